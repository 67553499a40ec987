from pyspark.sql import functions as F

import corpus_pipeline as P
from anamnesis.llm import bpe, decontamination, ngram_join, pii, quality_rules
from anamnesis.llm.frames import table

from ..compare import SF
from .test_operators import brute_jaccard


def test_stages_and_brute_force(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    kept = P.rules(spark, docs, SF)
    assert kept.columns == columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert 0.5 * docs.count() < len(rows) < docs.count()
    root = {i: i for i, _ in rows}
    pairs = brute_jaccard(rows, ngram_join.N, ngram_join.THRESHOLD)
    for _ in range(20):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    single = P.near_copies(spark, kept, SF)
    assert single.columns == columns and {r.doc_id for r in single.collect()} == {i for i in root if root[i] == i}
    items = [decontamination.normalise(r.text) for r in table(spark, SF, "benchmark").collect()]
    clean = P.benchmark_leaks(spark, single, SF)
    leaked = {r.doc_id for r in single.collect()} - {r.doc_id for r in clean.collect()}
    assert clean.columns == columns and leaked >= {r.doc_id for r in single.collect() if any(i in decontamination.normalise(r.text) for i in items)}
    private = P.private_data(spark, clean, SF)
    assert private.columns == columns and private.where("text LIKE '%@mail%'").count() == 0
    text = {r.doc_id: r.text for r in private.collect()}
    out = P.tokens(spark, private, SF)
    back = {r.doc_id: r.text for r in bpe.decode(out).collect()}
    assert back == text
    run = P.run(spark, SF)
    assert {r.doc_id: r.tokens for r in run.collect()} == {r.doc_id: r.tokens for r in out.collect()}
    assert [n for n, _ in P.STAGES] == ["quality_rules", "ngram_join", "decontamination", "pii", "bpe"]
    assert quality_rules.MAX_LOSS == 0.5 and pii.CONFIDENCE == 0.9


def test_awkward_rows_go_through_all_stages(spark, tmp_path):
    prose = "The first sentence of this text is about nothing much. The second one goes on for a while, and then it ends. "
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [
        (1, prose, "a"), (1, "Quite another text under the very same number. It shares no run of words.", "b"), (2, prose, "c"), (None, prose, "d"), (None, "A text without a number that says what no other does.", "e"),
        (3, None, "f"), (4, "", "g"), (5, " \n\t ", "h"), (6, f"So they wrote: {leak} And that was it.", "i"), (7, "Write to joe.smith@mail.example.com if you like to know more about this.", "j"),
        (8, "Menu\nHome\nLogin", "k"), (9, " ".join(f"word{k}" for k in range(40_000)) + ".", "l"), (10, "今天天气很好。我们去公园散步。", "m"), (10, "今天天气很好。我们去公园散步。", "m"),
    ]
    wide = "doc_id long, text string, q string, `row` string, `__gone` string, node string, kept string, spans string, lines string, tokens string"
    docs = spark.createDataFrame([(i, t, m, *["x"] * 7) for i, t, m in rows], wide)
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = docs
    for _, stage in P.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
    got = {(r.doc_id, r.q): r for r in kept.collect()}
    assert set(got) == {(1, "a"), (1, "b"), (None, "d"), (None, "e"), (7, "j"), (9, "l"), (10, "m")} and kept.count() == 8
    assert "<EMAIL>" in got[7, "j"].text and got[10, "m"].text == "今天天气很好。我们去公园散步。" and all(r.spans == r.lines == "x" for r in got.values())
    out = P.run(spark, str(tmp_path))
    assert out.count() == 8 and all(r.round_trip for r in out.collect())
    docs.limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    docs.limit(0).select(F.lit(1).cast("long").alias("item_id"), "text").write.parquet(f"{tmp_path}/empty/benchmark.parquet")
    assert P.run(spark, f"{tmp_path}/empty").count() == 0
