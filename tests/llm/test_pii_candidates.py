import pytest

from anamnesis.llm import pii

SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize(("text", "value", "kind"), [
    ("x password=CorrectHorseBattery y", "CorrectHorseBattery", "secret"), ('x token = "abcdefabcdefabcdefab" y', "abcdefabcdefabcdefab", "secret"),
    ("see ghp_AbCdEfGhIjKlMnOpQrSt here", "ghp_AbCdEfGhIjKlMnOpQrSt", "key"), ("xoxb-abcdefghijklmnopqr", "xoxb-abcdefghijklmnopqr", "key"),
    ("login: quickfox", "quickfox", None), ("badge#AbcDef", "AbcDef", None),
])
def test_identifiers_without_a_digit(spark, text, value, kind):
    assert (value, kind) in [(v, k) for _, _, v, k, _, _ in pii.scan(text)]
    rows = pii.occurrences(spark.createDataFrame([(1, "plain words"), (2, text)], SCHEMA)).collect()
    assert (2, value, kind) in [(r.doc_id, r.value, r.seed) for r in rows]
    if kind:
        assert value not in pii.redact(spark.createDataFrame([(1, text)], SCHEMA)).first().text


def test_a_cue_finds_values_without_a_digit(spark):
    rows = [(i, f"login: user{'abcdefghij'[i]}@example.org") for i in range(10)] + [(99, "login: quickfox"), (100, "then: quickly")]
    found = {(r.doc_id, r.value, r.pattern) for r in pii.pii(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (99, "quickfox", "cue") in found and not any(x[0] == 100 for x in found)


def test_both_ways_to_redact_give_the_same_rows(spark):
    rows = [(1, "mail a.b@example.org now"), (1, "nothing here at all, nothing"), (None, "so write to c@example.org"), (None, "password=CorrectHorseBattery"), (2, None), (1, "mail a.b@example.org now")]
    df = spark.createDataFrame(rows, SCHEMA)
    one, two = (sorted(((r.doc_id or 0, r.text or "") for r in pii.redact(df, limit).collect())) for limit in (pii.MAX_BROADCAST, -1))
    assert one == two and (1, "nothing here at all, nothing") in two and pii.redact(df, -1).columns == df.columns


def test_long_shapes_differ():
    assert pii.shape("a-1-" * 40 + "b") != pii.shape("a-1-" * 40 + "7")
