import pytest

from anamnesis.plans import catalog

from .compare import SF, same


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, name):
    same(catalog.QUERIES[name], catalog.SQL[name], spark)


def test_probing_all_clusters_is_exact(spark):
    rows = {r.nprobe: r.recall for r in catalog.QUERIES["ann_recall"](spark, SF).collect()}
    assert rows["all"] == 1.0 and rows["auto"] >= 0.9


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry_without_the_training_data_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'rrf' in e.queries() and 'pipeline' not in e.queries() and 'rrf' in e.oracle_sql()"
    from .conftest import ROOT

    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
