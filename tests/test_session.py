import pytest

from molweave.session import cut, ensure_checkpoint_dir, join_grouped


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_grouped_equals_a_plain_join(spark, how):
    rows = spark.createDataFrame([(1, i) for i in range(300)] + [(2, i) for i in range(5)] + [(3, 0), (None, 1)], "k long, v long")
    groups = spark.createDataFrame([(1, 300, "hot"), (2, 5, "cold")], "k long, n long, name string")
    key = lambda df: sorted((tuple(r) for r in df.select("k", "v", "n", "name").collect()), key=repr)
    assert key(join_grouped(rows, groups, ["k"], "n", 307, how, least=50)) == key(rows.join(groups, "k", how))
    assert key(join_grouped(rows, groups, ["k"], "n", 307, how)) == key(rows.join(groups, "k", how))


def test_cut_keeps_rows(spark):
    ensure_checkpoint_dir(spark)
    df = cut(spark.range(10))
    assert df.count() == 10 and "RDD" in df._jdf.queryExecution().logical().toString()


def test_rest_works_without_the_training_data_operators(monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    for name in [m for m in sys.modules if m.startswith("molweave.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "molweave.llm", None)
    entry = importlib.reload(__spark_entry__)
    assert "fingerprint_wl_parity" in entry.queries() and not any(q.startswith("p1_") for q in entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
