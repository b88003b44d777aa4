"""Driver contract: entry() runs; every query has an oracle; every query gives the same rows at
1 and 16 shuffle partitions."""

import pytest

import __spark_entry__ as E
from labelflow.plans import catalog

from .conftest import SF001

NON_SQL = {"step_training"}  # of the library's own queries: its steps are serial


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 2 and {r.dataset for r in rows} == {"hatemm", "mhc"}


def test_every_query_has_oracle():
    q, o = E.queries(), E.oracle_sql()
    assert set(catalog.QUERIES) <= set(q)
    assert set(catalog.QUERIES) - set(o) == NON_SQL
    assert set(o) <= set(q)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_partition_independence(spark, name):
    fn = E.queries()[name]
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    a = sorted(map(tuple, fn(spark, SF001).collect()), key=repr)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    b = sorted(map(tuple, fn(spark, SF001).collect()), key=repr)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a == b


FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "SortAggregate")


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_plan_has_no_slow_path(spark, name):
    """No registered query plans a cross product, a nested-loop join, a row-at-a-time Python
    UDF or a sort-based aggregate."""
    plan = E.queries()[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert not [k for k in FORBIDDEN if k in plan]


def test_entry_without_what_the_training_data_part_needs(monkeypatch, capsys):
    """A package that the subpackage needs is absent: the other queries are all there."""
    import sys
    for name in [m for m in sys.modules if m.startswith("labelflow.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    import labelflow
    monkeypatch.delattr(labelflow, "llm", raising=False)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    monkeypatch.setitem(sys.modules, "sentencepiece", None)
    found = E.queries()
    assert set(catalog.QUERIES) <= set(found)
    if "op4_simhash" not in found:
        assert "left out" in capsys.readouterr().err
