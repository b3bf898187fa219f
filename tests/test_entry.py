import sys

import __spark_entry__ as entry_mod
from conftest import SF001

from tablediff.plans import suite
from tablediff.plans.suite_sql import queries_sql


def test_entry_runs(spark):
    rows = entry_mod.entry(spark).collect()
    assert len(rows) == 1
    assert set(rows[0].asDict()) >= {"only_in_candidate", "only_in_baseline", "different"}


def test_every_query_has_an_oracle():
    assert set(suite.QUERIES) == set(queries_sql())
    registered, sql = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(suite.QUERIES) <= set(registered)
    assert set(sql) <= set(registered)


def test_a_failing_import_leaves_the_other_queries(monkeypatch):
    monkeypatch.setitem(sys.modules, "tablediff.llm", None)
    monkeypatch.delitem(sys.modules, "tablediff.llm.queries", raising=False)
    assert set(entry_mod.queries()) == set(suite.QUERIES)
    assert set(entry_mod.oracle_sql()) == set(suite.QUERIES)


def test_every_query_runs_on_the_smallest_tables(spark):
    for name in suite.QUERIES:
        df = entry_mod.queries()[name](spark, SF001)
        df.collect()
        assert len(df.columns) == len(set(df.columns)), name
