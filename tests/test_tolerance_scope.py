import datetime as dt
import json
from decimal import Decimal

import pytest
from helpers import disagreeing, run_pair

from tablediff.operators.columns import column_sets
from tablediff.operators.scope import apply_row_range
from tablediff.plans.compare import keyed_row_diff
from tablediff.spec import RowRange

DDL = "id bigint, price decimal(12,4), cost decimal(12,4), name string"


def df(spark, rows):
    return spark.createDataFrame([(i, Decimal(p), Decimal("1"), n) for i, p, n in rows], DDL)


TOL = {"price": "0.01"}


def test_within_tolerance_passes(spark):
    r = run_pair(spark, df(spark, [(1, "10.000", "x"), (2, "20.000", "x")]), df(spark, [(1, "10.004", "x"), (2, "19.996", "x")]), tolerances=TOL)
    assert r.verdict == "PASS"
    assert [t["column"] for t in r.tolerance_columns] == ["price"]


def test_beyond_tolerance_fails_on_sum_and_min(spark):
    r = run_pair(spark, df(spark, [(1, "10.000", "x"), (2, "20.000", "x")]), df(spark, [(1, "10.500", "x"), (2, "20.000", "x")]), tolerances=TOL)
    assert r.verdict == "FAIL"
    bad = disagreeing(r)
    assert "sum:price" in bad and "min:price" in bad and "max:price" not in bad


def test_blind_spot_by_design(spark):
    r = run_pair(spark, df(spark, [(1, "10", "x"), (2, "20", "x")]), df(spark, [(1, "20", "x"), (2, "10", "x")]), tolerances=TOL)
    assert r.verdict == "PASS"


def test_tolerance_in_samples(spark):
    c = df(spark, [(1, "10.000", "x"), (2, "20.000", "x")])
    b = df(spark, [(1, "10.004", "y"), (2, "21.000", "y")])
    cs = column_sets(c.schema, ("id",), (), TOL)
    _, sample = keyed_row_diff(c, b, cs)
    got = {json.loads(r["key"])["id"]: r["differing_columns"] for r in sample.collect()}
    assert got == {1: ["name"], 2: ["price", "name"]}


def test_half_open_date_range(spark):
    ddl = "id bigint, load_date date"
    c = spark.createDataFrame([(1, dt.date(2026, 1, 1)), (2, dt.date(2026, 2, 1))], ddl)
    b = spark.createDataFrame([(1, dt.date(2026, 1, 1))], ddl)
    r = run_pair(spark, c, b, range_column="load_date", rng=RowRange("2026-01-01", "2026-02-01"), full_refresh=False)
    assert r.verdict == "PASS"
    r = run_pair(spark, c, b, range_column="load_date", rng=RowRange("2026-01-01", "2026-02-02"), full_refresh=False)
    assert r.verdict == "FAIL"
    assert r.notes == []


def test_whole_table_fail_has_drift_note(spark):
    ddl = "id bigint, name string"
    r = run_pair(spark, spark.createDataFrame([(1, "a")], ddl), spark.createDataFrame([(1, "b")], ddl))
    assert r.verdict == "FAIL" and len(r.notes) == 1


def test_range_bounds_of_each_type(spark):
    ddl = "id bigint, d date, ts timestamp_ntz, amount decimal(10,2), batch string"
    rows = [
        (1, dt.date(2026, 1, 1), dt.datetime(2026, 1, 1, 12), Decimal("1.50"), "b1"),
        (2, dt.date(2026, 1, 2), dt.datetime(2026, 1, 2, 0), Decimal("2.50"), "b2"),
        (3, dt.date(2026, 1, 3), dt.datetime(2026, 1, 3, 0), Decimal("3.50"), "b3"),
    ]
    t = spark.createDataFrame(rows, ddl)

    def ids(column, lo, hi):
        return sorted(r["id"] for r in apply_row_range(t, column, RowRange(lo, hi)).collect())

    assert ids("id", "1.5", "3") == [2]
    assert ids("d", "2026-01-01T06:00:00", "2026-01-03") == [2]
    assert ids("ts", "2026-01-01T12:00:00", "2026-01-03") == [1, 2]
    assert ids("amount", "2.5", "3.5") == [2]
    assert ids("amount", "2.505", "9") == [3]
    assert ids("batch", "b2", "b3") == [2]


def test_range_is_pushed_to_parquet(spark, tmp_dir):
    ddl = "id bigint, ts timestamp_ntz"
    spark.createDataFrame([(1, dt.datetime(2026, 1, 1))], ddl).write.parquet(tmp_dir + "/t")
    t = spark.read.parquet(tmp_dir + "/t")
    plan = apply_row_range(t, "ts", RowRange("2026-01-01", "2026-01-02"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in plan
    plan = apply_row_range(t, "id", RowRange("0.5", "9"))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,1)" in plan


def test_empty_range_rejected(spark):
    ddl = "id bigint, batch string"
    t = spark.createDataFrame([(1, "a")], ddl)
    with pytest.raises(ValueError):
        apply_row_range(t, "batch", RowRange("b", "a"))


def test_range_column_may_be_ignored(spark):
    ddl = "id bigint, load_date date, name string"
    c = spark.createDataFrame([(1, dt.date(2026, 1, 1), "a"), (2, dt.date(2026, 3, 1), "zzz")], ddl)
    b = spark.createDataFrame([(1, dt.date(2026, 1, 5), "a")], ddl)
    r = run_pair(
        spark, c, b, range_column="load_date", rng=RowRange("2026-01-01", "2026-02-01"), full_refresh=False, ignored_columns=("load_date",)
    )
    assert r.verdict == "PASS"


def test_range_on_zoned_timestamp_uses_utc_instants(spark):
    utc = dt.timezone.utc
    rows = [(1, dt.datetime(2026, 1, 1, 9, 59, 59, tzinfo=utc)), (2, dt.datetime(2026, 1, 1, 10, 0, 0, tzinfo=utc)), (3, dt.datetime(2026, 1, 2, tzinfo=utc))]
    t = spark.createDataFrame(rows, "id bigint, z timestamp")
    got = sorted(r["id"] for r in apply_row_range(t, "z", RowRange("2026-01-01T10:00:00", "2026-01-02")).collect())
    assert got == [2]


def test_integer_bounds_beyond_the_type(spark):
    from tablediff.operators.scope import apply_row_range
    from tablediff.spec import RowRange

    df = spark.createDataFrame([(-(2**31),), (0,), (2**31 - 1,), (None,)], "v int")
    count = lambda lo, hi: apply_row_range(df, "v", RowRange(lo, hi)).count()
    assert count("0", "3000000000") == 2
    assert count("-3000000000", "1") == 2
    assert count("-3000000000", "3000000000") == 3
    assert count("3000000000", "4000000000") == 0
    assert count("-4000000000", "-3000000000") == 0
    assert count("0", "2147483647") == 1


def test_offset_of_a_bound_is_converted_for_a_zoned_column(spark):
    import datetime as dt

    from tablediff.operators.scope import apply_row_range
    from tablediff.spec import RowRange

    utc = dt.timezone.utc
    df = spark.createDataFrame([(dt.datetime(2026, 1, 1, h, tzinfo=utc),) for h in (1, 5, 6)], "t timestamp")
    assert apply_row_range(df, "t", RowRange("2026-01-01T00:30:00-05:00", "2026-01-02")).count() == 1
