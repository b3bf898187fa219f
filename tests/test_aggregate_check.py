import datetime as dt
from decimal import Decimal

from helpers import check, disagreeing, run_pair

DDL = "id bigint, amount decimal(38,20), name string, note string, created timestamp_ntz, load_ts timestamp_ntz"
CREATED = dt.datetime(2026, 1, 1, 10, 30, 0)
LOAD_TS = dt.datetime(2026, 2, 1, 0, 0, 1)


def row(i, amount="10.5", name="alpha", note=None, created=CREATED, load_ts=LOAD_TS):
    return (i, None if amount is None else Decimal(amount), name, note, created, load_ts)


def pair(spark, cand_rows, base_rows, ddl=DDL):
    return spark.createDataFrame(cand_rows, ddl), spark.createDataFrame(base_rows, ddl)


def test_identical_data_passes(spark):
    rows = [row(1), row(2, note="x"), row(3, amount=None, name=None)]
    r = run_pair(spark, *pair(spark, rows, rows))
    assert r.verdict == "PASS"
    assert disagreeing(r) == []
    assert r.row_diff["status"] == "SKIPPED"


def test_report_shows_both_values(spark):
    rows = [row(1), row(2, note="x")]
    r = run_pair(spark, *pair(spark, rows, rows))
    names = {(c["check_name"], c["column_name"]) for c in r.checks}
    assert {("row_count", None), ("sum", "amount"), ("sum", "id"), ("null_count", "note"), ("checksum", None)} <= names
    assert Decimal(check(r, "sum", "amount")["candidate"]) == Decimal("21.0")
    assert int(check(r, "null_count", "note")["candidate"]) == 1


def test_row_count_difference_fails(spark):
    r = run_pair(spark, *pair(spark, [row(1), row(2)], [row(1)]))
    assert r.verdict == "FAIL"
    assert "row_count" in disagreeing(r)
    c = check(r, "row_count")
    assert (c["candidate"], c["baseline"]) == ("2", "1")


def test_numeric_sum_difference_fails(spark):
    r = run_pair(spark, *pair(spark, [row(1, amount="10.5")], [row(1, amount="11.5")]))
    assert r.verdict == "FAIL"
    assert "sum:amount" in disagreeing(r)
    assert Decimal(check(r, "sum", "amount")["baseline"]) == Decimal("11.5")


def test_null_rate_difference_fails(spark):
    r = run_pair(spark, *pair(spark, [row(1, note=None)], [row(1, note="x")]))
    assert "null_count:note" in disagreeing(r)


def test_value_change_only_moves_checksum(spark):
    r = run_pair(spark, *pair(spark, [row(1, name="alpha")], [row(1, name="alphb")]))
    assert r.verdict == "FAIL"
    assert disagreeing(r) == ["checksum"]
    assert r.row_diff["different"] == 1


def test_checksum_ignores_row_order(spark):
    a = [row(1), row(2, name="beta"), row(3, name="gamma")]
    r = run_pair(spark, *pair(spark, a, list(reversed(a))))
    assert r.verdict == "PASS"


def test_ignored_column_difference_passes(spark):
    c = [row(1, load_ts=dt.datetime(2026, 3, 1)), row(2)]
    b = [row(1, load_ts=dt.datetime(2026, 3, 2)), row(2)]
    assert run_pair(spark, *pair(spark, c, b), ignored_columns=("load_ts",)).verdict == "PASS"
    assert run_pair(spark, *pair(spark, c, b)).verdict == "FAIL"


def test_twenty_fractional_digits_are_exact(spark):
    r = run_pair(spark, *pair(spark, [row(1, amount="0.12345678901234567891")], [row(1, amount="0.12345678901234567892")]))
    assert r.verdict == "FAIL"
    assert {"sum:amount", "checksum"} <= set(disagreeing(r))
    assert check(r, "sum", "amount")["candidate"].endswith("891")


def test_null_equals_null_but_not_blank_or_zero(spark):
    assert run_pair(spark, *pair(spark, [row(1, note=None, amount=None)], [row(1, note=None, amount=None)])).verdict == "PASS"
    r = run_pair(spark, *pair(spark, [row(1, note=None)], [row(1, note=" ")]))
    assert r.verdict == "FAIL" and "null_count:note" in disagreeing(r)
    assert run_pair(spark, *pair(spark, [row(1, amount=None)], [row(1, amount="0")])).verdict == "FAIL"


def test_trailing_spaces_differ(spark):
    r = run_pair(spark, *pair(spark, [row(1, name="alpha")], [row(1, name="alpha ")]))
    assert disagreeing(r) == ["checksum"]


def test_time_of_day_and_fraction_differ(spark):
    r = run_pair(spark, *pair(spark, [row(1, created=dt.datetime(2026, 1, 1))], [row(1, created=dt.datetime(2026, 1, 1, 0, 0, 1))]))
    assert disagreeing(r) == ["checksum"]
    r = run_pair(
        spark,
        *pair(spark, [row(1, load_ts=dt.datetime(2026, 1, 1, 0, 0, 0, 1))], [row(1, load_ts=dt.datetime(2026, 1, 1, 0, 0, 0, 2))]),
    )
    assert r.verdict == "FAIL"


def test_extra_column_is_schema_difference(spark):
    c = spark.createDataFrame([(1, "a", "x")], "id bigint, name string, extra string")
    b = spark.createDataFrame([(1, "a")], "id bigint, name string")
    r = run_pair(spark, c, b)
    assert r.verdict == "FAIL"
    assert any("extra" in d for d in r.schema_differences)
    assert r.checks is None


def test_type_change_is_schema_difference(spark):
    c = spark.createDataFrame([(1, Decimal("1.00"))], "id bigint, v decimal(12,2)")
    b = spark.createDataFrame([(1, Decimal("1.000"))], "id bigint, v decimal(12,3)")
    r = run_pair(spark, c, b)
    assert r.schema_differences == ["v: decimal(12,2) -> decimal(12,3)"]


def test_duplicate_check_needs_both_sides_clean(spark):
    ddl = "id bigint, name string"
    both = [(1, "a"), (1, "a")]
    r = run_pair(spark, spark.createDataFrame(both, ddl), spark.createDataFrame(both, ddl))
    assert r.verdict == "FAIL"
    assert "duplicate_key_rows" in disagreeing(r)


def test_empty_sides_pass(spark):
    ddl = "id bigint, name string"
    e = spark.createDataFrame([], ddl)
    r = run_pair(spark, e, e)
    assert r.verdict == "PASS"
    assert check(r, "checksum")["candidate"] is None


def test_checks_of_collected_values_equal_those_of_the_plan(spark):
    from conftest import SF01

    from tablediff.operators import aggregate as agg
    from tablediff.operators.columns import column_sets
    from tablediff.plans import fixtures as fx

    cand, base = fx.orders_pair(spark, SF01)
    for tol in (fx.ORDERS_TOLERANCES, {}):
        cs = column_sets(cand.schema, fx.ORDERS_KEYS, (), tol)
        values = agg.aggregate_values(cand, base, cs)
        assert values.schema.simpleString() == agg.aggregate_values_schema(cs).simpleString()
        counted = agg.with_duplicates(values, agg.duplicate_key_rows(cand, base, cs.key_columns))
        local = agg.checks_of(spark, [r.asDict() for r in counted.collect()], cs)
        key = lambda r: (r["check_name"], r["column_name"] or "")
        assert sorted(local, key=key) == sorted(agg.collect_checks(cand, base, cs), key=key)


def test_float_sum_and_verdict_do_not_depend_on_row_order(spark):
    values = [1e16, 1.0, -1e16, 1.0, 0.1, 0.2, 0.3]
    rows = [(i, v) for i, v in enumerate(values)]
    turned = [(i, v) for i, v in enumerate(values)][::-1]
    c = spark.createDataFrame(rows, "id int, v double").repartition(1)
    b = spark.createDataFrame(turned, "id int, v double").repartition(3)
    r = run_pair(spark, c, b, tolerances={"v": "0.01"})
    assert r.verdict == "PASS"
    assert abs(float(check(r, "sum", "v")["candidate"]) - 2.6) < 0.05
    assert check(r, "sum", "v")["candidate"] == check(r, "sum", "v")["baseline"]


def test_equal_nan_and_infinity_agree_under_a_tolerance(spark):
    rows = [(1, float("nan")), (2, float("inf")), (3, 1.5)]
    c = spark.createDataFrame(rows, "id int, v double")
    assert run_pair(spark, c, c, tolerances={"v": "0.01"}).verdict == "PASS"
    other = spark.createDataFrame([(1, 0.5), (2, float("inf")), (3, 1.5)], "id int, v double")
    assert run_pair(spark, c, other, tolerances={"v": "0.01"}).verdict == "FAIL"
