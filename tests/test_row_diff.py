import json
import math
from decimal import Decimal

import pytest
from conftest import SF01
from helpers import run_pair

from tablediff.operators import rowdiff as rd
from tablediff.operators.columns import column_sets
from tablediff.plans import fixtures as fx
from tablediff.plans.compare import keyed_row_diff

DDL = "id bigint, name string, amount decimal(10,2), note string"


def df(spark, rows, ddl=DDL):
    return spark.createDataFrame(rows, ddl)


def test_one_value_differs(spark):
    c = df(spark, [(1, "alpha", Decimal("1.00"), None), (2, "beta", Decimal("2.00"), None)])
    b = df(spark, [(1, "alpha", Decimal("1.00"), None), (2, "beta-prod", Decimal("2.00"), None)])
    r = run_pair(spark, c, b)
    assert r.verdict == "FAIL"
    assert (r.row_diff["different"], r.row_diff["only_in_candidate"], r.row_diff["only_in_baseline"]) == (1, 0, 0)
    assert [(s["mismatch_type"], s["differing_columns"]) for s in r.samples] == [("different", ["name"])]


def test_one_value_differs_sample(spark):
    c = df(spark, [(1, "alpha", Decimal("1.00"), None), (2, "beta", Decimal("2.00"), None)])
    b = df(spark, [(1, "alpha", Decimal("1.00"), None), (2, "beta-prod", Decimal("2.00"), None)])
    cs = column_sets(c.schema, ("id",))
    report, sample = keyed_row_diff(c, b, cs)
    rows = sample.collect()
    assert len(rows) == 1
    assert rows[0]["mismatch_type"] == "different"
    assert rows[0]["differing_columns"] == ["name"]
    assert json.loads(rows[0]["key"]) == {"id": 2}
    assert json.loads(rows[0]["candidate"])["note"] is None


def test_one_sided_keys(spark):
    c = df(spark, [(1, "a", None, None), (2, "b", None, None)])
    b = df(spark, [(1, "a", None, None), (3, "c", None, None)])
    r = run_pair(spark, c, b)
    assert (r.row_diff["only_in_candidate"], r.row_diff["only_in_baseline"], r.row_diff["different"]) == (1, 1, 0)


def test_padding_differs_scale_does_not(spark):
    c = df(spark, [(1, "padded", Decimal("2.00"), None)])
    b = df(spark, [(1, "padded ", Decimal("2"), None)])
    cs = column_sets(c.schema, ("id",))
    report, sample = keyed_row_diff(c, b, cs)
    assert report["different"] == 1
    assert sample.collect()[0]["differing_columns"] == ["name"]


def test_sample_cap(spark):
    c = df(spark, [(i, f"c{i}", None, None) for i in range(120)])
    b = df(spark, [(i, f"b{i}", None, None) for i in range(120)])
    r = run_pair(spark, c, b)
    assert r.row_diff["different"] == 120
    assert r.row_diff["sampled"] == 100


def test_sample_cap_per_type(spark):
    c = df(spark, [(i, "x", None, None) for i in range(5)] + [(100 + i, "y", None, None) for i in range(3)])
    b = df(spark, [(i, "z", None, None) for i in range(5)])
    r = run_pair(spark, c, b, sample_size=2)
    assert (r.row_diff["different"], r.row_diff["only_in_candidate"]) == (5, 3)
    assert r.row_diff["sampled"] == 4


def test_sample_keys_sort_as_text(spark):
    c = df(spark, [(i, "x", None, None) for i in (2, 10, 3)])
    b = df(spark, [(i, "y", None, None) for i in (2, 10, 3)])
    cs = column_sets(c.schema, ("id",))
    pk = rd.per_key(c, b, cs.key_columns, cs.fingerprint_columns)
    keys = [r["k0"] for r in rd.sample_keys(rd.diff_from_per_key(pk, 1), cs.key_columns, 2).collect()]
    assert keys == [10, 2]


def test_duplicates_on_candidate(spark):
    ddl = "id bigint, name string"
    r = run_pair(spark, df(spark, [(1, "a"), (1, "a"), (2, "b")], ddl), df(spark, [(1, "a"), (2, "b")], ddl))
    assert r.verdict == "FAIL"
    d = r.row_diff
    assert d["duplicate_keys"]["candidate"]["keys"] == 1
    assert d["duplicate_keys"]["candidate"]["top"] == [{"id": 1, "occurrences": 2}]
    assert d["duplicate_keys"]["baseline"]["keys"] == 0
    assert (d["only_in_candidate"], d["only_in_baseline"], d["different"]) == (0, 0, 0)


def test_null_keys_match_null_safely(spark):
    ddl = "id bigint, part string, name string"
    c = df(spark, [(1, None, "a"), (None, "x", "b")], ddl)
    b = df(spark, [(1, None, "a"), (None, "x", "c")], ddl)
    cs = column_sets(c.schema, ("id", "part"))
    report, sample = keyed_row_diff(c, b, cs)
    assert (report["different"], report["only_in_candidate"], report["only_in_baseline"]) == (1, 0, 0)
    row = sample.collect()[0]
    assert json.loads(row["key"]) == {"id": None, "part": "x"}
    assert row["differing_columns"] == ["name"]


def test_keyless_bags(spark):
    ddl = "id bigint, name string"
    c = df(spark, [(1, "a"), (1, "a"), (2, "b")], ddl)
    b = df(spark, [(1, "a"), (2, "b"), (2, "c")], ddl)
    r = run_pair(spark, c, b, keyless=True)
    cd = r.row_diff["count_differences"]
    assert (cd["differing_contents"], cd["extra_candidate_rows"], cd["extra_baseline_rows"]) == (2, 1, 1)
    assert sorted((t["n_candidate"], t["n_baseline"]) for t in cd["top"]) == [(0, 1), (2, 1)]


def test_keyless_forms_agree(spark):
    cand, base = fx.lineitem_pair(spark, SF01)
    cs = column_sets(cand.schema, ())
    a = sorted(tuple(r) for r in rd.keyless_counts(cand, base, cs.fingerprint_columns).collect())
    b = sorted(tuple(r) for r in rd.keyless_counts_join(cand, base, cs.fingerprint_columns).collect())
    assert a == b and len(a) > 0


def test_orders_regression_numbers(spark):
    cand, base = fx.orders_pair(spark, SF01)
    cs = column_sets(cand.schema, fx.ORDERS_KEYS, (), fx.ORDERS_TOLERANCES)
    counts = rd.diff_counts(rd.per_key(cand, base, cs.key_columns, cs.fingerprint_columns)).collect()[0]
    assert (counts["duplicate_keys_candidate"], counts["only_in_candidate"], counts["only_in_baseline"], counts["different"]) == (
        144, 149, 153, 351
    )


def test_one_shuffle_and_join_forms_agree(spark):
    cand, base = fx.orders_pair(spark, SF01)
    cs = column_sets(cand.schema, fx.ORDERS_KEYS, (), fx.ORDERS_TOLERANCES)
    pk = rd.per_key(cand, base, cs.key_columns, cs.fingerprint_columns)
    one = sorted(tuple(r) for r in rd.diff_from_per_key(pk, 1).collect())
    ckf = rd.key_fingerprint(cand, cs.key_columns, cs.fingerprint_columns)
    bkf = rd.key_fingerprint(base, cs.key_columns, cs.fingerprint_columns)
    join = sorted(tuple(r) for r in rd.keyed_diff_join(ckf, bkf, 1).collect())
    assert one == join


def test_one_bit_float_difference(spark):
    ddl = "id bigint, v double"
    r = run_pair(spark, df(spark, [(1, 0.2)], ddl), df(spark, [(1, math.nextafter(0.2, 1.0))], ddl))
    assert r.verdict == "FAIL"
    assert r.row_diff["different"] == 1


def test_float_sum_order_is_informational(spark):
    ddl = "id bigint, v double"
    vals = [1e16, 1.0, -1e16, 1.0]
    c = df(spark, [(i, v) for i, v in enumerate(vals)], ddl).repartition(4)
    b = df(spark, [(i, v) for i, v in reversed(list(enumerate(vals)))], ddl).coalesce(1)
    r = run_pair(spark, c, b)
    assert r.verdict == "PASS"
    s = [x for x in r.checks if x["check_name"] == "sum" and x["column_name"] == "v"][0]
    assert s["method"] == "informational" and s["decisive"] is False


@pytest.mark.parametrize("k", [1, 7, 40])
def test_mutating_k_rows_reports_exactly_those(spark, k):
    base = spark.read.parquet(f"{SF01}/customer.parquet")
    import pyspark.sql.functions as F

    picked = [r["c_custkey"] for r in base.orderBy(F.xxhash64("c_custkey", F.lit(k))).limit(k).collect()]
    cand = base.withColumn("c_name", F.when(F.col("c_custkey").isin(picked), F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")))
    cs = column_sets(base.schema, ("c_custkey",))
    diff = rd.diff_from_per_key(rd.per_key(cand, base, cs.key_columns, cs.fingerprint_columns), 1).collect()
    assert sorted(r["k0"] for r in diff) == sorted(picked)
    assert {r["mismatch_type"] for r in diff} == {"different"}
