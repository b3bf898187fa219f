"""Digests of key classes: what they tell, and what the row diff then leaves out."""

import pytest
from helpers import run_pair
from plans import exchanged
from pyspark.sql import functions as F

from tablediff.operators import aggregate as agg
from tablediff.operators import digest
from tablediff.operators import rowdiff as rd
from tablediff.operators.columns import column_sets
from tablediff.plans import compare as cmp

N = 20_000
DDL = "id long, name string, amount decimal(10,2), v double"


def table(spark, n=N):
    return spark.range(n).select(
        "id",
        F.concat(F.lit("v"), (F.col("id") % 1000).cast("string")).alias("name"),
        (F.col("id") % 7).cast("decimal(10,2)").alias("amount"),
        (F.col("id") / 3).alias("v"),
    )


def changed(df, ids):
    return df.withColumn("name", F.when(F.col("id").isin(ids), F.lit("changed")).otherwise(F.col("name")))


def differing(spark, cand, base, cs):
    rows = digest.class_rows(cand, base, cs)
    local = spark.createDataFrame(rows.collect(), rows.schema)
    return local, sorted(r["class"] for r in digest.differing_classes(local).collect())


def test_the_class_rows_roll_up_to_the_whole_check(spark):
    base = table(spark)
    cand = changed(base.where("id % 11 <> 0"), [5])
    for keys, tolerances in ((("id",), {}), ((), {}), (("id",), {"v": "0.5", "amount": "1"})):
        cs = column_sets(base.schema, keys, (), tolerances)
        local, _ = differing(spark, cand, base, cs)
        want = agg.aggregate_values(cand, base, cs).collect()
        assert sorted(map(tuple, digest.values_of(local, cs).collect())) == sorted(map(tuple, want))
        assert digest.values_of(local, cs).schema.simpleString() == agg.aggregate_values_schema(cs).simpleString()


def test_classes_that_differ_are_those_of_the_changed_keys(spark):
    base = table(spark)
    ids = [3, 77, 1234, 19_999]
    cs = column_sets(base.schema, ("id",))
    _, found = differing(spark, changed(base, ids), base, cs)
    assert found == sorted({r[0] for r in base.where(F.col("id").isin(ids)).select(digest.class_of(cs)).collect()})
    _, found = differing(spark, base.repartition(7), base, cs)
    assert found == []


@pytest.mark.parametrize("side", ["candidate", "baseline"])
def test_an_empty_side_differs_in_all_classes(spark, side):
    base = table(spark, 5000)
    none = base.where("false")
    cs = column_sets(base.schema, ("id",))
    cand, other = (none, base) if side == "candidate" else (base, none)
    local, found = differing(spark, cand, other, cs)
    assert len(found) == digest.CLASSES
    counts = {r["side"]: r["row_count"] for r in digest.values_of(local, cs).collect()}
    assert counts[side] == 0 and sum(counts.values()) == 5000
    nothing, found = differing(spark, none, none, cs)
    assert found == [] and [r["row_count"] for r in digest.values_of(nothing, cs).collect()] == [0, 0]


def test_ten_changed_rows_exchange_under_a_tenth_of_the_keys(spark):
    base = table(spark)
    cand = changed(base, list(range(0, N, N // 10)))
    cs = column_sets(base.schema, ("id",))
    _, found = differing(spark, cand, base, cs)
    assert 0 < len(found) <= 10
    pk = rd.per_key_of_classes(cand, base, cs, found, digest.CLASSES)
    report = rd.keyed_report(pk, cs.key_columns)
    rows = report.collect()
    assert next(r for r in rows if r["part"] == "counts")["different"] == 10
    with_prints = exchanged(report, "is_c") or exchanged(report, "max")
    every = rd.keyed_report(rd.per_key(cand, base, cs.key_columns, cs.fingerprint_columns), cs.key_columns)
    every.collect()
    # Both sides' rows with fingerprints against one side's bare keys for the duplicates.
    assert exchanged(every) >= 2 * N
    assert exchanged(report) <= N + 2 * N // 10
    assert with_prints <= 2 * N // 10


def test_the_narrowed_diff_equals_the_whole_one(spark):
    base = table(spark).union(table(spark).where("id IN (4, 8, 15, 16)")).union(table(spark).where("id IN (15)"))
    cand = changed(base.where("id NOT IN (100, 200)"), [16, 23, 42]).union(table(spark).where("id = 108"))
    cs = column_sets(base.schema, ("id",))
    _, found = differing(spark, cand, base, cs)
    narrow, sample = cmp.keyed_row_diff(cand, base, cs, differing=found)
    whole, all_sample = cmp.keyed_row_diff(cand, base, cs)
    assert len(found) < digest.CLASSES
    assert narrow == whole
    assert narrow["duplicate_rows"] == {"candidate": 6, "baseline": 5}
    assert sorted(map(str, sample.collect())) == sorted(map(str, all_sample.collect()))


def test_compare_with_a_key_without_one_and_within_a_tolerance(spark):
    base = table(spark, 3000)
    cand = changed(base, [7, 8])
    result = run_pair(spark, cand, base)
    assert result.verdict == "FAIL" and result.row_diff["different"] == 2
    assert sorted(s["mismatch_type"] for s in result.samples) == ["different"] * 2
    result = run_pair(spark, cand, base, keyless=True)
    assert result.row_diff["count_differences"]["differing_contents"] == 4
    # Only a tolerance column differs, so no class does: nothing to exchange, but the duplicates are still counted.
    drifted = base.union(base.where("id = 9")).withColumn("amount", (F.col("amount") + 5).cast("decimal(10,2)"))
    result = run_pair(spark, drifted, base.union(base.where("id = 9")), tolerances={"amount": "1"})
    assert result.verdict == "FAIL" and result.row_diff["different"] == 0
    assert {k: v["keys"] for k, v in result.row_diff["duplicate_keys"].items()} == {"candidate": 1, "baseline": 1}


def test_one_side_alone_has_the_same_digests(spark):
    base = table(spark, 4000)
    cs = column_sets(base.schema, ("id",))
    rows = digest.class_rows(base, base, cs).where("side = 'baseline'")
    names = ["class", "row_count", "_ck_0", "_ck_1", "_ck_2"]
    alone = digest.class_digests(base.repartition(3), cs).select(*names)
    assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, rows.select(*names).collect()))


def test_a_fingerprint_becomes_a_number_once_for_each_row(spark):
    base = table(spark, 100)
    keyless = column_sets(base.schema, (), ("v",))
    for df in (digest.class_rows(base, base, keyless), digest.class_digests(base, keyless)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        sums = [line for line in plan.splitlines() if "Aggregate [" in line]
        assert sums and not any("conv(" in line or "md5(" in line for line in sums)


def test_classes_of_contents_are_those_of_their_md5(spark):
    base = table(spark, 300)
    cs = column_sets(base.schema, (), ("v",))
    fp = digest.fingerprint(cs.fingerprint_columns)
    found = base.select(digest.class_of(cs), fp, digest.class_of(cs, 7)).collect()
    assert all((a, b) == (int(text[:8], 16) % 256, int(text[:8], 16) % 7) for a, text, b in found)
