"""One key (or one row content) holding a third of all rows."""

from pyspark.sql import functions as F

from tablediff.operators import aggregate as agg
from tablediff.operators import rowdiff as rd
from tablediff.operators.columns import column_sets

N = 300_000


def sides(spark):
    base = spark.range(N).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("id"),
        F.concat(F.lit("v"), (F.col("id") % 1000).cast("string")).alias("name"),
        (F.col("id") % 7).cast("decimal(10,2)").alias("amount"),
    )
    cand = base.withColumn("name", F.when(F.col("id") % 1000 == 1, F.lit("changed")).otherwise(F.col("name")))
    return cand, base


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def assert_partial_then_exchange(df):
    plan = plan_of(df)
    assert "SortAggregate" not in plan
    assert "partial_" in plan


def test_hot_key_is_one_duplicated_key(spark):
    cand, base = sides(spark)
    cs = column_sets(base.schema, ("id",))
    pk = rd.per_key(cand, base, cs.key_columns, cs.fingerprint_columns)
    assert_partial_then_exchange(pk)
    counts = rd.diff_counts(pk).collect()[0]
    assert counts["duplicate_keys_candidate"] == 1 and counts["duplicate_keys_baseline"] == 1
    assert counts["duplicate_rows_candidate"] == N // 3 - 1
    changed = sum(1 for i in range(N) if i % 3 != 0 and i % 1000 == 1)
    assert counts["different"] == changed and counts["only_in_candidate"] == 0
    dup = agg.duplicate_key_rows(cand, base, cs.key_columns)
    assert_partial_then_exchange(dup)
    assert {r["side"]: r["duplicate_key_rows"] for r in dup.collect()} == {"candidate": N // 3 - 1, "baseline": N // 3 - 1}


def test_hot_key_differing_columns(spark):
    cand, base = sides(spark)
    cs = column_sets(base.schema, ("id",))
    df = rd.differing_columns_by_key(cand, base, cs.key_columns, cs.compared, cs.fingerprint_columns)
    assert_partial_then_exchange(df)
    rows = df.collect()
    assert {r["column_name"] for r in rows} == {"name"}
    assert len(rows) == sum(1 for i in range(N) if i % 3 != 0 and i % 1000 == 1)


def test_hot_content_keyless(spark):
    cand, base = sides(spark)
    cs = column_sets(base.schema.__class__([f for f in base.schema.fields if f.name != "id"]))
    c, b = cand.drop("id"), base.drop("id")
    bag = rd.keyless_counts(c, b, cs.fingerprint_columns)
    assert_partial_then_exchange(bag)
    summary = rd.keyless_summary(bag).collect()[0]
    assert summary["extra_candidate_rows"] == summary["extra_baseline_rows"] > 0


def test_join_form_reduces_a_hot_key_before_the_join(spark):
    cand, base = sides(spark)
    cs = column_sets(base.schema, ("id",))
    ckf = rd.key_fingerprint(cand, cs.key_columns, cs.fingerprint_columns)
    bkf = rd.key_fingerprint(base, cs.key_columns, cs.fingerprint_columns)
    joined = rd.keyed_diff_join(ckf, bkf, 1)
    assert_partial_then_exchange(joined)
    pk = rd.per_key(cand, base, cs.key_columns, cs.fingerprint_columns)
    assert sorted(tuple(r) for r in joined.collect()) == sorted(tuple(r) for r in rd.diff_from_per_key(pk, 1).collect())


def test_building_a_plan_starts_no_job(spark):
    cand, base = sides(spark)
    cs = column_sets(base.schema, ("id",))
    spark.sparkContext.setJobGroup("building", "plans only")
    ckf = rd.key_fingerprint(cand, cs.key_columns, cs.fingerprint_columns)
    bkf = rd.key_fingerprint(base, cs.key_columns, cs.fingerprint_columns)
    pk = rd.per_key(cand, base, cs.key_columns, cs.fingerprint_columns)
    rd.unique_key_rows(ckf, rd.duplicate_key_union(ckf, bkf, 1), 1)
    rd.keyed_diff_join(ckf, bkf, 1)
    rd.keyed_report(pk, cs.key_columns)
    rd.differing_columns_by_key(cand, base, cs.key_columns, cs.compared, cs.fingerprint_columns)
    rd.keyless_counts(cand, base, cs.fingerprint_columns)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup("building") == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_keyed_report_has_one_exchange_of_the_keys(spark):
    cand, base = sides(spark)
    cs = column_sets(base.schema, ("id",))
    pk = rd.per_key(cand, base, cs.key_columns, cs.fingerprint_columns)
    report = rd.keyed_report(pk, cs.key_columns, 5)
    report.collect()
    plan = report._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    keyed = [x for x in final.splitlines() if "Exchange hashpartitioning(k0" in x and "Reused" not in x]
    assert len(keyed) == 1, final
