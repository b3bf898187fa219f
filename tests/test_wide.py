from pyspark.sql import functions as F

from tablediff.operators import aggregate as agg
from tablediff.operators import rowdiff as rd
from tablediff.operators.columns import column_sets


def test_one_hundred_fifty_columns(spark):
    base = spark.range(2000).select(
        F.col("id"), *[(F.col("id") * i % 97).cast("string" if i % 2 else "bigint").alias(f"c{i}") for i in range(150)]
    )
    cand = base.withColumn("c149", F.when(F.col("id") == 7, F.lit("x")).otherwise(F.col("c149")))
    cs = column_sets(base.schema, ("id",))
    checks = agg.collect_checks(cand, base, cs)
    assert [c["check_name"] for c in checks if not c["agrees"]] == ["checksum"]
    diff = rd.diff_from_per_key(rd.per_key(cand, base, cs.key_columns, cs.fingerprint_columns), 1).collect()
    assert [(r["k0"], r["mismatch_type"]) for r in diff] == [(7, "different")]
