"""Sums of IEEE columns: exact within a band, the same for every order of the rows, from one scan."""

import math
import random

import pytest
from plans import nodes
from pyspark.sql import functions as F

from tablediff.operators import aggregate as agg
from tablediff.operators.columns import column_sets


def sums(spark, values, parts=1, kind="double"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"id long, v {kind}").repartition(parts)
    cs = column_sets(df.schema, ("id",))
    return agg.aggregate_values(df, df, cs).collect()[0]["sum__v"]


@pytest.mark.parametrize(
    "values,want",
    [
        ([1e16, 1.0, -1e16, 1.0], 2.0),
        ([0.1] * 10, math.fsum([0.1] * 10)),
        ([5e-324, 5e-324, None], 1e-323),
        ([1.7976931348623157e308, -1.7976931348623157e308, 2.5], 2.5),
        ([2.0**k for k in range(-60, 60)], math.fsum(2.0**k for k in range(-60, 60))),
        ([2.0**-20, 2.0**44, math.nextafter(2.0**44, 0), math.nextafter(2.0**-20, 0)], math.fsum([2.0**-20, 2.0**44, math.nextafter(2.0**44, 0), 2.0**-20])),
        ([0.0, -0.0], 0.0),
        ([None, None], None),
        ([1.0, float("inf")], float("inf")),
        ([3, 4], 7.0),
    ],
)
def test_small_sums(spark, values, want):
    got = sums(spark, [None if v is None else float(v) for v in values])
    assert got == want


def test_odd_values_are_the_sum(spark):
    assert math.isnan(sums(spark, [1.0, float("nan"), float("inf")]))
    assert math.isnan(sums(spark, [float("-inf"), float("inf")]))


def test_sums_of_all_magnitudes_are_close_to_the_exact_one_and_independent_of_the_order(spark):
    rng = random.Random(4)
    for low, high in ((-1074, 1000), (-30, 30), (-3, 3), (900, 1020), (-1074, -900)):
        values = [rng.choice((-1, 1)) * math.ldexp(rng.random(), rng.randint(low, high)) for _ in range(400)]
        exact = math.fsum(values)
        got = {sums(spark, rng.sample(values, len(values)), parts) for parts in (1, 5)}
        assert len(got) == 1
        assert abs(got.pop() - exact) <= 4 * math.ulp(exact)


def test_floats_of_single_precision(spark):
    values = [0.1, 0.2, -3.5, 1e30]
    import struct

    narrow = [struct.unpack("f", struct.pack("f", v))[0] for v in values]
    assert sums(spark, values, kind="float") == math.fsum(narrow)


def test_shuffled_copies_agree_bit_by_bit_and_each_side_is_read_once(spark, tmp_dir):
    rng = random.Random(8)
    rows = [(k, rng.uniform(-1, 1) * 10 ** rng.randint(-12, 12), rng.gauss(0, 1), k % 5) for k in range(5000)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c int")
    df.repartition(3).write.parquet(f"{tmp_dir}/x")
    df.orderBy(F.rand(3)).write.parquet(f"{tmp_dir}/y")
    x, y = (spark.read.parquet(f"{tmp_dir}/{n}") for n in "xy")
    values = agg.aggregate_values(x, y, column_sets(df.schema, ("id",)))
    one, other = values.drop("side").collect()
    assert one == other
    assert one["sum__a"] == pytest.approx(math.fsum(r[1] for r in rows), rel=1e-15)
    assert len(nodes(values, "FileSourceScanExec")) == 2
