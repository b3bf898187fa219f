"""Digests of key classes: where two sides differ, before any row is exchanged.

Rows are dealt into classes by a hash of their key (without a key: of their whole content), so the same key has the
same class on both sides. The aggregate check, which reads every row anyway, is made per class: a class's digest is its
number of rows and the sum of its row fingerprints, which does not depend on the order of the rows. The class rows roll
up to the values of the whole check, and classes whose digests agree hold the same rows on both sides, so a row diff
need not exchange them. Ten changed rows lie in ten of 256 classes at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import checksum_bits, col, fingerprint, fingerprint_halves, limbs
from .aggregate import BASELINE, CANDIDATE, SIDE, final_exprs, partial_rows, rolled_up
from .columns import ColumnSets

CLASSES = 256
CLASS = "class"
_DIGEST = ("row_count", "_ck_0", "_ck_1", "_ck_2")


def class_of(cs: ColumnSets, classes: int = CLASSES) -> Column:
    """A row's class, from the first 32 bits of its key's fingerprint (without a key, of its own)."""
    high, _ = fingerprint_halves(fingerprint(list(cs.key_columns) or cs.fingerprint_columns))
    return F.pmod(F.shiftrightunsigned(high, 32), F.lit(classes)).cast("int")


def class_rows(candidate: DataFrame, baseline: DataFrame, cs: ColumnSets, classes: int = CLASSES) -> DataFrame:
    """The aggregate check's partials per side and class: twice ``classes`` rows at most. Each side is read once."""

    def side(df: DataFrame, name: str) -> DataFrame:
        parts = partial_rows(df, cs, [class_of(cs, classes)])
        return parts.withColumnRenamed("_g0", CLASS).withColumn(SIDE, F.lit(name))

    return side(candidate, CANDIDATE).unionByName(side(baseline, BASELINE))


def values_of(rows: DataFrame, cs: ColumnSets) -> DataFrame:
    """:func:`..aggregate.aggregate_values` from the class rows."""

    def side(name: str) -> DataFrame:
        return rolled_up(rows.where(col(SIDE) == name), cs).select(F.lit(name).alias(SIDE), *final_exprs(cs))

    return side(CANDIDATE).unionByName(side(BASELINE))


def differing_classes(rows: DataFrame) -> DataFrame:
    """``class, rows_candidate, rows_baseline`` of the classes whose digests differ."""
    names = [n for n in _DIGEST if n in rows.columns]

    def of(side: str, name: str) -> Column:
        return F.coalesce(F.max(F.when(col(SIDE) == side, col(name))), F.lit(0).cast("bigint"))

    sides = [of(s, n).alias(f"{s}_{n}") for s in (CANDIDATE, BASELINE) for n in names]
    pairs = [col(f"{CANDIDATE}_{n}") != col(f"{BASELINE}_{n}") for n in names]
    differ = pairs[0]
    for p in pairs[1:]:
        differ = differ | p
    wide = rows.groupBy(CLASS).agg(*sides).where(differ)
    return wide.select(CLASS, col(f"{CANDIDATE}_row_count").alias("rows_candidate"), col(f"{BASELINE}_row_count").alias("rows_baseline"))


def class_digests(df: DataFrame, cs: ColumnSets, classes: int = CLASSES) -> DataFrame:
    """``class, row_count, _ck_0.._ck_2`` of one side alone, for whoever keeps digests between runs."""
    rows = df.select(class_of(cs, classes).alias(CLASS), checksum_bits(fingerprint(cs.fingerprint_columns)).alias("_bits"))
    parts = limbs(col("_bits"))
    return rows.groupBy(CLASS).agg(F.count(F.lit(1)).alias("row_count"), *[F.sum(p).alias(f"_ck_{j}") for j, p in enumerate(parts)])
