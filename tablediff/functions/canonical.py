"""Canonical text, row fingerprints and checksum terms as native Spark expressions.

Equality is decided on these: exact decimals, NULL equal to NULL only, untrimmed case-sensitive strings, dates and
timestamps as timestamps with nine fractional digits, zoned timestamps as UTC instants. Every expression stays inside
whole-stage codegen; there is no Python UDF.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .types import Category, ColumnInfo

# Fixed values that must stay as they are for fingerprints to agree with other implementations of the same rule:
# the timestamp text pattern, the NULL piece (letter N and 32 zeros, as wide as a tagged md5) and the text hashed
# when a row has no fingerprint column at all.
TIMESTAMP_PATTERN = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSSSS"
NULL_PIECE = "N00000000000000000000000000000000"
EMPTY_ROW_TEXT = "-"
CHECKSUM_HEX_DIGITS = 15


def col(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def _utc_wall_clock(c: Column) -> Column:
    """A zoned timestamp as the UTC wall-clock time of its instant, independent of the session time zone."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(c), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def canonical(column: ColumnInfo, c: Column | None = None) -> Column:
    """The value as the text equality is decided on."""
    c = col(column.name) if c is None else c
    cat = column.category
    if cat is Category.NUMERIC:
        return c.cast("string")
    if cat is Category.TEXT:
        return c.cast("string")
    if cat in (Category.DATE, Category.TIMESTAMP):
        return F.date_format(c.cast("timestamp_ntz"), TIMESTAMP_PATTERN)
    if cat is Category.TIMESTAMP_TZ:
        return F.date_format(_utc_wall_clock(c), TIMESTAMP_PATTERN)
    raise ValueError(f"Column '{column.name}' has type {column.type_text}, which cannot be compared")


def piece(column: ColumnInfo) -> Column:
    """Fixed-width piece of one column: NULL is distinct from every value, so NULL equals NULL and nothing else."""
    c = col(column.name)
    return F.when(c.isNull(), F.lit(NULL_PIECE)).otherwise(F.concat(F.lit("V"), F.md5(canonical(column, c))))


def fingerprint(columns: Sequence[ColumnInfo]) -> Column:
    """Row fingerprint: md5 (32 hex characters) over the pieces of the given columns."""
    if not columns:
        return F.md5(F.lit(EMPTY_ROW_TEXT))
    return F.md5(F.concat(*[piece(c) for c in columns]))


def fingerprint_halves(fp: Column) -> tuple[Column, Column]:
    """The 128 bits of an md5 text as two signed longs.

    A pair of longs is fixed-width, so per-key aggregation over it stays a codegen'd hash aggregate and the shuffle
    carries 16 bytes instead of a 32-character string.
    """
    hi = F.conv(F.substring(fp, 1, 16), 16, -10).cast("bigint")
    lo = F.conv(F.substring(fp, 17, 16), 16, -10).cast("bigint")
    return hi, lo


def checksum_term(fp: Column) -> Column:
    """The first 60 bits of a fingerprint as a number; their sum is an order-independent checksum.

    60 bits times up to 10^20 rows stays inside decimal(38,0). Unlike xor, equal rows do not cancel out.
    """
    return F.conv(F.substring(fp, 1, CHECKSUM_HEX_DIGITS), 16, 10).cast("decimal(38,0)")


# Exact wide sums in plain longs: a value is split into 21-bit limbs, each limb is summed as a long (no overflow below
# 2^42 rows per group) and the limb sums are recombined once, after aggregation, into decimal(38,0). This keeps the
# aggregate buffers fixed-width, so the sums stay in the codegen'd hash aggregate instead of BigDecimal arithmetic.
LIMB_BITS = 21
LIMB_MASK = (1 << LIMB_BITS) - 1


def limbs(value: Column) -> list[Column]:
    """A signed long as ``[low, middle, high]`` with ``value = high * 2^42 + middle * 2^21 + low``."""
    v = value.cast("bigint")
    return [
        v.bitwiseAND(F.lit(LIMB_MASK)),
        F.shiftright(v, LIMB_BITS).bitwiseAND(F.lit(LIMB_MASK)),
        F.shiftright(v, 2 * LIMB_BITS),
    ]


def from_limbs(sums: list[Column]) -> Column:
    """Recombines limb sums into one exact decimal(38,0); NULL when the sums are NULL (no non-NULL value)."""
    total = None
    for i, s in enumerate(sums):
        term = s.cast("decimal(38,0)") * F.lit(1 << (LIMB_BITS * i)).cast("decimal(38,0)")
        total = term if total is None else total + term
    return total.cast("decimal(38,0)")


def checksum_bits(fp: Column) -> Column:
    """The fingerprint's first 60 bits as a long (the high 64 bits shifted right by 4, so never negative)."""
    hi, _ = fingerprint_halves(fp)
    return F.shiftrightunsigned(hi, 4)


def checksum_limbs(fp: Column) -> list[Column]:
    """Limbs of the fingerprint's first 60 bits."""
    return limbs(checksum_bits(fp))


def report_value(column: ColumnInfo, c: Column | None = None) -> Column:
    """A value as a report shows it: temporal values as canonical text, numbers and text natively."""
    c = col(column.name) if c is None else c
    if column.category.temporal:
        return canonical(column, c)
    return c
