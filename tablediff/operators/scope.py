"""Row range ``[lo, hi)`` on one column, written so that Catalyst pushes it into the scan.

The bounds are turned into literals of the column's own type whenever that keeps the meaning exact; a literal of
another type would make Catalyst cast the column instead, and a cast column is no longer pushed to Parquet/JDBC.
Rows with NULL in the range column fall out, as with any comparison.
"""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import col
from ..functions.types import Category, ColumnInfo, is_integral
from ..spec import RowRange, bind_range, column_map


def _ceil_integral(value: Decimal) -> int:
    return int(math.ceil(value))


def _ceil_date(value: dt.datetime) -> dt.date:
    d = value.date()
    return d if value.time() == dt.time() else d + dt.timedelta(days=1)


_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def _integral_pair(t: T.DataType, lo: int, hi: int) -> tuple[Column | None, Column | None]:
    """Bounds of an integer column. A bound that all its values meet is left out (None); one that none can meet is
    replaced by the nearest one of the type that still keeps them out."""
    most = 2 ** (_BITS[type(t)] - 1) - 1
    least = -most - 1
    if lo > most or hi <= least:  # no value is in the range
        return F.lit(most).cast(t), F.lit(most).cast(t)
    lower = None if lo <= least else F.lit(lo).cast(t)
    return lower, None if hi > most else F.lit(hi).cast(t)


def _literal_pair(column: ColumnInfo, lo, hi) -> tuple[Column | None, Column | None]:
    """Bounds as literals of the column's type. For integers and dates, ``c >= x`` equals ``c >= ceil(x)`` and
    ``c < x`` equals ``c < ceil(x)``, so rounding both bounds up keeps the half-open range exact."""
    t = column.data_type
    cat = column.category
    if cat is Category.NUMERIC:
        if is_integral(t):
            return _integral_pair(t, _ceil_integral(lo), _ceil_integral(hi))
        if isinstance(t, T.DecimalType):
            def fits(v: Decimal) -> bool:
                exp = v.as_tuple().exponent
                scale = -exp if isinstance(exp, int) and exp < 0 else 0
                return scale <= t.scale and len(str(abs(int(v)))) <= t.precision - t.scale

            if fits(lo) and fits(hi):
                return F.lit(str(lo)).cast(t), F.lit(str(hi)).cast(t)
            return F.lit(lo), F.lit(hi)
        return F.lit(float(lo)).cast(t), F.lit(float(hi)).cast(t)
    if cat is Category.DATE:
        return F.lit(_ceil_date(lo)), F.lit(_ceil_date(hi))
    if cat is Category.TIMESTAMP:
        return F.lit(lo.isoformat(sep=" ")).cast("timestamp_ntz"), F.lit(hi.isoformat(sep=" ")).cast("timestamp_ntz")
    if cat is Category.TIMESTAMP_TZ:
        # Bounds without a zone are UTC instants; the session time zone is pinned to UTC.
        return F.lit(lo.isoformat(sep=" ")).cast("timestamp"), F.lit(hi.isoformat(sep=" ")).cast("timestamp")
    return F.lit(lo), F.lit(hi)


def range_predicate(column: ColumnInfo, rng: RowRange) -> Column:
    lo, hi = bind_range(column, rng)
    lo_lit, hi_lit = _literal_pair(column, lo, hi)
    c = col(column.name)
    kept = c.isNotNull()
    kept = kept if lo_lit is None else kept & (c >= lo_lit)
    return kept if hi_lit is None else kept & (c < hi_lit)


def apply_row_range(df: DataFrame, column_name: str | None, rng: RowRange | None) -> DataFrame:
    """The rows of ``df`` inside the range; the whole DataFrame when there is no range column."""
    if column_name is None:
        return df
    if rng is None:
        raise ValueError(f"range column '{column_name}' needs a row range")
    column = column_map(df.schema).get(column_name)
    if column is None:
        raise ValueError(f"range column '{column_name}' does not exist")
    return df.where(range_predicate(column, rng))
