"""The aggregate check as SQL that a database answers itself.

A side that is a database table need not send its rows for the aggregate check: the expressions of
:mod:`..functions.canonical` are rendered in the database's dialect and sent as one query, whose answer is one row, or
one row per key class. Both sides must be asked in the same dialect: within one dialect equal values have equal texts,
between two they need not (the text of a float, the zeros after a decimal point).
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import CHECKSUM_HEX_DIGITS, EMPTY_ROW_TEXT, NULL_PIECE, col
from ..functions.types import Category, ColumnInfo
from ..operators.aggregate import BASELINE, CANDIDATE, SIDE, aggregate_values_schema, max_name, min_name, nonnull_name, sum_name
from ..operators.columns import ColumnSets
from ..operators.digest import CLASS
from ..spec import RowRange, bind_range


class Dialect:
    """Standard SQL with md5 as a function on text. A database's own ways are methods of its subclass."""

    name = "standard"

    def name_of(self, column: str) -> str:
        if not column or "\x00" in column:
            raise ValueError(f"Invalid identifier: {column!r}")
        return '"' + column.replace('"', '""') + '"'

    def text_literal(self, text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def literal(self, value) -> str:
        """A bound's value (see ``spec.bind_bound``)."""
        if isinstance(value, Decimal):
            return format(value, "f")
        if isinstance(value, dt.datetime):
            return f"TIMESTAMP '{value.isoformat(sep=' ')}'"
        return self.text_literal(value)

    # --- canonical text

    def number_text(self, x: str) -> str:
        return f"CAST({x} AS VARCHAR)"

    def time_text(self, x: str) -> str:
        raise NotImplementedError

    def utc(self, x: str) -> str:
        """A zoned timestamp as the wall clock of UTC."""
        return f"({x} AT TIME ZONE 'UTC')"

    def canonical(self, c: ColumnInfo) -> str:
        x = self.name_of(c.name)
        if c.category is Category.NUMERIC:
            return self.number_text(x)
        if c.category is Category.TEXT:
            return x
        if c.category in (Category.DATE, Category.TIMESTAMP):
            return self.time_text(x)
        if c.category is Category.TIMESTAMP_TZ:
            return self.time_text(self.utc(x))
        raise ValueError(f"column '{c.name}' has type {c.type_text}, which takes no part in a comparison")

    # --- fingerprints

    def md5(self, text: str) -> str:
        return f"md5({text})"

    def whole(self, hexadecimal: str) -> str:
        """The number that a text of at most 15 hexadecimal digits stands for."""
        raise NotImplementedError

    def remainder(self, number: str, by: int) -> str:
        return f"MOD({number}, {by})"

    def fingerprint(self, columns) -> str:
        if not columns:
            return self.md5(self.text_literal(EMPTY_ROW_TEXT))
        parts = []
        for c in columns:
            tagged = f"'V' || {self.md5(self.canonical(c))}"
            parts.append(f"CASE WHEN {self.name_of(c.name)} IS NULL THEN '{NULL_PIECE}' ELSE {tagged} END")
        return self.md5(" || ".join(parts))

    def key_class(self, cs: ColumnSets, classes: int) -> str:
        text = self.fingerprint(list(cs.key_columns) or cs.fingerprint_columns)
        return self.remainder(self.whole(f"substr({text}, 1, 8)"), classes)

    # --- aggregates

    def wide(self, number: str) -> str:
        """A number whose sum over all rows must not overflow."""
        return f"CAST({number} AS DECIMAL(38, 0))"

    def float_sum(self, x: str) -> str:
        return f"SUM({x})"

    def sum_of(self, c: ColumnInfo) -> str:
        x = self.name_of(c.name)
        if c.floating:
            return self.float_sum(x)
        return f"SUM({x})" if isinstance(c.data_type, T.DecimalType) else f"SUM({self.wide(x)})"

    def row_range(self, column: ColumnInfo, rng: RowRange) -> str:
        lo, hi = bind_range(column, rng)
        x = self.name_of(column.name)
        return f"{x} >= {self.literal(lo)} AND {x} < {self.literal(hi)}"

    def aggregate_query(self, relation: str, cs: ColumnSets, where: str | None = None, classes: int | None = None) -> str:
        """One row with the values of :func:`..operators.aggregate.aggregate_values`, or one per class of keys."""
        out = ["COUNT(*) AS " + self.name_of("row_count")]
        out += [f"{self.sum_of(c)} AS {self.name_of(sum_name(c))}" for c in cs.sum_columns]
        out += [f"COUNT({self.name_of(c.name)}) AS {self.name_of(nonnull_name(c))}" for c in cs.null_columns]
        for c in cs.tolerance_columns:
            out += [f"{how}({self.name_of(c.name)}) AS {self.name_of(name(c))}" for how, name in (("MIN", min_name), ("MAX", max_name))]
        if cs.fingerprint_columns:
            bits = self.whole(f"substr({self.fingerprint(cs.fingerprint_columns)}, 1, {CHECKSUM_HEX_DIGITS})")
            out.append(f"SUM({self.wide(bits)}) AS {self.name_of('checksum')}")
        group = ""
        if classes is not None:
            by = self.key_class(cs, classes)
            out.insert(0, f"{by} AS {self.name_of(CLASS)}")
            group = f" GROUP BY {by}"
        condition = f" WHERE {where}" if where else ""
        return f"SELECT {', '.join(out)} FROM {relation}{condition}{group}"

    # --- splitting a read

    def split_query(self, relation: str, column: str, parts: int, where: str | None = None) -> str:
        """Where each of ``parts`` equally full stretches of a column begins, among the rows of the range."""
        x = self.name_of(column)
        condition = f"{x} IS NOT NULL" + (f" AND {where}" if where else "")
        ranked = f"SELECT {x} AS v, NTILE({parts}) OVER (ORDER BY {x}) AS part FROM {relation} WHERE {condition}"
        return f"SELECT MIN(v) AS v FROM ({ranked}) q GROUP BY part ORDER BY 1"


class DuckDb(Dialect):
    name = "duckdb"

    def time_text(self, x: str) -> str:
        return f"strftime(CAST({x} AS TIMESTAMP_NS), '%Y-%m-%dT%H:%M:%S.%n')"

    def whole(self, hexadecimal: str) -> str:
        return f"CAST('0x' || {hexadecimal} AS BIGINT)"

    def remainder(self, number: str, by: int) -> str:
        return f"CAST({number} % {by} AS INTEGER)"

    def float_sum(self, x: str) -> str:
        return f"fsum({x})"


class Oracle(Dialect):
    name = "oracle"

    def number_text(self, x: str) -> str:
        return f"TO_CHAR({x}, 'TM9', 'NLS_NUMERIC_CHARACTERS=''.,''')"

    def time_text(self, x: str) -> str:
        return f"TO_CHAR(CAST({x} AS TIMESTAMP(9)), 'YYYY-MM-DD\"T\"HH24:MI:SS.FF9')"

    def utc(self, x: str) -> str:
        return f"SYS_EXTRACT_UTC({x})"

    def md5(self, text: str) -> str:
        return f"LOWER(RAWTOHEX(STANDARD_HASH({text}, 'MD5')))"

    def whole(self, hexadecimal: str) -> str:
        return f"TO_NUMBER({hexadecimal}, '{'X' * CHECKSUM_HEX_DIGITS}')"

    def wide(self, number: str) -> str:
        return number


class Postgres(Dialect):
    name = "postgresql"

    def time_text(self, x: str) -> str:
        return f"to_char(CAST({x} AS timestamp), 'YYYY-MM-DD\"T\"HH24:MI:SS.US') || '000'"

    def whole(self, hexadecimal: str) -> str:
        return f"CAST(CAST('x' || lpad({hexadecimal}, 16, '0') AS bit(64)) AS bigint)"


DIALECTS = {d.name: d for d in (DuckDb(), Oracle(), Postgres())}


def dialect_named(name: str) -> Dialect:
    if name not in DIALECTS:
        raise ValueError(f"no SQL dialect {name!r}; known: {', '.join(sorted(DIALECTS))}")
    return DIALECTS[name]


# --- the answers ---------------------------------------------------------------------------------------------------


def typed_answer(answer: DataFrame, cs: ColumnSets, side: str) -> DataFrame:
    """A query's answer with this library's types, whatever numbers the driver made of it: rows (side, class, values)."""
    by_name = {c.lower(): c for c in answer.columns}
    fields = [f for f in aggregate_values_schema(cs).fields if f.name != SIDE]
    values = [col(by_name[f.name.lower()]).cast(f.dataType).alias(f.name) for f in fields]
    return answer.select(F.lit(side).alias(SIDE), col(by_name[CLASS]).cast("int").alias(CLASS), *values)


def values_of_answers(rows: DataFrame, cs: ColumnSets) -> DataFrame:
    """The answers per class, a bounded number of rows, as one row per side (also for a side without rows)."""
    how = {n(c): f for c in cs.tolerance_columns for n, f in ((min_name, F.min), (max_name, F.max))}
    schema = aggregate_values_schema(cs)
    counts = {"row_count", *[nonnull_name(c) for c in cs.null_columns]}

    def side(name: str) -> DataFrame:
        out = []
        for f in schema.fields[1:]:
            total = how.get(f.name, F.sum)(col(f.name)).cast(f.dataType)
            out.append((F.coalesce(total, F.lit(0).cast("bigint")) if f.name in counts else total).alias(f.name))
        return rows.where(col(SIDE) == name).agg(*out).select(F.lit(name).alias(SIDE), *schema.names[1:])

    return side(CANDIDATE).unionByName(side(BASELINE))


def differing_answers(rows: DataFrame) -> DataFrame:
    """``class`` of the classes whose number of rows or checksum differ."""
    zero = F.lit(0).cast("decimal(38,0)")
    names = [n for n in ("row_count", "checksum") if n in rows.columns]
    signed = [
        F.sum(F.when(col(SIDE) == CANDIDATE, col(n).cast("decimal(38,0)")).otherwise(-col(n).cast("decimal(38,0)"))).alias(n) for n in names
    ]
    differ = None
    for n in names:
        one = F.coalesce(col(n), zero) != zero
        differ = one if differ is None else differ | one
    return rows.groupBy(CLASS).agg(*signed).where(differ).select(CLASS)
