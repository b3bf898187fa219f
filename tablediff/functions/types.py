"""What a column's Spark type means for comparison.

Six categories decide which expression a column gets: numbers compare as exact values, text as is, dates and
timestamps as timestamps, zoned timestamps as instants; everything else cannot be compared and must be ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import types as T


class Category(Enum):
    # value: (name, numeric, temporal, comparable, usable_as_key); the name keeps members with equal flags distinct
    NUMERIC = ("numeric", True, False, True, True)
    TEXT = ("text", False, False, True, True)
    DATE = ("date", False, True, True, True)
    TIMESTAMP = ("timestamp", False, True, True, True)
    TIMESTAMP_TZ = ("timestamp_tz", False, True, True, False)
    OTHER = ("other", False, False, False, False)

    @property
    def numeric(self) -> bool:
        return self.value[1]

    @property
    def temporal(self) -> bool:
        return self.value[2]

    @property
    def comparable(self) -> bool:
        return self.value[3]

    @property
    def usable_as_key(self) -> bool:
        return self.value[4]


_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATING = (T.FloatType, T.DoubleType)


def category_of(data_type: T.DataType) -> Category:
    if isinstance(data_type, _INTEGRAL + _FLOATING + (T.DecimalType,)):
        return Category.NUMERIC
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return Category.TEXT
    if isinstance(data_type, T.DateType):
        return Category.DATE
    if isinstance(data_type, T.TimestampNTZType):
        return Category.TIMESTAMP
    if isinstance(data_type, T.TimestampType):
        return Category.TIMESTAMP_TZ
    return Category.OTHER


def is_floating(data_type: T.DataType) -> bool:
    """IEEE floats: their sums depend on the order of addition, so a sum of them never decides."""
    return isinstance(data_type, _FLOATING)


def is_integral(data_type: T.DataType) -> bool:
    return isinstance(data_type, _INTEGRAL)


@dataclass(frozen=True)
class ColumnInfo:
    """A column as the dataset's real schema reports it."""

    name: str
    data_type: T.DataType

    @property
    def category(self) -> Category:
        return category_of(self.data_type)

    @property
    def floating(self) -> bool:
        return is_floating(self.data_type)

    @property
    def type_text(self) -> str:
        return self.data_type.simpleString()


def columns_of(schema: T.StructType) -> list[ColumnInfo]:
    return [ColumnInfo(f.name, f.dataType) for f in schema.fields]
