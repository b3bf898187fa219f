"""Which columns each part of a comparison uses, derived once from the candidate's schema and the spec."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import types as T

from ..functions.types import ColumnInfo, columns_of


@dataclass(frozen=True)
class ColumnSets:
    compared: tuple[ColumnInfo, ...]
    # numeric compared columns, keys and tolerance columns included
    sum_columns: tuple[ColumnInfo, ...]
    # every compared column
    null_columns: tuple[ColumnInfo, ...]
    # compared minus tolerance columns: the row fingerprint and the checksum
    fingerprint_columns: tuple[ColumnInfo, ...]
    key_columns: tuple[ColumnInfo, ...] = ()
    tolerance_columns: tuple[ColumnInfo, ...] = ()
    tolerances: dict[str, Decimal] = field(default_factory=dict)


def column_sets(
    candidate_schema: T.StructType,
    key_columns=(),
    ignored_columns=(),
    tolerances: dict | None = None,
) -> ColumnSets:
    """Column sets in the candidate's column order; both sides are evaluated in that order."""
    tolerances = {k: Decimal(str(v)) for k, v in (tolerances or {}).items()}
    ignored = set(ignored_columns)
    all_cols = columns_of(candidate_schema)
    by_name = {c.name: c for c in all_cols}
    compared = tuple(c for c in all_cols if c.name not in ignored)
    return ColumnSets(
        compared=compared,
        sum_columns=tuple(c for c in compared if c.category.numeric),
        null_columns=compared,
        fingerprint_columns=tuple(c for c in compared if c.name not in tolerances),
        key_columns=tuple(by_name[k] for k in key_columns),
        tolerance_columns=tuple(c for c in compared if c.name in tolerances),
        tolerances=tolerances,
    )
