"""Schema diff of the two sides by column name; the order of columns and nullability play no part."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import types as T


def column_types(schema: T.StructType, ignored: Collection[str] = ()) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in schema.fields if f.name not in ignored}


def schema_differences(candidate: T.StructType, baseline: T.StructType, ignored: Collection[str] = ()) -> list[str]:
    """One line per column that the sides do not share with one type: ``name: candidate type -> baseline type``, a
    missing column's type being ``none``; sorted by name."""
    types = [column_types(s, ignored) for s in (candidate, baseline)]
    rows = {n: tuple(t.get(n, "none") for t in types) for n in sorted({*types[0], *types[1]})}
    return [f"{name}: {c} -> {b}" for name, (c, b) in rows.items() if c != b]
