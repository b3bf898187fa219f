"""The aggregate check: one pass per side, compared value by value.

Both sides are scanned in one job: each is projected to the compared columns and aggregated globally, and the two
results are unioned, so the only exchange carries one partial row per task and side. Duplicate keys need a shuffle of
every key, so they are a separate step (:func:`duplicate_key_rows`) that a comparison runs only when it can change the
outcome.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import LIMB_BITS, canonical, checksum_bits, col, fingerprint, from_limbs, limbs
from ..functions.types import ColumnInfo, is_floating, is_integral
from .columns import ColumnSets

CANDIDATE = "candidate"
BASELINE = "baseline"
SIDE = "side"


def _limbed(c: ColumnInfo) -> bool:
    """Integers and decimals whose unscaled value fits a long are summed exactly in long limbs."""
    t = c.data_type
    return is_integral(t) or (isinstance(t, T.DecimalType) and t.precision <= 18)


def _unscaled(c: ColumnInfo) -> Column:
    t = c.data_type
    if isinstance(t, T.DecimalType) and t.scale > 0:
        return (col(c.name) * F.lit(10**t.scale)).cast("bigint")
    return col(c.name).cast("bigint")


# --- exact sums of IEEE columns -----------------------------------------------------------------------------------
#
# A finite value is a whole multiple of a power of two. Values whose magnitudes lie in one band of 64 binary orders
# share that power, so within a band they are added as integers: nothing is rounded, whatever the order of the rows.
# The bands of a row's IEEE columns are grouping keys of the first aggregate, which is still one pass with a map-side
# step; band 0 takes 2^-20 to 2^44 (and zeros and NULLs), so a table of amounts has one group.

BAND = 64
BAND_START = -20
LOWEST_BAND, HIGHEST_BAND = -17, 16
PIECE_BITS = 42
FLOAT_LIMBS = 6


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def _power(base: int, band: Column) -> list[Column]:
    """Two factors whose product is 2^(base - BAND * band): one alone could leave the range of a double."""
    bands = range(LOWEST_BAND, HIGHEST_BAND + 1)
    exponents = [base - BAND * b for b in bands]
    halves = ([e // 2 for e in exponents], [e - e // 2 for e in exponents])
    texts = [", ".join(f"{2.0**e!r}D" for e in part) for part in halves]
    return [F.get(F.expr(f"array({text})"), band - LOWEST_BAND) for text in texts]


# Magnitudes of a band are whole multiples of 2^(BAND * band - UNIT): 52 bits below its start, one more since the
# logarithm may be off by one at a power of two.
UNIT = 53 - BAND_START


def _with_bands(df: DataFrame, floats: list[tuple[int, ColumnInfo]]) -> DataFrame:
    """``df`` with, for each IEEE column i, its band ``_e<i>`` and its value in the band's unit as three whole pieces
    ``_p<i>_0`` to ``_p<i>_2`` of PIECE_BITS bits; ``_x<i>`` is the value itself where it is not finite."""
    names = {i: f"_v{i}" for i, _ in floats}
    df = df.withColumns({names[i]: col(c.name).cast("double") for i, c in floats})
    bands = {}
    for i, _ in floats:
        x = col(names[i])
        order = F.floor(F.log2(F.when(_finite(x) & (x != 0), F.abs(x)).otherwise(F.lit(1.0))))
        bands[f"_e{i}"] = F.floor((order - BAND_START) / BAND).cast("int")
    df = df.withColumns(bands)
    whole, pieces = {}, {}
    for i, _ in floats:
        x, up = col(names[i]), _power(UNIT, col(f"_e{i}"))
        whole[f"_w{i}"] = F.when(_finite(x), F.abs(x) * up[0] * up[1])
        whole[f"_x{i}"] = F.when(~_finite(x), x)
    df = df.withColumns(whole)
    high, middle = 2.0 ** (2 * PIECE_BITS), 2.0**PIECE_BITS
    for i, _ in floats:
        sign = F.when(col(names[i]) < 0, F.lit(-1)).otherwise(F.lit(1)).cast("bigint")
        w = col(f"_w{i}")
        top = F.floor(w / high)
        rest = w - top * high
        mid = F.floor(rest / middle)
        parts = (rest - mid * middle, mid, top)
        pieces |= {f"_p{i}_{j}": sign * part.cast("bigint") for j, part in enumerate(parts)}
    return df.withColumns(pieces)


def _float_limbs(i: int) -> list[Column]:
    """The pieces as 21-bit limbs, lowest first: their sums fit longs below 2^42 rows."""
    out = []
    for j in range(3):
        low, high, _ = limbs(F.abs(col(f"_p{i}_{j}")))
        sign = F.signum(col(f"_p{i}_{j}")).cast("bigint")
        out += [sign * low, sign * high]
    return out


def _float_total(bands: Column) -> Column:
    """The sum of an IEEE column from its bands' limb sums (array of e, l0..l5, each band once), in a fixed order."""

    def of_band(b: Column) -> Column:
        low, high = (from_limbs([b[f"l{3 * h + j}"] for j in range(3)]) for h in (0, 1))
        unit = F.lit(Decimal(1 << (3 * LIMB_BITS))).cast("decimal(38,0)")
        carry = ((low - F.pmod(low, unit)) / unit).cast("decimal(38,0)")
        back = _power(UNIT, b["e"])
        whole = (high + carry).cast("double") * 2.0 ** (3 * LIMB_BITS) + F.pmod(low, unit).cast("double")
        return whole / back[0] / back[1]

    ordered = F.transform(F.reverse(F.array_sort(bands)), of_band)
    return F.aggregate(ordered, F.lit(0.0), lambda a, x: a + x)


# --- aggregates of a side -----------------------------------------------------------------------------------------


def _sum_partials(c: ColumnInfo, i: int) -> list[tuple[str, str, Column]]:
    """What is summed for a column besides the bands of an IEEE one: integers (and short decimals, by their unscaled
    value) as 21-bit limbs in longs, long decimals themselves, of an IEEE column NaN and the infinities."""
    if _limbed(c):
        return [(f"_s{i}_{j}", "sum", part) for j, part in enumerate(limbs(_unscaled(c)))]
    if is_floating(c.data_type):
        return [(f"_odd{i}", "sum", col(f"_x{i}")), (f"_some{i}", "count", col(c.name))]
    return [(f"_s{i}_0", "sum", col(c.name))]


def _sum_final(c: ColumnInfo, i: int) -> Column:
    if _limbed(c):
        total = from_limbs([col(f"_s{i}_{j}") for j in range(3)])
        t = c.data_type
        if isinstance(t, T.DecimalType) and t.scale > 0:
            # Rescaled through the exact integer text: decimal division would round the scale. Runs once per side.
            total = F.concat(total.cast("string"), F.lit(f"E-{t.scale}")).cast(T.DecimalType(38, t.scale))
        return total
    if is_floating(c.data_type):
        own = F.transform(
            F.filter("_bands", lambda b: b["i"] == i),
            lambda b: F.struct(b["e"].alias("e"), *[b[f"l{j}"].alias(f"l{j}") for j in range(FLOAT_LIMBS)]),
        )
        return F.coalesce(col(f"_odd{i}"), F.when(col(f"_some{i}") > 0, _float_total(own)))
    return col(f"_s{i}_0").cast(T.DecimalType(38, c.data_type.scale))


def sum_name(c: ColumnInfo) -> str:
    return f"sum__{c.name}"


def nonnull_name(c: ColumnInfo) -> str:
    return f"nonnull__{c.name}"


def min_name(c: ColumnInfo) -> str:
    return f"min__{c.name}"


def max_name(c: ColumnInfo) -> str:
    return f"max__{c.name}"


def _partials(cs: ColumnSets) -> list[tuple[str, str, Column]]:
    """(name, how its values of several groups combine, input) of everything a side is aggregated to."""
    out = [("row_count", "count", F.lit(1))]
    for i, c in enumerate(cs.sum_columns):
        out += _sum_partials(c, i)
    out += [(nonnull_name(c), "count", col(c.name)) for c in cs.null_columns]
    for c in cs.tolerance_columns:
        out += [(min_name(c), "min", col(c.name)), (max_name(c), "max", col(c.name))]
    if cs.fingerprint_columns:
        out += [(f"_ck_{j}", "sum", part) for j, part in enumerate(limbs(col("_bits")))]
    return out


_OF_ROWS = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
_OF_GROUPS = {"count": "sum", "sum": "sum", "min": "min", "max": "max"}


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _partial_names(cs: ColumnSets) -> list[tuple[str, str]]:
    """Name and way of combining of ``_partials``."""
    out = [("row_count", "count")]
    for i, c in enumerate(cs.sum_columns):
        if _limbed(c):
            out += [(f"_s{i}_{j}", "sum") for j in range(3)]
        elif is_floating(c.data_type):
            out += [(f"_odd{i}", "sum"), (f"_some{i}", "count")]
        else:
            out.append((f"_s{i}_0", "sum"))
    out += [(nonnull_name(c), "count") for c in cs.null_columns]
    out += [(n(c), how) for c in cs.tolerance_columns for n, how in ((min_name, "min"), (max_name, "max"))]
    if cs.fingerprint_columns:
        out += [(f"_ck_{j}", "sum") for j in range(3)]
    return out


def _combined(cs: ColumnSets, made: bool) -> list[Column]:
    """The aggregates of ``_partials``, of the rows or (``made``) of groups that are aggregated already."""
    if made:
        return [F.expr(f"{_OF_GROUPS[how]}({_quoted(name)})").alias(name) for name, how in _partial_names(cs)]
    return [_OF_ROWS[how](part).alias(name) for name, how, part in _partials(cs)]


def partial_rows(df: DataFrame, cs: ColumnSets, by: list[Column] | None = None) -> DataFrame:
    """One row per group of ``by`` (one row at all without it): ``_partials`` and, with IEEE columns, ``_bands``, an
    array of (i, e, l0..l5) with the limb sums of each column's bands. ``df`` is read once."""
    by = by or []
    names = [f"_g{k}" for k in range(len(by))]
    # The text of a fingerprint becomes a number once, in the projection: the sums take their limbs from that.
    fp = [checksum_bits(fingerprint(cs.fingerprint_columns)).alias("_bits")] if cs.fingerprint_columns else []
    rows = df.select(*[c.alias(n) for n, c in zip(names, by, strict=True)], *[col(c.name) for c in cs.compared], *fp)
    floats = [(i, c) for i, c in enumerate(cs.sum_columns) if is_floating(c.data_type)]
    if not floats:
        return rows.groupBy(*names).agg(*_combined(cs, False))
    banded = _with_bands(rows, floats)
    sums = [F.sum(x).alias(f"_l{i}_{j}") for i, _ in floats for j, x in enumerate(_float_limbs(i))]
    groups = banded.groupBy(*names, *[f"_e{i}" for i, _ in floats]).agg(*_combined(cs, False), *sums)

    # The groups are few. Their rows are dealt out as one with the partials and one per IEEE column and band.
    own = [name for name, _ in _partial_names(cs)]
    types = {f.name: f.dataType.simpleString() for f in groups.schema.fields}

    def part(i: int | None) -> str:
        fields = [f"{-1 if i is None else i} AS i", f"{0 if i is None else f'_e{i}'} AS e"]
        fields += [f"{'CAST(NULL AS BIGINT)' if i is None else f'_l{i}_{j}'} AS l{j}" for j in range(FLOAT_LIMBS)]
        fields += [f"{_quoted(n) if i is None else f'CAST(NULL AS {types[n]})'} AS {_quoted(n)}" for n in own]
        return f"struct({', '.join(fields)})"

    every = ", ".join([part(None), *[part(i) for i, _ in floats]])
    dealt = groups.selectExpr(*names, f"inline(array({every}))")
    limb_sums = [F.expr(f"coalesce(sum(l{j}), 0L)").alias(f"l{j}") for j in range(FLOAT_LIMBS)]
    once = dealt.groupBy(*names, "i", "e").agg(*limb_sums, *_combined(cs, True))
    band = f"struct(i, e, {', '.join(f'l{j}' for j in range(FLOAT_LIMBS))})"
    # One row of each group has the partials: whichever aggregate leaves its values as they are.
    kept = [F.expr(f"max({_quoted(n)})").alias(n) for n in own]
    return once.groupBy(*names).agg(*kept, F.expr(f"collect_list(CASE WHEN i >= 0 THEN {band} END)").alias("_bands"))


def rolled_up(parts: DataFrame, cs: ColumnSets) -> DataFrame:
    """The partial rows of several groups, a bounded number, as one row."""
    if "_bands" not in parts.columns:
        return parts.agg(*_combined(cs, True))
    all_bands = F.flatten(F.collect_list("_bands"))

    def merged(bands: Column) -> Column:
        keys = F.array_distinct(F.transform(bands, lambda b: F.struct(b["i"].alias("i"), b["e"].alias("e"))))

        def total(key: Column, j: int) -> Column:
            same = F.filter(bands, lambda b: (b["i"] == key["i"]) & (b["e"] == key["e"]))
            return F.aggregate(same, F.lit(0).cast("bigint"), lambda a, b: a + b[f"l{j}"])

        return F.transform(keys, lambda k: F.struct(k["i"].alias("i"), k["e"].alias("e"), *[total(k, j).alias(f"l{j}") for j in range(FLOAT_LIMBS)]))

    return parts.agg(*_combined(cs, True), all_bands.alias("_all")).withColumn("_bands", merged(col("_all"))).drop("_all")


def final_exprs(cs: ColumnSets) -> list[Column]:
    """The reported values of a side from its row of partials (also where the side has no rows)."""
    zero = F.lit(0).cast("bigint")
    out = [F.coalesce("row_count", zero).alias("row_count")]
    out += [_sum_final(c, i).alias(sum_name(c)) for i, c in enumerate(cs.sum_columns)]
    out += [F.coalesce(col(nonnull_name(c)), zero).alias(nonnull_name(c)) for c in cs.null_columns]
    for c in cs.tolerance_columns:
        out += [col(min_name(c)), col(max_name(c))]
    if cs.fingerprint_columns:
        out.append(from_limbs([col(f"_ck_{j}") for j in range(3)]).alias("checksum"))
    return out


def aggregate_values(candidate: DataFrame, baseline: DataFrame, cs: ColumnSets) -> DataFrame:
    """One row per side: row_count, sum__c, nonnull__c, min__c/max__c (tolerance columns), checksum.

    Each side is read once (no rows: count 0, sums NULL); the two are unioned, so both scans run in one job and only
    the tasks' partial rows are exchanged.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        return partial_rows(df, cs).select(F.lit(name).alias(SIDE), *final_exprs(cs))

    return side(candidate, CANDIDATE).unionByName(side(baseline, BASELINE))


def aggregate_values_schema(cs: ColumnSets) -> T.StructType:
    """The schema of :func:`aggregate_values`."""
    exact = T.DecimalType(38, 0)

    def summed(c: ColumnInfo) -> T.DataType:
        if is_floating(c.data_type):
            return T.DoubleType()
        if isinstance(c.data_type, T.DecimalType):
            return T.DecimalType(38, c.data_type.scale)
        return exact

    fields = [(SIDE, T.StringType()), ("row_count", T.LongType())]
    fields += [(sum_name(c), summed(c)) for c in cs.sum_columns]
    fields += [(nonnull_name(c), T.LongType()) for c in cs.null_columns]
    fields += [(n(c), c.data_type) for c in cs.tolerance_columns for n in (min_name, max_name)]
    if cs.fingerprint_columns:
        fields.append(("checksum", exact))
    return T.StructType([T.StructField(n, t) for n, t in fields])


def key_exprs(keys: tuple[ColumnInfo, ...] | list[ColumnInfo]) -> list[Column]:
    """Key parts as grouped and joined on: typed, except IEEE floats, which group by their text (so -0.0 and 0.0
    stay apart, as their fingerprints do)."""
    out = []
    for i, k in enumerate(keys):
        e = canonical(k) if is_floating(k.data_type) else col(k.name)
        out.append(e.alias(f"k{i}"))
    return out


def duplicate_key_rows(candidate: DataFrame, baseline: DataFrame, keys: tuple[ColumnInfo, ...]) -> DataFrame:
    """Per side: rows minus distinct keys (NULL is a key value). One shuffle of the narrow keys per side; partial
    aggregation collapses a hot key inside each task before it is exchanged."""
    kcols = [f"k{i}" for i in range(len(keys))]

    def side(df: DataFrame, name: str) -> DataFrame:
        per_key = df.select(*key_exprs(keys)).groupBy(*kcols).agg(F.count(F.lit(1)).alias("n"))
        return per_key.agg(
            F.coalesce(F.sum("n") - F.count(F.lit(1)), F.lit(0).cast("bigint")).alias("duplicate_key_rows")
        ).select(F.lit(name).alias(SIDE), "duplicate_key_rows")

    return side(candidate, CANDIDATE).unionByName(side(baseline, BASELINE))


def wide_pair(values: DataFrame) -> DataFrame:
    """The two per-side rows as one row, each value column as ``c__x`` and ``b__x``."""
    names = [n for n in values.columns if n != SIDE]
    aggs = []
    for n in names:
        aggs.append(F.max(F.when(col(SIDE) == CANDIDATE, col(n))).alias("c__" + n))
        aggs.append(F.max(F.when(col(SIDE) == BASELINE, col(n))).alias("b__" + n))
    return values.agg(*aggs)


def _text(c: Column) -> Column:
    return c.cast("string")


def _check(name: str, column: str | None, c: Column, b: Column, agrees: Column, method: str, tolerance, decisive: bool) -> Column:
    return F.struct(
        F.lit(name).alias("check_name"),
        F.lit(column).cast("string").alias("column_name"),
        _text(c).alias("candidate"),
        _text(b).alias("baseline"),
        agrees.alias("agrees"),
        F.lit(method).alias("method"),
        F.lit(None if tolerance is None else format(tolerance, "f")).cast("string").alias("tolerance"),
        F.lit(decisive).alias("decisive"),
    )


def _within(c: Column, b: Column, allowed: Column) -> Column:
    """One-sided NULL disagrees; equal values (NULL, NaN and infinities too) agree; else the difference must be within
    ``allowed``."""
    return F.when(c.isNull() | b.isNull(), c.isNull() & b.isNull()).otherwise((c == b) | (F.abs(c - b) <= allowed))


def aggregate_checks(values: DataFrame, cs: ColumnSets, with_duplicates: bool | None = None) -> DataFrame:
    """Long form: check_name, column_name, candidate, baseline (value text), agrees, method, tolerance, decisive.

    ``values`` has one row per side as from :func:`aggregate_values`, optionally joined with
    :func:`duplicate_key_rows`. Agreement is decided on the typed values, so decimals compare exactly.
    """
    if with_duplicates is None:
        with_duplicates = "duplicate_key_rows" in values.columns
    w = wide_pair(values)

    def c(n):
        return col("c__" + n)

    def b(n):
        return col("b__" + n)

    rows = c("row_count")
    brows = b("row_count")
    checks = [_check("row_count", None, rows, brows, rows.eqNullSafe(brows), "exact", None, True)]
    most_rows = F.greatest(rows, brows)
    for col_info in cs.sum_columns:
        n = sum_name(col_info)
        tol = cs.tolerances.get(col_info.name)
        if tol is not None:
            allowed = F.lit(tol) * most_rows.cast("decimal(20,0)")
            if col_info.floating:
                allowed = allowed.cast("double")
            checks.append(_check("sum", col_info.name, c(n), b(n), _within(c(n), b(n), allowed), "tolerance", tol, True))
        elif col_info.floating:
            checks.append(_check("sum", col_info.name, c(n), b(n), c(n).eqNullSafe(b(n)), "informational", None, False))
        else:
            checks.append(_check("sum", col_info.name, c(n), b(n), c(n).eqNullSafe(b(n)), "exact", None, True))
    for col_info in cs.tolerance_columns:
        tol = cs.tolerances[col_info.name]
        allowed = F.lit(tol).cast("double") if col_info.floating else F.lit(tol)
        for kind, name_of in (("min", min_name), ("max", max_name)):
            n = name_of(col_info)
            checks.append(_check(kind, col_info.name, c(n), b(n), _within(c(n), b(n), allowed), "tolerance", tol, True))
    for col_info in cs.null_columns:
        n = nonnull_name(col_info)
        cn, bn = rows - c(n), brows - b(n)
        checks.append(_check("null_count", col_info.name, cn, bn, cn.eqNullSafe(bn), "exact", None, True))
    if cs.fingerprint_columns:
        checks.append(_check("checksum", None, c("checksum"), b("checksum"), c("checksum").eqNullSafe(b("checksum")), "exact", None, True))
    if cs.key_columns and with_duplicates:
        cd, bd = c("duplicate_key_rows"), b("duplicate_key_rows")
        # Equal numbers of surplus rows are no agreement: one repeated key, on either side, fails the check.
        checks.append(_check("duplicate_key_rows", None, cd, bd, (cd == 0) & (bd == 0), "exact", None, True))
    return w.select(F.inline(F.array(*checks)))


def checks_of(spark: SparkSession, rows: list[dict], cs: ColumnSets) -> list[dict]:
    """:func:`aggregate_checks` of per-side value rows that are already here, as plain rows."""
    local = aggregate_values_schema(cs)
    if "duplicate_key_rows" in rows[0]:
        local = T.StructType([*local.fields, T.StructField("duplicate_key_rows", T.LongType())])
    values = spark.createDataFrame([tuple(r[n] for n in local.names) for r in rows], local)
    return [r.asDict() for r in aggregate_checks(values, cs).collect()]


def collect_checks(candidate: DataFrame, baseline: DataFrame, cs: ColumnSets, duplicates: bool = True) -> list[dict]:
    """The aggregate check as a comparison runs it, duplicate keys included when there are keys and ``duplicates``."""
    values = aggregate_values(candidate, baseline, cs)
    if cs.key_columns and duplicates:
        values = with_duplicates(values, duplicate_key_rows(candidate, baseline, cs.key_columns))
    return [r.asDict() for r in aggregate_checks(values, cs).collect()]


def gate(checks: DataFrame) -> DataFrame:
    """One row, one boolean: every decisive check agrees."""
    return checks.agg(F.coalesce(F.bool_and(col("agrees") | ~col("decisive")), F.lit(True)).alias("gate"))


def agree(check_rows) -> bool:
    """The gate over collected check rows."""
    return all(r["agrees"] or not r["decisive"] for r in check_rows)


def with_duplicates(values: DataFrame, dups: DataFrame) -> DataFrame:
    return values.join(dups, SIDE, "left")
