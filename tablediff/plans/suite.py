"""The registered queries: every operator of the library run over the driver's tables, whole.

Each function takes ``(spark, sf_dir)`` and returns a lazy DataFrame. Two-sided inputs are the rule-based pairs of
:mod:`tablediff.plans.fixtures`. Column names match the SQL texts of :mod:`tablediff.plans.suite_sql`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import canonical, col, fingerprint, from_limbs
from ..functions.types import ColumnInfo, columns_of
from ..operators import aggregate as agg
from ..operators import digest
from ..operators import rowdiff as rd
from ..operators.columns import ColumnSets, column_sets
from ..operators.scope import apply_row_range
from ..sources import parquet as parquet_source
from ..sources import records as record_store
from ..spec import RowRange
from . import fixtures as fx
from . import history as hist
from . import verdict as vd

SAMPLE_N = 5

# --- pairs and their column sets ----------------------------------------------------------------------------------


def _orders_sets(cand: DataFrame, tolerances=fx.ORDERS_TOLERANCES, ignored=()) -> ColumnSets:
    return column_sets(cand.schema, fx.ORDERS_KEYS, ignored, tolerances)


def _orders(spark, sf_dir, tolerances=fx.ORDERS_TOLERANCES, ignored=()):
    cand, base = fx.orders_pair(spark, sf_dir)
    return cand, base, _orders_sets(cand, tolerances, ignored)


def _lineitem(spark, sf_dir):
    cand, base = fx.lineitem_pair(spark, sf_dir)
    return cand, base, column_sets(cand.schema, ())


def _values(cand, base, cs: ColumnSets) -> DataFrame:
    values = agg.aggregate_values(cand, base, cs)
    if cs.key_columns:
        values = agg.with_duplicates(values, agg.duplicate_key_rows(cand, base, cs.key_columns))
    return values


def _round_float_values(checks: DataFrame, cs: ColumnSets) -> DataFrame:
    """Sums of IEEE columns depend on the order of addition; reported to two decimals so two engines agree."""
    floats = [c.name for c in cs.sum_columns if c.floating]
    if not floats:
        return checks
    is_float_sum = (col("check_name") == "sum") & col("column_name").isin(*floats)

    def rounded(c: Column) -> Column:
        return F.when(is_float_sum, F.round(c.cast("double"), 2).cast("decimal(38,2)").cast("string")).otherwise(c)

    return checks.withColumn("candidate", rounded(col("candidate"))).withColumn("baseline", rounded(col("baseline")))


def _checks(cand, base, cs) -> DataFrame:
    return _round_float_values(agg.aggregate_checks(_values(cand, base, cs), cs), cs)


# --- sources, filters, expressions ---------------------------------------------------------------------------------


def scan_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = [
        parquet_source.read_dataset(spark, f"{sf_dir}/{t}.parquet").agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(t).alias("table_name"), "n_rows"
        )
        for t in fx.TABLES
    ]
    return reduce(DataFrame.unionByName, frames)


def row_range_filter(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events")
    return apply_row_range(events, "ts", RowRange("2024-01-10", "2024-01-20")).select("event_id", "event_type")


def row_range_numeric(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders")
    return apply_row_range(orders, "o_orderkey", RowRange("1000.5", "2000")).select("o_orderkey")


def row_range_text(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders")
    return apply_row_range(orders, "o_orderpriority", RowRange("2-HIGH", "4-NOT SPECIFIED")).select("o_orderkey")


def canonical_text(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders")
    cols = {c.name: c for c in columns_of(orders.schema)}
    amount = ColumnInfo("amount", T.DecimalType(18, 2))
    return orders.select(
        "o_orderkey",
        canonical(cols["o_custkey"]).alias("custkey_text"),
        canonical(cols["o_orderstatus"]).alias("status_text"),
        canonical(cols["o_orderdate"]).alias("date_text"),
        canonical(amount, col("o_totalprice").cast("decimal(18,2)")).alias("amount_text"),
    )


def row_fingerprint(spark, sf_dir):
    conv = fx.table(spark, sf_dir, "conversations")
    return conv.select("conv_id", "turn", fingerprint(columns_of(conv.schema)).alias("fp"))


def key_fingerprint(spark, sf_dir):
    cand, _, cs = _orders(spark, sf_dir)
    return rd.key_fingerprint(cand, cs.key_columns, cs.fingerprint_columns)


# --- aggregate check -----------------------------------------------------------------------------------------------


def _exact_text(values: DataFrame) -> DataFrame:
    """Decimal columns as their exact text: the registered outputs then compare across engines without any engine
    turning a wide decimal into a float on the way out."""
    return values.select(
        *[col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, T.DecimalType) else col(f.name) for f in values.schema.fields]
    )


def _side_values(spark, sf_dir, names_of) -> DataFrame:
    """Some of the per-side values; the duplicate keys are only counted where they are asked for."""
    cand, base, cs = _orders(spark, sf_dir)
    names = names_of(cs)
    counted = names == ["duplicate_key_rows"]
    values = agg.duplicate_key_rows(cand, base, cs.key_columns) if counted else agg.aggregate_values(cand, base, cs)
    return _exact_text(values.select(agg.SIDE, *names))


def agg_row_count(spark, sf_dir):
    return _side_values(spark, sf_dir, lambda cs: ["row_count"])


def agg_sum(spark, sf_dir):
    return _side_values(spark, sf_dir, lambda cs: [agg.sum_name(c) for c in cs.sum_columns if not c.floating])


def agg_null_count(spark, sf_dir):
    cand, base, cs = _orders(spark, sf_dir)
    values = agg.aggregate_values(cand, base, cs)
    return values.select(
        agg.SIDE, *[(col("row_count") - col(agg.nonnull_name(c))).alias(f"null_count__{c.name}") for c in cs.null_columns]
    )


def agg_min_max(spark, sf_dir):
    return _side_values(
        spark, sf_dir, lambda cs: [n for c in cs.tolerance_columns for n in (agg.min_name(c), agg.max_name(c))]
    )


def agg_checksum(spark, sf_dir):
    return _side_values(spark, sf_dir, lambda cs: ["checksum"])


def agg_duplicate_rows(spark, sf_dir):
    return _side_values(spark, sf_dir, lambda cs: ["duplicate_key_rows"])


def agg_float_sum(spark, sf_dir):
    cand, base, cs = _orders(spark, sf_dir)
    values = agg.aggregate_values(cand, base, cs)
    return _exact_text(
        values.select(
            agg.SIDE,
            *[F.round(col(agg.sum_name(c)), 2).cast("decimal(38,2)").alias(agg.sum_name(c)) for c in cs.sum_columns if c.floating],
        )
    )


def aggregate_values(spark, sf_dir):
    cand, base, cs = _orders(spark, sf_dir)
    values = _values(cand, base, cs)
    out = []
    for n in values.columns:
        c = col(n)
        if n.startswith("sum__") and n[len("sum__"):] in {x.name for x in cs.sum_columns if x.floating}:
            c = F.round(c, 2).cast("decimal(38,2)")
        out.append(c.alias(n))
    return _exact_text(values.select(*out))


def aggregate_check(spark, sf_dir):
    return _checks(*_orders(spark, sf_dir))


def checks_exact(spark, sf_dir):
    return aggregate_check(spark, sf_dir).where(col("method") == "exact")


def checks_tolerance(spark, sf_dir):
    return aggregate_check(spark, sf_dir).where(col("method") == "tolerance")


def checks_informational(spark, sf_dir):
    # Without a tolerance the price column's sum only informs; the checksum decides.
    return _checks(*_orders(spark, sf_dir, tolerances={})).where(col("method") == "informational")


def checks_duplicates(spark, sf_dir):
    return aggregate_check(spark, sf_dir).where(col("check_name") == "duplicate_key_rows")


def ignored_columns_check(spark, sf_dir):
    cand, base, cs = _orders(spark, sf_dir, ignored=("o_orderstatus",))
    return _checks(cand, base, cs).select("check_name", "column_name", "agrees")


def embeddings_check(spark, sf_dir):
    """Aggregate check of a table whose vector column cannot be compared: the spec must ignore it (the config check
    rejects it otherwise), and the other columns are checked as usual."""
    base = fx.table(spark, sf_dir, "embeddings")
    cand = base.withColumn("label", F.when(col("vec_id") % 11 == 0, col("label") + 1).otherwise(col("label")))
    cs = column_sets(base.schema, ("vec_id",), ("embedding",), {})
    return _checks(cand, base, cs)


def _gate_of(name: str, checks: DataFrame) -> DataFrame:
    return agg.gate(checks).select(F.lit(name).alias("pair_name"), "gate")


def aggregate_gate(spark, sf_dir):
    return _gate_of("orders_mutated", _checks(*_orders(spark, sf_dir))).unionByName(
        _gate_of("orders_same", _checks(*_orders_same(spark, sf_dir)))
    )


# --- key classes ---------------------------------------------------------------------------------------------------


def differing_classes(spark, sf_dir):
    """The key classes of the orders pair whose digests differ, with their rows on each side."""
    cand, base, cs = _orders(spark, sf_dir)
    return digest.differing_classes(digest.class_rows(cand, base, cs))


def differing_content_classes(spark, sf_dir):
    """The same for a pair without a key, whose classes are those of the rows' contents."""
    cand, base, cs = _lineitem(spark, sf_dir)
    return digest.differing_classes(digest.class_rows(cand, base, cs))


def class_digests(spark, sf_dir):
    """Each class's number of rows and checksum, of one side alone."""
    _, base, cs = _orders(spark, sf_dir)
    rows = digest.class_digests(base, cs)
    return _exact_text(rows.select("class", "row_count", from_limbs([col(f"_ck_{j}") for j in range(3)]).alias("checksum")))


def row_diff_in_classes(spark, sf_dir):
    """The keyed row diff with only the differing classes exchanged. At sf0.01 and below that is a part of all classes
    only for a pair with few changes, so the customers' few changes are compared here."""
    cand, base = fx.customer_pair(spark, sf_dir)
    cs = column_sets(base.schema, ("c_custkey",))
    rows = digest.class_rows(cand, base, cs)
    differing = sorted(r["class"] for r in digest.differing_classes(rows).collect())
    pk = rd.per_key_of_classes(cand, base, cs, differing, digest.CLASSES)
    return rd.rename_keys(rd.diff_from_per_key(pk, 1), cs.key_columns)


# --- duplicates ----------------------------------------------------------------------------------------------------

LINEITEM_KEYS = ("l_orderkey", "l_linenumber")


def _lineitem_dups(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem")
    cs = column_sets(li.schema, LINEITEM_KEYS)
    kf = rd.key_fingerprint(li, cs.key_columns, cs.fingerprint_columns)
    return rd.duplicate_keys(kf, len(cs.key_columns)), cs


def duplicate_keys(spark, sf_dir):
    dups, cs = _lineitem_dups(spark, sf_dir)
    return rd.rename_keys(dups, cs.key_columns)


def duplicate_key_counts(spark, sf_dir):
    dups, _ = _lineitem_dups(spark, sf_dir)
    return dups.agg(
        F.count(F.lit(1)).alias("duplicated_keys"),
        F.coalesce(F.sum(col("occurrences") - 1), F.lit(0).cast("bigint")).alias("surplus_rows"),
    )


def duplicate_keys_top(spark, sf_dir):
    dups, cs = _lineitem_dups(spark, sf_dir)
    return rd.rename_keys(rd.top_duplicates(dups, cs.key_columns, 100), cs.key_columns)


def _orders_kf(spark, sf_dir):
    cand, base, cs = _orders(spark, sf_dir)
    return (
        rd.key_fingerprint(cand, cs.key_columns, cs.fingerprint_columns),
        rd.key_fingerprint(base, cs.key_columns, cs.fingerprint_columns),
        cs,
    )


def duplicate_key_union(spark, sf_dir):
    ckf, bkf, cs = _orders_kf(spark, sf_dir)
    return rd.rename_keys(rd.duplicate_key_union(ckf, bkf, 1), cs.key_columns)


def unique_key_rows(spark, sf_dir):
    ckf, bkf, cs = _orders_kf(spark, sf_dir)
    return rd.rename_keys(rd.unique_key_rows(ckf, rd.duplicate_key_union(ckf, bkf, 1), 1), cs.key_columns)


# --- keyed row diff ------------------------------------------------------------------------------------------------


def _orders_diff(spark, sf_dir):
    cand, base, cs = _orders(spark, sf_dir)
    pk = rd.per_key(cand, base, cs.key_columns, cs.fingerprint_columns)
    return cand, base, cs, rd.diff_from_per_key(pk, len(cs.key_columns))


def row_diff(spark, sf_dir):
    _, _, cs, diff = _orders_diff(spark, sf_dir)
    return rd.rename_keys(diff, cs.key_columns)


def row_diff_join(spark, sf_dir):
    ckf, bkf, cs = _orders_kf(spark, sf_dir)
    return rd.rename_keys(rd.keyed_diff_join(ckf, bkf, 1), cs.key_columns)


def document_diff(spark, sf_dir):
    """Keyed diff of whole long texts: a character appended at the end of a 20,000-word text is a difference."""
    cand, base = fx.documents_pair(spark, sf_dir)
    cs = column_sets(base.schema, ("doc_id",))
    pk = rd.per_key(cand, base, cs.key_columns, cs.fingerprint_columns)
    return rd.rename_keys(rd.diff_from_per_key(pk, 1), cs.key_columns)


def conversation_diff(spark, sf_dir):
    """Keyed diff on a composite key."""
    cand, base = fx.conversations_pair(spark, sf_dir)
    cs = column_sets(base.schema, ("conv_id", "turn"))
    pk = rd.per_key(cand, base, cs.key_columns, cs.fingerprint_columns)
    return rd.rename_keys(rd.diff_from_per_key(pk, 2), cs.key_columns)


def conversation_differing_columns(spark, sf_dir):
    cand, base = fx.conversations_pair(spark, sf_dir)
    cs = column_sets(base.schema, ("conv_id", "turn"))
    out = rd.differing_columns_by_key(cand, base, cs.key_columns, cs.compared, cs.fingerprint_columns)
    return rd.rename_keys(out, cs.key_columns)


def row_diff_counts(spark, sf_dir):
    _, _, _, diff = _orders_diff(spark, sf_dir)
    return diff.groupBy("mismatch_type").agg(F.count(F.lit(1)).alias("n"))


def row_diff_summary(spark, sf_dir):
    cand, base, cs = _orders(spark, sf_dir)
    return rd.diff_counts(rd.per_key(cand, base, cs.key_columns, cs.fingerprint_columns))


def row_diff_sample_keys(spark, sf_dir):
    _, _, cs, diff = _orders_diff(spark, sf_dir)
    return rd.rename_keys(rd.sample_keys(diff, cs.key_columns, SAMPLE_N), cs.key_columns)


def _sampled_pairs(spark, sf_dir):
    cand, base, cs, diff = _orders_diff(spark, sf_dir)
    samples = rd.sample_keys(diff, cs.key_columns, SAMPLE_N)
    return rd.sampled_pairs(cand, base, samples, cs.key_columns, cs.compared), cs


def sampled_rows(spark, sf_dir):
    """Both sides' values of the sampled rows, as canonical text (NULL for a side without the row); the price is shown as
    a decimal, whose text is the same in every engine."""
    pairs, cs = _sampled_pairs(spark, sf_dir)
    amount = T.DecimalType(18, 4)

    def shown(prefix: str, c: ColumnInfo) -> Column:
        value = col(prefix + c.name)
        text = canonical(ColumnInfo(c.name, amount), value.cast(amount)) if c.floating else canonical(c, value)
        return text.alias(prefix + c.name)

    values = [shown(p, c) for p in ("c__", "b__") for c in cs.compared]
    return rd.rename_keys(pairs.select("k0", "mismatch_type", *values), cs.key_columns)


def row_diff_sample(spark, sf_dir):
    pairs, cs = _sampled_pairs(spark, sf_dir)
    report = rd.sample_report(pairs, cs.key_columns, cs.compared, cs.tolerances)
    return report.select(
        "mismatch_type", "key", "candidate", "baseline", F.array_join("differing_columns", ",").alias("differing_columns")
    )


def differing_columns(spark, sf_dir):
    """Differing columns of every changed key (not only the sampled ones), with the price tolerance."""
    cand, base, cs = _orders(spark, sf_dir)
    out = rd.differing_columns_by_key(cand, base, cs.key_columns, cs.compared, cs.fingerprint_columns, cs.tolerances)
    return rd.rename_keys(out, cs.key_columns)


# --- keyless -------------------------------------------------------------------------------------------------------


def keyless_diff(spark, sf_dir):
    cand, base, cs = _lineitem(spark, sf_dir)
    return rd.keyless_counts(cand, base, cs.fingerprint_columns)


def keyless_diff_join(spark, sf_dir):
    cand, base, cs = _lineitem(spark, sf_dir)
    return rd.keyless_counts_join(cand, base, cs.fingerprint_columns)


def keyless_summary(spark, sf_dir):
    return rd.keyless_summary(keyless_diff(spark, sf_dir))


def keyless_top(spark, sf_dir):
    return rd.keyless_top(keyless_diff(spark, sf_dir), 100)


# --- verdicts ------------------------------------------------------------------------------------------------------


def _part_pair(spark, sf_dir):
    part = fx.table(spark, sf_dir, "part")
    k = col("p_partkey")
    drifted = part.withColumn(
        "p_retailprice", F.when(k % fx.DRIFT_MOD == 0, col("p_retailprice") + F.lit(fx.DRIFT)).otherwise(col("p_retailprice"))
    )
    return drifted, part, column_sets(part.schema, ("p_partkey",), (), {"p_retailprice": "0.01"})


def _same(spark, sf_dir, name, key):
    t = fx.table(spark, sf_dir, name)
    return t, t, column_sets(t.schema, (key,), (), {})


def _orders_same(spark, sf_dir):
    _, base, cs = _orders(spark, sf_dir)
    return base, base, cs


def _dataset_checks(spark, sf_dir) -> DataFrame:
    pairs = {
        "orders_mutated": _orders(spark, sf_dir),
        "orders_same": _orders_same(spark, sf_dir),
        "lineitem_mutated": _lineitem(spark, sf_dir),
        "customer_same": _same(spark, sf_dir, "customer", "c_custkey"),
        "part_drift": _part_pair(spark, sf_dir),
    }
    frames = [_checks(c, b, cs).select(F.lit(name).alias("dataset"), "*") for name, (c, b, cs) in pairs.items()]
    return reduce(DataFrame.unionByName, frames)


def dataset_verdicts(spark, sf_dir):
    return vd.dataset_verdicts(_dataset_checks(spark, sf_dir))


# Runs and their datasets come from the events: a run for every RUN_MOD users, holding the dataset that stands for each
# type of event the users have. The first such event tells whether the dataset was new then, or could not be read.
RUN_MOD = 40
NEW_MOD, BROKEN_MOD = 3, 5
DATASET_OF_EVENT = {
    "click": "orders_mutated",
    "error": "lineitem_mutated",
    "purchase": "orders_same",
    "signup": "part_drift",
    "view": "customer_same",
}


def _run_dataset_verdicts(spark, sf_dir) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in DATASET_OF_EVENT.items() for x in pair])
    run = F.concat(F.lit("run-"), (col("user_id") % RUN_MOD).cast("string")).alias("run_id")
    events = fx.table(spark, sf_dir, "events")
    held = events.groupBy(run, names[col("event_type")].alias("dataset")).agg(F.min("event_id").alias("first"))
    judged = held.where(col("dataset").isNotNull()).join(dataset_verdicts(spark, sf_dir), "dataset", "left")
    state = F.when(col("first") % NEW_MOD == 0, F.lit("SKIPPED")).when(col("first") % BROKEN_MOD == 0, F.lit("ERROR"))
    return judged.select("run_id", "dataset", state.otherwise(col("verdict")).alias("verdict"))


def run_verdict(spark, sf_dir):
    return vd.run_verdicts(_run_dataset_verdicts(spark, sf_dir))


def unverified_datasets(spark, sf_dir):
    names = vd.unverified_datasets(_run_dataset_verdicts(spark, sf_dir))
    return names.select("run_id", F.array_join("unverified_datasets", ",").alias("unverified_datasets"))


# --- run records and history ---------------------------------------------------------------------------------------

AS_OF = "2024-01-20T00:00:00.000Z"
NO_TIME_MOD = 41
STALE_AFTER_SECONDS = 6 * 3600
HISTORY_PIPELINE = "p1"
HISTORY_FROM = "2024-01-05T00:00:00Z"
HISTORY_TO = "2024-01-25T00:00:00Z"


def record_lines(spark, sf_dir) -> DataFrame:
    """Run records derived from ``events`` as JSON lines, one run per event, a few lines damaged on purpose."""
    ev = fx.table(spark, sf_dir, "events")
    et = col("event_type")
    running = et == "signup"
    fmt = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
    heartbeat = F.timestamp_add("HOUR", (col("user_id") % 7).cast("int"), col("ts"))
    verdict = (
        F.when(et == "click", F.lit("PASS"))
        .when(et == "purchase", F.lit("FAIL"))
        .when(et == "view", F.lit("SKIPPED"))
        .when(et == "error", F.lit("ERROR"))
    )
    ds_type = "array<struct<name:string,verdict:string>>"
    datasets = F.when(running, F.array().cast(ds_type)).otherwise(
        F.array(
            F.struct(F.lit("orders").alias("name"), verdict.alias("verdict")),
            F.struct(F.lit("events").alias("name"), F.lit("PASS").alias("verdict")),
        )
    )
    record = F.struct(
        F.concat(F.lit("run-"), col("event_id").cast("string")).alias("run_id"),
        F.concat(F.lit("p"), (col("user_id") % 4).cast("string")).alias("pipeline"),
        F.when(running, F.lit("RUNNING")).otherwise(F.lit("COMPLETED")).alias("status"),
        F.date_format(col("ts"), fmt).alias("started_at"),
        F.date_format(heartbeat, fmt).alias("heartbeat_at"),
        F.when(~running, F.date_format(heartbeat, fmt)).alias("finished_at"),
        verdict.alias("verdict"),
        F.lit(None).cast("string").alias("reason"),
        datasets.alias("datasets"),
        F.when(et == "view", F.array(F.lit("orders"))).otherwise(F.array().cast("array<string>")).alias("unverified_datasets"),
    )
    record = record.withField(
        "started_at", F.when(col("event_id") % NO_TIME_MOD == 0, F.lit("not a time")).otherwise(record["started_at"])
    )
    line = (
        F.when(col("event_id") % 500 == 7, F.lit("{ this is not json"))
        .when(col("event_id") % 777 == 5, F.lit('{"junk":true}'))
        .otherwise(F.to_json(record))
    )
    return ev.select(line.alias("value"))


def _records(spark, sf_dir) -> DataFrame:
    return record_store.parse_run_records(record_lines(spark, sf_dir))


def run_records(spark, sf_dir):
    return _records(spark, sf_dir).select("run_id", "pipeline", "status", "started_at", "verdict")


def history(spark, sf_dir):
    h = hist.history(_records(spark, sf_dir), HISTORY_PIPELINE, HISTORY_FROM, HISTORY_TO, limit=50)
    return h.select("run_id", "started_at", "status", "verdict")


def history_datasets(spark, sf_dir):
    return hist.dataset_verdict_rows(_records(spark, sf_dir))


def running_runs(spark, sf_dir):
    return hist.running_runs(_records(spark, sf_dir))


def abandoned_runs(spark, sf_dir):
    recs = _records(spark, sf_dir).where(col("status") == "RUNNING")
    return hist.with_abandoned(recs, AS_OF, STALE_AFTER_SECONDS).select("run_id", "status", "verdict", "reason")


QUERIES = {
    "scan_dataset": scan_dataset,
    "row_range_filter": row_range_filter,
    "row_range_numeric": row_range_numeric,
    "row_range_text": row_range_text,
    "canonical_text": canonical_text,
    "row_fingerprint": row_fingerprint,
    "key_fingerprint": key_fingerprint,
    "agg_row_count": agg_row_count,
    "agg_sum": agg_sum,
    "agg_null_count": agg_null_count,
    "agg_min_max": agg_min_max,
    "agg_checksum": agg_checksum,
    "agg_duplicate_rows": agg_duplicate_rows,
    "agg_float_sum": agg_float_sum,
    "aggregate_values": aggregate_values,
    "aggregate_check": aggregate_check,
    "checks_exact": checks_exact,
    "checks_tolerance": checks_tolerance,
    "checks_informational": checks_informational,
    "checks_duplicates": checks_duplicates,
    "ignored_columns_check": ignored_columns_check,
    "embeddings_check": embeddings_check,
    "aggregate_gate": aggregate_gate,
    "differing_classes": differing_classes,
    "differing_content_classes": differing_content_classes,
    "class_digests": class_digests,
    "row_diff_in_classes": row_diff_in_classes,
    "duplicate_keys": duplicate_keys,
    "duplicate_key_counts": duplicate_key_counts,
    "duplicate_keys_top": duplicate_keys_top,
    "duplicate_key_union": duplicate_key_union,
    "unique_key_rows": unique_key_rows,
    "row_diff": row_diff,
    "row_diff_join": row_diff_join,
    "row_diff_counts": row_diff_counts,
    "document_diff": document_diff,
    "conversation_diff": conversation_diff,
    "conversation_differing_columns": conversation_differing_columns,
    "row_diff_summary": row_diff_summary,
    "row_diff_sample_keys": row_diff_sample_keys,
    "sampled_rows": sampled_rows,
    "row_diff_sample": row_diff_sample,
    "differing_columns": differing_columns,
    "keyless_diff": keyless_diff,
    "keyless_diff_join": keyless_diff_join,
    "keyless_summary": keyless_summary,
    "keyless_top": keyless_top,
    "dataset_verdicts": dataset_verdicts,
    "run_verdict": run_verdict,
    "unverified_datasets": unverified_datasets,
    "run_records": run_records,
    "history": history,
    "history_datasets": history_datasets,
    "running_runs": running_runs,
    "abandoned_runs": abandoned_runs,
}
