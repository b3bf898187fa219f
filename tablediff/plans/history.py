"""History over stored run records: one pipeline's runs, running runs, and runs whose heartbeat stopped.

Records are a table like any other: filters reach the scan, the order is by real timestamps (not text), and "now" is an
explicit argument so the abandoned classification is reproducible.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import records as record_store

DEFAULT_LIMIT = 50
MAX_LIMIT = 500
# Why a run without a recent heartbeat is shown as abandoned.
ABANDONED_REASON = "abandoned; last heartbeat {}"


def instant(c: Column | str) -> Column:
    """An ISO-8601 instant text (``...Z`` or with an offset) as a timestamp, NULL if it is none; the session time zone is
    UTC."""
    c = F.col(c) if isinstance(c, str) else c
    return F.try_to_timestamp(c)


def _lit_instant(value: str | dt.datetime) -> Column:
    if isinstance(value, dt.datetime):
        if value.tzinfo is not None:
            value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
        return F.lit(value.isoformat(sep=" ")).cast("timestamp")
    return F.to_timestamp(F.lit(value))


def history(
    records: DataFrame,
    pipeline: str,
    lo: str | dt.datetime | None = None,
    hi: str | dt.datetime | None = None,
    limit: int = DEFAULT_LIMIT,
    as_of: str | dt.datetime | None = None,
    stale_after_seconds: float | None = None,
) -> DataFrame:
    """The pipeline's runs, most recent first: ``lo`` inclusive, ``hi`` exclusive on the start time.

    With ``as_of`` and ``stale_after_seconds``, runs whose heartbeat stopped are reported as abandoned
    (:func:`with_abandoned`).
    """
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}")
    if as_of is not None and stale_after_seconds is not None:
        records = with_abandoned(records, as_of, stale_after_seconds)
    started = instant("started_at")
    # A record whose start can't be read has no place in the order and is left out, like other damaged records.
    out = records.where((F.col("pipeline") == pipeline) & started.isNotNull())
    if lo is not None:
        out = out.where(started >= _lit_instant(lo))
    if hi is not None:
        out = out.where(started < _lit_instant(hi))
    return out.orderBy(started.desc(), F.col("run_id").asc()).limit(limit)


def running_runs(records: DataFrame) -> DataFrame:
    """Runs of every pipeline whose record still says RUNNING."""
    return records.where(
        (F.col("status") == "RUNNING") & F.col("pipeline").isNotNull() & F.col("run_id").isNotNull() & F.col("heartbeat_at").isNotNull()
    ).select("pipeline", "run_id", "heartbeat_at")


def is_abandoned(as_of: str | dt.datetime, stale_after_seconds: float) -> Column:
    """RUNNING with a heartbeat strictly older than ``stale_after_seconds`` at ``as_of``, or one that can't be read."""
    age = F.unix_micros(_lit_instant(as_of)) - F.unix_micros(instant("heartbeat_at"))
    late = F.coalesce(age > F.lit(int(round(stale_after_seconds * 1_000_000))), F.lit(True))
    return (F.col("status") == "RUNNING") & late


def with_abandoned(records: DataFrame, as_of: str | dt.datetime, stale_after_seconds: float) -> DataFrame:
    """Records as reported: an abandoned run shows status ABANDONED, verdict ERROR and the reason."""
    gone = is_abandoned(as_of, stale_after_seconds)
    reason = F.format_string(ABANDONED_REASON.replace("{}", "%s"), F.col("heartbeat_at"))
    return records.withColumns(
        {
            "status": F.when(gone, F.lit("ABANDONED")).otherwise(F.col("status")),
            "verdict": F.when(gone, F.lit("ERROR")).otherwise(F.col("verdict")),
            "reason": F.when(gone, reason).otherwise(F.col("reason")),
        }
    )


def run_record(
    spark: SparkSession, root: str, pipeline: str, run_id: str, as_of: str | dt.datetime, stale_after_seconds: float
) -> dict | None:
    """One run's record as it is reported at ``as_of``: a run whose heartbeat stopped is shown as abandoned."""
    record = record_store.read_run_record(spark, root, pipeline, run_id)
    if record is None:
        return None
    rows = spark.createDataFrame([record], record_store.RECORD_SCHEMA)
    return with_abandoned(rows, as_of, stale_after_seconds).collect()[0].asDict(recursive=True)


def dataset_verdict_rows(records: DataFrame) -> DataFrame:
    """One row per run and dataset: ``run_id, name, verdict`` from the nested dataset list."""
    return records.select("run_id", F.inline_outer("datasets")).where(F.col("name").isNotNull())
