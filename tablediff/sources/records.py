"""Run records and mismatch samples: the stored results of comparison runs.

A run record is one JSON object on one line. Each write is a new file ``<root>/<pipeline>/<run_id>/run-<number>.json``
that is never changed or renamed; a reader takes the highest number whose line is complete. So a crash at any moment
leaves a readable record, on stores where a rename is a copy too. Records are read as text lines and parsed with a fixed
schema, so a damaged or foreign record becomes a row of NULLs and is dropped instead of failing the whole scan.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATASET_VERDICT = T.StructType([T.StructField("name", T.StringType()), T.StructField("verdict", T.StringType())])

RECORD_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("pipeline", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("started_at", T.StringType()),
        T.StructField("heartbeat_at", T.StringType()),
        T.StructField("finished_at", T.StringType()),
        T.StructField("verdict", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("row_range", T.StructType([T.StructField("lo", T.StringType()), T.StructField("hi", T.StringType())])),
        T.StructField("datasets", T.ArrayType(DATASET_VERDICT)),
        T.StructField("unverified_datasets", T.ArrayType(T.StringType())),
    ]
)

REQUIRED_FIELDS = ("run_id", "status", "started_at", "heartbeat_at")


def record_path(root: str, pipeline: str, run_id: str) -> str:
    return f"{root.rstrip('/')}/{pipeline}/{run_id}"


def parse_run_records(lines: DataFrame, text_column: str = "value") -> DataFrame:
    """JSON text lines to typed records; unreadable lines and records missing a required field are dropped."""
    parsed = lines.select(F.from_json(F.col(text_column), RECORD_SCHEMA, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    cond = None
    for f in REQUIRED_FIELDS:
        c = F.col(f).isNotNull()
        cond = c if cond is None else cond & c
    return parsed.where(cond)


# The last field of a written record: a line without it was cut off.
COMPLETE = '"complete": true}'
# Older versions are deleted once so many newer ones are there. A reader that has listed a run's folder passes over
# versions that go meanwhile.
KEPT_VERSIONS = 10


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RECORD_SCHEMA)


def _latest(spark: SparkSession, folders: str) -> DataFrame | None:
    """The newest complete record of each run folder that the glob ``folders`` matches; None when it matches none.

    A file without a number counts as the oldest version, complete or not.
    """
    try:
        lines = spark.read.option("pathGlobFilter", "run*.json").option("ignoreMissingFiles", "true").text(folders)
        lines.schema
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return None
        raise
    place = F.col("_metadata.file_path")
    number = F.regexp_extract(place, r"/run-([0-9]+)\.json$", 1)
    versions = lines.select(
        "value",
        F.regexp_replace(place, "/[^/]*$", "").alias("folder"),
        F.coalesce(number.try_cast("bigint"), F.lit(-1).cast("bigint")).alias("version"),
    )
    whole = versions.where((F.col("version") < 0) | F.rtrim("value").endswith(COMPLETE))
    parsed = whole.select("folder", "version", F.from_json("value", RECORD_SCHEMA, {"mode": "PERMISSIVE"}).alias("r"))
    valid = None
    for f in REQUIRED_FIELDS:
        there = F.col(f"r.{f}").isNotNull()
        valid = there if valid is None else valid & there
    newest = parsed.where(valid).groupBy("folder").agg(F.max_by("r", "version").alias("r"))
    return newest.select("r.*")


def read_run_records(spark: SparkSession, root: str, pipeline: str | None = None) -> DataFrame:
    """All run records of one pipeline (its own folder only), or of every pipeline; empty when there are none."""
    records = _latest(spark, f"{root.rstrip('/')}/{pipeline if pipeline is not None else '*'}/*")
    if records is None:
        return _empty(spark)
    if pipeline is not None:
        records = records.where(F.col("pipeline") == pipeline)
    return records


def read_run_record(spark: SparkSession, root: str, pipeline: str, run_id: str) -> dict | None:
    """One run's record as it was last written, or None. Reads only that run's folder."""
    records = _latest(spark, record_path(root, pipeline, run_id))
    if records is None:
        return None
    rows = records.where((F.col("pipeline") == pipeline) & (F.col("run_id") == run_id)).take(1)
    return rows[0].asDict(recursive=True) if rows else None


def _versions(store, fs_api, folder: str) -> dict[int, object]:
    """The numbered files of a run folder."""
    found = store.globStatus(fs_api.Path(f"{folder}/run-*.json")) or []
    out = {}
    for status in found:
        digits = status.getPath().getName()[len("run-") : -len(".json")]
        if digits.isdigit():
            out[int(digits)] = status.getPath()
    return out


def write_run_record(spark: SparkSession, root: str, record: dict) -> str:
    """Add ``record`` (one JSON line) as the run's newest version. Returns the record's folder.

    The file is made under its final name through the Hadoop file API of the store, and never where one is already, so
    no version is overwritten. Until it is closed its line lacks the last field and readers pass it over.
    """
    folder = record_path(root, record["pipeline"], record["run_id"])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs_api = jvm.org.apache.hadoop.fs
    store = fs_api.Path(folder).getFileSystem(conf)
    there = _versions(store, fs_api, folder)
    number = max(there, default=0) + 1
    out = store.create(fs_api.Path(f"{folder}/run-{number:08d}.json"), False)
    plain = {k: v for k, v in record.items() if k != "complete"}
    out.write(bytearray((json.dumps({**plain, "complete": True}, default=str) + "\n").encode()))
    out.close()
    for old in sorted(there)[: -(KEPT_VERSIONS - 1)]:
        store.delete(there[old], False)
    return folder


def write_mismatches(sample: DataFrame, root: str, pipeline: str, run_id: str, dataset: str) -> str | None:
    """The mismatch sample as Parquet at ``<run folder>/mismatches/<dataset>``; nothing is written for no samples."""
    path = f"{record_path(root, pipeline, run_id)}/mismatches/{dataset}"
    if sample.isEmpty():
        return None
    sample.coalesce(1).write.mode("overwrite").parquet(path)
    return path


__all__ = [
    "RECORD_SCHEMA", "parse_run_records", "read_run_record", "read_run_records", "write_run_record", "write_mismatches",
]
