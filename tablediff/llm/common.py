"""Helpers shared by the corpus operators: the shared scratch folder, written intermediate tables, column clashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL = re.compile(r"local(\[.*\])?$")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that the cluster names in ``spark.checkpoint.dir``.

    Only a plain local session (tests), where driver and executor are one process, may go without the setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not _LOCAL.match(spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set; a cluster must name a shared folder")
        base = tempfile.mkdtemp(prefix="tablediff-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/llm-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within the block, the shuffle files of a finished query go at once, not when the driver next collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, path: str, buckets_by: str | None = None) -> DataFrame:
    """``df`` written as Parquet below a shared folder and read back: cuts the lineage and survives lost executors.

    ``buckets_by`` deals its rows into ``shuffle_buckets`` buckets by that column, so that a later step which meets others
    by it reads the rows where they are and doesn't write them a second time to exchange them. Nothing of the query but
    the table stays on disk.
    """
    if buckets_by is None:
        with shuffles_dropped(df.sparkSession):
            df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)
    spark, name = df.sparkSession, f"tablediff_{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.format("parquet").bucketBy(shuffle_buckets(spark), buckets_by).option("path", path).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the catalog's entry only: the files are the caller's
    return table


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table that ``written`` made and that no later step reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within the block, jobs hand Python workers at most ``rows`` rows at a time: wide rows then stay small together."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def whole_text(text_col: str):
    """The text with null read as empty."""
    return F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))


def shuffle_buckets(spark: SparkSession) -> int:
    """How many ways keyed work is dealt out: the session's shuffle partitions, which a cluster sizes to its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, also where ``use`` needs it for each element of an array."""
    return F.transform(F.array(value), use)[0]


SPAN = "array<struct<start:int,end:int>>"
_BLOCK = 512


def spans_of(text: Column, pattern: str | Column) -> Column:
    """(start, end) of each match of ``pattern``, leftmost and non-overlapping, in code points, the end exclusive.

    The lengths of the matches and of the pieces between them are summed in blocks, so that no step carries the list of
    all matches along. Matches must not be empty.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    none = F.array().cast(SPAN)

    def in_block(sizes: Column, base: Column) -> Column:
        start = F.struct(base.cast("int").alias("at"), none.alias("all"))

        def step(state: Column, x: Column) -> Column:
            first = state["at"] + x["gap"]
            end = first + x["match"]
            one = F.array(F.struct(first.alias("start"), end.alias("end")))
            return F.struct(end.alias("at"), F.concat(state["all"], one).alias("all"))

        return F.aggregate(sizes, start, step, lambda s: s["all"])

    def from_blocks(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x["gap"] + x["match"]))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        step = lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all"))
        bases = F.aggregate(sums, start, step, lambda a: a["all"])
        return once(bases, lambda at: F.flatten(F.transform(blocks, lambda b, i: in_block(b, F.get(at, i)))))

    def placed(matches: Column, gaps: Column) -> Column:
        sizes = F.transform(
            matches, lambda m, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), F.length(m).alias("match"))
        )
        some = F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / _BLOCK).cast("int"))
        blocks = once(sizes, lambda s: F.transform(some, lambda b: F.slice(s, b * _BLOCK + 1, _BLOCK)))
        return once(blocks, from_blocks)

    return once(
        F.regexp_extract_all(text, pattern, F.lit(0)),
        lambda m: F.when(F.size(m) > 0, once(F.split(text, pattern, -1), lambda g: placed(m, g))).otherwise(none),
    )


def text_key(text: Column) -> list[Column]:
    """128 bits of a text, as two columns k1 and k2: rows with equal texts have equal keys."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2")]
