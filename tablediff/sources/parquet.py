"""Parquet datasets: every ``*.parquet`` file under a folder, at any depth, read as one DataFrame."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


class MixedFiles(ValueError):
    """Files of one dataset disagree about its columns."""


def _below(path: str, file: str) -> list[str]:
    """The folders between a dataset's root and one of its files."""
    root = path.rstrip("/").split("://")[-1].split(":")[-1]
    return file.partition(root + "/")[2].split("/")[:-1]


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """All Parquet files under ``path`` as one dataset.

    Files are gathered recursively. If a folder at any depth is named ``key=value``, Spark's partition discovery reads
    the dataset instead, so the keys are columns and a range on them prunes folders; folders that it can't bring into
    one layout raise.
    """
    plain = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path)
    files = plain.inputFiles()
    if not any("=" in folder for f in files for folder in _below(path, f)):
        return plain
    keyed = spark.read.option("pathGlobFilter", "*.parquet").parquet(path)
    if len(keyed.inputFiles()) != len(files):
        raise MixedFiles(f"{path}: some files are in key=value folders and some are not")
    return keyed


# So many files' footers are in the driver at once.
FOOTERS_AT_ONCE = 1000


def require_one_schema(spark: SparkSession, path: str, at_once: int = FOOTERS_AT_ONCE) -> None:
    """Raise :class:`MixedFiles` unless all files hold the same columns with the same types.

    Spark takes the columns of one file for all: a column that only other files have would vanish, one that they lack
    would read as NULL, and a comparison could pass for it. The listing that the scan made is used again, and the
    footers (no rows, no statistics) are read in parallel threads, ``at_once`` files at a time; of each lot only the
    different column lists are kept, so what the driver holds does not grow with the number of files.
    """
    plain = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    listed = plain._jdf.queryExecution().analyzed().relation().location().allFiles()
    files = jvm.java.util.ArrayList(jvm.scala.jdk.javaapi.CollectionConverters.asJava(listed))
    first = None
    for lo in range(0, files.size(), at_once):
        lot = files.subList(lo, min(lo + at_once, files.size()))
        for columns in _column_lists(jvm, conf, lot):
            if first is None:
                first = columns
            elif columns != first:
                odd = sorted(set(columns) ^ set(first))
                raise MixedFiles(f"{path}: files disagree about {', '.join(odd)}")


def _column_lists(jvm, conf, files) -> set[tuple[str, ...]]:
    """The different column lists (sorted, without required or optional) in the footers of ``files``."""
    schemas = jvm.java.util.HashSet()
    for footer in jvm.org.apache.parquet.hadoop.ParquetFileReader.readAllFootersInParallel(conf, files, True):
        schemas.add(footer.getParquetMetadata().getFileMetaData().getSchema())
    return {tuple(sorted(" ".join(str(c).split()[1:]) for c in schema.getFields())) for schema in schemas}


def read_dataset_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The dataset, or None when nothing exists at ``path``; files that disagree raise.

    An existing but empty dataset still has its columns, so it is not None.
    """
    try:
        df = read_dataset(spark, path)
    except AnalysisException as e:
        if _is_missing(e):
            return None
        raise
    require_one_schema(spark, path)
    return df


def _is_missing(e: AnalysisException) -> bool:
    condition = e.getCondition() if hasattr(e, "getCondition") else None
    if condition in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
        return True
    return "Path does not exist" in str(e)
