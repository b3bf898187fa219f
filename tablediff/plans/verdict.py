"""Verdicts as DataFrame folds: per dataset from its check rows, per run from its datasets' verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Severity order of the fold: any FAIL beats any ERROR beats any PASS; SKIPPED only when every dataset was skipped.
SEVERITY = {"SKIPPED": 0, "PASS": 1, "ERROR": 2, "FAIL": 3}


def dataset_verdicts(checks: DataFrame, dataset_col: str = "dataset") -> DataFrame:
    """PASS when every decisive check of the dataset agrees, otherwise FAIL (even if a row diff would find nothing)."""
    gate = F.bool_and(F.col("agrees") | ~F.col("decisive"))
    return checks.groupBy(dataset_col).agg(F.when(gate, F.lit("PASS")).otherwise(F.lit("FAIL")).alias("verdict"))


def _severity(c):
    expr = None
    for name, rank in SEVERITY.items():
        expr = F.when(c == name, F.lit(rank)) if expr is None else expr.when(c == name, F.lit(rank))
    return expr


def _verdict_of(rank):
    expr = None
    for name, r in SEVERITY.items():
        expr = F.when(rank == r, F.lit(name)) if expr is None else expr.when(rank == r, F.lit(name))
    return expr


def run_verdicts(verdicts: DataFrame, run_col: str = "run_id", verdict_col: str = "verdict") -> DataFrame:
    """One verdict per run from its datasets' verdicts."""
    rank = F.max(_severity(F.col(verdict_col)))
    return verdicts.groupBy(run_col).agg(_verdict_of(rank).alias("verdict"))


def unverified_datasets(verdicts: DataFrame, run_col: str = "run_id", dataset_col: str = "dataset") -> DataFrame:
    """Per run, the sorted names of the datasets that were skipped."""
    return verdicts.groupBy(run_col).agg(
        F.array_sort(F.collect_list(F.when(F.col("verdict") == "SKIPPED", F.col(dataset_col)))).alias("unverified_datasets")
    )
