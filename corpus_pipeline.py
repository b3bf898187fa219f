"""From raw documents to packed training sequences: each stage applies one operator to all rows that the last one kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet and reads it again
for the next stage. All but the last return the columns of ``documents``: an operator sees only the columns that it
needs, all others travel as one column beside them, so whatever their names are they come out as they went in. Nulls in
any column, empty tables and repeated rows are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablediff.llm.chosen_path import one_of_each
from tablediff.llm.common import shared_dir, written
from tablediff.llm.packing import best_fit_packing
from tablediff.llm.pii import find_pii, sanitise
from tablediff.llm.quality import quality_rules
from tablediff.llm.queries import tokenizer_path
from tablediff.llm.suffix_dedup import suffix_dedup


def _apart(docs: DataFrame, *used: str) -> DataFrame:
    """The ``used`` columns of ``docs``, and all others as the struct ``given``."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in used]
    return docs.select(*used, F.struct(F.lit(0).alias("none") if not others else others[0], *others[1:]).alias("given"))


def _together(done: DataFrame, docs: DataFrame, *used: str) -> DataFrame:
    """The columns of ``docs``, the ``used`` ones as ``done`` has them."""

    def column(c: str) -> Column:
        return F.col(c) if c in used else F.col("given").getField(c).alias(c)

    return done.select(*[column(c) for c in docs.columns])


def _counted(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars, if it is there, as the text now is."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    used = ("lang", "source", "text")
    return _together(quality_rules(_apart(docs, *used)).where("kept"), docs, *used)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return _together(one_of_each(_apart(docs, "doc_id", "text")), docs, "doc_id", "text")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand anywhere else too."""
    return _counted(_together(suffix_dedup(_apart(docs, "doc_id", "text")), docs, "doc_id", "text"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data generalised."""
    return _counted(_together(sanitise(find_pii(_apart(docs, "text"))), docs, "text"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences."""
    return best_fit_packing(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packing", packing),
]

# Near duplicates, repeated passages and token ids are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents of ``sf_dir``."""
    at = shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"{at}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
