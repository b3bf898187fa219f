"""Deterministic two-sided pairs derived from one table.

A comparison needs two copies of a dataset. The candidate copies here are rule-based mutations of the baseline table,
applied in Spark to whole tables, so their size and the work grow with the input. The same rules are written as SQL
in ``__spark_entry__.oracle_sql``.

Order of the rules: drop first, then the column changes in the order listed (within a column the first matching rule
wins), then added and duplicated rows, which copy untouched baseline rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the mutation rules (moduli of the key) and the offset of added keys.
DROP_MOD = 97
ADD_MOD = 101
CHANGE_MOD = 89
NULL_MOD = 79
DRIFT_MOD = 83
DUPLICATE_MOD = 103
ADDED_KEY_OFFSET = 10_000_000
DRIFT = 0.004
CHANGE_SUFFIX = "*"
FEW_CHANGED_MOD = 97
FEW_DROPPED_MOD = 499
TEXT_END_MOD = 7
DROP_MOD_SMALL = 13
ADDED_TURN = 100

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mutate_orders(orders: DataFrame) -> DataFrame:
    """The candidate copy of ``orders``: drops, status changes, NULLs, price drift, added and duplicated rows."""
    k = F.col("o_orderkey")
    status = (
        F.when(k % CHANGE_MOD == 0, F.concat(F.col("o_orderstatus"), F.lit(CHANGE_SUFFIX)))
        .when(k % NULL_MOD == 0, F.lit(None).cast("string"))
        .otherwise(F.col("o_orderstatus"))
    )
    price = F.when(k % DRIFT_MOD == 0, F.col("o_totalprice") + F.lit(DRIFT)).otherwise(F.col("o_totalprice"))
    changed = orders.where(k % DROP_MOD != 0).select(
        k, "o_custkey", status.alias("o_orderstatus"), price.alias("o_totalprice"), "o_orderdate", "o_orderpriority"
    )
    added = orders.where(k % ADD_MOD == 0).withColumn("o_orderkey", k + F.lit(ADDED_KEY_OFFSET))
    duplicated = orders.where(k % DUPLICATE_MOD == 0)
    return changed.unionByName(added).unionByName(duplicated)


def mutate_lineitem(lineitem: DataFrame) -> DataFrame:
    """The candidate copy of ``lineitem`` (compared without a key): first lines of some orders dropped, a status
    changed, some lines present twice."""
    k = F.col("l_orderkey")
    first_line = F.col("l_linenumber") == 1
    status = F.when(k % CHANGE_MOD == 0, F.concat(F.col("l_linestatus"), F.lit(CHANGE_SUFFIX))).otherwise(F.col("l_linestatus"))
    kept = lineitem.where(~((k % DROP_MOD == 0) & first_line)).withColumn("l_linestatus", status)
    duplicated = lineitem.where(k % DUPLICATE_MOD == 0)
    return kept.unionByName(duplicated)


def mutate_documents(documents: DataFrame) -> DataFrame:
    """The candidate copy of ``documents``: some texts get one character appended at their very end (only a whole-text
    comparison sees it), some documents are dropped."""
    k = F.col("doc_id")
    text = F.when(k % TEXT_END_MOD == 0, F.concat(F.col("text"), F.lit(CHANGE_SUFFIX))).otherwise(F.col("text"))
    return documents.where(k % DROP_MOD_SMALL != 0).withColumn("text", text)


def mutate_conversations(conversations: DataFrame) -> DataFrame:
    """The candidate copy of ``conversations`` (key ``conv_id, turn``): some first turns dropped, some second turns'
    text and role changed, and one extra turn added to some conversations."""
    c, t = F.col("conv_id"), F.col("turn")
    changed = (c % 3 == 0) & (t == 1)
    kept = conversations.where(~((c % 5 == 0) & (t == 0))).select(
        c, t,
        F.when(changed & (c % 2 == 0), F.lit("system")).otherwise(F.col("role")).alias("role"),
        F.when(changed, F.concat(F.col("text"), F.lit(CHANGE_SUFFIX))).otherwise(F.col("text")).alias("text"),
    )
    extra = conversations.where((c % 7 == 0) & (t == 0)).withColumn("turn", F.lit(ADDED_TURN).cast("bigint"))
    return kept.unionByName(extra)


def mutate_customer(customer: DataFrame) -> DataFrame:
    """The candidate copy of ``customer``, with few changes: some names end in another letter, a few rows are dropped."""
    k = F.col("c_custkey")
    name = F.when(k % FEW_CHANGED_MOD == 0, F.concat(F.col("c_name"), F.lit(CHANGE_SUFFIX))).otherwise(F.col("c_name"))
    return customer.where(k % FEW_DROPPED_MOD != 0).withColumn("c_name", name)


def customer_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base = table(spark, sf_dir, "customer")
    return mutate_customer(base), base


def orders_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base = table(spark, sf_dir, "orders")
    return mutate_orders(base), base


def lineitem_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    amounts = {c: F.col(c).cast(AMOUNT) for c in LINEITEM_AMOUNTS}
    base = table(spark, sf_dir, "lineitem").withColumns(amounts)
    return mutate_lineitem(base), base


def documents_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base = table(spark, sf_dir, "documents")
    return mutate_documents(base), base


def conversations_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base = table(spark, sf_dir, "conversations")
    return mutate_conversations(base), base


# The orders pair is keyed on o_orderkey, with a tolerance on the price; the lineitem pair has no key. Its IEEE columns
# are compared as decimals, whose text is the same in every engine.
ORDERS_KEYS = ("o_orderkey",)
ORDERS_TOLERANCES = {"o_totalprice": "0.01"}
AMOUNT = "decimal(18,4)"
LINEITEM_AMOUNTS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
