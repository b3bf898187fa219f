"""Exact top-k search by integer inner product: a Voronoi join of queries and data.

1. Pivots (a bounded, fixed number of data rows, by hash of the id) cut the data into cells. Each row keeps its distance
   to the nearest pivot. Per cell, the k + 1 rows nearest to the pivot are its summary.
2. For a query q and a row x of the cell of pivot p at distance d, q.p - |q| d <= q.x <= q.p + |q| d. The k-th largest
   lower bound over the summaries bounds the query's k-th score from below, so a row can only matter if its distance is
   at least (bound - q.p) / |q|.
3. Queries are grouped by their pivots. Per group and cell, the smallest of these distances is kept; a data row goes to
   just those groups whose distance it reaches.
4. Each (group, block of data) is solved by matrix products; a query's best k of all blocks are its result.

Groups and blocks have a fixed size on average, however large a cell is. Vectors that are null, empty, or hold null or
non-finite components take no part, and neither do vectors of another length than the most frequent one (of equally
frequent ones the longest): they have no inner product with the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablediff.llm.common import shared_dir, written

PIVOTS = 64
QUERIES_PER_GROUP = 1024
ROWS_PER_BLOCK = 8192
SCALE = 256

# Bounds are worked out in floating point; this share of |q| (|p| + d) covers its rounding.
SLACK = 1e-9


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows (id, v): v is the vector's components times SCALE, rounded down, as doubles."""
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & finite)
    return rows.select(
        F.col(id_col).alias("id"), F.transform(v, lambda x: F.floor(x * F.lit(float(SCALE))).cast("double")).alias("v")
    )


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_list()).astype(np.float64)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point if all sums stay below 2^53, else in integers."""
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2.0**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _best(scores: np.ndarray, ids: np.ndarray, own, k: int) -> list[tuple[int, int]]:
    """The k best (id, score), ties to the smaller id, without the rows whose id is ``own``."""
    keep = np.flatnonzero(ids != own)
    if len(keep) > k:
        s = scores[keep]
        keep = keep[s >= np.partition(s, len(s) - k)[len(s) - k]]
    keep = keep[np.lexsort((ids[keep], -scores[keep]))][:k]
    return [(ids[i], scores[i]) for i in keep]


def voronoi_topk(
    vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """Rows (query_id, rank, <id_col>, score): for each row with ``is_query`` the k best other rows.

    Rows with the query's own id are left out; a null id is no query and no candidate. Repeated rows are candidates
    each; repeated queries count once. With fewer than k candidates all are returned; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    at = shared_dir(spark)
    id_type = vectors.schema[id_col].dataType.simpleString()
    rows = integer_vectors(vectors.where(F.col(id_col).isNotNull()), id_col, vec_col)
    out = f"query_id {id_type}, rank int, `{id_col}` {id_type}, score long"
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], out)
    rows = rows.where(F.size("v") == sizes[0]["n"])
    pivots = np.array([r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()])

    def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for lo in range(0, len(part), ROWS_PER_BLOCK):
                some = part.iloc[lo : lo + ROWS_PER_BLOCK]
                x = _matrix(some["v"])
                square = (x * x).sum(1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(1)[None, :]
                cell = square.argmin(1)
                yield some.assign(cell=cell, d=np.sqrt(((x - pivots[cell]) ** 2).sum(1)))

    data = written(rows.mapInPandas(assign, f"id {id_type}, v array<double>, cell int, d double"), at + "/cells")

    # The cells' summaries: at most PIVOTS * (k + 1) rows.
    nearest = Window.partitionBy("cell").orderBy("d", "id")
    summary = (
        data.select("cell", "d", "id").withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k + 1).toPandas()
    )
    near_cell, near_d, near_id = (summary[c].to_numpy() for c in ("cell", "d", "id"))
    pivot_size = np.sqrt((pivots * pivots).sum(1))

    queries = vectors.where(is_query).select(F.col(id_col).alias("id")).distinct()
    queries = data.join(queries, "id", "left_semi").select("id", "v", "cell").distinct()
    per_cell = {r["cell"]: r["count"] for r in queries.groupBy("cell").count().collect()}
    if not per_cell:
        return spark.createDataFrame([], out)
    # Cells are joined to groups in the order of their numbers; a cell with many queries is split by hash.
    first, ways, groups, open_ = {}, {}, 0, 0
    for c in sorted(per_cell):
        ways[c] = -(-per_cell[c] // QUERIES_PER_GROUP)
        if ways[c] > 1 or open_ + per_cell[c] > QUERIES_PER_GROUP or not first:
            first[c], groups, open_ = groups, groups + ways[c], per_cell[c] if ways[c] == 1 else QUERIES_PER_GROUP
        else:
            first[c], open_ = groups - 1, open_ + per_cell[c]
    group_of = F.broadcast(
        spark.createDataFrame([(c, first[c], ways[c]) for c in first], "cell int, first int, ways int")
    )
    queries = written(
        queries.join(group_of, "cell").select(
            "id", "v", (F.col("first") + F.pmod(F.xxhash64("id"), "ways")).cast("int").alias("g")
        ),
        at + "/queries",
    )

    def reach(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Per query and cell: the distance from which on a row may matter."""
        for part in parts:
            for g, own, v in zip(part["g"], part["id"], part["v"], strict=True):
                q = np.asarray(v, np.float64)
                size, dots = np.sqrt(q @ q), pivots @ q
                low = (dots[near_cell] - size * near_d)[near_id != own]
                if len(low) < k or size == 0:
                    least = np.full(len(pivots), -1.0)
                else:
                    bound = np.partition(low, len(low) - k)[len(low) - k]
                    slack = SLACK * size * (pivot_size + np.abs(bound) / size + 1)
                    least = (bound - slack - dots) / size
                yield pd.DataFrame({"g": g, "cell": np.arange(len(pivots)), "least": least})

    needs = (
        queries.mapInPandas(reach, "g int, cell int, least double")
        .groupBy("g", "cell")
        .agg(F.min("least").alias("least"))
        .groupBy("cell")
        .agg(F.collect_list(F.struct("g", "least")).alias("needs"))
    )
    blocks = max(1, -(-data.count() // ROWS_PER_BLOCK))
    placed = (
        data.join(needs, "cell")
        .select("id", "v", "d", F.explode("needs").alias("need"))
        .where(F.col("d") >= F.col("need.least"))
        .select("id", "v", F.col("need.g").alias("g"), F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).alias("block"))
    )
    asked = queries.select("id", "v", "g", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked = asked.withColumn("block", F.col("block").cast("long"))

    def solve(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(rows):
            x, ids = _matrix(rows["v"]), rows["id"].to_numpy()
            for lo in range(0, len(queries), 128):
                part = queries.iloc[lo : lo + 128]
                q = _matrix(part["v"])
                keys = part["vector_key"].to_numpy()
                for own, key, scores in zip(part["id"], keys, _products(q, x), strict=True):
                    found += [(own, key, i, s) for i, s in _best(scores, ids, own, k)]
        return pd.DataFrame(found, columns=["query_id", "vector_key", "id", "score"])

    partial = (
        asked.withColumn("vector_key", F.xxhash64("v"))
        .groupBy("g", "block")
        .cogroup(placed.groupBy("g", "block"))
        .applyInPandas(solve, f"query_id {id_type}, vector_key long, id {id_type}, score long")
    )
    best = Window.partitionBy("query_id", "vector_key").orderBy(F.desc("score"), "id")
    return (
        partial.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias(id_col), "score")
    )
