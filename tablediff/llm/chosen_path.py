"""N-gram Jaccard join by chosen paths: recursive splits on sampled shared tokens, brute force in small buckets.

1. Every text becomes the set of its word shingles. Texts with one set are one class, so copies cost nothing further.
   A set's tokens are its MinHash values: two sets share each of them with the probability of their Jaccard similarity.
2. A run starts with one node and splits it by the value of a sampled token. A node with more than ``SMALL`` sets is
   split again by another token, chosen by the node's path, ``DEPTH`` levels deep at most. What remains are the leaves.
   A pair at the threshold stays together on one path with probability threshold^depth, so ``runs_for`` independent
   runs reach the target recall even for pairs that are split to the last level.
3. Within a leaf all pairs are compared by their tokens; a leaf too large for one task is compared in pairs of blocks.
   A pair counts only in the first run in which its sets share a leaf, which their lists of leaves tell. Sets with a
   likely partner go on to the exact check with all their shingles, in the same leaves.
4. Tasks return, per set, its number of partners and the smallest set it is connected with in the leaf; never pairs.
   Sums by set give the number of links; joining the connections gives the classes of the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablediff.llm.common import arrow_rows, drop_path, shared_dir, text_key, whole_text, written
from tablediff.llm.shingles import constants, min_hashes, set_keys, shingle_sets
from tablediff.llm.shingles import _mixed as mixed

THRESHOLD = 0.8
RECALL = 0.9999
TOKENS = 64
SMALL = 256
DEPTH = 3
BLOCK = 512
# Bits of the filter that the texts to be checked are told by: 16 MB.
FILTER_BITS = 1 << 27
# Rows that a Python worker gets at a time: a row may carry all shingles of a text.
BATCH_ROWS = 1000
# Five standard deviations of the estimate below the threshold: such a pair is not checked further.
MARGIN = 5 * math.sqrt(0.25 / TOKENS)


def runs_for(threshold: float, recall: float, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has met with the probability ``recall``, at the greatest depth."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth))


def _paths(tokens: np.ndarray, runs: int) -> np.ndarray:
    """Per set, run and level the node's number (sets x runs x DEPTH)."""
    out = np.zeros((len(tokens), runs, DEPTH), np.uint64)
    rows = np.arange(len(tokens))
    for run, salt in enumerate(constants(runs, 7)):
        path = np.full(len(tokens), salt)
        for level in range(DEPTH):
            pick = (mixed(path + np.uint64(level + 1)) % np.uint64(TOKENS)).astype(np.int64)
            path = mixed(path * np.uint64(0x9E3779B97F4A7C15) + tokens[rows, pick])
            out[:, run, level] = path
    return out


def sketches(docs: DataFrame, id_col: str, text_col: str, runs: int) -> DataFrame:
    """Rows (id, k1, k2, cls, n, tokens, paths) of the texts with a shingle; cls is the key of the set."""
    id_type = docs.schema[id_col].dataType
    long_list = T.ArrayType(T.LongType())
    schema = T.StructType(
        [T.StructField("id", id_type), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType())]
        + [T.StructField("cls", T.BinaryType()), T.StructField("n", T.IntegerType())]
        + [T.StructField("tokens", T.BinaryType()), T.StructField("paths", long_list)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                shingles, starts = shingle_sets(part.column(3).cast(pa.binary()))
                tokens = min_hashes(shingles, starts, TOKENS)
                keep = np.flatnonzero(np.diff(starts) > 0)
                paths = _paths(tokens[keep], runs).astype(np.int64).reshape(len(keep), -1)
                short = (tokens[keep] >> np.uint64(48)).astype("<u2")
                keys = set_keys(shingles, starts)[keep]
                at = np.arange(len(keep) + 1, dtype=np.int32) * paths.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c).take(pa.array(keep)) for c in range(3)),
                        pa.array([k.tobytes() for k in keys], pa.binary()),
                        pa.array(np.diff(starts)[keep].astype(np.int32)),
                        pa.array([s.tobytes() for s in short], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(at), pa.array(paths.ravel())),
                    ],
                    names=schema.names,
                )

    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).alias("id"), *text_key(text), F.lower(text).alias("text"))
    return rows.mapInArrow(run, schema)


def _leaves(classes: DataFrame, runs: int) -> DataFrame:
    """Rows (cls, run, leaf): in each run the first node on the set's path with at most SMALL sets, or the last one."""
    at = lambda level: F.col("paths")[F.col("run") * DEPTH + level]
    rows = classes.select("cls", "paths", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))
    rows = rows.select("cls", "run", *[at(level).alias(f"p{level}") for level in range(DEPTH)])
    for level in range(DEPTH - 1):
        inside = rows if level == 0 else rows.where(F.col(f"large{level - 1}"))
        large = inside.groupBy(f"p{level}").agg(F.count(F.lit(1)).alias("sets")).where(F.col("sets") > SMALL)
        large = large.select(f"p{level}", F.lit(True).alias(f"large{level}"))
        rows = rows.join(large, f"p{level}", "left")
    leaf = F.col(f"p{DEPTH - 1}")
    for level in reversed(range(DEPTH - 1)):
        leaf = F.when(F.col(f"large{level}"), leaf).otherwise(F.col(f"p{level}"))
    return rows.select("cls", "run", leaf.alias("leaf"))


def _in_blocks(members: DataFrame) -> DataFrame:
    """``members`` dealt to (leaf, a, b): the pairs a <= b of the leaf's blocks of about BLOCK sets; ``own`` is a row's block."""
    dealt = members.withColumn("blocks", F.ceil(F.col("sets") / BLOCK).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.select("*", other.alias("other"))
    return dealt.withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")}).drop("blocks", "sets", "other")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Rows sorted by (leaf, a, b) as tables of whole groups, with each group's first row and end."""
    held: list[pa.RecordBatch] = []

    def split(table: pa.Table) -> np.ndarray:
        keys = [table.column(c).to_numpy() for c in ("leaf", "a", "b")]
        new = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        return np.flatnonzero(np.concatenate(([True], new)))

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held).combine_chunks()
        starts = split(table)
        if len(starts) > 1:  # the last group may go on in the next batch
            yield table.slice(0, starts[-1]), list(zip(starts[:-1].tolist(), starts[1:].tolist()))
            held = table.slice(starts[-1]).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        starts = split(table).tolist()
        yield table, list(zip(starts, [*starts[1:], table.num_rows]))


class _Rows:
    """The columns of a table that pairs are told by."""

    def __init__(self, table: pa.Table):
        one = lambda c: table.column(c).combine_chunks() if table.num_rows else table.column(c)
        self.tokens = np.frombuffer(b"".join(one("tokens").to_pylist()), "<u2").reshape(-1, TOKENS)
        self.leaves = np.array(one("leaves").to_pylist(), np.int64)
        self.n, self.own, self.run = (one(c).to_numpy() for c in ("n", "own", "run"))
        self.across = one("a").to_numpy() != one("b").to_numpy()

    def candidates(self, lo: int, hi: int, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
        """(row, later rows) of the group lo..hi-1 that may be linked and have no earlier leaf in common."""
        run, across = int(self.run[lo]), bool(self.across[lo])
        for i in range(lo, hi - 1):
            rest = slice(i + 1, hi)
            n = self.n[rest]
            good = np.minimum(n, self.n[i]) >= threshold * np.maximum(n, self.n[i])
            good &= (self.tokens[rest] == self.tokens[i]).sum(1) >= (threshold - MARGIN) * TOKENS
            if across:
                good &= self.own[rest] != self.own[i]
            if run and good.any():
                good &= ~(self.leaves[rest, :run] == self.leaves[i, :run]).any(1)
            rows = np.flatnonzero(good) + i + 1
            if len(rows):
                yield i, rows


LIKELY = "leaf long, run int, a int, b int, own int, cls binary, n int, tokens binary, leaves array<long>"


def _likely(threshold: float):
    """The rows that have a likely partner in their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, groups in _groups(batches):
            rows, hit = _Rows(table), np.zeros(table.num_rows, bool)
            for lo, hi in groups:
                for i, rest in rows.candidates(lo, hi, threshold):
                    hit[i] = True
                    hit[rest] = True
            yield from table.filter(pa.array(hit)).to_batches()

    return run


def _linked(threshold: float):
    """Per row: how many of its group it is linked with, and the smallest set of the group it is connected with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, groups in _groups(batches):
            rows, names = _Rows(table), table.column("cls").to_pylist()
            sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
            links, parent = np.zeros(len(sets), np.int64), list(range(len(sets)))

            def root(i: int, parent=parent) -> int:
                while parent[i] != i:
                    parent[i] = parent[parent[i]]
                    i = parent[i]
                return i

            for lo, hi in groups:
                for i, rest in rows.candidates(lo, hi, threshold):
                    own = sets[i]
                    others = np.concatenate([sets[j] for j in rest])
                    at = np.minimum(np.searchsorted(own, others), len(own) - 1)
                    sizes = np.array([len(sets[j]) for j in rest])
                    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                    both = np.add.reduceat((own[at] == others).astype(np.int64), starts)
                    for j in rest[both >= threshold * (len(own) + sizes - both) - 1e-9].tolist():
                        links[i] += 1
                        links[j] += 1
                        x, y = root(i), root(j)
                        if names[x] > names[y]:
                            x, y = y, x
                        parent[y] = x
            good = np.flatnonzero(links).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([names[i] for i in good], pa.binary()),
                    pa.array(links[good], pa.int64()),
                    pa.array([names[root(i)] for i in good], pa.binary()),
                ],
                names=["cls", "links", "least"],
            )

    return run


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.repartition("leaf", "a", "b").sortWithinPartitions("leaf", "a", "b")


def _bitmap(keys: DataFrame) -> np.ndarray:
    """One bit for each value of k1 modulo FILTER_BITS: FILTER_BITS / 8 bytes, whatever the number of keys."""
    place = F.pmod("k1", F.lit(FILTER_BITS)) + 1
    parts = keys.groupBy(F.bitmap_bucket_number(place).alias("part"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in parts.agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect():
        own = np.frombuffer(r["bits"], np.uint8)
        out[(r["part"] - 1) * len(own) : r["part"] * len(own)] = own
    return out


def _shingles_of(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """Rows (cls, shingles) of the wanted (k1, k2, cls).

    A broadcast bitmap of fixed size keeps most texts that are not wanted from being worked on and moved; the join by
    the whole key decides.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            place = np.mod(batch.column(0).to_numpy(), FILTER_BITS)
            batch = batch.filter(pa.array((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1))
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                shingles, starts = shingle_sets(part.column(2).cast(pa.binary()))
                raw = [shingles[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:])]
                columns = [part.column(0), part.column(1), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "shingles"])

    text = whole_text(text_col)
    rows = docs.select(*text_key(text), F.lower(text).alias("text"))
    found = rows.mapInArrow(run, "k1 long, k2 long, shingles binary").join(wanted, ["k1", "k2"])
    return found.groupBy("cls").agg(F.first("shingles").alias("shingles"))


def components(edges: DataFrame, at: str) -> DataFrame:
    """Rows (cls, label): the smallest cls that each end of ``edges`` (a, b) is connected with.

    Each round, a set takes the smallest label of its neighbours, then that label's own label, so labels travel twice as
    far each time. Every round is a written table; the previous one is dropped.
    """
    spark = edges.sparkSession
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.where("a <> b").distinct(), at + "/edges")
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")), at + "/labels0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(near, "a").select("a", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("a").alias("low"), F.col("label").alias("far"))
        new = low.join(jump, "low", "left").select(
            "a", F.coalesce(F.least("low", "far"), "low").alias("label"), F.col("label").alias("old")
        )
        new = written(new, f"{at}/labels{step}")
        changed = new.where("label <> old").limit(1).count()
        if step > 1:
            drop_path(spark, f"{at}/labels{step - 1}")
        labels = new.select("a", "label")
        if not changed:
            return labels.withColumnRenamed("a", "cls")


def _joined_classes(docs: DataFrame, id_col: str, text_col: str, threshold: float, recall: float) -> DataFrame:
    """Rows (id, k1, k2, class_id, first, n_links, n_copies) of the texts with a word; first is (id, k1, k2).

    All steps that run Python write their tables in here.
    """
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        return _classes_of(docs, id_col, text_col, threshold, recall)


def _classes_of(docs: DataFrame, id_col: str, text_col: str, threshold: float, recall: float) -> DataFrame:
    spark = docs.sparkSession
    at = shared_dir(spark)
    runs = runs_for(threshold, recall)
    sketched = written(sketches(docs, id_col, text_col, runs), at + "/sketches")
    classes = sketched.groupBy("cls").agg(
        F.min("id").alias("first_id"),
        F.count(F.lit(1)).alias("copies"),
        F.min(F.struct("id", "k1", "k2")).alias("first"),
        F.first("n").alias("n"),
        F.first("tokens").alias("tokens"),
        F.first("paths").alias("paths"),
    )
    classes = written(classes, at + "/classes")

    placed = written(_leaves(classes, runs), at + "/leaves")
    sizes = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
    sizes = written(sizes, at + "/sizes")
    all_leaves = placed.groupBy("cls").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("run", "leaf"))), lambda x: x["leaf"]).alias("leaves")
    )
    shared = written(placed.join(sizes, "leaf"), at + "/shared")
    about = classes.select("cls", "n", "tokens").join(all_leaves, "cls")
    about = about.join(shared.select("cls").distinct(), "cls", "left_semi")
    members = written(shared.join(about, "cls"), at + "/members")
    drop_path(spark, at + "/leaves")
    drop_path(spark, at + "/shared")

    likely = _grouped(_in_blocks(members).select([c.split()[0] for c in LIKELY.split(", ")]))
    likely = written(likely.mapInArrow(_likely(threshold), LIKELY), at + "/likely")
    wanted = likely.select("cls").distinct().join(classes.select("cls", "first.k1", "first.k2"), "cls")
    sets = written(_shingles_of(docs, text_col, written(wanted, at + "/wanted")), at + "/sets")
    checked = _grouped(likely.join(sets, "cls"))
    partial = checked.mapInArrow(_linked(threshold), "cls binary, links long, least binary")
    partial = written(partial, at + "/links")
    for done in ("sizes", "members", "likely", "wanted", "sets"):
        drop_path(spark, f"{at}/{done}")
    degrees = partial.groupBy("cls").agg(F.sum("links").alias("n_links"))
    labels = components(partial.select(F.col("cls").alias("a"), F.col("least").alias("b")), at)
    own = classes.select("cls", "first_id", "first")
    grouped = labels.join(own, "cls").groupBy("label").agg(
        F.min("first_id").alias("class_id"), F.min("first").alias("class_first")
    )
    result = (
        classes.select("cls", "first_id", "first", "copies")
        .join(degrees, "cls", "left")
        .join(labels.join(grouped, "label"), "cls", "left")
        .select(
            "cls",
            F.coalesce("class_id", "first_id").alias("class_id"),
            F.coalesce("class_first", "first").alias("first"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
            F.col("copies").alias("n_copies"),
        )
    )
    return sketched.select("id", "k1", "k2", "cls").join(result, "cls").drop("cls")


def _wordless(text_col: str) -> Column:
    return ~whole_text(text_col).rlike(r"[^\x09-\x0D\x20]")


def jaccard_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    recall: float = RECALL,
) -> DataFrame:
    """Rows (<id_col>, class_id, n_links, n_copies), one per row of ``docs``.

    class_id is the smallest id among the documents connected by links; n_links counts the other shingle sets linked
    with the document's own, n_copies the rows that have its set. A text without a word (null, empty) is a class of its
    own id, without links. Ids need not be unique: repeated rows get equal results. An empty table gives no rows.
    """
    rows = _joined_classes(docs, id_col, text_col, threshold, recall).select("id", "class_id", "n_links", "n_copies")
    alone = docs.where(_wordless(text_col)).select(
        F.col(id_col).alias("id"), F.col(id_col).alias("class_id"), F.lit(0).cast("long"), F.lit(1).cast("long")
    )
    return rows.union(alone).withColumnRenamed("id", id_col)


def one_of_each(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    recall: float = RECALL,
) -> DataFrame:
    """One row of each class: the one with the smallest id (a null id is smallest); texts without a word all stay.

    Of rows that have this id and text twice, one stays.
    """
    rows = _joined_classes(docs, id_col, text_col, threshold, recall)
    first = rows.select("first.*").distinct().withColumnsRenamed({"id": "__id", "k1": "__k1", "k2": "__k2"})
    k1, k2 = text_key(whole_text(text_col))
    worded = docs.where(~_wordless(text_col)).withColumns({"__d1": k1, "__d2": k2})
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__d1") == F.col("__k1")) & (F.col("__d2") == F.col("__k2"))
    kept = worded.join(first, same, "left_semi").dropDuplicates([id_col, "__d1", "__d2"])
    return kept.select(*docs.columns).unionByName(docs.where(_wordless(text_col)))
