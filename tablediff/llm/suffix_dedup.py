"""Removal of repeated passages: a logarithmic family of sampled suffix arrays, and an exact look at what it finds.

* Texts come in batches. A batch's sampled suffixes (see ``suffix_samples``), in the order of the hash of their first K
  bytes, are its array: a bucketed, sorted table with one row per different K bytes.
* A new array is merge-scanned against each level of the family: a sort-merge join of two tables with the same buckets,
  which needs no exchange. What is found, in it or in both, are the beginnings of possible matches. Then the array
  becomes the lowest level; two levels of one size are merged into the next, so a suffix is rewritten once per doubling.
* For suffixes with a repeated beginning, the stretch of windows around the anchor is looked at. Stretches that occur
  twice as a whole are repeated. Where only some windows may be, the stretch is cut into blocks of BLOCK windows that
  are aligned to the anchor. The bytes that all windows of a block share tell blocks without any match; blocks that
  occur twice are repeated; the windows of the rest are compared one by one.

All comparisons are sums and joins by content, aggregated before the shuffle. Texts have 128-bit keys (equal texts are
one text, counted with its copies). Equality of stretches is that of 64-bit hashes beside an equal anchor or core.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablediff.llm.common import drop_path, shared_dir, shuffle_buckets, shuffles_dropped, text_key, whole_text, written
from tablediff.llm.suffix_samples import MATCH, as_bytes, mixed, samples, strips

BATCHES = 4
BLOCK = 16

SAMPLE = "k1 long, k2 long, h long, a int, w int, c long, starts array<int>"


class SuffixFamily:
    """The levels of the index: level r holds 2^r batches, or nothing."""

    def __init__(self, spark: SparkSession, at: str, buckets: int | None = None):
        self.spark, self.at = spark, at
        self.buckets = buckets or shuffle_buckets(spark)
        self.name = f"suffixes_{uuid.uuid4().hex}"
        self.levels: dict[int, str] = {}
        self.made = 0
        self.found: list[int] = []

    def _stored(self, rows: DataFrame) -> str:
        self.made += 1
        table = f"{self.name}_{self.made}"
        with shuffles_dropped(self.spark):
            rows.write.bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.at}/{table}").saveAsTable(table)
        return table

    def _dropped(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE {table}")
        drop_path(self.spark, f"{self.at}/{table}")

    def add(self, suffixes: DataFrame) -> DataFrame:
        """Take a batch in (rows h, n); returns the beginnings h that it repeats, in itself or in earlier batches."""
        array = suffixes.repartition(self.buckets, "h").groupBy("h").agg(F.sum("n").alias("n"))
        new = self._stored(array)
        scan = self.spark.table(new)
        found = scan.where("n > 1").select("h")
        for level in self.levels.values():
            found = found.union(scan.hint("merge").join(self.spark.table(level).select("h"), "h").select("h"))
        found = written(found, f"{self.at}/found_{self.made}")
        self.found.append(self.made)
        rank = 0
        while rank in self.levels:
            old = self.levels.pop(rank)
            both = self.spark.table(new).hint("merge").join(self.spark.table(old).withColumnRenamed("n", "m"), "h", "full")
            merged = self._stored(both.select("h", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n")))
            self._dropped(new)
            self._dropped(old)
            new, rank = merged, rank + 1
        self.levels[rank] = new
        return found

    def close(self) -> None:
        for table in self.levels.values():
            self._dropped(table)
        self.levels = {}


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    text = whole_text(text_col)
    return docs.select(*text_key(text), text.cast("binary").alias("raw"))


def _beginnings(docs: DataFrame, text_col: str) -> DataFrame:
    """Rows (batch key k1, h, n) of all samples, equal ones of one text and strip as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy()
            for text, _, _, _, h, _ in samples(as_bytes(batch.column(2))):
                order = np.lexsort((h, text))
                text, h = text[order], h[order]
                first = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (h[1:] != h[:-1]))))
                n = np.diff(np.append(first, len(h)))
                arrays = [pa.array(key[text[first]]), pa.array(h[first].view(np.int64)), pa.array(n)]
                yield pa.RecordBatch.from_arrays(arrays, names=["k1", "h", "n"])

    return _keyed(docs, text_col).mapInArrow(run, "k1 long, h long, n long")


def _stretches(docs: DataFrame, text_col: str) -> DataFrame:
    """Rows SAMPLE: anchor hash h, its distance a from the first window start, w windows, the bytes' hash c, and where
    in the text such stretches start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(c).to_numpy() for c in (0, 1))
            for text, start, w, a, h, c in samples(as_bytes(batch.column(2))):
                order = np.lexsort((start, c, a, h, text))
                text, start, w, a, h, c = (x[order] for x in (text, start, w, a, h, c))
                new = np.ones(len(h), bool)
                new[1:] = np.any([x[1:] != x[:-1] for x in (text, h, a, w, c)], axis=0)
                first = np.flatnonzero(new)
                at = pa.array(np.append(first, len(h)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(k1[text[first]]),
                        pa.array(k2[text[first]]),
                        pa.array(h[first].view(np.int64)),
                        pa.array(a[first].astype(np.int32)),
                        pa.array(w[first].astype(np.int32)),
                        pa.array(c[first].view(np.int64)),
                        pa.ListArray.from_arrays(at, pa.array(start.astype(np.int32))),
                    ],
                    names=["k1", "k2", "h", "a", "w", "c", "starts"],
                )

    return _keyed(docs, text_col).mapInArrow(run, SAMPLE)


def _local_strips(raw: bytes, jobs: list[dict]) -> Iterator[tuple]:
    """The strips of one text with the jobs (first, w, ...) whose windows lie in them; a job may be cut in two."""
    for strip, where in strips([raw]):
        for _, place, lo, hi in where:
            last = place + (hi - lo) - MATCH  # the last window start
            for job in jobs:
                first, stop = max(job["first"], place), min(job["first"] + job["w"] - 1, last)
                if first <= stop:
                    yield strip, lo - place, job, first, stop


def _blocks(raw: bytes, jobs: list[dict]) -> Iterator[tuple[int, int, int, int]]:
    """(core, content, first window start, windows) of the aligned blocks of each job's windows.

    ``place`` below turns a place in the text into one in the strip. Windows at distances d .. d + BLOCK - 1 before the
    anchor are one block; their shared bytes go from the anchor less d to the end of the farthest window.
    """
    for strip, place, job, first, stop in _local_strips(raw, jobs):
        anchor = job["first"] + job["a"]
        far = np.arange((anchor - stop) // BLOCK, (anchor - first) // BLOCK + 1)  # blocks, nearest first
        core_lo = anchor - BLOCK * far
        core_hi = core_lo - (BLOCK - 1) + MATCH
        lo, hi = np.maximum(first, core_lo - (BLOCK - 1)), np.minimum(stop, core_lo)
        salt = np.uint64(job["h"] & 0xFFFFFFFFFFFFFFFF)
        core = mixed(strip.hashes(core_lo + place, core_hi + place) ^ mixed(salt + far.astype(np.uint64)))
        content = mixed(strip.hashes(lo + place, hi + MATCH + place) + (anchor - lo).astype(np.uint64))
        yield from zip(core.view(np.int64).tolist(), content.view(np.int64).tolist(), lo.tolist(), (hi - lo + 1).tolist())


def _windows(raw: bytes, jobs: list[dict]) -> Iterator[tuple[int, int]]:
    """(hash, start) of each window of each job."""
    for strip, place, _, first, stop in _local_strips(raw, jobs):
        at = np.arange(first, stop + 1)
        yield from zip(strip.hashes(at + place, at + place + MATCH).view(np.int64).tolist(), at.tolist())


def _per_text(make, names: list[str], types: list[pa.DataType]):
    """A mapInArrow function for rows (k1, k2, raw, jobs): ``make``'s rows for each text, after its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                keys = part.select(["k1", "k2"]).to_pylist()
                rows, texts = [], as_bytes(part.column("raw"))
                for key, raw, jobs in zip(keys, texts, part.column("jobs").to_pylist(), strict=True):
                    rows += [(key["k1"], key["k2"], *row) for row in make(raw, jobs)]
                columns = list(zip(*rows)) if rows else [[]] * (2 + len(names))
                arrays = [pa.array(x, t) for x, t in zip(columns, [pa.int64(), pa.int64(), *types], strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["k1", "k2", *names])

    return run


def repeated_texts(docs: DataFrame, at: str, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """Rows (k1, k2, kept, n_removed, n_spans) of the different texts that hold a repeated window; kept is binary.

    A window is repeated if its MATCH bytes also start anywhere else, in the same text, in another one, or in a copy of
    the text. All bytes of repeated windows are removed, judged on the texts as given. A text whose row is repeated (same
    id, same text) may have its row twice. The result reads tables below ``at``; once it is written, the caller drops
    that folder.
    """
    spark = docs.sparkSession
    key = ["k1", "k2"]

    # The family finds the repeated beginnings.
    counts = written(_beginnings(docs, text_col), at + "/beginnings")
    family = SuffixFamily(spark, at)
    found = None
    for b in range(batches):
        own = family.add(counts.where(F.pmod("k1", F.lit(batches)) == b).select("h", "n"))
        found = own if found is None else found.union(own)
    repeated = written(found.distinct(), at + "/repeated")
    family.close()
    for done in ("beginnings", *(f"found_{made}" for made in family.found)):
        drop_path(spark, f"{at}/{done}")

    # Stretches around them, and those that occur twice as a whole.
    one = ["h", "a", "w", "c"]
    held = _stretches(docs, text_col).join(repeated, "h").groupBy(*key, *one, "starts").agg(F.count(F.lit(1)).alias("copies"))
    held = written(held, at + "/stretches")
    drop_path(spark, at + "/repeated")
    kinds = held.groupBy(*one).agg(
        F.sum(F.size("starts") * F.col("copies")).alias("n"),
        F.min(F.struct("k1", "k2", F.array_min("starts").alias("first"))).alias("witness"),
    )
    kinds = written(kinds, at + "/kinds")
    open_ = kinds.where("n = 1").select("h").distinct()
    witnesses = kinds.where("n > 1").join(open_, "h", "left_semi")
    whole = held.join(kinds.select(*one, "n"), one).select(*key, *one, "n", F.explode("starts").alias("first"))
    job = F.struct("first", "w", "a", "h").alias("job")
    looked_at = whole.where("n = 1").select(*key, job)
    looked_at = looked_at.union(witnesses.select("witness.k1", "witness.k2", "witness.first", "w", "a", "h").select(*key, job))
    jobs = looked_at.groupBy(*key).agg(F.collect_list("job").alias("jobs"))
    sure = whole.where("n > 1").groupBy(*key).agg(F.collect_list(F.struct("first", "w")).alias("sure"))
    lists = written(jobs.join(sure, key, "full"), at + "/lists")
    drop_path(spark, at + "/stretches")
    drop_path(spark, at + "/kinds")

    # One row of each text with such stretches, with its bytes.
    texts = _keyed_once(docs, id_col, text_col).join(lists.select(*key), key, "left_semi")
    texts = written(_rows_of(docs, id_col, text_col).join(texts, [*key, "id_key"]).select(*key, "raw"), at + "/texts")

    # Blocks of the stretches that are open, then the windows of those blocks that still are.
    with_jobs = texts.join(lists.where("jobs IS NOT NULL").select(*key, "jobs"), key)
    make = _per_text(_blocks, ["core", "content", "first", "w"], [pa.int64(), pa.int64(), pa.int32(), pa.int32()])
    blocks = with_jobs.mapInArrow(make, "k1 long, k2 long, core long, content long, first int, w int")
    blocks = written(blocks.distinct(), at + "/blocks")
    contents = blocks.groupBy("core", "content").agg(F.count(F.lit(1)).alias("n"))
    cores = contents.groupBy("core").agg(F.sum("n").alias("of_core"))
    states = contents.join(cores, "core").where("of_core > 1").select("core", "content", (F.col("n") > 1).alias("twice"))
    states = blocks.join(states, ["core", "content"]).select(*key, "first", "w", "core", "twice")
    states = written(states, at + "/states")
    drop_path(spark, at + "/blocks")
    left = states.where("NOT twice").groupBy(*key).agg(F.collect_list(F.struct("first", "w")).alias("jobs"))
    # The windows of blocks that occur twice are there to be met by those of others.
    met = states.where("twice").join(states.where("NOT twice").select("core").distinct(), "core", "left_semi")
    met = met.groupBy(*key).agg(F.collect_list(F.struct("first", "w")).alias("more"))
    none = F.array().cast("array<struct<first:int,w:int>>")
    left = left.join(met, key, "full").select(
        *key, F.concat(F.coalesce("jobs", none), F.coalesce("more", none)).alias("jobs")
    )
    make = _per_text(_windows, ["hash", "first"], [pa.int64(), pa.int32()])
    windows = texts.join(left, key).mapInArrow(make, "k1 long, k2 long, hash long, first int").distinct()
    windows = written(windows, at + "/windows")
    twice = windows.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    single = windows.join(twice, "hash").select(*key, "first", F.lit(1).alias("w"))
    late = states.where("twice").select(*key, "first", "w").union(single)
    late = late.groupBy(*key).agg(F.collect_list(F.struct("first", "w")).alias("late"))

    spans = lists.select(*key, "sure").join(late, key, "full")
    spans = spans.select(*key, F.concat(F.coalesce("sure", none), F.coalesce("late", none)).alias("spans"))
    cut = texts.join(spans.where(F.size("spans") > 0), key)
    return cut.mapInArrow(_cut, "k1 long, k2 long, kept binary, n_removed long, n_spans long")


def _rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = whole_text(text_col)
    return docs.select(*text_key(text), F.xxhash64(id_col).alias("id_key"), text.cast("binary").alias("raw"))


def _keyed_once(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (k1, k2, id_key): for each text one of the rows that hold it (a repeated row may be taken twice)."""
    rows = docs.select(*text_key(whole_text(text_col)), F.xxhash64(id_col).alias("id_key"))
    return rows.groupBy("k1", "k2").agg(F.min("id_key").alias("id_key"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k1, k2, raw, spans) to rows with the bytes that no span's windows cover."""
    for batch in batches:
        kept, removed, runs = [], [], []
        texts, spans = as_bytes(batch.column("raw")), batch.column("spans")
        for i, raw in enumerate(texts):
            own = spans[i].values
            first, w = own.field("first").to_numpy(), own.field("w").to_numpy()
            edge = np.zeros(len(raw) + 1, np.int32)
            np.add.at(edge, first, 1)
            np.add.at(edge, first + w - 1 + MATCH, -1)
            covered = np.cumsum(edge[:-1]) > 0
            removed.append(int(covered.sum()))
            runs.append(int((covered & ~np.concatenate(([False], covered[:-1]))).sum()))
            kept.append(np.frombuffer(raw, np.uint8)[~covered].tobytes())
        columns = [batch.column("k1"), batch.column("k2"), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(removed, pa.int64()), pa.array(runs, pa.int64())],
            names=["k1", "k2", "kept", "n_removed", "n_spans"],
        )


def suffix_dedup_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """Rows (<id_col>, n_bytes, n_removed, n_spans, kept_sha256), one per row of ``docs``; null texts are empty.

    Texts shorter than MATCH bytes keep everything. Of a text that occurs twice, all is removed from both rows.
    """
    at = shared_dir(docs.sparkSession)
    changed = repeated_texts(docs, at + "/work", id_col, text_col, batches)
    changed = changed.select("k1", "k2", "n_removed", "n_spans", F.sha2("kept", 256).alias("own_sha256"))
    changed = written(changed.distinct(), at + "/changed")
    drop_path(docs.sparkSession, at + "/work")
    text = whole_text(text_col)
    rows = docs.select(
        F.col(id_col),
        *text_key(text),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.sha2(text.cast("binary"), 256).alias("sha256"),
    )
    return rows.join(changed, ["k1", "k2"], "left").select(
        id_col,
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("own_sha256", "sha256").alias("kept_sha256"),
    )


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """``docs`` with the repeated windows cut out of the text; characters that a cut broke are left out.

    All rows and columns stay. A null text stays null; a text of which nothing is left is empty.
    """
    at = shared_dir(docs.sparkSession)
    changed = written(repeated_texts(docs, at + "/work", id_col, text_col, batches), at + "/changed")
    drop_path(docs.sparkSession, at + "/work")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [raw.decode(errors="ignore") for raw in as_bytes(part.column(2))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["k1", "k2", "__new"])

    one = changed.select("k1", "k2", "kept").dropDuplicates(["k1", "k2"])
    decoded = one.mapInArrow(run, "k1 long, k2 long, __new string")
    k1, k2 = text_key(whole_text(text_col))
    joined = docs.withColumns({"__k1": k1, "__k2": k2}).join(
        decoded.withColumnsRenamed({"k1": "__k1", "k2": "__k2"}), ["__k1", "__k2"], "left"
    )
    return joined.withColumn(text_col, F.coalesce("__new", text_col)).select(*docs.columns)
