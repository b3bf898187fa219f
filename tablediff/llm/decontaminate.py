"""Benchmark decontamination by suffix arrays over the training texts.

* The documents' words (hashed, in the order of their hashes) are cut into shards of at most SHARD_WORDS words. Each
  shard's suffix array is worked out in a task by prefix doubling and written beside the rows: an index that several
  benchmarks can be searched in. Equal texts of one shard stand in it once; a text longer than a shard goes on in the
  next one, with an overlap of one word less than a window.
* A benchmark comes in blocks of about BLOCK_WORDS words, dealt out by content. Each block is broadcast (that is its
  size bound) and each of its suffixes is binary-searched in every shard: first to the depth of a window, which gives
  the interval of all places where the window stands; inside it word by word as deep as any place goes on, which gives
  the longest verbatim match and where it stands.
* Windows that stand at the same places are one interval, so a passage that many items and many texts share is marked
  once per place, not once per pair.

Two words are equal if their 64-bit hashes are; a window is equal if all of its words are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablediff.llm.common import shared_dir, written
from tablediff.llm.shingles import _mixed as mixed
from tablediff.llm.shingles import _powers as powers
from tablediff.llm.shingles import constants

WINDOW = 10
SHARD_WORDS = 1 << 19
BLOCK_WORDS = 1 << 21
_STRIP = 1 << 20

_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = True
_WORD[ord("A") : ord("Z") + 1] = True
_WORD[ord("a") : ord("z") + 1] = True
_WORD[128:] = True
_LOWER = np.arange(256)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE = np.where(_WORD, constants(256, 21)[_LOWER], np.uint64(0))

ARRAYS = "vocab binary, words binary, suffixes binary, texts array<long>, firsts array<long>"
SPANS = "array<struct<start:long,n_words:long>>"
LONGEST = "struct<n_words:long,start:long,item_id:string,item_word:long>"


def _strips(raw: bytes) -> Iterator[bytes]:
    """Pieces of a text of about _STRIP bytes that cut no word."""
    lo = 0
    while len(raw) - lo > _STRIP:
        other = np.flatnonzero(~_WORD[np.frombuffer(raw, np.uint8, _STRIP, lo)])
        if len(other):
            hi = lo + int(other[-1]) + 1
        else:
            hi = lo + _STRIP
            while hi < len(raw) and _WORD[raw[hi]]:
                hi += 1
        yield raw[lo:hi]
        lo = hi
    yield raw[lo:]


def hashed_words(texts: list[bytes]) -> list[np.ndarray]:
    """Each text's words, lower-cased (A-Z), as 64-bit hashes."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    rows: list[int] = []
    parts: list[bytes] = []

    def flush() -> None:
        raw = np.frombuffer(b"\0".join(parts), np.uint8)
        inside = _WORD[raw]
        starts = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1])))
        if len(starts):
            up, down = powers(len(raw))
            hashes = mixed(np.add.reduceat(_BYTE[raw] * up[: len(raw)], starts) * down[starts])
            ends = np.cumsum([len(p) + 1 for p in parts])
            cuts = np.searchsorted(starts, ends)
            for row, a, b in zip(rows, [0, *cuts], cuts):
                out[row].append(hashes[a:b])
        rows.clear()
        parts.clear()

    size = 0
    for i, text in enumerate(texts):
        for part in _strips(text):
            rows.append(i)
            parts.append(part)
            size += len(part) + 1
            if size >= _STRIP:
                flush()
                size = 0
    if parts:
        flush()
    none = np.zeros(0, np.uint64)
    return [x[0] if len(x) == 1 else np.concatenate(x) if x else none for x in out]


def suffix_array(words: np.ndarray, separators: int) -> np.ndarray:
    """The places of ``words`` in the order of their suffixes, without those of the separators.

    The numbers 0 to separators - 1 stand once each, the last one at the end; so all suffixes differ. Prefix doubling:
    ranks by the first two numbers, then pairs of ranks, for the places whose rank is still shared.
    """
    n = len(words)
    bits = np.uint64(n.bit_length())
    index = np.arange(n, dtype=np.uint64)
    mask = (np.uint64(1) << bits) - np.uint64(1)

    def by(first: np.ndarray, second: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``place`` in the order of (first, second), and where a new pair begins."""
        packed = np.sort((first << (bits + bits)) | (second << bits) | place)
        pair = packed >> bits
        return packed & mask, np.concatenate(([True], pair[1:] != pair[:-1]))

    symbols = words.astype(np.uint64)
    order, new = by(symbols, np.append(symbols[1:], np.uint64(0)), index)
    slot = index  # the slots of ``order`` that are looked at
    rank = np.empty(n, np.uint64)
    array, depth = order.copy(), 2
    while True:
        head = np.maximum.accumulate(np.where(new, slot, np.uint64(0)))
        rank[order] = head
        shared = ~new | ~np.append(new[1:], True)
        slot, order = slot[shared], order[shared]
        if not len(slot):
            return array[separators:].astype(np.int64)
        order, new = by(rank[order], rank[order + np.uint64(depth)], order)
        array[slot] = order
        depth *= 2


def _shard(pieces: list[tuple[int, int, np.ndarray]]) -> dict:
    """The arrays of the pieces (text number, place of its first word in the text, hashed words)."""
    flat = np.concatenate([w for _, _, w in pieces])
    coded = pa.array(flat).dictionary_encode()
    vocab = coded.dictionary.to_numpy()
    order = np.argsort(vocab)
    place = np.empty(len(vocab), np.int32)
    place[order] = np.arange(len(vocab), dtype=np.int32) + len(pieces)
    words = np.empty(len(flat) + len(pieces), np.int32)
    ends = np.cumsum([len(w) + 1 for _, _, w in pieces]) - 1
    inside = np.ones(len(words), bool)
    inside[ends] = False
    words[inside] = place[coded.indices.to_numpy()]
    words[ends] = np.arange(len(pieces))
    return {
        "vocab": vocab[order].tobytes(),
        "words": words.tobytes(),
        "suffixes": suffix_array(words, len(pieces)).astype(np.int32).tobytes(),
        "texts": [t for t, _, _ in pieces],
        "firsts": [f for _, f, _ in pieces],
    }


def suffix_arrays(rows: DataFrame, shard_words: int = SHARD_WORDS, overlap: int = WINDOW - 1) -> DataFrame:
    """The index of ``rows`` (columns row, a struct, and text): rows (row, text_no, n_words) and rows (arrays).

    text_no is the same for rows with equal texts of one shard and null for texts without words. ``shard_words`` is at
    most SHARD_WORDS.
    """
    if not 0 <= overlap < shard_words <= SHARD_WORDS:
        raise ValueError(f"shard_words must be more than {overlap} and at most {SHARD_WORDS}")
    schema = T.StructType(
        [
            T.StructField("row", rows.schema["row"].dataType),
            T.StructField("text_no", T.LongType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("arrays", T.StructType.fromDDL(ARRAYS)),
        ]
    )
    struct = pa.struct(
        [(n, pa.binary()) for n in ("vocab", "words", "suffixes")] + [(n, pa.list_(pa.int64())) for n in ("texts", "firsts")]
    )

    def as_row(pieces: list[tuple[int, int, np.ndarray]], kind: pa.DataType) -> pa.RecordBatch:
        nulls = [pa.nulls(1, t) for t in (kind, pa.int64(), pa.int64())]
        return pa.RecordBatch.from_arrays([*nulls, pa.array([_shard(pieces)], struct)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        known: dict[bytes, tuple[int | None, int]] = {}  # the texts of the current shard: number, words
        pieces: list[tuple[int, int, np.ndarray]] = []
        held, kind = 0, None
        for batch in batches:
            row, texts = batch.column(0), batch.column(1)
            kind = row.type
            for lo in range(0, len(texts), 256):
                raws = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in texts.slice(lo, 256)]
                fresh = list(dict.fromkeys(r for r in raws if r not in known))
                full = False
                for raw, words in zip(fresh, hashed_words(fresh), strict=True):
                    known[raw] = (number if len(words) else None, len(words))
                    for first in range(0, len(words) - overlap if len(words) > overlap else len(words), shard_words):
                        part = words[first : first + shard_words + overlap]
                        pieces.append((number, first, part))
                        held += len(part)
                        if held >= shard_words:
                            yield as_row(pieces, kind)
                            pieces, held, full = [], 0, True
                    number += 1
                own = [known[raw] for raw in raws]
                made = [pa.array([x[k] for x in own], pa.int64()) for k in (0, 1)]
                n = len(raws)
                yield pa.RecordBatch.from_arrays([row.slice(lo, n), *made, pa.nulls(n, struct)], names=schema.names)
                if full:
                    known = {}
        if pieces:
            yield as_row(pieces, kind)

    return rows.mapInArrow(run, schema)


class Block:
    """A block of benchmark items: their words one after the other, with the items' names."""

    def __init__(self, rows: list, window: int):
        parts = [np.frombuffer(r["words"], np.uint64) for r in rows]
        sizes = np.array([len(p) for p in parts], np.int64)
        ends = np.cumsum(sizes)
        self.items = [r["item_id"] for r in rows]
        self.item = np.repeat(np.arange(len(rows)), sizes)
        self.place = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
        self.first = np.array([r["first"] for r in rows], np.int64)
        self.left = np.repeat(ends, sizes) - np.arange(ends[-1])  # words up to the item's end
        whole = np.array([r["n_words"] for r in rows], np.int64)
        self.wide = np.minimum(window, np.repeat(whole, sizes))
        self.vocab, self.words = np.unique(np.concatenate(parts), return_inverse=True)


def _bound(words, suffixes, lo, hi, depth, want) -> np.ndarray:
    """The first place of each [lo, hi) whose suffix has no smaller number than ``want`` at ``depth``."""
    lo, hi = lo.copy(), hi.copy()
    depth = np.broadcast_to(depth, lo.shape)
    while True:
        live = np.flatnonzero(lo < hi)
        if not len(live):
            return lo
        mid = (lo[live] + hi[live]) >> 1
        less = words[suffixes[mid] + depth[live]] < want[live]
        lo[live[less]] = mid[less] + 1
        hi[live[~less]] = mid[~less]


def _narrowed(words, suffixes, lo, hi, depth, want) -> tuple[np.ndarray, np.ndarray]:
    lo = _bound(words, suffixes, lo, hi, depth, want)
    return lo, _bound(words, suffixes, lo, hi, depth, want + 1)


def _slots(lo, hi) -> tuple[np.ndarray, np.ndarray]:
    """All numbers in the intervals, one interval after the other, and each one's interval."""
    size = hi - lo
    which = np.repeat(np.arange(len(lo)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + lo[which], which


def _largest(lo, hi, value, n: int) -> np.ndarray:
    """For each of 0 to n - 1 the largest value of the intervals around it: each interval is the union of two stretches
    whose length is a power of two, and stretches hand their values down to their halves."""
    level = np.frexp((hi - lo).astype(float))[1] - 1
    out = np.full(n, -1, np.int64)
    for k in range(int(level.max()), -1, -1):
        own = np.flatnonzero(level == k)
        np.maximum.at(out, lo[own], value[own])
        np.maximum.at(out, hi[own] - (1 << k), value[own])
        if k:
            half = 1 << (k - 1)
            below = out.copy()
            below[half:] = np.maximum(out[half:], out[:-half])
            out = below
    return out


def search(shard: dict, block: Block) -> list[dict]:
    """For each text of the shard with windows of the block: where they stand, their items, the longest match."""
    vocab, words = np.frombuffer(shard["vocab"], np.uint64), np.frombuffer(shard["words"], np.int32)
    suffixes = np.frombuffer(shard["suffixes"], np.int32).astype(np.int64)
    separators = len(shard["texts"])
    at = np.minimum(np.searchsorted(vocab, block.vocab), len(vocab) - 1)
    known = np.where(vocab[at] == block.vocab, at + separators, -1)[block.words]
    strange = np.concatenate(([0], np.cumsum(known < 0)))
    start = np.arange(len(known))
    fits = block.left >= block.wide
    stop = np.minimum(start + block.wide, len(known))
    start = start[fits & (strange[stop] == strange[start])]
    lo, hi = np.zeros(len(start), np.int64), np.full(len(start), len(suffixes))
    for depth in range(int(block.wide[start].max(initial=0))):
        deep = np.flatnonzero(block.wide[start] > depth)
        lo[deep], hi[deep] = _narrowed(words, suffixes, lo[deep], hi[deep], depth, known[start[deep] + depth])
        some = lo < hi
        start, lo, hi = start[some], lo[some], hi[some]
    if not len(start):
        return []
    wide = block.wide[start]

    # Windows with the same places are one interval.
    same = np.stack([lo, hi, wide])
    intervals, which = np.unique(same, axis=1, return_inverse=True)
    slot, of = _slots(intervals[0], intervals[1])
    place = suffixes[slot]
    edge = np.bincount(place, minlength=len(words) + 1) - np.bincount(place + intervals[2][of], minlength=len(words) + 1)
    hit = np.cumsum(edge)[: len(words)] > 0
    ends = np.flatnonzero(words < separators)
    begins = np.concatenate(([0], ends[:-1] + 1))
    first = np.flatnonzero(hit & ~np.concatenate(([False], hit[:-1])))
    last = np.flatnonzero(hit & ~np.append(hit[1:], False))
    owner = np.searchsorted(ends, first)

    # Items of each text: pairs (text, interval), then (interval, item).
    pairs = np.unique(np.searchsorted(ends, place) * np.int64(intervals.shape[1]) + of)
    by = np.argsort(which, kind="stable")
    item_from = np.searchsorted(which[by], np.arange(intervals.shape[1] + 1))
    holding = block.item[start[by]]

    # How far each suffix goes on inside its interval; the longest at each place, and of those the first of each text.
    far = wide.copy()
    live = np.flatnonzero(block.left[start] > far)
    while len(live):
        live = live[known[start[live] + far[live]] >= 0]
        a, b = _narrowed(words, suffixes, lo[live], hi[live], far[live], known[start[live] + far[live]])
        on = a < b
        live = live[on]
        lo[live], hi[live] = a[on], b[on]
        far[live] += 1
        live = live[block.left[start[live]] > far[live]]
    slots = np.unique(slot)
    value = far * len(far) + np.arange(len(far) - 1, -1, -1)
    best = _largest(np.searchsorted(slots, lo), np.searchsorted(slots, hi), value, len(slots))
    by_far, which_far = np.divmod(best, len(far))
    match_at = suffixes[slots]
    text = np.searchsorted(ends, match_at)
    order = np.lexsort((match_at, -by_far, text))
    order = order[np.concatenate(([True], text[order][1:] != text[order][:-1]))]
    longest = {int(text[i]): (int(by_far[i]), int(match_at[i]), int(start[len(far) - 1 - which_far[i]])) for i in order}

    out: dict[int, dict] = {}
    for t, a, b in zip(owner.tolist(), first.tolist(), last.tolist()):
        base = shard["firsts"][t] - int(begins[t])
        found = out.setdefault(t, {"text_no": shard["texts"][t], "spans": [], "items": set(), "longest": None})
        found["spans"].append({"start": a + base, "n_words": b - a + 1})
    for pair in pairs.tolist():
        t, interval = divmod(pair, intervals.shape[1])
        out[t]["items"].update(holding[item_from[interval] : item_from[interval + 1]].tolist())
    for t, found in out.items():
        found["items"] = [block.items[i] for i in found["items"]]
        n, where, j = longest[t]
        i = int(block.item[j])
        found["longest"] = {
            "n_words": n,
            "start": where + shard["firsts"][t] - int(begins[t]),
            "item_id": block.items[i],
            "item_word": int(block.place[j] + block.first[i]),
        }
    return list(out.values())


def _item_words(tests: DataFrame, window: int, piece: int) -> DataFrame:
    """Rows (item_id, first, n_words, words) of the items' hashed words, long items in pieces that share window - 1 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(1)]
            rows = []
            for item, words in zip(ids, hashed_words(texts), strict=True):
                for first in range(0, max(1, len(words) - window + 1) if len(words) else 0, piece):
                    rows.append((item, first, len(words), words[first : first + piece + window - 1].tobytes()))
            columns = list(zip(*rows)) if rows else [[]] * 4
            types = [pa.string(), pa.int64(), pa.int64(), pa.binary()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["item_id", "first", "n_words", "words"])

    return tests.mapInArrow(run, "item_id string, first long, n_words long, words binary")


def find_items(
    index: DataFrame, tests: DataFrame, item_col: str, test_text_col: str, window: int = WINDOW, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """Rows (text_no, spans, items, longest) of the index's texts that hold windows of ``tests``.

    spans are the maximal runs of hit words; items the sorted, distinct item ids as text (a null id is the empty text);
    longest is the longest verbatim match that an item's suffix has in the text (of equal ones the first in the text).
    ``index`` is read once per block and must have been written.
    """
    spark = index.sparkSession
    at = shared_dir(spark)
    items = tests.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item_id"), F.col(test_text_col).cast("string"))
    held = written(_item_words(items, window, block_words // 2), at + "/items")
    size = held.agg(F.sum(F.octet_length("words"))).head()[0] or 0
    blocks = -(-size // (8 * block_words))
    arrays = index.where("arrays IS NOT NULL").select("arrays")
    out = "text_no long, spans " + SPANS + ", items array<string>, longest " + LONGEST
    kind = pa.schema(
        [
            ("text_no", pa.int64()),
            ("spans", pa.list_(pa.struct([("start", pa.int64()), ("n_words", pa.int64())]))),
            ("items", pa.list_(pa.string())),
            (
                "longest",
                pa.struct([("n_words", pa.int64()), ("start", pa.int64()), ("item_id", pa.string()), ("item_word", pa.int64())]),
            ),
        ]
    )

    def searched(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard in batch.column(0):
                    yield pa.RecordBatch.from_pylist(search(shard.as_py(), sent.value), kind)

        return run

    found = spark.createDataFrame([], out)
    for b in range(blocks):
        rows = held.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == b).collect()
        if not rows:
            continue
        sent = spark.sparkContext.broadcast(Block(rows, window))
        found = found.union(written(arrays.mapInArrow(searched(sent), out), f"{at}/found{b}"))
        sent.unpersist()

    def merged(spans: Column) -> Column:
        """Runs that meet or overlap become one."""
        start = F.array().cast(SPANS)

        def step(done: Column, s: Column) -> Column:
            last = F.get(done, F.size(done) - 1)
            end = last["start"] + last["n_words"]
            longer = F.struct(
                last["start"].alias("start"),
                (F.greatest(end, s["start"] + s["n_words"]) - last["start"]).alias("n_words"),
            )
            apart = F.concat(done, F.array(s))
            return F.when(end >= s["start"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(apart)

        return F.aggregate(F.sort_array(spans), start, step)

    best = F.max(F.struct(F.col("longest.n_words").alias("n"), (-F.col("longest.start")).alias("s"), "longest"))["longest"]
    return found.groupBy("text_no").agg(
        merged(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        best.alias("longest"),
    )


NEW = ("n_words", "n_hit", "spans", "items", "longest", "contaminated")


def find_contamination(
    docs: DataFrame,
    tests: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    test_text_col: str = "text",
    window: int = WINDOW,
    shard_words: int = SHARD_WORDS,
    block_words: int = BLOCK_WORDS,
    keep_text: bool = True,
) -> DataFrame:
    """All rows and columns of ``docs`` with NEW (columns of these names are replaced); the text goes if not ``keep_text``.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. n_hit
    counts the words inside any occurrence of a window; spans, items and longest are as in ``find_items`` (empty lists
    and null without one). Null and empty texts, on both sides, have no words. Repeated rows stay repeated rows;
    items with the same id are one item, a null id is the empty text. Empty tables give no hits or no rows.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in NEW and (keep_text or c != text_col)]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    index = written(suffix_arrays(rows, shard_words, max(0, window - 1)), shared_dir(spark) + "/index")
    found = find_items(index, tests, item_col, test_text_col, window, block_words)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["n_words"])
    joined = index.where("arrays IS NULL").select("row", "text_no", "n_words").join(found, "text_no", "left")
    return joined.select(
        *[F.col("row").getField(c).alias(c) for c in kept],
        "n_words",
        F.coalesce(n_hit, F.lit(0)).alias("n_hit"),
        F.coalesce("spans", F.array().cast(SPANS)).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        "longest",
        F.col("spans").isNotNull().alias("contaminated"),
    )


def decontaminate(docs: DataFrame, tests: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` without a window of ``tests``, with the columns they came with (see ``find_contamination``)."""
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("given"), F.col(how.pop("text_col", "text")).alias("text"))
    clean = find_contamination(marked, tests, "text", keep_text=False, **how).where(~F.col("contaminated"))
    return clean.select("given.*")


def contamination_digest(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """Rows (<id_col>, n_words, n_hit, n_items, items_sha256, contaminated), one per row of ``docs``."""
    found = find_contamination(docs.select(id_col, "text"), tests, keep_text=False, **how)
    return found.select(
        id_col,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )
