"""Alignment of two tokenizers over the same texts, by interval coalescing, with corpus-wide counts of linked ids.

All tokens of both tokenizers are byte ranges of a space and the text. They are sorted by where they start (lexsort),
the ends are accumulated with their running maximum, and a group breaks where a start reaches it: there tokens of both
sides end. Inside groups every pair of tokens whose ranges overlap is a link. Where a character is in front of white
space, tokens of both sides end whatever else stands in the text, so a stretch between such places is aligned once and
remembered: a text's groups and links are those of its stretches in turn.

Texts are read in strips of about STRIP_BYTES. A strip's distinct id pairs, with the number of its documents that hold
them, are one row each; they are counted over the corpus, and each strip gets the counts of its own pairs back, so no
more than the pairs of a strip come together and a pair that all documents hold is one row per strip. Texts longer than
PIECE_CHARS are aligned in pieces, cut in front of a space after a printable ASCII character and before a letter, where
both tokenizers begin a token.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablediff.llm.chunk_ids import _gather as gathered
from tablediff.llm.common import shared_dir, written
from tablediff.llm.segment_ids import MEMORY_SEGMENTS, SegmentIds, byte_level_ids, piece_ids, shared_cut, tokenizer_file

STRIP_BYTES = 8 << 20
PIECE_CHARS = 1 << 18
BATCH_CHARS = 1 << 20
MEMORY_CHARS = 8_000_000

MEASURES = ("n_a", "n_b", "n_groups", "n_links")
NEW = (*MEASURES, "groups_sha256", "n_best", "count_sum")
# Distinct pairs (A's id * 2^32 + B's), how many documents of the strip hold each; then, text by text, which pairs and
# how often, as compressed 32-bit numbers.
PAIRS = "pairs array<long>, docs array<long>, members array<int>, sizes array<int>, which binary, times binary"

Ids = tuple[np.ndarray, np.ndarray]

_CUT = re.compile(r"(?<=[!-~]) (?=[A-Za-z])")
_LOADED: dict[tuple[str, str], _Aligner] = {}


def _loaded(a_file: str, b_file: str) -> _Aligner:
    key = (a_file, b_file)
    if key not in _LOADED:
        _LOADED[key] = _Aligner(byte_level_ids(tokenizer_file(a_file)), piece_ids(tokenizer_file(b_file)))
    return _LOADED[key]


def text_pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """A space and the text, in pieces that each begin with a space."""
    text = " " + text
    out, lo = [], 0
    while len(text) - lo > size:
        cut = None
        for cut in _CUT.finditer(text, lo + 1, lo + size):
            pass
        cut = cut or _CUT.search(text, lo + size)
        if cut is None:
            break
        out.append(text[lo : cut.start()])
        lo = cut.start()
    return [*out, text[lo:]]


def coalesced(a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For tokens of these many bytes, in order: the group of each A and each B token; the links as two index arrays."""
    a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
    a_start, b_start = a_end - a_size, b_end - b_size
    start, end = np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end])
    side = np.repeat([0, 1], [len(a_size), len(b_size)])
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order])
    breaks = np.ones(len(order), bool)
    breaks[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks) - 1
    first = np.searchsorted(b_end, a_start, side="right")
    n = np.searchsorted(b_start, a_end, side="left") - first
    from_a = np.repeat(np.arange(len(a_size)), n)
    from_b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[from_a]
    return group[: len(a_size)], group[len(a_size) :], from_a, from_b


class _Text:
    """What is known of one text so far."""

    def __init__(self):
        self.same, self.counts, self.digest, self.pairs = True, np.zeros(4, np.int64), hashlib.sha256(), []


def _in_turn(ids: list[np.ndarray]) -> Ids:
    return np.concatenate(ids).astype(np.int64), np.cumsum([0, *map(len, ids)])


class _Units:
    """Stretches of text with whole groups, aligned: what is said of each one's groups, MEASURES, and all its links."""

    def __init__(self):
        self.said: list[bytes] = []
        self.counts, self.links, self.at = np.zeros((0, 4), np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)

    def add(self, a_ids: Ids, b_ids: Ids, a: SegmentIds, b: SegmentIds, ends: list[bytes]) -> None:
        """Align units by their ids, all in turn, and where each unit's start; none is empty."""
        (a_flat, a_at), (b_flat, b_at) = a_ids, b_ids
        a_group, b_group, from_a, from_b = coalesced(a.sizes[a_flat], b.sizes[b_flat])
        groups = int(a_group[-1]) + 1
        a_before, b_before = (np.concatenate(([0], np.cumsum(np.bincount(x, minlength=groups)))) for x in (a_group, b_group))

        # The groups' ids in turn, each with the sign that follows it.
        code = np.empty(len(a_flat) + len(b_flat), np.int64)
        a_place = np.arange(len(a_flat)) + b_before[a_group]
        b_place = np.arange(len(b_flat)) + a_before[b_group + 1]
        code[a_place], code[b_place] = 3 * a_flat, 3 * b_flat
        code[a_place[a_before[1:] - 1]] += 1
        code[b_place[b_before[1:] - 1]] += 2
        said, at = list(map(ends.__getitem__, code.tolist())), (a_at + b_at).tolist()
        self.said += [b"".join(said[lo:hi])[:-1] for lo, hi in zip(at[:-1], at[1:])]

        links_at = np.searchsorted(from_a, a_at)
        group_at = np.append(a_group[a_at[:-1]], groups)
        self.counts = np.concatenate([self.counts, np.diff([a_at, b_at, group_at, links_at]).T])
        self.links = np.concatenate([self.links, a_flat[from_a] * len(b.raw) + b_flat[from_b]])
        self.at = np.concatenate([self.at, self.at[-1] + links_at[1:]])

    def and_(self, others: _Units) -> _Units:
        """These units, and the others after them."""
        both = _Units()
        both.said = self.said + others.said
        both.counts = np.concatenate([self.counts, others.counts])
        both.links = np.concatenate([self.links, others.links])
        both.at = np.concatenate([self.at, self.at[-1] + others.at[1:]])
        return both


class _Aligner:
    """Two tokenizers with the stretches that are remembered, each aligned once."""

    def __init__(self, a: SegmentIds, b: SegmentIds):
        self.a, self.b, self.cut = a, b, shared_cut(a, b)
        signs = (b",", b"|", b";")
        self.ends = [str(i).encode() + s for i in range(max(len(a.raw), len(b.raw))) for s in signs]
        self._forget()

    def _forget(self) -> None:
        self.units, self.number, self.chars = _Units(), {}, 0

    def _learn(self, stretches: list[str]) -> None:
        """Align stretches and number them; those whose bytes a tokenizer doesn't give back have the number -1."""
        ids = [self.a.of_stretches(stretches), self.b.of_stretches(stretches)]
        good = np.all([np.diff(at) > 0 for _, at in ids], axis=0)
        if not good.all():
            self.number.update((s, -1) for s, g in zip(stretches, good) if not g)
            stretches = [s for s, g in zip(stretches, good) if g]
            ids = [gathered(flat, at, np.flatnonzero(good)) for flat, at in ids]
        self.number.update(zip(stretches, range(len(self.units.said), len(self.units.said) + len(stretches))))
        self.chars += sum(map(len, stretches))
        if stretches:
            self.units.add(*ids, self.a, self.b, self.ends)

    def add(self, texts: list[_Text], pieces: list[tuple[int, str]]) -> None:
        """Add the pieces (text, its piece) to what is known of their texts."""
        if len(self.number) > MEMORY_SEGMENTS or self.chars > MEMORY_CHARS:
            self._forget()
        cuts = [self.cut(p) for _, p in pieces]
        number = self.number
        new = list({s for c in cuts if c is not None for s in c if s not in number})
        if new:
            self._learn(new)
        picks = [None if c is None else list(map(number.__getitem__, c)) for c in cuts]

        # Pieces that aren't cut are a unit each.
        units = self.units
        whole = [k for k, p in enumerate(picks) if p is None or -1 in p]
        if whole:
            plain = [pieces[k][1] for k in whole]
            found = list(zip(whole, self.a.of(plain), self.b.of(plain)))
            same = [(k, a_ids, b_ids) for k, (a_ids, a_same), (b_ids, b_same) in found if a_same and b_same]
            for k in whole:
                picks[k] = None
            for j, (k, _, _) in enumerate(same):
                picks[k] = [len(units.said) + j]
            if same:
                others = _Units()
                others.add(_in_turn([x for _, x, _ in same]), _in_turn([x for _, _, x in same]), self.a, self.b, self.ends)
                units = units.and_(others)
        for (i, _), own in zip(pieces, picks):
            if own is None:
                texts[i].same = False
        good = [k for k, own in enumerate(picks) if own is not None]
        if not good:
            return

        at = np.cumsum([0, *(len(picks[k]) for k in good)])
        flat = np.fromiter(chain.from_iterable(picks[k] for k in good), np.int64, at[-1])
        counts = np.add.reduceat(units.counts[flat], at[:-1])
        links, links_at = gathered(units.links, units.at, flat)
        wide = len(self.b.raw)
        most = len(self.a.raw) * wide
        linked = np.sort(np.repeat(np.arange(len(good)) * most, np.diff(links_at[at])) + links)
        first = np.flatnonzero(np.concatenate(([True], linked[1:] != linked[:-1])))
        times = np.diff(np.append(first, len(linked)))
        piece, pair = np.divmod(linked[first], most)
        pair = (pair // wide << 32) | pair % wide
        held = np.searchsorted(piece, np.arange(len(good) + 1))
        for j, k in enumerate(good):
            text = texts[pieces[k][0]]
            said = b";".join(map(units.said.__getitem__, picks[k]))
            text.digest.update(b";" + said if text.counts[0] else said)
            text.counts += counts[j]
            text.pairs.append((pair[held[j] : held[j + 1]], times[held[j] : held[j + 1]]))


def _numbers(values: np.ndarray) -> bytes:
    """32-bit numbers, their lowest bytes first of all, compressed."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def align_texts(texts: list[str], copies: list[int], a_file: str, b_file: str) -> tuple[list[tuple], dict]:
    """For different texts with their numbers of copies: each one's MEASURES and digest, and the strip's PAIRS."""
    aligner = _loaded(a_file, b_file)
    known = [_Text() for _ in texts]
    waiting: list[tuple[int, str]] = []
    size = 0
    for i, text in enumerate(texts):
        if not text:
            known[i].same = False
            continue
        for piece in text_pieces(text):
            waiting.append((i, piece))
            size += len(piece)
            if size >= BATCH_CHARS:
                aligner.add(known, waiting)
                waiting, size = [], 0
    if waiting:
        aligner.add(known, waiting)

    rows, members, parts = [], [], []
    for i, text in enumerate(known):
        if not text.same:
            rows.append((0, 0, 0, 0, ""))
            continue
        rows.append((*text.counts.tolist(), text.digest.hexdigest()))
        pair, times = text.pairs[0]
        if len(text.pairs) > 1:
            pair, inverse = np.unique(np.concatenate([p for p, _ in text.pairs]), return_inverse=True)
            times = np.bincount(inverse, np.concatenate([t for _, t in text.pairs])).astype(np.int64)
        members.append(i)
        parts.append((pair, times))
    if not parts:
        return rows, {"pairs": [], "docs": [], "members": [], "sizes": [], "which": b"", "times": b""}
    sizes = [len(p) for p, _ in parts]
    every = pa.array(np.concatenate([p for p, _ in parts])).dictionary_encode()
    which = every.indices.to_numpy()
    weight = np.repeat(np.array(copies, np.int64)[members], sizes)
    return rows, {
        "pairs": every.dictionary.to_numpy(),
        "docs": np.bincount(which, weight).astype(np.int64),
        "members": members,
        "sizes": sizes,
        "which": _numbers(which),
        "times": _numbers(np.concatenate([t for _, t in parts])),
    }


def _strips(rows: DataFrame, a_file: str, b_file: str, strip_bytes: int) -> DataFrame:
    """Rows (row, strip, member, MEASURES, groups_sha256) of the documents and rows (strip, found) of the strips."""
    schema = T.StructType(
        [
            T.StructField("row", rows.schema["row"].dataType),
            T.StructField("strip", T.LongType()),
            T.StructField("member", T.IntegerType()),
            *[T.StructField(c, T.LongType()) for c in MEASURES],
            T.StructField("groups_sha256", T.StringType()),
            T.StructField("found", T.StructType.fromDDL(PAIRS)),
        ]
    )
    found = pa.struct(
        [
            ("pairs", pa.list_(pa.int64())),
            ("docs", pa.list_(pa.int64())),
            ("members", pa.list_(pa.int32())),
            ("sizes", pa.list_(pa.int32())),
            ("which", pa.binary()),
            ("times", pa.binary()),
        ]
    )
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * len(MEASURES), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strip = TaskContext.get().partitionId() << 32

        def done(parts: list[pa.Array], texts: list[str]) -> Iterator[pa.RecordBatch]:
            numbers: dict[str, int] = {}
            own = [numbers.setdefault(t, len(numbers)) for t in texts]
            copies = np.bincount(own).tolist()
            measured, pairs = align_texts(list(numbers), copies, a_file, b_file)
            columns = [[strip] * len(own), own, *zip(*(measured[i] for i in own))]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            rows = pa.concat_arrays(parts)
            yield pa.RecordBatch.from_arrays([rows, *arrays, pa.nulls(len(own), found)], names=schema.names)
            lists = [pa.ListArray.from_arrays([0, len(pairs[c])], pa.array(pairs[c], t)) for c, t in LISTS]
            one = pa.StructArray.from_arrays([*lists, *(pa.array([pairs[c]], pa.binary()) for c in ("which", "times"))], fields=list(found))
            nulls = [pa.nulls(1, t) for t in (rows.type, *kinds)]
            nulls[1] = pa.array([strip])
            yield pa.RecordBatch.from_arrays([*nulls, one], names=schema.names)

        parts, texts, size = [], [], 0
        for batch in batches:
            column = batch.column(1)
            lo = 0
            for i, text in enumerate(column):
                text = text.as_py() or ""
                texts.append(text)
                size += len(text)
                if size >= strip_bytes:
                    yield from done([*parts, batch.column(0).slice(lo, i + 1 - lo)], texts)
                    parts, texts, size, lo = [], [], 0, i + 1
                    strip += 1
            if lo < len(column):
                parts.append(batch.column(0).slice(lo))
        if texts:
            yield from done(parts, texts)

    LISTS = (("pairs", pa.int64()), ("docs", pa.int64()), ("members", pa.int32()), ("sizes", pa.int32()))
    return rows.mapInArrow(run, schema)


def _weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (strip, found, known: at, n, best of each pair) to rows (strip, member, n_best, count_sum)."""
    for batch in batches:
        for row in range(batch.num_rows):
            found, known = batch.column("found")[row], batch.column("known")[row].values
            sizes, members = found["sizes"].values.to_numpy(), found["members"].values
            total = int(sizes.sum())
            n = np.zeros(len(found["pairs"]), np.int64)
            best = np.zeros(len(n), bool)
            at = known.field("at").to_numpy()
            n[at] = known.field("n").to_numpy()
            best[at] = known.field("best").to_numpy(zero_copy_only=False)
            which, times = (_unpacked(found[c].as_py(), total) for c in ("which", "times"))
            times = times.astype(np.int64)
            starts = np.cumsum(sizes) - sizes
            sums = [np.add.reduceat(x, starts) for x in (times * best[which], times * n[which])]
            columns = [pa.array([batch.column("strip")[row].as_py()] * len(members), pa.int64()), members]
            yield pa.RecordBatch.from_arrays(
                [*columns, *(pa.array(s, pa.int64()) for s in sums)], names=["strip", "member", "n_best", "count_sum"]
            )


def linked_pairs(strips: DataFrame) -> DataFrame:
    """Rows (pair, a, b, n, best): the id pairs of all strips, in how many documents each is linked, and whether no
    other pair of its A id is in more."""
    each = strips.where("found IS NOT NULL").select(F.explode(F.arrays_zip("found.pairs", "found.docs")).alias("p"))
    counts = each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.docs").alias("n"))
    a, b = F.shiftright("pair", 32), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    # An A id has at most as many pairs as B has ids.
    top = F.max("n").over(Window.partitionBy("a"))
    return counts.select("pair", a.alias("a"), b.alias("b"), "n").withColumn("best", F.col("n") == top)


def align(
    docs: DataFrame,
    a_file: str = "byte_bpe_50k.json",
    b_file: str = "piece_bpe_32k.model",
    text_col: str = "text",
    keep_text: bool = True,
    strip_bytes: int = STRIP_BYTES,
) -> DataFrame:
    """All rows and columns of ``docs`` with NEW (columns of these names are replaced); the text goes if not ``keep_text``.

    A is a byte-level file and gets a space and the text, B a sentence-piece model that puts the space in front itself.
    n_groups and n_links are as above; groups_sha256 is the digest of all groups (``a1,a2|b1;a3|b2,b3``). A pair's count
    is the number of rows whose text links it; n_best are the links whose count no other pair of their A id exceeds,
    count_sum is the sum over all links. Null and empty texts, and texts that a tokenizer's bytes don't give back, have
    no tokens: zeros and an empty digest. Repeated rows stay and count each; an empty table gives an empty table.
    """
    at = shared_dir(docs.sparkSession)
    kept = [c for c in docs.columns if c not in NEW and (keep_text or c != text_col)]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    strips = written(_strips(rows, a_file, b_file, strip_bytes), at + "/strips")
    counts = written(linked_pairs(strips), at + "/counts")
    found = strips.where("found IS NOT NULL").select("strip", "found").where(F.size("found.pairs") > 0)
    each = found.select("strip", F.posexplode("found.pairs").alias("at", "pair")).join(counts.select("pair", "n", "best"), "pair")
    known = each.groupBy("strip").agg(F.collect_list(F.struct("at", "n", "best")).alias("known"))
    weighed = found.join(known, "strip").mapInArrow(_weighed, "strip long, member int, n_best long, count_sum long")
    joined = strips.where("found IS NULL").drop("found").join(weighed, ["strip", "member"], "left")
    return joined.select(
        *[F.col("row").getField(c).alias(c) for c in kept],
        *MEASURES,
        "groups_sha256",
        F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"),
    )
