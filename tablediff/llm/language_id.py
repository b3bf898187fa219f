"""Language identification by prediction by partial matching (PPM, escape method C) over bytes.

Training counts, per language, every byte with the three bytes before it, over all labelled documents: runs of four bytes
are counted inside the tasks, then summed by key. All of them become the language's context tree; the counts of shorter
contexts follow from them. The statistics are then frozen.

Under a language, a byte costs -log2 n / (t + d) bits if it was seen n times after its three-byte context (t: how often
the context was seen, d: by how many different bytes it was followed), else the escape's -log2 d / (t + d) bits and what
it costs after the next shorter context; bytes never seen cost 8 bits at the end. A text gets the language with the
shortest code.

The statistics are tables and grow with the training documents; ``identify`` never holds them in one place. The texts are
dealt into strips of about SCORED bytes. Code lengths are worked out for the distinct runs of all strips, order by order,
by joins; each strip then meets the lengths of its own runs. ``learn`` and ``predict`` do the same with one model in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablediff.llm.common import shared_dir, whole_text, written

ORDER = 3
UNKNOWN = "und"
# Bytes worked on at once in a task.
STRIP = 2 << 20
# Bytes of texts that are scored together.
SCORED = 8 << 20
# Languages whose code lengths are summed up at once, and rows whose lengths are worked out at once.
LANGUAGES, ROWS = 16, 1024
# In front of each text.
START = b"\n" * ORDER


def _codes(raw: np.ndarray) -> np.ndarray:
    """Each four bytes in a row as one number."""
    wide = raw.astype(np.uint32)
    return wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]


def _strips(texts: pa.Array, most: int = STRIP) -> Iterator[list[tuple[int, bytes]]]:
    """(row, bytes) in lists of about ``most`` bytes; a long text is cut, each part with its context in front."""
    held, size = [], 0
    for i, t in enumerate(texts):
        raw = t.as_buffer().to_pybytes() if t.is_valid else b""
        for lo in range(0, len(raw), most):
            part = (START if lo == 0 else raw[lo - ORDER : lo]) + raw[lo : lo + most]
            held.append((i, part))
            size += len(part)
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def run_counts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """Rows (lang, run, n): how often each four bytes in a row occur in the texts of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for strip in _strips(batch.column(1)):
                for lang in sorted({langs[i] for i, _ in strip}):
                    parts = [p for i, p in strip if langs[i] == lang]
                    codes = _codes(np.frombuffer(b"".join(parts), np.uint8))
                    ends = np.cumsum([len(p) for p in parts])[:-1]
                    across = (ends[:, None] - np.arange(1, ORDER + 1)[None, :]).ravel()  # runs over two texts
                    codes = np.sort(np.delete(codes, across))
                    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
                    n = np.diff(np.append(first, len(codes)))
                    arrays = [pa.array([lang] * len(first)), pa.array(codes[first].astype(np.int64)), pa.array(n)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["lang", "run", "n"])

    rows = docs.where(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), whole_text(text_col).cast("binary").alias("raw")
    )
    counted = rows.mapInArrow(run, "lang string, run long, n long")
    return counted.groupBy("lang", "run").agg(F.sum("n").alias("n"))


class Places:
    """Where each of some distinct runs stands, by open addressing: slot of the run's product hash -> its place; -1: free."""

    def __init__(self, known: np.ndarray):
        self.known = known
        self.bits = max(12, int(np.ceil(np.log2(len(known) * 8 + 1))))
        self.slots = np.full(1 << self.bits, -1, np.int32)
        rows, slot = np.arange(len(known)), self._slot(known)
        while len(rows):
            free = np.flatnonzero(self.slots[slot] < 0)
            self.slots[slot[free]] = rows[free]
            left = np.flatnonzero(self.slots[slot] != rows)
            rows, slot = rows[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint32(2654435761)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def of(self, codes: np.ndarray) -> np.ndarray:
        """The place of each run, -1 for others."""
        slot = self._slot(codes)
        row = self.slots[slot]
        wrong = np.flatnonzero(self.known[row] != codes)  # free slots too: they show the last known run
        wrong = wrong[row[wrong] >= 0]
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & ((1 << self.bits) - 1)
            row[wrong] = self.slots[slot[wrong]]
            wrong = wrong[(row[wrong] >= 0) & (self.known[row[wrong]] != codes[wrong])]
        return row


class ContextTrees:
    """The frozen statistics of all languages, and the code lengths that follow from them."""

    def __init__(self, runs: dict[str, tuple[np.ndarray, np.ndarray]]):
        """``runs``: language -> (runs of four bytes in rising order, their counts)."""
        self.languages = sorted(runs)
        self.levels = []  # per language, from the longest context: (runs, log n, contexts, log d, log (t + d))
        for lang in self.languages:
            codes, n = runs[lang]
            codes, own = codes.astype(np.int64), []
            for order in range(ORDER, -1, -1):
                if order < ORDER:
                    codes, at = np.unique(codes & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
                    n = np.bincount(at, weights=n)
                contexts, at = np.unique(codes >> 8, return_inverse=True)
                total, kinds = np.bincount(at, weights=n), np.bincount(at)
                own.append((codes, np.log2(n), contexts, np.log2(kinds), np.log2(total + kinds)))
            self.levels.append(own)
        self.known = np.unique(np.concatenate([runs[x][0] for x in self.languages])).astype(np.uint32)
        self.table = self._lengths(self.known)
        self.place = Places(self.known)

    def _lengths(self, codes: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each run under each language."""
        out = np.zeros((len(codes), len(self.languages)))
        for k, levels in enumerate(self.levels):
            left, wide = np.arange(len(codes)), codes.astype(np.int64)
            for order, (runs, log_n, contexts, log_d, log_td) in zip(range(ORDER, -1, -1), levels, strict=True):
                own = wide[left] & ((1 << 8 * (order + 1)) - 1)
                c = np.minimum(np.searchsorted(contexts, own >> 8), len(contexts) - 1)
                met = contexts[c] == own >> 8
                r = np.minimum(np.searchsorted(runs, own), len(runs) - 1)
                seen = runs[r] == own
                out[left, k] += np.where(met, log_td[c] - np.where(seen, log_n[r], log_d[c]), 0)
                left = left[~seen]
            out[left, k] += 8
        return out.astype(np.float32)

    def lengths(self, codes: np.ndarray) -> np.ndarray:
        row = self.place.of(codes)
        out = self.table[row]
        new = np.flatnonzero(row < 0)
        if len(new):
            kinds, at = np.unique(codes[new], return_inverse=True)
            out[new] = self._lengths(kinds)[at]
        return out

    def text_lengths(self, texts: pa.Array) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(texts), len(self.languages)))
        for strip in _strips(texts):
            codes = [_codes(np.frombuffer(p, np.uint8)) for _, p in strip]
            bits = self.lengths(np.concatenate(codes))
            starts = np.cumsum([0, *map(len, codes)])[:-1]
            np.add.at(out, [i for i, _ in strip], np.add.reduceat(bits, starts, axis=0, dtype=np.float64))
        return out


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_runs: int | None = None) -> ContextTrees | None:
    """The context trees of all languages in ``docs``, in the driver; None if no row has a language and a text.

    Every run counts, unless the caller sets a limit: then the most frequent ones, shared out evenly among the languages.
    """
    rows = run_counts(docs, lang_col, text_col)
    if max_runs is not None:
        languages = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string")).distinct().count()
        often = Window.partitionBy("lang").orderBy(F.desc("n"), "run")
        rows = rows.withColumn("k", F.row_number().over(often)).where(F.col("k") <= max(1, max_runs // max(1, languages)))
    rows = rows.select("lang", "run", "n").orderBy("lang", "run").toPandas()
    if not len(rows):
        return None
    return ContextTrees({k: (g["run"].to_numpy(), g["n"].to_numpy(float)) for k, g in rows.groupby("lang")})


NEW = ("lang_pred", "score")


def _lettered(text_col: str) -> Column:
    """The text, or nothing if it has no letter."""
    text = whole_text(text_col)
    return F.when(text.rlike(r"\p{L}"), text).otherwise("")


def _verdicts(bits: np.ndarray, labels: pa.Array) -> list[pa.Array]:
    """lang_pred and score of texts by their bits under each language."""
    share = 1 / np.exp2(np.maximum(bits.min(1)[:, None] - bits, -1000)).sum(1)
    return [labels.take(pa.array(bits.argmin(1))), pa.array(share)]


def _unknown(scored: DataFrame, text_col: str) -> DataFrame:
    lettered = whole_text(text_col).rlike(r"\p{L}")
    return scored.withColumns(
        {
            "lang_pred": F.when(lettered, F.col("lang_pred")).otherwise(UNKNOWN),
            "score": F.when(lettered, F.col("score")).otherwise(0.0),
        }
    )


def predict(docs: DataFrame, trees: ContextTrees | None, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with lang_pred and score (columns of these names are replaced).

    score is the language's share of the summed probabilities of the text. Null texts and texts without a letter are
    ``und`` with score 0, as are all texts if nothing was learned. Of equally short codes the smaller name wins.
    """
    kept = docs.select([c for c in docs.columns if c not in NEW])
    if trees is None:
        return kept.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    schema = T.StructType(
        [*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        labels = pa.array(model.languages)
        for batch in batches:
            bits = model.text_lengths(batch.column(batch.num_columns - 1).cast(pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *_verdicts(bits, labels)], names=names)

    return _unknown(kept.withColumn("__scored", _lettered(text_col)).mapInArrow(run, schema), text_col)


def _dealt(docs: DataFrame, text_col: str) -> DataFrame:
    """Rows (strip, rows, runs): ``docs`` in strips of about SCORED bytes of text or one text, packed, with their distinct runs.

    The packed rows are the columns of ``docs`` and __lettered, whether the text has a letter and so is scored.
    """
    lettered = docs.withColumn("__lettered", whole_text(text_col).rlike(r"\p{L}"))
    text_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strip = TaskContext.get().partitionId() << 32
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(text_at).cast(pa.binary())), 0).to_numpy().astype(np.int64)
            part = (np.cumsum(size) - size) // SCORED
            for one in np.unique(part):
                lo, hi = np.searchsorted(part, [one, one + 1])
                packed, met = batch.take(pa.array(np.arange(lo, hi))), np.empty(0, np.uint32)  # a copy: texts of a slice come out wrong
                for parts in _strips(_scored(packed, text_at)):
                    met = np.unique(np.concatenate([met, *(_codes(np.frombuffer(p, np.uint8)) for _, p in parts)]))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, packed.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(packed)
                runs = pa.ListArray.from_arrays(np.array([0, len(met)], np.int32), met.astype(np.int64))
                raw = pa.array([sink.getvalue().to_pybytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([strip]), raw, runs], names=["strip", "rows", "runs"])
                strip += 1

    return lettered.mapInArrow(run, "strip long, rows binary, runs array<long>")


def _scored(rows: pa.RecordBatch | pa.Table, text_at: int) -> pa.Array:
    """The texts of packed rows as bytes, null where they have no letter."""
    raw, none = rows.column(text_at).cast(pa.binary()), pa.scalar(None, pa.binary())
    return pc.if_else(rows.column(rows.num_columns - 1), raw, none)


def _lists(column: pa.Array, *fields: str) -> list[np.ndarray]:
    """Of a column of lists of structs: each element's row, and the named fields."""
    rows = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy())
    return [rows, *(column.flatten().field(f).to_numpy() for f in fields)]


def _run_lengths(counts: DataFrame, needed: DataFrame, languages: int, at: str) -> DataFrame:
    """Rows (run, bits): the code length of the last byte of each run in ``needed`` under each language.

    ``counts`` has rows (k, run, n), k being the language's number. Runs are shortened byte by byte to the orders below;
    from the lowest order up, a run takes its count, its context's counts and the bits of the next shorter run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, max(1, ROWS * LANGUAGES // languages)):
                batch = whole.slice(lo, max(1, ROWS * LANGUAGES // languages))
                bits = batch.column(3).flatten().to_numpy().reshape(-1, languages).copy()
                row, k, kinds, total = _lists(batch.column(2), "k", "kinds", "total")
                spent = np.zeros_like(bits)
                spent[row, k] = np.log2(total + kinds)
                bits[row, k] += spent[row, k] - np.log2(kinds)
                row, k, n = _lists(batch.column(1), "k", "n")
                bits[row, k] = spent[row, k] - np.log2(n)
                out = pa.ListArray.from_arrays(np.arange(len(bits) + 1, dtype=np.int32) * languages, bits.ravel())
                yield pa.RecordBatch.from_arrays([batch.column(0), out], names=["run", "bits"])

    levels, wanted = [], []
    for order in range(ORDER, -1, -1):
        short = F.col("run").bitwiseAND((1 << 8 * (order + 1)) - 1)
        if order < ORDER:
            counts = written(counts.groupBy("k", short.alias("run")).agg(F.sum("n").alias("n")), f"{at}/counts{order}")
            needed = written(needed.select(short.alias("run")).distinct(), f"{at}/needed{order}")
        levels.append(counts)
        wanted.append(needed)
    bits = None
    for order in range(ORDER + 1):
        counts, needed = levels[ORDER - order], wanted[ORDER - order]
        context = F.shiftright("run", 8).alias("context")
        seen = counts.groupBy("run").agg(F.collect_list(F.struct("k", "n")).alias("seen"))
        after = counts.groupBy("k", context).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        after = after.groupBy("context").agg(F.collect_list(F.struct("k", "total", "kinds")).alias("after"))
        rows = needed.select("run", context, F.col("run").bitwiseAND((1 << 8 * order) - 1).alias("shorter"))
        rows = rows.join(seen, "run", "left").join(after, "context", "left")
        if bits is None:
            rows = rows.withColumn("bits", F.array_repeat(F.lit(8.0), languages))
        else:
            rows = rows.join(bits.withColumnRenamed("run", "shorter"), "shorter")
        filled = [F.coalesce(c, F.array().cast(rows.schema[c].dataType)).alias(c) for c in ("seen", "after")]
        bits = written(rows.select("run", *filled, "bits").mapInArrow(run, "run long, bits array<double>"), f"{at}/bits{order}")
    return bits


def identify(docs: DataFrame, training: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``predict`` of ``docs`` under all that ``training`` has in each language, without a model in one place."""
    kept = docs.select([c for c in docs.columns if c not in NEW])
    kept = kept.withColumn(text_col, F.col(f"`{text_col}`").cast("string"))
    at = shared_dir(docs.sparkSession)
    counts = written(run_counts(training, lang_col, text_col), at + "/counts")
    languages = [r["lang"] for r in counts.select("lang").distinct().sort("lang").collect()]
    if not languages:
        return predict(kept, None, text_col)
    names = docs.sparkSession.createDataFrame(list(zip(languages, range(len(languages)), strict=True)), "lang string, k int")
    dealt = written(_dealt(kept, text_col), at + "/dealt", buckets_by="strip")
    runs = dealt.select("strip", F.explode("runs").alias("run"))
    needed = written(runs.select("run").distinct(), at + "/needed")
    counts = counts.join(F.broadcast(names), "lang").select("k", "run", "n")
    bits = _run_lengths(counts, needed, len(languages), at)
    lengths = runs.join(bits, "run").select(F.col("strip").alias("of_strip"), "run", F.col("bits").cast("array<float>").alias("bits"))
    schema = T.StructType(
        [*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )
    text_at, columns = kept.columns.index(text_col), [*kept.columns, *NEW]

    def score(strip: pa.Table, lengths: pa.Table) -> pa.Table:
        known = lengths.column("run").to_numpy().astype(np.uint32)
        table = lengths.column("bits").combine_chunks().flatten().to_numpy().reshape(len(known), len(languages))
        rows = pa.ipc.open_stream(strip.column("rows")[0].as_buffer()).read_all().combine_chunks()
        out = np.zeros((rows.num_rows, len(languages)))
        place = Places(known) if len(known) else None
        for parts in _strips(_scored(rows, text_at)):
            codes = [_codes(np.frombuffer(p, np.uint8)) for _, p in parts]
            row = place.of(np.concatenate(codes))
            starts = np.cumsum([0, *map(len, codes)])[:-1]
            for lo in range(0, len(languages), LANGUAGES):
                some = np.add.reduceat(table[:, lo : lo + LANGUAGES][row], starts, axis=0, dtype=np.float64)
                np.add.at(out[:, lo : lo + LANGUAGES], [i for i, _ in parts], some)
        return pa.Table.from_arrays([*rows.columns[:-1], *_verdicts(out, pa.array(languages))], names=columns)

    strips = dealt.select(F.col("strip").alias("own"), "rows")
    scored = strips.groupBy("own").cogroup(lengths.groupBy("of_strip")).applyInArrow(score, schema)
    return _unknown(scored, text_col)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from training: the CRC-32 of its id as text is divisible by 5 (a null id counts so)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))
