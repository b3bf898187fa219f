"""Best-fit packing of tokenised documents into sequences of a fixed length, planned on a length histogram.

1. Every document is tokenised once and cut into pieces of at most ``capacity`` tokens; a table of pieces without texts
   is written to the shared folder.
2. The driver gets one row per length (``capacity`` rows at most) and plans best-fit decreasing on counts: sequences
   with the same room left are one entry, so the plan has a few rows per length, whatever the number of pieces.
3. Each piece takes the slot of its rank among the pieces of its length. The rank comes from counts per
   (length, bucket of the document's hash) and the row's number within that pair, so that no task holds a whole length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablediff.llm.chunk_ids import batch_ids
from tablediff.llm.common import shared_dir, shuffle_buckets, whole_text, written

CAPACITY = 2048
END_ID = 0
# Texts of about this many bytes are tokenised at once.
BATCH_BYTES = 12 << 20

PLAN_SCHEMA = "length long, first_rank long, n long, first_sequence long, per_sequence long, offset long"


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """``texts`` in runs of about BATCH_BYTES."""
    ends = np.cumsum(np.array([len(t.as_buffer() or b"") if t.is_valid else 0 for t in texts.cast(pa.large_binary())]))
    lo = 0
    while lo < len(texts):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + BATCH_BYTES, side="right")))
        yield texts.slice(lo, hi - lo)
        lo = hi


def pieces_of(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """One row per piece: the id column, piece, start, length, ids_crc32.

    A document is its ids and then the end id 0, so a null or empty text is one piece of length 1. Repeated rows give
    repeated pieces. Null ids stay null.
    """
    id_type = docs.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField(id_col, id_type), T.StructField("piece", T.IntegerType())]
        + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = batch_ids(tokenizer_path)
        for batch in batches:
            done = 0
            for texts in _slices(batch.column(1)):
                ids, at = encode.of(texts)
                row, piece, start, length, crc = [], [], [], [], []
                for i in range(len(texts)):
                    own = np.append(ids[at[i] : at[i + 1]], np.uint32(END_ID)).astype("<u4")
                    for k, lo in enumerate(range(0, len(own), capacity)):
                        part = own[lo : lo + capacity]
                        row.append(done + i)
                        piece.append(k)
                        start.append(lo)
                        length.append(len(part))
                        crc.append(zlib.crc32(part))
                done += len(texts)
                own_ids = batch.column(0).take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [own_ids, pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    names=schema.names,
                )

    return docs.select(F.col(id_col), whole_text(text_col).alias("text")).mapInArrow(run, schema)


def plan_slots(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing on counts: rows (length, first_rank, n, first_sequence, per_sequence, offset).

    The pieces of ``length`` with ranks from first_rank to first_rank + n - 1 fill the sequences from first_sequence
    on, ``per_sequence`` of them side by side from ``offset``. Longest first, each piece goes where the least room is
    left. Sequences with the same room left are kept as runs of sequence numbers.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}  # room left -> runs (first sequence, how many)
    plan, sequences = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = min((r for r in rooms if r >= length), default=None)
            if room is None:
                room = capacity
                rooms[room] = [(sequences, -(-left // (capacity // length)))]
                sequences += rooms[room][0][1]
            first, n = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
            per = room // length
            full, rest = min(n, left // per), 0
            if full < n:
                rest = left - full * per
            for start, many, each in ((first, full, per), (first + full, int(rest > 0), rest)):
                if many:
                    plan.append((length, rank, many * each, start, each, capacity - room))
                    rank, left = rank + many * each, left - many * each
                    if room > each * length:
                        rooms.setdefault(room - each * length, []).append((start, many))
            used = full + (rest > 0)
            if used < n:
                rooms.setdefault(room, []).append((first + used, n - used))
    return plan


def pack(pieces: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset. ``pieces`` is read three times and should be a written table.

    Pieces of one length are interchangeable, so ties (repeated rows too) may take either's slot.
    """
    spark = pieces.sparkSession
    buckets = shuffle_buckets(spark)
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64(id_col, "piece"), F.lit(buckets)).cast("int"))
    counts = keyed.groupBy("length", "bucket").count()
    by_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    plan = spark.createDataFrame(plan_slots(by_length, capacity), PLAN_SCHEMA)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ranks_before")
    )
    within = Window.partitionBy("length", "bucket").orderBy(id_col, "piece")
    ranked = (
        keyed.withColumn("row", F.row_number().over(within))
        .join(offsets, ["length", "bucket"])
        .withColumn("rank", F.col("ranks_before") + F.col("row") - 1)
    )
    slot = F.broadcast(plan.withColumnRenamed("length", "slot_length"))  # a few rows per length
    return (
        ranked.join(
            slot,
            (F.col("length") == F.col("slot_length"))
            & (F.col("rank") >= F.col("first_rank"))
            & (F.col("rank") < F.col("first_rank") + F.col("n")),
        )
        .withColumn("at", F.col("rank") - F.col("first_rank"))
        .select(
            *pieces.columns,
            (F.col("first_sequence") + F.floor(F.col("at") / F.col("per_sequence"))).alias("sequence_id"),
            (F.col("offset") + F.pmod("at", "per_sequence") * F.col("length")).alias("offset"),
        )
    )


def best_fit_packing(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """Pieces of all documents with their sequence and place. Empty tables give an empty table."""
    spark = docs.sparkSession
    pieces = written(pieces_of(docs, tokenizer_path, id_col, text_col, capacity), shared_dir(spark) + "/pieces")
    return pack(pieces, id_col, capacity)
