"""Token counts of whole documents, huge ones by overlap resynchronisation.

A document that surely fits into ``chunk_bytes`` bytes of UTF-8 is encoded at once. A longer one is encoded in overlapping chunks with
offsets. Two neighbouring chunks are spliced after a token that both of them hold with the same id at the same place in
the overlap. Why that is exact for byte-pair merging: merges cross a token boundary only if they would also do so
between the two tokens beside it taken alone, so a sequence of tokens is the encoding of a text if each neighbouring
pair is the encoding of its own text. Left of the shared token every pair comes from the left chunk, from the shared
token on every pair comes from the right chunk. If no token is shared, the overlap is doubled until it takes in the
whole left chunk; if there is none even then, the document is encoded at once.

A token at a chunk's first character is never taken for shared, since the library puts a word mark in front of every
text it gets. Byte tokens are not taken either: several of them have the same place.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablediff.llm.common import whole_text

CHUNK_BYTES = 1 << 16
OVERLAP_BYTES = 1 << 9

_ENCODERS: dict[str, object] = {}


def encoder(model_path: str):
    """The library's encoder, loaded once in a Python worker."""
    if model_path not in _ENCODERS:
        import sentencepiece

        _ENCODERS[model_path] = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return _ENCODERS[model_path]


def _placed(enc, raw: bytes, start: int, stop: int) -> list[tuple[int, int, int]]:
    """(id, begin, end) of each token of ``raw[start:stop]``, places in bytes from the document's start."""
    pieces = enc.encode(raw[start:stop].decode(), return_type="proto").pieces
    return [(p.id, p.begin + start, p.end + start) for p in pieces]


def _whole_char(raw: bytes, at: int) -> int:
    """The first character boundary at or after ``at``."""
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return at


def chunked_ids(enc, text: str, chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> list[int]:
    """The ids of ``text``, spliced from overlapping chunks."""
    raw = text.encode()
    start, end = 0, _whole_char(raw, chunk)
    left = _placed(enc, raw, 0, end)  # from the last shared token on
    ids: list[int] = []  # before it
    while end < len(raw):
        wide = overlap
        while True:
            begin = max(start, _whole_char(raw, max(0, end - wide)))
            stop = _whole_char(raw, max(end + 1, begin + chunk))
            right = _placed(enc, raw, begin, stop)
            seen = {t: i for i, t in enumerate(left) if not enc.is_byte(t[0])}
            shared = ((seen[t], j) for j, t in enumerate(right) if begin < t[1] and t[2] < end and t in seen)
            at = next(shared, None)
            if at is not None:
                ids += [t[0] for t in left[: at[0]]]
                left, start, end = right[at[1] :], begin, stop
                break
            if begin == start:
                if ids:  # not even the last shared token is held again: no boundary is proven
                    return enc.encode(text)
                left, end = right, stop
                break
            wide *= 2
    return ids + [t[0] for t in left]


def count_tokens(
    docs: DataFrame,
    model_path: str,
    text_col: str = "text",
    limit: int = 4096,
    chunk_bytes: int = CHUNK_BYTES,
    overlap_bytes: int = OVERLAP_BYTES,
) -> DataFrame:
    """All rows and columns of ``docs`` with n_bytes, n_tokens and over_limit (columns of these names are replaced).

    Null and empty texts have 0 tokens. Repeated rows stay repeated rows. An empty table gives an empty table. The
    counts are those of the model's own library over the whole text, without begin, end or added special tokens.
    """
    new = ("n_bytes", "n_tokens", "over_limit")
    kept = docs.select([c for c in docs.columns if c not in new])
    schema = T.StructType([*kept.schema.fields, T.StructField("n_tokens", T.LongType())])
    arrow_names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            short = [i for i, t in enumerate(texts) if len(t) <= chunk_bytes // 4]
            counts = [0] * len(texts)
            for lo in range(0, len(short), 64):  # the ids of a few texts at a time
                part = short[lo : lo + 64]
                for i, ids in zip(part, enc.encode([texts[i] for i in part], num_threads=1), strict=True):
                    counts[i] = len(ids)
            for i, t in enumerate(texts):
                if len(t) > chunk_bytes // 4:
                    counts[i] = len(chunked_ids(enc, t, chunk_bytes, overlap_bytes))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], names=arrow_names)

    return (
        kept.mapInArrow(run, schema)
        .withColumn("n_bytes", F.octet_length(whole_text(text_col)).cast("long"))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
