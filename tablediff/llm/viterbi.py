"""SentencePiece encoding and decoding by a streaming Viterbi search.

The model file gives pieces and scores; a text's ids are those of the segmentation with the largest sum of scores (of
equal sums the one whose last piece is longer). A character that no piece covers costs more than any piece and becomes
its UTF-8 bytes.

The search keeps a window: best sums for as many places as the longest piece has characters, backpointers from the last
committed boundary on. When the paths back from all places of the window meet in one boundary, the ids up to it are
committed and the rest of the text can't change them. Some boundaries are known without looking: all paths meet between
two characters that stand side by side in no piece, as in front of a word mark after another character. The words between
them are no longer than a few windows; those of a batch of texts that are not remembered are searched side by side, one
place of all words after the other, with the pieces as a trie in numpy arrays. Everything else streams.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARK = "▁"
MEMORY_WORDS = 400_000
REMEMBERED_CHARS = 64
_CHAR_BITS = 21
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_LOADED: dict[str, Pieces] = {}
# Words with the spaces in front of them, lines' ends, and spaces that no word follows.
_WORDS = re.compile(r"\n| *[^ \n]+| +")


class Pieces:
    """A model's pieces: the search over them and the way back to texts."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.byte_ids = {int(names[i][1:-1], 16): i for i in range(size) if model.is_byte(i)}
        self.unknown_id = model.unk_id()
        self.score = {names[i]: (model.get_score(i), i) for i in plain if not model.is_unused(i)}
        self.unknown_score = min(s for s, _ in self.score.values()) - 10.0
        self.longest = max(map(len, self.score))
        # Every beginning of a piece; empty if it is no piece itself.
        self.begins = {p[:n]: () for p in self.score for n in range(1, len(p))} | self.score
        self.pairs = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self.marks_lead = not any(p[1] == MARK != p[0] for p in self.pairs)
        self.newline_alone = not any("\n" in p for p in self.pairs)
        self.raw = [b""] * size
        for i in plain:
            self.raw[i] = names[i].replace(MARK, " ").encode()
        for b, i in self.byte_ids.items():
            self.raw[i] = bytes([b])
        self.size_of = np.array([len(r) for r in self.raw], np.int64)
        self.raw_at = np.concatenate(([0], np.cumsum(self.size_of)))
        self.raw_flat = np.frombuffer(b"".join(self.raw), np.uint8)
        self.by_word = self.marks_lead and self.newline_alone
        self.memory: dict[str, bytes] = {}
        self._make_trie()

    def _make_trie(self) -> None:
        """Beginnings of pieces as numbered states (0: nothing yet); steps from one to the next in a hash table."""
        state = {begin: k for k, begin in enumerate(["", *self.begins])}
        self.piece_of = np.full(len(state), -1, np.int64)
        self.score_of = np.zeros(len(state))
        for piece, (score, i) in self.score.items():
            self.piece_of[state[piece]], self.score_of[state[piece]] = i, score
        bits = (3 * len(state)).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.step_key = np.full(1 << bits, -1, np.int64)
        self.step_to = np.full(1 << bits, -1, np.int64)
        keys = np.array([state[b[:-1]] << _CHAR_BITS | ord(b[-1]) for b in self.begins], np.int64)
        targets = np.array([state[b] for b in self.begins], np.int64)
        slots = ((keys.view(np.uint64) * _SPREAD) >> self.shift).astype(np.int64)
        while len(keys):
            _, first = np.unique(slots, return_index=True)
            free = first[self.step_key[slots[first]] < 0]
            self.step_key[slots[free]], self.step_to[slots[free]] = keys[free], targets[free]
            rest = np.ones(len(keys), bool)
            rest[free] = False
            keys, targets, slots = keys[rest], targets[rest], (slots[rest] + 1) & self.mask

    def _step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The states after ``char``, -1 where no piece goes on so."""
        key = state << _CHAR_BITS | char
        slot = ((key.view(np.uint64) * _SPREAD) >> self.shift).astype(np.int64)
        there = self.step_key[slot]
        out = np.where(there == key, self.step_to[slot], -1)
        open_ = np.flatnonzero((there != key) & (there >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            there = self.step_key[slot[open_]]
            same = there == key[open_]
            out[open_[same]] = self.step_to[slot[open_[same]]]
            open_ = open_[~same & (there >= 0)]
        return out

    def packed_words(self, words: list[str]) -> list[bytes]:
        """As ``search``, for many words that are as short as a few windows (spaces already marked), side by side."""
        sizes = np.array([len(w) for w in words], np.int64)
        by_size = np.argsort(-sizes, kind="stable")
        sizes, n = sizes[by_size], len(words)
        width = int(sizes[0])
        chars = np.zeros((n, width), np.int64)
        flat = np.frombuffer("".join([words[i] for i in by_size.tolist()]).encode("utf-32-le"), np.uint32)
        chars[np.arange(width) < sizes[:, None]] = flat
        longer = np.searchsorted(-sizes, -np.arange(width + 2), side="right")  # how many words have so many characters
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0.0
        start_of = np.zeros((n, width + 1), np.int64)
        piece_at = np.full((n, width + 1), -1, np.int64)
        for start in range(width):
            rows = np.flatnonzero(best[: longer[start + 1], start] > -np.inf)
            here, state = best[rows, start], np.zeros(len(rows), np.int64)
            for end in range(start + 1, min(start + self.longest, width) + 1):
                some = np.searchsorted(rows, longer[end])
                rows, here = rows[:some], here[:some]
                state = self._step(state[:some], chars[rows, end - 1])
                if end == start + 1:
                    alone = (state < 0) | (self.piece_of[state] < 0)
                    lost, total = rows[alone], here[alone] + self.unknown_score
                    better = total > best[lost, end]
                    best[lost[better], end], start_of[lost[better], end], piece_at[lost[better], end] = total[better], start, -1
                on = state >= 0
                rows, here, state = rows[on], here[on], state[on]
                if not len(rows):
                    break
                piece = self.piece_of[state]
                total = np.where(piece >= 0, here + self.score_of[state], -np.inf)
                better = np.flatnonzero(total > best[rows, end])
                at = rows[better]
                best[at, end], start_of[at, end], piece_at[at, end] = total[better], start, piece[better]
        found_rows, found_ends, found = [], [], []
        rows, ends = np.arange(n), sizes.copy()
        while len(rows):
            found_rows.append(rows)
            found_ends.append(ends)
            found.append(piece_at[rows, ends])
            ends = start_of[rows, ends]
            rows, ends = rows[ends > 0], ends[ends > 0]
        row, end, ids = (np.concatenate(x) for x in (found_rows, found_ends, found))
        order = np.lexsort((end, row))
        row, ids = row[order], ids[order]
        at = (4 * np.searchsorted(row, np.arange(n + 1))).tolist()
        raw = ids.astype(np.uint32).tobytes()
        unknown = set(row[ids < 0].tolist())
        out: list[bytes] = [b""] * n
        for k, i in enumerate(by_size.tolist()):
            out[i] = self._packed(words[i]) if k in unknown else raw[at[k] : at[k + 1]]
        return out

    def search(self, text: str) -> Iterator[list[int]]:
        """The ids of ``text`` (spaces already marked), as they are committed."""
        begins, longest, unknown = self.begins, self.longest, self.unknown_score
        done = 0  # the committed boundary; the lists below begin there
        best: list[float | None] = [0.0]
        back: list[tuple[int, int]] = [(0, -1)]
        check = 8 * longest
        for start in range(len(text)):
            here = best[start - done]
            for _ in range(start + longest - done + 2 - len(best)):
                best.append(None)
                back.append((0, -1))
            if here is None:
                continue
            alone = False
            for end in range(start + 1, min(start + longest, len(text)) + 1):
                found = begins.get(text[start:end])
                if found is None:
                    break
                if found:
                    alone = alone or end == start + 1
                    total = here + found[0]
                    old = best[end - done]
                    if old is None or total > old:
                        best[end - done], back[end - done] = total, (start, found[1])
            if not alone:
                total, old = here + unknown, best[start + 1 - done]
                if old is None or total > old:
                    best[start + 1 - done], back[start + 1 - done] = total, (start, -1)
            if start - done >= check:
                met = self._meet(best, back, start + 1, done)
                if met > done:
                    yield self._path(text, back, met, done)
                    base = best[met - done]
                    best = [None if b is None else b - base for b in best[met - done :]]
                    back = back[met - done :]
                    done, check = met, 8 * longest
                else:
                    check += 8 * longest
        yield self._path(text, back, len(text), done)

    def _meet(self, best, back, now: int, done: int) -> int:
        """The last boundary that is on the paths back from all reached places in the window after ``now`` - 1."""
        ends = {e for e in range(now, now + self.longest) if e - done < len(best) and best[e - done] is not None}
        while len(ends) > 1:
            last = max(ends)
            ends.discard(last)
            ends.add(back[last - done][0])
        return max(done, ends.pop())

    def _path(self, text: str, back, end: int, done: int) -> list[int]:
        ids: list[int] = []
        while end > done:
            start, piece = back[end - done]
            if piece >= 0:
                ids.append(piece)
            elif self.byte_ids:
                ids.extend(self.byte_ids[b] for b in reversed(text[start:end].encode()))
            else:
                ids.append(self.unknown_id)
            end = start
        return ids[::-1]

    def _packed(self, marked: str) -> bytes:
        out = array("I")
        for ids in self.search(marked):
            out.extend(ids)
        return out.tobytes()

    def _learn(self, words: list[str]) -> None:
        short = [w for w in words if len(w) <= REMEMBERED_CHARS]
        if short:
            self.memory.update(zip(short, self.packed_words([w.replace(" ", MARK) for w in short]), strict=True))
        for w in words:
            if len(w) > REMEMBERED_CHARS:
                self.memory[w] = self._packed(w.replace(" ", MARK))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as native unsigned 32-bit numbers."""
        if not self.by_word:
            return [self._packed(MARK + t.replace(" ", MARK)) if t else b"" for t in texts]
        words = [_WORDS.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        memory = self.memory
        if len(memory) > MEMORY_WORDS:
            memory.clear()
        self._learn(list(dict.fromkeys(w for own in words for w in own if w not in memory)))
        out = [b"".join(map(memory.__getitem__, own)) for own in words]
        for own in words:
            for w in own:
                if len(w) > REMEMBERED_CHARS:
                    memory.pop(w, None)
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def bytes_of(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids' pieces stand for."""
        size = self.size_of[ids]
        out = np.cumsum(size)
        return self.raw_flat[np.repeat(self.raw_at[ids] - out + size, size) + np.arange(out[-1] if len(out) else 0)].tobytes()

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``: the mark put in front of every text is taken off, broken UTF-8 shows as U+FFFD."""
        return self.bytes_of(np.asarray(ids, np.int64)).decode(errors="replace").removeprefix(" ")


def pieces(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def encode(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ids (array<int>) and ids_crc32 (columns of these names are replaced).

    ids_crc32 is the CRC-32 of the ids as little-endian unsigned 32-bit numbers. Null and empty texts have no ids.
    Repeated rows stay repeated rows; an empty table gives an empty table.
    """
    kept = docs.select([c for c in docs.columns if c not in ("ids", "ids_crc32")])
    schema = T.StructType(
        [*kept.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("ids_crc32", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            for lo in range(0, len(texts), 256):
                found = model.encode_all([t.as_py() or "" for t in texts.slice(lo, 256)])
                at = np.cumsum([0, *map(len, found)]) // 4
                ids = pa.ListArray.from_arrays(
                    pa.array(at, pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32))
                )
                crc = pa.array([zlib.crc32(f) for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(lo, 256) for c in batch.columns), ids, crc], names=schema.names
                )

    return kept.mapInArrow(run, schema)


def decode(tokens: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """All rows and columns of ``tokens`` with decoded (a column of this name is replaced); null ids give an empty text."""
    kept = tokens.select([c for c in tokens.columns if c != "decoded"])
    schema = T.StructType([*kept.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col))
            for lo in range(0, len(ids), 256):
                texts = [model.decode(i.values.tolist() if i.is_valid else []) for i in ids.slice(lo, 256)]
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(lo, 256) for c in batch.columns), pa.array(texts, pa.string())], names=schema.names
                )

    return kept.mapInArrow(run, schema)


def round_trip(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with n_ids, ids_crc32 and same_text (columns of these names are replaced).

    Each text is encoded and decoded again in one step, and the ids stay there: n_ids is their number, ids_crc32 as in
    ``encode``, same_text whether the decoded text is the given one (null: empty). Null and empty texts have no ids;
    repeated rows stay repeated rows; an empty table gives an empty table.
    """
    new = ("n_ids", "ids_crc32", "same_text")
    kept = docs.select([c for c in docs.columns if c not in new])
    added = [T.StructField("n_ids", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("same_text", T.BooleanType())]
    schema = T.StructType([*kept.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path)

        def same(ids: bytes, text: str) -> bool:
            numbers = np.frombuffer(ids, np.uint32)
            return model.bytes_of(numbers) == b" " + text.encode() if text else not len(numbers)

        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            for lo in range(0, len(column), 256):
                texts = [t.as_py() or "" for t in column.slice(lo, 256)]
                found = model.encode_all(texts)
                arrays = [
                    pa.array([len(f) // 4 for f in found], pa.int64()),
                    pa.array([zlib.crc32(f) for f in found], pa.int64()),
                    pa.array([same(f, t) for f, t in zip(found, texts)], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, 256) for c in batch.columns), *arrays], names=schema.names)

    return kept.mapInArrow(run, schema)
