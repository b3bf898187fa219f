"""Token ids of many texts at once, each distinct word encoded once.

For a tokenizer that lower-cases, drops white space and marks word ends, the ids of a text are those of its parts (runs
of letters, single digits, runs of other signs) in turn. A batch of texts is cut into parts and dictionary-encoded by
Arrow; the library encodes the distinct parts that are not remembered, many in one call, and the word-end marks tell
where each part's ids end. Texts in which that is not plain (an apostrophe, a special token's string, control characters,
signs above U+017F) are encoded whole by the library. So are all texts if the tokenizer's file states other steps.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEMORY_PARTS = 400_000

# Texts with one of these go whole through the library. Up to U+017F, letters but the dotted capital I are lower-cased
# one by one and are already composed, so the parts below are those of the tokenizer.
_NOT_PLAIN = r"['\x00-\x08\x0e-\x1f\x7f-\x{a0}\x{130}\x{180}-\x{10ffff}]"
_CUT = r"([^\pL\pN\s]+|\pN)"

_LOADED: dict[str, BatchIds] = {}


class BatchIds:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            said = json.load(f)
        self.special = [t["content"] for t in said.get("added_tokens") or []]
        normal = [(n["type"], n.get("content")) for n in (said.get("normalizer") or {}).get("normalizers", [])]
        steps = (said.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_part = (
            normal == [("NFC", None), ("Replace", " "), ("Lowercase", None)]
            and [p["type"] for p in steps] == ["Split", "ByteLevel"]
            and steps[0]["behavior"] == "Removed"
            and steps[0]["invert"]
            and steps[0]["pattern"]["Regex"].endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
            and said["model"].get("end_of_word_suffix") == "</w>"
        )
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for piece, i in vocab.items():
            self.ends[i] = piece.endswith("</w>")
        self.memory: dict[str, bytes] = {}  # a part's ids, four bytes each

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, parts: list[str]) -> None:
        """Encode ``parts``, 256 in a text."""
        blocks = [parts[i : i + 256] for i in range(0, len(parts), 256)]
        for lo in range(0, len(blocks), 64):
            some = blocks[lo : lo + 64]
            for block, ids in zip(some, self.whole([" ".join(b) for b in some]), strict=True):
                flat = np.array(ids, np.uint32)
                ends = np.flatnonzero(self.ends[flat]) + 1
                if len(ends) != len(block):
                    self.memory.update(zip(block, (np.array(x, np.uint32).tobytes() for x in self.whole(block)), strict=True))
                else:
                    raw, to = flat.tobytes(), (4 * ends).tolist()
                    self.memory.update(zip(block, (raw[a:b] for a, b in zip([0, *to], to)), strict=True))

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's ids start (and the last one's end)."""
        n = len(texts)
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.by_part:
            return _joined([np.array(x, np.uint32) for x in self.whole(texts.to_pylist())])
        odd = pc.match_substring_regex(texts, _NOT_PLAIN)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        plain = pc.if_else(odd, "", texts)
        cut = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(plain), _CUT, r" \1 "))
        starts = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        words = cut.flatten().dictionary_encode()
        vocab = words.dictionary.to_pylist()
        if len(self.memory) + len(vocab) > MEMORY_PARTS:
            self.memory = {}
        self.memory[""] = b""
        self._learn([w for w in vocab if w not in self.memory])
        known = [self.memory[w] for w in vocab]
        at = np.zeros(len(known) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, known), np.int64, len(known)) // 4, out=at[1:])
        ids, word_at = _gather(np.frombuffer(b"".join(known), np.uint32), at, words.indices.to_numpy())
        text_at = word_at[starts]
        rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if not len(rows):
            return ids, text_at
        whole = iter(self.whole(texts.take(pa.array(rows)).to_pylist()))
        strange = set(rows.tolist())
        return _joined(
            [np.array(next(whole), np.uint32) if i in strange else ids[text_at[i] : text_at[i + 1]] for i in range(n)]
        )


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    at = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=at[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), at


def _gather(flat: np.ndarray, at: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``picks`` of ``flat``, one after the other, and where each starts."""
    size = (at[1:] - at[:-1])[picks]
    out = np.zeros(len(picks) + 1, np.int64)
    np.cumsum(size, out=out[1:])
    return flat[np.repeat(at[picks] - out[:-1], size) + np.arange(out[-1])], out


def batch_ids(path: str) -> BatchIds:
    if path not in _LOADED:
        _LOADED[path] = BatchIds(path)
    return _LOADED[path]
