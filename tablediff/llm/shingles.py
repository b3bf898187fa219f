"""Sets of word shingles and their MinHash values, for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
# Bytes worked on at once: some 35 bytes of memory each, in every Python worker.
STRIP = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread one-to-one image of each 64-bit number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, salt: int) -> np.ndarray:
    """``n`` fixed odd numbers."""
    return _mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) | np.uint64(1)


_BYTE = np.where(_SPACE, np.uint64(0), constants(256, 1))
_PLACE = constants(WORDS, 2)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        base = int(constants(1, 3)[0])
        for name, b in (("up", base), ("down", pow(base, -1, 1 << 64))):
            steps = np.full(n, np.uint64(b))
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def _strips(texts: pa.Array) -> Iterator[tuple[list[int], bytes]]:
    """Pieces of texts with a space after each, about STRIP bytes together; long texts are cut at white space."""
    rows: list[int] = []
    parts: list[bytes] = []
    size = 0
    for i, t in enumerate(texts):
        raw = t.as_buffer().to_pybytes() if t.is_valid else b""
        lo = 0
        while lo < len(raw):
            hi = lo + STRIP
            if hi < len(raw):
                space = np.flatnonzero(_SPACE[np.frombuffer(raw[lo:hi], np.uint8)])
                after = _SPACE[np.frombuffer(raw[hi:], np.uint8)]
                hi = lo + int(space[-1]) + 1 if len(space) else hi + (int(after.argmax()) if after.any() else len(raw))
            part = raw[lo:hi] + b" "
            rows.append(i)
            parts.append(part)
            size += len(part)
            lo = hi
            if size >= STRIP:
                yield rows, parts
                rows, parts, size = [], [], 0
    if rows:
        yield rows, parts


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words' 64-bit hashes of all texts in turn, and where each text's begin (and the last one's end)."""
    hashes, counts = [], np.zeros(len(texts) + 1, np.int64)
    for rows, parts in _strips(texts):
        raw = np.frombuffer(b"".join(parts), np.uint8)
        space = _SPACE[raw]
        starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
        if not len(starts):
            continue
        up, down = _powers(len(raw))
        hashes.append(_mixed(np.add.reduceat(_BYTE[raw] * up[: len(raw)], starts) * down[starts]))
        ends = np.cumsum([len(p) for p in parts])
        np.add.at(counts, np.array(rows)[np.searchsorted(ends, starts, side="right")] + 1, 1)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.cumsum(counts)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all texts in turn, sorted within a text, and where each text's begin.

    A text with fewer than WORDS words, but at least one, has one shingle of all its words.
    """
    words, at = word_hashes(texts)
    sets = []
    for lo, hi in zip(at[:-1], at[1:]):
        w, n = words[lo:hi], int(hi - lo)
        if n >= WORDS:
            s = w[: n - WORDS + 1] * _PLACE[0]
            for k in range(1, WORDS):
                s = s + w[k : n - WORDS + 1 + k] * _PLACE[k]
            sets.append(np.unique(_mixed(s)))
        else:
            sets.append(_mixed((w * _PLACE[:n]).sum(keepdims=True) + np.uint64(n)) if n else w)
    starts = np.zeros(len(sets) + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=starts[1:])
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), starts


def min_hashes(shingles: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Per text and hash function the smallest hash (all bits set for an empty set)."""
    out = np.full((len(starts) - 1, n), np.uint64(0xFFFFFFFFFFFFFFFF))
    rows = np.flatnonzero(np.diff(starts) > 0)
    if len(rows):
        scale, shift = constants(n, 4), constants(n, 5)
        for k in range(n):
            out[rows, k] = np.minimum.reduceat(shingles * scale[k] + shift[k], starts[rows])
    return out


def set_keys(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """16 bytes for each text's set: equal sets have equal keys."""
    out = np.zeros((len(starts) - 1, 2), np.uint64)
    rows = np.flatnonzero(np.diff(starts) > 0)
    for k in range(2):
        if len(rows):
            out[rows, k] = np.add.reduceat(_mixed(shingles ^ constants(2, 6)[k]), starts[rows])
    return out
