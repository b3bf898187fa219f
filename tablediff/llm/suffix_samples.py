"""Sampled suffixes of byte strings, for matches of at least MATCH bytes.

Of every MATCH bytes in a row (a window), the K bytes in a row with the smallest hash, the leftmost of equal ones, are
its anchor; the suffixes that start at anchors are the samples. Which anchor a window has depends on its bytes alone, so
equal windows have their anchors at the same place in them: matches of MATCH bytes or more are found from the samples,
about one suffix in fifty. All window starts of a text fall into stretches with one anchor each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tablediff.llm.shingles import _mixed as mixed
from tablediff.llm.shingles import _powers as powers
from tablediff.llm.shingles import constants

MATCH = 200
K = 64
ANCHORS = MATCH - K + 1
_PLACE_BITS = 20
STRIP = 1 << _PLACE_BITS

_BYTE = constants(256, 11)


class Strip:
    """Several texts' bytes with sums from which the hash of any stretch follows."""

    def __init__(self, raw: bytes):
        self.bytes = np.frombuffer(raw, np.uint8)
        up, self.down = powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[self.bytes] * up[: len(raw)], dtype=np.uint64, out=self.sums[1:])

    def hashes(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mixed((self.sums[hi] - self.sums[lo]) * self.down[lo] + (hi - lo).astype(np.uint64))

    def anchors(self) -> np.ndarray:
        """The anchor's place for each window start (windows across texts too)."""
        n = len(self.bytes)
        if n < MATCH:
            return np.zeros(0, np.int64)
        at = np.arange(n - K + 1, dtype=np.uint64)
        mask = np.uint64(STRIP * 2 - 1)
        least = (mixed((self.sums[K:] - self.sums[:-K]) * self.down[: n - K + 1]) & ~mask) | at
        wide = 1
        while 2 * wide <= ANCHORS:
            least = np.minimum(least[:-wide], least[wide:])
            wide *= 2
        rest = ANCHORS - wide
        if rest:
            least = np.minimum(least[:-rest], least[rest:])
        return (least & mask).astype(np.int64)


def strips(texts: list[bytes]) -> Iterator[tuple[Strip, list[tuple[int, int, int, int]]]]:
    """Strips of about STRIP bytes and, per part, (text, its place in the text, its first and last byte + 1 in the strip).

    Parts of one text overlap by MATCH - 1 bytes, so that each of its windows is in just one part.
    """
    parts: list[bytes] = []
    where: list[tuple[int, int, int, int]] = []
    size = 0
    for i, raw in enumerate(texts):
        lo = 0
        while len(raw) - lo >= MATCH:
            part = raw[lo : lo + STRIP // 2]
            where.append((i, lo, size, size + len(part)))
            parts.append(part)
            size += len(part)
            lo += len(part) - MATCH + 1
            if size >= STRIP // 2:
                yield Strip(b"".join(parts)), where
                parts, where, size = [], [], 0
    if where:
        yield Strip(b"".join(parts)), where


def samples(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """Per strip: text, first window start in the text, number of windows, anchor's distance from the first start,
    the anchor's hash and the hash of all bytes of the windows."""
    for strip, where in strips(texts):
        anchor = strip.anchors()
        text, place, first, last = (np.array(x, np.int64) for x in zip(*where))
        new = np.ones(len(anchor), bool)
        new[1:] = anchor[1:] != anchor[:-1]
        new[first[first < len(anchor)]] = True
        start = np.flatnonzero(new)
        part = np.searchsorted(first, start, side="right") - 1
        stop = np.append(start[1:], len(anchor))  # window starts
        stop = np.minimum(stop, last[part] - MATCH + 1)
        good = np.flatnonzero(stop > start)
        start, stop, part = start[good], stop[good], part[good]
        at = anchor[start]
        yield (
            text[part],
            start - first[part] + place[part],
            stop - start,
            at - start,
            strip.hashes(at, at + K),
            strip.hashes(start, stop + MATCH - 1),
        )


def as_bytes(column: pa.Array) -> list[bytes]:
    return [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in column]
