"""Token ids of texts from those of their segments, each distinct segment encoded once by the tokenizer's own library.

A text is cut only where no merge can cross: at the places where a byte-level tokenizer's own pattern cuts, or in front
of a run of spaces where no piece of a sentence-piece model holds a space after another character. Whether the
tokenizer's file allows that is looked up when it is loaded; texts for which it isn't plain go whole through the library.

Between a character and a space, tab or newline after it both kinds cut: ``shared_cut`` gives the stretches in between.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

MARK = "▁"
MEMORY_SEGMENTS = 400_000
MEMORY_CHARS = 16_000_000

# Ranges in which all releases of Unicode agree on letters, numbers and white space.
_STEADY = "\t\n\r\x20-\x7e\xa1-ȶЀ-ҁҊ-ӎぁ-ゔァ-ヺ一-龥가-힣‐-‧"
_ODD = re.compile(f"[^{_STEADY}]")
# Pieces may end with a carriage return, so a stretch goes on over white space that begins with one.
_STRETCH = re.compile(r"[ \t\n\r]*[^ \t\n\r]+(?:\r[ \t\n\r]*[^ \t\n\r]*)*|[ \t\n\r]+")
_LEAD = " x"
STRETCHES_AT_ONCE = 256
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_file(name: str) -> str:
    """Where a tokenizer's file is on this machine: a path as given, a bare name among the public tokenizers."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class SegmentIds:
    """Texts to ids (native unsigned 32-bit numbers), and whether the ids' bytes are those of a space and the text."""

    def __init__(
        self, encode: Callable[[list[str]], list[list[int]]], raw: list[bytes], cut: Callable[[str], list[str] | None], blanks_lead: bool
    ):
        self.encode, self.raw, self.cut, self.blanks_lead = encode, raw, cut, blanks_lead
        self.sizes = np.array([len(r) for r in raw], np.int64)
        self.memory: dict[str, bytes] = {}
        self.strange: set[str] = set()
        self.chars = 0

    def _packed(self, texts: list[str]) -> list[bytes]:
        return [np.array(ids, np.uint32).tobytes() for ids in self.encode(texts)]

    def _same(self, ids: bytes, text: str) -> bool:
        return b"".join(map(self.raw.__getitem__, np.frombuffer(ids, np.uint32).tolist())) == text.encode()

    def _learn(self, segments: list[str]) -> None:
        for segment, ids in zip(segments, self._packed(segments), strict=True):
            self.memory[segment] = ids
            self.chars += len(segment)
            if not self._same(ids, segment):
                self.strange.add(segment)

    def of(self, texts: list[str]) -> list[tuple[np.ndarray, bool]]:
        """For each text, which begins with a space, its ids and whether they stand for its bytes."""
        if len(self.memory) > MEMORY_SEGMENTS or self.chars > MEMORY_CHARS:
            self.memory, self.strange, self.chars = {}, set(), 0
        cuts = [self.cut(t) for t in texts]
        memory = self.memory
        self._learn(list(dict.fromkeys(s for c in cuts if c is not None for s in c if s not in memory)))
        whole = iter(self._packed([t for t, c in zip(texts, cuts) if c is None]))
        out = []
        for text, segments in zip(texts, cuts):
            if segments is None:
                ids = next(whole)
                same = self._same(ids, text)
            else:
                ids = b"".join(map(memory.__getitem__, segments))
                same = not self.strange or self.strange.isdisjoint(segments) or self._same(ids, text)
            out.append((np.frombuffer(ids, np.uint32), same))
        return out

    def _apart(self, blocks: list[list[str]]) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of all stretches, each block encoded as one text, and where each stretch's start (and the last one's
        end); None if the tokens' bytes are not those of the stretches."""
        text = [[_LEAD, *block] for block in blocks]
        flat = np.fromiter(chain.from_iterable(self.encode(["".join(parts) for parts in text])), np.int64)
        parts = pa.array(list(chain.from_iterable(text)), pa.string())
        stops = np.cumsum(pc.binary_length(parts).to_numpy())
        ends = np.cumsum(self.sizes[flat])
        at = np.searchsorted(ends, stops)
        if ends[-1] != stops[-1] or not np.array_equal(ends[at], stops):
            return None
        if b"".join(map(self.raw.__getitem__, flat.tolist())) != "".join(map("".join, text)).encode():
            return None
        first, at = np.concatenate(([0], at[:-1] + 1)), at + 1
        leads = np.cumsum([0, *map(len, text[:-1])])
        sizes = at - first
        flat = np.delete(flat, np.concatenate([np.arange(first[k], at[k]) for k in leads]))
        return flat, np.cumsum(np.concatenate(([0], np.delete(sizes, leads))))

    def of_stretches(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all stretches of ``shared_cut``, and where each one's start (and the last one's end).

        Stretches that end with a character are encoded many in one text, in which the tokens' bytes tell them apart.
        A stretch whose ids don't stand for its bytes has none.
        """
        blocks: list[list[str]] = []
        room = 0
        for s in stretches:
            if room and not blocks[-1][-1][-1].isspace():
                blocks[-1].append(s)
                room -= 1
            else:
                blocks.append([s])
                room = STRETCHES_AT_ONCE - 1
        none = np.zeros(0, np.int64), np.zeros(2, np.int64)
        found = self._apart(blocks)
        if found is None:
            each = [self._apart([block]) or [self._apart([[s]]) or none for s in block] for block in blocks]
            parts = list(chain.from_iterable(x if isinstance(x, list) else [x] for x in each))
            sizes = np.concatenate([np.diff(at) for _, at in parts])
            found = np.concatenate([ids for ids, _ in parts]), np.cumsum(np.concatenate(([0], sizes)))
        return found


def shared_cut(a: SegmentIds, b: SegmentIds) -> Callable[[str], list[str] | None]:
    """Cuts a text that begins with a space where tokens of a byte-level and of a sentence-piece file both end: in front
    of a space, tab or newline after a character that is no white space. None for texts, or all texts of files, for which that isn't plain."""
    good = a.blanks_lead and b.blanks_lead
    return lambda text: _STRETCH.findall(text) if good and not _ODD.search(text) else None


def byte_level_ids(path: str) -> SegmentIds:
    """A byte-level BPE file of the tokenizers library; strings of special tokens are plain text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    with open(path) as f:
        said = json.load(f)
    steps = said.get("pre_tokenizer") or {}
    plain = said.get("normalizer") is None and steps.get("type") == "ByteLevel" and steps.get("use_regex", True)
    plain = plain and not steps.get("add_prefix_space")
    # Printable bytes stand for themselves, the others for code points from 256 on.
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
    vocab = tokenizer.get_vocab()
    raw = [b""] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        raw[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
    parts = regex.compile(_PATTERN)

    def encode(texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for lo in range(0, len(texts), 1024):
            out += [e.ids for e in tokenizer.encode_batch_fast(texts[lo : lo + 1024], add_special_tokens=False)]
        return out

    return SegmentIds(encode, raw, lambda text: parts.findall(text) if plain and not _ODD.search(text) else None, plain)


def piece_ids(path: str) -> SegmentIds:
    """A sentence-piece file, which puts the space in front itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(size)]
    raw = [n.replace(MARK, " ").encode() for n in names]
    for i in range(size):
        if model.is_byte(i):
            raw[i] = bytes([int(names[i][1:-1], 16)])
    apart = all(MARK not in n.lstrip(MARK) for n in names)
    probe = " a  b\tc ﬁ é "
    plain = apart and model.normalize(probe) == (MARK + probe).replace(" ", MARK)
    blanks_lead = plain and not any(re.search(r"[^▁ \t\n\r][▁ \t\n]", n) for n in names)
    spaced = re.compile(" +[^ ]*")

    def cut(text: str) -> list[str] | None:
        return spaced.findall(text) if plain and MARK not in text and "\0" not in text else None

    def encode(texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        alone = [model.piece_to_id(MARK)]
        for lo in range(0, len(texts), 4096):
            some = texts[lo : lo + 4096]
            ids = model.encode([t[1:] for t in some], num_threads=1)
            out += [alone if t == " " else i for t, i in zip(some, ids)]
        return out

    return SegmentIds(encode, raw, cut, blanks_lead)
