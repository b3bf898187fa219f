"""Alignment of two tokenizers against a plain walk over the libraries' own tokens."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import sentencepiece
from rows import empty, frame
from rows import rows as plain_rows
from tokenizers import Tokenizer

from tablediff.llm.alignment import align, coalesced, text_pieces
from tablediff.llm.segment_ids import byte_level_ids, piece_ids, shared_cut

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ALPHABETS = ["ab ", "the an 's 'll", "aé日\n x", "0123 ,.!'", "  \t\n a", "ąžȶ Ж ы", "日本é 한", "▁a b", "\x00\x1c\x85 a", "😀 áb", "thingao "]


def tokenizer():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t


def strings(n, seed, longest=60):
    rng = random.Random(seed)
    out = ["", " ", "  ", "a ", " a", "<|endoftext|> a", "</s> <s>", "x" * 300]
    for _ in range(n):
        letters = rng.choice(ALPHABETS)
        out.append("".join(rng.choice(letters) for _ in range(rng.randint(0, longest))))
    return out


def walked(texts):
    """Per text (n_a, n_b, groups as text, links) from the libraries' tokens; None without tokens."""
    t, model = tokenizer(), sentencepiece.SentencePieceProcessor(model_file=B)
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    back = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    out = []
    for text in texts:
        if not text:
            out.append(None)
            continue
        want = (" " + text).encode()
        e = t.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(back[c] for c in p)) for i, p in zip(e.ids, e.tokens)]
        b = []
        for i in model.encode(text):
            p = model.id_to_piece(i)
            b.append((i, bytes([int(p[1:-1], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()))
        if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            out.append(None)
            continue
        groups, links, i, j, pa, pb = [([], [])], [], 0, 0, 0, 0
        while i < len(a) or j < len(b):
            if pa <= pb:
                groups[-1][0].append(a[i][0])
                pa += len(a[i][1])
                i += 1
            else:
                groups[-1][1].append(b[j][0])
                pb += len(b[j][1])
                j += 1
            if pa == pb and pa < len(want):
                groups.append(([], []))
        ranges = lambda x: [(n, sum(len(r) for _, r in x[:k]), sum(len(r) for _, r in x[: k + 1])) for k, (n, _) in enumerate(x)]
        ra, rb = ranges(a), ranges(b)
        links = [(x, y) for x, s, e in ra for y, u, v in rb if s < v and u < e]
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), said, links))
    return out


def expected(texts):
    each = walked(texts)
    counts = Counter(p for w in each if w for p in set(w[4]))
    top = {}
    for (a, _), n in counts.items():
        top[a] = max(top.get(a, 0), n)
    out = []
    for w in each:
        if w is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n = [counts[p] for p in w[4]]
        best = sum(counts[p] == top[p[0]] for p in w[4])
        out.append((w[0], w[1], w[2], len(w[4]), best, sum(n), hashlib.sha256(w[3].encode()).hexdigest()))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_segments_give_the_libraries_ids():
    a, b, t = byte_level_ids(A), piece_ids(B), tokenizer()
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    texts = strings(3000, 1)
    for text, (got_a, _), (got_b, _) in zip(texts, a.of([" " + x for x in texts]), b.of([" " + x for x in texts])):
        assert got_a.tolist() == t.encode(" " + text, add_special_tokens=False).ids, repr(text)
        if text:
            assert got_b.tolist() == model.encode(text), repr(text)


def test_pieces_of_long_texts_give_the_same_ids():
    a, b = byte_level_ids(A), piece_ids(B)
    for text in strings(400, 2, 300):
        pieces = text_pieces(text, 20)
        assert "".join(pieces) == " " + text
        for ids in (a, b):
            assert [i for x, _ in ids.of(pieces) for i in x.tolist()] == ids.of([" " + text])[0][0].tolist() or not text


def test_groups_break_where_both_end():
    rng = random.Random(3)
    for _ in range(200):
        size = rng.randint(1, 40)
        sides = []
        for _ in range(2):
            cuts = sorted(rng.sample(range(1, size), rng.randint(0, size - 1))) if size > 1 else []
            sides.append([y - x for x, y in zip([0, *cuts], [*cuts, size])])
        import numpy as np

        ga, gb, fa, fb = coalesced(*(np.array(s) for s in sides))
        spans = [[(sum(s[:k]), sum(s[: k + 1])) for k in range(len(s))] for s in sides]
        both = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        for got, span in zip((ga, gb), spans):
            assert got.tolist() == [sum(x <= s for x in both) for s, _ in span]
        want = [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if s < v and u < e]
        assert list(zip(fa.tolist(), fb.tolist())) == want


def test_all_columns_equal_a_walk(spark):
    texts = [None, *strings(300, 4), *["the thing and that"] * 30, "the thing " * 400]
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(texts)], "doc_id long, text string, found string, strip string")
    want = expected(texts)
    for strip in (8 << 20, 500):
        out = align(docs.repartition(3), A, B, strip_bytes=strip).collect()
        assert len(out) == len(texts)
        for r in out:
            assert tuple(r[c] for c in COLUMNS) == want[r["doc_id"]], (strip, texts[r["doc_id"]])
            assert (r["found"], r["strip"]) == ("x", "y")


def test_a_text_of_many_pieces(spark, monkeypatch):
    import tablediff.llm.alignment as m

    texts = [" ".join(strings(60, 5)).replace("▁", "_"), "one two three " * 50]
    want = expected(texts)
    monkeypatch.setattr(m, "BATCH_CHARS", 64)
    monkeypatch.setattr(m.text_pieces, "__defaults__", (30,))
    rows, found = m.align_texts(texts, [1, 1], A, B)
    assert [(*r[:4], r[4]) for r in rows] == [(*w[:4], w[6]) for w in want]
    assert sum(found["sizes"]) == sum(len({p for p in walked([t])[0][4]}) for t in texts)


def test_odd_rows_and_empty_tables(spark):
    out = align(frame(spark), A, B).collect()
    want = expected([t for _, t, *_ in plain_rows()])
    key = lambda x: tuple(map(str, x))
    assert sorted((tuple(r[c] for c in COLUMNS) for r in out), key=key) == sorted(want, key=key)
    assert align(empty(spark), A, B).count() == 0


def test_stretches_give_the_libraries_ids_in_any_text():
    t, model = tokenizer(), sentencepiece.SentencePieceProcessor(model_file=B)
    a, b = byte_level_ids(A), piece_ids(B)
    cut = shared_cut(a, b)
    rng = random.Random(6)
    # Some pieces of B end with a carriage return.
    alphabets = [*ALPHABETS, "a;{\r\n ", "(); \r", "\t\n\r x"]
    plain = 0
    for k in range(3000):
        letters = alphabets[k % len(alphabets)]
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 40)))
        stretches = cut(" " + text)
        if stretches is None:
            continue
        plain += 1
        assert "".join(stretches) == " " + text
        (got_a, _), (got_b, _) = a.of_stretches(stretches), b.of_stretches(stretches)
        assert got_a.tolist() == t.encode(" " + text, add_special_tokens=False).ids, repr(text)
        assert got_b.tolist() == model.encode(text), repr(text)
    assert plain > 1500


def test_a_stretch_is_aligned_once(monkeypatch):
    import tablediff.llm.alignment as m

    seen = []
    monkeypatch.setattr(m, "coalesced", lambda a, b, f=m.coalesced: seen.append(len(a)) or f(a, b))
    monkeypatch.setattr(m, "_LOADED", {})
    texts = [" ".join(["alpha, beta gamma."] * n) for n in range(1, 200)]
    rows, _ = m.align_texts(texts, [1] * len(texts), A, B)
    assert m.align_texts(texts, [1] * len(texts), A, B)[0] == rows
    assert sum(seen) < 20 < rows[-1][0]
