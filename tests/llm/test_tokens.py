import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from rows import empty, frame, rows, texts

from tablediff.llm.chunk_ids import batch_ids
from tablediff.llm.packing import best_fit_packing, plan_slots
from tablediff.llm.token_counts import chunked_ids, count_tokens
from tablediff.llm.viterbi import MARK, pieces, round_trip

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ALPHABETS = ["ab", "the an", "aaaaa b", "aé日\n x", "0123 ,.", "thingao", " ", "a", "日本é"]


def strings(n, seed, longest=300):
    rng = random.Random(seed)
    for _ in range(n):
        letters = rng.choice(ALPHABETS)
        yield "".join(rng.choice(letters) for _ in range(rng.randint(0, longest)))


def test_spliced_chunks_equal_the_whole_text():
    enc = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for k, text in enumerate(strings(600, 1)):
        for chunk, overlap in ((5, 2), (17, 4), (64, 8)):
            assert chunked_ids(enc, text, chunk, overlap) == enc.encode(text), (k, text)


def test_counts_of_all_rows(spark):
    enc = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    out = count_tokens(frame(spark), PIECES, limit=100, chunk_bytes=256, overlap_bytes=16).collect()
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"], r["kept"]) for r in out)
    want = []
    for i, t, *_ in rows():
        n = len(enc.encode(t or ""))
        want.append((i or 0, len((t or "").encode()), n, n > 100, "clash"))
    assert got == sorted(want)
    assert count_tokens(empty(spark), PIECES).count() == 0


def best_path(model, text):
    best, back = [0.0] + [None] * len(text), [None] * (len(text) + 1)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - model.longest), end):
            if best[start] is None:
                continue
            found = model.score.get(text[start:end]) or ((model.unknown_score, -1) if end == start + 1 else None)
            if found and (best[end] is None or best[start] + found[0] > best[end]):
                best[end], back[end] = best[start] + found[0], (start, found[1])
    return model._path(text, [b or (0, -1) for b in back], len(text), 0)


def test_streaming_search_equals_the_whole_search():
    model = pieces(PIECES)
    for text in [*strings(300, 2), *strings(40, 3, 3000), "a" * 4000, "日本" * 900]:
        marked = MARK + text.replace(" ", MARK)
        assert np.frombuffer(model.encode(text), np.uint32).tolist() == (best_path(model, marked) if text else [])
        if text:
            assert [i for part in model.search(marked) for i in part] == best_path(model, marked)
        assert model.decode(np.frombuffer(model.encode(text), np.uint32).tolist()) == text


def test_round_trip_of_all_rows(spark):
    out = round_trip(frame(spark), PIECES).collect()
    assert len(out) == len(rows()) and all(r["same_text"] for r in out)
    assert sorted(r["n_ids"] for r in out)[0] == 0 and all(r["score"] == "clash" for r in out)
    assert round_trip(empty(spark), PIECES).count() == 0


def test_batch_ids_equal_the_library():
    enc = batch_ids(WORDS)
    odd = ["a <|endoftext|> b", "It's THE Σ ΟΔΟΣ x é İstanbul ﬁ 123 4.5 \x1c k", "ÀÖ×÷²³ª", "SS ẞ ß ſ ŉ abc!!1..2,,x", "½¾x²y"]
    odd += [chr(c) + "A," + chr(c) + "4" for c in range(1, 0x600, 3)]
    given = [*texts(), *odd, *strings(100, 4)]
    ids, at = enc.of(pa.array(given))
    for i, text in enumerate(given):
        assert ids[at[i] : at[i + 1]].tolist() == enc.whole([text])[0], text


def test_plan_fills_sequences_and_is_near_the_bound():
    rng = random.Random(5)
    for _ in range(30):
        counts = {rng.randint(1, 100): rng.randint(1, 400) for _ in range(rng.randint(1, 40))}
        placed, used = {}, {}
        for length, first_rank, n, sequence, per, offset in plan_slots(counts, 100):
            assert first_rank == placed.get(length, 0)
            placed[length] = first_rank + n
            for k in range(n):
                used.setdefault(sequence + k // per, []).append((offset + k % per * length, length))
        assert placed == counts
        for parts in used.values():
            end = 0
            for offset, length in sorted(parts):
                assert offset == end
                end += length
            assert end <= 100
        least = -(-sum(k * n for k, n in counts.items()) // 100)
        assert len(used) <= 11 / 9 * max(least, sum(n for k, n in counts.items() if k > 50)) + 1


def test_packing_of_all_rows(spark):
    out = best_fit_packing(frame(spark), WORDS, capacity=64).toPandas()
    enc, want = batch_ids(WORDS), {}
    for i, t, *_ in rows():
        ids = [*enc.whole([t or ""])[0], 0]
        for k, lo in enumerate(range(0, len(ids), 64)):
            part = np.array(ids[lo : lo + 64], "<u4")
            want.setdefault((i or 0, k, lo, len(part), zlib.crc32(part)), 0)
            want[i or 0, k, lo, len(part), zlib.crc32(part)] += 1
    out["doc_id"] = out["doc_id"].fillna(0).astype(int)
    got = out.groupby(["doc_id", "piece", "start", "length", "ids_crc32"]).size().to_dict()
    assert got == want
    for _, rows_ in out.sort_values("offset").groupby("sequence_id"):
        assert rows_["offset"].tolist() == [0, *rows_["length"].cumsum().tolist()[:-1]] and rows_["length"].sum() <= 64
    assert best_fit_packing(empty(spark), WORDS).count() == 0
