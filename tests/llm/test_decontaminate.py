"""Suffix arrays over training words against plain scans of all windows."""

import hashlib
import random
import re

import numpy as np
import pytest
from rows import empty, frame

from tablediff.llm.decontaminate import (
    Block,
    contamination_digest,
    decontaminate,
    find_contamination,
    hashed_words,
    suffix_array,
)

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def scanned(texts, items, window=10):
    """For each text: words, hit words, item ids, spans, length of the longest match of an item's suffix."""
    out = []
    for text in texts:
        words, hit, found, longest = words_of(text), set(), set(), 0
        for item, body in items:
            own = words_of(body)
            w = min(window, len(own))
            for j in range(len(own) - w + 1 if own else 0):
                for p in range(len(words) - w + 1):
                    if words[p : p + w] == own[j : j + w]:
                        n = w
                        while p + n < len(words) and j + n < len(own) and words[p + n] == own[j + n]:
                            n += 1
                        hit.update(range(p, p + w))
                        found.add("" if item is None else str(item))
                        longest = max(longest, n)
        spans = [(a, next(n for n in range(1, len(words) + 2) if a + n not in hit)) for a in sorted(hit) if a - 1 not in hit]
        out.append((len(words), len(hit), sorted(found), spans, longest))
    return out


def cases(seed=3):
    rng = random.Random(seed)
    vocab = ["a", "B", "c", "Dé", "e1", "日本"]
    some = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, some(rng.randint(0, 30))) for k in range(12)] + [(3, some(14)), (None, some(3)), (50, None), (51, "zz"), (52, "?!")]
    shared = some(25)
    items += [(60, shared), (61, "x " + shared), (62, shared)]
    texts = [some(rng.randint(0, 60)) for _ in range(60)]
    texts += [some(5) + ", " + items[k % 12][1].upper() + "\n" + some(7) for k in range(20)]
    texts += [shared] * 9 + [None, "", "...", "ZZ", "y" * 4000, some(900), "pad " + shared + " " + some(3)]
    return texts, items


def test_suffix_array_equals_sorting():
    rng = random.Random(1)
    for _ in range(60):
        parts = [[rng.randint(0, 2) for _ in range(rng.randint(1, 12))] * rng.randint(1, 4) for _ in range(rng.randint(1, 6))]
        flat = []
        for k, part in enumerate(parts):
            flat += [x + len(parts) for x in part] + [k]
        want = sorted((i for i in range(len(flat)) if flat[i] >= len(parts)), key=lambda i: flat[i:])
        assert suffix_array(np.array(flat, np.int32), len(parts)).tolist() == want


def test_hashed_words_are_equal_where_words_are():
    texts = ["Ab ab AB-aB [x]_x`x 9ß9", "", "...", "q" * (3 << 20) + " tail", "w " * (1 << 20)]
    got = hashed_words([t.encode() for t in texts])
    assert [len(g) for g in got] == [len(words_of(t)) for t in texts]
    known = {}
    for text, hashes in zip(texts, got):
        for word, h in zip(words_of(text), hashes.tolist()):
            assert known.setdefault(word, h) == h
    assert len(set(known.values())) == len(known)


@pytest.mark.parametrize("shard,block", [(1 << 19, 1 << 21), (12, 24)])
def test_hits_items_and_matches_equal_a_scan(spark, shard, block):
    texts, items = cases()
    docs = spark.createDataFrame([(k, t, "clash", 1) for k, t in enumerate(texts)], "doc_id long, text string, items string, n_hit int")
    tests = spark.createDataFrame(items, "item_id long, text string")
    out = find_contamination(docs.repartition(3), tests, shard_words=shard, block_words=block).collect()
    want = scanned(texts, items)
    assert len(out) == len(texts)
    for r in out:
        n, hit, found, spans, longest = want[r["doc_id"]]
        assert (r["n_words"], r["n_hit"], r["items"]) == (n, hit, found), r["doc_id"]
        assert [(s["start"], s["n_words"]) for s in r["spans"]] == spans
        assert r["contaminated"] == (hit > 0)
        if shard > 1000:  # matches that two shards share are cut
            assert (r["longest"]["n_words"] if r["longest"] else 0) == longest
        if r["longest"]:
            m = r["longest"]
            own = words_of(texts[r["doc_id"]])[m["start"] : m["start"] + m["n_words"]]
            bodies = [words_of(b) for i, b in items if ("" if i is None else str(i)) == m["item_id"]]
            assert any(b[m["item_word"] : m["item_word"] + m["n_words"]] == own for b in bodies)


def test_digest_and_removal(spark):
    texts, items = cases(5)
    docs = spark.createDataFrame([(k, t, "x", "x") for k, t in enumerate(texts)], "doc_id long, text string, contaminated string, row string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    want = scanned(texts, items)
    for r in contamination_digest(docs, tests).collect():
        n, hit, found, _, _ = want[r["doc_id"]]
        sha = hashlib.sha256(",".join(found).encode()).hexdigest()
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n, hit, len(found), sha, hit > 0)
    clean = decontaminate(docs, tests)
    assert clean.columns == docs.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == [k for k, w in enumerate(want) if not w[1]]


def test_a_passage_in_many_texts_and_items(spark):
    passage = " ".join(f"w{k}" for k in range(15))
    docs = spark.range(3000).selectExpr("id AS doc_id", f"concat('d', id, ' {passage} e', id % 7) AS text")
    tests = spark.range(300).selectExpr("id AS item_id", f"concat('{passage} i', id) AS text")
    out = contamination_digest(docs, tests).collect()
    assert len(out) == 3000
    assert all((r["n_hit"], r["n_items"]) == (15, 300) for r in out)


def test_empty_tables_and_odd_rows(spark):
    tests = spark.createDataFrame([(1, "spam ham eggs toast spam ham eggs toast spam ham")], "item_id long, text string")
    assert contamination_digest(empty(spark), tests).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination_digest(frame(spark), none).where("contaminated").count() == 0
    got = contamination_digest(frame(spark), tests).collect()
    assert len(got) == frame(spark).count()
    assert [r["doc_id"] for r in got if r["contaminated"]] == [11]


def test_block_counts_words_to_the_end():
    words = np.arange(5, dtype=np.uint64).tobytes()
    block = Block([{"item_id": "a", "first": 0, "n_words": 5, "words": words}], 10)
    assert block.left.tolist() == [5, 4, 3, 2, 1]
    assert block.wide.tolist() == [5] * 5
