"""Spelling variants against all pairs of a vocabulary."""

import random
import re
import zlib
from collections import Counter

import pytest
from rows import empty, frame
from rows import rows as plain_rows

from tablediff.llm.spelling import near_pairs, spelling_variants, vocabulary


def counted(rows, least=7, twice=2):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= least and c >= twice}


def near(a, b):
    """Exactly one edit."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants(n, factor=10):
    words = sorted(n)
    others = {w: [] for w in words}
    by_size = {}
    for w in words:
        by_size.setdefault(len(w), []).append(w)
    for w in words:
        for size in (len(w), len(w) + 1):
            for x in by_size.get(size, []):
                if (size > len(w) or x > w) and near(w, x):
                    others[w].append(x)
                    others[x].append(w)
    form = {}
    for w in words:
        best = min(others[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= factor * n[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(others[w]), n[form[w]] if form[w] else None))
    return out


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def edited(rng, word, letters):
    k = rng.randrange(len(word))
    return rng.choice([word[:k] + word[k + 1 :], word[:k] + rng.choice(letters) + word[k + 1 :], word[:k] + rng.choice(letters) + word[k:]])


@pytest.mark.parametrize("letters,size,many", [("ab", 7, 130), ("abcdé", 8, 500), ("abcdefghijklmnopqrstuvwxyzñÿ", 12, 900), ("ab", 4, 30)])
def test_near_pairs_equal_all_pairs(spark, letters, size, many):
    rng = random.Random(size)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(size, size + 4))) for _ in range(many)}
    words |= {edited(rng, w, letters) for w in sorted(words) for _ in range(2)}
    words = sorted(w for w in words if len(w) >= 4)
    got = near_pairs(spark.createDataFrame([(w,) for w in words], "word string").repartition(3)).collect()
    assert sorted((r["word"], r["other"]) for r in got) == sorted((a, b) for a in words for b in words if near(a, b))


def test_forms_and_roots_follow_the_counts(spark):
    rng = random.Random(9)
    n = {}
    for _ in range(60):
        word = "".join(rng.choice("abcdefgh") for _ in range(9))
        n[word] = 5000
        for m in (400, 30, 2):
            word = edited(rng, word, "abcdefgh")
            n[word] = max(n.get(word, 0), m)
    n |= {"baaaaaaa": 100, "caaaaaaa": 100, "aaaaaaaa": 3}
    n = {w: c for w, c in n.items() if len(w) >= 4}
    got = spelling_variants(spark.createDataFrame(sorted(n.items()), "word string, n long")).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == variants(n)
    assert {r["word"]: r["form"] for r in got}["aaaaaaaa"] == "baaaaaaa"
    assert any(r["root"] != (r["form"] or r["word"]) for r in got)


def test_vocabulary_of_whole_texts(spark):
    rng = random.Random(2)
    stock = ["".join(rng.choice("abcdeÀÿ×ABZ") for _ in range(rng.randint(5, 10))) for _ in range(60)]
    rows = [(k, " ".join(rng.choice(stock) + rng.choice(["", "1", "-", "日"]) for _ in range(200))) for k in range(40)]
    rows += [(None, rows[0][1]), (3, None), (4, ""), (5, "x" * 4000), (5, "x" * 4000), (6, "1 2")]
    docs = spark.createDataFrame([(i, t, "w") for i, t in rows], "doc_id long, text string, word string")
    got = {r["word"]: r["n"] for r in vocabulary(docs.repartition(3)).collect()}
    assert got == counted(rows)


def test_odd_rows_and_empty_tables(spark):
    got = spelling_variants(vocabulary(frame(spark))).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == variants(counted([(r[0], r[1]) for r in plain_rows()]))
    assert spelling_variants(vocabulary(empty(spark))).count() == 0
    with pytest.raises(ValueError):
        spelling_variants(vocabulary(empty(spark)), factor=1)
