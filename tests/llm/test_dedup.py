import collections
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from rows import DDL, empty, frame, rows, words

from tablediff.llm.chosen_path import jaccard_classes, one_of_each, runs_for
from tablediff.llm.common import written
from tablediff.llm.suffix_dedup import MATCH, suffix_dedup, suffix_dedup_digest

CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def brute_cut(texts):
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[i : i + MATCH] for r in raws for i in range(len(r) - MATCH + 1))
    out = []
    for raw in raws:
        covered = bytearray(len(raw))
        for i in range(len(raw) - MATCH + 1):
            if seen[raw[i : i + MATCH]] > 1:
                covered[i : i + MATCH] = b"\x01" * MATCH
        runs = sum(covered[i] and not (i and covered[i - 1]) for i in range(len(raw)))
        out.append((bytes(b for b, c in zip(raw, covered) if not c), sum(covered), runs))
    return out


def more_rows():
    """Shared passages that meet at other places, periodic texts, and passages just below and at the length."""
    rng = random.Random(11)
    shared = words(rng, 80)
    out = []
    for i in range(40):
        lo = rng.randint(0, 200)
        out.append((100 + i, words(rng, 20) + shared[lo : lo + rng.choice((199, 200, 201, 260, 330))] + words(rng, 25)))
    out += [(200 + i, "ab" * (150 + i)) for i in range(3)] + [(210, "xyz" * 90 + words(rng, 30) + "xyz" * 90)]
    return [*rows(), *((i, t, "en", "a", len(t), "clash", "clash") for i, t in out)]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame(more_rows(), DDL).repartition(3)


def test_suffix_dedup_equals_brute_force(spark, documents):
    import hashlib

    given = more_rows()
    cut = brute_cut([r[1] for r in given])
    want = collections.Counter()
    for (i, t, *_), (kept, n, runs) in zip(given, cut):
        want[i, len((t or "").encode()), n, runs, hashlib.sha256(kept).hexdigest()] += 1
    out = suffix_dedup_digest(documents).collect()
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out) == want


def test_suffix_dedup_keeps_rows_columns_and_nulls(spark, documents):
    given = more_rows()
    out = suffix_dedup(documents, batches=3)
    assert out.columns == documents.columns
    cut = [None if r[1] is None else c[0].decode(errors="ignore") for r, c in zip(given, brute_cut([r[1] for r in given]))]
    got = collections.Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert got == collections.Counter((r[0], t) for r, t in zip(given, cut))
    assert suffix_dedup_digest(empty(spark)).count() == 0


def shingles(text):
    w = [x for x in re.split(r"[ \t\n\r\x0b\x0c]+", (text or "").lower()) if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_rows():
    """Chains and a large group of near copies beside the common rows."""
    rng = random.Random(12)
    out = []
    for g, size in ((300, 90), (500, 8), (600, 2)):
        base = words(rng, 160).split()
        for i in range(size):
            own = list(base)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = words(rng, 1)
            out.append((g + i, " ".join(own)))
    return [*rows(), *((i, t, "en", "a", len(t), "clash", "clash") for i, t in out)]


def brute_classes(given):
    members = collections.defaultdict(list)
    for i, t, *_ in given:
        members[shingles(t)].append(i)
    sets = [s for s in members if s]
    parent, links = list(range(len(sets))), [0] * len(sets)

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    first = {}
    for a, s in enumerate(sets):
        own = [i for i in members[s] if i is not None]
        first[root(a)] = min([*own, first.get(root(a), 10**9)])
    out = collections.Counter()
    for a, s in enumerate(sets):
        for i in members[s]:
            out[i, first[root(a)] if first[root(a)] < 10**9 else None, links[a], len(members[s])] += 1
    for i in members.get(frozenset(), []):
        out[i, i, 0, 1] += 1
    return out


def test_jaccard_classes_equal_brute_force(spark):
    given = near_rows()
    out = jaccard_classes(spark.createDataFrame(given, DDL).repartition(3)).collect()
    assert collections.Counter((r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in out) == brute_classes(given)
    assert jaccard_classes(empty(spark)).count() == 0


def test_one_document_of_each_class_stays(spark):
    docs = frame(spark)
    out = one_of_each(docs)
    assert out.columns == docs.columns
    kept = sorted((r["doc_id"] or 0) for r in out.collect())
    # 2 and 3 are copies of 1, the second 15 repeats the first; texts without a word stay.
    assert kept == [0, 1, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]


def test_runs_reach_the_recall():
    runs = runs_for(0.8, 0.9999)
    assert 1 - (1 - 0.8**3) ** runs >= 0.9999 > 1 - (1 - 0.8**3) ** (runs - 1)


def files(at):
    return {str(p) for p in Path(at).rglob("*") if p.is_file()}


def test_suffix_dedup_leaves_one_table(spark, documents, tmp_path, monkeypatch):
    monkeypatch.setattr("tablediff.llm.suffix_dedup.shared_dir", lambda spark: str(tmp_path))
    cleaned = spark.conf.get(CLEANED)
    out = suffix_dedup(documents)
    assert {Path(p).parent.name for p in files(tmp_path)} == {"changed"}
    assert spark.conf.get(CLEANED) == cleaned
    assert out.count() == len(more_rows())


def test_a_written_table_leaves_no_shuffle_files(spark, tmp_path):
    def shuffles():
        blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {p for d in blocks.localDirs() for p in files(d.getPath()) if "/shuffle_" in p}

    before = shuffles()
    table = written(spark.range(10_000).groupBy((F.col("id") % 97).alias("k")).count(), str(tmp_path / "table"))
    assert not shuffles() - before
    assert table.count() == 97
