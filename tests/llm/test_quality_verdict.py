"""The quality operator's verdict: against a minimum covariance determinant in numpy, and on planted junk per statistic."""

import random

import numpy as np
import pytest
from plans import nodes
from rows import words

from tablediff.llm import quality as q

DDL = "doc_id long, text string, lang string, source string"


def percentile(values, share):
    return np.quantile(values, share)


def estimate(rows, factor):
    mean = rows.mean(axis=0)
    cov = factor * ((rows.T @ rows) / len(rows) - np.outer(mean, mean)) + np.diag([(f * q.GRID) ** 2 for f in q.FLOOR])
    return mean, cov


def distances(x, mean, cov):
    d = x - mean
    return np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)


def robust(x):
    """The reweighted estimate of the start that ends with the smallest determinant."""
    floor = np.array([(f * q.GRID) ** 2 for f in q.FLOOR])
    centres = [np.array([percentile(c, share) for c in x.T]) for share in q.CENTRES]
    spread = np.array([1.4826 * percentile(abs(c - m), 0.5) for c, m in zip(x.T, centres[0])])
    starts = [(m, np.diag(spread**2 + floor)) for m in centres] + [(centres[0], np.diag(floor))]
    best = None
    for mean, cov in starts:
        last = np.inf
        while True:
            step = np.floor(16 * np.log2(1 + distances(x, mean, cov)))
            core = x[step <= percentile(step, q.CORE)]
            new = estimate(core, q.CORE_FACTOR)
            det = np.linalg.slogdet(new[1])[1]
            if det >= last - 1e-9:
                break
            (mean, cov), last = new, det
        if best is None or last < best[0]:
            best = (last, mean, cov)
    return estimate(x[distances(x, *best[1:]) <= q.REWEIGHT], q.REWEIGHT_FACTOR)


def prose(rng, n=90):
    text = words(rng, n, "abcdefghijklmnop")
    if rng.random() < 0.3:
        text += " (5%)"
    return text.replace(" ", "\n", rng.randint(0, 4))


def junk(kind, rng):
    if kind == "symbols":
        return " ".join(w + rng.choice(["##", "*|*", "<$>"]) for w in words(rng, 60).split())
    if kind == "word length":
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(14, 22))) for _ in range(60))
    if kind == "repeated lines":
        menu = ["home", "login", "about us", "next page"]
        return "\n".join(rng.choice(menu) if k % 2 else words(rng, 4) for k in range(50))
    passage = words(rng, 11)
    return words(rng, 30) + " " + passage + " " + words(rng, 20) + " " + passage + " " + words(rng, 22)


KINDS = ("symbols", "word length", "repeated lines", "repeated words")


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(11)
    rows = [(k, prose(rng, rng.randint(60, 140)), "en" if k % 2 else "de", "web") for k in range(800)]
    for j, kind in enumerate(KINDS):
        rows += [(1000 * (j + 1) + k, junk(kind, rng), "en" if k % 2 else "de", "web") for k in range(20)]
    return q.quality_rules(spark.createDataFrame(rows, DDL)).collect()


def test_junk_is_rejected_by_each_statistic_and_prose_is_kept(judged):
    clean = [r["kept"] for r in judged if r["doc_id"] < 1000]
    assert sum(clean) >= 0.95 * len(clean)
    for j, kind in enumerate(KINDS):
        rows = [r for r in judged if r["doc_id"] // 1000 == j + 1]
        assert len(rows) == 20
        by_method = [r for r in rows if not r["base_failed"]]
        assert len(by_method) >= 18, kind  # the base rules don't decide these
        assert sum(not r["kept"] for r in by_method) >= 0.9 * len(by_method), kind


def test_distances_equal_a_plain_computation(judged):
    for lang in ("en", "de"):
        rows = [r for r in judged if r["lang"] == lang and not r["base_failed"]]
        logs = [
            (
                np.log(max(r["word_chars"], 1) / max(r["n_words"], 1)),
                np.log1p(100 * r["n_symbols"] / max(r["word_chars"], 1)),
                np.log1p(100 * r["n_dup_lines"] / max(r["n_words"], 1)),
                np.log1p(100 * r["n_repeat_words"] / max(r["n_words"], 1)),
            )
            for r in rows
        ]
        x = np.floor(q.GRID * np.array(logs) + 0.5)
        want = distances(x, *robust(x))
        assert np.allclose([r["distance"] for r in rows], want, rtol=1e-4, atol=1e-4)
        assert [r["kept"] for r in rows] == [bool(d <= q.LIMIT) for d in want]


def test_a_concentration_step_broadcasts_the_estimates_alone(spark):
    rng = random.Random(13)
    rows = [(g, *(rng.randint(0, 90) for _ in q.DIMS), rng.randint(1, 4)) for g in ("a", "b") for _ in range(151)]
    cells = spark.createDataFrame(rows, ["grp", *q.DIMS, "n"]).groupBy("grp", *q.DIMS).agg(q.F.sum("n").alias("n"))
    estimates = spark.createDataFrame(q._starts(cells).collect())
    step = q._concentrate(cells, estimates)
    found = step.collect()
    assert len(nodes(step, "BroadcastExchange")) <= 1
    for r in found:
        x = np.array([c[1:5] for c in rows if c[0] == r["grp"] for _ in range(c[5])], float)
        e = next(e for e in estimates.collect() if (e["grp"], e["start"]) == (r["grp"], r["start"]))
        w = np.array([[e[f"w{i}{j}"] if j <= i else 0 for j in range(4)] for i in range(4)])
        d = (((x - [e[f"m{i}"] for i in range(4)]) @ w.T) ** 2).sum(1)
        ring = np.floor(16 * np.log2(1 + d))
        mean, _ = estimate(x[ring <= percentile(ring, q.CORE)], q.CORE_FACTOR)
        assert np.allclose([r[f"m{i}"] for i in range(4)], mean)
    assert len(found) == len(estimates.collect())
