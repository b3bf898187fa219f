import random

import numpy as np
from plans import exchanged
from pyspark.sql import functions as F
from rows import DDL, empty, frame, words

from tablediff.llm.language_id import ContextTrees, held_out, identify, learn, predict
from tablediff.llm.topk_search import voronoi_topk


def brute_topk(rows, k):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            good.setdefault(len(v), []).append((i, [int(np.floor(256 * float(x))) for x in v]))
    vectors = good[max(good, key=lambda n: (len(good[n]), n))]
    out = set()
    for q, v in vectors:
        if q % 5 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors if i != q)
            out |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:k])}
    return out


def test_topk_equals_brute_force(spark):
    rng = random.Random(31)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(400)]
    rows += [(400 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(120)]  # ties, and one crowded cell
    rows += [(1000, None), (1005, []), (1010, [None] * 6), (1015, [float("nan")] * 6), (1020, [float("inf")] + [0.0] * 5)]
    rows += [(1025, [1.0, 2.0]), (None, [0.5] * 6), (1030, [0.0] * 6)]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<float>, score string")
    as_float = [(i, None if v is None else [None if x is None else np.float32(x) for x in v]) for i, v in rows]
    out = voronoi_topk(df.repartition(4), F.col("vec_id") % 5 == 0)
    assert {tuple(r) for r in out.collect()} == brute_topk(as_float, 5)
    assert voronoi_topk(df.limit(0), F.lit(True)).count() == 0
    few = df.where("vec_id < 3")
    assert {tuple(r)[:3] for r in voronoi_topk(few, F.col("vec_id") == 0).collect()} <= {(0, 1, 1), (0, 1, 2), (0, 2, 1), (0, 2, 2)}


def brute_bits(text, training):
    """PPM with escapes, straight from the counts of all runs of four bytes."""
    runs = {}
    for t in training:
        raw = b"\n\n\n" + t.encode()
        for i in range(3, len(raw)):
            runs[raw[i - 3 : i + 1]] = runs.get(raw[i - 3 : i + 1], 0) + 1
    counts = [{} for _ in range(4)]
    for run, n in runs.items():
        for order in range(4):
            own = counts[order].setdefault(run[3 - order : 3], {})
            own[run[3]] = own.get(run[3], 0) + n
    bits, raw = 0.0, b"\n\n\n" + text.encode()
    for i in range(3, len(raw)):
        for order in (3, 2, 1, 0):
            own = counts[order].get(raw[i - order : i])
            if own is None:
                continue
            total = sum(own.values()) + len(own)
            if raw[i] in own:
                bits -= np.log2(own[raw[i]] / total)
                break
            bits -= np.log2(len(own) / total)
        else:
            bits += 8
    return bits


def test_code_lengths_equal_the_definition(spark):
    rng = random.Random(32)
    training = {"en": [words(rng, 200, "etaoin") for _ in range(3)], "de": [words(rng, 200, "ensirü") for _ in range(3)]}
    docs = spark.createDataFrame([(lang, t) for lang, ts in training.items() for t in ts], "lang string, text string")
    trees = learn(docs)
    assert trees.languages == ["de", "en"]
    import pyarrow as pa

    given = [words(rng, 40, "etaoin"), words(rng, 40, "ensirü"), "zzz", "", "日本語 q"]
    bits = trees.text_lengths(pa.array([g.encode() for g in given]))
    for row, text in zip(bits, given):
        for k, lang in enumerate(trees.languages):
            assert abs(row[k] - brute_bits(text, training[lang])) < 1e-2 * max(1, row[k])


def test_long_texts_are_worked_on_in_strips(spark, monkeypatch):
    import pyarrow as pa

    from tablediff.llm import language_id

    rng = random.Random(33)
    docs = spark.createDataFrame([("en", words(rng, 300))], "lang string, text string")
    trees = learn(docs)
    text = pa.array([words(rng, 500).encode()])
    whole = trees.text_lengths(text)
    strips = language_id._strips
    monkeypatch.setattr(language_id, "_strips", lambda t, most=100: strips(t, most))
    assert np.allclose(whole, trees.text_lengths(text), rtol=1e-6)


def test_predictions_of_all_rows(spark):
    rng = random.Random(34)
    labelled = [(i, words(rng, 60, a), lang, "s", 0, "", "") for i in range(40) for lang, a in (("en", "etaoin"), ("de", "üörsch"))]
    trees = learn(spark.createDataFrame(labelled, DDL))
    docs = frame(spark)
    out = predict(docs, trees)
    assert out.columns == [*[c for c in docs.columns if c != "score"], "lang_pred", "score"]
    by_id = {r["doc_id"]: r for r in out.collect()}
    assert {i for i, r in by_id.items() if r["lang_pred"] == "und"} == {5, 6, 12}
    assert all(0 <= r["score"] <= 1 for r in by_id.values())
    new = [(i, words(rng, 30, a), lang, "s", 0, "", "") for i, (lang, a) in enumerate((("en", "etaoin"), ("de", "üörsch")) * 10)]
    held = predict(spark.createDataFrame(new, DDL), trees).collect()
    assert all(r["lang_pred"] == r["lang"] for r in held)
    nothing = predict(docs, learn(empty(spark))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"} and {r["score"] for r in nothing} == {0.0}
    assert predict(empty(spark), trees).count() == 0


def test_held_out_is_a_fifth_by_checksum(spark):
    import zlib

    out = spark.range(50).select("id", held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in out)


def test_a_model_keeps_within_its_bound(spark):
    rng = random.Random(35)
    docs = spark.createDataFrame([("en", words(rng, 400)), ("de", words(rng, 400, "üöä"))], "lang string, text string")
    trees = learn(docs, max_runs=100)
    assert isinstance(trees, ContextTrees) and len(trees.known) <= 100


def test_every_run_counts_with_many_languages(spark):
    import pyarrow as pa

    rng = random.Random(36)
    training = {f"l{i:03}": ["few words"] for i in range(298)}
    training |= {"de": [words(rng, 900, "abcdefgäöü") for _ in range(2)], "en": [words(rng, 900) for _ in range(2)]}
    given = [(lang, t) for lang, ts in training.items() for t in ts]
    docs = spark.createDataFrame(given, "lang string, text string")
    runs = {t.encode()[i : i + 4] for t in training["en"] for i in range(len(t) - 3)}
    assert len(runs) > 2 * ((1 << 18) // len(training))
    trees = learn(docs)
    for lang in ("de", "en"):
        text = training[lang][1][:900]
        got = trees.text_lengths(pa.array([text.encode()]))[0, trees.languages.index(lang)]
        assert abs(got - brute_bits(text, training[lang])) < 1e-2


def test_identify_equals_one_model_in_memory(spark, monkeypatch):
    from tablediff.llm import language_id

    monkeypatch.setattr(language_id, "SCORED", 4000)  # texts of many strips
    rng = random.Random(37)
    labelled = [(i, words(rng, 60, a), lang, "s", 0, "", "") for i in range(20) for lang, a in (("en", "etaoin"), ("de", "etiörsch"), ("fr", "etüaé"))]
    training = spark.createDataFrame(labelled, DDL)
    new = [(100 + i, words(rng, 3, "etaoiné"), "en", "s", 0, "", "") for i in range(60)]
    docs = frame(spark).unionByName(spark.createDataFrame(new, DDL)).unionByName(training.limit(10))
    out = identify(docs, training)
    want = predict(docs, learn(training))
    assert out.columns == want.columns
    rounded = lambda d: sorted(map(str, d.withColumn("score", F.round("score", 3)).collect()))
    assert rounded(out) == rounded(want)
    nothing = identify(docs, empty(spark)).collect()
    assert len(nothing) == docs.count() and {r["lang_pred"] for r in nothing} == {"und"}
    assert identify(empty(spark), training).count() == 0


def test_packed_texts_are_not_exchanged(spark, monkeypatch):
    from tablediff.llm import language_id

    monkeypatch.setattr(language_id, "SCORED", 4000)
    docs = frame(spark)
    before = {t.name for t in spark.catalog.listTables()}
    out = identify(docs, docs)
    assert len(out.collect()) == docs.count()
    assert exchanged(out, "run") > 0 and exchanged(out, "rows") == 0
    assert {t.name for t in spark.catalog.listTables()} == before
