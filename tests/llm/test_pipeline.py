import collections

import pytest
from pyspark.sql import functions as F
from rows import DDL, empty, rows
from test_dedup import brute_cut, near_rows

import corpus_pipeline


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(near_rows(), DDL).repartition(4).write.parquet(at + "/documents.parquet")
    return at


def test_stages_in_turn(spark, source):
    docs = spark.read.parquet(source + "/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, source)
        if name != "packing":
            assert docs.columns == before.columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen[name] = docs
    kept = {r["doc_id"] for r in seen["quality"].collect()}
    assert 1 in kept and not kept & {5, 6, 7, 11}
    left = {r["doc_id"] for r in seen["near_duplicates"].collect()}
    assert 1 in left and not left & {2, 3} and len([i for i in left if i and 300 <= i < 390]) < 90
    given = seen["near_duplicates"].collect()
    cut = [c[0].decode(errors="ignore") for c in brute_cut([r["text"] for r in given])]
    got = collections.Counter((r["doc_id"], r["text"], r["n_chars"]) for r in seen["repeated_passages"].collect())
    assert got == collections.Counter((r["doc_id"], t, len(t)) for r, t in zip(given, cut))
    packed = seen["packing"].collect()
    assert {r["doc_id"] for r in packed} == left


CLASHING = ("kept", "found", "distance", "n_words", "base_failed", "given", "__k1", "__terms", "n_links", "n_dup_lines", "k1")


def test_clashing_columns_come_out_unchanged(spark, source):
    docs = spark.read.parquet(source + "/documents.parquet").drop("kept", "score")
    docs = docs.withColumns({c: F.concat(F.lit(c + " "), F.col("doc_id").cast("string")) for c in CLASHING})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, source)
        assert out.dtypes == docs.dtypes, name
        got = out.select("doc_id", *CLASHING).collect()
        assert got
        for r in got:
            assert all(r[c] == (None if r["doc_id"] is None else f"{c} {r['doc_id']}") for c in CLASHING), name


def test_run_gives_the_last_stage(spark, source):
    out = corpus_pipeline.run(spark, source).collect()
    assert out and set(out[0].asDict()) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}


def test_an_empty_table_gives_an_empty_result(spark, tmp_path):
    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert rows()
