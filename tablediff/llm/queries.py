"""The registered queries of this subpackage: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated passages of 200 bytes or more are cut out of every whole document."""
    from tablediff.llm.suffix_dedup import suffix_dedup_digest

    return suffix_dedup_digest(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole document, learned from the labelled ones that are not held out."""
    from tablediff.llm.language_id import held_out, identify

    docs = _table(spark, sf_dir, "documents")
    texts = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify(texts, docs.where(~held_out()).select("lang", "text")).select("doc_id", "held_out", "lang_pred", "score")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole document under piece_bpe_32k.model."""
    from tablediff.llm.token_counts import count_tokens

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, tokenizer_path("piece_bpe_32k.model")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document encoded with the pieces of piece_bpe_32k.model and decoded again."""
    from tablediff.llm.viterbi import round_trip

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs, tokenizer_path("piece_bpe_32k.model")).select("doc_id", "n_ids", "ids_crc32", "same_text")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdicts of every whole document."""
    from tablediff.llm.common import shared_dir, written
    from tablediff.llm.quality import MEASURES, judge, measure

    measured = measure(_table(spark, sf_dir, "documents")).select("doc_id", "lang", "source", *MEASURES)
    judged = judge(written(measured, shared_dir(spark) + "/measured"))
    return judged.select("doc_id", *MEASURES, "kept", "distance")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms of every whole document."""
    from tablediff.llm.pii import COLUMNS, find_pii, with_digest

    found = find_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return with_digest(found).select("doc_id", *COLUMNS)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents and their numbers of links."""
    from tablediff.llm.chosen_path import jaccard_classes

    return jaccard_classes(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and labels of every whole document."""
    from tablediff.llm.licenses import COLUMNS, license_scan

    return license_scan(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *COLUMNS)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens of word_bpe_49k.json."""
    from tablediff.llm.packing import best_fit_packing

    return best_fit_packing(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best partners of every fiftieth vector among all vectors."""
    from tablediff.llm.topk_search import voronoi_topk

    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return voronoi_topk(vectors, F.col("vec_id") % 50 == 0)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all whole documents with their near words' number, form and root."""
    from tablediff.llm.spelling import spelling_variants, vocabulary

    return spelling_variants(vocabulary(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers' tokens in every whole document, with the corpus-wide counts of linked ids."""
    from tablediff.llm.alignment import NEW, align

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return align(docs, "byte_bpe_50k.json", "piece_bpe_32k.model", keep_text=False).select("doc_id", *NEW)


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of every whole document stand in windows of benchmark items, by suffix arrays over the documents."""
    from tablediff.llm.decontaminate import contamination_digest

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination_digest(docs, _table(spark, sf_dir, "benchmark").select("item_id", "text"))


OP10_SQL = """
WITH ints AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT q.vec_id AS query_id, x.vec_id,
           CAST(list_sum(list_transform(generate_series(1, len(q.v)), lambda i: q.v[i] * x.v[i])) AS BIGINT) AS score
    FROM ints q JOIN ints x ON q.vec_id <> x.vec_id
    WHERE q.vec_id % 50 = 0
),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup,
        op2_language_id,
        op3_token_counts,
        op4_sentencepiece,
        op5_quality_rules,
        op6_pii,
        op7_ngram_jaccard_join,
        op8_license_scans,
        op9_best_fit_packing,
        op10_exact_topk_search,
        op11_spelling_variants,
        op12_tokenizer_alignment,
        op13_decontaminate,
    )
}

ORACLE_SQL = {
    "op10_exact_topk_search": OP10_SQL,
}
