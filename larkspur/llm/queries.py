"""The queries opN_<name> of this subpackage, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """A public tokenizer's file: under $LARKSPUR_TOKENIZERS, or as the installed package has it."""
    folder = os.environ.get("LARKSPUR_TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.unigram_pieces import encode_pieces

    return encode_pieces(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.substring_dedup import dedup_substrings

    out = dedup_substrings(table(spark, sf_dir, "documents"), 50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op3_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.lattice_likelihood import score_documents

    return score_documents(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.source_mix import mix_sources

    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm import cluster
    from larkspur.llm.token_store import read_tokens, write_tokens

    folder = cluster.shared_folder(spark) + "/tokens"
    write_tokens(table(spark, sf_dir, "documents"), folder, tokenizer_file("word_bpe_49k.json"), end_id=2)
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_subsequence_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.toxicity import fit_toxicity, score_toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score_toxicity(docs, fit_toxicity(docs, labels))


def op7_block_matrix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.vector_search import nearest_by_blocks

    return nearest_by_blocks(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op8_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.vector_search import top_products

    return top_products(table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


def op9_backward_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.suffix_dedup import dedup_bytes

    out = dedup_bytes(table(spark, sf_dir, "documents"), 200)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.ngram_join import join_similar

    return join_similar(table(spark, sf_dir, "documents"), n=4, percent=85)


def op11_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.best_fit import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=1)


def op12_voronoi_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.hard_negatives import mine_negatives

    rows = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    return mine_negatives(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)))


def op13_tsqr_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_unigram_pieces, op2_substring_dedup, op3_lattice_likelihood, op4_source_mix, op5_token_store, op6_subsequence_svm, op7_block_matrix_join, op8_ball_tree, op9_backward_extension, op10_ngram_join, op11_vector_best_fit, op12_voronoi_negatives, op13_tsqr_whitening, pipeline)}


WHOLE_VECTORS = """SELECT vec_id, label::BIGINT AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0"""

SQL = {
    "op2_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (SELECT doc_id, k, array_to_string(w[k : k + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM d)),
        again AS (SELECT doc_id, k FROM win JOIN (SELECT s, min(doc_id) AS first_id FROM win GROUP BY s) USING (s) WHERE first_id < doc_id),
        gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS i FROM again),
        words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
        lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(lost.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
        FROM d LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op8_ball_tree": f"""
        WITH e AS ({WHOLE_VECTORS})
        SELECT a.vec_id AS query_id, (row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.x, b.x) DESC, b.vec_id))::INT AS rank, b.vec_id, list_inner_product(a.x, b.x)::BIGINT AS score
        FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
        QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.x, b.x) DESC, b.vec_id) <= 5""",
    "op12_voronoi_negatives": f"""
        WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, x FROM ({WHOLE_VECTORS}) WHERE label IS NOT NULL),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score FROM e a, e b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10""",
}


def oracle_sql() -> dict[str, str]:
    return SQL
