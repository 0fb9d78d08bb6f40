"""Registered queries of the numbered operators: thin reports over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardflow.llm import (
    adaptive_rules,
    golay,
    intervals,
    periodic_runs,
    piece_codec,
    pivot_index,
    quality_model,
    source_audit,
    source_mix,
    token_counts,
    token_rows,
    unit_dedup,
    vector_packing,
)
from hazardflow.llm.common import table, tokenizer_path

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query("op3_vector_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return vector_packing.packed_documents(docs, tokenizer_path("word_bpe_49k.json"))


@query("op8_token_rows")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sequence: the segments as they are, the matrices as checksums."""
    rows = token_rows.token_rows(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return rows.select(
        "sequence_id", "n_tokens", "n_segments", "cumulative", "doc_ids", "pieces",
        F.crc32("ids").alias("ids_crc32"), F.crc32("positions").alias("positions_crc32"),
    )


@query("op10_piece_codec")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = piece_codec.encoded(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return rows.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query("op4_golay_near")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = golay.near_groups(table(spark, sf_dir, "documents"))
    return rows.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


@query("op5_interval_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.report(table(spark, sf_dir, "documents"))


@query("op1_quality_model")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_adaptive_rules")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptive_rules.judged(table(spark, sf_dir, "documents")).drop("lang", "source")


@query("op6_unit_dedup", unit_dedup.REPORT_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_dedup.report(table(spark, sf_dir, "documents"), unit_dedup.SENTENCE, unit_dedup.LEAST)


@query(
    "op7_pivot_search",
    """
    WITH whole AS (
      SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    scored AS (
      SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
    WHERE rank <= 5
    """,
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return pivot_index.top_k(vectors, vectors.filter("vec_id % 50 = 0"))


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.report(periodic_runs.with_period(table(spark, sf_dir, "documents")))


@query("op12_source_mix")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.taken(table(spark, sf_dir, "documents"))


@query("op13_source_audit", source_audit.REPORT_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.report(table(spark, sf_dir, "documents"))
