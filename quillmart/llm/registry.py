"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from quillmart.llm import (
    backoff_lm,
    byte_bpe,
    hard_negatives,
    language_id,
    line_dedup,
    mixing,
    multi_index,
    oracle,
    order_minhash,
    pii,
    projected_search,
    quality,
    suffix_dedup,
    token_alignment,
)
from quillmart.llm.production import TARGETS, aligned_models, domains, table, vocabulary

Query = Callable[[SparkSession, str], DataFrame]


def op1_projected_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projected_search.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = order_minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id") == F.col("class_id"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = language_id.held_out("doc_id", 4, 2)
    model = language_id.fit(docs, ~held_out)
    return language_id.predict(docs, model).withColumn("held_out", held_out)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = language_id.held_out("id", 5, 0)
    scored = quality.score_documents(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out
    )
    return scored.select(
        F.col("id").alias("doc_id"),
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), domains(table(spark, sf_dir, "labels")), TARGETS)
    return mixed.select(
        F.col("id").alias("doc_id"),
        "n_tokens",
        *(F.col("posteriors")[j].alias(f"p_{d}") for j, d in enumerate(sorted(TARGETS))),
        "rate",
        "copies",
    )


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    lengths = F.zip_with("high", "low", lambda high, low: high - low)
    return found.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_removed"),
        F.size("low").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.summary(pii.detect(docs, pii.fit(docs)))


def op8_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.kept_lines(docs, short_repeats=True)
    return kept.select(
        F.col("row.c0").alias("doc_id"),
        F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"),
        F.char_length("kept_text").cast("long").alias("kept_chars"),
        F.sha2("kept_text", 256).alias("kept_sha256"),
    )


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), *vocabulary())


def op11_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = backoff_lm.score_documents(docs, ~language_id.held_out("doc_id", 10, 0))
    return scored.withColumns({"doc_id": F.col("id"), "held_out": ~F.col("learned")}).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    vectors = hard_negatives.whole_vectors(rows, 256.0, "vec_id", "embedding", "label")
    return hard_negatives.mine(vectors, F.col("id") % 100 == 0)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = token_alignment.inverted(table(spark, sf_dir, "documents"), *aligned_models())
    return token_alignment.document_scores(index).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Query]:
    operators = (
        op1_projected_search,
        op2_order_minhash,
        op3_language_id,
        op4_quality,
        op5_mixing,
        op6_suffix_dedup,
        op7_pii,
        op8_multi_index,
        op9_line_dedup,
        op10_byte_bpe,
        op11_backoff_lm,
        op12_hard_negatives,
        op13_token_alignment,
    )
    return {f.__name__: f for f in operators} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
