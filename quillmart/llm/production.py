"""Tables and parameters that the queries and the pipeline run with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmart.llm import byte_bpe, token_alignment


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> tuple[bytes, str]:
    """Ranks and pattern of the vocabulary the queries use."""
    import public_tokenizers

    return (
        byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")),
        public_tokenizers.PATTERN,
    )


def aligned_models() -> tuple[bytes, bytes]:
    """The byte-level BPE and the sentencepiece model whose tokens are aligned."""
    import public_tokenizers

    return tuple(token_alignment.read_model(public_tokenizers.path(f)) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


#: Domains of the labels table, and their shares of the tokens.
TARGETS = {"clean": 0.88, "low": 0.08, "toxic": 0.04}


def domains(labels: DataFrame) -> DataFrame:
    """``id`` and ``domain`` of every labelled document."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")
    return labels.select(F.col("doc_id").alias("id"), domain.alias("domain"))
