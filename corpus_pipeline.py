"""From raw documents to token ids: language, repeated lines, near copies, mixture, tokens.

Every stage takes the session, the documents its predecessor kept and the folder of the tables, and returns
what it keeps, with the columns of documents; the last returns token ids. ``run`` writes each stage's result
to the shared folder and reads it again for the next. SQL cannot express the stages that are trained or
tokenize, so there is no SQL for the whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmart.llm import byte_bpe, language_id, line_dedup, mixing, order_minhash
from quillmart.llm.common import stored
from quillmart.llm.production import TARGETS, domains, table, vocabulary

MIN_LANGUAGE_SCORE = 0.5


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without a letter, or too unlike any language, go.

    NULL texts go, repeated rows fare alike, an empty table stays empty. Without any label all with a letter stay.
    """
    model = language_id.fit(docs, F.lit(True))
    return language_id.accepted(docs, model, MIN_LANGUAGE_SCORE)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that come earlier, long ones also within one edit; those left without a word go.

    NULL texts go, rows that repeat an id and a text get equal texts, an empty table stays empty.
    """
    left = line_dedup.dedup(docs, short_repeats=True).filter(F.col("text").rlike(r"\S"))
    return left.withColumn("n_chars", F.char_length("text").cast("long"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each class of near copies.

    Of rows that repeat an id and a text one stays; rows without an id stay, as do NULL texts. An empty table stays
    empty.
    """
    return order_minhash.one_of_each(docs)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents taken by their rates, none more than once.

    NULL texts have no tokens and the rate of the prior; repeated rows fare alike; an empty table stays empty.
    """
    mixed = mixing.mix(docs, domains(table(spark, sf_dir, "labels")), TARGETS, most=1.0)
    return mixing.take(docs, mixed)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text.

    A NULL text has no ids; repeated rows get equal ids; an empty table stays empty.
    """
    coded = byte_bpe.encode_documents(docs, *vocabulary())
    return coded.select(
        "doc_id",
        "lang",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        (F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("decodes"),
    )


STAGES = [
    ("language id", keep_known_languages),
    ("line dedup", drop_repeated_lines),
    ("near dedup", keep_one_of_near_copies),
    ("mixing", mix_to_targets),
    ("byte bpe", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
