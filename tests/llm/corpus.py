"""Awkward documents and vectors, and plain answers to compare with."""

import random

from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"

LONG = " ".join(f"word{i % 977} of{i}" for i in range(20_000))
PROSE = "the small engine reads every line of the text and counts the words that it holds again and again"

DOCS = [
    (1, None, "en", "a"),
    (2, "", "en", None),
    (3, " \n\t \n", None, "a"),
    (4, "short", "en", "b"),
    (5, LONG, "en", "b"),
    (6, f"{PROSE}\n{PROSE} once more", "en", "b"),
    (7, f"{PROSE}\n{PROSE} once more", None, None),
    (7, f"{PROSE}\n{PROSE} once more", None, None),
    (None, "a text whose row has no id at all, with enough words to be compared", "en", "c"),
    (9, "été über señor \U0001f600\U0001f601 ﬁn 12½ and a few more words", "fr", "c"),
    (10, "x" * 5000, "en", "c"),
    (11, "###***!!!\n###***!!!", "en", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"

#: Names that the operators use inside.
CLASHING = "id same row pos h key at n label score text_ words kept vec a b component other bytes left size copies rate"


def documents(spark, rows=DOCS):
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in CLASHING.split():
        docs = docs.withColumn(name, F.lit(name))
    return docs.withColumn("odd `name`.x", F.lit(None).cast("string"))


def no_documents(spark):
    return documents(spark, [])


def table(spark, name):
    return spark.read.parquet(f"{SF_DIR}/{name}.parquet")


def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in table(spark, "documents").select("doc_id", "text").collect()}


def random_words(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(n)]
