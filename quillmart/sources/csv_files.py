"""Readers for the comma-separated exports.

Every reader declares its schema, checks the file's header against it and fails on a malformed row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from quillmart import schemas


def read_order_details(spark: SparkSession, path: str) -> DataFrame:
    """Order lines; the file's ``book id`` becomes ``book_id``."""
    return _read(
        spark,
        path,
        {
            "order_id": LongType(),
            "book id": LongType(),
            "quantity": IntegerType(),
            "discount": IntegerType(),
        },
        schemas.ORDER_DETAILS,
    )


def read_genre_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Genres with their stated number of sub-genres."""
    return _read(
        spark,
        path,
        {"Title": StringType(), "Number of Sub-genres": IntegerType()},
        schemas.GENRE_SIZES,
    )


def read_sub_genres(spark: SparkSession, path: str) -> DataFrame:
    """Sub-genres and their genre. A sub-genre title may occur under several genres."""
    return _read(
        spark, path, {"Title": StringType(), "Main Genre": StringType()}, schemas.SUB_GENRES
    )


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """States with division and region."""
    return _read(
        spark,
        path,
        {
            "State": StringType(),
            "State Code": StringType(),
            "Region": StringType(),
            "Division": StringType(),
            "Region_code": StringType(),
        },
        schemas.STATES,
    )


def _read(spark: SparkSession, path: str, header: dict, schema: StructType) -> DataFrame:
    in_file = StructType([StructField(name, dtype) for name, dtype in header.items()])
    return (
        spark.read.schema(in_file)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .option("escape", '"')
        .csv(path)
        .toDF(*schema.names)
    )
