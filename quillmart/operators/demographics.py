"""Who the customers are: the customer table and shares of its attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmart.functions import gender_group


def customer_scan(customer: DataFrame) -> DataFrame:
    """All customers with all columns the source has."""
    return customer


def gender_distribution(customer: DataFrame, ordered: bool = True) -> DataFrame:
    """Male, Female and Others with their share of all customers in percent."""
    return _shares(
        customer.select(gender_group(F.col("gender")).alias("gender_grouped")), ordered
    )


def language_share(customer: DataFrame, ordered: bool = True) -> DataFrame:
    """Customers per preferred language with their share of those who state one, in percent."""
    return _shares(
        customer.select("preferred_language").filter(F.col("preferred_language").isNotNull()),
        ordered,
    )


def demographics(customer: DataFrame) -> dict[str, DataFrame]:
    """The breakdowns the customer table has columns for."""
    available = {
        "gender": ("gender_distribution", gender_distribution),
        "preferred_language": ("language_share", language_share),
    }
    return {
        name: breakdown(customer)
        for column, (name, breakdown) in available.items()
        if column in customer.columns
    }


def _shares(values: DataFrame, ordered: bool) -> DataFrame:
    """Count and percent per value, most frequent first.

    The grand total is a scalar subquery over the counts, so the counts are never gathered in one
    task as a window without partitions would do.
    """
    (column,) = values.columns
    counts = values.groupBy(column).agg(F.count("*").alias("customers"))
    total = counts.agg(F.sum("customers")).scalar()
    shares = counts.withColumn("percent", F.col("customers") * 100.0 / total)
    return shares.orderBy(F.desc("customers"), column) if ordered else shares
