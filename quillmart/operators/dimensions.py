"""Roll-ups of the two dimension hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sub_genre_counts(genre: DataFrame, sub_genres: DataFrame) -> DataFrame:
    """Sub-genres per genre, zero for a genre without any."""
    counts = sub_genres.groupBy("genre_title").agg(F.count("*").alias("n_sub_genres"))
    return (
        genre.select("genre_title")
        .join(counts, "genre_title", "left")
        .select("genre_title", F.coalesce("n_sub_genres", F.lit(0)).alias("n_sub_genres"))
    )


def region_rollup(states: DataFrame) -> DataFrame:
    """States per division of each region."""
    return states.groupBy("region", "division").agg(F.count("*").alias("n_states"))
