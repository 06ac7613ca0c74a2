"""Review sentiment and activity. Reviews are counted per book or customer before any join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmart.functions import in_year
from quillmart.operators.relations import (
    known_books,
    review_sentiment,
    review_totals,
    with_names,
)


def sentiment_by_year(reviews: DataFrame, year: int) -> DataFrame:
    """Number of reviews per label in one year."""
    return (
        review_sentiment(reviews.filter(in_year(F.col("review_date"), int(year))))
        .groupBy("review_classification")
        .agg(F.count("*").alias("total_reviews"))
    )


def top_reviewers(reviews: DataFrame, customer: DataFrame, ordered: bool = True) -> DataFrame:
    """All reviewing customers with their number of reviews, most first."""
    counts = reviews.groupBy("customer_id").agg(F.count("*").alias("number_of_reviews_given"))
    named = with_names(counts, customer)
    return named.orderBy(F.desc("number_of_reviews_given"), "customer_id") if ordered else named


def top_reviewed_books(reviews: DataFrame, books: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` books with most reviews and the label of their mean rating.

    Titles are fetched for the chosen books only.
    """
    order = (F.desc("total_reviews"), F.asc("book_id"))
    chosen = known_books(review_totals(reviews), books).orderBy(*order).limit(n)
    return (
        chosen.join(books.select("book_id", "title"), "book_id")
        .orderBy(*order)
        .limit(n)
        .select("book_id", "title", "review_classification")
    )


def genre_sentiment(
    reviews: DataFrame,
    books: DataFrame,
    genre: DataFrame,
    best: bool = True,
    ordered: bool = True,
) -> DataFrame:
    """Reviews per genre and label, best labels first or worst labels first."""
    per_book = (
        review_sentiment(reviews)
        .groupBy("book_id", "review_classification")
        .agg(F.count("*").alias("reviews"))
    )
    counts = (
        per_book.join(books.select("book_id", "genre_id"), "book_id")
        .join(genre, "genre_id")
        .groupBy("genre_title", "review_classification")
        .agg(F.sum("reviews").alias("review_count"))
    )
    if not ordered:
        return counts
    label = F.desc("review_classification") if best else F.asc("review_classification")
    return counts.orderBy(label, F.desc("review_count"), "genre_title")
