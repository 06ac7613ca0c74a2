"""Every operator as a query over the synthetic tables, by name.

Each query reads whole tables. ``plans.oracle`` holds the SQL it is compared with.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from quillmart.operators import (
    customers,
    demographics,
    dimensions,
    recommend,
    relations,
    reviews,
    sales,
)
from quillmart.sources.synthetic import SyntheticStar

AS_OF = dt.date(2001, 8, 1)
CHURN_DAYS = 90
SALES_YEAR = 1998
REVIEW_YEAR = 2024
CUSTOMER = 7

Query = Callable[[SparkSession, str], DataFrame]


def _purchases(t: SyntheticStar) -> tuple[DataFrame, ...]:
    return t.orders, t.order_details, t.books, t.genre


def _favourite(t: SyntheticStar) -> DataFrame:
    return recommend.preferred_genre(relations.customer_frequent_genre(*_purchases(t)))


OPERATORS: dict[str, Callable[[SyntheticStar], DataFrame]] = {
    # derived relations
    "customer_book_details": lambda t: relations.customer_book_details(*_purchases(t)),
    "customer_frequent_genre": lambda t: relations.customer_frequent_genre(*_purchases(t)),
    "best_sellers_by_genre": lambda t: relations.best_sellers_by_genre(
        t.order_details, t.books, t.genre
    ),
    "customer_avg_value": lambda t: relations.customer_avg_value(t.orders, t.customer),
    "customer_total_orders": lambda t: relations.customer_total_orders(t.orders),
    "review_sentiment": lambda t: relations.review_sentiment(t.reviews),
    "reviews_per_book": lambda t: relations.reviews_per_book(t.reviews, t.books),
    # recommendation
    "preferred_genre": _favourite,
    "purchased_in_preferred_genre": lambda t: recommend.purchased_in_preferred_genre(
        *_purchases(t)
    ),
    "preferred_genre_best_sellers": lambda t: recommend.preferred_genre_best_sellers(
        *_purchases(t)
    ),
    "recommend_books": lambda t: recommend.recommend_books(*_purchases(t)),
    "purchased_in_preferred_genre_of_one": lambda t: recommend.purchased_in_preferred_genre(
        *_purchases(t), customer_id=CUSTOMER
    ),
    "recommend_books_of_one": lambda t: recommend.recommend_books(
        *_purchases(t), customer_id=CUSTOMER
    ),
    # customers
    "churn_risk": lambda t: customers.churn_risk(t.orders, CHURN_DAYS, AS_OF),
    "recency": lambda t: customers.recency(t.orders, AS_OF),
    "monetary": lambda t: customers.monetary(t.orders, t.customer),
    "monetary_of_one": lambda t: customers.monetary(t.orders, t.customer, CUSTOMER),
    "average_order_value": lambda t: customers.average_order_value(t.orders, t.customer),
    "customer_lifetime_value": lambda t: customers.customer_lifetime_value(t.orders, t.customer),
    "avg_days_between_purchases": lambda t: customers.avg_days_between_purchases(t.orders),
    "tenure": lambda t: customers.tenure(t.orders),
    # reviews
    "sentiment_by_year": lambda t: reviews.sentiment_by_year(t.reviews, REVIEW_YEAR),
    "top_reviewers": lambda t: reviews.top_reviewers(t.reviews, t.customer),
    "top_reviewed_books": lambda t: reviews.top_reviewed_books(t.reviews, t.books),
    "genre_sentiment_best": lambda t: reviews.genre_sentiment(t.reviews, t.books, t.genre),
    "genre_sentiment_worst": lambda t: reviews.genre_sentiment(
        t.reviews, t.books, t.genre, best=False
    ),
    # demographics
    "customer_scan": lambda t: demographics.customer_scan(t.customer),
    "gender_distribution": lambda t: demographics.gender_distribution(t.customer),
    "language_share": lambda t: demographics.language_share(t.customer),
    # sales
    "genre_sales_by_year": lambda t: sales.genre_sales_by_year(*_purchases(t), SALES_YEAR),
    "book_sales_by_year": lambda t: sales.book_sales_by_year(
        t.orders, t.order_details, t.books, SALES_YEAR
    ),
    "top_bottom_books": lambda t: sales.top_bottom_books(
        t.orders, t.order_details, t.books, SALES_YEAR
    ),
    "poorly_performing_books": lambda t: sales.poorly_performing_books(t.books, t.reviews),
    "poorly_performing_books_strict": lambda t: sales.poorly_performing_books(
        t.books, t.reviews, rating_below=3.6, negatives_above=20
    ),
    "declining_sales": lambda t: sales.declining_sales(t.orders, t.order_details, t.books),
    "publisher_revenue": lambda t: sales.publisher_revenue(
        t.orders, t.order_details, t.books, t.publisher
    ),
    # dimensions
    "sub_genre_counts": lambda t: dimensions.sub_genre_counts(t.genre, t.sub_genres),
    "region_rollup": lambda t: dimensions.region_rollup(t.states),
}


def queries() -> dict[str, Query]:
    return {name: _query(build) for name, build in OPERATORS.items()}


def _query(build: Callable[[SyntheticStar], DataFrame]) -> Query:
    return lambda spark, sf_dir: _doubles(build(SyntheticStar(spark, sf_dir)))


def _doubles(df: DataFrame) -> DataFrame:
    """Exact money as double, the type the SQL side returns."""
    decimals = [f.name for f in df.schema if isinstance(f.dataType, DecimalType)]
    return df.withColumns({c: F.col(c).cast("double") for c in decimals}) if decimals else df
