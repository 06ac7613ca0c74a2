"""The tables and derived relations as temporary views, for users who query them in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quillmart import schemas
from quillmart.operators import relations
from quillmart.sources import StarTables

SENTIMENT_BY_YEAR = """
    CREATE OR REPLACE TEMPORARY FUNCTION sentiment_by_year(year INT)
    RETURNS TABLE (review_classification STRING, total_reviews BIGINT)
    RETURN SELECT review_classification, COUNT(*) FROM review_sentiment
           WHERE review_date >= make_date(sentiment_by_year.year, 1, 1)
             AND review_date < make_date(sentiment_by_year.year + 1, 1, 1)
           GROUP BY review_classification"""


def derived_relations(star: StarTables) -> dict[str, DataFrame]:
    sales = (star.orders, star.order_details, star.books, star.genre)
    return {
        "customer_book_details": relations.customer_book_details(*sales),
        "customer_frequent_genre": relations.customer_frequent_genre(*sales),
        "best_sellers_by_genre": relations.best_sellers_by_genre(*sales[1:]),
        "customer_avg_value": relations.customer_avg_value(star.orders, star.customer),
        "customer_total_orders": relations.customer_total_orders(star.orders),
        "review_sentiment": relations.review_sentiment(star.reviews),
        "reviews_per_book": relations.reviews_per_book(star.reviews, star.books),
    }


def register_views(star: StarTables) -> None:
    """Register the seven tables and the seven derived relations under their names.

    ``sentiment_by_year(year)`` becomes a table function: ``SELECT * FROM sentiment_by_year(2022)``.
    """
    tables = {name: getattr(star, name) for name in schemas.TABLES}
    for name, df in (tables | derived_relations(star)).items():
        df.createOrReplaceTempView(name)
    star.reviews.sparkSession.sql(SENTIMENT_BY_YEAR)
