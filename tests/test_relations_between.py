"""Results that must agree with one another, on the smallest test tables."""

from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmart.operators import customers, demographics, recommend, relations, reviews, sales
from quillmart.sources.synthetic import SyntheticStar

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def star(spark):
    return SyntheticStar(spark, SF_DIR)


def _purchases(star):
    return star.orders, star.order_details, star.books, star.genre


def test_mean_gap_equals_the_gaps_one_by_one(star):
    previous = F.lag("order_date").over(Window.partitionBy("customer_id").orderBy("order_date"))
    expected = (
        star.orders.withColumn("gap", F.datediff("order_date", previous))
        .filter("gap IS NOT NULL")
        .groupBy("customer_id")
        .agg(F.round(F.avg("gap"), 2))
    )
    assert sorted(rows(customers.avg_days_between_purchases(star.orders))) == sorted(
        rows(expected)
    )


def test_lifetime_value_equals_total_spend(star):
    value = customers.customer_lifetime_value(star.orders, star.customer)
    spend = customers.monetary(star.orders, star.customer)
    both = value.join(spend, "customer_id").select("life_time_value", "total_spend")
    assert all(abs(a - float(b)) <= 0.01 for a, b in rows(both))


def test_genre_and_book_sales_have_one_total(star):
    by_genre = sales.genre_sales_by_year(*_purchases(star), year=1998)
    by_book = sales.book_sales_by_year(star.orders, star.order_details, star.books, 1998)
    assert sum(r[2] for r in rows(by_genre)) == sum(r[2] for r in rows(by_book)) > 0


def test_shares_add_up(star):
    for df in demographics.demographics(star.customer).values():
        assert sum(r[2] for r in rows(df)) == pytest.approx(100)


def test_recommended_are_unowned_best_sellers_of_the_favourite(star):
    got = {(r[0], r[3]) for r in rows(recommend.recommend_books(*_purchases(star)))}
    best = {(r[0], r[3]) for r in rows(recommend.preferred_genre_best_sellers(*_purchases(star)))}
    bought = {(r[0], r[1]) for r in rows(relations.customer_book_details(*_purchases(star)))}
    assert got == best - bought and got


def test_one_customer_equals_that_part_of_all(star):
    everyone = rows(recommend.recommend_books(*_purchases(star)))
    for customer_id in (everyone[0][0], everyone[-1][0]):
        alone = rows(recommend.recommend_books(*_purchases(star), customer_id=customer_id))
        assert alone == [r for r in everyone if r[0] == customer_id]


def test_publisher_revenue_is_amount_times_lines(star):
    revenue = sales.publisher_revenue(
        star.orders, star.order_details, star.books, star.publisher
    )
    lines = relations.sales_lines(star.orders, star.order_details)
    assert sum(r[1] for r in rows(revenue)) == lines.agg(F.sum("total_amount")).first()[0]


def test_best_and_worst_ordering_hold_the_same_rows(star):
    tables = (star.reviews, star.books, star.genre)
    best = rows(reviews.genre_sentiment(*tables))
    assert sorted(best) == sorted(rows(reviews.genre_sentiment(*tables, best=False)))


def test_sentiment_over_years_and_genres_counts_every_review(star):
    total = star.reviews.count()
    years = [rows(reviews.sentiment_by_year(star.reviews, y)) for y in (2024, 2025, 2026)]
    assert all(years)
    assert sum(r[1] for year in years for r in year) == total
    by_genre = reviews.genre_sentiment(star.reviews, star.books, star.genre, ordered=False)
    assert sum(r[2] for r in rows(by_genre)) == total
