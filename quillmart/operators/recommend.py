"""Explainable recommendations: favourite genre, its best sellers, minus what the customer owns.

Each operator answers for all customers in one job; ``customer_id`` narrows it to one. Orders without
a customer belong to nobody: they have no favourite genre, and no operator here returns a row for
them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmart.operators.relations import (
    best_sellers_by_genre,
    books_by_kind,
    genre_kinds,
    lines_by_kind,
    most_frequent_kind,
    only_customer,
    sales_lines,
    with_titles,
)
from quillmart.operators.salting import salted_join


def preferred_genre(frequent_genre: DataFrame, customer_id: int | None = None) -> DataFrame:
    """One favourite genre per customer; among equally frequent ones the first by title."""
    return (
        only_customer(frequent_genre, customer_id)
        .filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(F.min("genre_title").alias("genre_title"))
    )


def purchased_in_preferred_genre(
    orders: DataFrame,
    order_details: DataFrame,
    books: DataFrame,
    genre: DataFrame,
    customer_id: int | None = None,
    broadcast_orders: bool = False,
    lines: DataFrame | None = None,
) -> DataFrame:
    """The lines each customer bought inside the favourite genre.

    Both uses of the lines read one shuffle by book. Lines meet the favourite by customer and the id of
    the genre's title, without a title of their own.
    """
    bought = sales_lines(orders, order_details, customer_id, broadcast_orders, lines).select(
        "customer_id", "book_id"
    )
    kinds = genre_kinds(genre)
    favourite = _favourite_kind(most_frequent_kind(lines_by_kind(bought, books, kinds)), kinds)
    catalogue = books_by_kind(books.select("book_id", "genre_id", "title"), kinds)
    return (
        bought.join(catalogue, "book_id")
        .join(favourite, ["customer_id", "kind_id"])
        .select("customer_id", "book_id", "title", "genre_title")
    )


def _favourite_kind(winners: DataFrame, kinds: DataFrame) -> DataFrame:
    """``customer_id``, ``kind_id`` and ``genre_title`` of one favourite genre per customer."""
    first = F.min(F.struct("genre_title", "kind_id")).alias("first")
    known = with_titles(winners, kinds).filter(
        F.col("customer_id").isNotNull() & F.col("genre_title").isNotNull()
    )
    return known.groupBy("customer_id").agg(first).select("customer_id", "first.*")


def _offers(best: DataFrame, kinds: DataFrame) -> DataFrame:
    """Best sellers with the id of their genre's title."""
    named = kinds.filter(F.col("genre_title").isNotNull()).select("genre_id", "kind_id")
    return best.join(named, "genre_id")


def preferred_genre_best_sellers(
    orders: DataFrame,
    order_details: DataFrame,
    books: DataFrame,
    genre: DataFrame,
    customer_id: int | None = None,
    best_sellers: DataFrame | None = None,
    broadcast_orders: bool = False,
    lines: DataFrame | None = None,
) -> DataFrame:
    """Best sellers of the favourite genre, owned or not."""
    best = _best_sellers(best_sellers, order_details, books, genre)
    bought = sales_lines(orders, order_details, customer_id, broadcast_orders, lines)
    kinds = genre_kinds(genre)
    favourite = _favourite_kind(most_frequent_kind(lines_by_kind(bought, books, kinds)), kinds)
    offers = _offers(best, kinds).select("kind_id", "title", "book_id")
    return salted_join(favourite, offers, "kind_id", "customer_id").select(
        "customer_id", "genre_title", "title", "book_id"
    )


def recommend_books(
    orders: DataFrame,
    order_details: DataFrame,
    books: DataFrame,
    genre: DataFrame,
    customer_id: int | None = None,
    best_sellers: DataFrame | None = None,
    broadcast_orders: bool = False,
    lines: DataFrame | None = None,
) -> DataFrame:
    """Best sellers of the favourite genre that the customer does not own yet.

    One pass over the sales lines counts the purchases per customer and genre, with each best seller
    counted apart. The counts give both the favourite genre and the best sellers owned in it.

    Best sellers are marked in the catalogue, by genre and book, so that the lines are joined once by
    book with a side that has just been shuffled by book as well: AQE can split a hot book only in
    such a join. ``best_sellers`` takes a stored result of ``best_sellers_by_genre``. For a single
    customer the rows come best first.
    """
    best = _best_sellers(best_sellers, order_details, books, genre)
    kinds = genre_kinds(genre)
    marks = best.select("genre_id", "book_id", F.col("book_id").alias("owned_book_id"))
    marked = books.select("book_id", "genre_id").join(marks, ["genre_id", "book_id"], "left")
    counts = (
        sales_lines(orders, order_details, customer_id, broadcast_orders, lines)
        .filter(F.col("customer_id").isNotNull())
        .select("customer_id", "book_id")
        .join(books_by_kind(marked, kinds).drop("genre_id"), "book_id")
        .groupBy("customer_id", "kind_id", "owned_book_id")
        .agg(F.count("*").alias("lines"))
    )
    # A customer has one row per genre and owned best seller, so sending the rows to the customer is
    # safe, and it serves all windows.
    in_genre = Window.partitionBy("customer_id", "kind_id")
    by_count = Window.partitionBy("customer_id").orderBy(F.desc("genre_count"))
    by_title = Window.partitionBy("customer_id").orderBy("genre_title")
    winners = (
        counts.repartition("customer_id")
        .withColumn("genre_count", F.sum("lines").over(in_genre))
        .withColumn("rnk", F.rank().over(by_count))
        .filter(F.col("rnk") == 1)
        .select("customer_id", "kind_id", "owned_book_id")
    )
    # The first row of a customer brings the offers, every row a book owned, if it has one. A book
    # offered and not owned is recommended.
    first = F.row_number().over(by_title) == 1
    favourite = with_titles(winners, kinds).withColumn(
        "offered_kind", F.when(first, F.col("kind_id"))
    )
    wanted = ("genre_title", "title", "total_book_sales")
    offers = _offers(best, kinds).select(
        F.col("kind_id").alias("offered_kind"), "book_id", F.struct(*wanted).alias("offer")
    )
    offered = F.struct("book_id", F.lit(False).alias("owned"), "offer")
    owned = F.struct(
        F.col("owned_book_id").alias("book_id"),
        F.lit(True).alias("owned"),
        F.lit(None).cast(offers.schema["offer"].dataType).alias("offer"),
    )
    recommended = (
        salted_join(
            favourite.select("customer_id", "offered_kind", "owned_book_id"),
            offers, "offered_kind", "customer_id", "left",
        )
        .select("customer_id", F.inline(F.array(offered, owned)))
        .filter(F.col("book_id").isNotNull())
        .groupBy("customer_id", "book_id")
        .agg(F.bool_or("owned").alias("owned"), F.max("offer").alias("offer"))
        .filter(~F.col("owned"))
        .select("customer_id", "offer.genre_title", "offer.title", "book_id", "offer.total_book_sales")
    )
    if customer_id is None:
        return recommended
    return recommended.orderBy(F.desc("total_book_sales"), "title", "book_id")


def _best_sellers(
    stored: DataFrame | None, order_details: DataFrame, books: DataFrame, genre: DataFrame
) -> DataFrame:
    return best_sellers_by_genre(order_details, books, genre) if stored is None else stored
