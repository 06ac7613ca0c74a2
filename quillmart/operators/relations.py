"""Derived relations the other operators build on.

Keys: ``order_id`` in orders, ``book_id`` in books, ``genre_id`` in genre, ``publisher_id`` in
publisher and ``customer_id`` in customer are unique. Titles and names are not.

Dimension joins carry no broadcast hint, as dimensions grow with the data. Spark broadcasts a side
when its file size, or under AQE its measured shuffle size, is below the configured threshold, and
otherwise runs a sort-merge join whose hot partitions AQE splits. A genre's title meets the books, or
the winners of a ranking in a salted join, never the lines or their counts, which would be shuffled by
a handful of genres.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmart.functions import classify_average, classify_rating
from quillmart.operators.salting import salted_join


def only_customer(df: DataFrame, customer_id: int | None) -> DataFrame:
    """Rows of one customer, or all rows when no customer is given."""
    return df if customer_id is None else df.filter(F.col("customer_id") == int(customer_id))


def sales_lines(
    orders: DataFrame,
    order_details: DataFrame,
    customer_id: int | None = None,
    broadcast_orders: bool = False,
    lines: DataFrame | None = None,
) -> DataFrame:
    """Order lines with the columns of their order: the one fact-to-fact join.

    A look-up of one customer whose orders are known to be few saves the shuffle of all lines with
    ``broadcast_orders``. ``lines`` takes the stored result of ``sources.sinks.write_sales_lines``,
    which needs no join.
    """
    if lines is not None:
        return only_customer(lines, customer_id)
    own = only_customer(orders, customer_id)
    return order_details.join(F.broadcast(own) if broadcast_orders else own, "order_id")


def customer_book_details(
    orders: DataFrame,
    order_details: DataFrame,
    books: DataFrame,
    genre: DataFrame,
    customer_id: int | None = None,
    broadcast_orders: bool = False,
    lines: DataFrame | None = None,
) -> DataFrame:
    """One row per purchased line; a book bought twice appears twice."""
    catalogue = books.select("book_id", "title", "genre_id").join(genre, "genre_id")
    return (
        sales_lines(orders, order_details, customer_id, broadcast_orders, lines)
        .select("customer_id", "book_id")
        .join(catalogue, "book_id")
        .select("customer_id", "book_id", "title", "genre_title")
    )


def customer_frequent_genre(
    orders: DataFrame,
    order_details: DataFrame,
    books: DataFrame,
    genre: DataFrame,
    customer_id: int | None = None,
    broadcast_orders: bool = False,
    lines: DataFrame | None = None,
) -> DataFrame:
    """Genres bought most often by each customer, counted in lines; ties are kept."""
    bought = sales_lines(orders, order_details, customer_id, broadcast_orders, lines)
    kinds = genre_kinds(genre)
    return with_titles(most_frequent_kind(lines_by_kind(bought, books, kinds)), kinds).select(
        "customer_id", "genre_title", "genre_count"
    )


def genre_kinds(genre: DataFrame) -> DataFrame:
    """Every genre with its ``kind_id``: the smallest id among the genres that share its title.

    Ids of one title become one id while they are still in the catalogue, so that lines are counted and
    counts are ranked without a title.
    """
    same_title = Window.partitionBy("genre_title")
    return genre.select(
        "genre_id", "genre_title", F.min("genre_id").over(same_title).alias("kind_id")
    )


def books_by_kind(books: DataFrame, kinds: DataFrame) -> DataFrame:
    """``books`` of a known genre with their ``kind_id``, not gathered by their few genres."""
    return salted_join(books, kinds.select("genre_id", "kind_id"), "genre_id", "book_id")


def lines_by_kind(lines: DataFrame, books: DataFrame, kinds: DataFrame) -> DataFrame:
    """``customer_id``, ``book_id`` and ``kind_id`` of every line of a known book."""
    catalogue = books_by_kind(books.select("book_id", "genre_id"), kinds)
    return lines.select("customer_id", "book_id").join(
        catalogue.select("book_id", "kind_id"), "book_id"
    )


def most_frequent_kind(purchases: DataFrame) -> DataFrame:
    """``customer_id``, ``kind_id`` and ``genre_count`` of the genres bought most often, ties kept.

    The window's groups hold at most one row per title however many lines a customer has.
    """
    counts = purchases.groupBy("customer_id", "kind_id").agg(F.count("*").alias("genre_count"))
    by_count = Window.partitionBy("customer_id").orderBy(F.desc("genre_count"))
    return counts.withColumn("rnk", F.rank().over(by_count)).filter(F.col("rnk") == 1).drop("rnk")


def with_titles(winners: DataFrame, kinds: DataFrame) -> DataFrame:
    """Rows of customers with the ``genre_title`` of their ``kind_id``."""
    titles = kinds.filter(F.col("genre_id") == F.col("kind_id")).select("kind_id", "genre_title")
    return salted_join(winners, titles, "kind_id", "customer_id")


def book_sales(lines: DataFrame) -> DataFrame:
    """Copies sold per book, combined on the map side before the shuffle."""
    return lines.groupBy("book_id").agg(F.sum("quantity").alias("total_book_sales"))


def best_sellers_by_genre(
    order_details: DataFrame, books: DataFrame, genre: DataFrame
) -> DataFrame:
    """The book or books of each genre that reach the genre's highest total.

    The highest total is an aggregate joined back on (genre, total): a rank window would sort all
    tied books of a genre in one task. Both uses of the totals read the same shuffle.
    """
    totals = book_sales(order_details).join(
        books.select("book_id", "title", "genre_id"), "book_id"
    )
    highest = totals.groupBy("genre_id").agg(F.max("total_book_sales").alias("total_book_sales"))
    return (
        totals.join(highest, ["genre_id", "total_book_sales"])
        .join(genre, "genre_id")
        .select("genre_id", "genre_title", "title", "book_id", "total_book_sales")
    )


def customer_avg_value(
    orders: DataFrame, customer: DataFrame, customer_id: int | None = None
) -> DataFrame:
    """Mean order value per customer, not rounded. The money is summed exactly, then divided."""
    averages = (
        only_customer(orders, customer_id)
        .groupBy("customer_id")
        .agg(mean_amount().alias("avg_order_value"))
    )
    return with_names(averages, customer)


def customer_total_orders(orders: DataFrame, customer_id: int | None = None) -> DataFrame:
    """Number of orders per customer."""
    return (
        only_customer(orders, customer_id)
        .groupBy("customer_id")
        .agg(F.count("*").alias("total_orders"))
    )


def review_sentiment(reviews: DataFrame) -> DataFrame:
    """Every rated review with its label."""
    return reviews.withColumn("review_classification", classify_rating(F.col("rating"))).filter(
        F.col("review_classification").isNotNull()
    )


def review_totals(reviews: DataFrame) -> DataFrame:
    """Review count, mean rating and its label per reviewed book id."""
    return (
        reviews.groupBy("book_id")
        .agg(F.count("*").alias("total_reviews"), F.avg("rating").alias("avg_rating"))
        .withColumn("review_classification", classify_average(F.col("avg_rating")))
    )


def reviews_per_book(reviews: DataFrame, books: DataFrame) -> DataFrame:
    """Review count, mean rating and its label per reviewed book."""
    return (
        review_totals(reviews)
        .join(books.select("book_id", "title"), "book_id")
        .select("book_id", "title", "total_reviews", "avg_rating", "review_classification")
    )


def known_books(rows: DataFrame, books: DataFrame) -> DataFrame:
    """Rows whose book is in the catalogue.

    An inner join on the key: a semi join would be pushed through the aggregation that made the
    rows, down to the lines.
    """
    return rows.join(books.select("book_id"), "book_id")


def mean_amount() -> Column:
    """Mean of the non-NULL order amounts of a group; NULL when there is none."""
    return F.try_divide(F.sum("total_amount").cast("double"), F.count("total_amount"))


def with_names(values: DataFrame, customer: DataFrame) -> DataFrame:
    """Rows keyed by customer, names joined in after the key."""
    names = customer.select("customer_id", "first_name", "last_name")
    rest = [c for c in values.columns if c != "customer_id"]
    return values.join(names, "customer_id").select(
        "customer_id", "first_name", "last_name", *rest
    )
