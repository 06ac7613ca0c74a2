"""Sales performance and insights.

Lines are summed per book (and month) right after the order join; titles, genres and publishers meet
the sums, not the lines. A book with a third of all lines therefore reaches the shuffle as one row
per map task. ``lines`` takes stored lines, which carry their order (``sources.sinks.write_sales_lines``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmart.functions import in_year, percent_change, short_title
from quillmart.operators.relations import book_sales, known_books, sales_lines
from quillmart.schemas import SALES_YEAR


def genre_sales_by_year(
    orders: DataFrame,
    order_details: DataFrame,
    books: DataFrame,
    genre: DataFrame,
    year: int,
    ordered: bool = True,
    lines: DataFrame | None = None,
) -> DataFrame:
    """Copies sold per genre in one year, most first."""
    sales = (
        _year_sales(orders, order_details, year, lines)
        .join(books.select("book_id", "genre_id"), "book_id")
        .groupBy("genre_id")
        .agg(F.sum("total_book_sales").alias("total_books_sold"))
        .join(genre, "genre_id")
        .select("genre_id", "genre_title", "total_books_sold")
    )
    return sales.orderBy(F.desc("total_books_sold"), "genre_id") if ordered else sales


def book_sales_by_year(
    orders: DataFrame,
    order_details: DataFrame,
    books: DataFrame,
    year: int,
    ordered: bool = True,
    lines: DataFrame | None = None,
) -> DataFrame:
    """Copies sold per book in one year, most first. Books sharing a title stay apart."""
    sales = (
        _year_sales(orders, order_details, year, lines)
        .join(books.select("book_id", "title"), "book_id")
        .select("book_id", "title", "total_book_sales")
    )
    return sales.orderBy(F.desc("total_book_sales"), "book_id") if ordered else sales


def top_bottom_books(
    orders: DataFrame,
    order_details: DataFrame,
    books: DataFrame,
    year: int,
    n: int = 10,
    title_width: int = 35,
    lines: DataFrame | None = None,
) -> DataFrame:
    """First and last ``n`` books of the year's ranking, best first; all of them when fewer than 2n.

    Two opposite top-n selections over one total order overlap exactly when there are fewer than 2n
    books, and together they then hold every book. Titles are fetched for the chosen books only.
    """
    sales = known_books(_year_sales(orders, order_details, year, lines), books)
    top = sales.orderBy(F.desc("total_book_sales"), F.asc("book_id")).limit(n)
    bottom = sales.orderBy(F.asc("total_book_sales"), F.desc("book_id")).limit(n)
    chosen = top.unionByName(bottom).distinct()
    return (
        chosen.join(books.select("book_id", "title"), "book_id")
        .withColumn("title_short", short_title(F.col("title"), title_width))
        .select("book_id", "title", "title_short", "total_book_sales")
        .orderBy(F.desc("total_book_sales"), F.asc("book_id"))
        .limit(2 * n)
    )


def poorly_performing_books(
    books: DataFrame,
    reviews: DataFrame,
    rating_below: float = 3,
    negatives_above: int = 3,
    ordered: bool = True,
) -> DataFrame:
    """Books with a mean rating below the limit or more negative reviews than the limit.

    A book without reviews meets neither condition, so only reviewed books are looked at.
    """
    totals = reviews.groupBy("book_id").agg(
        F.count("review_id").alias("total_reviews"),
        F.avg("rating").alias("avg_rating"),
        F.sum(F.when(F.col("rating") <= 2, 1).otherwise(0)).alias("negative_review_count"),
    )
    poor = (
        totals.filter(
            (F.col("avg_rating") < rating_below)
            | (F.col("negative_review_count") > negatives_above)
        )
        .join(books.select("book_id", "title"), "book_id")
        .select("book_id", "title", "total_reviews", "avg_rating", "negative_review_count")
    )
    if not ordered:
        return poor
    return poor.orderBy(F.desc("negative_review_count"), F.asc("avg_rating"), "book_id")


def declining_sales(
    orders: DataFrame,
    order_details: DataFrame,
    books: DataFrame,
    threshold: float = -10,
    n: int = 10,
    lines: DataFrame | None = None,
) -> DataFrame:
    """The ``n`` steepest month-over-month falls of a book's sales beyond ``threshold`` percent.

    The month before is the last month in which the book sold, and months without sales do not
    exist. The window runs on one row per book and month, so the calendar bounds its groups.
    """
    monthly = (
        sales_lines(orders, order_details, lines=lines)
        .groupBy("book_id", F.trunc("order_date", "month").alias("month"))
        .agg(F.sum("quantity").alias("monthly_sales"))
    )
    previous = F.lag("monthly_sales").over(Window.partitionBy("book_id").orderBy("month"))
    order = (F.asc("sales_change"), F.asc("book_id"), F.asc("month"))
    declines = (
        monthly.withColumn("prev_month_sales", previous)
        .withColumn(
            "sales_change", percent_change(F.col("monthly_sales"), F.col("prev_month_sales"))
        )
        .filter(F.col("sales_change") < threshold)
    )
    steepest = known_books(declines, books).orderBy(*order).limit(n)
    return (
        steepest.join(books.select("book_id", "title"), "book_id")
        .select(
            "book_id",
            "title",
            F.date_format("month", "yyyy-MM-01").alias("month"),
            "monthly_sales",
            "prev_month_sales",
            "sales_change",
        )
        .orderBy(*order)
        .limit(n)
    )


def publisher_revenue(
    orders: DataFrame,
    order_details: DataFrame,
    books: DataFrame,
    publisher: DataFrame,
    ordered: bool = True,
    lines: DataFrame | None = None,
) -> DataFrame:
    """Order amounts per publisher, an order's whole amount counting once for each of its lines.

    The totals thus exceed the money taken whenever an order has several lines; this is the
    measure's definition and is kept.
    """
    per_book = (
        sales_lines(orders, order_details, lines=lines)
        .groupBy("book_id")
        .agg(F.sum("total_amount").alias("revenue"))
    )
    revenue = (
        per_book.join(books.select("book_id", "publisher_id"), "book_id")
        .groupBy("publisher_id")
        .agg(F.sum("revenue").alias("revenue"))
        .join(publisher, "publisher_id")
        .groupBy("publisher_name")
        .agg(F.sum("revenue").alias("publisher_revenue"))
    )
    return revenue.orderBy(F.desc("publisher_revenue"), "publisher_name") if ordered else revenue


def _year_sales(
    orders: DataFrame, order_details: DataFrame, year: int, lines: DataFrame | None
) -> DataFrame:
    """Copies per book in one year; of stored lines only the folder of the year is read."""
    if lines is not None:
        return book_sales(lines.filter(F.col(SALES_YEAR) == int(year)))
    in_orders = orders.filter(in_year(F.col("order_date"), int(year)))
    return book_sales(sales_lines(in_orders, order_details))
