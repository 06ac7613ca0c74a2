from __future__ import annotations

import datetime as dt
import sys
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from quillmart import schemas  # noqa: E402
from quillmart.plans.session import local_session  # noqa: E402
from quillmart.sources import StarTables  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        4,
        app="tests",
        **{
            "spark.driver.memory": "4g",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df):
    """Rows as plain tuples in the order they come."""
    return [tuple(r) for r in df.collect()]


def day(text):
    return dt.date.fromisoformat(text)


def money(text):
    return Decimal(text)


@pytest.fixture
def make(spark):
    """make.orders([...]) and so on: one table from tuples in schema order."""

    class Make:
        def __getattr__(self, name):
            return lambda data: spark.createDataFrame(data, schemas.TABLES[name])

    return Make()


@pytest.fixture
def shop(make):
    """A few customers, two genres and every tie, gap and orphan the operators must get right.

    Fantasy: books 1 and 2 tie as best sellers. History: book 4. Books 1 and 5 share a title.
    Customer 10 buys as many fantasy as history lines. Customer 11 owns both fantasy best sellers.
    Customer 12 bought one history book twice in one order. Customer 13 never ordered.
    Order 106 has no lines; order 107's line names an unknown book.
    """
    return StarTables(
        orders=make.orders(
            [
                (101, 10, day("2023-01-05"), money("30.00")),
                (102, 10, day("2023-03-20"), money("12.50")),
                (103, 11, day("2023-03-01"), money("20.00")),
                (104, 11, day("2023-05-31"), money("10.01")),
                (105, 12, day("2024-02-29"), money("99.99")),
                (106, 12, day("2024-03-01"), money("5.00")),
                (107, 14, day("2022-12-31"), money("7.00")),
            ]
        ),
        order_details=make.order_details(
            [
                (101, 1, 3, 0),
                (101, 4, 1, 10),
                (102, 3, 1, 0),
                (102, 5, 1, 0),
                (103, 1, 1, 0),
                (103, 2, 4, 0),
                (104, 2, 0, 0),
                (105, 4, 2, 5),
                (105, 4, 2, 5),
                (107, 999, 1, 0),
            ]
        ),
        books=make.books(
            [
                (1, "Dragons", 1, 71),
                (2, "Elves", 1, 72),
                (3, "Giants", 1, 71),
                (4, "Rome", 2, 72),
                (5, "Dragons", 2, 73),
                (6, "Unsold", 2, 73),
            ]
        ),
        genre=make.genre([(1, "Fantasy"), (2, "History"), (3, "Poetry")]),
        publisher=make.publisher([(71, "North"), (72, "South"), (73, "South")]),
        customer=make.customer(
            [
                (10, "Ada", "Lee", "Female", "English"),
                (11, "Bo", "Ek", "Male", "Swedish"),
                (12, "Cy", "Oz", None, None),
                (13, "Di", "Uy", "Nonbinary", "English"),
                (14, "Ed", "Ax", "Male", "English"),
            ]
        ),
        reviews=make.reviews(
            [
                (1, 1, 10, 5, day("2022-01-01")),
                (2, 1, 11, 4, day("2022-12-31")),
                (3, 2, 10, 3, day("2023-01-01")),
                (4, 3, 10, 1, day("2022-06-01")),
                (5, 3, 11, None, day("2022-06-02")),
                (6, 4, 12, 2, day("2022-07-01")),
                (7, 4, 12, 5, day("2022-07-02")),
                (8, 999, 12, 1, day("2022-07-03")),
            ]
        ),
    )


def purchases(shop):
    return shop.orders, shop.order_details, shop.books, shop.genre
