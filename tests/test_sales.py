import pytest
from conftest import day, money, purchases, rows

from quillmart.operators import sales


def test_genre_sales_by_year(shop):
    assert rows(sales.genre_sales_by_year(*purchases(shop), year=2023)) == [
        (1, "Fantasy", 9),
        (2, "History", 2),
    ]
    assert rows(sales.genre_sales_by_year(*purchases(shop), year=2024)) == [(2, "History", 4)]
    assert rows(sales.genre_sales_by_year(*purchases(shop), year=2020)) == []


def test_book_sales_keep_books_with_one_title_apart(shop):
    got = rows(sales.book_sales_by_year(shop.orders, shop.order_details, shop.books, 2023))
    assert got == [
        (1, "Dragons", 4),
        (2, "Elves", 4),
        (3, "Giants", 1),
        (4, "Rome", 1),
        (5, "Dragons", 1),
    ]


def _ranked_shop(make, n, title="t"):
    """Book i sells i // 2 copies, so neighbours tie."""
    orders = make.orders([(1, 1, day("2022-05-05"), None)])
    lines = make.order_details([(1, i, i // 2, 0) for i in range(n)] + [(1, 10**6, 99, 0)])
    books = make.books([(i, f"{title}{i}", 1, 1) for i in range(n)])
    return orders, lines, books


@pytest.mark.parametrize("n", [0, 1, 19, 20, 21, 45])
def test_top_and_bottom_books(make, n):
    orders, lines, books = _ranked_shop(make, n)
    ranking = sorted(range(n), key=lambda i: (-(i // 2), i))
    expected = ranking if n < 20 else ranking[:10] + ranking[-10:]
    got = rows(sales.top_bottom_books(orders, lines, books, 2022))
    assert [r[0] for r in got] == expected


def test_long_titles_are_shortened(make):
    orders, lines, books = _ranked_shop(make, 2, title="x" * 34)
    got = rows(sales.top_bottom_books(orders, lines, books, 2022))
    assert [r[2] for r in got] == ["x" * 34 + "0", "x" * 34 + "1"]
    orders, lines, books = _ranked_shop(make, 1, title="é" * 35)
    got = rows(sales.top_bottom_books(orders, lines, books, 2022))
    assert [(r[1], r[2]) for r in got] == [("é" * 35 + "0", "é" * 35 + "…")]


def _months(make, *sold):
    """One book, one order per (date, copies)."""
    orders = make.orders([(i, 1, day(d), None) for i, (d, _) in enumerate(sold)])
    lines = make.order_details([(i, 1, q, 0) for i, (_, q) in enumerate(sold)])
    return orders, lines, make.books([(1, "Dragons", 1, 1)])


def test_decline_compares_with_the_last_month_that_sold(make):
    tables = _months(make, ("2023-01-31", 4), ("2023-03-01", 2), ("2023-03-31", 1))
    assert rows(sales.declining_sales(*tables)) == [(1, "Dragons", "2023-03-01", 3, 4, -25.0)]


def test_decline_is_strictly_beyond_the_threshold(make):
    tables = _months(make, ("2022-12-15", 10), ("2023-01-01", 9))
    assert rows(sales.declining_sales(*tables)) == []
    assert rows(sales.declining_sales(*tables, threshold=-9.99)) == [
        (1, "Dragons", "2023-01-01", 9, 10, -10.0)
    ]


def test_decline_from_zero_is_unknown(make):
    tables = _months(make, ("2023-01-01", 0), ("2023-02-01", 5), ("2023-03-01", 1))
    assert rows(sales.declining_sales(*tables)) == [(1, "Dragons", "2023-03-01", 1, 5, -80.0)]


def test_declines_are_limited_after_unknown_books_are_left_out(make):
    orders = make.orders([(1, 1, day("2023-01-01"), None), (2, 1, day("2023-02-01"), None)])
    lines = make.order_details(
        [(1, b, 100, 0) for b in range(15)] + [(2, b, 10 + b // 2, 0) for b in range(15)]
    )
    books = make.books([(b, f"b{b}", 1, 1) for b in range(1, 15)])
    got = rows(sales.declining_sales(orders, lines, books))
    assert [r[0] for r in got] == list(range(1, 11))
    assert got[0][5] == -90.0


def test_publisher_revenue_counts_an_order_once_per_line(shop):
    got = rows(
        sales.publisher_revenue(shop.orders, shop.order_details, shop.books, shop.publisher)
    )
    # North: 101, 102, 103 by one line each. South: 101, 102, 103, 104 and twice 105.
    assert got == [("South", money("272.49")), ("North", money("62.50"))]
