import random
from collections import Counter

import pytest
from conftest import purchases, rows

from quillmart.operators import recommend, relations


def test_purchases_keep_repeats_and_drop_unknown_books(shop):
    got = rows(relations.customer_book_details(*purchases(shop)))
    assert sorted(got) == [
        (10, 1, "Dragons", "Fantasy"),
        (10, 3, "Giants", "Fantasy"),
        (10, 4, "Rome", "History"),
        (10, 5, "Dragons", "History"),
        (11, 1, "Dragons", "Fantasy"),
        (11, 2, "Elves", "Fantasy"),
        (11, 2, "Elves", "Fantasy"),
        (12, 4, "Rome", "History"),
        (12, 4, "Rome", "History"),
    ]


def test_frequent_genre_counts_lines_and_keeps_ties(shop):
    got = rows(relations.customer_frequent_genre(*purchases(shop)))
    assert sorted(got) == [
        (10, "Fantasy", 2),
        (10, "History", 2),
        (11, "Fantasy", 3),
        (12, "History", 2),
    ]


def test_genres_sharing_a_title_count_as_one(make):
    orders = make.orders([(1, 10, None, None)])
    lines = make.order_details([(1, 1, 1, 0), (1, 2, 1, 0), (1, 3, 1, 0)])
    books = make.books([(1, "a", 1, 1), (2, "b", 2, 1), (3, "c", 3, 1)])
    genre = make.genre([(1, "Poetry"), (2, "Poetry"), (3, "Drama")])
    assert rows(relations.customer_frequent_genre(orders, lines, books, genre)) == [
        (10, "Poetry", 2)
    ]


def test_best_sellers_are_every_book_at_the_maximum(shop):
    got = rows(relations.best_sellers_by_genre(shop.order_details, shop.books, shop.genre))
    assert sorted(got) == [
        (1, "Fantasy", "Dragons", 1, 4),
        (1, "Fantasy", "Elves", 2, 4),
        (2, "History", "Rome", 4, 5),
    ]


def test_preferred_genre_takes_the_first_title_of_a_tie(shop):
    frequent = relations.customer_frequent_genre(*purchases(shop))
    assert sorted(rows(recommend.preferred_genre(frequent))) == [
        (10, "Fantasy"),
        (11, "Fantasy"),
        (12, "History"),
    ]
    assert rows(recommend.preferred_genre(frequent, 12)) == [(12, "History")]


def test_purchases_in_the_preferred_genre(shop):
    got = rows(recommend.purchased_in_preferred_genre(*purchases(shop)))
    assert sorted(got) == [
        (10, 1, "Dragons", "Fantasy"),
        (10, 3, "Giants", "Fantasy"),
        (11, 1, "Dragons", "Fantasy"),
        (11, 2, "Elves", "Fantasy"),
        (11, 2, "Elves", "Fantasy"),
        (12, 4, "Rome", "History"),
        (12, 4, "Rome", "History"),
    ]


def test_best_sellers_of_the_preferred_genre_include_owned_ones(shop):
    got = rows(recommend.preferred_genre_best_sellers(*purchases(shop)))
    assert sorted(got) == [
        (10, "Fantasy", "Dragons", 1),
        (10, "Fantasy", "Elves", 2),
        (11, "Fantasy", "Dragons", 1),
        (11, "Fantasy", "Elves", 2),
        (12, "History", "Rome", 4),
    ]


def test_recommendations_leave_out_owned_books(shop):
    assert rows(recommend.recommend_books(*purchases(shop))) == [(10, "Fantasy", "Elves", 2, 4)]


def test_recommendations_for_one_customer(shop):
    tables = purchases(shop)
    assert rows(recommend.recommend_books(*tables, customer_id=10)) == [
        (10, "Fantasy", "Elves", 2, 4)
    ]
    assert rows(recommend.recommend_books(*tables, customer_id=11)) == []
    assert rows(recommend.recommend_books(*tables, customer_id=404)) == []
    assert rows(recommend.purchased_in_preferred_genre(*tables, customer_id=404)) == []
    assert sorted(rows(recommend.preferred_genre_best_sellers(*tables, customer_id=12))) == [
        (12, "History", "Rome", 4)
    ]


def test_recommendations_come_best_first_for_one_customer(make):
    orders = make.orders([(1, 10, None, None), (2, 11, None, None)])
    lines = make.order_details([(1, 3, 1, 0), (2, 1, 9, 0), (2, 2, 9, 0)])
    books = make.books([(1, "Zebra", 1, 1), (2, "Ant", 1, 1), (3, "Bee", 1, 1)])
    genre = make.genre([(1, "Nature")])
    got = rows(recommend.recommend_books(orders, lines, books, genre, customer_id=10))
    assert [r[2] for r in got] == ["Ant", "Zebra"]


def test_orders_without_a_customer_get_no_recommendation(make):
    orders = make.orders([(1, None, None, None), (2, 11, None, None)])
    lines = make.order_details([(1, 3, 1, 0), (2, 1, 9, 0), (2, 3, 1, 0)])
    books = make.books([(1, "Zebra", 1, 1), (3, "Bee", 1, 1)])
    genre = make.genre([(1, "Nature")])
    assert rows(recommend.recommend_books(orders, lines, books, genre)) == []


def test_stored_best_sellers_give_the_same_recommendations(shop, spark, tmp_path):
    path = str(tmp_path / "best")
    relations.best_sellers_by_genre(shop.order_details, shop.books, shop.genre).write.parquet(path)
    stored = spark.read.parquet(path)
    tables = purchases(shop)
    assert rows(recommend.recommend_books(*tables, best_sellers=stored)) == rows(
        recommend.recommend_books(*tables)
    )
    assert sorted(
        rows(recommend.preferred_genre_best_sellers(*tables, best_sellers=stored))
    ) == sorted(rows(recommend.preferred_genre_best_sellers(*tables)))


def test_orders_of_one_customer_are_broadcast_on_request_only(shop):
    tables = purchases(shop)
    plain = relations.customer_book_details(*tables, customer_id=10)
    asked = relations.customer_book_details(*tables, customer_id=10, broadcast_orders=True)
    assert sorted(rows(plain)) == sorted(rows(asked))
    hinted = [
        "strategy=broadcast" in df._jdf.queryExecution().optimizedPlan().toString()
        for df in (plain, asked)
    ]
    assert hinted == [False, True]


def test_orders_without_a_customer_belong_to_nobody(make):
    orders = make.orders([(1, None, None, None), (2, 11, None, None)])
    lines = make.order_details([(1, 3, 1, 0), (2, 1, 9, 0), (2, 3, 1, 0)])
    books = make.books([(1, "Zebra", 1, 1), (3, "Bee", 1, 1)])
    tables = orders, lines, books, make.genre([(1, "Nature")])
    frequent = relations.customer_frequent_genre(*tables)
    assert {r[0] for r in rows(frequent)} == {None, 11}
    for got in (
        recommend.preferred_genre(frequent),
        recommend.purchased_in_preferred_genre(*tables),
        recommend.preferred_genre_best_sellers(*tables),
    ):
        assert {r[0] for r in rows(got)} == {11}
    assert rows(recommend.recommend_books(*tables)) == []


def _expected(orders, lines, books, genre):
    """Recommendations worked out in plain Python."""
    customer_of = {o[0]: o[1] for o in orders}
    genre_titles = dict(genre)
    genre_of = {b[0]: genre_titles[b[2]] for b in books}
    title_of = {b[0]: b[1] for b in books}
    sold, bought = Counter(), Counter()
    for order, book, quantity, _ in lines:
        sold[book] += quantity
        bought[customer_of[order], genre_of[book]] += 1
    highest = {}
    for book, copies in sold.items():
        highest[genre_of[book]] = max(copies, highest.get(genre_of[book], 0))
    owned = {(customer_of[order], book) for order, book, _, _ in lines}
    result = []
    for customer in {c for c, _ in bought}:
        favourite = min((-n, g) for (c, g), n in bought.items() if c == customer)[1]
        result += [
            (customer, favourite, title_of[book], book, copies)
            for book, copies in sold.items()
            if genre_of[book] == favourite
            and copies == highest[favourite]
            and (customer, book) not in owned
        ]
    return sorted(result)


@pytest.mark.parametrize("seed", range(5))
def test_recommendations_equal_plain_python(make, seed):
    """Few books and small quantities, so that genres, best sellers and ownership tie often."""
    pick = random.Random(seed)
    genre = [(1, "A"), (2, "B"), (3, "C")]
    books = [(b, f"title {b % 4}", pick.randint(1, 3), 1) for b in range(12)]
    orders = [(o, pick.randint(1, 15), None, None) for o in range(40)]
    lines = [(pick.randrange(40), pick.randrange(12), pick.randint(1, 2), 0) for _ in range(90)]
    got = recommend.recommend_books(
        make.orders(orders), make.order_details(lines), make.books(books), make.genre(genre)
    )
    assert sorted(rows(got)) == _expected(orders, lines, books, genre)
