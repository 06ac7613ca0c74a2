from conftest import day, rows

from quillmart.operators import relations, reviews, sales


def test_review_sentiment_drops_unrated_reviews(shop):
    got = relations.review_sentiment(shop.reviews).select("review_id", "review_classification")
    assert sorted(rows(got)) == [
        (1, "Positive"),
        (2, "Positive"),
        (3, "Neutral"),
        (4, "Negative"),
        (6, "Negative"),
        (7, "Positive"),
        (8, "Negative"),
    ]


def test_sentiment_by_year_includes_first_and_last_day(shop):
    assert sorted(rows(reviews.sentiment_by_year(shop.reviews, 2022))) == [
        ("Negative", 3),
        ("Positive", 3),
    ]
    assert rows(reviews.sentiment_by_year(shop.reviews, 2023)) == [("Neutral", 1)]
    assert rows(reviews.sentiment_by_year(shop.reviews, 1999)) == []


def test_reviews_per_book_labels_the_mean(shop):
    got = rows(relations.reviews_per_book(shop.reviews, shop.books))
    assert sorted(got) == [
        (1, "Dragons", 2, 4.5, "Positive"),
        (2, "Elves", 1, 3.0, "Neutral"),
        (3, "Giants", 2, 1.0, "Negative"),
        (4, "Rome", 2, 3.5, "Positive"),
    ]


def test_top_reviewers(shop):
    assert rows(reviews.top_reviewers(shop.reviews, shop.customer)) == [
        (10, "Ada", "Lee", 3),
        (12, "Cy", "Oz", 3),
        (11, "Bo", "Ek", 2),
    ]


def test_top_reviewed_books_skip_unknown_books_before_the_limit(shop, make):
    more = make.reviews([(i, 998, 10, 1, day("2022-01-01")) for i in range(20, 30)])
    got = rows(reviews.top_reviewed_books(shop.reviews.unionByName(more), shop.books, n=2))
    assert got == [(1, "Dragons", "Positive"), (3, "Giants", "Negative")]


def test_genre_sentiment_in_both_orders(shop):
    tables = (shop.reviews, shop.books, shop.genre)
    best = [
        ("Fantasy", "Positive", 2),
        ("History", "Positive", 1),
        ("Fantasy", "Neutral", 1),
        ("Fantasy", "Negative", 1),
        ("History", "Negative", 1),
    ]
    assert rows(reviews.genre_sentiment(*tables)) == best
    worst = rows(reviews.genre_sentiment(*tables, best=False))
    assert worst == best[3:] + best[2:3] + best[:2]


def test_poor_books_by_mean_or_by_negatives(shop, make):
    assert rows(sales.poorly_performing_books(shop.books, shop.reviews)) == [
        (3, "Giants", 2, 1.0, 1)
    ]
    ratings = [1, 1, 2, 2, 5, 5, 5, 5, 5, 5, 5, 5]
    loved = make.reviews([(i, 2, 10, r, day("2022-01-01")) for i, r in enumerate(ratings)])
    got = rows(sales.poorly_performing_books(shop.books, loved))
    assert got == [(2, "Elves", 12, sum(ratings) / 12, 4)]
    assert rows(sales.poorly_performing_books(shop.books, loved.filter("review_id > 0"))) == []
