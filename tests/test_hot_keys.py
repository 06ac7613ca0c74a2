"""Tables with a hot key: bucketed sales lines, and database tables read by conditions."""

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_scale import NO_BROADCAST, conf  # noqa: F401

from quillmart import schemas
from quillmart.operators import recommend, sales
from quillmart.sources.key_ranges import key_quantiles, quantile_predicates
from quillmart.sources.sinks import heavy_keys, read_bucketed_sales, write_bucketed_sales
from quillmart.sources.star import load_star_jdbc, skewed_predicates


@pytest.fixture
def hot(shop):
    """Order 101 gets two thousand lines more, and one line belongs to no order."""
    spark = shop.orders.sparkSession
    more = spark.range(0, 2000, 1, 8).select(
        F.lit(101).alias("order_id"), (1 + F.col("id") % 5).alias("book_id"), F.lit(1).alias("quantity"), F.lit(0).alias("discount")
    )
    stray = spark.createDataFrame([(888, 1, 1, 0), (None, 2, 1, 0)], schemas.ORDER_DETAILS)
    details = spark.createDataFrame(shop.order_details.unionByName(more).unionByName(stray).collect(), schemas.ORDER_DETAILS)
    return shop.orders, details.repartition(8)


@pytest.fixture
def database(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS hot_db")
    yield "hot_db"
    spark.sql("DROP DATABASE hot_db CASCADE")


def test_heavy_keys_are_those_above_the_limit(hot):
    assert rows(heavy_keys(hot[1], "order_id", 100)) == [(101,)]
    assert rows(heavy_keys(hot[1], "order_id", 5000)) == []


@pytest.mark.parametrize("heavy_rows", [100, 5000, 0])
def test_bucketed_sales_are_the_unbucketed_join(spark, hot, database, tmp_path, conf, heavy_rows):  # noqa: F811
    orders, details = hot
    write_bucketed_sales(orders, details, database, 4, heavy_rows, path=str(tmp_path))
    lines = read_bucketed_sales(spark, database)
    expected = details.join(orders, "order_id")
    assert sorted(rows(lines.select(expected.columns))) == sorted(rows(expected))
    # Light lines are joined without a shuffle, heavy ones are in several files.
    conf(NO_BROADCAST)
    light = read_bucketed_sales(spark, database)._jdf.queryExecution().executedPlan().toString()
    first, second = light.split("SortMergeJoin")[1:]
    assert "Exchange" not in first and "Exchange" in second
    if heavy_rows == 100:
        assert len(list((tmp_path / "heavy_details").glob("*.parquet"))) > 1
        assert rows(spark.table(f"{database}.heavy_orders").select("order_id")) == [(101,)]
        assert spark.table(f"{database}.order_details").filter("order_id = 101").count() == 0


def test_sales_operators_take_bucketed_lines(spark, shop, hot, database, tmp_path):
    orders, details = hot
    write_bucketed_sales(orders, details, database, 4, 100, path=str(tmp_path))
    lines = read_bucketed_sales(spark, database)
    for operator, args in (
        (sales.declining_sales, (orders, details, shop.books)),
        (sales.publisher_revenue, (orders, details, shop.books, shop.publisher)),
        (recommend.recommend_books, (orders, details, shop.books, shop.genre)),
    ):
        expected = sorted(rows(operator(*args)), key=repr)
        assert sorted(rows(operator(*args, lines=lines)), key=repr) == expected


def parts_of(df, predicates):
    """How many conditions every row meets, and the rows of each condition."""
    met = sum((F.when(F.expr(p), 1).otherwise(0) for p in predicates), F.lit(0))
    sizes = df.agg(*(F.sum(F.when(F.expr(p), 1).otherwise(0)) for p in predicates)).first()
    return {r[0] for r in df.select(met).distinct().collect()}, [n or 0 for n in sizes]


def test_conditions_hold_equal_numbers_of_rows(spark):
    i = F.col("id")
    # Keys crowd at the low end; a third of the rows have one key.
    df = spark.range(60_000).select(
        F.when(i % 3 == 0, 77).when(i % 101 == 0, None).otherwise(F.pow(i % 1000, F.lit(3)).cast("long")).alias("order_id"),
        F.when(i % 50 == 0, None).otherwise(i - 30_000).alias("line_id"),
    )
    quantiles = key_quantiles(df, "order_id", 20)
    met, sizes = parts_of(df, quantile_predicates("order_id", quantiles, "line_id"))
    assert met == {1} and sum(sizes) == 60_000 and max(sizes) < 2.5 * 60_000 / 20
    met, whole = parts_of(df, quantile_predicates("order_id", quantiles))
    assert met == {1} and max(whole) > 19_000  # the hot key, not dealt
    even = [int(k) for k in range(0, 10**9, 10**9 // 20)][1:]
    assert max(parts_of(df, quantile_predicates("order_id", even))[1]) > 2 * max(sizes)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=8), st.booleans())
def test_every_row_meets_one_condition(spark, quantiles, deal):
    keys = [(k, d) for k in [None, *range(-7, 8)] for d in (None, -3, -2, 0, 1, 2, 5)]
    df = spark.createDataFrame(keys, "k int, d int")
    assert parts_of(df, quantile_predicates("k", quantiles, "d" if deal else None))[0] == {1}


def test_no_keys_and_odd_names(spark):
    assert quantile_predicates("k", key_quantiles(spark.createDataFrame([], "k int"), "k", 4)) == ["1 = 1"]
    assert key_quantiles(spark.range(5), "id", 1) == []
    with pytest.raises(ValueError, match="plain"):
        quantile_predicates("k; DROP TABLE x", [1])
    with pytest.raises(ValueError):
        quantile_predicates("k", ["1 OR 1 = 1"])


def test_database_tables_are_read_by_conditions(spark, shop):
    calls = {}

    class Reader:
        def jdbc(self, url, table, **options):
            calls.setdefault(table, []).append(options)
            return getattr(shop, table)

    class Session:
        read = Reader()

    bounds = ("order_id", 1, 1000, 20)
    found = skewed_predicates(Session(), "jdbc:x", {}, "order_details", bounds, 3)
    assert calls["order_details"][0]["numPartitions"] == 20
    assert parts_of(shop.order_details, found)[0] == {1} and len(found) >= 3
    star = load_star_jdbc(
        Session(), "jdbc:x", {}, {"orders": bounds, "reviews": ("review_id", 1, 9, 2)}, {"order_details": found}
    )
    assert calls["order_details"][1] == {"predicates": found, "properties": {}}
    assert star.order_details.columns == schemas.ORDER_DETAILS.names
