import pytest
from conftest import rows
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from quillmart import schemas
from quillmart.operators import dimensions, recommend, reviews, sales
from quillmart.plans.views import derived_relations, register_views
from quillmart.sources import MissingColumnsError, conform, load_star
from quillmart.sources.csv_files import (
    read_genre_sizes,
    read_order_details,
    read_states,
    read_sub_genres,
)
from quillmart.sources.sinks import (
    store,
    write_bucketed,
    write_result,
    write_sales_lines,
)
from quillmart.sources.star import conform_table, load_star_catalog, load_star_jdbc


def _file(tmp_path, text):
    path = tmp_path / "file.csv"
    path.write_text(text, encoding="utf-8")
    return str(path)


def _save(star, root):
    for name in schemas.TABLES:
        getattr(star, name).write.parquet(f"{root}/{name}")


def test_order_lines_file(spark, tmp_path):
    df = read_order_details(
        spark, _file(tmp_path, "order_id,book id,quantity,discount\n7,12,2,15\n8,13,1,0")
    )
    assert df.schema == schemas.ORDER_DETAILS
    assert sorted(rows(df)) == [(7, 12, 2, 15), (8, 13, 1, 0)]


def test_quoted_commas_and_quotes(spark, tmp_path):
    sizes = read_genre_sizes(
        spark,
        _file(tmp_path, 'Title,Number of Sub-genres\n"Food, Drink & ""More""",3\nTravel,0\n'),
    )
    assert sorted(rows(sizes)) == [('Food, Drink & "More"', 3), ("Travel", 0)]


def test_stated_and_counted_sub_genres_agree(spark, tmp_path):
    (tmp_path / "a").mkdir()
    sizes = read_genre_sizes(
        spark, _file(tmp_path / "a", "Title,Number of Sub-genres\nCooking,2\nMaps,0\n")
    )
    subs = read_sub_genres(
        spark, _file(tmp_path, "Title,Main Genre\nBaking,Cooking\nSoups,Cooking\n")
    )
    assert sorted(rows(dimensions.sub_genre_counts(sizes, subs))) == sorted(rows(sizes))


def test_states_file(spark, tmp_path):
    text = "State,State Code,Region,Division,Region_code\nOhio,OH,Midwest,East North Central,MW\n"
    df = read_states(spark, _file(tmp_path, text))
    assert df.columns == schemas.STATES.names
    assert rows(df) == [("Ohio", "OH", "Midwest", "East North Central", "MW")]


@pytest.mark.parametrize(
    "text",
    [
        "order_id,quantity,book id,discount\n7,2,12,15\n",
        "order_id,book id,quantity,discount\n7,twelve,2,15\n",
        "order_id,book id,quantity,discount\n7,12\n",
    ],
    ids=["columns swapped", "not a number", "short row"],
)
def test_wrong_files_are_refused(spark, tmp_path, text):
    with pytest.raises((PySparkException, Py4JJavaError)):
        read_order_details(spark, _file(tmp_path, text)).collect()


def test_conform_casts_orders_and_drops(spark):
    df = spark.createDataFrame([("x", "5", 1)], "Genre_Title STRING, genre_id STRING, more INT")
    assert conform(df, schemas.GENRE).schema == schemas.GENRE
    assert rows(conform(df, schemas.GENRE, keep_extra=True)) == [(5, "x", 1)]


def test_missing_columns_are_named(spark):
    df = spark.createDataFrame([(1,)], "genre_id INT")
    with pytest.raises(MissingColumnsError, match="genre_title"):
        conform(df, schemas.GENRE)


def test_customer_table_may_lack_demographics_and_keeps_extras(spark):
    df = spark.createDataFrame(
        [(1, "A", "B", "a@b.example")],
        "customer_id INT, first_name STRING, last_name STRING, email STRING",
    )
    assert conform_table("customer", df).columns == [
        "customer_id",
        "first_name",
        "last_name",
        "email",
    ]


def test_star_from_files_and_views(spark, shop, tmp_path):
    _save(shop, tmp_path)
    star = load_star(spark, str(tmp_path))
    register_views(star)
    assert spark.table("orders").count() == 7
    for name, df in derived_relations(star).items():
        assert spark.table(name).columns == df.columns
    favourite = spark.sql(
        "SELECT genre_title FROM customer_frequent_genre WHERE customer_id = :id LIMIT 1",
        args={"id": 12},
    )
    assert rows(favourite) == [("History",)]


def test_database_tables_are_read_in_key_ranges(shop):
    calls = {}

    class Reader:
        def jdbc(self, url, table, **options):
            calls[table] = options
            return getattr(shop, table)

    class Session:
        read = Reader()

    bounds = {
        "orders": ("order_id", 1, 1000, 20),
        "order_details": ("order_id", 1, 1000, 40),
        "reviews": ("review_id", 1, 500, 5),
    }
    star = load_star_jdbc(Session(), "jdbc:x", {"user": "u"}, bounds)
    with pytest.raises(ValueError, match="order_details"):
        load_star_jdbc(Session(), "jdbc:x", {}, {k: bounds[k] for k in ("orders", "reviews")})
    assert star.orders.columns == schemas.ORDERS.names
    assert calls["orders"] == {
        "column": "order_id",
        "lowerBound": 1,
        "upperBound": 1000,
        "numPartitions": 20,
        "properties": {"user": "u"},
    }
    assert calls["genre"] == {"properties": {"user": "u"}}


def test_results_are_written_in_folders(spark, shop, tmp_path):
    path = str(tmp_path / "out")
    write_result(shop.genre, path, partition_by=("genre_title",))
    assert (tmp_path / "out" / "genre_title=Fantasy").is_dir()
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(PySparkException):
        write_result(shop.genre, path)


def test_bucketed_facts_join_without_a_shuffle(spark, shop, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS shop_db")
    for name in schemas.TABLES:
        table, df = f"shop_db.{name}", getattr(shop, name)
        if name in ("orders", "order_details"):
            write_bucketed(df, table, "order_id", 4, path=str(tmp_path / name))
        else:
            df.write.option("path", str(tmp_path / name)).saveAsTable(table)
    star = load_star_catalog(spark, "shop_db")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = star.order_details.join(star.orders, "order_id")
        plan = lines._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        got = sales.publisher_revenue(
            star.orders, star.order_details, star.books, star.publisher
        )
        assert [r[0] for r in rows(got)] == ["South", "North"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP DATABASE shop_db CASCADE")


def test_a_stored_result_replaces_the_one_before(shop, tmp_path):
    stored = [store(shop.genre, f"{tmp_path}/", "genre") for _ in range(2)][-1]
    assert sorted(rows(stored)) == sorted(rows(shop.genre))
    assert stored.schema == shop.genre.schema
    assert [p.name for p in tmp_path.iterdir()] == ["genre"]


@pytest.mark.parametrize("folder", ["/tmp/x", "file:///tmp/x", "x"])
def test_a_folder_of_one_machine_is_refused_on_a_cluster(shop, monkeypatch, folder):
    monkeypatch.setattr(shop.genre.sparkSession.sparkContext, "master", "yarn")
    with pytest.raises(ValueError, match="share"):
        store(shop.genre, folder, "genre")


def test_stored_lines_give_the_same_sales(spark, shop, tmp_path):
    path = str(tmp_path / "lines")
    write_sales_lines(shop.orders, shop.order_details, path)
    assert (tmp_path / "lines" / "order_year=2023").is_dir()
    lines = spark.read.parquet(path)
    tables = shop.orders, shop.order_details, shop.books
    for operator, args in (
        (sales.genre_sales_by_year, (*tables, shop.genre, 2023)),
        (sales.book_sales_by_year, (*tables, 2023)),
        (sales.top_bottom_books, (*tables, 2023)),
        (sales.declining_sales, tables),
        (sales.publisher_revenue, (*tables, shop.publisher)),
        (recommend.recommend_books, (*tables, shop.genre)),
        (recommend.purchased_in_preferred_genre, (*tables, shop.genre)),
        (recommend.preferred_genre_best_sellers, (*tables, shop.genre)),
    ):
        with_lines = operator(*args, lines=lines)
        assert sorted(rows(with_lines), key=repr) == sorted(rows(operator(*args)), key=repr)
        if 2023 in args:
            plan = with_lines._jdf.queryExecution().executedPlan().toString()
            assert "order_year" in plan.split("PartitionFilters: [")[1].split("]")[0]
            assert "order_date" not in plan


def test_sentiment_by_year_is_a_table_function(spark, shop):
    register_views(shop)
    got = rows(spark.sql("SELECT * FROM sentiment_by_year(2022)"))
    assert sorted(got) == sorted(rows(reviews.sentiment_by_year(shop.reviews, 2022))) and got
