"""Plans that must hold on large and skewed tables.

The skewed tables give a third of all lines to one order, a third to one customer, a third to one
book. The thresholds are lowered so that AQE treats the small test partitions like large ones.
"""

from dataclasses import replace

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quillmart import schemas
from quillmart.operators import customers, recommend, relations, reviews, sales
from quillmart.plans.session import PARTITION_BYTES, cluster_settings
from quillmart.sources import StarTables, load_star
from quillmart.sources.sinks import write_result

LINES = 300_000
ORDERS = 30_000
CUSTOMERS = 3_000
BOOKS = 2_000
GENRES = 10


@pytest.fixture
def conf(spark):
    """Set Spark settings for one test."""
    changed = []

    def set_all(settings):
        for key, value in settings.items():
            spark.conf.set(key, value)
            changed.append(key)

    yield set_all
    for key in changed:
        spark.conf.unset(key)


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    i = F.col("id")
    third = i % 3 == 0

    def spread(seed, n):
        return F.pmod(F.xxhash64(i, F.lit(seed)), F.lit(n))

    def table(n, partitions=8):
        return spark.range(0, n, 1, partitions)

    # Line i belongs to order i % ORDERS, except the hot third, split between a hot order and the
    # orders of a hot customer; every third line of the rest goes to the hot book.
    details = table(LINES).select(
        F.when(third & (i % 2 == 0), 0).otherwise(spread(1, ORDERS)).alias("order_id"),
        F.when(i % 3 == 1, 0).otherwise(spread(2, BOOKS)).alias("book_id"),
        (1 + spread(3, 5)).cast("int").alias("quantity"),
        F.lit(0).alias("discount"),
    )
    orders = table(ORDERS).select(
        i.alias("order_id"),
        F.when(third, 0).otherwise(spread(4, CUSTOMERS)).alias("customer_id"),
        F.date_add(F.lit("1998-01-01").cast("date"), spread(5, 700).cast("int")).alias(
            "order_date"
        ),
        (spread(6, 10_000) / 100).cast(schemas.MONEY).alias("total_amount"),
    )
    books = table(BOOKS, 2).select(
        i.alias("book_id"),
        F.concat(F.lit("t"), i.cast("string")).alias("title"),
        F.when(third, 0).otherwise(spread(7, GENRES)).alias("genre_id"),
        spread(8, 20).alias("publisher_id"),
    )
    star = StarTables(
        orders=orders,
        order_details=details,
        books=books,
        genre=table(GENRES, 1).select(
            i.alias("genre_id"), F.concat(F.lit("g"), i.cast("string")).alias("genre_title")
        ),
        publisher=table(20, 1).select(
            i.alias("publisher_id"), F.concat(F.lit("p"), i.cast("string")).alias("publisher_name")
        ),
        customer=table(CUSTOMERS, 1).select(
            i.alias("customer_id"),
            F.lit("A").alias("first_name"),
            F.lit("B").alias("last_name"),
        ),
        reviews=table(30_000).select(
            i.alias("review_id"),
            F.when(third, 0).otherwise(spread(9, BOOKS)).alias("book_id"),
            F.when(third, 0).otherwise(spread(10, CUSTOMERS)).alias("customer_id"),
            (1 + spread(11, 5)).cast("int").alias("rating"),
            F.lit("2022-05-05").cast("date").alias("review_date"),
        ),
    )
    root = str(tmp_path_factory.mktemp("skewed"))
    for name in schemas.TABLES:
        getattr(star, name).write.parquet(f"{root}/{name}")
    return load_star(spark, root)


def _purchases(star):
    return star.orders, star.order_details, star.books, star.genre


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _final_plan(df):
    """The plan AQE arrived at, after running it."""
    df._jdf.queryExecution().executedPlan().execute().count()
    return _plan(df).split("Initial Plan")[0]


NO_BROADCAST = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}
SPLIT_SMALL = {
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


def test_lines_of_a_hot_order_are_split(skewed, conf):
    conf(NO_BROADCAST | SPLIT_SMALL)
    lines = relations.sales_lines(skewed.orders, skewed.order_details)
    assert "SortMergeJoin(skew=true)" in _final_plan(lines)
    assert lines.count() == LINES


def test_lines_of_a_hot_book_are_split(skewed, conf):
    conf(NO_BROADCAST | SPLIT_SMALL)
    details = relations.customer_book_details(*_purchases(skewed))
    joins = [part.split("\n")[0] for part in _final_plan(details).split("SortMergeJoin")[1:]]
    by_book = [j for j in joins if "book_id" in j]
    assert len(by_book) == 1 and by_book[0].startswith("(skew=true)")
    assert details.count() == LINES


@pytest.mark.parametrize("stored", [False, True])
def test_recommendation_splits_a_hot_book(spark, skewed, conf, tmp_path, stored):
    # Half of the customers do not own the hot book, so that there is something to recommend.
    orders = skewed.orders.withColumn("hot", F.col("customer_id") % 2 == 0)
    kept = skewed.order_details.join(orders.select("order_id", "hot"), "order_id")
    details = kept.filter("hot OR book_id > 0").drop("hot")
    details.write.parquet(str(tmp_path / "details"))
    tables = list(_purchases(skewed))
    tables[1] = spark.read.parquet(str(tmp_path / "details"))
    best = relations.best_sellers_by_genre(*tables[1:])
    if stored:
        best.write.parquet(str(tmp_path / "best"))
        best = spark.read.parquet(str(tmp_path / "best"))
    expected = rows(recommend.recommend_books(*tables))
    conf(NO_BROADCAST | SPLIT_SMALL)
    got = recommend.recommend_books(*tables, best_sellers=best if stored else None)
    joins = [part.split("\n")[0] for part in _final_plan(got).split("SortMergeJoin")[1:]]
    assert any(j.startswith("(skew=true)") and "[book_id" in j for j in joins)
    assert sorted(rows(got)) == sorted(expected) and expected


def test_lines_are_not_shuffled_by_genre(skewed, conf):
    conf({"spark.sql.autoBroadcastJoinThreshold": "1KB"})
    genre = skewed.genre.distinct()
    tables = (*_purchases(skewed)[:3], genre)
    for operator in (
        relations.customer_book_details,
        relations.customer_frequent_genre,
        recommend.recommend_books,
        recommend.purchased_in_preferred_genre,
        recommend.preferred_genre_best_sellers,
    ):
        plan = _plan(operator(*tables))
        lines = plan.split("\n")
        for i, line in enumerate(lines):
            if "Exchange hashpartitioning(genre_id" in line:
                below = "".join(lines[i + 1 : i + 3])
                assert "order_id" not in below and "customer_id" not in below.split("partial")[0]


def test_building_a_query_starts_no_job(spark, monkeypatch, tmp_path):
    from quillmart.plans import registry

    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "building")
    for build in registry.queries().values():
        build(spark, "/root/testdata/sf0.001")
    assert not tracker.getJobIdsForGroup("building")
    spark.sparkContext.setJobGroup("tests", "tests")


def test_lines_of_a_hot_customer_are_split(skewed, conf):
    tiny = {
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.shuffle.partitions": "64",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32KB",
    }
    conf(NO_BROADCAST | SPLIT_SMALL | tiny)
    # Without the hot book, whose repeated lines compress to next to nothing.
    star = replace(skewed, order_details=skewed.order_details.filter("book_id > 0"))
    bought = recommend.purchased_in_preferred_genre(*_purchases(star))
    joins = [part.split("\n")[0] for part in _final_plan(bought).split("SortMergeJoin")[1:]]
    assert any(j.startswith("(skew=true)") and "customer_id" in j for j in joins)


OPERATORS = {
    "customer_frequent_genre": lambda t: relations.customer_frequent_genre(*_purchases(t)),
    "best_sellers_by_genre": lambda t: relations.best_sellers_by_genre(*_purchases(t)[1:]),
    "recommend_books": lambda t: recommend.recommend_books(*_purchases(t)),
    "preferred_genre_best_sellers": lambda t: recommend.preferred_genre_best_sellers(
        *_purchases(t)
    ),
    "genre_sales_by_year": lambda t: sales.genre_sales_by_year(*_purchases(t), year=1998),
    "book_sales_by_year": lambda t: sales.book_sales_by_year(*_purchases(t)[:3], year=1998),
    "top_bottom_books": lambda t: sales.top_bottom_books(*_purchases(t)[:3], year=1998),
    "declining_sales": lambda t: sales.declining_sales(*_purchases(t)[:3]),
    "publisher_revenue": lambda t: sales.publisher_revenue(*_purchases(t)[:3], t.publisher),
    "poorly_performing_books": lambda t: sales.poorly_performing_books(t.books, t.reviews),
    "top_reviewers": lambda t: reviews.top_reviewers(t.reviews, t.customer),
    "top_reviewed_books": lambda t: reviews.top_reviewed_books(t.reviews, t.books),
    "genre_sentiment": lambda t: reviews.genre_sentiment(t.reviews, t.books, t.genre),
    "churn_risk": lambda t: customers.churn_risk(t.orders, 90, "2001-01-01"),
    "customer_lifetime_value": lambda t: customers.customer_lifetime_value(t.orders, t.customer),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_results_do_not_depend_on_join_strategy(skewed, conf, name):
    broadcast = rows(OPERATORS[name](skewed))
    conf(NO_BROADCAST | SPLIT_SMALL)
    shuffled = rows(OPERATORS[name](skewed))
    assert sorted(shuffled, key=repr) == sorted(broadcast, key=repr) and shuffled


@pytest.mark.parametrize("name", OPERATORS)
def test_no_nested_loops_and_no_window_over_everything(skewed, conf, name):
    conf(NO_BROADCAST)
    plan = _plan(OPERATORS[name](skewed))
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "windowspecdefinition(specifiedwindowframe" not in plan
    single = [line for line in plan.split("\n") if "Exchange SinglePartition" in line]
    assert not single


def test_hot_keys_are_combined_before_the_shuffle(skewed, conf):
    conf(NO_BROADCAST)
    plan = _plan(sales.publisher_revenue(*_purchases(skewed)[:3], skewed.publisher))
    by_book = plan.index("partial_sum(total_amount")
    assert plan.index("Exchange hashpartitioning(book_id") < by_book


def test_year_reaches_the_scan(skewed, conf):
    conf({"spark.sql.maxMetadataStringLength": "1000"})
    plan = _plan(sales.genre_sales_by_year(*_purchases(skewed), year=1998))
    assert "GreaterThanOrEqual(order_date,1998-01-01)" in plan
    assert "LessThan(order_date,1999-01-01)" in plan


def test_customer_reaches_the_scan(skewed):
    for df in (
        customers.tenure(skewed.orders, 5),
        customers.monetary(skewed.orders, skewed.customer, 5),
        relations.customer_frequent_genre(*_purchases(skewed), customer_id=5),
    ):
        assert "EqualTo(customer_id,5)" in _plan(df)


def test_scans_read_only_the_columns_used(skewed):
    plan = _plan(relations.customer_frequent_genre(*_purchases(skewed)))
    assert "ReadSchema: struct<order_id:bigint,book_id:bigint>" in plan
    assert "ReadSchema: struct<order_id:bigint,customer_id:bigint>" in plan
    assert "title:string,genre" not in plan


def test_rank_is_cut_before_the_shuffle(skewed, conf):
    conf(NO_BROADCAST)
    plan = _plan(relations.customer_frequent_genre(*_purchases(skewed)))
    assert "rank(genre_count" in plan
    assert plan.count("WindowGroupLimit") == 2


def test_recommendation_counts_purchases_once(skewed, conf):
    conf(NO_BROADCAST)
    plan = _final_plan(recommend.recommend_books(*_purchases(skewed)))
    scans = [line for line in plan.split("\n") if "FileScan" in line]
    assert sum("[order_id" in s and "book_id" in s for s in scans) == 1
    assert sum("customer_id" in s for s in scans) == 1
    assert sum("quantity" in s for s in scans) == 1


def test_stored_best_sellers_are_broadcast_to_the_catalogue(spark, skewed, tmp_path):
    path = str(tmp_path / "best")
    relations.best_sellers_by_genre(*_purchases(skewed)[1:]).write.parquet(path)
    best = spark.read.parquet(path)
    plan = _plan(recommend.recommend_books(*_purchases(skewed), best_sellers=best))
    to_books = next(line for line in plan.split("\n") if "LeftOuter" in line)
    assert "BroadcastHashJoin" in to_books


@pytest.mark.parametrize("threshold", ["-1", "10MB", "50KB"])
def test_both_ends_of_a_ranking_read_one_shuffle_of_lines(skewed, conf, threshold):
    conf({"spark.sql.autoBroadcastJoinThreshold": threshold})
    plan = _final_plan(sales.top_bottom_books(*_purchases(skewed)[:3], year=1998))
    scans = [line for line in plan.split("\n") if "FileScan" in line]
    assert sum("quantity" in s for s in scans) == 1
    assert sum("order_date" in s for s in scans) == 1


@pytest.mark.parametrize("threshold", ["-1", "10MB", "50KB"])
def test_best_sellers_read_one_shuffle_of_lines(skewed, conf, threshold):
    conf({"spark.sql.autoBroadcastJoinThreshold": threshold})
    plan = _final_plan(relations.best_sellers_by_genre(*_purchases(skewed)[1:]))
    assert sum("FileScan" in line and "quantity" in line for line in plan.split("\n")) == 1


def test_top_books_fetch_titles_for_the_chosen_only(skewed, conf):
    conf({"spark.sql.autoBroadcastJoinThreshold": "100KB"})
    for df in (
        sales.top_bottom_books(*_purchases(skewed)[:3], year=1998),
        sales.declining_sales(*_purchases(skewed)[:3]),
        reviews.top_reviewed_books(skewed.reviews, skewed.books),
    ):
        plan = _plan(df)
        assert plan.count("TakeOrderedAndProject") >= 2
        assert "title:string" in plan


def test_shuffle_partitions_follow_the_largest_shuffle():
    small = cluster_settings(cores=100, largest_shuffle_bytes=10**9)
    large = cluster_settings(cores=4000, largest_shuffle_bytes=20_000 * PARTITION_BYTES + 1)
    assert small["spark.sql.shuffle.partitions"] == "300"
    assert large["spark.sql.shuffle.partitions"] == "20001"
    assert large["spark.sql.adaptive.skewJoin.enabled"] == "true"


def test_a_large_folder_is_written_by_several_tasks(skewed, conf, spark, tmp_path):
    conf({"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB"})
    few = skewed.books.filter("genre_id < 3").coalesce(2)
    many = few.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(40))))
    path = tmp_path / "books"
    write_result(many, str(path), partition_by=("genre_id",))
    files = {d.name: len(list(d.glob("*.parquet"))) for d in path.glob("genre_id=*")}
    assert files["genre_id=0"] > 1
    assert spark.read.parquet(str(path)).count() == many.count()
