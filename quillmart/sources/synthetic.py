"""The star schema read from the synthetic order, part, customer and event tables.

The tables have no genre, publisher or review of their own, so part type and brand stand in for
genre and publisher and events for reviews. Genre and publisher ids are the leading 60 bits of the
title's MD5: a book finds its id without a join, and no global numbering is needed.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

# Fixed: the columns used, as the files declare them.
RAW = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_mktsegment STRING, c_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_quantity DOUBLE, l_discount DOUBLE",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, value DOUBLE, props STRING",
}


def title_id(title: str) -> str:
    return f"CAST(conv(substring(md5(CAST({title} AS BINARY)), 1, 15), 16, 10) AS BIGINT)"


class SyntheticStar:
    """The tables of ``StarTables`` with the types of ``schemas``, each built when first asked for."""

    def __init__(self, spark: SparkSession, root: str):
        self._spark = spark
        self._root = root

    def _raw(self, name: str) -> DataFrame:
        return self._spark.read.schema(RAW[name]).parquet(f"{self._root}/{name}.parquet")

    @cached_property
    def orders(self) -> DataFrame:
        return self._raw("orders").selectExpr(
            "o_orderkey AS order_id",
            "o_custkey AS customer_id",
            "CAST(o_orderdate AS DATE) AS order_date",
            "CAST(o_totalprice AS DECIMAL(18, 2)) AS total_amount",
        )

    @cached_property
    def order_details(self) -> DataFrame:
        return self._raw("lineitem").selectExpr(
            "l_orderkey AS order_id",
            "l_partkey AS book_id",
            "CAST(l_quantity AS INT) AS quantity",
            "CAST(round(l_discount * 100) AS INT) AS discount",
        )

    @cached_property
    def books(self) -> DataFrame:
        return self._raw("part").selectExpr(
            "p_partkey AS book_id",
            "p_name AS title",
            f"{title_id('p_type')} AS genre_id",
            f"{title_id('p_brand')} AS publisher_id",
        )

    @cached_property
    def genre(self) -> DataFrame:
        return (
            self._raw("part")
            .select("p_type")
            .distinct()
            .selectExpr(f"{title_id('p_type')} AS genre_id", "p_type AS genre_title")
        )

    @cached_property
    def publisher(self) -> DataFrame:
        return (
            self._raw("part")
            .select("p_brand")
            .distinct()
            .selectExpr(f"{title_id('p_brand')} AS publisher_id", "p_brand AS publisher_name")
        )

    @cached_property
    def customer(self) -> DataFrame:
        customer, nation = self._raw("customer"), self._raw("nation")
        return customer.join(
            nation, customer["c_nationkey"] == nation["n_nationkey"], "left"
        ).selectExpr(
            "c_custkey AS customer_id",
            "split(c_name, '#')[0] AS first_name",
            "split(c_name, '#')[1] AS last_name",
            "CASE c_mktsegment WHEN 'BUILDING' THEN 'Male' WHEN 'HOUSEHOLD' THEN 'Female' "
            "ELSE c_mktsegment END AS gender",
            "n_name AS preferred_language",
            "c_acctbal",
        )

    @cached_property
    def reviews(self) -> DataFrame:
        return self._raw("events").selectExpr(
            "event_id AS review_id",
            "CAST(get_json_object(props, '$.k') AS BIGINT) AS book_id",
            "user_id AS customer_id",
            "CASE WHEN value >= 150 THEN 1 WHEN value >= 90 THEN 2 WHEN value >= 50 THEN 3 "
            "WHEN value >= 20 THEN 4 ELSE 5 END AS rating",
            # Events are of one month; spread over three years so that a year leaves some out.
            "date_add(CAST(ts AS DATE), CAST(400 * (event_id % 3) AS INT)) AS review_date",
        )

    @cached_property
    def sub_genres(self) -> DataFrame:
        """Part names as sub-genres of the part types they occur under."""
        return (
            self._raw("part")
            .selectExpr("p_name AS sub_genre_title", "p_type AS genre_title")
            .distinct()
        )

    @cached_property
    def states(self) -> DataFrame:
        """A market segment served in a nation as a state, the nation as its division."""
        nation, region = self._raw("nation"), self._raw("region")
        segments = self._raw("customer").select("c_nationkey", "c_mktsegment").distinct()
        return (
            segments.join(nation, segments["c_nationkey"] == nation["n_nationkey"])
            .join(region, nation["n_regionkey"] == region["r_regionkey"])
            .selectExpr(
                "concat_ws(' ', n_name, c_mktsegment) AS state",
                "concat_ws('-', c_nationkey, c_mktsegment) AS state_code",
                "r_name AS region",
                "n_name AS division",
                "CAST(r_regionkey AS STRING) AS region_code",
            )
        )
