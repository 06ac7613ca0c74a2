"""Customer value and churn, one aggregate over orders each.

The customer metrics return every customer with an order, unsorted; ``customer_id`` narrows them to
one, and the predicate reaches the scan. An unknown customer gives no rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmart.functions import days_since
from quillmart.operators.relations import (
    customer_avg_value,
    mean_amount,
    only_customer,
    with_names,
)


def recency(
    orders: DataFrame, as_of: dt.date | str | None = None, customer_id: int | None = None
) -> DataFrame:
    """Last order date and the days since then."""
    return (
        only_customer(orders, customer_id)
        .groupBy("customer_id")
        .agg(F.max("order_date").alias("last_order_date"))
        .withColumn("days_since_order", days_since(F.col("last_order_date"), as_of))
    )


def churn_risk(
    orders: DataFrame,
    days: int = 90,
    as_of: dt.date | str | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Customers whose last order is strictly more than ``days`` days ago, longest absence first."""
    absent = recency(orders, as_of).filter(F.col("days_since_order") > int(days))
    return absent.orderBy(F.desc("days_since_order"), "customer_id") if ordered else absent


def monetary(
    orders: DataFrame, customer: DataFrame, customer_id: int | None = None
) -> DataFrame:
    """Total spend to two decimals, with names joined after the aggregation."""
    return with_names(
        only_customer(orders, customer_id)
        .groupBy("customer_id")
        .agg(F.round(F.sum("total_amount"), 2).alias("total_spend")),
        customer,
    )


def average_order_value(
    orders: DataFrame, customer: DataFrame, customer_id: int | None = None
) -> DataFrame:
    """Mean order value."""
    return customer_avg_value(orders, customer, customer_id)


def customer_lifetime_value(
    orders: DataFrame, customer: DataFrame, customer_id: int | None = None
) -> DataFrame:
    """Mean order value times number of orders, to two decimals.

    Both factors come from one pass over the orders. An order without an amount counts as an order
    but not in the mean.
    """
    value = F.round(mean_amount() * F.count("*"), 2)
    return with_names(
        only_customer(orders, customer_id)
        .groupBy("customer_id")
        .agg(value.alias("life_time_value")),
        customer,
    )


def avg_days_between_purchases(orders: DataFrame, customer_id: int | None = None) -> DataFrame:
    """Mean gap in days between consecutive orders; customers with one dated order are absent.

    The gaps add up to last minus first, so no window and no sort are needed.
    """
    span = F.datediff(F.max("order_date"), F.min("order_date"))
    gap = F.try_divide(span, F.count("order_date") - 1)
    return (
        only_customer(orders, customer_id)
        .groupBy("customer_id")
        .agg(F.round(gap, 2).alias("avg_days_between_purchases"))
        .filter(F.col("avg_days_between_purchases").isNotNull())
    )


def tenure(orders: DataFrame, customer_id: int | None = None) -> DataFrame:
    """First and latest order date and the days between them."""
    return (
        only_customer(orders, customer_id)
        .groupBy("customer_id")
        .agg(
            F.min("order_date").alias("first_order_date"),
            F.max("order_date").alias("latest_order_date"),
        )
        .withColumn("tenure", F.datediff("latest_order_date", "first_order_date"))
    )
