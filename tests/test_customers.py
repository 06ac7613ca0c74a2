from conftest import day, money, rows

from quillmart.operators import customers, relations

AS_OF = day("2023-08-29")  # 90 days after customer 11's last order


def test_churn_is_strictly_more_than_the_days(shop):
    got = rows(customers.churn_risk(shop.orders, days=90, as_of=AS_OF))
    assert got == [(14, day("2022-12-31"), 241), (10, day("2023-03-20"), 162)]
    assert (11, day("2023-05-31"), 90) in rows(customers.churn_risk(shop.orders, 89, AS_OF))


def test_churn_counts_from_today_unless_told(make, spark):
    today = spark.sql("SELECT current_date() AS d").first().d
    orders = make.orders([(1, 1, today, None), (2, 2, day("2000-01-01"), None)])
    assert [r[0] for r in rows(customers.churn_risk(orders, 1))] == [2]


def test_churn_ignores_customers_without_a_dated_order(make):
    orders = make.orders([(1, 1, None, None), (2, 2, day("2000-01-01"), None)])
    got = rows(customers.churn_risk(orders, 1, "2001-01-01"))
    assert got == [(2, day("2000-01-01"), 366)]


def test_recency(shop):
    assert rows(customers.recency(shop.orders, "2024-03-02", customer_id=12)) == [
        (12, day("2024-03-01"), 1)
    ]
    assert rows(customers.recency(shop.orders, AS_OF, customer_id=404)) == []
    assert len(rows(customers.recency(shop.orders, AS_OF))) == 4


def test_monetary(shop):
    got = rows(customers.monetary(shop.orders, shop.customer))
    assert sorted(got) == [
        (10, "Ada", "Lee", money("42.50")),
        (11, "Bo", "Ek", money("30.01")),
        (12, "Cy", "Oz", money("104.99")),
        (14, "Ed", "Ax", money("7.00")),
    ]
    assert rows(customers.monetary(shop.orders, shop.customer, 11)) == [
        (11, "Bo", "Ek", money("30.01"))
    ]


def test_average_order_value_is_not_rounded(shop):
    assert rows(customers.average_order_value(shop.orders, shop.customer, 11)) == [
        (11, "Bo", "Ek", 30.01 / 2)
    ]


def test_lifetime_value_is_mean_times_orders(shop):
    got = rows(customers.customer_lifetime_value(shop.orders, shop.customer))
    assert sorted(got) == [
        (10, "Ada", "Lee", 42.5),
        (11, "Bo", "Ek", 30.01),
        (12, "Cy", "Oz", 104.99),
        (14, "Ed", "Ax", 7.0),
    ]
    assert sorted(rows(relations.customer_total_orders(shop.orders))) == [
        (10, 2),
        (11, 2),
        (12, 2),
        (14, 1),
    ]


def test_an_order_without_amount_counts_but_is_not_averaged(make):
    customer = make.customer([(1, "A", "B", None, None), (2, "C", "D", None, None)])
    orders = make.orders(
        [(1, 1, None, money("10.00")), (2, 1, None, None), (3, 2, None, None)]
    )
    assert sorted(rows(customers.customer_lifetime_value(orders, customer))) == [
        (1, "A", "B", 20.0),
        (2, "C", "D", None),
    ]
    assert sorted(rows(customers.average_order_value(orders, customer))) == [
        (1, "A", "B", 10.0),
        (2, "C", "D", None),
    ]


def test_mean_gap_leaves_out_single_orders(shop):
    got = rows(customers.avg_days_between_purchases(shop.orders))
    assert sorted(got) == [(10, 74.0), (11, 91.0), (12, 1.0)]


def test_mean_gap_is_rounded_and_skips_undated_orders(make):
    orders = make.orders(
        [
            (1, 1, day("2023-01-01"), None),
            (2, 1, day("2023-01-01"), None),
            (3, 1, day("2023-01-03"), None),
            (4, 1, day("2023-01-11"), None),
            (5, 1, None, None),
            (6, 2, day("2023-01-01"), None),
            (7, 2, None, None),
        ]
    )
    assert rows(customers.avg_days_between_purchases(orders)) == [(1, 3.33)]


def test_tenure(shop):
    got = rows(customers.tenure(shop.orders))
    assert (14, day("2022-12-31"), day("2022-12-31"), 0) in got
    assert (10, day("2023-01-05"), day("2023-03-20"), 74) in got
    assert rows(customers.tenure(shop.orders, 404)) == []
