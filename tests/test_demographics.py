import pytest
from conftest import rows

from quillmart.operators import demographics


def test_gender_distribution_puts_the_rest_and_null_under_others(shop):
    got = rows(demographics.gender_distribution(shop.customer))
    assert got == [("Male", 2, 40.0), ("Others", 2, 40.0), ("Female", 1, 20.0)]


def test_language_share_is_of_those_who_state_one(shop):
    assert rows(demographics.language_share(shop.customer)) == [
        ("English", 3, 75.0),
        ("Swedish", 1, 25.0),
    ]


def test_shares_of_no_customers(shop):
    nobody = shop.customer.filter("customer_id < 0")
    assert rows(demographics.gender_distribution(nobody)) == []
    assert rows(demographics.language_share(nobody)) == []


def test_demographics_follow_the_columns_there_are(shop):
    assert set(demographics.demographics(shop.customer)) == {
        "gender_distribution",
        "language_share",
    }
    assert set(demographics.demographics(shop.customer.drop("gender"))) == {"language_share"}


def test_customer_scan(shop):
    scan = demographics.customer_scan(shop.customer)
    assert scan.columns == shop.customer.columns
    assert scan.count() == 5


@pytest.mark.parametrize("column", ["gender", "preferred_language"])
def test_scan_reads_only_the_column_counted(spark, shop, tmp_path, column):
    path = str(tmp_path / "customer")
    shop.customer.write.parquet(path)
    df = demographics.demographics(spark.read.parquet(path))[
        {"gender": "gender_distribution", "preferred_language": "language_share"}[column]
    ]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert f"ReadSchema: struct<{column}:string>" in plan
