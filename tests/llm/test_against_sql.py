"""Every corpus query that has SQL against it, on whole tables."""

import math
import os

import duckdb
import pytest
from conftest import rows

from quillmart.llm import oracle, registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("documents", "embeddings", "labels"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def rounded(row):
    return tuple(float(f"{x:.9g}") if isinstance(x, float) and math.isfinite(x) else x for x in row)


@pytest.mark.parametrize("name", oracle.oracle_sql())
def test_same_columns_types_and_rows(spark, duck, name):
    df = registry.queries()[name](spark, SF_DIR)
    result = duck.execute(oracle.oracle_sql()[name])
    types = {c[0]: TYPES[str(c[1])] for c in result.description}
    assert dict(df.dtypes) == types
    expected = [dict(zip(types, r, strict=True)) for r in result.fetchall()]
    columns = sorted(types)
    got = sorted(map(rounded, rows(df.select(columns))), key=repr)
    assert got == sorted((rounded(tuple(r[c] for c in columns)) for r in expected), key=repr)
    assert got
