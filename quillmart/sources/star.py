"""The star schema as a bundle of DataFrames, and loaders for it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillmart import schemas
from quillmart.sources.key_ranges import key_quantiles, quantile_predicates


FACTS = ("orders", "order_details", "reviews")


class MissingColumnsError(ValueError):
    """A table lacks columns its schema requires."""


@dataclass(frozen=True)
class StarTables:
    """The seven tables of ``schemas.TABLES``."""

    orders: DataFrame
    order_details: DataFrame
    books: DataFrame
    genre: DataFrame
    publisher: DataFrame
    customer: DataFrame
    reviews: DataFrame


def conform(
    df: DataFrame,
    schema: StructType,
    optional: tuple[str, ...] = (),
    keep_extra: bool = False,
) -> DataFrame:
    """Check that the columns of ``schema`` exist, in any case, and cast them to its types.

    Columns in ``optional`` may be missing and stay missing. Other columns are dropped unless
    ``keep_extra`` is set. Only the plan is touched: a scan still reads just the columns used.
    """
    found = {c.lower(): c for c in df.columns}
    missing = [f.name for f in schema if f.name not in found and f.name not in optional]
    if missing:
        raise MissingColumnsError(f"missing columns {missing}; found {df.columns}")
    fits = {f.name: df.schema[f.name].dataType == f.dataType for f in schema if f.name in df.columns}
    # A column that fits is taken as it is: an alias around it would tell two uses of the table
    # apart in a union and keep them from sharing a shuffle.
    wanted = [
        F.col(f.name)
        if fits.get(f.name)
        else F.col(found[f.name]).cast(f.dataType).alias(f.name)
        for f in schema
        if f.name in found
    ]
    extra = [F.col(c) for c in df.columns if keep_extra and c.lower() not in schema.names]
    return df.select(*wanted, *extra)


def conform_table(name: str, df: DataFrame) -> DataFrame:
    """``conform`` for one of the seven tables; the customer table keeps all its columns."""
    return conform(
        df,
        schemas.TABLES[name],
        optional=schemas.OPTIONAL_COLUMNS.get(name, ()),
        keep_extra=name == "customer",
    )


def load_star(spark: SparkSession, root: str, file_format: str = "parquet") -> StarTables:
    """Load ``{root}/{table}`` for every table of the star."""
    return _load(lambda name: spark.read.format(file_format).load(f"{root}/{name}"))


def load_star_catalog(spark: SparkSession, database: str) -> StarTables:
    """Load the star from catalog tables ``{database}.{table}``."""
    return _load(lambda name: spark.table(f"{database}.{name}"))


def load_star_jdbc(
    spark: SparkSession,
    url: str,
    properties: dict[str, str],
    bounds: dict[str, tuple[str, int, int, int]],
    predicates: dict[str, list[str]] | None = None,
) -> StarTables:
    """Load the star from a database.

    ``bounds`` gives (key column, lowest key, highest key, partitions) for each table to be read by
    several tasks. The keys outside the bounds are read too, by the first and last of them.
    ``predicates`` gives, instead, a condition for every task; those of ``quantile_predicates`` hold
    equal numbers of rows where keys are not evenly used. A table without either is read by one task;
    the fact tables have to have one. The driver for the database has to be on Spark's class path.
    """
    predicates = predicates or {}
    missing = [name for name in FACTS if name not in bounds and name not in predicates]
    if missing:
        raise ValueError(f"bounds are missing for {missing}, which one task cannot read")

    def read(name: str) -> DataFrame:
        if name in predicates:
            return spark.read.jdbc(url, name, predicates=predicates[name], properties=properties)
        if name not in bounds:
            return spark.read.jdbc(url, name, properties=properties)
        column, lower, upper, partitions = bounds[name]
        return spark.read.jdbc(
            url,
            name,
            column=column,
            lowerBound=lower,
            upperBound=upper,
            numPartitions=partitions,
            properties=properties,
        )

    return _load(read)


def skewed_predicates(
    spark: SparkSession,
    url: str,
    properties: dict[str, str],
    table: str,
    bounds: tuple[str, int, int, int],
    parts: int,
    deal_by: str | None = None,
) -> list[str]:
    """Conditions for ``predicates`` of ``load_star_jdbc``, from the quantiles of a table's keys.

    Only the key column is read for them, in the even ranges of ``bounds``.
    """
    column, lower, upper, partitions = bounds
    keys = spark.read.jdbc(
        url, table, column=column, lowerBound=lower, upperBound=upper, numPartitions=partitions, properties=properties
    ).select(column)
    return quantile_predicates(column, key_quantiles(keys, column, parts), deal_by)


def _load(read) -> StarTables:
    return StarTables(**{name: conform_table(name, read(name)) for name in schemas.TABLES})
