"""Writers for results, for intermediate tables and for a layout that saves the fact join its shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmart.schemas import SALES_YEAR


def write_result(
    df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "errorifexists"
) -> None:
    """Write a result as Parquet, optionally in one folder per value of ``partition_by``.

    Rows of a folder are brought together first, which keeps the number of files low; AQE splits a
    folder that is much larger than the others over several tasks.
    """
    grouped = df.hint("rebalance", *partition_by) if partition_by else df
    grouped.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_bucketed(
    df: DataFrame,
    table: str,
    key: str,
    buckets: int,
    path: str | None = None,
    mode: str = "errorifexists",
) -> None:
    """Write a catalog table bucketed and sorted by ``key``.

    With ``orders`` and ``order_details`` both written by ``order_id`` into the same number of
    buckets, every operator over sales lines joins them without a shuffle. The rows are sent to
    their bucket first, so that there is one file per bucket and not one per task and bucket.

    A bucket is read by one task and is not split by AQE: where one order may hold a large part of the
    lines, write both tables with ``write_bucketed_sales``.
    """
    writer = (
        df.repartition(buckets, key)
        .write.mode(mode)
        .format("parquet")
        .bucketBy(buckets, key)
        .sortBy(key)
    )
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def heavy_keys(df: DataFrame, key: str, most_rows: int) -> DataFrame:
    """Keys with more than ``most_rows`` rows: fewer than rows / ``most_rows``. Counted on the map side first."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return counts.filter(F.col(key).isNotNull() & (F.col("n") > most_rows)).select(key)


def write_bucketed_sales(
    orders: DataFrame,
    order_details: DataFrame,
    database: str,
    buckets: int,
    heavy_rows: int,
    path: str | None = None,
    mode: str = "errorifexists",
) -> None:
    """Write orders and lines into ``database`` so that their join needs no shuffle and no task is hot.

    Orders of at most ``heavy_rows`` lines go to ``orders`` and ``order_details``, bucketed by
    ``order_id``. A heavier order would fill the one task that reads its bucket: its lines go to
    ``heavy_details``, in files of as many rows as tasks wrote, and its row to ``heavy_orders``, which has
    fewer than lines / ``heavy_rows`` rows. ``read_bucketed_sales`` puts both together again. Lines of
    orders that do not exist are kept like others; orders without lines stay with the light ones.

    The heavy keys are written first, so that both splits read one list of them.
    """
    spark = orders.sparkSession

    def save(df: DataFrame, name: str) -> DataFrame:
        writer = df.write.mode(mode).format("parquet")
        if path is not None:
            writer = writer.option("path", f"{path.rstrip('/')}/{name}")
        writer.saveAsTable(f"{database}.{name}")
        return spark.table(f"{database}.{name}")

    def bucketed(df: DataFrame, name: str) -> None:
        folder = None if path is None else f"{path.rstrip('/')}/{name}"
        write_bucketed(df, f"{database}.{name}", "order_id", buckets, folder, mode)

    heavy = save(heavy_keys(order_details, "order_id", heavy_rows), "heavy_order_ids")
    bucketed(orders.join(heavy, "order_id", "left_anti"), "orders")
    bucketed(order_details.join(heavy, "order_id", "left_anti"), "order_details")
    save(orders.join(heavy, "order_id", "left_semi"), "heavy_orders")
    save(order_details.join(heavy, "order_id", "left_semi"), "heavy_details")


def read_bucketed_sales(spark: SparkSession, database: str) -> DataFrame:
    """Order lines with the columns of their order, from tables of ``write_bucketed_sales``.

    The light lines are joined bucket by bucket. The heavy ones meet the few heavy orders by a broadcast
    where Spark finds these small enough, else by a join of which AQE splits hot partitions. Operators
    over sales take the result as ``lines=``.
    """

    def joined(details: str, orders: str) -> DataFrame:
        return spark.table(f"{database}.{details}").join(spark.table(f"{database}.{orders}"), "order_id")

    return joined("order_details", "orders").unionByName(joined("heavy_details", "heavy_orders"))


def write_sales_lines(
    orders: DataFrame, order_details: DataFrame, path: str, mode: str = "errorifexists"
) -> None:
    """Write order lines with the columns of their order, in one folder per year.

    Sales of a year then read that year alone, and no operator over lines joins orders. Lines of
    undated orders go to a folder of their own.
    """
    lines = order_details.join(orders, "order_id").withColumn(SALES_YEAR, F.year("order_date"))
    write_result(lines, path, (SALES_YEAR,), mode)


def store(df: DataFrame, folder: str, name: str) -> DataFrame:
    """A result that later plans use, written to ``folder`` under ``name`` and read back.

    The files tell the planner its true size before a job starts, and losing executors does not cost
    its computation. An earlier result of the name is replaced, so a folder holds one of each. On a
    cluster the folder has to be one that all machines share: a path of the local file system is
    refused there, as every executor would write to its own disk.
    """
    spark = df.sparkSession
    local = spark.sparkContext.master.split("[")[0] == "local"
    if not local and (folder.startswith(("file:", "/")) or "://" not in folder):
        raise ValueError(f"{folder!r} does not name a file system that all machines share")
    path = f"{folder.rstrip('/')}/{name}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
