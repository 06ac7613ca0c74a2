"""Session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# All but the time zone are Spark's defaults; named here because the operators depend on them.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.exchange.reuse": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}

PARTITION_BYTES = 200 * 1024**2


def cluster_settings(cores: int, largest_shuffle_bytes: int) -> dict[str, str]:
    """Settings for a cluster, from its cores and the bytes of its largest shuffle.

    The largest shuffle is the order lines by order id, two to three columns of each. AQE merges the
    partitions that turn out small, so the number is chosen for the largest one.
    """
    partitions = max(3 * cores, -(-largest_shuffle_bytes // PARTITION_BYTES))
    return SETTINGS | {"spark.sql.shuffle.partitions": str(partitions)}


def local_session(cores: int | str = "*", app: str = "quillmart", **settings: str) -> SparkSession:
    """A single-machine session for tests and measurements."""
    partitions = "8" if cores == "*" else str(cores)
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = SETTINGS | {
        "spark.sql.shuffle.partitions": partitions,
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    }
    for key, value in (conf | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
