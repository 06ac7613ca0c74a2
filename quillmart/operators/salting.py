"""Joins of many rows with few keys, such as customers with genres, that keep the rows spread.

A shuffle by such a key sends all rows to as many tasks as there are keys. A salted join adds a second key:
each of the many rows gets one of ``n`` salts from the hash of another column, and every row of the other side
is copied once for each salt. Nothing is lost, as every row of the many meets one copy of every row it would
have met. The other side has to be small against the many even so; where Spark finds it small enough to be
broadcast, no row is shuffled at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key that holds all rows is met by so many tasks at most.
MOST_SALTS = 1024


def salts(spark: SparkSession) -> int:
    """As many as a shuffle has partitions, which are set by the size of the largest shuffle."""
    return max(1, min(MOST_SALTS, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def salted_join(
    many: DataFrame, few: DataFrame, key: str, spread: str, how: str = "inner", n: int | None = None
) -> DataFrame:
    """``many.join(few, key, how)`` for an inner or left join, with rows of a key dealt by ``spread``."""
    if how not in ("inner", "left"):
        raise ValueError(f"{how!r}: rows of the copied side would appear once for every salt")
    n = salts(many.sparkSession) if n is None else n
    dealt = many.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(n)).cast("int"))
    copies = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return dealt.join(copies, [key, "salt"], how).drop("salt")
