"""Helpers that several operators share: written intermediate tables, row keys, components of links."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder all machines share, as ``spark.checkpoint.dir`` names it.

    Only a session on one machine may leave it unset; it then gets a folder of its own.
    """
    folder = spark.conf.get(CHECKPOINT_SETTING, None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_SETTING} to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="quillmart-")
        spark.conf.set(CHECKPOINT_SETTING, folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back.

    Cuts the lineage: later jobs, and tasks of lost executors, read the files. The owner of the
    folder clears it.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rejoin(docs: DataFrame, decisions: DataFrame, id_col: str, how: str = "left") -> DataFrame:
    """Rows of ``docs`` as struct ``row`` next to the columns decided for their ``key_id``.

    Ids may be NULL; the columns of ``docs`` stay inside the struct, so no name can clash.
    """
    rows = docs.select(F.col(id_col).alias("row_id"), F.struct(*map(quoted, docs.columns)).alias("row"))
    return rows.join(decisions, rows["row_id"].eqNullSafe(decisions["key_id"]), how)


def quoted(name: str) -> Column:
    """The column of this very name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose texts add up to about ``most`` bytes, at least one row each."""
    sizes = np.array(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), np.int64)
    run = (np.cumsum(sizes) - sizes) // most
    starts = np.flatnonzero(np.diff(run, prepend=-1)) if len(run) else np.zeros(0, np.int64)
    for start, end in zip(starts, [*starts[1:], len(run)], strict=True):
        yield batch.slice(start, end - start)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which of the links ``a, b`` between ``n`` nodes make a spanning forest."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = np.zeros(len(a), bool)
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept[i] = True
    return kept


def components(nodes: DataFrame, links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from every node: columns ``node`` and ``component``.

    ``links`` holds pairs ``a``, ``b`` of nodes. Each round joins every node to the smallest label in
    its neighbourhood (large star), then short-cuts labels through labels (small star), until the links are
    stars. Labels are written to the shared folder every round; the rounds grow with the logarithm of the
    longest path. A node with a third of all links is no hot group, as each round only takes minima, which are
    combined before the shuffle.
    """
    edges = stored(
        links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "links",
    )
    for _ in range(max_rounds):
        if _stars(edges):
            break
        both = edges.select(F.inline(F.expr("array(struct(a AS n, b AS m), struct(b AS n, a AS m))")))
        low = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("low"))
        # Large star: neighbours above a node hang on the smallest label around it.
        large = both.join(low, "n").filter("m > n AND m <> low").select(F.col("low").alias("a"), F.col("m").alias("b"))
        # Small star: a node's smaller neighbours, and itself, hang on the smallest of them.
        down = large.groupBy("b").agg(F.min("a").alias("low"))
        small = (
            large.join(down, "b")
            .select(F.inline(F.expr("array(struct(low AS a, a AS b), struct(low AS a, b AS b))")))
            .filter("a <> b").distinct()
        )
        edges = stored(small, "links")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    labels = edges.select(F.col("a").alias("low"), "b")
    return nodes.join(labels, nodes["node"] == labels["b"], "left").select(
        "node", F.coalesce("low", "node").alias("component")
    )


def _stars(edges: DataFrame) -> bool:
    """Whether no ``b`` of the distinct pairs hangs on two nodes, or has another hanging on it."""
    ends = edges.select(F.inline(F.expr("array(struct(a AS n, 1 AS above, 0 AS below), struct(b AS n, 0 AS above, 1 AS below))")))
    held = ends.groupBy("n").agg(F.max("above").alias("above"), F.sum("below").alias("below"))
    return held.filter("below > 1 OR (below = 1 AND above = 1)").isEmpty()
