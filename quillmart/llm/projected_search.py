"""Approximate nearest neighbours by inner product: stable projections in a kd-tree, with a stopping test.

Vectors get one more component that gives all of them one length, so that the largest inner product is the
smallest distance; a query is scaled to that length, which does not change its ranks, and its own added
component is 0. A Gaussian projection to few dimensions follows: squared projected distance over squared
distance has a chi-square distribution. The leaves of a kd-tree over the projections are blocks of rows.
A query first verifies its own leaf, then the others in rounds, nearest first and four times as many leaves a
round. It stops when the test holds for all leaves left: a nearer vector than its k-th best would with
probability ``confidence`` lie nearer than they do. In every block it verifies rows in the order of their
projected distance until the same test holds. A query with fewer than k candidates so far visits on.

The tree's splits are fitted on a bounded sample; every row is in the index. A leaf with more than
``block_rows`` rows, such as copies of one vector, is cut into several blocks, and so are the queries that
visit a block.

Defined results: vectors that are NULL, zero, of another length than most, or hold NULL or non-finite
components take no part, as queries or as candidates; neither do rows without an id. Rows that share an id
count once. Equal scores rank by the smaller id. An empty table gives an empty result. Only the id and the
vector are read, so other columns cannot clash. Vectors of any finite length are searched: distances are
taken of scaled vectors, and queries meet the candidates scaled by powers of two, so that ranks do not depend
on whether a score is within the range of doubles. A score beyond it is returned as infinite.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmart.llm.common import stored
from quillmart.llm.vectors import common_length, lists, matrix, one_per_id


@dataclass(frozen=True)
class Settings:
    """What the index depends on."""

    dims: int = 12  # of the projection; even
    confidence: float = 0.95
    sample_rows: int = 50_000  # most rows the splits are fitted on
    block_rows: int = 4096
    step: int = 512  # rows verified between two tests
    first_leaves: int = 4  # visited in the first round after the own leaf
    seed: int = 20


def chi_square_quantile(p: float, dims: int) -> float:
    """The value below which a chi-square variable of an even number of dimensions lies with ``p``."""

    def below(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(dims // 2))

    low, high = 0.0, 20.0 * dims + 100
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def split_tree(points: np.ndarray, leaf_rows: int) -> list[tuple[int, float, int, int]]:
    """Nodes ``dimension, value, left, right`` of a kd-tree; a leaf is ``-1, 0, number, 0``."""
    nodes: list[tuple[int, float, int, int]] = []
    leaves = 0

    def grow(rows: np.ndarray) -> int:
        nonlocal leaves
        at = len(nodes)
        nodes.append((-1, 0.0, 0, 0))
        axis = int(np.argmax(rows.max(0) - rows.min(0))) if len(rows) > leaf_rows else -1
        value = float(np.median(rows[:, axis])) if axis >= 0 else 0.0
        right = rows[:, axis] >= value if axis >= 0 else np.zeros(len(rows), bool)
        if not right.any() or right.all():
            nodes[at] = (-1, 0.0, leaves, 0)
            leaves += 1
        else:
            nodes[at] = (axis, value, grow(rows[~right]), grow(rows[right]))
        return at

    grow(points)
    return nodes


def leaf_of(points: np.ndarray, nodes: list[tuple[int, float, int, int]]) -> np.ndarray:
    out = np.zeros(len(points), np.int32)

    def walk(node: int, rows: np.ndarray) -> None:
        axis, value, left, right = nodes[node]
        if axis < 0:
            out[rows] = left
        elif len(rows):
            over = points[rows, axis] >= value
            walk(left, rows[~over])
            walk(right, rows[over])

    walk(0, np.arange(len(points)))
    return out


def scaled(x: np.ndarray, bits: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Rows times a power of two each that makes the largest component less than 2 ** -bits, and the powers taken out."""
    power = np.frexp(np.abs(x).max(1))[1] + bits
    return np.ldexp(x, -power[:, None]), power


def reach(queries: np.ndarray, bounds: np.ndarray, power: int, longest: float, limit: float) -> np.ndarray:
    """Squared projected distances within which a row with a score of ``bounds`` lies by the test.

    ``power`` is that of the rows, ``longest`` the squared length of the scaled rows. Rounding must not put a
    copy of the query out of reach, so a little is added.
    """
    to_length = math.sqrt(longest) / np.linalg.norm(queries, axis=1)
    return limit * np.maximum(0, 2 * longest - 2 * to_length * np.ldexp(bounds, -power)) + 1e-9 * longest


def best_in_block(
    queries: np.ndarray,
    query_ids: np.ndarray,
    near: np.ndarray,
    bounds: np.ndarray,
    points: np.ndarray,
    ids: np.ndarray,
    points_near: np.ndarray,
    k: int,
    within: Callable[[np.ndarray, np.ndarray], np.ndarray],
    step: int,
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query its number, and ids and scores of its best rows in a block.

    ``near`` and ``points_near`` are projections, ``bounds`` the k-th best scores known so far, minus infinity
    where none is; ``within`` gives the reach of queries for scores.
    """
    at_first = within(queries, bounds)
    for i, q in enumerate(queries):
        gap = points_near - near[i]
        gap = np.einsum("ij,ij->i", gap, gap)
        least = bounds[i]
        left = np.flatnonzero((gap <= at_first[i]) & (ids != query_ids[i]))
        left = left[np.argsort(gap[left], kind="stable")]
        held_at, held = np.zeros(0, np.int64), np.zeros(0)
        for start in range(0, len(left), step):
            part = left[start : start + step]
            if gap[part[0]] > within(q[None], np.array([least]))[0]:
                break
            # Row by row sums: equal vectors get equal scores.
            score = (points[part] * q).sum(1)
            keep = score >= least
            held_at, held = np.append(held_at, part[keep]), np.append(held, score[keep])
            if len(held) > k:
                order = np.lexsort((ids[held_at], -held))[:k]
                held_at, held = held_at[order], held[order]
                least = max(least, held[-1])
        if len(held):
            yield i, ids[held_at], held


def search(
    rows: DataFrame,
    is_query: Column,
    k: int,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    settings: Settings | None = None,
) -> DataFrame:
    """The ``k`` rows of largest inner product with each query: ``query_id, rank, vec_id, score``.

    ``is_query`` is a condition on ``id``. A query's own row is no candidate.
    """
    s = settings or Settings()
    spark = rows.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    clean = stored(one_per_id(rows, id_col, vec_col).withColumn("id", F.col("id").cast("long")), "vectors")
    dim = common_length(clean)
    if dim is None:
        return spark.createDataFrame([], result)
    clean = clean.filter(F.size("vec") == dim)
    n, largest = clean.agg(F.count("*"), F.max(F.array_max(F.transform("vec", F.abs)))).first()
    power = math.frexp(largest)[1]
    # In two steps: one factor may be beyond the range of doubles.
    half = -power // 2
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + F.pow(x * 2.0**half * 2.0 ** (-power - half), F.lit(2.0)))
    longest = clean.agg(F.max(square)).first()[0]
    limit = chi_square_quantile(s.confidence, s.dims)
    plane = np.random.default_rng(s.seed).standard_normal((dim + 1, s.dims))
    within = partial(reach, power=power, longest=longest, limit=limit)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.ldexp(matrix(batch.column(1), dim), -power)
            rest = np.sqrt(np.maximum(0, longest - (x * x).sum(1)))
            near = np.column_stack([x, rest]) @ plane
            yield pa.RecordBatch.from_arrays([*batch.columns, lists(near)], names=["id", "vec", "near"])

    projected = clean.mapInArrow(project, "id long, vec array<double>, near array<double>")
    sample = projected.select("id", "near").orderBy(F.xxhash64("id"), "id").limit(s.sample_rows)
    points = np.array([r["near"] for r in sample.select("near").collect()])
    # Leaves of block_rows rows, as far as the sample can tell them apart.
    tree = split_tree(points, max(16, math.ceil(s.block_rows * len(points) / n)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = leaf_of(matrix(batch.column(2), s.dims), tree)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*"id vec near leaf".split()])

    placed = stored(
        projected.mapInArrow(assign, "id long, vec array<double>, near array<double>, leaf int"), "placed"
    )
    # At most as many rows as the tree has leaves, and so bounded by the sample.
    sides = [f(F.col("near")[j]).alias(f"{name}{j}") for j in range(s.dims) for name, f in (("lo", F.min), ("hi", F.max))]
    boxes = sorted(placed.groupBy("leaf").agg(F.count("*").alias("n"), *sides).collect(), key=lambda r: r["leaf"])
    leaves = np.array([r["leaf"] for r in boxes])
    low, high = (np.array([[r[f"{name}{j}"] for j in range(s.dims)] for r in boxes]) for name in ("lo", "hi"))
    parts = spark.createDataFrame([(r["leaf"], math.ceil(r["n"] / s.block_rows)) for r in boxes], "leaf int, parts int")
    blocks = placed.join(F.broadcast(parts), "leaf").select(
        F.struct("leaf", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part")).alias("in_block"),
        *(F.col(c).alias(f"p_{c}") for c in ("id", "vec", "near")),
    )

    asking = "id long, vec array<double>, power int, near array<double>"
    spare = math.ceil(math.log2(dim)) + 1  # bits: no inner product of a scaled query overflows

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Scaled vector, power taken out, projection and leaf of a row as a query."""
        for batch in batches:
            x, out = scaled(matrix(batch.column(1), dim), spare)
            near = x * (math.sqrt(longest) / np.linalg.norm(x, axis=1))[:, None] @ plane[:dim]
            columns = [batch.column(0), lists(x), pa.array(out, pa.int32()), lists(near), pa.array(leaf_of(near, tree))]
            yield pa.RecordBatch.from_arrays(columns, names=[*"id vec power near leaf".split()])

    queries = placed.filter(is_query).select("id", "vec").mapInArrow(ask, f"{asking}, leaf int")

    def visit(first: int, last: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the other leaves, nearest first, the ``first`` to ``last`` as far as they are in reach of each query."""
        names = ["id", "vec", "power", "near", "bound", "leaf"]
        for batch in batches:
            own, bound = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            near = matrix(batch.column(3), s.dims)
            furthest = within(matrix(batch.column(1), dim), bound)
            for i in range(len(near)):
                gap = np.maximum(0, np.maximum(low - near[i], near[i] - high))
                gap = (gap * gap).sum(1)
                order = np.argsort(gap, kind="stable")
                order = order[leaves[order] != own[i]][first:last]
                to = leaves[order[gap[order] <= furthest[i]]]
                row = batch.slice(i, 1).take(pa.array(np.zeros(len(to), np.int64)))
                columns = [*row.columns[:4], row.column(5), pa.array(to, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    def verify(visits: DataFrame) -> DataFrame:
        """Best rows of the blocks of the leaves that queries visit."""
        to = visits.join(F.broadcast(parts), "leaf").select(
            "id", "vec", "power", "near", "bound", "leaf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
        ).select(F.struct("leaf", "part").alias("block"), "id", "vec", "power", "near", "bound")
        crowds = to.groupBy("block").agg(F.ceil(F.count("*") / s.block_rows).cast("int").alias("crowds"))
        asked = to.join(crowds, "block").withColumn("crowd", F.pmod(F.xxhash64("id"), "crowds").cast("int"))
        asked_of = blocks.join(crowds, F.col("in_block") == F.col("block")).select(
            "p_id", "p_vec", "p_near", F.col("in_block").alias("of"),
            F.explode(F.sequence(F.lit(0), F.col("crowds") - 1)).alias("of_crowd"),
        )

        def run(q: pa.Table, p: pa.Table) -> pa.Table:
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0))]
            if q.num_rows and p.num_rows:
                q_ids, power = q["id"].to_numpy(), q["power"].to_numpy()
                found = best_in_block(
                    matrix(q["vec"], dim), q_ids, matrix(q["near"], s.dims), q["bound"].to_numpy(),
                    matrix(p["p_vec"], dim), p["p_id"].to_numpy(), matrix(p["p_near"], s.dims),
                    k, within, s.step,
                )
                out += [(np.full(len(ids), q_ids[i]), np.full(len(ids), power[i]), ids, score) for i, ids, score in found]
            columns = [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]
            return pa.Table.from_arrays(columns, names=["query_id", "power", "vec_id", "scaled"])

        return (
            asked.groupBy("block", "crowd").cogroup(asked_of.groupBy("of", "of_crowd"))
            .applyInArrow(run, "query_id long, power int, vec_id long, scaled double")
        )

    by_rank = Window.partitionBy("query_id").orderBy(F.desc("scaled"), "vec_id")

    def best(found: DataFrame) -> DataFrame:
        return stored(found.withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= k), "nearest")

    none = F.lit(float("-inf"))  # no bound is known yet
    nearest = best(verify(queries.withColumn("bound", none)))
    first, width = 0, s.first_leaves
    while first < len(leaves) - 1:
        kth = nearest.filter(F.col("rank") == k).select(F.col("query_id").alias("of"), F.col("scaled").alias("kth"))
        bounded = queries.join(kth, F.col("id") == F.col("of"), "left").select(
            "id", "vec", "power", "near", "leaf", F.coalesce("kth", none).alias("bound")
        )
        visits = stored(
            bounded.mapInArrow(partial(visit, first, first + width), f"{asking}, bound double, leaf int"), "visits"
        )
        # The leaves come nearest first: those of later rounds are out of reach too.
        if visits.isEmpty():
            break
        nearest = best(nearest.drop("rank").unionByName(verify(visits)))
        first, width = first + width, 4 * width
    low_half = F.floor(F.col("power") / 2)
    score = F.col("scaled") * F.pow(F.lit(2.0), low_half) * F.pow(F.lit(2.0), F.col("power") - low_half)
    return nearest.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", score.alias("score"))
