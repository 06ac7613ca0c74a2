"""Near-duplicate vectors by an inverted multi-index.

The halves of the unit vectors get codebooks of their own; pairs of codes are the cells of a grid. A vector
lies in the cell of its nearest codes and visits cells in the order of the multi-sequence algorithm, by the
sum of its squared distances to the two codes, as far as the target recall asks: the reach is the excess
over the nearest cell within which, for sampled vectors turned by the angle of the threshold, the share
``recall`` of the turned vectors lie. Vectors of visited cells are verified by their cosine.

Codebooks and reach are fitted on a bounded sample; every vector is in the index. Rows meet by label and first
code, in blocks; there the rows of a cell are compared with its visitors alone. Equal vectors of a label
are verified once. A pair is seen from its first vector or its second; it is counted once for each. Pairs
are not listed: blocks of at most ``block_rows`` rows a side return link counts and a spanning forest of
their links, so a group of near copies costs as many rows as it has members per block.

Defined results: vectors that are NULL, zero, of another length than most, or hold NULL or non-finite
components, and vectors without a label, link with nothing; their component is their own id. Rows that
share an id count once, with the smallest (label, vector) that can be linked. Rows without an id have no
result. An empty table gives an empty result. Only id, vector and label are read, so other columns cannot
clash. Vectors of any finite length count by their direction.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmart.llm.common import components, forest, quoted, stored
from quillmart.llm.vectors import common_length, lists, matrix, usable


@dataclass(frozen=True)
class Settings:
    """What the index depends on."""

    recall: float = 0.99
    sample_rows: int = 20_000  # most rows codebooks and reach are fitted on
    cell_rows: int = 64  # rows wanted per cell of a label
    most_codes: int = 1024
    rounds: int = 8  # of Lloyd's algorithm
    block_rows: int = 2048
    seed: int = 8


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T)


def codebook(x: np.ndarray, codes: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of Lloyd's algorithm; a centre that loses all rows stays where it is."""
    centres = x[rng.choice(len(x), codes, replace=False)]
    for _ in range(rounds):
        nearest = squared(x, centres).argmin(1)
        n = np.bincount(nearest, minlength=codes)
        total = np.zeros_like(centres)
        np.add.at(total, nearest, x)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


@dataclass(frozen=True)
class MultiIndex:
    """Two codebooks and the reach; their size depends on the settings alone."""

    books: tuple[np.ndarray, np.ndarray]
    reach: float

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """To the codes of either half, less that to the nearest code."""
        half = self.books[0].shape[1]
        found = squared(x[:, :half], self.books[0]), squared(x[:, half:], self.books[1])
        return tuple(d - d.min(1, keepdims=True) for d in found)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return np.column_stack([a.argmin(1), b.argmin(1)])

    def visited(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Per row and first code: the second codes of the cells within reach.

        Both lists of distances are sorted, and the grid is followed along its frontier: the cells of
        a first code are a prefix of the second list that shrinks from one first code to the next.
        """
        a, b = self.distances(x)
        order_a, order_b = a.argsort(1, kind="stable"), b.argsort(1, kind="stable")
        for i in range(len(x)):
            sorted_b = b[i, order_b[i]]
            for code in order_a[i]:
                n = np.searchsorted(sorted_b, self.reach - a[i, code], "right")
                if n == 0:
                    break
                yield i, int(code), order_b[i, :n]


def fit(sample: np.ndarray, n: int, cosine: float, s: Settings) -> MultiIndex:
    """Codebooks and reach for ``n`` rows a label, from unit vectors."""
    rng = np.random.default_rng(s.seed)
    codes = int(min(s.most_codes, max(1, len(sample) // 8), max(1, round(math.sqrt(n / s.cell_rows)))))
    half = sample.shape[1] // 2
    books = tuple(codebook(x, codes, s.rounds, rng) for x in (sample[:, :half], sample[:, half:]))
    index = MultiIndex(books, 0.0)
    # Sampled vectors turned in a random direction by the angle of the threshold.
    turned = rng.standard_normal(sample.shape)
    turned -= (turned * sample).sum(1, keepdims=True) * sample
    turned /= np.maximum(np.linalg.norm(turned, axis=1, keepdims=True), 1e-12)
    cells = index.cells(cosine * sample + math.sqrt(1 - cosine * cosine) * turned)
    a, b = index.distances(sample)
    at = np.arange(len(sample))
    excess = a[at, cells[:, 0]] + b[at, cells[:, 1]]
    return MultiIndex(books, float(np.quantile(excess, s.recall)) + 1e-12)


def near_duplicates(
    rows: DataFrame,
    cosine: float,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    settings: Settings | None = None,
) -> DataFrame:
    """One row per id: ``vec_id, n_links, component_id, kept``; links are within a label."""
    s = settings or Settings()
    vec = quoted(vec_col).cast("array<double>")
    known = rows.filter(quoted(id_col).isNotNull()).select(
        quoted(id_col).cast("long").alias("id"), quoted(label_col).alias("label"), vec.alias("vec"),
        (usable(vec) & quoted(label_col).isNotNull()).alias("linked"),
    )
    first = F.min(F.when(F.col("linked"), F.struct("label", "vec"))).alias("first")
    each = stored(known.groupBy("id").agg(first).select("id", "first.*"), "vectors")
    dim = common_length(each.filter("vec IS NOT NULL"))
    if dim is None:
        return each.select(
            F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"),
            F.col("id").alias("component_id"), F.lit(True).alias("kept"),
        )
    # Equal vectors of a label are one vector with so many copies.
    one = stored(
        each.filter(F.size("vec") == dim).groupBy("label", "vec")
        .agg(F.min("id").alias("id"), F.count("*").alias("copies")), "distinct",
    )
    largest = one.groupBy("label").count().agg(F.max("count")).first()[0]
    sample = one.orderBy(F.xxhash64("id"), "id").limit(s.sample_rows).select("vec")
    index = fit(unit(np.array([r["vec"] for r in sample.collect()])), largest, cosine, s)
    kind = one.schema["label"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(matrix(batch.column(2), dim))
            cells = index.cells(x)
            columns = [*batch.columns[:2], pa.array(cells[:, 0], pa.int32()), pa.array(cells[:, 1], pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [*columns, lists(x), batch.column(3)], names=["id", "label", "a", "b", "x", "copies"]
            )

    unit_vectors = one.select("id", "label", "vec", "copies").mapInArrow(
        place, f"id long, label {kind}, a int, b int, x array<double>, copies long"
    )
    placed = stored(unit_vectors, "placed")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per first code within reach; the second codes are worked out again where it arrives."""
        for batch in batches:
            to = [(i, code) for i, code, _ in index.visited(matrix(batch.column(4), dim))]
            row, code = (pa.array([x[j] for x in to], pa.int32()) for j in (0, 1))
            yield pa.RecordBatch.from_arrays([*batch.take(row).columns, code], names=[*batch.schema.names, "to"])

    probes = placed.mapInArrow(visit, f"id long, label {kind}, a int, b int, x array<double>, copies long, to int")
    # The rows of a label and first code are verified in blocks of a bounded number of rows a side.
    crowd = lambda n: F.greatest(F.lit(1), F.ceil(n / s.block_rows)).cast("int")
    here = placed.groupBy("label", F.col("a").alias("to")).agg(crowd(F.count("*")).alias("parts"))
    there = probes.groupBy("label", "to").agg(crowd(F.count("*")).alias("crowds"))
    blocks = here.join(there, ["label", "to"])
    columns = ["id", "label", "a", "b", "x", "copies"]
    resident = placed.withColumn("to", F.col("a")).join(blocks, ["label", "to"]).select(
        *columns, "to", F.lit(-1).alias("probe"),
        F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.col("crowds") - 1)).alias("crowd"),
    )
    asking = probes.join(blocks, ["label", "to"]).select(
        *columns, "to", F.lit(1).alias("probe"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.pmod(F.xxhash64("id"), "crowds").cast("int").alias("crowd"),
    )

    def verify(group: pa.Table) -> pa.Table:
        """Rows ``a, b, n``: links counted for ``a``, and with a second id a link of the forest."""
        x, ids = matrix(group["x"], dim), group["id"].to_numpy()
        copies, code_b = group["copies"].to_numpy(), group["b"].to_numpy()
        code_a, asks = group["a"].to_numpy(), group["probe"].to_numpy() > 0
        q, p = np.flatnonzero(asks), np.flatnonzero(~asks)
        counted = np.zeros(len(ids), np.int64)
        links = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if len(p) and len(q):
            q_a, q_b = index.distances(x[q])
            p_a, p_b = index.distances(x[p])
            p = p[np.argsort(code_b[p], kind="stable")]
            at_p = np.zeros(len(ids), np.int64)
            at_p[np.flatnonzero(~asks)] = np.arange(len(p))
            to = code_a[p[0]]  # of all residents here
            # Only the rows of a cell that a vector visits are compared with it.
            starts = np.flatnonzero(np.diff(code_b[p], prepend=-1))
            for first, last in zip(starts, [*starts[1:], len(p)], strict=True):
                cell = p[first:last]
                visitors = np.flatnonzero(q_a[:, to] + q_b[:, code_b[cell[0]]] <= index.reach)
                for start in range(0, len(visitors), 512):
                    at = visitors[start : start + 512]
                    part = q[at]
                    i, j = np.nonzero((x[part] @ x[cell].T >= cosine) & (ids[part][:, None] != ids[cell]))
                    home = at_p[cell[j]]
                    back = p_a[home, code_a[part[i]]] + p_b[home, code_b[part[i]]] <= index.reach
                    np.add.at(counted, part[i], copies[cell[j]])
                    # A pair that is seen from both sides counts for each of them once.
                    np.add.at(counted, cell[j][~back], copies[part[i]][~back])
                    links.append((part[i], cell[j]))
        a, b = (np.concatenate(c) for c in zip(*links, strict=True))
        if len(a):
            order = {v: k for k, v in enumerate(np.unique(ids[np.append(a, b)]).tolist())}
            kept = forest(*(np.array([order[v] for v in ids[c].tolist()]) for c in (a, b)), len(order))
            a, b = a[kept], b[kept]
        some = np.flatnonzero(counted)
        return pa.Table.from_arrays(
            [
                pa.array(np.append(ids[some], ids[a])),
                pa.array([*[None] * len(some), *ids[b].tolist()], pa.int64()),
                pa.array(np.append(counted[some], np.zeros(len(a), np.int64))),
            ],
            names=["a", "b", "n"],
        )

    found = stored(
        resident.unionByName(asking).groupBy("label", "to", "part", "crowd").applyInArrow(verify, "a long, b long, n long"),
        "links",
    )
    totals = found.filter("b IS NULL").groupBy("a").agg(F.sum("n").alias("n"))
    joined = components(one.select(F.col("id").alias("node")), found.filter("b IS NOT NULL").select("a", "b"))
    summed = (
        one.join(totals, F.col("id") == F.col("a"), "left").join(joined, F.col("id") == F.col("node"))
        .select("label", "vec", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component")
    )
    return (
        each.join(summed, ["label", "vec"], "left")
        .select(
            F.col("id").alias("vec_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        )
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )


def unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors; a power of two is taken out first, as squares of extreme components have no place in a double."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)
