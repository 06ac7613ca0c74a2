"""Hard negatives by anchor-clustered shared lists.

Anchors are clustered by direction. With ``spread``, the largest angle between a cluster's centre and its
anchors, ``|x| cos(max(0, angle(x, centre) - spread))`` bounds the inner product of a row ``x`` with every unit
anchor of the cluster. The rows sorted by this bound, once for a cluster, are the list that all its anchors
share: an anchor walks it from the top and stops for certain where its own length times the next bound cannot
reach what it has found.

A list is walked in segments that grow by a factor; only the rows of a segment that clusters still walk are
sent to them, in parts of about ``block_rows`` rows, and a cluster's anchors are split likewise. So neither a
large cluster nor a group of copies fills a task. Two walks are made over the same lists: one finds the
positives of the anchors among the rows of their label, one the negatives of every positive among the others.
Centres and the cuts between segments are fitted on a bounded sample; every row is in every list.

Scores are inner products of whole numbers, exact; higher scores come first, ties by smaller id.

Defined results: rows without an id or a label, and vectors that are NULL, empty, of another length than most,
or hold NULL or non-finite components take no part; nor do vectors with a component, after scaling, of 2^31 or
more, or a squared length of 2^62 or more, whose products need not fit a long. A zero vector takes part. Rows
that share an id count once, with the smallest (label, vector). An anchor without another row of its label, and
a positive without a row in its band, have no result; a negative positive score has an empty band. An empty
table gives an empty result. Only id, vector and label are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmart.llm.anchors import mixed
from quillmart.llm.common import quoted, stored
from quillmart.llm.multi_index import codebook
from quillmart.llm.vectors import common_length, matrix

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
HITS = "anchor long, want long, found long, score long"


@dataclass(frozen=True)
class Settings:
    """What is mined, and what the lists depend on."""

    positives: int = 5
    negatives: int = 10
    low: int = 30  # hundredths of the positive's score
    high: int = 90
    cluster_anchors: int = 128  # wanted in a cluster
    sample_rows: int = 20_000  # most rows that centres and cuts are fitted on
    rounds: int = 8  # of Lloyd's algorithm
    first_rows: int = 8192  # expected in a list's first segment
    growth: int = 8
    block_rows: int = 4096
    step: int = 1024  # rows verified between two tests
    seed: int = 12


def whole_vectors(rows: DataFrame, scale: float, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """``id, label, vec`` of the rows that take part; components are the floors of their multiples."""
    vec = quoted(vec_col)
    # One step after the other: floors of values that do not fit are never taken.
    fit = F.forall(vec, lambda x: x.isNotNull() & (F.abs(x.cast("double") * scale) < 2.0**31))
    known = rows.filter(quoted(id_col).isNotNull() & quoted(label_col).isNotNull() & (F.size(vec) > 0) & fit).select(
        quoted(id_col).cast("long").alias("id"), quoted(label_col).cast("string").alias("label"),
        F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("vec"),
    )
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    smallest = F.min(F.struct("label", "vec")).alias("row")
    return known.filter(square < 2.0**62).groupBy("id").agg(smallest).select("id", "row.*")


@dataclass(frozen=True)
class Lists:
    """Centres and spreads of the clusters, and where each one's list is cut; bounded by the sample."""

    centres: np.ndarray
    spread: np.ndarray
    cuts: np.ndarray  # clusters x segments: the least bound of a segment; the last is minus infinity

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """Rows x clusters. Rounding is always up."""
        length = np.sqrt((x * x).sum(1))
        cosine = np.clip((x @ self.centres.T) / np.maximum(length, 1e-300)[:, None], -1, 1)
        angle = np.maximum(0, np.arccos(cosine) - self.spread - 1e-6)
        return length[:, None] * (np.cos(angle) + 1e-9)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1)), 1e-300)[:, None]


def walk(
    asks: np.ndarray, low: np.ndarray, high: np.ndarray, asks_of: np.ndarray, asks_label: np.ndarray,
    rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, bounds: np.ndarray,
    k: int, same: bool, step: int,
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number of an ask, and ids and scores of the best ``k`` rows of its kind in its band.

    ``bounds`` fall from row to row. An ask is done when the next bound cannot reach its lowest score.
    """
    length = np.sqrt((asks.astype(float) ** 2).sum(1))
    # Sums of products below 2^53 are exact in doubles.
    exact = np.float64 if length.max(initial=0) * np.abs(bounds).max(initial=0) < 2.0**52 else np.int64
    asks, rows = asks.astype(exact), rows.astype(exact)
    least = low.copy()
    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(asks)
    walking = np.arange(len(asks))
    for start in range(0, len(rows), step):
        walking = walking[length[walking] * bounds[start] * (1 + 1e-9) + 1e-6 >= least[walking]]
        if not len(walking):
            break
        part = slice(start, start + step)
        score = (asks[walking] @ rows[part].T).astype(np.int64)
        kind = (labels[part] == asks_label[walking][:, None]) == same
        fits = kind & (score >= least[walking][:, None]) & (score <= high[walking][:, None])
        fits &= ids[part] != asks_of[walking][:, None]
        for at in np.flatnonzero(fits.any(1)):
            i, new = walking[at], fits[at]
            found, best = np.append(held[i][0], ids[part][new]), np.append(held[i][1], score[at][new])
            if len(found) > k:
                order = np.lexsort((found, -best))[:k]
                found, best = found[order], best[order]
            if len(found) == k:
                least[i] = max(least[i], best.min())
            held[i] = found, best
    for i, (found, best) in enumerate(held):
        if len(found):
            yield i, found, best


def fit_lists(data: DataFrame, anchors: DataFrame, n: int, n_anchors: int, dim: int, s: Settings) -> tuple[Lists, DataFrame]:
    """The lists, and the anchors with their cluster."""

    def sampled(rows: DataFrame) -> np.ndarray:
        """At most ``sample_rows`` rows."""
        first = rows.orderBy(F.xxhash64("id"), "id").limit(s.sample_rows).select("vec").collect()
        return np.array([r["vec"] for r in first], float).reshape(-1, dim)

    x = unit(sampled(anchors))
    codes = max(1, min(math.ceil(n_anchors / s.cluster_anchors), len(x) // 8))
    centres = unit(codebook(x, codes, s.rounds, np.random.default_rng(s.seed)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(matrix(batch.column(2), dim))
            cosine = x @ centres.T
            cluster = cosine.argmax(1)
            # Any bound holds for a zero vector.
            angle = np.where(x.any(1), np.arccos(np.clip(cosine.max(1, initial=-1), -1, 1)), 0)
            columns = [*batch.columns, pa.array(cluster, pa.int32()), pa.array(angle)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "vec", "cluster", "angle"])

    placed = stored(
        anchors.mapInArrow(place, "id long, label string, vec array<int>, cluster int, angle double"), "anchors"
    )
    spread = np.zeros(codes)
    for r in placed.groupBy("cluster").agg(F.max("angle").alias("angle")).collect():  # a row for each centre
        spread[r["cluster"]] = r["angle"]
    y = sampled(data)
    sizes = [max(s.first_rows, 16 * n // len(y))]
    while sizes[-1] < n:
        sizes.append(sizes[-1] * s.growth)
    bounds = Lists(centres, spread, np.zeros((codes, 0))).bounds(y)
    inner = [np.quantile(bounds, 1 - size / n, axis=0) for size in sizes[:-1]]
    cuts = np.column_stack([*inner, np.full(codes, -np.inf)])
    return Lists(centres, spread, cuts), placed


def _best(hits: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each ask, with their rank."""
    order = Window.partitionBy("anchor", "want").orderBy(F.desc("score"), "found")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _walked(data: DataFrame, asks: DataFrame, lists: Lists, sizes: np.ndarray, dim: int, k: int, same: bool, s: Settings) -> DataFrame:
    """``anchor, want, found, score, rank``: the best ``k`` rows of every ask.

    ``asks`` has ``id, label, vec, cluster`` of an anchor, the number ``want`` of what it asks for, and the
    band ``low`` to ``high``. ``sizes`` are the rows of the segments of each list.
    """
    spark = data.sparkSession
    codes, segments = lists.cuts.shape
    active = asks.withColumn("least", F.col("low"))
    found = None
    for r in range(segments):
        walking = {row["cluster"]: row["n"] for row in active.groupBy("cluster").agg(F.count("*").alias("n")).collect()}
        if not walking:
            break
        parts = np.maximum(1, -(-sizes[:, r] // s.block_rows))
        crowds = np.zeros(codes, np.int64)  # 0: nobody walks
        crowds[list(walking)] = [-(-n // s.block_rows) for n in walking.values()]
        high = lists.cuts[:, r - 1] if r else np.full(codes, np.inf)

        def segment(batches: Iterator[pa.RecordBatch], r=r, parts=parts, crowds=crowds, high=high) -> Iterator[pa.RecordBatch]:
            """Rows of the segment of every list that is walked, once for each crowd of asks."""
            for batch in batches:
                bounds = lists.bounds(matrix(batch.column(2), dim))
                part = mixed(batch.column(0).to_numpy().view(np.uint64))
                for c in np.flatnonzero(crowds):
                    at = np.flatnonzero((bounds[:, c] >= lists.cuts[c, r]) & (bounds[:, c] < high[c]))
                    if not len(at):
                        continue
                    rows = batch.take(pa.array(at))
                    own = (part[at] % np.uint64(parts[c])).astype(np.int32)
                    for crowd in range(crowds[c]):
                        same_for_all = [pa.array(np.full(len(at), x, np.int32)) for x in (c, crowd)]
                        yield pa.RecordBatch.from_arrays(
                            [*rows.columns, pa.array(bounds[at, c]), same_for_all[0], pa.array(own), same_for_all[1]],
                            names=["p_id", "p_label", "p_vec", "bound", "of", "of_part", "of_crowd"],
                        )

        lists_of = data.mapInArrow(
            segment, "p_id long, p_label string, p_vec array<int>, bound double, of int, of_part int, of_crowd int"
        )
        # A row for each centre, as many as the sample allows.
        plan = spark.createDataFrame([(c, int(parts[c]), int(crowds[c])) for c in walking], "cluster int, parts int, crowds int")
        sent = active.join(F.broadcast(plan), "cluster").select(
            "id", "label", "vec", "cluster", "want", "least", "high",
            F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
            F.pmod(F.xxhash64("id", "want"), "crowds").cast("int").alias("crowd"),
        )

        def verify(q: pa.Table, p: pa.Table) -> pa.Table:
            out = [(np.zeros(0, np.int64),) * 4]
            if q.num_rows and p.num_rows:
                bounds = p["bound"].to_numpy()
                order = np.lexsort((p["p_id"].to_numpy(), -bounds))
                q_ids, wants = q["id"].to_numpy(), q["want"].to_numpy()
                hits = walk(
                    matrix(q["vec"], dim), q["least"].to_numpy(), q["high"].to_numpy(), q_ids,
                    np.array(q["label"].to_pylist(), object), matrix(p["p_vec"], dim)[order],
                    p["p_id"].to_numpy()[order], np.array(p["p_label"].to_pylist(), object)[order], bounds[order],
                    k, same, s.step,
                )
                out += [(np.full(len(x), q_ids[i]), np.full(len(x), wants[i]), x, score) for i, x, score in hits]
            columns = [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]
            return pa.Table.from_arrays(columns, names=["anchor", "want", "found", "score"])

        hits = (
            sent.groupBy("cluster", "part", "crowd").cogroup(lists_of.groupBy("of", "of_part", "of_crowd"))
            .applyInArrow(verify, HITS)
        )
        hits = hits if found is None else found.drop("rank").unionByName(hits)
        found = stored(_best(hits, k), "found")
        if r + 1 == segments:
            break
        # Who goes on: the next bound may still reach the lowest score that counts.
        reach = spark.createDataFrame([(c, float(lists.cuts[c, r])) for c in walking], "cluster int, reach double")
        kth = found.filter(F.col("rank") == k).select(
            F.col("anchor").alias("id"), "want", F.col("score").alias("kth")
        )
        length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
        after = active.join(kth, ["id", "want"], "left").join(F.broadcast(reach), "cluster")
        active = stored(
            after.withColumn("least", F.greatest("least", F.coalesce("kth", "least")))
            .filter(length * F.col("reach") * F.when(F.col("reach") > 0, 1 + 1e-9).otherwise(1 - 1e-9) + 1e-6 >= F.col("least"))
            .select("id", "label", "vec", "cluster", "want", "low", "high", "least"), "active",
        )
    return found if found is not None else spark.createDataFrame([], f"{HITS}, rank int")


def _sizes(data: DataFrame, lists: Lists, dim: int) -> np.ndarray:
    """Rows of each segment of each list: clusters x segments."""
    codes, segments = lists.cuts.shape

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((codes, segments), np.int64)
        for batch in batches:
            bounds = lists.bounds(matrix(batch.column(0), dim))
            for r in range(segments):
                high = lists.cuts[:, r - 1] if r else np.inf
                total[:, r] += ((bounds >= lists.cuts[:, r]) & (bounds < high)).sum(0)
        cell = np.arange(codes * segments)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total.ravel())], names=["cell", "n"])

    sums = data.select("vec").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(codes * segments, np.int64)
    for row in sums.collect():  # a row for each segment of each list
        out[row["cell"]] = row["n"]
    return out.reshape(codes, segments)


def mine(vectors: DataFrame, is_anchor: Column, settings: Settings | None = None) -> DataFrame:
    """Negatives of every positive of every anchor, hardest first, from rows ``id, label, vec``.

    ``vectors`` is a result of ``whole_vectors``, ``is_anchor`` a condition on ``id``. The positives of an
    anchor are its best other rows of its label; the negatives of a positive are the best rows of other
    labels whose score is between ``low`` and ``high`` hundredths of the positive's.
    """
    s = settings or Settings()
    spark = vectors.sparkSession
    clean = stored(vectors.select("id", "label", "vec"), "whole")
    dim = common_length(clean)
    if dim is None:
        return spark.createDataFrame([], RESULT)
    data = clean.filter(F.size("vec") == dim)
    anchors = data.filter(is_anchor)
    n, n_anchors = data.count(), anchors.count()
    if not n_anchors:
        return spark.createDataFrame([], RESULT)
    lists, placed = fit_lists(data, anchors, n, n_anchors, dim, s)
    sizes = _sizes(data, lists, dim)
    lowest, highest = F.lit(-(2**63 - 1)), F.lit(2**63 - 1)
    asks = placed.select("id", "label", "vec", "cluster", F.lit(-1).cast("long").alias("want"), lowest.alias("low"), highest.alias("high"))
    positives = _walked(data, asks, lists, sizes, dim, s.positives, True, s)
    # Bounds of the band in whole numbers; a product with hundredths may not fit a long.
    exact = lambda share: F.col("score").cast("decimal(38,0)") * share / 100
    bands = stored(
        positives.filter("score >= 0").select(
            F.col("anchor").alias("id"), F.col("found").alias("want"), F.col("score").alias("positive_score"),
            F.ceil(exact(s.low)).cast("long").alias("low"), F.floor(exact(s.high)).cast("long").alias("high"),
        ), "bands",
    )
    wanted = placed.select("id", "label", "vec", "cluster").join(bands, "id").select(
        "id", "label", "vec", "cluster", "want", "low", "high"
    )
    negatives = _walked(data, wanted, lists, sizes, dim, s.negatives, False, s)
    scores = bands.select(F.col("id").alias("anchor_id"), F.col("want").alias("positive_id"), "positive_score")
    return (
        negatives.select(
            F.col("anchor").alias("anchor_id"), F.col("want").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
            F.col("found").alias("negative_id"), F.col("score").alias("negative_score"),
        )
        .join(scores, ["anchor_id", "positive_id"])
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
