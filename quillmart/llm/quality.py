"""Quality scores: ridge regression on random Fourier features of document statistics.

Statistics of every whole text are standardised and mapped to random Fourier features, whose inner products
approximate a Gaussian kernel. The normal equations of the ridge regression are sums over rows: every task
sums up its part, and the parts are added. Isotonic regression on a histogram of the scores turns them into
shares of good documents.

Defined results: a NULL text has the statistics of an empty text, and gets a score like any other. NULL
labels are not learned from; several labels of one id count as their mean; an id without a row teaches
nothing. Without labels every score is 0.5. Repeated rows get equal scores. Only the id and the text of
documents are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmart.llm.common import quoted, slices, stored
from quillmart.llm.vectors import lists, matrix

SYMBOLS = re.compile(r"[^\w\s.,;:'\"?()-]")
STATISTICS = 16


@dataclass(frozen=True)
class Settings:
    """What training depends on."""

    features: int = 192
    width: float = 2.0  # of the kernel, in root mean square distances of standardised statistics
    ridge: float = 1e-4  # of the number of rows
    bins: int = 1000  # of the histogram that isotonic regression reads
    seed: int = 4


def statistics(text: str) -> list[float]:
    """Lengths and shares that tell prose from lists, shouting, symbols and repetition."""
    words, lines = text.split(), text.split("\n")
    n, n_words, n_lines = max(1, len(text)), max(1, len(words)), max(1, len(lines))
    counts = Counter(words)
    shares = [c / n_words for c in counts.values()]
    letters = sum(map(len, words))
    symbols = SYMBOLS.findall(text)
    upper = sum(map(str.isupper, words))
    same = sum(map(str.__eq__, words, words[1:]))
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        letters / n_words,
        len(counts) / n_words,
        len(counts) / n_words**0.7,
        max(shares, default=0.0),
        sum(s * s for s in shares),
        same / n_words,
        upper / n_words,
        len(symbols) / n,
        text.count("|") / n_words,
        sum(map(str.isdigit, words)) / n_words,
        len(set(lines)) / n_lines,
        np.log1p(n / n_lines),
        (text.count(".") + text.count(",")) / n_words,
        sum(len(w) > 15 for w in words) / n_words,
    ]


def described(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id`` and statistics ``x`` of every row."""
    rows = docs.select(quoted(id_col).alias("id"), F.coalesce(quoted(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in slices(batch, 1)):
            x = np.array([statistics(t) for t in batch.column(1).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(x)], names=["id", "x"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, x array<double>")


@dataclass(frozen=True)
class QualityModel:
    """Its size depends on the settings alone."""

    mean: np.ndarray
    scale: np.ndarray
    plane: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    edges: np.ndarray  # isotonic regression: raw scores, and the share of good documents at each
    shares: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.plane + self.phase
        return np.column_stack([np.sqrt(2 / len(self.phase)) * np.cos(z), np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.edges, self.shares)


def normal_equations(rows: DataFrame, model: QualityModel) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums of z z' and z y over ``x``, ``y``; every task returns one matrix, and rows of it are added up."""
    size = len(model.phase) + 1

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((size, size + 1)), 0
        for batch in batches:
            z = model.features(matrix(batch.column(0), STATISTICS))
            total += z.T @ np.column_stack([z, batch.column(1).to_numpy()])
            n += len(z)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), lists(total)], names=["i", "row"])

    def add(group: pa.Table) -> pa.Table:
        total = matrix(group["row"], size + 1).sum(0, keepdims=True)
        return pa.Table.from_arrays([group["i"].slice(0, 1), lists(total)], names=["i", "row"])

    schema = "i long, row array<double>"
    summed = rows.select("x", "y").mapInArrow(part, schema).groupBy("i").applyInArrow(add, schema)
    total = np.zeros((size, size + 1))
    for r in summed.collect():  # as many rows as features
        total[r["i"]] = r["row"]
    return total[:, :-1], total[:, -1], int(round(total[-1, -2]))


def isotonic(good: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Non-decreasing shares of good ones nearest to ``good / n``, pooling neighbours that fall."""
    pools: list[list[float]] = []
    for g, m in zip(good, n, strict=True):
        pools.append([g, m, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            g1, m1, k1 = pools.pop()
            pools[-1] = [pools[-1][0] + g1, pools[-1][1] + m1, pools[-1][2] + k1]
    return np.concatenate([np.full(int(k), g / m) for g, m, k in pools])


def fit(rows: DataFrame, labels: DataFrame, may_learn: Column, settings: Settings | None = None) -> QualityModel | None:
    """A model from described rows and ``id``, ``y`` labels; ``may_learn`` is a condition on ``id``."""
    s = settings or Settings()
    known = (
        labels.filter(F.col("y").isNotNull() & may_learn).groupBy("id").agg(F.avg("y").alias("y"))
    )
    taught = stored(rows.join(known, "id").select("x", "y"), "taught")
    columns = [F.col("x")[j] for j in range(STATISTICS)]
    moments = taught.agg(F.count("*"), *map(F.avg, columns), *map(F.stddev_pop, columns)).first()
    if not moments[0]:
        return None
    mean, scale = np.array(moments[1:]).reshape(2, STATISTICS)
    rng = np.random.default_rng(s.seed)
    width = s.width * np.sqrt(2 * STATISTICS) / 2
    start = QualityModel(
        mean, np.where(scale > 1e-9, scale, 1.0), rng.standard_normal((STATISTICS, s.features)) / width,
        rng.uniform(0, 2 * np.pi, s.features), np.zeros(s.features + 1), np.zeros(1), np.full(1, 0.5),
    )
    left, right, n = normal_equations(taught, start)
    weights = np.linalg.solve(left + s.ridge * n * np.eye(len(left)), right)
    model = replace(start, weights=weights)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.clip(model.raw(matrix(batch.column(0), STATISTICS)), -0.5, 1.5)
            at = np.floor((raw + 0.5) / 2 * (s.bins - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1)], names=["bin", "y"])

    counts = (
        taught.select("x", "y").mapInArrow(binned, "bin long, y double").groupBy("bin")
        .agg(F.sum("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    )  # at most as many rows as bins
    shares = isotonic(np.array([r["y"] for r in counts]), np.array([r["n"] for r in counts], float))
    edges = (np.array([r["bin"] for r in counts]) + 0.5) / (s.bins - 1) * 2 - 0.5
    return replace(model, edges=edges, shares=shares)


def predict(rows: DataFrame, model: QualityModel | None) -> DataFrame:
    """``id`` and ``score`` of described rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), STATISTICS)
            score = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(score, 0, 1))], names=["id", "score"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    may_learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    settings: Settings | None = None,
) -> DataFrame:
    """``id`` and ``score`` of every row; texts are read once."""
    rows = stored(described(docs, id_col, text_col), "statistics")
    known = labels.select(quoted(id_col).alias("id"), quoted(label_col).cast("double").alias("y"))
    return predict(rows, fit(rows, known, may_learn, settings))
