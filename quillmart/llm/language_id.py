"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all rows that may be learned from. The regression is trained with
follow-the-regularised-leader under an elastic-net penalty, on a sample of at most ``sample_rows`` of
those rows: shards of the sample are trained in parallel and their weights averaged. A temperature fitted
on the part of the sample kept out of training turns the scores into probabilities.

Defined results: a text that is NULL or has no letter gets ``und`` with score 0, and an empty text is such
a text. Texts of any length are read whole, half a million characters at a time. Of languages of equal
probability the first by name is told. Without any row to learn from every text gets ``und``, and ``accepted``
keeps every text with a letter. Rows with a NULL label or a NULL text are not learned from; a row that is
repeated is learned from once. Repeated rows get equal results. An empty table gives an empty one. Only the id
and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmart.llm import grams
from quillmart.llm.common import slices, stored

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """What training depends on."""

    bits: int = 15  # of a feature's number
    sample_rows: int = 8000  # most rows that weights and temperature are fitted on
    shards: int = 4
    epochs: int = 2
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02


@dataclass(frozen=True)
class LanguageModel:
    """Weights per feature and language; their size depends on ``bits`` and the languages alone."""

    labels: tuple[str, ...]
    weights: np.ndarray  # features x languages, with the inverse document frequency in them
    bias: np.ndarray
    temperature: float
    bits: int

    def logits(self, texts: list[str]) -> np.ndarray:
        """One row of scores per text: bias plus the mean weight of its n-grams."""
        table = grams.letters()
        total, n = np.zeros((len(texts), len(self.labels))), np.zeros(len(texts))
        columns = np.ascontiguousarray(self.weights.T)
        for at, pieces in grams.chunks(texts):
            found, piece = grams.hashed(pieces, table, self.bits)
            at = np.asarray(at)
            n += np.bincount(at, np.bincount(piece, minlength=len(at)), len(texts))
            for k, column in enumerate(columns):
                total[:, k] += np.bincount(at, np.bincount(piece, column[found], len(at)), len(texts))
        return self.bias + total / np.maximum(n, 1)[:, None]

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return softmax(self.logits(texts) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def document_frequencies(texts: DataFrame, bits: int) -> tuple[np.ndarray, int]:
    """Number of texts each feature is in, and of texts. Every task sums up what it reads."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = grams.letters()
        df, n = np.zeros(1 << bits, np.int64), 0
        for batch in (part for batch in batches for part in slices(batch, 0)):
            found_in = batch.column(0).to_pylist()
            n += len(found_in)
            rest: tuple[int, np.ndarray] | None = None  # a text that goes on in the next chunk
            for at, pieces in grams.chunks(found_in):
                found, piece = grams.hashed(pieces, table, bits)
                there = np.zeros((len(at), 1 << bits), bool)
                there[piece, found] = True
                if rest is not None:
                    if at[0] == rest[0]:
                        there[0] |= rest[1]
                    else:
                        df += rest[1]
                rest = (at[-1], there[-1].copy())
                df += there[:-1].sum(0)
            if rest is not None:
                df += rest[1]
        at = np.flatnonzero(df)
        feature, count = np.append(at, -1), np.append(df[at], n)  # -1: the texts
        yield pa.RecordBatch.from_arrays([pa.array(feature), pa.array(count)], names=["feature", "n"])

    summed = texts.mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    found = {row["feature"]: row["n"] for row in summed.toLocalIterator()}
    df = np.zeros(1 << bits)
    df[[f for f in found if f >= 0]] = [v for f, v in found.items() if f >= 0]
    return df, found.get(-1, 0)


def sparse(texts: list[str], bits: int, idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features and TF-IDF values of each text; term frequencies add up to 1."""
    table, out = grams.letters(), []
    for text in texts:
        counts = np.zeros(1 << bits)
        for _, pieces in grams.chunks([text]):
            counts += np.bincount(grams.hashed(pieces, table, bits)[0], minlength=1 << bits)
        at = np.flatnonzero(counts)
        out.append((at, counts[at] / max(1, counts.sum()) * idf[at]))
    return out


def follow_the_leader(
    rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, n_labels: int, s: Settings
) -> np.ndarray:
    """Weights from one shard, the bias in the last row. Most weights stay exactly 0."""
    size = (1 << s.bits) + 1
    z, n = np.zeros((size, n_labels)), np.zeros((size, n_labels))

    def weights(at: np.ndarray) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * s.l1) / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2)
        return np.where(np.abs(z[at]) <= s.l1, 0.0, w)

    for _ in range(s.epochs):
        for (at, x), y in zip(rows, label, strict=True):
            at, x = np.append(at, size - 1), np.append(x, 1.0)
            w = weights(at)
            p = softmax((x @ w)[None])[0]
            p[y] -= 1
            g = x[:, None] * p
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha
            z[at] += g - step * w
            n[at] += g * g
    return weights(np.arange(size))


def fit(
    docs: DataFrame,
    may_learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "lang",
    settings: Settings | None = None,
) -> LanguageModel | None:
    """A model from the rows for which ``may_learn`` holds, or None without labelled rows."""
    s = settings or Settings()
    rows = docs.filter(may_learn & F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label")
    )
    df, n = document_frequencies(rows.select("text"), s.bits)
    if not n:
        return None
    idf = 10 * np.log((1 + n) / (1 + df))
    order = F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), "text")
    # The rows with the smallest hashes. These are cut off first, without the texts; a row that is repeated
    # counts once, so that no more rows than hashes are left.
    first = rows.select(order.alias("at")).orderBy("at").limit(s.sample_rows)
    last = first.agg(F.max("at")).first()[0]
    chosen = rows.withColumn("at", order).filter(F.col("at") <= last).groupBy("at", "label").agg(F.min("text").alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts become sparse rows where they are; no text leaves its task."""
        for batch in (part for batch in batches for part in slices(batch, 2)):
            found = [sparse([t], s.bits, idf)[0] for t in batch.column(2).to_pylist()]
            ends = pa.array(np.cumsum([0, *(len(at) for at, _ in found)], dtype=np.int32))
            columns = (np.concatenate([f[i] for f in found]) if found else np.zeros(0) for i in (0, 1))
            at, x = (pa.ListArray.from_arrays(ends, pa.array(c, t)) for c, t in zip(columns, (pa.int32(), pa.float64()), strict=True))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], at, x], names=["at", "label", "features", "x"])

    sample = stored(
        chosen.select("at", "label", "text").mapInArrow(features, "at long, label string, features array<int>, x array<double>"),
        "sample",
    )
    labels = tuple(sorted(r["label"] for r in sample.select("label").distinct().collect()))
    # A tenth of the sample is kept for the temperature.
    parts = sample.withColumn("shard", F.pmod("at", F.lit(10))).withColumn(
        "shard", F.when(F.col("shard") == 0, -1).otherwise(F.pmod("at", F.lit(s.shards))).cast("int")
    )

    def train(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["at", "label"])
        y = np.array([labels.index(v) for v in shard["label"]])
        held = [(np.asarray(at, np.int64), np.asarray(x)) for at, x in zip(shard["features"], shard["x"], strict=True)]
        w = follow_the_leader(held, y, len(labels), s)
        at = np.flatnonzero(np.abs(w).sum(1))
        return pd.DataFrame({"feature": at, "w": list(w[at]), "rows": len(y)})

    trained = parts.filter("shard >= 0").groupBy("shard").applyInPandas(
        train, "feature long, w array<double>, rows long"
    )
    weights, total = np.zeros(((1 << s.bits) + 1, len(labels))), 0
    for part in trained.collect():  # at most shards x features rows
        weights[part["feature"]] += np.array(part["w"]) * part["rows"]
        total += part["rows"] if part["feature"] == 1 << s.bits else 0
    weights /= max(1, total)
    model = LanguageModel(labels, weights[:-1] * idf[:, None], weights[-1], 1.0, s.bits)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Logits of sparse rows, whose values have the inverse document frequency in them."""
        for batch in batches:
            pairs = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            logits = [(weights[-1] + np.asarray(x) @ weights[at]).tolist() if at else weights[-1].tolist() for at, x in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(logits, pa.list_(pa.float64()))], names=["label", "logits"])

    scored = parts.filter("shard < 0").select("label", "features", "x").mapInArrow(score, "label string, logits array<double>")
    kept = scored.collect()  # a tenth of the sample: a label and a few numbers each
    if not kept or len(labels) < 2:
        return model
    logits, y = np.array([r["logits"] for r in kept]), [labels.index(r["label"]) for r in kept]
    return LanguageModel(labels, model.weights, model.bias, temperature(logits, np.array(y)), s.bits)


def temperature(logits: np.ndarray, label: np.ndarray) -> float:
    """The divisor under which the labels are likeliest."""

    def loss(t: float) -> float:
        return -np.log(np.maximum(softmax(logits / t)[np.arange(len(label)), label], 1e-12)).mean()

    return float(min(np.geomspace(0.05, 20, 121), key=loss))


def predict(
    docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Columns of ``id_col``, ``lang_pred`` and ``score`` for every row."""
    rows = docs.select(F.col(id_col), F.col(text_col))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in slices(batch, 1)):
            texts = batch.column(1).to_pylist()
            told = [grams.has_letter(t) for t in texts] if model else [False] * len(texts)
            names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            at = [i for i, known in enumerate(told) if known]
            if at:
                p = model.probabilities([texts[i] for i in at])
                for i, k, score in zip(at, p.argmax(1), p.max(1), strict=True):
                    names[i], scores[i] = model.labels[k], float(score)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=[id_col, "lang_pred", "score"],
            )

    return rows.mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def accepted(
    docs: DataFrame, model: LanguageModel | None, min_score: float, text_col: str = "text"
) -> DataFrame:
    """Rows of ``docs`` whose language is told with at least this score; texts without a letter go.

    Without a model no language can be rejected: all texts with a letter stay.
    """
    at = docs.columns.index(text_col)
    rows = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in slices(batch, at)):
            texts = batch.column(at).to_pylist()
            told = [i for i, t in enumerate(texts) if grams.has_letter(t)]
            if told and model is None:
                yield batch.take(pa.array(told, pa.int64()))
            elif told:
                score = model.probabilities([texts[i] for i in told]).max(1)
                yield batch.take(pa.array([i for i, x in zip(told, score, strict=True) if x >= min_score], pa.int64()))

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether a row is of the fold that is not learned from; so is one without an id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(True))
