"""Mixing a corpus to target weights of domains that documents belong to softly.

Built of DataFrame functions alone. Naive Bayes over hashed words that tell domains apart, learned from a
bounded sample of a labelled table, predicts how far each document belongs to each domain; the sharpness of
each domain's evidence is fitted on labelled documents kept out of the counts. Every document then gets a rate
between 0 and ``most``: how often it is to be taken. The rates are found by projected gradient descent on the
squared gaps between the tokens expected of each domain and its target, in shares of all tokens, with a small
pull towards a rate of 1. A document's slope is the sum of the gaps weighted by its posteriors; the gaps are
scaled by their curvature over the rates that a step may move, damped where a step goes too far, and the steps are summed up before they are
projected, so that a few numbers describe all rates. Documents are summed up by posteriors rounded to a grid
before the descent, and every step is one aggregation of those sums.

The total, unless given, is what keeps the domain of the largest weight whole. Copies are the rate rounded up
or down by a hash of the document, so that their expectation is the rate.

Defined results: a NULL or empty text has no tokens and the prior as its posteriors; texts of any length are read
whole. Labels of other domains, NULL labels and labels without a document teach nothing, and of several labels of
an id the first by name counts; without any label all posteriors are equal. Equal gaps and equal posteriors give
equal rates, so there are no ties to break. Without any token every rate is 1 as far as ``most`` allows. Every row
has a result, and rows that repeat an id and a text get equal ones. An empty table gives an empty one. Other
columns are carried whatever their names. Where targets cannot be met, ``totals`` tells what is reached.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmart.llm.common import quoted, stored


@dataclass(frozen=True)
class Settings:
    """What posteriors and rates depend on."""

    buckets: int = 1 << 18  # of hashed words; bounds what is broadcast
    sample_rows: int = 20_000  # most labelled documents that are learned from
    smoothing: float = 1.0
    deviations: float = 4.0  # at which a bucket's weight counts half
    grid: int = 128  # steps of a posterior
    sweeps: int = 2  # over the domains
    pull: float = 1e-4
    steps: int = 40
    tolerance: float = 1e-8  # of all tokens
    sharpness: tuple[float, ...] = (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 1.0, 1.5, 2.0)


def _key(id_col: str, text_col: str) -> list[Column]:
    """What tells documents apart; the hash of a text is that of no other text of the id."""
    return [quoted(id_col).alias("id"), F.xxhash64(quoted(text_col)).alias("same")]


def _words(docs: DataFrame, s: Settings, *columns: str) -> DataFrame:
    """A row for every different word of a document, with the bucket of its hash; a document without any
    has a row for the empty word."""
    split = docs.select(*columns, F.split(F.lower("text"), r"[\s.,]+").alias("words"))
    # Counted in a step of its own: next to the rows of the words it would be counted for each of them.
    counted = split.withColumn("n_tokens", F.size(F.array_remove("words", "")))
    return counted.select(
        *columns, "n_tokens", F.posexplode(F.array_distinct("words")).alias("at", "word")
    ).withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(s.buckets)).cast("int"))


def mix(
    docs: DataFrame,
    labelled: DataFrame,
    targets: dict[str, float],
    total_tokens: float | None = None,
    most: float | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    settings: Settings | None = None,
) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``same``, ``n_tokens``, ``posteriors``, ``rate`` and ``copies``.

    ``labelled`` has columns ``id`` and ``domain``, ``targets`` the weight of every domain. ``same`` is the hash
    of the text; rows that repeat an id and a text get equal results.
    """
    s = settings or Settings()
    domains = sorted(targets)
    weight = [targets[d] / sum(targets.values()) for d in domains]
    texts = docs.select(*_key(id_col, text_col), F.coalesce(quoted(text_col), F.lit("")).alias("text"))
    known = _sample(labelled, domains, s)
    evidence = stored(_evidence(texts, _weights(texts, known, domains, s), len(domains), s), "evidence")
    prior, sharp = _calibrated(evidence, known, domains, s)
    members = evidence.select("id", "same", "copies_in", "n_tokens", _posteriors(prior, sharp).alias("posteriors"))
    cell = F.transform("posteriors", lambda p: F.round(p * s.grid).cast("int"))
    with_cell = members.withColumn("cell", cell)
    rates = _rates(with_cell, weight, total_tokens, most, s)
    joined = with_cell.join(rates, "cell")
    chance = (F.pmod(F.xxhash64("id", "same", F.lit("copies")), F.lit(1 << 30)) + 0.5) / (1 << 30)
    copies = F.floor(F.col("rate") + chance).cast("int").alias("copies")
    found = joined.select(F.col("id").alias("of"), F.col("same").alias("of_same"), "n_tokens", "posteriors", "rate", copies)
    rows = docs.select(*_key(id_col, text_col))
    every = rows.join(found, rows["id"].eqNullSafe(found["of"]) & rows["same"].eqNullSafe(found["of_same"]))
    return every.select("id", "same", "n_tokens", "posteriors", "rate", "copies")


def totals(mixed: DataFrame, targets: dict[str, float]) -> DataFrame:
    """A row for each domain: ``domain``, its ``target`` share of the tokens, and the share ``reached`` in expectation."""
    domains = sorted(targets)
    weight = sum(targets.values())
    tokens = [F.sum(F.col("n_tokens") * F.col("rate") * F.col("posteriors")[j]) for j in range(len(domains))]
    sums = mixed.agg(F.array(*tokens).alias("tokens"))
    each = (
        F.struct(F.lit(d).alias("domain"), F.lit(targets[d] / weight).alias("target"),
                 F.try_divide(F.col("tokens")[j], F.aggregate("tokens", F.lit(0.0), lambda a, x: a + x)).alias("reached"))
        for j, d in enumerate(domains)
    )
    return sums.select(F.inline(F.array(*each)))


def _sample(labelled: DataFrame, domains: list[str], s: Settings) -> DataFrame:
    """Labelled ids, at most ``sample_rows``, a quarter of them kept for the sharpness."""
    one = (
        labelled.filter(F.col("domain").isin(domains) & F.col("id").isNotNull())
        .groupBy("id").agg(F.min("domain").alias("domain"))
    )
    at = F.xxhash64("id", F.lit("mixing"))
    chosen = one.withColumn("at", at).orderBy("at", "id").limit(s.sample_rows)
    return stored(chosen.select("id", "domain", (F.pmod("at", F.lit(4)) == 0).alias("kept")), "labelled")


def _weights(texts: DataFrame, known: DataFrame, domains: list[str], s: Settings) -> DataFrame:
    """What the presence of a bucket adds to the log likelihood ratios: ``bucket``, ``w0``, ``w1``, ...

    A bucket counts the documents it is in. The surer it is that this number differs from what all documents
    lead to expect, the more of its weight is left: of one that is ``deviations`` standard deviations away half,
    of one nearer little, at any size of the sample. The row of bucket -1 holds what the absence of all
    buckets adds.
    """
    # The sample is bounded, and so is what is broadcast.
    taught = texts.join(F.broadcast(known.filter(~F.col("kept")).select("id", "domain")), "id")
    counts = _words(taught, s, "domain").filter("word <> ''").groupBy("domain", "bucket").agg(F.count("*").alias("n"))
    by_bucket = counts.groupBy("bucket").agg(
        *(F.coalesce(F.sum(F.when(F.col("domain") == d, F.col("n"))), F.lit(0)).alias(f"n{j}") for j, d in enumerate(domains))
    )
    n = {r["domain"]: r["count"] for r in known.filter(~F.col("kept")).groupBy("domain").count().collect()}
    n_docs = max(1, sum(n.values()))
    every = sum((F.col(f"n{j}") for j in range(1, len(domains))), F.col("n0"))
    weights = []
    for j, d in enumerate(domains):
        share = n.get(d, 0) / n_docs
        z = (F.col(f"n{j}") - every * share) / F.sqrt(every * share + 1)
        own = (F.col(f"n{j}") + s.smoothing * (every + 1) / (n_docs + 2)) / (n.get(d, 0) + s.smoothing)
        any_ = (every + s.smoothing) / (n_docs + 2 * s.smoothing)
        own, any_ = (F.least(F.greatest(x, F.lit(1e-6)), F.lit(1 - 1e-6)) for x in (own, any_))
        sure = z * z * z * z / (z * z * z * z + s.deviations**4) * (1.0 if share else 0.0)
        absent = F.log(1 - own) - F.log(1 - any_)
        weights += [((F.log(own) - F.log(any_) - absent) * sure).alias(f"w{j}"), (absent * sure).alias(f"a{j}")]
    some = F.greatest(*(F.abs(F.col(f"w{j}")) for j in range(len(domains))), F.lit(0.0)) > 0
    told = by_bucket.select("bucket", *weights).filter(some)
    names = [f"w{j}" for j in range(len(domains))]
    absent = told.agg(*(F.coalesce(F.sum(f"a{j}"), F.lit(0.0)).alias(f"w{j}") for j in range(len(domains))))
    return stored(told.select("bucket", *names).unionByName(absent.withColumn("bucket", F.lit(-1))), "weights")


def _evidence(texts: DataFrame, weights: DataFrame, n_domains: int, s: Settings) -> DataFrame:
    """Per document its tokens and the summed log likelihood ratios of its words under each domain.

    Sums are made where the words are; a document's few sums meet in the shuffle.
    """
    absent = weights.filter("bucket = -1").first()
    summed = (
        _words(texts, s, "id", "same")
        .join(F.broadcast(weights), "bucket", "left")  # at most ``buckets`` rows
        .groupBy("id", "same", "n_tokens")
        .agg(
            F.sum(F.when(F.col("at") == 0, 1).otherwise(0)).alias("copies_in"),
            *(F.coalesce(F.sum(f"w{j}"), F.lit(0.0)).alias(f"s{j}") for j in range(n_domains)),
        )
    )
    total = [F.round(F.col(f"s{j}") / F.col("copies_in") + absent[f"w{j}"], 9) for j in range(n_domains)]
    return summed.select("id", "same", "copies_in", F.col("n_tokens").cast("long"), F.array(*total).alias("sums"))


def _softmax(logits: list[Column]) -> Column:
    high = F.greatest(*logits) if len(logits) > 1 else logits[0]
    powers = [F.exp(x - high) for x in logits]
    total = sum(powers[1:], powers[0])
    return F.array(*(p / total for p in powers))


def _calibrated(evidence: DataFrame, known: DataFrame, domains: list[str], s: Settings) -> tuple[list[float], list[float]]:
    """Shares of the domains in the sample, and for each domain the sharpness of its evidence.

    One domain after the other takes the sharpness under which the kept part of the sample is likeliest.
    """
    n = {r["domain"]: r["count"] for r in known.groupBy("domain").count().collect()}
    prior = [(n.get(d, 0) + 1) / (sum(n.values()) + len(domains)) for d in domains]
    kept = stored(evidence.join(F.broadcast(known.filter("kept").select("id", "domain")), "id"), "kept")
    place = F.array_position(F.array(*map(F.lit, domains)), F.col("domain")).cast("int")
    sharp = [0.5] * len(domains)
    for _ in range(s.sweeps):
        for j in range(len(domains)):
            tried = []
            for x in s.sharpness:
                own = F.element_at(_posteriors(prior, [*sharp[:j], x, *sharp[j + 1 :]]), place)
                tried.append(F.sum(F.log(F.greatest(own, F.lit(1e-9)))))
            found = kept.agg(*(t.alias(f"t{i}") for i, t in enumerate(tried))).first()
            best = max(range(len(tried)), key=lambda i: -math.inf if found[i] is None else found[i])
            sharp[j] = float(s.sharpness[best])
    return prior, sharp


def _posteriors(prior: list[float], sharp: list[float]) -> Column:
    return _softmax([math.log(p) + x * F.col("sums")[j] for j, (p, x) in enumerate(zip(prior, sharp, strict=True))])


def _rates(members: DataFrame, weight: list[float], total: float | None, most: float | None, s: Settings) -> DataFrame:
    """``cell`` and ``rate``. There are at most as many cells as the grid has points that add up to 1."""
    domains = range(len(weight))
    cells = stored(
        members.groupBy("cell").agg(F.sum(F.col("n_tokens") * F.col("copies_in")).alias("tokens")), "cells"
    ).withColumn("p", F.transform("cell", lambda c: c / F.lit(float(s.grid))))
    per_domain = [F.coalesce(F.sum(F.col("tokens") * F.col("p")[j]), F.lit(0.0)) for j in domains]
    sums = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0)), *per_domain).first()
    everything = float(sums[0])
    start = 1.0 if most is None else min(1.0, most)
    if not everything:
        return cells.select("cell", F.lit(start).alias("rate"))
    largest = max(domains, key=lambda j: weight[j])
    goal = total if total is not None else sums[1 + largest] / weight[largest]
    target = np.array(weight) * goal / everything
    # All steps add up to one point in the space of domains; a cell's rate is its projection.

    def measured(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slopes at a point, and their curvature over the cells that a step may move."""
        rate, moved = _rate(at, most), _moved(at)
        inside = (moved >= 0) if most is None else (moved >= 0) & (moved <= most)
        products = [
            F.sum(F.when(inside, F.col("tokens") * F.col("p")[i] * F.col("p")[j]).otherwise(0.0))
            for i in domains for j in domains
        ]
        got = cells.agg(*(F.sum(F.col("tokens") * F.col("p")[j] * rate) for j in domains), *products).first()
        found = np.array(got, float) / everything
        curve = found[len(weight) :].reshape(len(weight), -1) + s.pull * np.eye(len(weight))
        return found[: len(weight)] - target - s.pull * at, curve

    at, damping = np.zeros(len(weight)), 1e-3
    slope, curve = measured(at)
    whole = curve
    for _ in range(s.steps):
        if np.abs(slope).max() <= s.tolerance:
            break
        step = np.linalg.solve(curve + damping * whole, slope)
        further, after = measured(at + step)
        if np.linalg.norm(further) > np.linalg.norm(slope) * (1 + 1e-9):  # too far
            damping *= 8
            continue
        at, slope, curve, damping = at + step, further, after, max(damping / 8, 1e-9)
    else:
        warnings.warn(f"after {s.steps} steps the slopes are {np.abs(slope).max():.2g} of all tokens", stacklevel=3)
    return cells.select("cell", _rate(at, most).alias("rate"))


def _moved(at: np.ndarray) -> Column:
    """1 less the steps a cell's posteriors take part in."""
    return F.lit(1.0) - sum((F.col("p")[j] * float(x) for j, x in enumerate(at)), F.lit(0.0))


def _rate(at: np.ndarray, most: float | None) -> Column:
    """The moved rate, projected to what a rate may be."""
    rate = F.greatest(_moved(at), F.lit(0.0))
    return rate if most is None else F.least(rate, F.lit(float(most)))


def take(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, each as often as ``mixed`` says."""
    some = mixed.filter("copies > 0").select(F.col("id").alias("of"), F.col("same").alias("of_same"), "copies").distinct()
    rows = docs.select(*_key(id_col, text_col), F.struct(*(quoted(c).alias(f"c{i}") for i, c in enumerate(docs.columns))).alias("row"))
    joined = rows.join(some, rows["id"].eqNullSafe(some["of"]) & (rows["same"] == some["of_same"]))
    often = joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("n"))
    return often.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)))
