import random

import numpy as np
import pytest
from conftest import rows
from corpus import documents, no_documents, random_words
from pyspark.sql import functions as F

from quillmart.llm import mixing
from quillmart.llm.production import TARGETS, domains

DOMAINS = ["code", "news", "poem"]


@pytest.fixture(scope="module")
def corpus(spark):
    """Documents of three domains with words of their own, some of two domains at once."""
    rng = random.Random(1)
    own = {d: random_words(i, 40) for i, d in enumerate(DOMAINS)}
    common = random_words(9, 400)
    docs, labels = [], []
    for i in range(900):
        domain = rng.choices(DOMAINS, [6, 3, 1])[0]
        parts = [domain] if i % 5 else [domain, rng.choice(DOMAINS)]
        words = rng.choices(common, k=rng.randrange(20, 80)) + [w for p in parts for w in rng.choices(own[p], k=12)]
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        if i % 2:
            labels.append((i, domain))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    return table.cache(), spark.createDataFrame(labels, "id long, domain string"), dict(docs)


def shares(mixed, column="rate"):
    total = np.zeros(len(DOMAINS))
    for r in mixed:
        total += r["n_tokens"] * r[column] * np.array(r["posteriors"])
    return total / total.sum(), total.sum()


def plain_rates(p, n, target, pull, most=np.inf):
    """Projected gradient descent on all rates, step by step, until it stands still."""
    n = n / n.sum()
    rate = np.minimum(np.ones(len(p)), most)
    for _ in range(400_000):
        gaps = (n * rate) @ p - target
        before, rate = rate, np.clip(rate - 0.5 * (p @ gaps + pull * (rate - 1)), 0, most)
        if np.abs(rate - before).max() < 1e-9:
            break
    return rate


@pytest.mark.parametrize("most", [None, 1.0])
def test_rates_against_plain_descent(corpus, most):
    docs, labels, texts = corpus
    targets = {"code": 0.4, "news": 0.4, "poem": 0.2}
    got = mixing.mix(docs, labels, targets, total_tokens=30_000.0, most=most).collect()
    assert {r["id"] for r in got} == set(texts)
    assert all(r["n_tokens"] == len(texts[r["id"]].split()) for r in got)
    p = np.round(np.array([r["posteriors"] for r in got]) * 128) / 128
    n = np.array([r["n_tokens"] for r in got], float)
    goal = np.array([0.4, 0.4, 0.2]) * 30_000 / n.sum()
    expected = plain_rates(p, n, goal, 1e-4, most or np.inf)
    assert np.abs(np.array([r["rate"] for r in got]) - expected).max() < 0.02
    if most is None:
        share, total = shares(got)
        assert np.abs(share - [0.4, 0.4, 0.2]).max() < 0.01 and abs(total / 30_000 - 1) < 0.01


def test_posteriors_are_soft_and_right(corpus):
    docs, labels, _ = corpus
    got = {r["id"]: r["posteriors"] for r in mixing.mix(docs, labels, dict.fromkeys(DOMAINS, 1.0)).collect()}
    assert all(abs(sum(p) - 1) < 1e-6 for p in got.values())
    # Of documents with words of one domain.
    told = [(DOMAINS[int(np.argmax(got[r["id"]]))], r["domain"]) for r in labels.collect() if r["id"] % 5]
    assert np.mean([a == b for a, b in told]) > 0.8


def test_copies_are_rates_rounded_by_a_hash(corpus):
    docs, labels, _ = corpus
    mixed = mixing.mix(docs, labels, {"code": 0.2, "news": 0.2, "poem": 0.6})
    got = mixed.collect()
    assert all(r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) for r in got)
    assert abs(sum(r["copies"] for r in got) / sum(r["rate"] for r in got) - 1) < 0.1
    taken = mixing.take(docs, mixed)
    assert taken.columns == docs.columns and taken.count() == sum(r["copies"] for r in got)


def test_awkward_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame(
        [(4, "code"), (5, "news"), (6, "news"), (6, "code"), (99, "poem"), (7, "other"), (9, None), (None, "code")],
        "id long, domain string",
    )
    mixed = mixing.mix(docs, labels, dict.fromkeys(DOMAINS, 1.0), most=1.0)
    got = {r["id"]: r for r in mixed.collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, None, 9, 10, 11}
    assert [got[i]["n_tokens"] for i in (1, 2, 3, 4)] == [0, 0, 0, 1] and got[5]["n_tokens"] == 40_000
    taken = mixing.take(docs, mixed.withColumn("copies", F.lit(1)))
    assert taken.columns == docs.columns and taken.count() == 12


def test_small_corpora_are_learned_from(spark):
    """Labelled documents of the smallest tables belong to their domain more than others do."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = domains(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    mixed = mixing.mix(docs, labels, TARGETS)
    assert mixed.count() == docs.count() and mixed.select("posteriors").distinct().count() > 100
    names = sorted(TARGETS)
    rows_ = mixed.join(labels, "id").select("domain", "posteriors").collect()
    for j, d in enumerate(names):
        own = np.mean([r["posteriors"][j] for r in rows_ if r["domain"] == d])
        other = np.mean([r["posteriors"][j] for r in rows_ if r["domain"] not in (d, None)])
        assert own > 2 * other, (d, own, other)
    for r in mixing.totals(mixed, TARGETS).collect():
        assert abs(r["reached"] - r["target"]) < 0.02, r


def test_every_row_has_a_result(spark):
    docs = spark.createDataFrame([(1, "a b")] * 3 + [(None, "c")] * 2 + [(1, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, "code")], "id long, domain string")
    mixed = mixing.mix(docs, labels, dict.fromkeys(DOMAINS, 1.0), most=1.0)
    assert sorted((r["id"] or 0, r["n_tokens"]) for r in mixed.collect()) == [(0, 1), (0, 1), (1, 1), (1, 2), (1, 2), (1, 2)]
    assert mixing.take(docs, mixed.withColumn("copies", F.lit(2))).count() == 12


def test_without_labels_or_documents(spark):
    labels = spark.createDataFrame([], "id long, domain string")
    got = mixing.mix(documents(spark), labels, dict.fromkeys(DOMAINS, 1.0)).collect()
    assert all(np.allclose(r["posteriors"], 1 / 3) for r in got)
    assert rows(mixing.mix(no_documents(spark), labels, dict.fromkeys(DOMAINS, 1.0))) == []


def test_the_main_path_has_no_python(corpus):
    docs, labels, _ = corpus
    mixed = mixing.mix(docs, labels, dict.fromkeys(DOMAINS, 1.0))
    plan = mixing.take(docs, mixed)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
