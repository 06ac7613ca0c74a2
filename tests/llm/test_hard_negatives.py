import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from quillmart.llm import hard_negatives
from quillmart.llm.hard_negatives import Settings

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(data, every, positives=5, negatives=10):
    """All pairs of rows that take part."""
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], label) for i, v, label in data]
    out = []
    for a, v, label in kept:
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), b, other) for b, w, other in kept if b != a]
        for p_score, p, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            band = sorted(x for x in scored if x[2] != label and 30 * -p_score <= 100 * -x[0] <= 90 * -p_score)
            out += [(a, p, r + 1, b, -p_score, -score) for r, (score, b, _) in enumerate(band[:negatives])]
    return sorted(out)


def found(spark, data, every, **settings):
    names = ("id", "vec", "cluster", "want", "found", "score", "rank", "bound", "anchor", "low", "high")
    table = spark.createDataFrame(data, SCHEMA).withColumns({c: F.lit(c) for c in names})
    vectors = hard_negatives.whole_vectors(table, 256.0, "vec_id", "embedding", "label")
    return sorted(rows(hard_negatives.mine(vectors, F.col("id") % every == 0, Settings(**settings))))


@pytest.mark.parametrize("clustered", [True, False])
def test_all_negatives_are_found_over_many_clusters_and_segments(spark, clustered):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    x = rng.normal(size=(900, 16)) * (0.1 if clustered else 1.0) + centres[rng.integers(0, 12, 900)] * clustered
    x[::9] *= 3
    data = [(i, (v / np.linalg.norm(v) * (1 + (i % 5 == 0))).tolist(), int(rng.integers(0, 3))) for i, v in enumerate(x)]
    data += [(900 + i, data[7][1], i % 3) for i in range(150)]  # copies
    settings = {"cluster_anchors": 8, "first_rows": 64, "growth": 3, "block_rows": 64, "step": 16}
    assert found(spark, data, 10, **settings) == plain(data, 10)


def test_clustered_lists_are_left_early():
    """Asks stop long before the end of a list when the rows near them score high."""
    rng = np.random.default_rng(6)
    near = rng.normal(size=(64, 8)) * 0.05 + 4
    far = rng.normal(size=(4000, 8)) * 0.05 - 4
    x = np.floor(np.concatenate([near, far]) * 256)
    lists = hard_negatives.Lists(hard_negatives.unit(near.mean(0)[None]), np.array([0.1]), np.zeros((1, 0)))
    bounds = lists.bounds(x)[:, 0]
    order = np.argsort(-bounds)

    labels = np.array(["a"] * len(x), object)
    none = np.full(4, -(2**62))
    hits = dict(
        (i, best) for i, _, best in hard_negatives.walk(
            x[:4], none, -none, np.arange(4), labels[:4], x[order], order, labels[order], bounds[order], 5, True, 64
        )
    )
    assert (bounds[order][128:] * np.sqrt((x[:4] ** 2).sum(1)).max() < min(b.min() for b in hits.values())).all()
    for i, best in hits.items():
        assert sorted(best)[::-1] == sorted((x @ x[i])[np.arange(len(x)) != i].astype(int))[::-1][:5]


def test_bounds_hold(spark):
    rng = np.random.default_rng(7)
    x, centres = rng.normal(size=(500, 6)), hard_negatives.unit(rng.normal(size=(3, 6)))
    asks = hard_negatives.unit(rng.normal(size=(200, 6)))
    angle = np.arccos(np.clip(asks @ centres.T, -1, 1))
    own = angle.argmin(1)
    spread = np.array([angle[own == c, c].max(initial=0) for c in range(3)])
    bounds = hard_negatives.Lists(centres, spread, np.zeros((3, 0))).bounds(x)
    assert ((x @ asks.T) <= bounds[:, own] + 1e-9).all()


def test_few_rows_ties_and_zero_vectors(spark):
    data = [
        (0, [0.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 0.0], 2), (3, [2.0, 1.0], 2), (100, [1.0, 1.0], 2),
        (101, [1.0, 1.0], 2), (102, [0.5, 0.5], 1), (103, [0.5, 0.5], 1), (104, [0.25, 0.5], 3), (200, [-1.0, -1.0], 3),
    ]
    assert found(spark, data, 100) == plain(data, 100) != []
    assert found(spark, data[:1], 100) == []


def test_awkward_rows_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 1.0], 1), (1, [1.0, 0.5], 1), (2, [0.5, 0.5], 2), (100, [0.5, 1.0], 2), (3, [0.5, 0.25], 1)]
    bad = [
        (4, None, 1), (5, [nan, 1.0], 2), (6, [None, 1.0], 2), (7, [inf, 0.0], 1), (8, [1.0], 1), (9, [1.0, 1.0], None),
        (None, [1.0, 1.0], 2), (300, [3e9, 0.0], 1), (10, [], 2), (1, [1.0, 0.5], 1),
    ]
    assert found(spark, good + bad, 100) == plain(good, 100) != []
    assert found(spark, [], 100) == []
    assert found(spark, [(1, [1.0], 1)], 100) == []


def test_large_whole_numbers_are_exact(spark):
    rng = np.random.default_rng(8)
    data = [(i, (rng.integers(-30000, 30000, 4) + rng.integers(0, 64, 4) / 64).tolist(), i % 3) for i in range(150)]
    assert found(spark, data, 10) == plain(data, 10) != []
