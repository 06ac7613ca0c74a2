import math

import numpy as np
from conftest import rows
from pyspark.sql import functions as F

from quillmart.llm import projected_search
from quillmart.llm.projected_search import Settings, chi_square_quantile, leaf_of, split_tree

SCHEMA = "vec_id long, embedding array<float>"


def plain(data, k):
    ids = np.array([i for i, _ in data])
    x = np.array([v for _, v in data], np.float32).astype(float)
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        score = (x * x[i]).sum(1)
        score[i] = -math.inf
        out[ids[i]] = [int(j) for j in ids[np.lexsort((ids, -score))][: min(k, len(ids) - 1)]]
    return out


def found(spark, data, k, **settings):
    table = spark.createDataFrame(data, SCHEMA).withColumns({c: F.lit(c) for c in ("id", "vec", "near", "leaf", "rank", "label")})
    got = rows(projected_search.search(table, F.col("id") % 20 == 0, k, settings=Settings(**settings)))
    out = {}
    for query, rank, vec, score in sorted(got):
        out.setdefault(query, []).append(vec)
        assert rank == len(out[query]) and isinstance(score, float)
    return out


def recall(got, expected):
    return sum(len(set(got[q]) & set(v)) for q, v in expected.items()) / sum(map(len, expected.values()))


def test_recall_over_leaves_and_blocks(spark):
    rng = np.random.default_rng(1)
    data = [(i, (rng.normal(size=24) * rng.uniform(0.5, 2)).tolist()) for i in range(3000)]
    data += [(3000 + i, data[40][1]) for i in range(400)]  # copies of a query
    expected = plain(data, 10)
    got = found(spark, data, 10, block_rows=128, step=32)
    assert recall(got, expected) >= 0.9
    assert got[40] == expected[40]  # equal scores rank by id


def test_recall_with_a_few_very_long_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[rng.permutation(4000)[:40]] *= 10
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    assert recall(found(spark, data, 20, block_rows=128, step=32), plain(data, 20)) >= 0.9


def test_whole_table_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    data = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    got = {}
    for query, _, vec, score in sorted(rows(projected_search.search(table, F.col("id") % 20 == 0, 20))):
        got.setdefault(query, []).append(vec)
    assert recall(got, plain(data, 20)) >= 0.9


def test_few_candidates_are_all_returned(spark):
    data = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (20, [0.0, -1.0])]
    assert found(spark, data, 20) == {0: [2, 1, 20], 20: [0, 1, 2]}
    assert found(spark, data[:1], 20) == {}


def test_vectors_of_any_length(spark):
    assert found(spark, [(0, [1e7, 0.0]), (1, [-1e7, 1.0]), (2, [1.0, 0.0]), (3, [-1.0, 3.0])], 20) == {0: [2, 3, 1]}
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 6))
    expected = [int(j) for j in np.argsort(-(x @ x[0]), kind="stable") if j]
    for size, squared in ((1e200, math.inf), (1e-200, 0.0), (1e-310, 0.0)):
        data = spark.createDataFrame([(i, (v * size).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = sorted(rows(projected_search.search(data, F.col("id") == 0, 100, settings=Settings(block_rows=16))))
        # Tiny components have lost digits, so only their number is fixed.
        assert [r[2] for r in got] == expected or size == 1e-310 and sorted(r[2] for r in got) == sorted(expected)
        assert {abs(r[3]) for r in got} == {squared}


def test_clusters_leave_most_leaves_unvisited(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 32))
    x = centres[rng.integers(0, 40, 6000)] + 0.1 * rng.normal(size=(6000, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    tables = {}
    store = projected_search.stored
    monkeypatch.setattr(projected_search, "stored", lambda df, name: tables.setdefault(name, []).append(store(df, name)) or tables[name][-1])
    assert recall(found(spark, data, 20, block_rows=128, step=32), plain(data, 20)) >= 0.9
    leaves = tables["placed"][0].select("leaf").distinct().count()
    visits = sum(t.count() for t in tables["visits"])
    assert leaves > 40 and visits < 0.5 * 300 * (leaves - 1)


def test_awkward_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    data = [
        (0, [1.0, 2.0]), (1, [2.0, 1.0]), (1, [2.0, 1.0]), (20, None), (40, [0.0, 0.0]), (60, [nan, 1.0]),
        (2, [inf, 1.0]), (3, [None, 1.0]), (4, [1.0]), (None, [1.0, 1.0]), (5, [1.0, 1.0]),
    ]
    assert found(spark, data, 5) == {0: [1, 5]}
    assert found(spark, [], 5) == {}
    assert found(spark, [(20, None)], 5) == {}


def test_chi_square_quantiles():
    # Fixed values of the distribution.
    for p, dims, value in ((0.95, 2, 5.991), (0.95, 8, 15.507), (0.99, 12, 26.217), (0.5, 4, 3.357)):
        assert abs(chi_square_quantile(p, dims) - value) < 1e-3


def test_every_row_has_the_leaf_its_splits_lead_to():
    rng = np.random.default_rng(2)
    points = np.round(rng.normal(size=(500, 3)), 1)
    tree = split_tree(points, 40)
    leaf = leaf_of(points, tree)
    assert len(set(leaf.tolist())) == sum(n[0] < 0 for n in tree) > 8
    assert np.bincount(leaf).max() <= 40
    same = np.ones((50, 3))
    assert set(leaf_of(same, split_tree(same, 4)).tolist()) == {0}
