import numpy as np
from conftest import rows
from pyspark.sql import functions as F

from quillmart.llm import multi_index

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(data, cosine):
    usable = {}
    for i, v, label in data:
        if v is not None and label is not None and None not in v and np.isfinite(v).all() and np.any(v):
            usable[i] = (np.array(v, np.float32).astype(float), label)
    links = {i: set() for i, *_ in data}
    for i, (v, label) in usable.items():
        for j, (w, other) in usable.items():
            if i != j and label == other and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= cosine:
                links[i].add(j)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(links[i]), min(seen), i == min(seen))
    return out


def found(spark, data, **settings):
    table = spark.createDataFrame(data, SCHEMA).withColumns({c: F.lit(c) for c in ("id", "vec", "x", "to", "a", "n")})
    got = multi_index.near_duplicates(table, 0.93, settings=multi_index.Settings(**settings))
    return {r[0]: tuple(r[1:]) for r in got.collect()}


def near_copies(seed, groups, size, dim=32):
    rng = np.random.default_rng(seed)
    data = []
    for g in range(groups):
        centre = rng.normal(size=dim)
        for k in range(size):
            v = centre + rng.normal(size=dim) * rng.choice([0, 0.1, 0.2])
            data.append((len(data) * 3, [float(x) for x in v * rng.uniform(0.5, 3)], int(g % 3)))
    return data


def test_links_against_all_pairs(spark):
    data = near_copies(8, 30, 12)
    expected = plain(data, 0.93)
    got = found(spark, data)
    n, all_links = (sum(x[i][0] for i in expected) for x in (got, expected))
    assert n >= 0.99 * all_links > 0
    assert all(got[i][0] <= expected[i][0] for i in got)
    assert sum(got[i][1] == expected[i][1] for i in got) >= 0.99 * len(got)


def test_blocks_change_nothing(spark):
    data = near_copies(10, 1, 150)
    whole = found(spark, data)
    assert found(spark, data, block_rows=16) == whole
    expected = plain(data, 0.93)
    assert all(whole[i][1:] == expected[i][1:] for i in expected)
    assert sum(x[0] for x in whole.values()) >= 0.99 * sum(x[0] for x in expected.values())


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, 3.0, 4.0]
    data = [
        (9, v, 1), (4, [2.0, 4.0, 6.0, 8.0], 1), (7, v, 2), (8, v, None), (1, None, 1), (2, [0.0] * 4, 1),
        (3, [nan, 1.0, 1.0, 1.0], 1), (5, [inf, 1.0, 1.0, 1.0], 1), (6, [None, 1.0, 1.0, 1.0], 1), (10, v, 1), (11, [1.0], 1),
    ]
    got = found(spark, [*data, (9, v, 1)])
    assert got == {**{i: (0, i, True) for i in (1, 2, 3, 5, 6, 7, 8, 11)}, 4: (2, 4, True), 9: (2, 4, False), 10: (2, 4, False)}
    assert found(spark, [(1, None, None)]) == {1: (0, 1, True)}
    assert found(spark, []) == {}


def test_extreme_vectors_link_by_direction(spark):
    data = [(i, [1.0 * size, 2.0 * size, -size], 1) for i, size in enumerate((1e200, 1e-200, 3.0, 1e308 / 2, 1e-300))]
    data.append((9, [1e200, -1e200, 0.0], 1))
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    got = {r[0]: tuple(r[1:]) for r in multi_index.near_duplicates(table, 0.93).collect()}
    assert got == {**{i: (4, 0, i == 0) for i in range(5)}, 9: (0, 9, True)}


def test_many_cells_find_the_links_of_all_pairs(spark):
    data = near_copies(12, 60, 20)
    expected = plain(data, 0.93)
    got = found(spark, data, cell_rows=2, block_rows=64)
    n, all_links = (sum(x[i][0] for i in expected) for x in (got, expected))
    assert n >= 0.99 * all_links > 0
    assert all(got[i][0] <= expected[i][0] for i in got)


def test_whole_table_against_all_pairs(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    data = [tuple(r) for r in table.collect()]
    got = {r[0]: tuple(r[1:]) for r in rows(multi_index.near_duplicates(table, 0.93))}
    assert got == plain(data, 0.93)


def test_cells_are_visited_nearest_first_as_far_as_the_reach():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = multi_index.fit(x, 5000, 0.93, multi_index.Settings())
    a, b = index.distances(x)
    visited = {(i, code, int(c)) for i, code, second in index.visited(x) for c in second}
    expected = {
        (i, j, k) for i in range(len(x)) for j in range(a.shape[1]) for k in range(b.shape[1]) if a[i, j] + b[i, k] <= index.reach
    }
    assert visited == expected and all((i, *c) in visited for i, c in enumerate(index.cells(x).tolist()))
