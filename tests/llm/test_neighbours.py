import numpy as np

from fieldloom.llm import neighbours


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_recall_and_contract(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[100:140] = x[50]  # copies: ties go to the smaller id
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(3000)]
    bad = [(5000, None, 0), (5050, [0.0] * 16, 0), (5100, [1.0] * 15 + [float("nan")], 0), (5150, [1.0, None] * 8, 0), (5200, [1.0] * 3, 0), (None, [1.0] * 16, 0), rows[7]]
    out = neighbours.nearest(frame(spark, rows + bad)).collect()
    v = x.astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    hits = 0
    by = {}
    for r in out:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(by) == list(range(0, 3000, 50))
    for q, found in by.items():
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5] and q not in [f[1] for f in found]
        s = v @ v[q]
        s[q] = -2
        best = np.lexsort((np.arange(3000), -np.round(s, 12)))[:5]
        hits += len({f[1] for f in found} & set(best.tolist()))
        assert all(abs(f[2] - s[f[1]]) < 1e-9 for f in found)
    assert hits / (5 * len(by)) >= 0.9
    assert [f[1] for f in by[50]] == [100, 101, 102, 103, 104]


def test_small_tables(spark):
    assert neighbours.nearest(frame(spark, [])).count() == 0
    assert neighbours.nearest(frame(spark, [(0, [1.0, 0.0], 0)])).count() == 0
    rows = neighbours.nearest(frame(spark, [(0, [1.0, 0.0], 0), (1, [0.0, 2.0], 0), (2, [3.0, 3.0], 0)])).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in rows] == [(0, 1, 2), (0, 2, 1)]


def test_hot_list_is_split(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CHUNK", 64)
    rng = np.random.default_rng(1)
    x = np.concatenate([np.ones((400, 8)) + rng.normal(scale=1e-3, size=(400, 8)), rng.normal(size=(200, 8))])
    out = neighbours.nearest(frame(spark, [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]), every=100).collect()
    assert len(out) == 6 * 5


def test_extreme_magnitudes_and_clashing_columns(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 8))
    scale = np.array([1e-200, 1e200, 1e-310, 1.0, 1e300, 5e-160])[np.arange(200) % 6]
    rows = [(i, [float(v) for v in row * k]) for i, (row, k) in enumerate(zip(x, scale))]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as rank", "2 as score", "3 as query_id", "4 as vector", "5 as list", "6 as code", "7 as chunk")
    out = neighbours.nearest(docs, every=20).collect()
    v = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert len(out) == 50
    for r in out:
        loose = 1e-9 if min(scale[r["vec_id"]], scale[r["query_id"]]) > 1e-300 else 1e-3  # digits are lost near the least double
        assert abs(r["score"] - v[r["query_id"]] @ v[r["vec_id"]]) < loose


def test_lists_that_are_split_again(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "MAX_LISTS", 16)
    monkeypatch.setattr(neighbours, "LIST_ROWS", 32)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 16))[rng.integers(0, 60, 4000)] + rng.normal(scale=0.4, size=(4000, 16))
    index = neighbours.fit_index(neighbours.unit(x), 4000)
    assert index.lists() == 16 * 7
    at, rest = index.assign(neighbours.unit(x[:50]))
    assert np.allclose(index.centres(at) + rest, neighbours.unit(x[:50]), atol=1e-6)
    away = index.remoteness(neighbours.unit(x[:50]))
    want = ((neighbours.unit(x[:50])[:, None] - index.centres(np.arange(index.lists()))[None]) ** 2).sum(axis=2) / 2
    assert np.allclose(away - away[:, :1], want - want[:, :1], atol=1e-5)
    out = neighbours.nearest(frame(spark, [(i, [float(v) for v in r], 0) for i, r in enumerate(x)])).collect()
    v = x.astype(np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 4000, 50):
        s = v @ v[q]
        s[q] = -2
        hits += len({r["vec_id"] for r in out if r["query_id"] == q} & set(np.argsort(-s)[:5].tolist()))
    assert hits / 400 >= 0.9


def test_the_least_vector_counts_where_an_id_repeats(spark):
    rows = [(0, [1.0, 0.0], 0), (7, [1.0, 0.1], 0), (7, [-1.0, 0.1], 0), (7, None, 0), (9, [0.0, 1.0], 0)]
    for order in (rows, rows[::-1]):
        got = neighbours.nearest(frame(spark, order)).orderBy("rank").collect()
        assert [(r["vec_id"], round(r["score"], 3)) for r in got] == [(9, 0.0), (7, -0.995)]
