"""Exact top-k against all inner products."""

import math

import numpy as np
import pandas as pd

from companion.llm import pivot_search as ps


def whole(vector):
    return [math.floor(64 * float(x)) for x in vector]


def brute(rows, queries, k):
    """{query: [(score, vec_id)]} with Python's whole numbers, repeated ids by their best."""
    out = {}
    for q, v in queries:
        best = {}
        for i, x in rows:
            if i != q and len(x) == len(v):
                score = sum(a * b for a, b in zip(x, v))
                score = min(max(score, -(1 << 63)), (1 << 63) - 1)
                best[i] = max(best.get(i, score), score)
        for i, s in best.items():
            out.setdefault(q, {})
            out[q][i] = max(out[q].get(i, s), s)
    return {q: sorted(((-s, i) for i, s in found.items()))[:k] for q, found in out.items()}


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        hits = out.setdefault(r.query_id, [])
        assert r.rank == len(hits) + 1
        hits.append((-r.score, r.vec_id))
    return out


def table(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, whole(r.embedding)) for r in df.collect()]
    x = np.array([v for _, v in rows])
    got = found(ps.top_k(df, df.filter("vec_id % 20 = 0"), cell_rows=200, first_rows=100))
    ids = np.array([i for i, _ in rows])
    for q, v in rows:
        if q % 20 == 0:
            score = x @ np.array(v)
            order = [(-int(score[j]), int(ids[j])) for j in np.lexsort((ids, -score)) if ids[j] != q]
            assert got.pop(q) == order[:20]
    assert not got


def test_clusters_and_spread_norms(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 12)) * 3
    x = centres[rng.integers(30, size=1500)] + rng.normal(size=(1500, 12)) / 20
    x *= rng.lognormal(sigma=0.5, size=(1500, 1))
    rows = list(enumerate(x.tolist()))
    df = table(spark, rows)
    ints = [(i, whole(v)) for i, v in rows]
    for options in ({"cell_rows": 100, "first_rows": 60, "piece": 64}, {"pivots": 1, "first_rows": 1}):
        got = found(ps.top_k(df, df.filter("vec_id % 30 = 0"), k=7, **options))
        assert got == brute(ints, ints[::30], 7)


def test_the_search_stops_before_the_end():
    """In clusters most candidates are never evaluated, and the k best are still exact."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 8)) * 50
    x = np.floor(64 * (centres[rng.integers(40, size=4000)] + rng.normal(size=(4000, 8))))
    space = ps.Space(8, float(np.abs(x).max()), 0.0)
    space.norm = float(np.sqrt((x / space.scale) ** 2 @ np.ones(8)).max())
    points = space.lifted(x, True)
    pivots = ps.far_apart(points, 32)
    rows = pd.DataFrame({"vec_id": range(4000), "vector": list(x), "far": list(ps.distances(points, pivots))})
    asked = space.lifted(x[:20], False)
    queries = pd.DataFrame({"query": range(20), "vector": list(x[:20]), "least": np.nan,
                            "far": list(ps.distances(asked, pivots))})
    got = ps.search_piece(10, space)(rows, queries)
    score = x[:20] @ x.T
    for q in range(20):
        best = got[got["query"] == q].sort_values(["score", "vec_id"], ascending=[False, True])
        order = np.lexsort((np.arange(4000), -score[q]))[:10]
        assert best["vec_id"].tolist() == order.tolist() and best["score"].tolist() == score[q][order].tolist()
    assert got.groupby("query")["evaluated"].first().mean() < 2000


def test_bounds_hold():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(300, 6)) * rng.lognormal(sigma=2, size=(300, 1)) * 64)
    space = ps.Space(6, float(np.abs(x).max()), 0.0)
    space.norm = float(np.linalg.norm(x / space.scale, axis=1).max())
    points, asked = space.lifted(x, True), space.lifted(x, False)
    pivots = ps.far_apart(points, 8)
    far, own = ps.distances(points, pivots), ps.distances(asked, pivots)
    for q in range(300):
        bound = ps.score_bound(space, float((asked[q] ** 2).sum()), np.abs(far - own[q]).max(axis=1))
        assert (bound >= x @ x[q]).all()


def test_edge_cases(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(80)]
    same = rows[3][1]
    rows += [(100 + i, same) for i in range(120)] + [(100, same), (5, rows[7][1])]   # copies, repeated ids
    rows += [(300, [0.0] * 6), (301, [-0.0] * 6), (302, [1e-9] * 6), (303, [-1e-9] * 6)]
    rows += [(400, [1.0, 2.0]), (401, [2.0, -1.0]), (402, []), (403, [])]
    bad = [(500, None), (501, [1.0, None]), (502, [float("nan")] * 6), (503, [float("inf")] + [0.0] * 5),
           (None, same)]
    df = table(spark, rows + bad).selectExpr("*", "1 AS rank", "'x' AS score", "2 AS cell", "3 AS query")
    ints = [(i, whole(v)) for i, v in rows]
    want = brute(ints, ints, 9)
    for options in ({}, {"cell_rows": 40, "first_rows": 30, "piece": 32}):
        got = found(ps.top_k(df, df, k=9, **options))
        assert got == want
    assert set(got[402]) == {(0, 403)} and len(got[400]) == 1
    assert ps.top_k(df.limit(0), df.limit(0)).count() == 0 and ps.top_k(df, df.limit(0)).count() == 0
    few = table(spark, rows[:4])
    assert {q: len(h) for q, h in found(ps.top_k(few, few)).items()} == dict.fromkeys(range(4), 3)


def test_large_components(spark):
    rows = [(i, [s * 10.0 ** e, 1.0, -3.5]) for i, (s, e) in enumerate(
        (s, e) for e in (0, 5, 9, 12, 16, 100, 300, 308) for s in (1.5, -1.25))]
    df = table(spark, rows)
    top = int(np.finfo(np.float64).max)
    ints = [(i, [min(max(math.floor(x * 64) if abs(x) < 2.0 ** 46 else int(x) * 64, -top), top) for x in v])
            for i, v in rows]
    assert found(ps.top_k(df, df, k=5)) == brute(ints, ints, 5)
