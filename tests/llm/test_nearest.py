"""Nearest neighbours against brute force."""

import contextlib

import numpy as np

from companion.llm import nearest


def brute(rows, queries, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for q, v in queries:
        score = x @ np.array(v, dtype=np.float64)
        best = [i for i in np.lexsort((ids, -np.round(score, 12))) if ids[i] != q][:k]
        out[q] = [int(ids[i]) for i in best]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def recall(got, want):
    return np.mean([len({v for _, v, _ in got.get(q, [])} & set(w)) / len(w) for q, w in want.items()])


def test_recall_on_the_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = found(nearest.nearest(df, df.filter("vec_id % 20 = 0")))
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    assert set(got) == set(want) and recall(got, want) >= 0.9
    vectors = dict(rows)
    for q, hits in got.items():
        assert [r for r, _, _ in hits] == list(range(1, 21)) and q not in {v for _, v, _ in hits}
        exact = [float(np.dot(np.float64(vectors[q]), np.float64(vectors[v]))) for _, v, _ in hits]
        assert np.allclose([s for _, _, s in hits], exact, atol=1e-12)
        assert [(-s, v) for _, v, s in hits] == sorted((-s, v) for _, v, s in hits)


def test_edge_cases(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)]
    same = rng.normal(size=8).tolist()
    rows += [(100 + i, same) for i in range(200)] + [(100, same)]             # a hot vector, a repeated row
    rows += [(400, None), (401, []), (402, [0.0] * 8), (403, [1.0] * 7 + [None]),
             (404, [1.0] * 7 + [float("nan")]), (405, [1.0] * 7 + [float("inf")]), (None, same),
             (406, [1.0, 2.0]), (407, [2.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows],
                               "vec_id long, embedding array<float>, bucket string, score double")
    options = dict(k=5, tables=16, probes=16, axes=8)             # every axis: exact
    got = found(nearest.nearest(df, df, **options))
    usable = [(i, np.float32(v).tolist()) for i, v in rows if i is not None and v and len(v) == 8
              and None not in v and np.isfinite(v).all() and any(v)]
    usable = list(dict(usable).items())
    want = brute(usable, usable, 5)
    assert {q: [v for _, v, _ in h] for q, h in got.items() if q < 400} == want
    assert [v for _, v, _ in got[406]] == [407] and set(got) == set(want) | {406, 407}
    pieces = found(nearest.nearest(df, df, piece=16, **options))
    assert pieces == got
    assert nearest.nearest(df.limit(0), df.limit(0)).count() == 0


def test_norms_count(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=16) * (1 + i % 7)).tolist()) for i in range(800)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(nearest.nearest(df, df.filter("vec_id % 20 = 0"), k=10))
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 10)
    assert recall(got, want) >= 0.9


def test_recall_with_long_and_spread_norms(spark):
    rng = np.random.default_rng(6)
    unit = rng.normal(size=(8000, 64))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    one_long = np.ones(8000)
    one_long[77] = 100.0
    for norms in (one_long, rng.lognormal(size=8000), rng.uniform(0.7, 1.4, size=8000)):
        rows = list(enumerate((unit * norms[:, None]).tolist()))
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = found(nearest.nearest(df, df.filter("vec_id % 40 = 0")))
        want = brute(rows, rows[::40], 20)
        assert set(got) == set(want) and recall(got, want) >= 0.9


def test_every_query_finds_what_there_is(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(15)]
    rows += [(100 + i, rng.normal(size=48).tolist()) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(nearest.nearest(df, df))
    for some in (rows[:15], rows[15:]):
        want = brute(some, some, 20)
        assert {q: [v for _, v, _ in got[q]] for q in want} == want
    # one bundle, and a query that looks the other way: its probes meet no row
    bundle = np.ones(64) + rng.normal(size=(5000, 64)) / 100
    rows = list(enumerate((bundle / np.linalg.norm(bundle, axis=1)[:, None]).tolist()))
    asked = [(9000, (-np.ones(64) / 8).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(nearest.nearest(df, spark.createDataFrame(asked, df.schema)))
    assert [v for _, v, _ in got[9000]] == brute(rows, asked, 20)[9000]


def probing_share(spark, n, seed):
    """(recall, share of the rows that a query meets) on ``n`` random unit vectors."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    asked = df.filter(f"vec_id % {n // 100} = 0")
    with watched_tables() as written:
        got = found(nearest.nearest(df, asked))
    order = np.argsort(-(x[::n // 100] @ x.T), axis=1)[:, 1:21]
    want = {int(q): [int(v) for v in o] for q, o in zip(range(0, n, n // 100), order)}
    key = ["length", "band", "table", "bucket"]
    met = written["nearest-probes"].join(written["nearest-index"], key).select("query", "vec_id").distinct().count()
    return recall(got, want), met / (len(want) * n)


@contextlib.contextmanager
def watched_tables():
    """The first stage table of each name that ``nearest`` writes."""
    written, plain = {}, nearest.materialize

    def watched(df, name):
        out = plain(df, name)
        written.setdefault(name, out)
        return out

    nearest.materialize = watched
    try:
        yield written
    finally:
        nearest.materialize = plain


def test_share_of_rows_falls_as_the_table_grows(spark):
    few, many = probing_share(spark, 2500, 1), probing_share(spark, 40_000, 2)
    print(f"recall and share: {few} of 2,500 rows, {many} of 40,000 rows")
    assert min(few[0], many[0]) >= 0.9
    assert many[1] < 0.9 * few[1]


def test_huge_and_tiny_components(spark):
    rng = np.random.default_rng(11)
    rows = [(i, (rng.normal(size=8) * s).tolist()) for i, s in enumerate([1e200] * 6 + [1.0] * 30 + [1e-200] * 6
                                                                       + [1e307] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(nearest.nearest(df, df, k=45))
    x = np.array([v for _, v in rows])
    with np.errstate(over="ignore"):
        for q, hits in got.items():
            assert len(hits) == 45 and not np.isnan([s for _, _, s in hits]).any()
            assert [(-s, v) for _, v, s in hits] == sorted((-s, v) for _, v, s in hits)
            scale = max(1e-300, np.abs(x[q]).max())
            for _, v, s in hits:
                size = np.abs(x[v]).max()
                exact = float((x[q] / scale) @ (x[v] / size)) * scale * size
                assert s == exact or np.isclose(s, exact, rtol=1e-9, atol=0)


def test_ids_with_several_vectors(spark):
    rng = np.random.default_rng(12)
    vectors = rng.normal(size=(30, 6)).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)] + [(0, vectors[5]), (3, vectors[9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(nearest.nearest(df, df, k=30))
    for q in range(30):
        best = {}
        for i, v in rows:
            for j, w in rows:
                if i == q and j != q:
                    best[j] = max(best.get(j, -np.inf), float(np.dot(v, w)))
        assert [v for _, v, _ in got[q]] == sorted(best, key=lambda j: (-best[j], j))


def test_transform_keeps_lengths_and_angles():
    rows = np.random.default_rng(0).normal(size=(5, 16))
    turned = nearest.rotations(rows, 3, 1)
    assert np.allclose(turned @ turned.T, rows @ rows.T)
