"""Whitening against numpy's eigenvalues, and the solver on hard matrices."""

import numpy as np
import pytest

from companion.llm import whitening as wh


def solved(r, most=64):
    vectors, values, trace = wh.directions(r, 1, most)
    return vectors, values, trace


def hard_matrices():
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.normal(size=(40, 40)))
    return {
        "random": rng.normal(size=(60, 40)), "identity": np.eye(12), "rotation": 5 * q,
        "multiples": np.diag([3.0, 3, 3, 2, 2, 1, 0, 0]), "zero": np.zeros((5, 5)), "one": np.array([[2.0]]),
        "few rows": rng.normal(size=(9, 30)), "rank 3": rng.normal(size=(50, 3)) @ rng.normal(size=(3, 20)),
        "graded": rng.normal(size=(80, 16)) * 10.0 ** np.linspace(0, -9, 16),
        "graded up": rng.normal(size=(80, 16)) * 10.0 ** np.linspace(-9, 0, 16),
        "blocks": np.kron(np.eye(4), rng.normal(size=(20, 5))),
        "wilkinson": np.diag(np.abs(np.arange(21) - 10.0)) + np.diag(np.ones(20), 1),
    }


@pytest.mark.parametrize("name", hard_matrices())
def test_solver(name):
    r = wh.triangle(hard_matrices()[name])
    diagonal, above, right = wh.bidiagonal(r)
    assert np.allclose(right.T @ right, np.eye(len(r)), atol=1e-13)
    exact = np.linalg.svd(r, compute_uv=False) ** 2
    top = max(exact[0], 1e-300)
    assert np.abs(wh.squared_singular_values(diagonal, above) - exact).max() <= 1e-13 * top
    vectors, values, trace = solved(r)
    assert len(values) == (exact > 1e-20 * top).sum() and np.isclose(trace, exact.sum(), rtol=1e-12)
    assert np.abs(r.T @ (r @ vectors) - vectors * values).max(initial=0) <= 1e-12 * top
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max(initial=0) <= 1e-11


def test_small_values_keep_relative_accuracy():
    rng = np.random.default_rng(1)
    a, b = 10.0 ** rng.uniform(-8, 2, 30), 10.0 ** rng.uniform(-8, 2, 29)
    dense = np.diag(a) + np.diag(b, 1)
    got = np.sqrt(wh.squared_singular_values(a, b))
    large = np.linalg.svd(dense, compute_uv=False)
    assert np.allclose(got[:10], large[:10], rtol=1e-12)
    assert np.isclose(np.log(got).sum(), np.log(a).sum(), rtol=1e-12)      # the determinant


def check(df, rows, components=32):
    """All columns against plain arithmetic on the rows that take part."""
    got = df.toPandas()
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in rows])
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    width = min(components, int((values > 1e-12 * values[0]).sum()))
    assert len(got) == n * width and set(got["n"]) == {n}
    exact = {}
    for (i, _), row in zip(rows, x.tolist()):
        exact.setdefault(i, []).append(sum((n * v - int(s)) ** 2 for v, s in zip(row, sums)))
    for i, some in got[got["component"] == 1].groupby("vec_id"):
        assert sorted(some["deviation"]) == sorted(exact[i])
    for c, some in got.groupby("component"):
        assert np.allclose(some["explained"], values[c - 1] / values.sum(), rtol=1e-6)
    assert set(got["component"]) == set(range(1, width + 1)) and got["identity_error"].nunique() == 1
    assert 0 <= got["identity_error"].iloc[0] <= 1e-8
    return got, x, vectors, values


def test_whole_table(spark, small):
    table = small("embeddings")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    for df in (table, table.repartition(70)):                  # more triangles than one task reduces
        got, x, vectors, values = check(wh.whiten(df), rows)
        wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[[i for i, _ in rows]]
        w = wide.to_numpy()
        assert np.abs(w.T @ w / len(w) - np.eye(32)).max() < 1e-9
        want = (x - x.mean(axis=0)) @ vectors[:, :32] / np.sqrt(values[:32])
        assert np.allclose(w, want * np.sign((want * w).sum(axis=0)), atol=1e-8)
        assert got.columns.tolist() == ["vec_id", "component", "n", "deviation", "whitened", "explained",
                                        "identity_error"]


def test_edge_cases(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(40)] + [(3, rng.normal(size=5).tolist())]
    rows += [(60, rows[0][1])] * 30                            # copies
    bad = [(70, None), (71, []), (72, [1.0, None, 0.0, 0.0, 0.0]), (73, [float("nan")] * 5),
           (74, [float("inf")] * 5), (75, [1e300] * 5), (76, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows + bad],
                               "vec_id long, embedding array<double>, part string, n double")
    check(wh.whiten(df), rows)
    two, *_ = check(wh.whiten(df, components=2), rows, 2)
    assert two["component"].max() == 2
    flat = [(i, [0.5, float(i % 3), 0.25]) for i in range(9)]  # varies along one axis only
    check(wh.whiten(spark.createDataFrame(flat, "vec_id long, embedding array<double>")), flat)
    one = spark.createDataFrame(rows[:1], "vec_id long, embedding array<double>")
    assert wh.whiten(one).count() == 0 and wh.whiten(df.limit(0)).count() == 0
    assert wh.whiten(spark.createDataFrame([(None, v) for _, v in rows], one.schema)).filter(
        "vec_id IS NULL").count() == 5 * len(rows)


def test_deviations_beyond_longs():
    centre = wh.Centre(10 ** 6, [10 ** 12 * 7, 0])
    x = np.array([[7 * 10 ** 6, 1], [1 << 40, 1 << 40]])
    want = [sum((10 ** 6 * v - s) ** 2 for v, s in zip(row, centre.sums)) for row in x.tolist()]
    assert centre.deviations(x) == [want[0], None] and want[1] > 1 << 63
