import numpy as np
import pytest

from companion.operators.histogram import histogram


def check(spark, values, bins, by=None):
    if by is None:
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        got = histogram(df, "v", bins).orderBy("bin").collect()
        counts, edges = np.histogram(np.asarray(values, dtype=float), bins=bins)
        assert [r.n for r in got] == counts.tolist()
        assert [r.lo for r in got] == pytest.approx(edges[:-1].tolist())
        assert [r.hi for r in got] == pytest.approx(edges[1:].tolist())


def test_matches_numpy_on_ratings(spark):
    check(spark, [1, 2, 2, 3, 4, 5, 5, 5], 10)


def test_matches_numpy_on_counts_and_awkward_widths(spark):
    rnd = np.random.default_rng(1)
    check(spark, rnd.integers(1, 97, 500).tolist(), 7)
    check(spark, rnd.integers(1, 1000, 300).tolist(), 500)
    check(spark, (rnd.random(400) * 3.3 - 1.1).tolist(), 33)


def test_single_value_range_is_widened(spark):
    check(spark, [4, 4, 4], 10)


def test_grouped_series_have_their_own_range(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 9.0), ("b", 100.0), ("b", 100.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = histogram(df, "v", 4, by=["g"]).orderBy("g", "bin").collect()
    a = [r.n for r in got if r.g == "a"]
    b = [r.n for r in got if r.g == "b"]
    assert a == np.histogram([1, 2, 9], bins=4)[0].tolist()
    assert b == np.histogram([100, 100], bins=4)[0].tolist()
    assert len(got) == 8
