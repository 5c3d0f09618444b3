import pytest
from pyspark.sql import functions as F

from companion.operators import negatives
from companion.operators.negatives import scoring_instances
from companion.session import watched_plans

SCHEMA = "reviewerID_int int, productID_int int, prodRating int"


def run(spark, test, train, pool, group_rows=1 << 17, seed=42):
    t = spark.createDataFrame(test, SCHEMA)
    tr = spark.createDataFrame(train, SCHEMA)
    p = spark.createDataFrame([(i,) for i in pool], "productID_int int")
    out = scoring_instances(t, tr, p, seed=seed, group_rows=group_rows)
    return sorted(tuple(r) for r in out.collect())


def test_negatives_are_unseen_distinct_and_as_many_as_tests(spark):
    pool = list(range(100, 160))
    test = [(1, 100, 4), (1, 101, 2), (1, 101, 5), (2, 102, 3)]
    train = [(1, 103, 4), (2, 104, 1), (2, 5, 3), (3, 106, 2)]
    rows = run(spark, test, train, pool)
    for u, n_test in ((1, 3), (2, 1)):
        negs = [i for (uu, i, neg) in rows if uu == u and neg]
        seen = {i for (uu, i, _) in test + train if uu == u}
        assert len(negs) == n_test == len(set(negs))
        assert not set(negs) & seen and set(negs) <= set(pool)
    # test rows are kept with their repeats; user 3 has no test rows
    assert [r for r in rows if not r[2]] == [(1, 100, False), (1, 101, False),
                                            (1, 101, False), (2, 102, False)]
    assert not [r for r in rows if r[0] == 3]


def test_user_without_training_rows_is_dropped(spark):
    rows = run(spark, [(7, 100, 3)], [(8, 101, 3)], range(100, 110))
    assert rows == []


def test_exhausted_pool_is_bounded(spark):
    pool = list(range(10))
    train = [(1, i, 3) for i in range(8)]                 # seen 8 of 10
    test = [(1, 8, 3), (1, 9, 3), (1, 9, 4)]              # and the other 2
    rows = run(spark, test, train, pool)
    assert [r for r in rows if r[2]] == []                # nothing left to draw


def test_shortfall_completed_exactly(spark):
    pool = list(range(40))
    train = [(1, i, 3) for i in range(30)]                # 10 unseen left
    test = [(1, 30, 3)] + [(1, 31, s) for s in range(1, 6)] + [(1, 32, 1)] * 1
    rows = run(spark, test, train, pool)
    negs = [i for (_, i, neg) in rows if neg]
    unseen = set(range(33, 40))                           # 7 unseen, 7 test rows
    assert sorted(negs) == sorted(unseen)


def test_same_seed_same_draws_independent_of_group_size(spark):
    pool = list(range(200, 260))
    test = [(u, 200 + u, 3) for u in range(5)] * 3
    train = [(u, 230 + u, 3) for u in range(5)]
    a = run(spark, test, train, pool)
    b = run(spark, test, train, pool, group_rows=2)
    c = run(spark, test, train, pool, seed=7)
    assert a == b
    assert a != c


def test_pools_of_any_exhaustion_in_one_pass(spark):
    """Users who have seen nothing to everything of a large pool: exact counts."""
    pool = list(range(3000))
    n_seen = {1: 2000, 2: 2900, 3: 2990, 4: 2999, 5: 3000, 6: 10}
    train = [(u, i, 3) for u, n in n_seen.items() for i in range(n)]
    test = [(u, i, 1) for u in n_seen for i in range(40)]
    rows = run(spark, test, train, pool)
    assert rows == run(spark, test, train, pool, group_rows=64)
    for u, n in n_seen.items():
        negs = [i for uu, i, neg in rows if uu == u and neg]
        assert len(negs) == len(set(negs)) == min(40, 3000 - max(n, 40))
        assert all(n <= i < 3000 for i in negs)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 12, 13, 97, 100, 1009, 4096])
def test_draws_are_a_permutation_of_the_pool(spark, n):
    a, b = negatives.sides(n)
    rows = spark.range(a * b).crossJoin(spark.range(3).withColumnRenamed("id", "u")).select(
        "u", "id", negatives.permuted(F.col("id"), "u", a, b, 7).alias("image")).collect()
    for u in range(3):
        images = [r.image for r in sorted(rows, key=lambda r: r.id) if r.u == u]
        assert sorted(images) == list(range(a * b)) and sum(i < n for i in images) == n
        if n >= 97:                                       # no order of its own, and keyed
            assert images != sorted(images)
            assert images != [r.image for r in sorted(rows, key=lambda r: r.id) if r.u == (u + 1) % 3]


def test_sides_waste_little():
    waste = []
    for n in [*range(1, 3000), 10 ** 6 + 3, 999_983, 10 ** 8 + 7, 2 ** 31 - 1]:
        a, b = negatives.sides(n)
        assert a * b >= n > a * (b - 1) and (n <= 3 or min(a, b) > 1)
        waste.append(a * b - n)
    assert max(waste) <= 8 and sum(waste) / len(waste) < 2


def test_draws_are_spread_over_the_pool(spark):
    """First draws of many users hit every item about equally often."""
    a, b = negatives.sides(60)
    counts = spark.range(6000).select(F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"), F.col("id").alias(
        "u")).select(negatives.permuted(F.col("k"), "u", a, b, 42).alias("i")).groupBy("i").count().collect()
    assert len(counts) == a * b
    assert all(220 <= r["count"] <= 380 for r in counts)    # 300 on average


def test_no_loop_and_few_exchanges(spark):
    """Rows go through one exchange per join: stage plans hold no repeated rounds."""
    with watched_plans() as stages:
        test = spark.createDataFrame([(1, 1, 3), (2, 2, 3)], SCHEMA)
        out = scoring_instances(test, test, test.select("productID_int"))
    names = [name for name, _ in stages]
    assert sorted(names) == sorted(["dense-ids-productID_int", "negatives-train-users", "negatives-tests",
                                    "negatives-seen", "negatives-need"])
    assert out.count() == 4


def test_few_draws_where_few_items_are_seen(spark, monkeypatch):
    """Users who have seen much of their own but little of the pool make about as many draws as
    they have tests, and those for whom that is too few get the same items in a second round."""
    written = {}

    def kept(df, name):
        out = materialize(df, name)
        written.setdefault(name, []).append(out)
        return out

    materialize = negatives.materialize
    monkeypatch.setattr(negatives, "materialize", kept)
    pool = list(range(3000))
    train = [(u, (u * 31 + 7 * i) % 3000, 3) for u in range(20) for i in range(200)]
    test = [(u, (u * 31 + 7 * (200 + i)) % 3000, 3) for u in range(20) for i in range(10)]
    got = run(spark, test, train, pool)
    assert len(got) == 2 * len(test)
    assert sum(d.count() for d in written["negatives-draws"]) < 20 * 30      # 20 * 220 at once
    assert len(written["negatives-draws"]) == 1
    monkeypatch.setattr(negatives, "likely_draws", lambda *_: F.lit(3))
    assert run(spark, test, train, pool) == got
    assert len(written["negatives-draws"]) == 3
