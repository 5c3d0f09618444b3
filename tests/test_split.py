import math

from pyspark.sql import functions as F

from companion.operators.split import holdout_split, training_set
from companion.session import watched_plans


def ratings(spark):
    rows = [(1, i, float(1 + i % 5)) for i in range(23)] + [(2, 100, 4.0)] + \
           [(3, i, 3.0) for i in range(5)] + [(3, 0, 3.0)]          # duplicate row
    return spark.createDataFrame(rows, "reviewerID_int int, productID_int int, compRating double")


def test_split_sizes_and_disjointness(spark):
    s = holdout_split(ratings(spark), "reviewerID_int", "productID_int", "compRating")
    rows = s.collect()
    per = {}
    for r in rows:
        per.setdefault(r.reviewerID_int, []).append(r.is_train)
    for u, flags in per.items():
        assert sum(flags) == math.floor(0.8 * len(flags))
    assert per[2] == [False]                     # one row: test only
    assert len(per[3]) == 5                      # distinct rows
    keys = [(r.reviewerID_int, r.productID_int, r.compRating) for r in rows]
    assert len(keys) == len(set(keys))


def test_split_is_deterministic_and_group_size_free(spark):
    df = ratings(spark)
    a = holdout_split(df, "reviewerID_int", "productID_int", "compRating", seed=9)
    b = holdout_split(df, "reviewerID_int", "productID_int", "compRating", seed=9,
                      group_rows=2)
    c = holdout_split(df, "reviewerID_int", "productID_int", "compRating", seed=10)
    sa, sb, sc = (sorted(tuple(r) for r in x.collect()) for x in (a, b, c))
    assert sa == sb
    assert sa != sc


def test_training_set(spark):
    split = holdout_split(ratings(spark), "reviewerID_int", "productID_int", "compRating")
    base = spark.createDataFrame([(1, 50, 4.0), (1, 50, 4.0), (9, 51, None)],
                                 "reviewerID_int int, productID_int int, prodRating double")
    train, test = training_set(base, split)
    assert train.where("productID_int = 50").count() == 2          # base duplicates kept
    assert train.where("productID_int = 51").first().prodRating == 0  # missing -> 0
    assert dict(train.dtypes)["prodRating"] == "int"
    t = {(r.reviewerID_int, r.productID_int) for r in test.collect()}
    tr = {(r.reviewerID_int, r.productID_int) for r in train.where(F.col("productID_int") < 50).collect()}
    assert not (t & tr)


def test_rows_of_equal_digest_and_extreme_parts(spark):
    """A null item or rating leaves no trace in the digest: such rows tie and follow their
    values.  All or none of the rows may be training rows; an empty table stays empty."""
    rows = spark.createDataFrame([(1, 7, None), (1, None, 7.0), (1, 8, 2.0), (None, 1, 1.0), (2, 5, 1.0)],
                                 "reviewerID_int int, productID_int int, compRating double")
    for frac, counts in ((0.0, {1: 0, 2: 0}), (0.34, {1: 1, 2: 0}), (0.67, {1: 2, 2: 0}), (1.0, {1: 3, 2: 1})):
        for group_rows in (1, 100):
            got = holdout_split(rows, "reviewerID_int", "productID_int", "compRating", frac=frac,
                                group_rows=group_rows).collect()
            assert len(got) == 4
            train = {}
            for r in got:
                train[r.reviewerID_int] = train.get(r.reviewerID_int, 0) + r.is_train
            assert train == counts
    assert holdout_split(rows.limit(0), "reviewerID_int", "productID_int", "compRating").count() == 0


def test_digests_are_not_written(spark):
    """A digest takes several times a row's bytes: every level computes it anew."""
    with watched_plans() as stages:
        holdout_split(ratings(spark), "reviewerID_int", "productID_int", "compRating", group_rows=2).count()
    written = dict(stages)
    assert "md5" not in written["first-rows"] and "md5" in written["first-cuts"]
    assert len([n for n, _ in stages if n == "first-placed"]) > 1
