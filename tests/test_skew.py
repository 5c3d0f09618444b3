"""One user holds a third of all rows: results stay exact when the user is
split into many sub-groups."""

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from companion.functions.hashing import seeded_digest
from companion.operators.negatives import scoring_instances
from companion.operators.split import holdout_split

SCHEMA = "reviewerID_int int, productID_int int, compRating double"


def skewed(spark, n_other_users=60, per_user=10):
    others = [(u, i, float(1 + (u + i) % 5)) for u in range(1, n_other_users + 1)
              for i in range(per_user)]
    hot = [(0, i, float(1 + i % 5)) for i in range(len(others) // 2)]   # 1/3 of rows
    return spark.createDataFrame(hot + others, SCHEMA)


@pytest.mark.parametrize("group_rows", [1, 16, 1 << 17])
def test_hot_user_split_equals_single_window(spark, group_rows):
    df = skewed(spark, 60 if group_rows > 1 else 400)
    got = holdout_split(df, "reviewerID_int", "productID_int", "compRating",
                        seed=5, group_rows=group_rows)
    rows = (df.select("reviewerID_int", "productID_int",
                      F.col("compRating").cast("int").alias("compRating")).distinct()
            .withColumn("_h", seeded_digest(5, "reviewerID_int", "productID_int", "compRating")))
    w = Window.partitionBy("reviewerID_int")
    want = rows.select(
        "reviewerID_int", "productID_int", "compRating",
        ((F.row_number().over(w.orderBy("_h", "productID_int", "compRating")) - 1)
         < F.floor(F.lit(0.8) * F.count(F.lit(1)).over(w))).alias("is_train"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    hot = got.where("reviewerID_int = 0")
    assert hot.where("is_train").count() == math.floor(0.8 * hot.count())


def test_hot_user_negatives_exact_count(spark):
    df = skewed(spark)
    split = holdout_split(df, "reviewerID_int", "productID_int", "compRating",
                          seed=5, group_rows=16)
    cols = ["reviewerID_int", "productID_int", F.col("compRating").alias("prodRating")]
    train = split.where("is_train").select(*cols)
    test = split.where("not is_train").select(*cols)
    pool = spark.range(0, 2000).select(F.col("id").cast("int").alias("productID_int"))
    inst = scoring_instances(test, train, pool, group_rows=16)
    negs = inst.where("is_negative")
    n_test = test.where("reviewerID_int = 0").count()
    hot_negs = negs.where("reviewerID_int = 0")
    assert hot_negs.count() == n_test == hot_negs.select("productID_int").distinct().count()
    seen = train.union(test).select("reviewerID_int", "productID_int")
    assert negs.join(seen, ["reviewerID_int", "productID_int"], "left_semi").count() == 0
