import pytest
from pyspark.sql import functions as F

from companion import schemas
from companion.operators import stats as S


def tables(spark):
    reviews = spark.createDataFrame(
        [("u1", "c1", 5.0), ("u1", "c1", 4.0), ("u1", "c2", 3.0), ("u2", "b1", 2.0),
         ("u2", "x", None), ("u3", "c3", 1.0)], schemas.REVIEW)
    rel = spark.createDataFrame([("b1", "c1"), ("b1", "c2"), ("b2", "c1"), ("b3", None),
                                 ("b2", "c9")], schemas.RELATION)
    meta = spark.createDataFrame([("b1",), ("b2",), ("b3",), ("b3",)], "asin string")
    return reviews, meta, rel


def test_counts_and_sparsity(spark):
    reviews, meta, rel = tables(spark)
    r = S.dataset_counts(reviews, meta, rel).first()
    assert (r.n_ratings, r.n_users, r.n_items, r.n_bases, r.n_comps) == (6, 3, 5, 3, 3)
    assert r.sparsity == pytest.approx(1 - 6 / 15)


def test_per_user_and_per_base_companion_counts(spark):
    reviews, _, rel = tables(spark)
    per_user = {r.reviewerID: r.n_companions
                for r in S.companions_per_user(reviews, rel).collect()}
    assert per_user == {"u1": 2}                 # c1 twice counts once; c3 is nobody's
    per_base = {r.asin: r.n_companions
                for r in S.companions_per_base(reviews, rel).collect()}
    assert per_base == {"b1": 2, "b2": 1}        # c9 was never rated


def test_counts_by_category(spark):
    reviews, meta, rel = tables(spark)
    cat = F.when(F.col("asin").isin("b1", "c1"), "A").otherwise("B")
    out = {r.category: r for r in S.dataset_counts(
        reviews.withColumn("category", cat), meta.withColumn("category", cat),
        rel.withColumn("category", cat), by=["category"]).collect()}
    assert out["A"].n_ratings == 3 and out["B"].n_ratings == 3


def test_approximate_distinct_counts(spark):
    reviews = spark.range(200000).select(
        (F.col("id") % 50000).cast("string").alias("reviewerID"),
        (F.col("id") % 7000).cast("string").alias("asin"), F.lit(3.0).alias("overall"))
    meta = spark.range(10).select(F.col("id").cast("string").alias("asin"))
    rel = meta.select("asin", F.col("asin").alias("compProd"))
    r = S.dataset_counts(reviews, meta, rel, exact=False).first()
    assert r.n_users == pytest.approx(50000, rel=0.05)
    assert r.n_items == pytest.approx(7000, rel=0.05)


def test_stored_sketches_merge(spark):
    from companion.operators.stats import count_sketches, sketched_counts
    rows = spark.range(60000).selectExpr(
        "concat('u', id % 5000) AS reviewerID", "concat('p', id % 700) AS asin",
        "concat('c', id % 7) AS category")
    stored = count_sketches(rows, ["category"])
    whole = sketched_counts(stored).first()
    assert whole.n_ratings == 60000
    assert abs(whole.n_users - 5000) < 300 and abs(whole.n_items - 700) < 42
    for r in sketched_counts(stored, ["category"]).collect():
        assert abs(r.n_users - 5000) < 300 and abs(r.n_items - 100) < 6
    assert tuple(sketched_counts(count_sketches(rows.limit(0), ["category"])).first())[0] == 0


def test_companions_per_user_deals_rows_before_they_are_made_distinct(spark):
    reviews = spark.createDataFrame([("u", "c", 1.0), ("u", "c", 2.0), ("u", "d", 1.0), ("v", "x", 1.0),
                                     (None, "c", 1.0)], "reviewerID string, asin string, overall double")
    rel = spark.createDataFrame([("a", "c"), ("a", "d")], "asin string, compProd string")
    out = S.companions_per_user(reviews, rel)
    assert [tuple(r) for r in out.collect()] == [("u", 2)]
    plan = out._jdf.queryExecution().sparkPlan().toString()
    below = plan[plan.index("REPARTITION_BY_COL"):].split("BroadcastExchange")[0].split("Join")[0]
    assert "Aggregate" not in below
