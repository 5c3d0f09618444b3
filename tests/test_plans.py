"""Physical plan shape of the registered queries (read through explain)."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from companion.functions.hashing import hex_prefix, seeded_digest
from companion.operators.cohort import cohort_ratings
from companion.operators.ranking import hash_bucket, key_rank
from companion.operators.split import holdout_split
from companion.plans import queries
from companion.session import watched_plans
from conftest import SF_TINY

# the queries of this library (others are registered by an optional subpackage)
OWN = sorted(queries.REGISTRY)
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
             "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"]
GROUP_LIMITED = ["top_companions", "top_k_per_key", "user_candidates",
                 "popularity_recommend"]


def plan_of(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", OWN)
def test_no_cross_join_or_python_in_plan(spark, name):
    with watched_plans() as stages:                   # stage tables too, not the last scan only
        plan = plan_of(queries.REGISTRY[name](spark, SF_TINY))
    for text in (plan, *(text for _, text in stages)):
        assert not [f for f in FORBIDDEN if f in text]


def test_stage_plans_are_seen(spark):
    queries.forget_runs()
    with watched_plans() as stages:
        queries.REGISTRY["holdout_split"](spark, SF_TINY)
    names = [name for name, _ in stages]
    assert {"als-cohort", "als-comp-enc", "als-split"} <= set(names)
    assert "HashAggregate" in dict(stages)["first-cuts"]


def test_split_sorts_no_ratings(spark):
    """The cut of a user is counted digit by digit: no window over rating rows anywhere."""
    rows = spark.range(5000).select(
        (F.col("id") % 7).cast("int").alias("reviewerID_int"),
        F.col("id").cast("int").alias("productID_int"), F.lit(3.0).alias("compRating"))
    with watched_plans() as stages:
        plan = plan_of(holdout_split(rows, "reviewerID_int", "productID_int", "compRating", group_rows=8))
    assert len([n for n, _ in stages if n == "first-cuts"]) > 1
    assert not [n for n, text in stages if "Window" in text] and "Window" not in plan


@pytest.mark.parametrize("name", GROUP_LIMITED)
def test_top_k_windows_are_group_limited(spark, name):
    plan = plan_of(queries.REGISTRY[name](spark, SF_TINY))
    # a partial limit runs in the map tasks, before the shuffle
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_fixture_scans_prune_and_push_down(spark):
    from companion.sources import fixtures as FX
    plan = plan_of(FX.relation_pairs(spark, SF_TINY))
    assert "LessThanOrEqual(p_size,25)" in plan
    assert "GreaterThanOrEqual(p_size,48)" in plan
    assert "ReadSchema: struct<p_partkey:bigint,p_size:int>" in plan


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def dealt_by(df) -> list[list[str]]:
    """Keys of every hash exchange in the plan (without attribute numbers)."""
    found = re.findall(r"hashpartitioning\(([^)]*)\)", plan_of(df))
    return [[re.sub(r"#.*", "", k).strip() for k in f.split(",")[:-1]] for f in found]


RATED = "reviewerID_int int, productID_int int, compRating double"


def test_ranks_deal_a_user_over_many_tasks(spark, no_broadcast):
    rows = spark.createDataFrame([(1, 1, 1.0)], RATED)
    # the only exchange by the user alone is that of the small count table's window
    ranked = key_rank(
        rows.withColumn("_h", seeded_digest(1, "reviewerID_int")).withColumn(
            "_b", hash_bucket(hex_prefix(F.col("_h")), 100, 16)),
        ["reviewerID_int"], "_b", [F.col("_h")], "r")
    text = plan_of(ranked)
    by_user = re.findall(r"hashpartitioning\(reviewerID_int#\d+, \d+\)", text)
    assert ["reviewerID_int", "_b"] in dealt_by(ranked) and len(by_user) <= 1


def test_cohort_deduplicates_before_it_meets_users(spark, no_broadcast):
    base = spark.createDataFrame([("u", "p", 1.0)], "reviewerID string, productID string, prodRating double")
    comp = spark.createDataFrame([("u", "c", 1.0)] * 2, "reviewerID string, compProd string, compRating double")
    out = cohort_ratings(base, comp)
    assert ["reviewerID", "productID", "prodRating"] in dealt_by(out["main"])
    assert ["reviewerID", "compProd", "compRating"] in dealt_by(out["comp"])


def test_preprocessing_reads_reviews_once(spark, tmp_path):
    """One scan and one join with the companion ids give both rating files."""
    from companion.plans.preprocess import preprocess_files
    with open(tmp_path / "reviews.json", "w", encoding="utf-8") as f:
        f.write("".join(f"{{'reviewerID': 'u{i}', 'asin': 'p{i % 5}', 'overall': {i % 4}.0}}\n" for i in range(40)))
    with open(tmp_path / "meta.json", "w", encoding="utf-8") as f:
        f.write("{'asin': 'p0', 'related': {'also_bought': ['p1', 'p2']}}\n{'asin': 'p3'}\n")
    with watched_plans() as stages:
        paths = preprocess_files(spark, f"file://{tmp_path}/reviews.json", f"file://{tmp_path}/meta.json",
                                 f"file://{tmp_path}/out")
    names = [n for n, _ in stages]
    assert names.count("preprocess-reviews") == 1
    text = dict(stages)["preprocess-reviews"]
    assert text.count("FileScan text") == 1 and text.count("Join") == 1
    base, comp = (spark.read.option("header", True).csv(paths[n]) for n in ("base", "comp"))
    assert base.columns == ["reviewerID", "productID", "prodRating"]
    assert {r.productID for r in base.collect()} == {"p0", "p3", "p4"} and base.count() == 24
    assert {r.compProd for r in comp.collect()} == {"p1", "p2"} and comp.count() == 16


def test_hot_user_rows_are_spread(spark, no_broadcast):
    """A third of all rows in one user: the tasks of the ranking window hold few of them."""
    rows = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500 + 1).cast("int").alias("u"),
        F.col("id").alias("v")).withColumn("_h", seeded_digest(2, "u", "v"))
    rows = rows.withColumn("_b", hash_bucket(hex_prefix(F.col("_h")), 30000, 1000))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = (rows.repartition("u", "_b").where("u = 0").groupBy(F.spark_partition_id().alias("p"))
                 .count().collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(r["count"] for r in sizes) < 10000 / 2


def test_distinct_ratings_are_dealt_into_bounded_partitions(spark, no_broadcast, monkeypatch):
    """As many tasks as the rows ask for, not as their bytes do; -0.0 and 0.0 are one rating."""
    from companion.operators import cohort
    monkeypatch.setattr(cohort, "DISTINCT_ROWS", 10, raising=False)
    base = spark.createDataFrame(
        [("u", f"p{i % 150}", float(i % 150 % 5)) for i in range(300)] + [("u", "p0", -0.0), (None, "p", 1.0)],
        "reviewerID string, productID string, prodRating double")
    comp = spark.createDataFrame([("u", f"c{i % 200}", 1.0) for i in range(400)] + [("u", "c0", None)] * 2,
                                 "reviewerID string, compProd string, compRating double")
    out = cohort.cohort_ratings(base, comp)
    assert out["main"].count() == 150 and out["comp"].count() == 201
    enc = cohort.encode_comp(comp, cohort.user_index(base), cohort.item_index(out["all"]))
    assert enc.count() == 201
    for df, n in ((out["main"], 31), (out["comp"], 41), (enc, 41)):
        assert f", {n}), REPARTITION_BY_NUM" in plan_of(df)


def test_rating_tables_are_halves_of_one_written_table(spark, monkeypatch):
    """Base and companion ratings read ``flagged``; neither they nor the reviews are written for it."""
    monkeypatch.setattr(queries, "_PREPARED", {})
    halves = [queries.prepared(spark, SF_TINY, n) for n in ("base", "comp")]
    assert {key[-1] for key in queries._PREPARED} == {"relation", "flagged"}
    assert halves[0].columns == ["reviewerID", "productID", "prodRating"]
    assert sum(h.count() for h in halves) == queries.prepared(spark, SF_TINY, "reviews").count()
