"""Rows-only ALS outputs checked by invariants on the smallest fixture."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from companion.operators import als as A
from companion.plans import queries
from companion.plans.als import ALSConfig, ALSRun
from companion.plans.queries import inputs
from companion.session import collect_garbage, run_tables, watched_plans
from conftest import SF_TINY, shuffles, soon


@pytest.fixture(scope="module")
def run(spark):
    i = inputs(spark, SF_TINY)
    return ALSRun(i["base"], i["comp"], ALSConfig(max_iter=5)).evaluate().out


def test_split_partitions_the_encoded_ratings(run):
    split = run["split"]
    assert split.count() == run["comp_enc"].count()
    train = split.where("is_train").select("reviewerID_int", "productID_int", "compRating")
    test = split.where("not is_train").select("reviewerID_int", "productID_int", "compRating")
    assert train.intersect(test).count() == 0


def test_recommendations_come_from_instances(run):
    rec = run["recommendations"]
    per_user = rec.groupBy("reviewerID_int").count()
    assert per_user.where("count > 5").count() == 0
    assert rec.join(run["instances"], ["reviewerID_int", "productID_int"],
                    "left_anti").count() == 0


def test_negatives_unseen_and_bounded(run):
    inst, train, test = run["instances"], run["train"], run["test"]
    negs = inst.where("is_negative")
    seen = train.select("reviewerID_int", "productID_int").union(
        test.select("reviewerID_int", "productID_int"))
    assert negs.join(seen, ["reviewerID_int", "productID_int"], "left_semi").count() == 0
    n_neg = {r[0]: r[1] for r in negs.groupBy("reviewerID_int").count().collect()}
    n_test = {r[0]: r[1] for r in inst.where("not is_negative")
              .groupBy("reviewerID_int").count().collect()}
    assert all(n_neg.get(u, 0) <= n for u, n in n_test.items())


def test_summary_ranges(run):
    s = run["summary"].first()
    assert s.n_users > 0 and 0 <= s.zero_hit <= s.n_users
    for v in (s.precision, s.ndcg, s.mrr):
        assert 0.0 <= v <= 1.0
    assert s.recall >= 0.0
    m = run["user_metrics"]
    assert m.where("ndcg < 0 or ndcg > 1.000001 or precision > 1").count() == 0


@pytest.fixture(scope="module")
def factors(spark, run):
    return A.factor_tables(run["model"])


def test_user_factors_solve_their_normal_equations(run, factors):
    users, items = factors
    rows = A.normal_equations(users, items, run["train"]).collect()
    assert len(rows) == run["train"].select("reviewerID_int").distinct().count()
    assert all(r.solved for r in rows) and max(r.residual for r in rows) < 1e-5
    # the same by numpy, for every user
    u = {r.id: np.array(r.factors, dtype=float) for r in users.collect()}
    v = {r.id: np.array(r.factors, dtype=float) for r in items.collect()}
    rated = {}
    for r in run["train"].collect():
        rated.setdefault(r.reviewerID_int, []).append((v[r.productID_int], r.prodRating))
    for user, pairs in rated.items():
        x, y = np.array([p for p, _ in pairs]), np.array([q for _, q in pairs], dtype=float)
        gram = x.T @ x + A.REG_PARAM * len(y) * np.eye(A.RANK)
        assert np.allclose(u[user], np.linalg.solve(gram, x.T @ y), atol=1e-4)


def test_changed_models_do_not_solve_them(run, factors):
    users, items = factors
    bent = users.withColumn("factors", F.transform("factors", lambda x, i: F.when(
        (i == 0) & (F.col("id") % 2 == 0), x + 0.01).otherwise(x).cast("float")))
    by_user = {r.reviewerID_int: r.solved for r in A.normal_equations(bent, items, run["train"]).collect()}
    assert all(solved == (user % 2 == 1) for user, solved in by_user.items())
    other = A.normal_equations(users, items, run["train"], reg_param=0.06).collect()
    assert not any(r.solved for r in other if r.residual > 0)
    missing = run["train"].where("productID_int % 5 <> 0")
    assert A.normal_equations(users, items, missing).where("not solved").count() > 0


def test_scores_from_factor_tables_are_the_models(run, factors):
    users, items = factors
    keys = ["reviewerID_int", "productID_int"]
    asked = run["instances"].select(*keys)
    extra = asked.limit(1).select(F.lit(10 ** 6).alias(keys[0]), keys[1]).union(
        asked.limit(1).select(keys[0], F.lit(10 ** 6).alias(keys[1])))
    got = {(r[0], r[1]): r.prediction for r in A.score_factors(users, items, asked.union(extra)).collect()}
    want = {(r[0], r[1]): r.prediction for r in run["predictions"].collect()}
    assert set(got) == set(want) and len(want) > 100
    assert all(abs(got[k] - want[k]) <= 1e-6 * max(1.0, abs(want[k])) for k in want)
    repeated = A.score_factors(users, items, asked.union(asked))
    assert repeated.count() == 2 * A.score_factors(users, items, asked).count()


def small_run(spark, **settings) -> ALSRun:
    """24 users who rate 12 main items and 30 companions."""
    base = spark.range(24 * 12).selectExpr(
        "concat('u', id % 24) AS reviewerID", "concat('p', id div 24) AS productID",
        "CAST(1 + (id * 7) % 5 AS double) AS prodRating")
    comp = spark.range(24 * 30).selectExpr(
        "concat('u', id % 24) AS reviewerID", "concat('c', id div 24) AS compProd",
        "CAST(1 + (id * 3) % 5 AS double) AS compRating")
    return ALSRun(base, comp, ALSConfig(rank=4, **settings))


def test_a_fitted_run_keeps_its_outputs_only(spark):
    """Neither the tables on the way to a stage's output nor the shuffles of the training
    iterations stay on disk while the run is in use."""
    with run_tables(spark) as folder:
        before = shuffles(spark)
        run = small_run(spark).fit()

        def gone() -> bool:
            collect_garbage(spark)
            return len(shuffles(spark) - before) <= 1
        assert soon(gone)
        names = {n.rsplit("-", 1)[0] for n in os.listdir(folder.removeprefix("file:"))}
        assert names == {"als-base", "als-comp", "als-cohort", "dense-ids-productID", "dense-ids-reviewerID",
                         "als-base-enc", "als-comp-enc", "als-split", "als-instances", "als-model",
                         "als-predictions", "als-recommendations"}
        assert run.out["recommendations"].select("reviewerID_int").distinct().count() == 24
        summary = run.evaluate().out["summary"].first()
        names = {n.rsplit("-", 1)[0] for n in os.listdir(folder.removeprefix("file:"))} - names
        assert names == {"als-targets", "als-user-metrics"} and summary.n_users == run.out["user_metrics"].count()


def test_checkpoints_do_not_change_the_model(spark):
    with run_tables(spark):
        rows = [sorted(small_run(spark, checkpoint_interval=n).fit().out["predictions"].collect())
                for n in (1, 5)]
        lazy = sorted(small_run(spark, materialize=False).fit().out["predictions"].collect())
    assert rows[0] == rows[1] == lazy and len(rows[0]) > 100


def test_sums_of_normal_equations_are_not_shuffled(spark, factors, run):
    """Ratings meet by user and are summed there; only those of users with very many are summed
    in every task first, and either way gives the same."""
    def shuffled_sums(df) -> int:
        lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
        return sum("Exchange" in parent for parent, line in zip(lines, lines[1:]) if "partial_sum" in line)

    users, items = factors
    plain = A.normal_equations(users, items, run["train"])
    hot = A.normal_equations(users, items, run["train"], hot_ratings=20)
    assert shuffled_sums(plain) == 0 and shuffled_sums(hot) == 1
    found, other = ({r.reviewerID_int: r for r in df.collect()} for df in (plain, hot))
    assert min(r.n_ratings for r in found.values()) <= 20 < max(r.n_ratings for r in found.values())
    assert {u: (r.n_ratings, r.solved) for u, r in found.items()} == {
        u: (r.n_ratings, r.solved) for u, r in other.items()}


def test_scored_rows_are_written_before_they_are_compared(spark):
    """Rows that carry both factors are not on disk any more when they meet the model's scores."""
    queries.forget_runs()
    with watched_plans() as stages:
        out = queries.REGISTRY["als_factor_scores"](spark, SF_TINY)
    names = [name for name, _ in stages]
    assert names.index("als-predictions") < names.index("als-recommendations") < names.index("als-factor-scores")
    assert "factors" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.where("not equals_model").count() == 0 < out.count()
