import math
import random

import pytest

from companion.operators import evaluation as E

LN2 = math.log(2)


def d(pos):
    return LN2 / math.log(pos + 1)


def metrics(spark, rec, pos, neg, k=5):
    rec_df = spark.createDataFrame(rec, "reviewerID string, pos int, compProd string")
    pos_df = spark.createDataFrame(pos, "reviewerID string, compProd string")
    neg_df = spark.createDataFrame(neg, "reviewerID string, compProd string")
    out = E.popularity_user_metrics(rec_df, pos_df, neg_df, k)
    return {r.reviewerID: r for r in out.collect()}


def test_dcg_idcg_with_negatives(spark):
    # list: n (neg), x (unlabelled), p (pos), q (pos)
    rec = [("u", 1, "n"), ("u", 2, "x"), ("u", 3, "p"), ("u", 4, "q")]
    m = metrics(spark, rec, [("u", "p"), ("u", "q"), ("u", "z")], [("u", "n")])["u"]
    assert m.hit == 2
    assert m.precision == pytest.approx(2 / 5)
    assert m.recall == pytest.approx(2 / 3)
    assert m.dcg == pytest.approx(d(3) + d(4))
    # ideal: p, q, x, n
    assert m.idcg == pytest.approx(d(1) + d(2))
    assert m.ndcg == pytest.approx((d(3) + d(4)) / (d(1) + d(2)))


def test_no_negative_list_and_repeats(spark):
    # repeats in the list count as hits (recall may exceed 1)
    rec = [("u", 1, "a"), ("u", 2, "a"), ("u", 3, "b")]
    m = metrics(spark, rec, [("u", "a")], [])["u"]
    assert m.hit == 2 and m.recall == pytest.approx(2.0)
    assert m.dcg == pytest.approx(d(1) + d(2))
    assert m.idcg == pytest.approx(d(1) + d(2))


def test_item_both_positive_and_negative_appears_twice_in_ideal(spark):
    rec = [("u", 1, "x"), ("u", 2, "a")]
    m = metrics(spark, rec, [("u", "a")], [("u", "a")])["u"]
    # ideal flags: [a(pos)] + [x] + [a(neg, still a hit)] -> hits at 1 and 3
    assert m.idcg == pytest.approx(d(1) + d(3))


def test_empty_list_counts_as_zero(spark):
    rec = [("u", None, None)]
    m = metrics(spark, rec, [("u", "a")], [])["u"]
    assert (m.hit, m.precision, m.recall, m.dcg, m.idcg, m.ndcg) == (0, 0.0, 0.0, 0.0, 0.0, 0.0)


def test_users_without_positives_are_not_scored(spark):
    out = metrics(spark, [("u", 1, "a")], [("v", "a")], [])
    assert out == {}


def test_als_metrics_ideal_from_instances_cut_to_k(spark):
    rec = spark.createDataFrame([(1, 1, 10), (1, 2, 11)],
                                "reviewerID_int int, pos int, productID_int int")
    pos = spark.createDataFrame([(1, 11), (1, 12), (1, 13)], "reviewerID_int int, productID_int int")
    neg = spark.createDataFrame([(1, 14)], "reviewerID_int int, productID_int int")
    inst = spark.createDataFrame(
        [(1, i, 0) for i in (10, 11, 12, 13, 14)],
        "reviewerID_int int, productID_int int, _kind int")
    m = E.als_user_metrics(rec, pos, neg, inst, 2, instance_order=["_kind", "productID_int"]).first()
    assert m.hit == 1
    assert m.precision == pytest.approx(0.5)
    assert m.recall == pytest.approx(1 / 3)
    assert m.dcg == pytest.approx(d(2))
    assert m.idcg == pytest.approx(d(1) + d(2))     # ideal cut to k=2: 11, 12
    assert m.mrr == pytest.approx(0.5)


def test_als_hit_walks_shorter_target_list(spark):
    # two targets, three recommendations: hits counted over target rows
    rec = spark.createDataFrame([(1, 1, 5), (1, 2, 5), (1, 3, 6)],
                                "reviewerID_int int, pos int, productID_int int")
    pos = spark.createDataFrame([(1, 5), (1, 7)], "reviewerID_int int, productID_int int")
    neg = spark.createDataFrame([], "reviewerID_int int, productID_int int")
    inst = spark.createDataFrame([(1, 5, 0), (1, 6, 0), (1, 7, 0)],
                                 "reviewerID_int int, productID_int int, _kind int")
    m = E.als_user_metrics(rec, pos, neg, inst, 3).first()
    assert m.hit == 1      # the list has 5 twice, but the target list has it once


def plain_als_metrics(rec, pos, neg, inst, k):
    """Lists walked one by one, as the definitions read."""
    out = {}
    for user in {u for u, *_ in rec}:
        items = [i for _, i in sorted((p, i) for u, p, i in rec if u == user and p is not None)]
        targets = [i for u, i in pos if u == user]
        bad = {i for u, i in neg if u == user}
        mine = [i for _, i in sorted((kind, i) for u, i, kind in inst if u == user)]
        if not targets or not mine:
            continue
        good = set(targets)
        hit = (sum(i in set(items) for i in targets) if len(targets) < len(items)
               else sum(i in good for i in items))
        ideal = ([i for i in mine if i in good] + [i for i in mine if i not in good | bad]
                 + [i for i in mine if i in bad])[:k]
        dcg = sum(d(p) for p, i in enumerate(items, 1) if i in good)
        idcg = sum(d(p) for p, i in enumerate(ideal, 1) if i in good)
        mrr = max((1 / p for p, i in enumerate(items, 1) if i in good), default=0.0)
        out[user] = (hit, hit / k, hit / len(targets), dcg, idcg, dcg / idcg if idcg else 0.0, mrr)
    return out


def test_als_metrics_against_walked_lists(spark):
    rng = random.Random(4)
    for k in (2, 5):
        rec, pos, neg, inst = [], [], [], []
        for user in range(150):
            pool = range(rng.choice([4, 6, 12]))
            inst += [(user, i, kind) for kind, n in ((0, 5), (1, 3)) for i in rng.choices(pool, k=rng.randint(0, n))]
            pos += [(user, i) for i in rng.choices(pool, k=rng.randint(0, 4))]
            neg += [(user, i) for i in rng.choices(pool, k=rng.randint(0, 4))]
            listed = rng.choices(pool, k=rng.randint(0, k))
            rec += [(user, p, i) for p, i in enumerate(listed, 1)] or [(user, None, None)]
        ids = "reviewerID_int int, productID_int int"
        got = E.als_user_metrics(
            spark.createDataFrame(rec, "reviewerID_int int, pos int, productID_int int"),
            spark.createDataFrame(pos, ids), spark.createDataFrame(neg, ids),
            spark.createDataFrame(inst, ids + ", _kind int"), k, instance_order=["_kind", "productID_int"]).collect()
        want = plain_als_metrics(rec, pos, neg, inst, k)
        assert {r.reviewerID_int for r in got} == set(want)
        for r in got:
            assert tuple(r)[1:] == pytest.approx(want[r.reviewerID_int])


def test_summary_is_one_pass(spark):
    df = spark.createDataFrame([("a", 0, 0.0, 0.0, 0.0), ("b", 2, 0.4, 1.0, 0.5)],
                               "u string, hit long, precision double, recall double, ndcg double")
    s = E.summarize(df).first()
    assert (s.n_users, s.zero_hit) == (2, 1)
    assert s.precision == pytest.approx(0.2)
