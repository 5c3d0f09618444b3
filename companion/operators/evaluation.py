"""Offline evaluation of top-K lists.

Inputs are long form: recommendations ``(user, pos, item)`` with at most K
rows per user (a null ``pos`` marks an empty list), positive and negative
targets ``(user, item)``.  Membership is decided by joins on
``(user, item)``, so target sets are never gathered into one row; only the
recommendation list itself (at most K entries) becomes an array per user.
"""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from companion.functions import metrics as M
from companion.operators.ranking import top_k_per_key
from companion.session import materialize


def _flag(df: DataFrame, pos: DataFrame, neg: DataFrame, user: str,
          item: str) -> DataFrame:
    """Add ``hit`` (item is a positive target) and ``neg`` (a negative one)
    from one aggregate over both target sets and one join."""
    marks = (pos.select(user, item, F.lit(True).alias("hit"), F.lit(False).alias("neg"))
             .unionByName(neg.select(user, item, F.lit(False).alias("hit"),
                                     F.lit(True).alias("neg")))
             .groupBy(user, item).agg(F.max("hit").alias("hit"), F.max("neg").alias("neg")))
    return (df.join(marks, [user, item], "left")
            .withColumn("hit", F.coalesce(F.col("hit"), F.lit(False)))
            .withColumn("neg", F.coalesce(F.col("neg"), F.lit(False))))


def _rec_lists(rec: DataFrame, users: DataFrame, pos: DataFrame,
               neg: DataFrame, user: str, item: str) -> DataFrame:
    """``user, lst`` for the given users; lst sorted, hit/neg flags set."""
    rows = rec.join(users, user, "left_semi")
    rows = _flag(rows, pos, neg, user, item)
    return rows.groupBy(user).agg(M.ordered_list("pos", "hit", "neg").alias("lst"))


def _ideal_entries(rows: DataFrame) -> DataFrame:
    """One row per (entry, ideal class): 0 = positive, 1 = unlabelled,
    2 = negative.  An entry both positive and negative is in 0 and 2."""
    classes = F.array(
        F.when(F.col("hit"), F.lit(0)),
        F.when(~F.col("hit") & ~F.col("neg"), F.lit(1)),
        F.when(F.col("neg"), F.lit(2)))
    return rows.withColumn("cls", F.explode(classes)).where(F.col("cls").isNotNull())


def ideal_order(rec: DataFrame, pos: DataFrame, neg: DataFrame,
                user: str = "reviewerID", item: str = "compProd") -> DataFrame:
    """Long form of the ideal reordering of each non-empty list:
    ``user, ideal_pos, item, cls`` with class 0 = positive, 1 = unlabelled,
    2 = negative; within a class the list order is kept.  An item that is
    both positive and negative appears in classes 0 and 2."""
    rows = rec.where(F.col("pos").isNotNull())
    rows = _flag(rows, pos, neg, user, item)
    entries = _ideal_entries(rows)
    # lists hold at most K entries, so this window is bounded per user
    w = Window.partitionBy(user).orderBy("cls", "pos")
    return entries.select(user, F.row_number().over(w).cast("long").alias("ideal_pos"),
                          item, F.col("cls").cast("long").alias("cls"))


def target_sizes(pos: DataFrame, user: str) -> DataFrame:
    """``user, n_target``: positive target rows per user (repeats count)."""
    return pos.groupBy(user).agg(F.count(F.lit(1)).alias("n_target"))


def popularity_user_metrics(rec: DataFrame, pos: DataFrame, neg: DataFrame,
                            k: int, user: str = "reviewerID",
                            item: str = "compProd") -> DataFrame:
    """Per user with a list (possibly empty) and at least one positive:
    ``hit, precision, recall, dcg, idcg, ndcg``.  The ideal list reorders
    the recommendation itself and is not cut."""
    sizes = target_sizes(pos, user)
    users = rec.select(user).distinct().join(sizes, user)
    lists = _rec_lists(rec, users.select(user), pos, neg, user, item)
    out = users.join(lists, user).select(
        user, "n_target",
        M.hits(F.col("lst")).alias("hit"),
        M.dcg(F.col("lst")).alias("dcg"),
        M.dcg_of_flags(M.ideal_hit_flags(F.col("lst"))).alias("idcg"))
    return out.select(
        user, "hit",
        (F.col("hit") / F.lit(float(k))).alias("precision"),
        (F.col("hit") / F.col("n_target")).alias("recall"),
        "dcg", "idcg",
        M.safe_ratio(F.col("dcg"), F.col("idcg")).alias("ndcg"))


def ideal_instances(instances: DataFrame, pos: DataFrame, neg: DataFrame, k: int,
                    user: str, item: str, order: list[str]) -> DataFrame:
    """The first K entries of the ideal list over a user's scoring instances (positives,
    unlabelled, negatives, each by ``order``): ``user, ideal_pos, item, cls, hit``, via a
    group limit."""
    entries = _ideal_entries(_flag(instances, pos, neg, user, item))
    return top_k_per_key(entries, [user], [F.col("cls"), *[F.col(c) for c in order]],
                         k, pos_col="ideal_pos")


def instance_ideal_dcg(instances: DataFrame, pos: DataFrame, neg: DataFrame,
                       k: int, user: str, item: str,
                       order: list[str]) -> DataFrame:
    """``user, idcg`` where the ideal list reorders a user's scoring
    instances (positives, unlabelled, negatives, each by ``order``) and is
    cut to K.  Only the first K ideal entries are ranked, via a group limit."""
    best = ideal_instances(instances, pos, neg, k, user, item, order)
    return best.groupBy(user).agg(
        F.sum(F.when(F.col("hit"), M.discount(F.col("ideal_pos")))
              .otherwise(F.lit(0.0))).alias("idcg"))


POSITIVE, NEGATIVE, FIRST = 1, 2, 2       # bits of a role mask; list position p has bit FIRST << p


def role_masks(rec: DataFrame, pos: DataFrame, neg: DataFrame, instances: DataFrame,
               user: str, item: str) -> DataFrame:
    """What every ``(user, item)`` is, in one aggregate over all four inputs: ``roles`` (the bits
    above, by ``bit_or``), and the numbers of ``targets``, ``entries`` (scoring instances) and
    ``listed`` rows (recommendations, empty ones too)."""
    def rows(df: DataFrame, roles: F.Column, **counts: int) -> DataFrame:
        return df.select(user, item, roles.cast("long").alias("roles"), *[
            F.lit(counts.get(c, 0)).alias(c) for c in ("targets", "entries", "listed")])

    place = F.when(F.col("pos").isNotNull(), F.call_function(
        "shiftleft", F.lit(FIRST).cast("long"), F.col("pos").cast("int"))).otherwise(F.lit(0))
    every = (rows(rec, place, listed=1).unionByName(rows(pos, F.lit(POSITIVE), targets=1))
             .unionByName(rows(neg, F.lit(NEGATIVE))).unionByName(rows(instances, F.lit(0), entries=1)))
    return every.groupBy(user, item).agg(F.bit_or("roles").alias("roles"), *[
        F.sum(c).alias(c) for c in ("targets", "entries", "listed")])


def als_user_metrics(rec: DataFrame, pos: DataFrame, neg: DataFrame,
                     instances: DataFrame, k: int, user: str = "reviewerID_int",
                     item: str = "productID_int",
                     instance_order: list[str] | None = None) -> DataFrame:
    """Per user with recommendations, positives and instances:
    ``hit, precision, recall, dcg, idcg, ndcg, mrr`` (``k`` at most 60).

    Hits follow the reference's rule: walk the shorter of target list and
    recommendation (the recommendation on a tie) and count entries found in
    the other.

    All inputs meet once, in ``role_masks``; everything else is one aggregate per user over
    bits and counts.  In the ideal list (positives, unlabelled, negatives) the positives are
    the first entries, so their gain follows from their number.  Only items that are positive
    and negative at once stand in it again, at a place that depends on the order of the
    negatives: these few users' negatives are ranked, where they can reach the first ``k``."""
    order = instance_order or [item]
    masks = materialize(role_masks(rec, pos, neg, instances, user, item), "evaluation-roles")
    roles = F.col("roles")
    positive, negative = roles.bitwiseAND(POSITIVE) != 0, roles.bitwiseAND(NEGATIVE) != 0
    places = [(p, positive & (roles.bitwiseAND(FIRST << p) != 0)) for p in range(1, k + 1)]
    length = F.bit_count(F.shiftright("roles", FIRST))

    def added(pairs, none: float):
        return sum((F.when(here, F.lit(value)).otherwise(F.lit(none)) for value, here in pairs), F.lit(none))

    gain = added([(M.LN2 / log(p + 1), here) for p, here in places], 0.0)
    first = F.coalesce(*[F.when(here, F.lit(1.0 / p)) for p, here in places], F.lit(0.0))
    per_user = masks.groupBy(user).agg(
        F.sum("targets").alias("n_target"), F.sum("listed").alias("_listed"),
        F.sum("entries").alias("_entries"), F.sum(length).alias("_size"),
        F.sum(F.when(positive, length).otherwise(0)).alias("_list_hit"),
        F.sum(F.when(length > 0, F.col("targets")).otherwise(0)).alias("_target_hit"),
        F.sum(gain).alias("dcg"), F.max(first).alias("mrr"),
        F.sum(F.when(positive, F.col("entries")).otherwise(0)).alias("_good"),
        F.sum(F.when(~positive & ~negative, F.col("entries")).otherwise(0)).alias("_unlabelled"),
        F.max(positive & negative & (F.col("entries") > 0)).alias("_both"))
    per_user = materialize(per_user.where(
        (F.col("n_target") > 0) & (F.col("_listed") > 0) & (F.col("_entries") > 0)), "evaluation-users")

    before = F.col("_good") + F.col("_unlabelled")
    twice = per_user.where(F.col("_both") & (before < k)).select(user, before.alias("_before"))
    flags = masks.where(negative).select(user, item, positive.alias("_hit")).join(twice, user)
    ranked = top_k_per_key(instances.join(flags, [user, item]), [user], [F.col(c) for c in order], k, "_place")
    place = F.col("_before") + F.col("_place")
    again = ranked.where(F.col("_hit") & (place <= k)).groupBy(user).agg(
        F.sum(M.discount(place)).alias("_again"))
    ideal = sum((F.when(F.col("_good") >= p, F.lit(M.LN2 / log(p + 1))).otherwise(F.lit(0.0))
                 for p in range(1, k + 1)), F.lit(0.0)) + F.coalesce("_again", F.lit(0.0))
    hit = F.when(F.col("n_target") < F.col("_size"), F.col("_target_hit")).otherwise(
        F.col("_list_hit")).cast("long")
    out = per_user.join(again, user, "left").select(
        user, "n_target", hit.alias("hit"), "dcg", ideal.alias("idcg"), "mrr")
    return out.select(
        user, "hit",
        (F.col("hit") / F.lit(float(k))).alias("precision"),
        (F.col("hit") / F.col("n_target")).alias("recall"),
        "dcg", "idcg",
        M.safe_ratio(F.col("dcg"), F.col("idcg")).alias("ndcg"), "mrr")


def summarize(user_metrics: DataFrame, with_mrr: bool = False) -> DataFrame:
    """One row: users, zero-hit users and mean metrics, in a single pass."""
    aggs = [F.count(F.lit(1)).cast("long").alias("n_users"),
            F.count_if(F.col("hit") == 0).cast("long").alias("zero_hit"),
            F.avg("precision").alias("precision"),
            F.avg("recall").alias("recall"),
            F.avg("ndcg").alias("ndcg")]
    if with_mrr:
        aggs.append(F.avg("mrr").alias("mrr"))
    return user_metrics.agg(*aggs)
