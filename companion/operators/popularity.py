"""Popularity recommender.

A companion's popularity is its number of ratings; each base product keeps
its K most popular companions; a user who rated ``m`` listed bases receives,
from each of them, the first ``floor(K / m)`` companions (``K`` when
``m == 1``), concatenated in base order.  A user with more than K listed
base ratings therefore gets an empty list, which still counts.

Everything is long form ``(user, pos, item)``: after the per-user quota the
list holds at most K rows, so the final numbering window is bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from companion.operators.ranking import top_k_per_key


def companion_popularity(comp: DataFrame) -> DataFrame:
    """``compProd, score``: ratings per companion (complete rows only)."""
    return (comp.na.drop().groupBy("compProd")
            .agg(F.count("reviewerID").cast("long").alias("score")))


def companion_scores(rel: DataFrame, comp: DataFrame) -> DataFrame:
    """Every complete relation row with its companion's score (0 if unrated)."""
    return (rel.na.drop().join(companion_popularity(comp), "compProd", "left")
            .select("asin", "compProd",
                    F.coalesce("score", F.lit(0)).cast("long").alias("score")))


def top_companions(scores: DataFrame, k: int) -> DataFrame:
    """``asin, comp_pos, compProd, score``: K best companions per base,
    by score then companion id."""
    return top_k_per_key(scores, ["asin"],
                         [F.col("score").desc(), F.col("compProd")], k,
                         pos_col="comp_pos")


def user_candidates(base: DataFrame, top: DataFrame) -> DataFrame:
    """Each complete base rating joined with its base's top list."""
    return (base.na.drop().join(top, F.col("productID") == F.col("asin"))
            .select("reviewerID", "productID", "prodRating", "comp_pos",
                    "compProd"))


def recommend_from_top(base: DataFrame, top: DataFrame, k: int) -> DataFrame:
    """``reviewerID, pos, compProd``; users with an empty list keep one row
    with null ``pos`` and ``compProd``."""
    listed = top.select("asin").distinct()
    rated = base.na.drop().join(
        listed, F.col("productID") == F.col("asin"), "left_semi")
    # identical base rows each contribute their own copy of the list
    copies = rated.groupBy("reviewerID", "productID", "prodRating").agg(
        F.count(F.lit(1)).alias("copies"))
    users = copies.groupBy("reviewerID").agg(F.sum("copies").alias("m"))
    users = users.withColumn(
        "quota", F.when(F.col("m") > 1, F.floor(F.lit(k) / F.col("m")))
        .otherwise(F.lit(k)).cast("long"))
    # quota >= 1 implies m <= k, so at most k copies are expanded per user
    served = users.where(F.col("quota") >= 1)
    picked = (copies.join(served, "reviewerID")
              .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
              .join(top, F.col("productID") == F.col("asin"))
              .where(F.col("comp_pos") <= F.col("quota")))
    numbered = top_k_per_key(
        picked, ["reviewerID"],
        [F.col("productID"), F.col("prodRating"), F.col("copy"), F.col("comp_pos")],
        k, pos_col="pos").select("reviewerID", "pos", "compProd")
    return users.select("reviewerID").join(numbered, "reviewerID", "left")


def popularity_recommend(base: DataFrame, rel: DataFrame, comp: DataFrame,
                         k: int, keep_top=None) -> DataFrame:
    """Top-K companion list per user by popularity (long form).

    ``keep_top`` may store the per-base top list (read twice) once."""
    top = top_companions(companion_scores(rel, comp), k)
    if keep_top is not None:
        top = keep_top(top)
    return recommend_from_top(base, top, k)
