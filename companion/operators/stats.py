"""Dataset statistics (G3, G4, G7, G8, G10, G11, ST1, ST7).

Every operator takes an optional ``by`` list (e.g. a category column) so
several datasets are described by one plan instead of one copy per dataset.
Joins between tables of a dataset then also match on ``by``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ratings_per_product(reviews: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``[by,] asin, n_ratings``: non-null ratings per item (rows without one are left out)."""
    return reviews.where(F.col("asin").isNotNull()).groupBy(*by, "asin").agg(
        F.count("overall").cast("long").alias("n_ratings"))


def ratings_per_user(reviews: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``[by,] reviewerID, n_ratings``: non-null ratings per user."""
    return (reviews.where(F.col("reviewerID").isNotNull())
            .groupBy(*by, "reviewerID")
            .agg(F.count("overall").cast("long").alias("n_ratings")))


def _comp_ids(rel: DataFrame, by: Sequence[str]) -> DataFrame:
    return (rel.where(F.col("asin").isNotNull() & F.col("compProd").isNotNull())
            .select(*by, F.col("compProd").alias("asin")).distinct())


def companions_per_user(reviews: DataFrame, rel: DataFrame,
                        by: Sequence[str] = ()) -> DataFrame:
    """``[by,] reviewerID, n_companions``: distinct rated companions per user.

    A semi join on the distinct companion ids replaces the reference's
    review x relation join, which repeats each review once per base.  Few ratings repeat a
    user's item, so rows are dealt by both before they are made distinct: a hash table per
    file split would hold nearly all of its rows."""
    rated = reviews.join(_comp_ids(rel, by), [*by, "asin"], "left_semi")
    return (rated.where(F.col("reviewerID").isNotNull())
            .select(*by, "reviewerID", "asin").repartition(*by, "reviewerID", "asin")
            .groupBy(*by, "reviewerID")
            .agg(F.countDistinct("asin").cast("long").alias("n_companions")))


def companions_per_base(reviews: DataFrame, rel: DataFrame,
                        by: Sequence[str] = ()) -> DataFrame:
    """``[by,] asin, n_companions``: distinct companions of each base that
    somebody rated."""
    rated = reviews.select(*by, F.col("asin").alias("compProd")).distinct()
    pairs = (rel.where(F.col("asin").isNotNull() & F.col("compProd").isNotNull())
             .join(rated, [*by, "compProd"], "left_semi"))
    return pairs.groupBy(*by, "asin").agg(
        F.countDistinct("compProd").cast("long").alias("n_companions"))


def dataset_counts(reviews: DataFrame, meta: DataFrame, rel: DataFrame,
                   by: Sequence[str] = (), exact: bool = True,
                   rsd: float = 0.01) -> DataFrame:
    """``[by,] n_ratings, n_users, n_items, n_bases, n_comps, sparsity``.

    Each row gives one ``(source, value)`` per identifier that is counted: two per
    review, one per metadata and relation row.  Those are counted once per distinct
    value (partial aggregates), and the values per source then.  Sparsity is
    ``1 - ratings / (items * users)``.  ``exact=False`` counts distinct values with
    HyperLogLog++ (relative error ``rsd``) in one partial aggregate."""
    by = list(by)

    def values(df: DataFrame, **sources: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(src).alias("src"), F.col(c).cast("string").alias("value"))
                          for src, c in sources.items()])
        return df.select(*by, F.explode(pairs).alias("p")).select(*by, "p.src", "p.value")

    stacked = (values(reviews, user="reviewerID", item="asin")
               .unionByName(values(meta, base="asin"))
               .unionByName(values(rel, comp="compProd")))
    names = {"user": "n_users", "item": "n_items", "base": "n_bases", "comp": "n_comps"}
    if exact:
        each = stacked.groupBy(*by, "src", "value").agg(F.count(F.lit(1)).alias("_n"))
        n_ratings = F.sum(F.when(F.col("src") == "user", F.col("_n")).otherwise(0))
        counts = [F.count_if((F.col("src") == src) & F.col("value").isNotNull()).cast("long")
                  .alias(name) for src, name in names.items()]
    else:
        each = stacked
        n_ratings = F.count_if(F.col("src") == "user")
        counts = [F.approx_count_distinct(F.when(F.col("src") == src, F.col("value")), rsd)
                  .cast("long").alias(name) for src, name in names.items()]
    out = each.groupBy(*by).agg(n_ratings.cast("long").alias("n_ratings"), *counts)
    if not by:
        out = out.withColumn("n_ratings", F.coalesce("n_ratings", F.lit(0)))
    cells = F.col("n_items").cast("double") * F.col("n_users").cast("double")
    return out.withColumn(
        "sparsity", F.when(cells > 0, F.lit(1.0) - F.col("n_ratings") / cells))


SKETCHED = {"n_users": "reviewerID", "n_items": "asin"}


def count_sketches(reviews: DataFrame, by: Sequence[str], lg_k: int = 12) -> DataFrame:
    """``by, n_ratings`` and one HyperLogLog sketch per name of ``SKETCHED`` (binary, at most
    2 ** lg_k bytes or so): a table to be stored.  One partial aggregate over the reviews."""
    return reviews.groupBy(*by).agg(
        F.count(F.lit(1)).cast("long").alias("n_ratings"),
        *[F.hll_sketch_agg(F.col(c).cast("string"), lg_k).alias(n) for n, c in SKETCHED.items()])


def sketched_counts(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of ``count_sketches`` merged up to ``by`` (none: everything), without the
    reviews.  A user of several groups counts once.  The relative standard error is about
    1.04 / sqrt(2 ** lg_k), 1.6 % for the default."""
    return sketches.groupBy(*by).agg(
        F.coalesce(F.sum("n_ratings"), F.lit(0)).cast("long").alias("n_ratings"),
        *[F.hll_sketch_estimate(F.hll_union_agg(n)).alias(n) for n in SKETCHED])
