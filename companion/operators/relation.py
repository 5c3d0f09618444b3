"""The base -> companion relation and the split of ratings by it.

List membership (``isin`` over a driver-side list in the reference) becomes a
semi / anti join against the distinct companion ids, so nothing passes
through the driver and the id set may be any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from companion.operators.reshape import as_base_ratings, as_comp_ratings


def companion_relation(meta_flat: DataFrame, list_col: str = "also_bought",
                       keep: tuple[str, ...] = ()) -> DataFrame:
    """One ``([keep...,] asin, compProd)`` row per list element.

    Items with a null or empty list keep one row with a null ``compProd``
    (``explode_outer``), as the reference's stacked join does."""
    return meta_flat.select(*keep, "asin", F.explode_outer(list_col).alias("compProd"))


def list_relations(meta_flat: DataFrame, named: tuple[str, ...] = ("also_bought",),
                   rest: str = "related_rest") -> DataFrame:
    """``list, asin, compProd``: every list of flattened open metadata, the named ones and
    those that ``rest`` holds under whatever key.  Items without a list have no row, and a
    value that is no list of texts has none either."""
    lists = F.map_from_arrays(F.array(*[F.lit(n) for n in named]), F.array(*[F.col(n) for n in named]))
    others = F.transform_values(
        F.map_filter(F.try_variant_get(F.col(rest), "$", "map<string,variant>"),
                     lambda key, _: ~key.isin(*named)),
        lambda _, value: F.try_variant_get(value, "$", "array<string>"))
    each = F.map_concat(lists, F.coalesce(others, F.create_map().cast("map<string,array<string>>")))
    return (meta_flat.select("asin", F.explode(each).alias("list", "members"))
            .select("list", "asin", F.explode("members").alias("compProd")))


def companion_ids(rel: DataFrame) -> DataFrame:
    """Distinct non-null companion ids of a relation (one column ``asin``)."""
    return (rel.where(F.col("compProd").isNotNull())
            .select(F.col("compProd").alias("asin")).distinct())


def base_ratings(reviews: DataFrame, rel: DataFrame) -> DataFrame:
    """Ratings of items that are nobody's companion.

    ``left_anti`` keeps a null ``asin`` just as ``~isin`` does."""
    return as_base_ratings(reviews.join(companion_ids(rel), "asin", "left_anti"))


def comp_ratings(reviews: DataFrame, rel: DataFrame) -> DataFrame:
    """Ratings of items that are somebody's companion."""
    return as_comp_ratings(reviews.join(companion_ids(rel), "asin", "left_semi"))


def flag_companions(reviews: DataFrame, rel: DataFrame) -> DataFrame:
    """``reviews`` plus ``is_comp``: whether the item is somebody's companion (false for a
    null item).  One join with one row per id answers both ``base_ratings`` and
    ``comp_ratings``; written partitioned by the flag, either reads its own half."""
    ids = companion_ids(rel).withColumn("_found", F.lit(True))
    return reviews.join(ids, "asin", "left").select(
        *reviews.columns, F.coalesce("_found", F.lit(False)).alias("is_comp"))


def rating_tables(flagged: DataFrame) -> dict[str, DataFrame]:
    """``base`` and ``comp`` ratings of ``flag_companions``."""
    return {"base": as_base_ratings(flagged.where(~F.col("is_comp"))),
            "comp": as_comp_ratings(flagged.where(F.col("is_comp")))}
