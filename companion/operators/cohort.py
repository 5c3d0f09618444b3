"""Cohort selection and integer encoding for factorisation.

The reference joins base and companion ratings on the user (every base row
times every companion row of that user) and then takes two distinct
projections.  Two semi joins give the same rows without the product.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from companion.operators.ranking import dense_index
from companion.operators.targets import users_with_at_least
from companion.session import materialize

# rows of a task that makes rows distinct: its hash table holds nearly all of them
DISTINCT_ROWS = 1 << 18


def distinct_rows(df: DataFrame, n_rows: int) -> DataFrame:
    """Distinct rows of ``df``, which has about ``n_rows``, dealt by all columns into partitions
    of ``DISTINCT_ROWS`` (as many as Spark's own at least), whose number Spark does not reduce:
    few rows are repeated, so larger partitions would spill their hash tables."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-n_rows // DISTINCT_ROWS)), *df.columns).dropDuplicates()


def cohort_ratings(base: DataFrame, comp: DataFrame,
                   min_comp: int = 2) -> dict[str, DataFrame]:
    """Users with at least ``min_comp`` companion rows and one base row.

    Returns distinct base rows (``main``), distinct companion rows
    (``comp``) and their union ``all`` as ``reviewerID, productID,
    prodRating``."""
    # rows are deduplicated before they meet the user tables, and those are written
    # first: a user with very many rows is never aggregated or joined in one task
    active_users = materialize(users_with_at_least(comp, "reviewerID", min_comp),
                               "cohort-active-users")
    base_users = base.select("reviewerID").distinct()
    users = materialize(active_users.join(base_users, "reviewerID", "left_semi"), "cohort-users")
    # users are distinct; Spark would move a semi join below the distinct rows
    main = (distinct_rows(base.select("reviewerID", "productID", "prodRating"), base.count())
            .join(users, "reviewerID"))
    comp_rows = (distinct_rows(comp.select("reviewerID", "compProd", "compRating"), comp.count())
                 .join(users, "reviewerID"))
    every = main.unionByName(comp_rows.select(
        "reviewerID", F.col("compProd").alias("productID"),
        F.col("compRating").alias("prodRating")))
    return {"main": main, "comp": comp_rows, "all": every}


def item_index(cohort_all: DataFrame) -> DataFrame:
    """``productID, productID_int``: dense ids of the cohort's items."""
    return dense_index(cohort_all, "productID", "productID_int")


def user_index(base: DataFrame) -> DataFrame:
    """``reviewerID, reviewerID_int``: dense ids of every base-rating user
    (not only the cohort's, as in the reference)."""
    return dense_index(base, "reviewerID", "reviewerID_int")


def encode_base(base: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Base ratings with integer ids; rows outside the cohort's item set
    drop out, duplicates stay."""
    return (base.join(users, "reviewerID").join(items, "productID")
            .select("reviewerID_int", "productID_int", "prodRating"))


def encode_comp(comp: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct companion ratings with integer ids."""
    encoded = (comp.join(users, "reviewerID")
               .join(items, F.col("compProd") == F.col("productID"))
               .select("reviewerID_int", "productID_int", "compRating"))
    return distinct_rows(encoded, comp.count())
