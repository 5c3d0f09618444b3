"""User means and positive / negative targets (G5, G6, TG1, TG2, P9, P10).

Per-user means are partial aggregates joined back on the user; a user with
a third of all rows is then one aggregate row, and the join back is split by
AQE's skew handling rather than sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def user_mean(df: DataFrame, user: str, rating: str,
              out: str = "avgRating", nonzero: bool = False) -> DataFrame:
    """``user, out``: mean rating per user (nulls ignored; optionally zeros)."""
    src = df.where(F.col(rating) != 0) if nonzero else df
    return src.groupBy(user).agg(F.avg(rating).alias(out))


def label_targets(ratings: DataFrame, means: DataFrame, user: str, item: str,
                  rating: str, offset: float = 0.0,
                  mean_col: str = "avgRating") -> DataFrame:
    """``user, item, positive`` in one pass: positive if ``rating >= mean - offset``; rows with a
    null rating or mean are left out."""
    bar = F.col(mean_col) - F.lit(offset)
    return (ratings.join(means, user)
            .where(F.col(rating).isNotNull() & F.col(mean_col).isNotNull())
            .select(user, item, (F.col(rating) >= bar).alias("positive")))


def popularity_labels(comp: DataFrame) -> DataFrame:
    """``reviewerID, compProd, positive`` of the popularity evaluation, in one pass."""
    means = user_mean(comp, "reviewerID", "compRating")
    return label_targets(comp, means, "reviewerID", "compProd", "compRating")


def users_with_at_least(df: DataFrame, user: str, m: int) -> DataFrame:
    """Distinct users owning at least ``m`` rows (rows, not distinct items)."""
    return (df.groupBy(user).agg(F.count(F.lit(1)).alias("_n"))
            .where(F.col("_n") >= m).select(user))


def keep_users_with_at_least(df: DataFrame, user: str, m: int) -> DataFrame:
    """Rows of users owning at least ``m`` rows."""
    return df.join(users_with_at_least(df, user, m), user, "left_semi")
