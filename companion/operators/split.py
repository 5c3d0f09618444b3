"""Per-user hold-out split and the training set.

Each user's rows are put in a seeded pseudo-random order (md5 of the seed
and the row's key), and the first ``floor(frac * n)`` rows are training
rows, the rest test rows.  The order is a pure function of the data, so a
recomputed partition splits identically and train and test never overlap; the
cut inside a user is exact and found by counting, not sorting (``first_by_digest``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from companion.functions.hashing import seeded_digest
from companion.operators.ranking import DEFAULT_GROUP_ROWS, LIST_ROWS, first_by_digest
from companion.operators.reshape import rating_as_int


def holdout_split(df: DataFrame, user: str, item: str, rating: str,
                  frac: float = 0.8, seed: int = 42,
                  group_rows: int = DEFAULT_GROUP_ROWS) -> DataFrame:
    """Distinct ``(user, item, rating)`` rows (rating as int) with
    ``is_train``: true for the first ``floor(frac * n)`` rows of each user
    in seeded hash order.  A user with one row has it in test."""
    rows = df.select(user, item, rating_as_int(rating).alias(rating)).distinct()
    return first_by_digest(rows, user, seeded_digest(seed, user, item, rating),
                           lambda n: F.floor(F.lit(frac) * n), [item, rating],
                           "is_train", min(group_rows, LIST_ROWS))


def training_set(base_enc: DataFrame, split: DataFrame,
                 fill_missing: bool = True) -> tuple[DataFrame, DataFrame]:
    """``train``: every encoded base rating plus the companion training
    rows, rating as int (a missing rating becomes 0 unless disabled);
    ``test``: companion test rows (distinct, as the split's rows are).  Both
    ``reviewerID_int, productID_int, prodRating``."""
    comp_train = split.where("is_train").select(
        "reviewerID_int", "productID_int", F.col("compRating").alias("prodRating"))
    train = base_enc.select(
        "reviewerID_int", "productID_int",
        rating_as_int("prodRating").alias("prodRating")).unionByName(comp_train)
    train = train.na.fill(0, ["prodRating"]) if fill_missing else train.na.drop()
    test = (split.where(~F.col("is_train"))
            .select("reviewerID_int", "productID_int",
                    F.col("compRating").alias("prodRating")))
    return train, test
