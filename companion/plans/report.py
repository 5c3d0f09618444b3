"""PL4: dataset statistics and histograms, several datasets in one plan.

The reference's notebook repeats the same statistics per review category;
here a ``category`` column is carried and grouped on instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from companion.operators import stats as S
from companion.operators.histogram import histogram
from companion.operators.relation import companion_relation
from companion.operators.reshape import flatten_metadata

# Fixed bin counts of the reference's plots (10 is the plotting default).
RATING_BINS = 10
PER_PRODUCT_BINS = 500
PER_USER_BINS = 200
COMPANIONS_PER_USER_BINS = 100
COMPANIONS_PER_BASE_BINS = 100


def categorized(reviews: DataFrame, meta: DataFrame,
                categories: DataFrame) -> dict[str, DataFrame]:
    """Attach each item's category to reviews, metadata and the relation
    (a relation row takes its base's category)."""
    cat_reviews = reviews.join(categories, "asin")
    cat_meta = flatten_metadata(meta).join(categories, "asin")
    cat_rel = companion_relation(cat_meta, keep=("category",))
    return {"reviews": cat_reviews, "meta": cat_meta, "relation": cat_rel}


REPORT_ITEMS = ("counts", "ratings_per_product", "ratings_per_user",
                "companions_per_user", "companions_per_base", "hist_rating",
                "hist_per_product", "hist_per_user", "hist_companions_per_user",
                "hist_companions_per_base")


def dataset_report(reviews: DataFrame, meta_flat: DataFrame, rel: DataFrame,
                   by: tuple[str, ...] = (),
                   items: tuple[str, ...] = REPORT_ITEMS) -> dict[str, DataFrame]:
    """Counts, sparsity and the five histograms of the reference's notebook.

    Only the requested ``items`` are planned (a histogram computes its
    range statistic when it is planned)."""
    made: dict[str, DataFrame] = {}

    def get(name: str) -> DataFrame:
        if name not in made:
            made[name] = build[name]()
        return made[name]

    build = {
        "counts": lambda: S.dataset_counts(reviews, meta_flat, rel, by),
        "ratings_per_product": lambda: S.ratings_per_product(reviews, by),
        "ratings_per_user": lambda: S.ratings_per_user(reviews, by),
        "companions_per_user": lambda: S.companions_per_user(reviews, rel, by),
        "companions_per_base": lambda: S.companions_per_base(reviews, rel, by),
        "hist_rating": lambda: histogram(reviews, "overall", RATING_BINS, by),
        "hist_per_product": lambda: histogram(get("ratings_per_product"), "n_ratings",
                                              PER_PRODUCT_BINS, by),
        "hist_per_user": lambda: histogram(get("ratings_per_user"), "n_ratings",
                                           PER_USER_BINS, by),
        "hist_companions_per_user": lambda: histogram(
            get("companions_per_user"), "n_companions", COMPANIONS_PER_USER_BINS, by),
        "hist_companions_per_base": lambda: histogram(
            get("companions_per_base"), "n_companions", COMPANIONS_PER_BASE_BINS, by),
    }
    return {name: get(name) for name in items}
