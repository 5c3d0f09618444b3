"""PL2: popularity recommender and its evaluation as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from companion.operators import evaluation as E
from companion.operators.popularity import popularity_recommend
from companion.operators.targets import popularity_labels
from companion.session import materialize

TOP_K = 5


def popularity_pipeline(base: DataFrame, comp: DataFrame, rel: DataFrame,
                        k: int = TOP_K, store: bool = True) -> dict[str, DataFrame]:
    """Recommendations, targets, per-user metrics and the one-row summary.

    With ``store`` the per-base top lists and the recommendations (at most
    K rows per base / per user, read several times downstream) are written
    once to the shared folder instead of being recomputed per branch."""
    keep_top = (lambda df: materialize(df, "popularity-top")) if store else None
    rec = popularity_recommend(base, rel, comp, k, keep_top=keep_top)
    if store:
        rec = materialize(rec, "popularity-recommendations")
    # labelled in one pass; with ``store`` written once, as several branches read it
    labels = popularity_labels(comp)
    if store:
        labels = materialize(labels, "popularity-targets")
    pos = labels.where("positive").drop("positive")
    neg = labels.where("not positive").drop("positive")
    per_user = E.popularity_user_metrics(rec, pos, neg, k)
    return {"recommendations": rec, "positives": pos, "negatives": neg,
            "user_metrics": per_user, "summary": E.summarize(per_user)}
