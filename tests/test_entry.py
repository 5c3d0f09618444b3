"""The driver contract, and the DuckDB oracle on the smallest fixture."""

import math
import re

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from conftest import SF_TINY

TABLES = ["part", "orders", "lineitem"]
ROWS_ONLY = {"als_predictions", "als_recommend", "als_evaluation"}


def norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    rows = [tuple(norm(x) for x in r) for r in pdf[cols].itertuples(index=False)]
    return cols, sorted(rows, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_TINY}/{t}.parquet')")
    return c


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["reviewerID", "pos", "compProd"]
    assert df.count() > 0


def test_every_query_has_an_oracle_unless_rows_only():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q)
    own = {name for name in q if not re.match(r"op\d+_|pipeline$", name)}
    assert own - set(sql) == ROWS_ONLY


FAST = ["companion_relation", "flatten_metadata", "base_ratings", "comp_ratings",
        "companion_scores", "top_companions", "popularity_recommend", "user_metrics",
        "popularity_evaluation", "ideal_order", "category_stats", "hist_per_product",
        "hist_companions_per_base", "dataset_counts", "sparsity", "top_k_per_key",
        "user_candidates", "companions_per_user", "preprocess_summary"]
ALS = ["item_index", "user_index", "holdout_split", "training_set", "negative_samples",
       "als_targets", "eligible_targets", "user_mean_rating", "cohort_ratings",
       "als_ideal_dcg", "pack_ratings", "als_user_metrics", "als_scored_instances",
       "als_list_sizes", "als_training_fit", "als_normal_equations", "als_factor_scores", "user_mean_of_rated", "sampled_users", "ideal_instances"]
RECORDS = ["record_cases", "csv_roundtrip", "records_roundtrip", "metadata_records",
           "open_metadata_records", "list_relations", "metadata_keys",
           "popularity_from_records", "als_targets_from_records"]


@pytest.mark.parametrize("name", FAST + ALS + RECORDS)
def test_matches_oracle(spark, con, name):
    got = entry.queries()[name](spark, SF_TINY).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert rows_of(got) == rows_of(want)
