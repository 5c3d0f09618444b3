"""Property tests: numpy's histogram rules and the salted exact rank."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from companion.functions.hashing import hex_prefix, seeded_digest
from companion.operators.histogram import histogram
from companion.operators.ranking import hash_bucket, key_rank

SETTINGS = settings(max_examples=20, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])

values = st.lists(
    st.one_of(st.integers(-1000, 1000).map(float),
              st.floats(-50, 50, allow_nan=False, allow_infinity=False)),
    min_size=1, max_size=60)


@SETTINGS
@given(vals=values, bins=st.integers(1, 40))
def test_histogram_matches_numpy(spark, vals, bins):
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = histogram(df, "v", bins).orderBy("bin").collect()
    counts, edges = np.histogram(np.asarray(vals, dtype=float), bins=bins)
    assert [r.n for r in got] == counts.tolist()
    assert [r.lo for r in got] == pytest.approx(edges[:-1].tolist())


@SETTINGS
@given(sizes=st.lists(st.integers(1, 40), min_size=1, max_size=6),
       group_rows=st.integers(1, 8))
def test_key_rank_equals_row_number(spark, sizes, group_rows):
    rows = [(f"k{k}", i) for k, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "key string, v int").withColumn(
        "_h", seeded_digest(3, "key", "v"))
    df = df.withColumn("_b", hash_bucket(hex_prefix(F.col("_h")), len(rows), group_rows))
    got = {(r.key, r.v): r.r for r in
           key_rank(df, ["key"], "_b", [F.col("_h"), F.col("v")], "r").collect()}
    want = {(r.key, r.v): r.e for r in df.withColumn(
        "e", F.row_number().over(Window.partitionBy("key").orderBy("_h", "v")) - 1).collect()}
    assert got == want
