import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from companion.functions.hashing import hex_prefix, seeded_digest
from companion.operators.ranking import dense_index, hash_bucket, key_rank, top_k_per_key


def test_key_rank_equals_row_number_with_tiny_groups(spark):
    rnd = random.Random(3)
    rows = [("hot", i) for i in range(400)] + [(f"k{rnd.randrange(20)}", i) for i in range(200)]
    df = spark.createDataFrame(rows, "key string, v int").withColumn(
        "_h", seeded_digest(1, "key", "v"))
    df = df.withColumn("_b", hash_bucket(hex_prefix(F.col("_h")), df.count(), 16))
    assert df.select("_b").distinct().count() > 20          # the hot key is split
    ranked = key_rank(df, ["key"], "_b", [F.col("_h"), F.col("v")], "r", size_col="n")
    assert {r.key: r.n for r in ranked.collect()} == {
        r.key: r["count"] for r in df.groupBy("key").count().collect()}
    expect = df.withColumn("e", F.row_number().over(
        Window.partitionBy("key").orderBy("_h", "v")) - 1)
    got = {(r.key, r.v): r.r for r in ranked.collect()}
    want = {(r.key, r.v): r.e for r in expect.collect()}
    assert got == want


def test_dense_index_is_sorted_rank(spark):
    keys = [f"id{random.Random(5).randrange(10**6)}" for _ in range(1)] + \
           [f"k{i:04d}" for i in range(300)] + [None]
    df = spark.createDataFrame([(k,) for k in keys] * 2, "key string")
    ids = {r.key: r.id for r in dense_index(df, "key", "id", num_partitions=5).collect()}
    expect = {k: i for i, k in enumerate(sorted(k for k in set(keys) if k is not None))}
    assert ids == expect


def test_top_k_per_key(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), ("b", 5)], "k string, v int")
    got = sorted((r.k, r.v, r.pos) for r in
                 top_k_per_key(df, ["k"], [F.col("v").desc()], 2).collect())
    assert got == [("a", 2, 2), ("a", 3, 1), ("b", 5, 1)]


def test_ids_of_earlier_batches_never_move(spark, tmp_path):
    from companion.operators.ranking import extend_ids, id_versions, read_ids

    def batch(*keys):
        return spark.createDataFrame([(k,) for k in keys], "k string")

    def ids(df):
        return {r.k: r.i for r in df.collect()}

    root = f"file://{tmp_path}/ids"
    first = ids(extend_ids(batch("m", "c", "m", None), "k", "i", root))
    assert first == {"c": 0, "m": 1}
    second = ids(extend_ids(batch("z", "a", "c"), "k", "i", root))
    assert second == {"c": 0, "m": 1, "a": 2, "z": 3}
    assert ids(extend_ids(batch("a", "m"), "k", "i", root)) == second      # nothing new
    assert len(id_versions(spark, root)) == 2
    # a write that was lost half way: files, but no _SUCCESS
    batch("q").selectExpr("k", "99 AS i").write.parquet(f"{root}/version=2")
    (tmp_path / "ids" / "version=2" / "_SUCCESS").unlink()
    assert ids(read_ids(spark, root)) == second
    third = ids(extend_ids(batch("b", "q"), "k", "i", root))
    assert third == second | {"b": 4, "q": 5}
    empty = f"file://{tmp_path}/none"
    assert ids(extend_ids(batch(), "k", "i", empty)) == {}
    assert ids(extend_ids(batch("x"), "k", "i", empty)) == {"x": 0}
