from pyspark.sql import functions as F

from companion import schemas
from companion.operators import reshape as R
from companion.operators import relation as REL


def meta(spark):
    rows = [("b1", "t", 1.0, (["c1", "c2"],)),
            ("b2", "t", 2.0, ([],)),          # empty list
            ("b3", "t", 3.0, None),            # no related at all
            ("b4", "t", 4.0, (None,))]         # related without a list
    return spark.createDataFrame(rows, schemas.METADATA)


def test_flatten_lifts_nested_fields(spark):
    flat = R.flatten_metadata(meta(spark))
    assert flat.columns == ["asin", "title", "price", "also_bought"]
    got = {r.asin: r.also_bought for r in flat.collect()}
    assert got == {"b1": ["c1", "c2"], "b2": [], "b3": None, "b4": None}


def test_relation_keeps_items_without_list(spark):
    rel = REL.companion_relation(R.flatten_metadata(meta(spark)))
    got = sorted(((r.asin, r.compProd) for r in rel.collect()), key=str)
    assert got == sorted([("b1", "c1"), ("b1", "c2"), ("b2", None), ("b3", None),
                          ("b4", None)], key=str)


def test_base_and_comp_split_by_relation(spark):
    reviews = spark.createDataFrame(
        [("u1", "c1", 5.0), ("u1", "b1", 4.0), ("u2", None, 3.0), ("u2", "x", 1.0)],
        schemas.REVIEW)
    rel = spark.createDataFrame([("b1", "c1"), ("b2", None)], schemas.RELATION)
    base = sorted((tuple(r) for r in REL.base_ratings(reviews, rel).collect()), key=str)
    comp = sorted(tuple(r) for r in REL.comp_ratings(reviews, rel).collect())
    # a null item is nobody's companion, as with ~isin
    assert base == sorted([("u1", "b1", 4.0), ("u2", None, 3.0), ("u2", "x", 1.0)], key=str)
    assert comp == [("u1", "c1", 5.0)]


def test_drop_and_fill(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0)], "k string, v double")
    assert R.drop_incomplete(df).count() == 1
    assert [r.v for r in R.fill_missing(df, ["v"]).orderBy("k").collect()] == [0.0, 2.0]


def test_table_shape(spark):
    df = spark.range(7).withColumn("x", F.lit(1))
    assert tuple(R.table_shape(df).first()) == (7, 2)
