"""Map the driver's Parquet tables onto the reference's inputs.

The reference reads review records, product metadata with an "also bought"
list, and three CSVs derived from them.  Here they are derived from the
TPC-H-like tables, linearly in their size:

* reviews: one rating per purchased line, ``reviewer = o_custkey``,
  ``item = l_partkey``, ``rating = ceil(l_quantity / 10)`` (1..5).
* main products are large parts, companions are small parts (``p_size``).
* each order that holds a main product is anchored to its smallest main
  part; every companion line of that order is "also bought" with the anchor.
  One anchor per order (a partial aggregate) keeps this linear: no pairs of
  lines are enumerated.
* metadata lists every part; parts that anchor no order carry a null
  ``related`` field, like catalogue items without an also-bought list.
* open metadata adds keys outside the schema: the brand, a rank under a key that
  differs by item (``salesRank: {p_type: p_size}``), and two more lists under
  ``related``: parts of odd size were viewed with the next two part numbers, parts
  whose size 3 divides are bought together with the part of twice their number.
* category (for the two-category statistics) is the part's ``p_type``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCES = ("lineitem", "orders", "part")

# Fixed fixture values: size classes of parts.
MAIN_MIN_SIZE = 48        # p_size >= 48: main (base) product
COMP_MAX_SIZE = 25        # p_size <= 25: companion product


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``reviewerID string, asin string, overall double``."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return li.join(orders, li.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").cast("string").alias("reviewerID"),
        F.col("l_partkey").cast("string").alias("asin"),
        F.ceil(F.col("l_quantity") / 10).cast("double").alias("overall"),
    )


def relation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct ``(asin, compProd)`` pairs, both non-null."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    lines = li.join(part, li.l_partkey == part.p_partkey)
    anchors = (lines.where(F.col("p_size") >= MAIN_MIN_SIZE)
               .groupBy("l_orderkey")
               .agg(F.min("l_partkey").alias("base")))
    comps = lines.where(F.col("p_size") <= COMP_MAX_SIZE).select(
        "l_orderkey", "l_partkey")
    return (comps.join(anchors, "l_orderkey")
            .select(F.col("base").cast("string").alias("asin"),
                    F.col("l_partkey").cast("string").alias("compProd"))
            .distinct())


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("asin"),
        F.col("p_name").alias("title"),
        F.col("p_retailprice").alias("price"),
        F.col("p_type").alias("category"),
    )


def relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relation table as the reference writes it: pairs plus one
    ``(asin, null)`` row per catalogue item without a list."""
    pairs = relation_pairs(spark, sf_dir)
    lonely = (_items(spark, sf_dir).select("asin")
              .join(pairs.select("asin"), "asin", "left_anti")
              .select("asin", F.lit(None).cast("string").alias("compProd")))
    return pairs.unionByName(lonely)


def metadata(spark: SparkSession, sf_dir: str,
             pairs: DataFrame | None = None) -> DataFrame:
    """Nested metadata: ``asin, title, price, related.also_bought``.

    Lists are sorted, one record per item as in the raw files.  ``pairs`` may pass
    relation pairs that were already computed."""
    if pairs is None:
        pairs = relation_pairs(spark, sf_dir)
    lists = (pairs.groupBy("asin")
             .agg(F.array_sort(F.collect_list("compProd")).alias("also_bought"))
             .select("asin", F.struct("also_bought").alias("related")))
    items = _items(spark, sf_dir).drop("category")
    return items.join(lists, "asin", "left").select(
        "asin", "title", "price", "related")


def open_metadata(spark: SparkSession, sf_dir: str, meta: DataFrame) -> DataFrame:
    """``meta`` with the keys and lists of raw files that the schema does not name."""
    part = table(spark, sf_dir, "part")

    def ids(*numbers):
        return F.array(*[n.cast("string") for n in numbers])

    more = part.select(
        F.col("p_partkey").cast("string").alias("asin"), F.col("p_brand").alias("brand"),
        F.create_map("p_type", "p_size").alias("salesRank"),
        F.when(F.col("p_size") % 2 == 1, ids(F.col("p_partkey") + 1, F.col("p_partkey") + 2)).alias("viewed"),
        F.when(F.col("p_size") % 3 == 0, ids(F.col("p_partkey") * 2)).alias("together"))
    return meta.join(more, "asin").select(
        "asin", "title", "price", "brand", "salesRank",
        F.struct(F.col("related.also_bought").alias("also_bought"),
                 F.col("viewed").alias("also_viewed"),
                 F.col("together").alias("bought_together")).alias("related"))


def item_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``asin, category`` for every catalogue item."""
    return _items(spark, sf_dir).select("asin", "category")
