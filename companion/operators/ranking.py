"""Ranking primitives: top-K per key, the first rows of a key in hash order, exact rank
within a key, dense ids.

``key_rank`` gives the exact 0-based position of each row inside its key
without sending a whole key to one task: the caller supplies a coarse integer
column, non-decreasing in the row order, that splits every key into bounded
sub-groups (for a hash order, ``hash_bucket``).  Counts per sub-group are a
partial aggregate, their running sums are a window over the small count
table, and the fine rank is a window over one sub-group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from companion.session import (materialize, scratch_path, shuffles_removed, steps_removed,
                               table_exists)

# rows per sub-group of a key; large enough that ordinary keys stay whole
DEFAULT_GROUP_ROWS = 1 << 17
# rows of a key that are few enough to be sorted as one list
LIST_ROWS = 1 << 10
HEX = 16
DIGEST_DIGITS = 32


def top_k_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                  k: int, pos_col: str = "pos") -> DataFrame:
    """Rows ranked 1..k inside each key by ``order`` (``pos_col`` 1-based).

    Catalyst plans this as a ``WindowGroupLimit``: each map task keeps only
    its own first k rows per key before the shuffle, so a hot key costs k
    rows per task, not its full size."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn(pos_col, F.row_number().over(w))
            .where(F.col(pos_col) <= k))


def first_by_digest(df: DataFrame, key: str, digest: Column, take: Callable[[Column], Column],
                    order: Sequence[str], flag: str, list_rows: int = LIST_ROWS) -> DataFrame:
    """``df`` plus ``flag``: whether a row is among the first ``take(n)`` of its key's ``n`` rows
    in the order of ``digest`` (md5 in hex of the row's own values), then ``order``.

    Radix selection, no sort: the rows of a key are counted by the first hex digit (16
    counters in one partial aggregate, so a key costs each task one row), and the running
    sum tells the digit in which the cut lies.  Rows with a lower digit are in, rows with a
    higher one are out; only those of the cut's digit (a sixteenth) are left.  Where these
    are at most ``list_rows`` for a key, the cut is read off their sorted list; larger ones
    are counted by the next digit.  Every level is written, so rows that are decided are not
    read again; digests are not, as they take several times a row's bytes: they are computed
    where they are read.  Rows with a null key are left out."""
    columns = df.columns
    place = F.struct(digest.alias("_digest"), *order)
    left = materialize(df, "first-rows")
    decided: list[DataFrame] = []
    for level in range(DIGEST_DIGITS):
        left = left.withColumn("_digit", F.conv(F.substring(digest, level + 1, 1), HEX, 10).cast("int"))
        digit = F.col("_digit")
        counters = [F.count_if(digit == i).alias(f"_c{i}") for i in range(HEX)]
        wanted = [] if level == 0 else [F.first("_wanted").alias("_wanted")]
        counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(*counters, *wanted)
        below = [sum((F.col(f"_c{i}") for i in range(n)), F.lit(0)) for n in range(HEX + 1)]
        if level == 0:
            counts = counts.withColumn("_wanted", take(below[HEX]).cast("long"))
        cut = F.coalesce(*[F.when(below[i + 1] > F.col("_wanted"), F.struct(
            F.lit(i).alias("digit"), (F.col("_wanted") - below[i]).alias("wanted"),
            F.col(f"_c{i}").alias("size"))) for i in range(HEX)])
        cuts = materialize(counts.select(key, cut.alias("_cut")), "first-cuts")
        known = (F.when(F.col("_cut").isNull() | (digit < F.col("_cut.digit")), True)
                 .when((digit > F.col("_cut.digit")) | (F.col("_cut.wanted") == 0), False))
        placed = materialize(left.select(*columns, digit).join(cuts, key).select(
            *columns, known.alias(flag), F.col("_cut.wanted").alias("_wanted"),
            F.col("_cut.size").alias("_size")), "first-placed")
        decided.append(placed.where(F.col(flag).isNotNull()).select(*columns, flag))
        undecided = placed.where(F.col(flag).isNull()).drop(flag)
        few = F.col("_size") <= list_rows if level + 1 < DIGEST_DIGITS else F.lit(True)
        short = undecided.where(few).withColumn("_place", place)
        ends = short.groupBy(key).agg(
            F.sort_array(F.collect_list("_place")).alias("_list"), F.first("_wanted").alias("_at")
        ).select(key, F.get("_list", F.col("_at").cast("int")).alias("_end"))
        decided.append(short.join(ends, key).select(*columns, (F.col("_place") < F.col("_end")).alias(flag)))
        if cuts.where((F.col("_cut.size") > list_rows) & (F.col("_cut.wanted") > 0)).isEmpty():
            break
        left = undecided.where(~few)
    out = decided[0]
    for part in decided[1:]:
        out = out.unionByName(part)
    return out


def hash_bucket(prefix: Column, total_rows: int, group_rows: int) -> Column:
    """Sub-group of a row ordered by a uniform 60-bit hash prefix.

    The hash range is cut into ``ceil(total_rows / group_rows)`` equal parts for
    every key: a key cannot own more than all rows, so even one that owns them all
    has about ``group_rows`` rows in a part, and no per-key count has to be joined
    to the rows first.  The bucket never decreases as the hash grows."""
    n_buckets = max(1, -(-int(total_rows) // group_rows))
    return F.floor(prefix / F.lit(float(1 << 60)) * F.lit(float(n_buckets))).cast("long")


def key_rank(df: DataFrame, keys: Sequence[str], coarse: str,
             order: Sequence[Column], rank_col: str = "rank",
             size_col: str | None = None) -> DataFrame:
    """Exact 0-based rank of each row within ``keys`` by (``coarse``, ``order``), and with
    ``size_col`` the number of rows of its key.

    ``coarse`` must be a column of ``df`` that is non-decreasing in the row
    order within a key; the rank is then identical to a single window over
    the key, but no task has to hold more than one ``(key, coarse)`` group: rows are
    dealt by both before the window, whatever their distribution was, and the counts
    come from one row per group."""
    keys = list(keys)
    df = df.repartition(*keys, coarse)
    counts = df.groupBy(*keys, coarse).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(coarse).rowsBetween(
        Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    sizes = [F.sum("_n").over(every).alias(size_col)] if size_col else []
    offsets = counts.select(*keys, coarse, *sizes,
                            F.coalesce(F.sum("_n").over(before), F.lit(0))
                            .alias("_before"))
    fine = Window.partitionBy(*keys, coarse).orderBy(*order)
    return (df.withColumn("_within", F.row_number().over(fine) - 1)
            .join(offsets, [*keys, coarse])
            .withColumn(rank_col, (F.col("_before") + F.col("_within")).cast("long"))
            .drop("_before", "_within"))


def dense_index(df: DataFrame, key: str, id_col: str,
                num_partitions: int | None = None) -> DataFrame:
    """``(key, id)`` with ids 0..n-1 in ascending key order (nulls skipped).

    Distinct keys are range-partitioned and sorted, tagged with their
    position inside the partition, and written once as a table in the shared
    checkpoint folder, so the ids never change afterwards (not even when an
    executor is lost).  Offsets of the range partitions (one row per
    partition) are broadcast, and the resulting id table is written in its place."""
    spark = df.sparkSession
    with steps_removed(spark) as keep:
        keys = df.select(key).where(F.col(key).isNotNull()).distinct().persist(
            StorageLevel.MEMORY_AND_DISK)
        path = scratch_path(spark, f"dense-index-{key}")
        # without an explicit count AQE may merge adjacent ranges, which keeps
        # every partition a contiguous key range
        ranged = (keys.repartitionByRange(num_partitions, key) if num_partitions
                  else keys.repartitionByRange(key))
        with shuffles_removed(spark):
            (ranged.sortWithinPartitions(key)
             .withColumn("_mid", F.monotonically_increasing_id())
             .write.parquet(path))
        keys.unpersist()
        tagged = spark.read.parquet(path)
        tagged = (tagged.withColumn("_pid", F.shiftright("_mid", 33))
                  .withColumn("_pos", F.col("_mid") - F.shiftleft(F.col("_pid"), 33)))
        sizes = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
        # one row per range partition: the global window and broadcast are bounded
        before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0))
                               .alias("_off"))
        ids = tagged.join(F.broadcast(offsets), "_pid").select(
            key, (F.col("_off") + F.col("_pos")).cast("int").alias(id_col))
        # the id table itself is written too, so every later use is a plain scan
        return keep(ids, f"dense-ids-{key}")


def id_versions(spark: SparkSession, root: str) -> list[str]:
    """Folders of the complete versions of an id table under ``root``, oldest first.

    A version whose write was cut short has no ``_SUCCESS`` file: it and whatever follows
    do not count."""
    folders: list[str] = []
    while table_exists(spark, f"{root}/version={len(folders)}/_SUCCESS"):
        folders.append(f"{root}/version={len(folders)}")
    return folders


def read_ids(spark: SparkSession, root: str) -> DataFrame:
    """``(key, id)`` of every complete version under ``root``."""
    return spark.read.parquet(*id_versions(spark, root))


def extend_ids(df: DataFrame, key: str, id_col: str, root: str) -> DataFrame:
    """Give dense ids to the keys of ``df`` that have none yet, and return the whole table.

    Ids live in versions under ``root``, one folder per batch that brought new keys: a
    version holds the new keys only, in ascending order, with ids that follow the last one
    given.  Ids that were given never move, so factors and encoded ratings of earlier batches stay
    valid, and a batch costs its own keys, not the table.  A lost write leaves a folder that
    no reader counts; the next batch overwrites it and gives the same ids again.  One writer
    at a time."""
    spark = df.sparkSession
    old = id_versions(spark, root)
    keys = df.select(key).where(F.col(key).isNotNull())
    start = 0
    if old:
        known = spark.read.parquet(*old)
        start = (known.agg(F.max(id_col)).first()[0] or 0) + 1 if not known.isEmpty() else 0
        keys = keys.distinct().join(known.select(key), key, "left_anti")
    fresh = dense_index(keys, key, id_col)
    if not old or not fresh.isEmpty():
        fresh.select(key, (F.col(id_col) + F.lit(start)).cast("int").alias(id_col)).write.mode(
            "overwrite").parquet(f"{root}/version={len(old)}")
    return read_ids(spark, root)
