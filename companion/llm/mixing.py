"""Mixing sources to target weights by capped water-filling.

A source's size is its number of words.  The mix holds ``SHARE`` times all
words.  Each source's target is its weight's part, clamped at ``MAX_EPOCHS``
times its size; what the clamp frees is dealt again to the others by weight,
until no target is above its clamp.  A document is then taken whole
``floor(target / size)`` times, and once more when it lies in the seeded part
that makes up the fraction.

That part is exact in words, not on average: documents get a seeded draw, draws
are counted into buckets, and the documents of the buckets below the boundary
are taken; the boundary bucket is divided again by the draw's next bits, and
inside the last bucket documents are taken in draw order while half of the next
one still fits.  So a source misses its target by at most half of one document.
Rows of equal id and text share their draw: as many of them are taken once more
as fit.

Scale: sizes and draws are written once as a narrow table; sources and buckets
are summed by partial aggregation, so a source with a third of all rows costs
its tasks one row per bucket.  The table of targets (one row per source) is written,
so Spark broadcasts it only below its measured size threshold and otherwise splits
the hot source's partition.  The water level is a window over one row per source.  Running sums go over at most ``BUCKETS`` rows of
a source, and over the different documents of one second-level bucket (one of
``BUCKETS ** 2``), never over a source.

Defined cases: a null text has size 0; a null source is a source of its own, the
last; documents of size 0 are taken 0 words; a source without words has target
0; equal draws order by id and size; of equal rows (same id and text) some may be
taken once more and others not, whichever these are; an empty table gives no rows;
reruns give the same rows, as draws depend on the row's values alone.  Other columns are
ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from companion.llm.common import WORD, md5_fraction
from companion.operators.ranking import key_rank
from companion.session import materialize

WEIGHTS = (3.0, 1.0, 2.0)     # by source in code-point order, null last, repeating
SHARE = 1.5
MAX_EPOCHS = 2.0
SEED = 42
BUCKETS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Targets of ``sources`` (source, source_size, weight): adds ``target``.

    The clamped sources are those with the smallest clamp per weight: in the
    order of size / weight, clamping the first j leaves a level of
    (total - clamps so far) / (weights left), and j is the first for which the
    next source stays under its clamp.  One running sum replaces the rounds."""
    by_need = Window.orderBy(F.col("_need"), F.col("source").asc_nulls_last())
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(float(share)) * F.sum("source_size").over(every)
             - F.coalesce(F.sum("_clamp").over(before), F.lit(0.0))) / (
                 F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    steps = sources.withColumn("_clamp", F.col("source_size") * F.lit(float(max_epochs))).withColumn(
        "_need", F.col("_clamp") / F.col("weight")).withColumn("_level", level).withColumn(
        "_place", F.row_number().over(by_need))
    stable = F.when(F.col("_level") <= F.col("_need"), F.struct("_place", "_level"))
    final = F.min(stable).over(every)["_level"]
    # no stable step: everything is clamped
    target = F.when(final.isNull() | (F.col("_need") <= final), F.col("_clamp")).otherwise(
        final * F.col("weight"))
    return steps.withColumn("target", target).drop("_clamp", "_need", "_level", "_place")


def default_weights(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Adds ``weight``: ``weights`` repeating over the sources in code-point order, null last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    list_ = F.array(*[F.lit(float(w)) for w in weights])
    return sources.withColumn("weight", F.element_at(
        list_, (place % len(weights) + 1).cast("int")))


def measures(docs: DataFrame, seed: int = SEED) -> dict[str, Column]:
    """The columns that decide how often a row is taken."""
    text = F.col("text").cast("string")
    return {"doc_id": F.col("doc_id"), "source": F.col("source").cast("string"),
            "size": word_count(text),
            "draw": md5_fraction(F.col("doc_id"), F.md5(F.coalesce(text, F.lit(""))), seed=seed)}


def measured(docs: DataFrame, seed: int = SEED) -> DataFrame:
    return docs.select(*[c.alias(n) for n, c in measures(docs, seed).items()])


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    first = F.floor(F.col("draw") * buckets).cast("long")
    second = F.floor(F.col("draw") * buckets * buckets).cast("long") % buckets
    return rows.withColumn("_b1", first).withColumn("_b2", second)


def taking_plan(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
                max_epochs: float = MAX_EPOCHS, buckets: int = BUCKETS) -> DataFrame:
    """A written table with one row per source: source_size, target, whole epochs, and
    the place in draw order up to which documents are taken once more.  Reads ``sized``
    (columns of ``measured``) three times: pass a written table."""
    rows = _bucketed(sized, buckets)
    by_bucket = materialize(
        rows.groupBy("source", "_b1").agg(F.sum("size").alias("words")), "mixing-buckets")
    sizes = by_bucket.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = water_fill(default_weights(sizes, weights), share, max_epochs)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(ratio)
    plan = materialize(targets.select(
        F.col("source").alias("_s"), "source_size", "target", whole.alias("_whole"),
        (F.col("target") - whole * F.col("source_size")).alias("_extra")), "mixing-plan")

    def boundary(sums: DataFrame, bucket: str, need: str) -> DataFrame:
        """Per source the bucket in which the running sum passes ``need``, and what is
        still needed there."""
        running = F.sum("words").over(Window.partitionBy("_s").orderBy(bucket))
        passed = sums.withColumn("_run", running).filter(F.col("_run") > F.col(need))
        return passed.groupBy("_s").agg(F.min(F.struct(
            F.col(bucket), (F.col(need) - F.col("_run") + F.col("words")).alias("left"))).alias("at")
        ).select("_s", F.col(f"at.{bucket}").alias(f"_at{bucket}"),
                 F.col("at.left").alias(f"_left{bucket}"))

    same = F.col("source").eqNullSafe(F.col("_s"))
    cut1 = boundary(by_bucket.join(plan, same), "_b1", "_extra")
    plan1 = materialize(
        plan.join(cut1.withColumnRenamed("_s", "_s1"), F.col("_s").eqNullSafe(F.col("_s1")), "left")
        .drop("_s1"), "mixing-plan")
    inside = rows.join(plan1, same).filter("_b1 = _at_b1")
    sums2 = inside.groupBy("_s", "_left_b1", "_b2").agg(F.sum("size").alias("words"))
    cut2 = boundary(sums2, "_b2", "_left_b1")
    plan2 = materialize(
        plan1.join(cut2.withColumnRenamed("_s", "_s1"), F.col("_s").eqNullSafe(F.col("_s1")), "left")
        .drop("_s1"), "mixing-plan")

    # the last bucket: in draw order, while half of the document still fits; equal rows are
    # one line with their number, of which the last line gives as many as fit
    last = rows.join(plan2, same).filter("_b1 = _at_b1 AND _b2 = _at_b2").groupBy(
        "_s", "_left_b2", "draw", "doc_id", "size").agg(F.count(F.lit(1)).alias("copies"))
    order = Window.partitionBy("_s").orderBy("draw", "doc_id", "size")
    before = F.coalesce(F.sum(F.col("size") * F.col("copies")).over(
        order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = F.col("_left_b2") - before
    fits = F.when(F.col("size") > 0, F.floor(room / F.col("size") + 0.5)).otherwise(
        F.when(room >= 0, F.col("copies")).otherwise(0))
    cut3 = last.withColumn("take", F.least(fits, F.col("copies")).cast("long")).filter(
        "take > 0").groupBy("_s").agg(F.max(F.struct(
            F.struct("draw", "doc_id", "size").alias("row"), "take", "copies")).alias("_end"))
    return materialize(plan2.join(cut3.withColumnRenamed("_s", "_s1"),
                                  F.col("_s").eqNullSafe(F.col("_s1")), "left").select(
        *plan2.columns, F.col("_end.row").alias("_last"), F.col("_end.take").alias("_take"),
        F.col("_end.copies").alias("_copies")), "mixing-plan")


def apply_plan(rows: DataFrame, plan: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``rows`` (with the columns of ``measured``) plus source_size, target and ``epochs``."""
    place = F.struct("_b1", "_b2")
    edge = F.struct(F.col("_at_b1").alias("_b1"), F.col("_at_b2").alias("_b2"))
    here = F.struct("draw", "doc_id", "size")
    more = (F.col("_at_b1").isNull()               # nothing passes the need: take all
            | (F.col("_b1") < F.col("_at_b1"))
            | ((F.col("_b1") == F.col("_at_b1")) & F.col("_at_b2").isNotNull()
               & (F.col("_b2") < F.col("_at_b2")))
            | ((place == edge) & F.coalesce(here <= F.col("_last"), F.lit(False))))
    extra = F.when((F.col("_extra") > 0) & F.coalesce(more, F.lit(False)), 1).otherwise(0)
    joined = _bucketed(rows, buckets).join(plan, F.col("source").eqNullSafe(F.col("_s")))
    shared = (F.col("_extra") > 0) & (F.col("_take") < F.col("_copies"))
    placed = joined.withColumn("epochs", (F.col("_whole") + extra).cast("long")).withColumn(
        "_shared", F.coalesce(shared & (place == edge) & (here == F.col("_last")), F.lit(False)))
    names = [*rows.columns, "source_size", "target", "epochs"]
    if plan.filter(shared).isEmpty():
        return placed.select(*names)
    # of equal rows some are taken once more: they are numbered in the order of a written
    # table, by part of the table first, so a row that fills the source is no single task
    tied = materialize(placed.filter("_shared").select(
        *names, "_whole", "_take", F.monotonically_increasing_id().alias("_id"),
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_key")), "mixing-tied")
    numbered = key_rank(tied.withColumn("_part", F.shiftright("_id", 33)), ["_key"], "_part",
                        [F.col("_id")], "_nth")
    dealt = numbered.withColumn("epochs", (
        F.col("_whole") + (F.col("_nth") < F.col("_take")).cast("long")).cast("long"))
    return placed.filter("NOT _shared").select(*names).unionByName(dealt.select(*names))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
        max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source, epochs."""
    sized = materialize(measured(docs, seed=seed), "mixing-sizes")
    out = apply_plan(sized, taking_plan(sized, weights, share, max_epochs))
    return out.select("doc_id", "size", "source_size", "target",
                      (F.col("epochs") * F.col("size")).alias("taken"), "source", "epochs")


def repeat_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
                     max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with ``copy`` from 1.

    The epochs of a row follow from its source and draw, so the texts are joined with
    one row per source instead of one row per document and are never shuffled by id."""
    sized = materialize(measured(docs, seed=seed), "mixing-sizes")
    plan = taking_plan(sized, weights, share, max_epochs)
    columns = [c for c in docs.columns]
    rows = docs.select(
        F.struct(*[F.col(c) for c in columns]).alias("_llm_row"), *[
            c.alias(f"_llm_{n}") for n, c in measures(docs, seed).items()])
    rows = rows.select("_llm_row", *[F.col(f"_llm_{n}").alias(n) for n in measures(docs, seed)])
    taken = apply_plan(rows, plan).filter("epochs > 0").select("_llm_row", F.explode(
        F.sequence(F.lit(1), F.col("epochs").cast("int"))).alias("_llm_copy"))
    return taken.select("_llm_row.*", F.col("_llm_copy").alias("copy"))
