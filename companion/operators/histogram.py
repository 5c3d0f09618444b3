"""Equal-width histograms with numpy's bin rules (ST2-ST6).

Bins span ``[min, max]`` of each series (``value +- 0.5`` when all values
are equal); bin ``i`` is ``[edge_i, edge_i+1)``, the last one closed, with
``edge_i = lo + i * (hi - lo) / bins`` and the last edge exactly ``hi``.
The index is computed as numpy does, including its one-ULP corrections, so
counts agree with ``numpy.histogram`` value for value.

Rows are counted per ``(series, value)`` first; the range and the bins are
aggregates over those counts; empty bins are generated per series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from companion.session import materialize


def _edge(i: Column, lo: Column, hi: Column, bins: int) -> Column:
    step = (hi - lo) / F.lit(float(bins))
    return F.when(i == F.lit(bins), hi).otherwise(i.cast("double") * step + lo)


def bin_index(df: DataFrame, v: str, lo: str, hi: str, bins: int,
              out: str = "bin") -> DataFrame:
    """Add numpy's bin index of column ``v`` inside ``[lo, hi]`` (values
    are in range): the scaled offset, then numpy's one-ULP corrections
    against the exact edges, one column at a time."""
    V, LO, HI = F.col(v), F.col(lo), F.col(hi)
    raw = ((V - LO) / (HI - LO) * F.lit(float(bins))).cast("long")
    df = df.withColumn("_raw", F.when(raw == F.lit(bins), F.lit(bins - 1)).otherwise(raw))
    down = F.col("_raw")
    df = df.withColumn("_down", F.when(V < _edge(down, LO, HI, bins), down - 1).otherwise(down))
    down = F.col("_down")
    return df.withColumn(out, F.when((V >= _edge(down + 1, LO, HI, bins))
                                     & (down != F.lit(bins - 1)), down + 1)
                         .otherwise(down)).drop("_raw", "_down")


def _bounds(lo0: Column, hi0: Column) -> tuple[Column, Column]:
    same = lo0 == hi0
    return (F.when(same, lo0 - 0.5).otherwise(lo0),
            F.when(same, hi0 + 0.5).otherwise(hi0))


def histogram(df: DataFrame, value: str, bins: int,
              by: Sequence[str] = ()) -> DataFrame:
    """``[by...,] bin, lo, hi, n`` for every bin of every series.

    Nulls are ignored.  Rows are counted per distinct value first (a partial
    aggregate, written once), so the range, the binning and the join with the
    range see distinct values only.  Without ``by`` the range is one row and enters
    as literals; with ``by`` it is joined on the series keys."""
    by = list(by)
    vals = df.select(*by, F.col(value).cast("double").alias("_v")).where(
        F.col("_v").isNotNull())
    values = materialize(vals.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_rows")),
                         "histogram-values")
    if by:
        rng = values.groupBy(*by).agg(F.min("_v").alias("_lo0"), F.max("_v").alias("_hi0"))
        lo, hi = _bounds(F.col("_lo0"), F.col("_hi0"))
        series = materialize(rng.select(*by, lo.alias("_lo"), hi.alias("_hi")),
                             "histogram-ranges")
        tagged = values.join(series, by)
    else:
        # the range is a one-row aggregate: two numbers (a bounded
        # statistic) enter the plan as literals; no join, no subquery copies
        lo0, hi0 = values.agg(F.min("_v"), F.max("_v")).first()
        empty = lo0 is None
        lo, hi = _bounds(F.lit(0.0 if empty else float(lo0)),
                         F.lit(0.0 if empty else float(hi0)))
        tagged = values.select("_v", "_rows", lo.alias("_lo"), hi.alias("_hi"))
        series = vals.sparkSession.range(0 if empty else 1).select(
            lo.alias("_lo"), hi.alias("_hi"))
    counts = (bin_index(tagged, "_v", "_lo", "_hi", bins)
              .groupBy(*by, "bin").agg(F.sum("_rows").alias("_n")))
    grid = series.select(*by, "_lo", "_hi",
                         F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return (grid.join(counts, [*by, "bin"], "left").select(
        *by, F.col("bin").cast("long").alias("bin"),
        _edge(F.col("bin"), F.col("_lo"), F.col("_hi"), bins).alias("lo"),
        _edge(F.col("bin") + 1, F.col("_lo"), F.col("_hi"), bins).alias("hi"),
        F.coalesce(F.col("_n"), F.lit(0)).cast("long").alias("n")))
