"""Column expressions for ranking metrics over short (at most K) lists.

A list is an array of ``struct(pos, hit, neg)`` sorted by ``pos`` (1-based):
``hit`` says the item is a positive target, ``neg`` a negative one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LN2 = math.log(2.0)


def discount(pos: Column) -> Column:
    """Binary-gain DCG discount of a 1-based position: ln 2 / ln(pos + 1)."""
    return F.lit(LN2) / F.log(pos + F.lit(1))


def ordered_list(pos: str, *fields: str) -> Column:
    """Aggregate: ``array<struct(pos, fields...)>`` sorted by position;
    rows with a null position (empty lists) are skipped."""
    return F.array_sort(F.collect_list(
        F.when(F.col(pos).isNotNull(),
               F.struct(F.col(pos).alias("pos"), *[F.col(f) for f in fields]))))


def hits(lst: Column) -> Column:
    """Number of list entries that are positive targets (repeats count)."""
    return F.size(F.filter(lst, lambda x: x["hit"])).cast("long")


def dcg(lst: Column) -> Column:
    """Sum of discounts over hit positions."""
    return F.aggregate(lst, F.lit(0.0),
                       lambda acc, x: acc + F.when(x["hit"], discount(x["pos"]))
                       .otherwise(F.lit(0.0)))


def ideal_hit_flags(lst: Column) -> Column:
    """Hit flags of the ideal reordering of the list: positives, then
    unlabelled, then negatives, each in list order.  An item that is both
    positive and negative appears in the first and the last group."""
    return F.concat(
        F.transform(F.filter(lst, lambda x: x["hit"]), lambda x: F.lit(True)),
        F.transform(F.filter(lst, lambda x: ~x["hit"] & ~x["neg"]),
                    lambda x: F.lit(False)),
        F.transform(F.filter(lst, lambda x: x["neg"]), lambda x: x["hit"]),
    )


def dcg_of_flags(flags: Column) -> Column:
    """DCG of an array of booleans (hit at 0-based index i -> ln2/ln(i+2))."""
    gains = F.transform(flags, lambda f, i: F.when(f, discount(i + F.lit(1)))
                        .otherwise(F.lit(0.0)))
    return F.aggregate(gains, F.lit(0.0), lambda acc, g: acc + g)


def reciprocal_rank(lst: Column) -> Column:
    """1 / position of the first hit, 0 when there is none."""
    first = F.array_min(F.transform(F.filter(lst, lambda x: x["hit"]),
                                    lambda x: x["pos"]))
    return F.coalesce(F.lit(1.0) / first, F.lit(0.0))


def safe_ratio(num: Column, den: Column) -> Column:
    """``num / den``, 0 when the denominator is 0 or null (ANSI-safe)."""
    return F.when(den != 0, num / den).otherwise(F.lit(0.0))
