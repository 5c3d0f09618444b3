"""Scoring instances: each user's test items plus as many unseen items.

The reference draws, for a user with ``t`` test rows, ``t`` distinct items
of the companion pool that the user has neither trained on nor been tested
on, by rejection sampling in a Python UDF (and never ends when the pool is
exhausted).  Here every user walks through the pool in an order of its own, a
keyed permutation, and takes the first ``t`` items that it hasn't seen:

1. the pool gets dense indexes ``0..P-1`` (item order, written once);
2. draw ``k`` of a user is the image of ``k`` under a Feistel network on pairs
   ``(L, R)`` of ``a * b`` values, keyed by seed and user: rounds add a digest of
   one half to the other (modulo ``a``, modulo ``b``), so draws never repeat;
3. the sides ``a`` and ``b`` are chosen so that ``a * b`` exceeds ``P`` as little as
   possible (``sides``); draws beyond the pool are skipped;
4. a user who has seen ``s`` items of the pool makes ``t + s + (a * b - P)`` draws, or
   all ``a * b``: at most ``s`` of them are seen and at most ``a * b - P`` lie beyond the
   pool, so ``min(t, unseen pool)`` items are always among them.

Most users need few of these draws, as few of them hit a seen item.  So everyone first makes
the number that is almost surely enough (``likely_draws``), and only users for whom it was
not make the rest; the draws and their order are the same.  Draws are generated in chunks
with a shuffle in between, so a user with a third of all rows is spread over many tasks, and
are written once, so their digests are not computed again by what reads them; seen items
leave by one anti join, and the first ``t`` by draw number are an exact rank.  No list is
built per user.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from companion.functions.hashing import draw_index, seeded_digest
from companion.operators.ranking import DEFAULT_GROUP_ROWS, dense_index, key_rank
from companion.session import materialize

ROUNDS = 4
SIDE_RANGE = 4                # sides are sought up to so many times the square root
ROWS_PER_TASK = 1 << 20       # generated draws per task


def sides(n: int) -> tuple[int, int]:
    """``(a, b)`` with ``a * b >= n``, as close as possible, and of these the least ``a``:
    from the square root up to ``SIDE_RANGE`` times that, neither side 1 if ``n > 3``."""
    least = max(1, math.ceil(math.sqrt(n)))
    most = max(least, min(SIDE_RANGE * least, (n + 1) // 2))
    _, a = min((a * -(-n // a), a) for a in range(least, most + 1))
    return a, max(1, -(-n // a))


def permuted(k: Column, key: Column | str, a: int, b: int, seed: int) -> Column:
    """The image of ``k`` (0 to ``a * b - 1``) under the permutation of ``key``."""
    left, right = F.floor(k / F.lit(b)).cast("long"), F.pmod(k, F.lit(b)).cast("long")
    for number in range(ROUNDS):
        if number % 2 == 0:
            left = F.pmod(left + draw_index(seeded_digest(seed, key, F.lit(number), right), F.lit(a)), F.lit(a))
        else:
            right = F.pmod(right + draw_index(seeded_digest(seed, key, F.lit(number), left), F.lit(b)), F.lit(b))
    return left * F.lit(b) + right


def _chunked_range(df: DataFrame, user: str, total: Column, name: str,
                   chunk_rows: int, partitions: int) -> DataFrame:
    """Rows ``0..total-1`` per input row as column ``name``, generated in
    chunks of ``chunk_rows`` that are shuffled into ``partitions`` parts
    before expansion (sized by the expanded row count, not the input)."""
    n_chunks = F.ceil(total / F.lit(chunk_rows)).cast("int")
    chunks = (df.withColumn("_total", total.cast("long"))
              .withColumn("_c", F.explode(F.sequence(F.lit(0), n_chunks - 1)))
              .repartition(partitions, user, "_c"))
    lo = F.col("_c").cast("long") * F.lit(chunk_rows)
    hi = F.least(lo + F.lit(chunk_rows), F.col("_total")) - 1
    return chunks.withColumn(name, F.explode(F.sequence(lo, hi))).drop("_c", "_total")


def _parts_for(df: DataFrame, rows: Column) -> int:
    """Partitions for ``sum(rows)`` generated rows: one per core at least,
    and about ``ROWS_PER_TASK`` rows each (one aggregate, one number)."""
    total = df.select(F.sum(rows)).first()[0] or 0
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(cores, -(-int(total) // ROWS_PER_TASK))


def likely_draws(tests: Column, seen: Column, n_pool: int, n_all: int) -> Column:
    """Draws out of ``n_all`` that almost surely hold ``tests`` unseen items: their mean and
    four standard deviations (null if all are seen)."""
    odds = F.when(seen < n_pool, F.lit(float(n_all)) / (F.lit(n_pool) - seen))
    return F.ceil(tests * odds + 4 * F.sqrt(tests * odds * (odds - 1))).cast("long") + 2


def scoring_instances(test: DataFrame, train: DataFrame, pool_items: DataFrame,
                      seed: int = 42, user: str = "reviewerID_int",
                      item: str = "productID_int",
                      group_rows: int = DEFAULT_GROUP_ROWS) -> DataFrame:
    """``user, item, is_negative`` for users with test and train rows: all
    test rows (repeats kept) and ``min(t, unseen pool)`` sampled unseen pool items."""
    pool = dense_index(pool_items.select(item), item, "_idx")
    n_pool = pool.count()
    a, b = sides(n_pool)

    # id tables are written before they are joined: both sides of the join are then plain
    # shuffles, and Spark can split a user with very many rows
    train_users = materialize(train.select(user).distinct(), "negatives-train-users")
    tests = materialize(test.join(train_users, user, "left_semi"), "negatives-tests")
    seen = materialize(train.select(user, item).unionByName(tests.select(user, item)).distinct()
                       .join(pool, item).select(user, "_idx"), "negatives-seen")
    counts = (tests.select(user, F.lit(1).alias("_t"), F.lit(0).alias("_s"))
              .unionByName(seen.select(user, F.lit(0).alias("_t"), F.lit(1).alias("_s")))
              .groupBy(user).agg(F.sum("_t").alias("_t"), F.sum("_s").alias("_s"))
              .where(F.col("_t") > 0))
    draws_needed = F.least(F.lit(a * b), F.col("_t") + F.col("_s") + F.lit(a * b - n_pool))
    first = F.least(draws_needed, likely_draws(F.col("_t"), F.col("_s"), n_pool, a * b))
    need = materialize(counts.select(
        user, "_t", draws_needed.alias("_n"), first.alias("_first"),
        F.least(F.col("_t"), F.lit(n_pool) - F.col("_s")).alias("_want")), "negatives-need")

    # tables between the rounds are written only if there can be a second one
    later = need.where(F.col("_first") < F.col("_n"))
    keep = (lambda df, name: df) if later.isEmpty() else materialize

    def unseen(users: DataFrame, start: Column, total: Column) -> DataFrame:
        made = _chunked_range(users.withColumn("_from", start), user, total, "_k", group_rows,
                              _parts_for(users, total))
        number = F.col("_from") + F.col("_k")
        draws = keep(made.select(user, "_t", number.alias("_k"), permuted(
            number, user, a, b, seed).alias("_idx")), "negatives-draws")
        return keep(draws.where(F.col("_idx") < n_pool).join(seen, [user, "_idx"], "left_anti"),
                    "negatives-fresh")

    fresh = unseen(need, F.lit(0), F.col("_first"))
    if keep is materialize:
        found = fresh.groupBy(user).agg(F.count(F.lit(1)).alias("_found"))
        short = materialize(later.join(found, user, "left").where(
            F.coalesce("_found", F.lit(0)) < F.col("_want")).drop("_found"), "negatives-short")
        if not short.isEmpty():
            fresh = fresh.unionByName(unseen(short, F.col("_first"), F.col("_n") - F.col("_first")))
    fresh = fresh.withColumn("_b", F.floor(F.col("_k") / F.lit(group_rows)))
    chosen = key_rank(fresh, [user], "_b", [F.col("_k")], "_r").where(F.col("_r") < F.col("_t"))
    negatives = chosen.select(user, "_idx").join(pool, "_idx").select(user, item)
    return (tests.select(user, item, F.lit(False).alias("is_negative"))
            .unionByName(negatives.withColumn("is_negative", F.lit(True))))
