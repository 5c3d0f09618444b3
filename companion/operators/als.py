"""Matrix-factorisation recommender on Spark MLlib's ALS.

Training, scoring and the per-user top-K all run distributed: MLlib's
block ALS shuffles factor blocks, scoring is ``model.transform`` (a join of
instances with factors), and the top-K is a group-limited window.

A fitted model is two relations (``factor_tables``), which makes it checkable and usable
without MLlib: ``score_factors`` scores instances by two joins and a dot product, and
``normal_equations`` tells for every trained user whether its factors solve the least
squares problem that ALS solves last.
"""

from __future__ import annotations

from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from companion.operators.ranking import DEFAULT_GROUP_ROWS, top_k_per_key
from companion.session import checkpoint_dir, materialize, scratch_path

# Fixed values of the reference's model.
RANK = 12
MAX_ITER = 10
REG_PARAM = 0.05
MIN_BLOCKS = 8
BLOCK_NUMBERS = 1 << 26
# Iterations between two checkpoints of the factors, each of which cuts their lineage.  Two
# shuffles of every iteration since the last one stay on disk, and either holds a row's factors
# once for every block of the other side that rates with it: many times the factors themselves.
CHECKPOINT_INTERVAL = 1


def fit_als(train: DataFrame, rank: int = RANK, max_iter: int = MAX_ITER,
            reg_param: float = REG_PARAM, seed: int = 42,
            user: str = "reviewerID_int", item: str = "productID_int",
            rating: str = "prodRating", num_blocks: int | None = None,
            checkpoint_interval: int = CHECKPOINT_INTERVAL) -> ALSModel:
    """Explicit-feedback ALS; unscorable (cold-start) rows are dropped.

    Factor lineage is checkpointed to the shared folder every
    ``checkpoint_interval`` iterations, so long runs survive executor loss
    without recomputing from the first iteration, and shuffles of earlier ones are removed."""
    checkpoint_dir(train.sparkSession)
    blocks = num_blocks or factor_blocks(train.count(), rank)
    als = ALS(rank=rank, maxIter=max_iter, regParam=reg_param, userCol=user,
              itemCol=item, ratingCol=rating, coldStartStrategy="drop", seed=seed,
              numUserBlocks=blocks, numItemBlocks=blocks,
              checkpointInterval=checkpoint_interval)
    return als.fit(train)


def factor_blocks(n_ratings: int, rank: int) -> int:
    """User and item blocks for ``n_ratings``: about ``BLOCK_NUMBERS`` ratings and factor
    entries in a block, and no fewer than ``MIN_BLOCKS``.  Blocks are messaged pairwise,
    so their number follows the data and not the number of cores."""
    return max(MIN_BLOCKS, -(-n_ratings * (rank + 2) // BLOCK_NUMBERS))


def stored_model(model: ALSModel, spark: SparkSession) -> ALSModel:
    """``model`` written to the shared folder and read back.  A fitted model refers to its
    shuffles and blocks of ratings, which stay on disk as long as it lives; a read one doesn't."""
    path = scratch_path(spark, "als-model")
    model.write().save(path)
    return ALSModel.load(path)


def predict(model: ALSModel, instances: DataFrame) -> DataFrame:
    """Predicted rating per instance row; rows without factors drop out."""
    return model.transform(instances).where(~F.isnan("prediction"))


def factor_tables(model: ALSModel) -> tuple[DataFrame, DataFrame]:
    """The model as written relations ``id, factors``: one row per trained user, one per
    trained item."""
    return (materialize(model.userFactors.select("id", F.col("features").alias("factors")),
                        "als-user-factors"),
            materialize(model.itemFactors.select("id", F.col("features").alias("factors")),
                        "als-item-factors"))


def dot(a: Column, b: Column) -> Column:
    """Dot product of two float arrays, summed in floats and in order, as the model does."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0).cast("float"),
                       lambda total, x: (total + x).cast("float"))


def score_factors(users: DataFrame, items: DataFrame, instances: DataFrame,
                  user: str = "reviewerID_int", item: str = "productID_int") -> DataFrame:
    """``instances`` with ``prediction`` from the factor relations.  Rows whose user or item has
    no factors drop out (inner joins), and so do those without a number (as in ``predict``)."""
    u = users.select(F.col("id").alias(user), F.col("factors").alias("_u"))
    v = items.select(F.col("id").alias(item), F.col("factors").alias("_v"))
    scored = instances.join(v, item).join(u, user).withColumn("prediction", dot(F.col("_u"), F.col("_v")))
    return scored.where(~F.isnan("prediction")).select(*instances.columns, "prediction")


def normal_equations(users: DataFrame, items: DataFrame, train: DataFrame, rank: int = RANK,
                     reg_param: float = REG_PARAM, tolerance: float = 1e-5,
                     user: str = "reviewerID_int", item: str = "productID_int",
                     rating: str = "prodRating", hot_ratings: int = DEFAULT_GROUP_ROWS) -> DataFrame:
    """``user, n_ratings, residual, solved``: how well each trained user's factors ``u`` solve

        (sum v v' + reg_param * n * I) u = sum rating * v

    over the user's ``n`` ratings, ``v`` being the item's factors.  ALS computes user factors
    last, so all users of a fitted model solve it up to the factors' single precision.
    ``residual`` is the largest entry of the difference, relative to the size of the terms.

    The sums are ``rank * (rank + 3) / 2`` numbers per user, many times a rating's own bytes, and
    most users have but a few ratings in any task.  So these ratings are dealt by user, with the
    item's factors in floats, and summed where they meet; no sums are shuffled.  Users with over
    ``hot_ratings`` ratings are summed by partial aggregates: one with a third of all ratings
    sends one row per task."""
    pairs = [(i, j) for i in range(rank) for j in range(i, rank)]
    v = items.select(F.col("id").alias(item), F.col("factors").alias("_v"))
    at = [F.col("_v")[i] for i in range(rank)]

    def summed(rated: DataFrame) -> DataFrame:
        return rated.withColumn("_v", F.col("_v").cast("array<double>")).groupBy(user).agg(
            F.count(F.lit(1)).alias("n_ratings"),
            F.array(*[F.sum(at[i] * at[j]) for i, j in pairs]).alias("_gram"),
            F.array(*[F.sum(F.col(rating) * at[i]) for i in range(rank)]).alias("_right"))

    hot = materialize(train.groupBy(user).agg(F.count(F.lit(1)).alias("_n")).where(
        F.col("_n") > hot_ratings).select(user), "als-hot-users")
    most = train.join(hot, user, "left_anti").select(user, item, rating)
    sums = summed(most.join(v, item).select(user, rating, "_v").repartition(user))
    if not hot.isEmpty():
        sums = sums.unionByName(summed(train.join(hot, user, "left_semi").join(v, item)))
    u = users.select(F.col("id").alias(user), F.col("factors").cast("array<double>").alias("_u"))
    place = {pair: k for k, pair in enumerate(pairs)}

    def term(i: int, j: int) -> Column:
        return F.col("_gram")[place[min(i, j), max(i, j)]] * F.col("_u")[j]

    ridge = F.lit(reg_param) * F.col("n_ratings")
    gaps, sizes = [], []
    for i in range(rank):
        terms = [term(i, j) for j in range(rank)] + [ridge * F.col("_u")[i], -F.col("_right")[i]]
        gaps.append(F.abs(sum(terms[1:], terms[0])))
        sizes.append(sum((F.abs(x) for x in terms[1:]), F.abs(terms[0])))
    largest, size = F.array_max(F.array(*gaps)), F.array_max(F.array(*sizes))
    residual = F.when(size > 0, largest / size).otherwise(largest)
    found = sums.join(u, user).select(user, F.col("n_ratings").cast("long").alias("n_ratings"),
                                      residual.alias("residual"))
    return found.withColumn("solved", F.col("residual") <= F.lit(tolerance))


def recommend(predictions: DataFrame, k: int, user: str = "reviewerID_int",
              item: str = "productID_int") -> DataFrame:
    """``user, pos, item, prediction``: the K highest predictions per user
    (ties by item id)."""
    return top_k_per_key(predictions, [user], [F.col("prediction").desc(), F.col(item)],
                         k, pos_col="pos").select(user, "pos", item, "prediction")
