"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables.

A table turns a vector by a pseudo-rotation (three rounds of seeded signs and a
fast Hadamard transform) and files it under the signed axis that it is nearest
to.  A query looks into its nearest axes of each of ``TABLES`` tables;
what it finds there is ranked again by the exact inner product in double
precision.  Inner products become angles by one more coordinate that lifts every
candidate to the largest norm of its band (zero for queries), so vectors need not
be unit.  A band holds norms within a factor of 2 ** (1 / ``BANDS``), so the added
coordinate stays the smaller part; every query probes every band of its length.

How many axes of a band a query probes is fitted: for a sample of ``FIT_QUERIES``
queries the exact neighbours are found in one pass over the rows, and a band gets the
fewest probes that would have met ``FIT_RECALL`` of the sample's neighbours in
it.  Neighbours among more rows are nearer, so the share of the rows that a
query looks at falls as the table grows, and a band of few long vectors, which are
neighbours at wide angles, is probed wider than the others.

Scale: index rows and queries meet by (length, band, table, axis), so each row is
shipped once per table and each query once per probe and band; there is no pass of
every query over every row.  Places with few rows share a group (about ``PIECE`` rows).  An axis that holds many rows is cut into pieces of about
``PIECE`` rows, and its queries into pieces of ``PIECE`` queries, each pair of
pieces a group of its own.  A piece returns at most ``k + 1`` rows per query.
Equal vectors give equal products, and ties go to smaller ids, so of each
distinct vector only the ``k + 1`` smallest ids are indexed and a distinct query
vector is searched once: a vector that a third of all rows share costs no more
than any other.  Nothing else is sampled and all rows are indexed.

A query that found fewer rows than it wants, while its length has more, searches again
with ``MORE_PROBES`` times the probes, and in the end all rows of its length, in the same
pieces: it returns ``k`` rows, or all candidates if they are fewer.

For a still larger collection raise ``polytopes``: the axes of several rotations are then
filed together, which squares the number of buckets.

Defined cases: null, empty or zero vectors and those holding null or non-finite
components take no part; nor do rows without id; vectors of different lengths
are not compared; rows that repeat an id count once, with their best product; a product
beyond the doubles is infinite with its sign, and ranks by id there; an empty table gives
no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from companion.session import materialize

TABLES = 24
PROBES = 4                    # of bands that hold no neighbour of the sample
FIT_QUERIES = 64
FIT_RECALL = 0.97
FEW = 40                      # neighbours of the sample in a band, below which all must be met
MORE_PROBES = 4               # factor of the probes of queries that found too little
AXES = 64
SEED = 17
PIECE = 4096
BANDS = 4                     # bands of norms per factor of two
NO_BAND = -1 << 20            # where rows are filed that are searched without a table
ROWS_AT_ONCE = 2048           # vectors that are rotated at a time


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of every row (length a power of two), orthonormal."""
    n = rows.shape[1]
    half = 1
    while half < n:
        rows = rows.reshape(len(rows), -1, 2, half)
        rows = np.stack([rows[:, :, 0] + rows[:, :, 1], rows[:, :, 0] - rows[:, :, 1]], axis=2)
        rows = rows.reshape(len(rows), n)
        half *= 2
    return rows / np.sqrt(n)


def rotations(rows: np.ndarray, table: int, seed: int) -> np.ndarray:
    signs = np.random.default_rng([seed, table]).choice([-1.0, 1.0], (3, rows.shape[1]))
    for sign in signs:
        rows = hadamard(rows * sign)
    return rows


def buckets(vectors: np.ndarray, lifts: np.ndarray, tables: int, probes: int, axes: int,
            polytopes: int, seed: int) -> np.ndarray:
    """(vector, table, probe) -> bucket number; the first probe is the vector's own."""
    width = 1 << int(vectors.shape[1]).bit_length()      # room for one more coordinate
    rows = np.zeros((len(vectors), width))
    rows[:, :vectors.shape[1]] = vectors
    rows[:, vectors.shape[1]] = lifts
    out = np.empty((len(vectors), tables, probes), dtype=np.int64)
    axes = min(axes, width)
    for table in range(tables):
        number = None
        for polytope in range(polytopes):
            turned = rotations(rows, table * polytopes + polytope, seed)[:, :axes]
            both = np.concatenate([turned, -turned], axis=1)
            if probes > 1 and polytope == polytopes - 1:
                best = np.argsort(-both, axis=1, kind="stable")[:, :probes]
            else:
                best = both.argmax(axis=1)[:, None]
            number = best if number is None else number * (2 * axes) + best
        if number.shape[1] < probes:                     # fewer axes than probes
            number = np.pad(number, ((0, 0), (0, probes - number.shape[1])), mode="edge")
        out[:, table] = number
    return out


def bucket_column(vector: Column, lift: Column, tables: int, probes: int, axes: int,
                  polytopes: int, seed: int) -> Column:
    """Array of (table, bucket, probe) per vector, ``probe`` from 0, the nearest axis first;
    ``lift`` is its added coordinate."""
    @F.arrow_udf("array<struct<table:int,bucket:long,probe:int>>")
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for lists, lifts in batches:
            lifted = lifts.to_numpy(zero_copy_only=False)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            sizes = np.diff(ends)
            out = np.empty((len(sizes), tables, probes), dtype=np.int64)
            for size in np.unique(sizes):
                chosen = np.flatnonzero(sizes == size)
                for at in range(0, len(chosen), ROWS_AT_ONCE):
                    some = chosen[at:at + ROWS_AT_ONCE]
                    block = values[ends[some][:, None] + np.arange(size)]
                    out[some] = buckets(block, lifted[some], tables, probes, axes, polytopes, seed)
            n = tables * probes
            table = np.tile(np.repeat(np.arange(tables, dtype=np.int32), probes), len(sizes))
            probe = np.tile(np.arange(probes, dtype=np.int32), len(sizes) * tables)
            places = pa.StructArray.from_arrays(
                [pa.array(table), pa.array(out.reshape(-1)), pa.array(probe)], ["table", "bucket", "probe"])
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * n, pa.int32()), places)

    return of(vector, lift)


def products(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each row for itself (equal rows give equal
    values).  Where doubles might overflow on the way, both sides are scaled first."""
    most = np.abs(query).max(initial=0.0), np.abs(rows).max(axis=1, initial=0.0)
    with np.errstate(over="ignore"):
        fits = most[0] * most[1].max(initial=0.0) * max(1, len(query)) < 1e300
    if fits:
        return (rows * query).sum(axis=1)
    small = np.where(most[1] > 0, most[1], 1.0)
    scaled = (rows / small[:, None] * (query / (most[0] or 1.0))).sum(axis=1)
    with np.errstate(over="ignore"):
        return np.where(scaled == 0, 0.0, scaled * most[0] * small)


def best_products(vectors: np.ndarray, index: np.ndarray, ids: np.ndarray, k: int):
    """(query, row, score) of the ``k`` best rows for every query, by query and rank."""
    most = np.abs(index).max(initial=0.0), np.abs(vectors).max(initial=0.0)
    with np.errstate(over="ignore"):
        fits = most[0] * most[1] * index.shape[1] < 1e300
    if len(index) > k and fits:
        product = vectors @ index.T
        # everything that could tie with the k-th: matrix products may round apart
        last = np.partition(product, -k, axis=1)[:, -k]
        scale = np.abs(product).max(axis=1)
        query, row = np.nonzero(product >= (last - 1e-9 * (1 + scale))[:, None])
        exact = (vectors[query] * index[row]).sum(axis=1)
    else:
        query, row = (a.ravel() for a in np.indices((len(vectors), len(index))))
        exact = np.concatenate([products(v, index) for v in vectors])
    order = np.lexsort((ids[row], -exact, query))
    query, row, exact = query[order], row[order], exact[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[keep], row[keep], exact[keep]


def rank_piece(k: int):
    """The ``k`` best rows for every query of a group, among the rows that share one of its
    places (table and bucket) in the group."""
    columns = {"query": "int64", "vec_id": "int64", "score": "float64"}

    def sorted_places(df: pd.DataFrame):
        code = df["bucket"].to_numpy() * (1 << 20) + df["table"].to_numpy()
        order = np.argsort(code, kind="stable")
        return code[order], np.stack(df["vector"].to_numpy())[order].astype(np.float64), order

    def rank(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(rows) and len(queries):
            row_code, index, order = sorted_places(rows)
            ids = rows["vec_id"].to_numpy()[order]
            query_code, vectors, order = sorted_places(queries)
            asked = queries["query"].to_numpy()[order]
            for code in np.unique(query_code):
                a, b = np.searchsorted(row_code, [code, code + 1])
                start, end = np.searchsorted(query_code, [code, code + 1])
                for at in range(start, end if a < b else start, 512):
                    stop = min(at + 512, end)
                    query, row, score = best_products(vectors[at:stop], index[a:b], ids[a:b], k)
                    parts.append((asked[at:stop][query], ids[a:b][row], score))
        if not parts:
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in columns.items()})
        query, vec_id, score = map(np.concatenate, zip(*parts))
        order = np.lexsort((vec_id, -score, query))
        query, vec_id, score = query[order], vec_id[order], score[order]
        # a row that several places share stands next to itself
        new = np.r_[True, (query[1:] != query[:-1]) | (vec_id[1:] != vec_id[:-1])]
        query, vec_id, score = query[new], vec_id[new], score[new]
        keep = np.arange(len(query)) - np.searchsorted(query, query) < k
        return pd.DataFrame(dict(zip(columns, (query[keep], vec_id[keep], score[keep]))))

    return rank


def fitted_probes(rows: DataFrame, sample: list, recall: float, k: int, tables: int, axes: int,
                  polytopes: int, seed: int) -> dict[tuple[int, int], int]:
    """(length, band) -> probes that meet ``recall`` of the sample's exact neighbours there.

    ``rows``: vec_id, vector, unit, lift, length, band; ``sample``: (vector, unit) of the queries.
    One pass: each task keeps the ``k + 1`` best rows of each sample query."""
    asked = [(np.array(r.vector), np.array(r.unit)) for r in sample]

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            parts = [] if held is None else [held]
            for number, (query, _) in enumerate(asked):
                some = batch[batch["length"] == len(query)]
                if len(some):
                    score = products(query, np.stack(some["vector"].to_numpy()))
                    top = np.lexsort((some["vec_id"].to_numpy(), -score))[:k + 1]
                    parts.append(some.iloc[top].drop(columns="vector").assign(query=number, score=score[top]))
            if parts:
                held = pd.concat(parts).sort_values(["query", "score", "vec_id"], ascending=[True, False, True])
                held = held.groupby("query").head(k + 1)
        if held is not None:
            yield held[["query", "score", "vec_id", "unit", "lift", "length", "band"]]

    near = rows.select("vec_id", "vector", "unit", "lift", "length", "band").mapInPandas(
        best, "query int, score double, vec_id long, unit array<double>, lift double, length int, band int")
    first = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found = near.withColumn("_place", F.row_number().over(first)).filter(
        F.col("_place") <= k + 1).collect()                # FIT_QUERIES * (k + 1) rows
    needed: dict[tuple[int, int], list[int]] = {}
    orders: dict[int, np.ndarray] = {}
    for r in found:
        if r.query not in orders:
            unit = asked[r.query][1][None, :]
            orders[r.query] = buckets(unit, np.zeros(1), tables, 2 * axes, axes, polytopes, seed)[0]
        own = buckets(np.array([r.unit]), np.array([r.lift]), tables, 1, axes, polytopes, seed)[0]
        met = orders[r.query] == own
        # with several polytopes a bucket may not be among the probes at all
        needed.setdefault((r.length, r.band), []).append(
            int(np.where(met.any(axis=1), met.argmax(axis=1), 2 * axes - 1).min()) + 1)
    return {band: max(n) if len(n) < FEW else int(np.quantile(n, recall, method="higher"))
            for band, n in needed.items()}


def usable(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(vec_id, vector as doubles, same) of the rows that take part; ``same`` is equal
    for equal vectors."""
    values = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), values.alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("vector", lambda x: x != 0)
    takes_part = F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)) & F.coalesce(
        some, F.lit(False))
    return rows.filter(takes_part).withColumn(
        "same", F.struct(F.xxhash64("vector"), F.hash("vector"), F.size("vector")))


def directions(rows: DataFrame) -> DataFrame:
    """Adds ``unit`` (the vector's direction) and ``log_norm`` (to base 2), finite for all
    finite vectors."""
    most = F.array_max(F.transform("vector", F.abs))
    near = rows.withColumn("_most", most).withColumn("_near", F.transform("vector", lambda x: x / F.col("_most")))
    size = F.sqrt(F.aggregate("_near", F.lit(0.0), lambda s, x: s + x * x))
    return near.withColumn("_size", size).withColumn(
        "unit", F.transform("_near", lambda x: x / F.col("_size"))).withColumn(
        "log_norm", F.log2("_most") + F.log2("_size")).drop("_most", "_near", "_size")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, tables: int = TABLES,
            probes: int | None = None, axes: int = AXES, polytopes: int = 1, seed: int = SEED,
            piece: int = PIECE, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """The ``k`` nearest rows found for every query: query_id, rank, vec_id, score.  ``probes``
    per table and band; if None, they are fitted."""
    rows = materialize(usable(vectors, vector, vec_id), "nearest-rows")
    asked = materialize(usable(queries, vector, vec_id).dropDuplicates(["vec_id", "same"]),
                        "nearest-queries")
    options = (axes, polytopes, seed)

    smallest = Window.partitionBy("same").orderBy("vec_id")
    kept = rows.dropDuplicates(["vec_id", "same"]).withColumn(
        "_place", F.row_number().over(smallest)).filter(F.col("_place") <= k + 1)
    # norms of about one value, a power of two above all, lie in the middle of a band
    kept = materialize(directions(kept).select(
        "vec_id", "vector", "unit", "log_norm", F.size("vector").alias("length"),
        F.round(F.col("log_norm") * BANDS).cast("int").alias("band")), "nearest-kept")
    bands = materialize(kept.groupBy("length", "band").agg(
        F.max("log_norm").alias("largest"), F.count("*").alias("n")), "nearest-bands")
    # of a unit vector, the coordinate that lifts it to the band's largest norm
    gap = F.pow(F.lit(4.0), F.col("largest") - F.col("log_norm")) - 1
    lifted = materialize(kept.join(bands.drop("n"), ["length", "band"]).withColumn(
        "lift", F.sqrt(F.greatest(gap, F.lit(0.0)))), "nearest-lifted")
    # a repeated id may ask with several vectors: queries have numbers of their own
    distinct = materialize(directions(asked.groupBy("same").agg(F.min("vector").alias("vector"))).withColumn(
        "query", F.monotonically_increasing_id()).withColumn("length", F.size("vector")), "nearest-distinct")
    probed = {}
    if probes is None:
        sample = distinct.orderBy(F.xxhash64("vector", F.lit(seed)), "query").limit(FIT_QUERIES + 1).select(
            "vector", "unit").collect()
        # a sample that is all queries can have all its neighbours
        recall = FIT_RECALL if len(sample) > FIT_QUERIES else 1.0
        probed = fitted_probes(lifted, sample[:FIT_QUERIES], recall, k, tables, *options) if sample else {}
    known = bands.collect()                                # BANDS for each factor of two and length
    counts = [(r.length, r.band, probed.get((r.length, r.band), probes or PROBES)) for r in known]
    # the places of a band are bundled into groups of about PIECE filed rows
    bundles = {(r.length, r.band): max(1, -(-r.n * tables // piece)) for r in known}
    hashed = materialize(lifted.select("vec_id", "vector", "length", "band", F.explode(bucket_column(
        F.col("unit"), F.col("lift"), tables, 1, *options)).alias("at")).select(
        "vec_id", "vector", "length", "band", "at.table", "at.bucket"), "nearest-index")
    nearest_first = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    place = ["length", "band", "table", "bucket"]

    def pieces(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*place).agg(F.ceil(F.count("*") / piece).cast("int").alias(name))

    def search(filed: DataFrame, probing: DataFrame) -> DataFrame:
        """The ``k + 1`` best of the rows that share a place with the query: query, vec_id, score."""
        # one row per place in use: how many pieces its rows and its queries have
        sizes = vectors.sparkSession.createDataFrame(
            [(*band, n) for band, n in bundles.items()], "length int, band int, bundles int")
        bundle = F.pmod(F.xxhash64("table", "bucket"), F.coalesce("bundles", F.lit(1))).alias("bundle")
        cuts = materialize(pieces(filed, "row_pieces").join(pieces(probing, "query_pieces"), place).join(
            sizes, ["length", "band"], "left").select(*place, "row_pieces", "query_pieces", bundle),
            "nearest-pieces")

        def grid(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
            mine = F.pmod(F.xxhash64(F.col(key)), F.col(own)).cast("int").alias(own[:-1])
            theirs = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other[:-1])
            return df.join(cuts, place).select(
                key, "vector", *place, F.col("bundle").cast("int").alias("bundle"), mine, theirs)

        left = grid(filed, "vec_id", "row_pieces", "query_pieces")
        right = grid(probing, "query", "query_pieces", "row_pieces")
        group = ["length", "band", "bundle", "row_piece", "query_piece"]
        found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(
            rank_piece(k + 1), "query long, vec_id long, score double")
        return first_ones(found)

    def first_ones(found: DataFrame) -> DataFrame:
        best = found.groupBy("query", "vec_id").agg(F.max("score").alias("score")).withColumn(
            "_place", F.row_number().over(nearest_first)).filter(F.col("_place") <= k + 1)
        return materialize(best.select("query", "vec_id", "score"), "nearest-best")

    def places_of(asking: DataFrame, factor: int) -> DataFrame:
        """The places that the queries probe, ``factor`` times those of each band."""
        wide = [(length, band, min(2 * axes, n * factor)) for length, band, n in counts]
        limits = vectors.sparkSession.createDataFrame(wide, "length int, band int, limit int")
        most = max((n for *_, n in wide), default=1)
        each = asking.select("query", "vector", "length", F.explode(bucket_column(
            F.col("unit"), F.lit(0.0), tables, most, *options)).alias("at")).select(
            "query", "vector", "length", "at.*")
        # short vectors have fewer axes than probes: the last one is then repeated
        return materialize(each.join(limits, "length").filter("probe < limit").select(
            "query", "vector", *place).distinct(), "nearest-probes")

    def everywhere(df: DataFrame, key: str) -> DataFrame:
        return df.select(key, "vector", "length", F.lit(NO_BAND).alias("band"), F.lit(-1).alias("table"),
                         F.lit(-1).cast("long").alias("bucket"))

    best = search(hashed, places_of(distinct, 1))
    # with one's own row, k + 1 of the distinct ids of a length, or all of them
    wanted = materialize(kept.groupBy("length").agg(F.least(
        F.count_distinct("vec_id"), F.lit(k + 1)).alias("wanted")), "nearest-wanted")
    short, factor, fewest = distinct, 1, min((n for *_, n in counts), default=1)
    while True:
        got = best.groupBy("query").agg(F.count("*").alias("n"))
        short = materialize(short.select(*distinct.columns).join(wanted, "length").join(
            got, "query", "left").filter(F.coalesce("n", F.lit(0)) < F.col("wanted")).select(
            *distinct.columns), "nearest-short")
        if short.isEmpty():
            break
        factor *= MORE_PROBES
        last = fewest * factor >= 2 * axes
        again = search(everywhere(kept, "vec_id"), everywhere(short, "query")) if last else search(
            hashed, places_of(short, factor))
        best = first_ones(best.union(again))
        if last:
            break
    members = materialize(
        asked.select(F.col("vec_id").alias("query_id"), "same").join(
            distinct.select("query", "same"), "same").select("query_id", "query"), "nearest-members")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # a repeated id may ask with several vectors: each candidate counts once
    pairs = members.join(best, "query").filter("vec_id <> query_id").groupBy(
        "query_id", "vec_id").agg(F.max("score").alias("score"))
    return pairs.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
