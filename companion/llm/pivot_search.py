"""Exact top-k search by inner product with a table of pivot distances.

Every component x becomes floor(64 * x), so scores are whole numbers.  One more
coordinate lifts every candidate to the largest norm of the table (zero for queries);
then a larger inner product is a smaller distance, and distances obey the triangle
inequality: |d(q, p) - d(x, p)| is at most d(q, x) for every pivot p.

Method: a bounded sample gives ``PIVOTS`` pivots far from each other, and every row
stores its distance to each.  The greatest of the lower bounds over all pivots bounds a
candidate's score from above.  A query evaluates candidates in the order of that bound and
stops for good where the bound falls below its k-th best score; what it hasn't evaluated
can't be among the k best.  Bounds carry a margin above their rounding error, and
scores are exact, so the result is that of a full scan.

Scale: rows are filed in cells (by nearest pivot and distance to it).  Of each cell
the least and greatest distance to every pivot are kept: a table of at most
``MAX_CELLS`` rows, whatever the input.  Each query first searches the cells
that promise most, until they hold ``FIRST_ROWS`` rows.  Its k-th best score there decides which of
the other cells can matter, and only to these it is shipped, with that score.  A cell is
cut into pieces of about ``PIECE`` rows, its queries into pieces of ``PIECE`` queries, and
each pair of pieces is a group of its own: no group grows with the data.  Where distances say
little (many dimensions, no clusters) all cells matter, and the work is that of
every query against every row; the contract makes queries a fixed share of the rows.
Of equal vectors only the k + 1 smallest ids are searched (ties go to smaller ids), and a query
vector that several rows share is searched once.

Defined cases: null vectors and those holding null or non-finite components take no
part, nor do rows without id; zero vectors do; vectors of different lengths are not
compared; rows that repeat an id count once, with their best score; scores beyond a
long stand at its limits and rank by id there; an empty table gives no rows; other
columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from companion.session import materialize

UNITS = 64
PIVOTS = 32
SAMPLE_ROWS = 2048            # rows among which pivots and ring borders are chosen
CELL_ROWS = 4096              # rows of a cell, as long as MAX_CELLS allows
MAX_CELLS = 1024
FIRST_ROWS = 2048             # candidates of a query before other cells are judged
PIECE = 4096
CHUNK = 64                    # candidates evaluated at first, then 8 times as many each time
MARGIN = 1e-9                 # of the squared distances, far above their rounding
LONG = np.iinfo(np.int64)


class Space:
    """The common space: vectors over ``scale``, filled up with zeros, lifted to ``norm``."""

    def __init__(self, width: int, scale: float, norm: float) -> None:
        self.width, self.scale, self.norm = width, scale or 1.0, norm

    def lifted(self, vectors: list[np.ndarray] | np.ndarray, candidates: bool) -> np.ndarray:
        out = np.zeros((len(vectors), self.width + 1))
        for row, vector in zip(out, vectors):
            row[:len(vector)] = vector
        out /= self.scale
        if candidates:
            squares = (out * out).sum(axis=1)
            out[:, -1] = np.sqrt(np.maximum(self.norm ** 2 - squares, 0.0))
        return out


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean, by differences: products would cancel for near points."""
    return np.stack([np.sqrt(((points - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def far_apart(points: np.ndarray, most: int) -> np.ndarray:
    """Greedy choice: each pivot is the point farthest from those before it."""
    chosen = [0]
    gap = distances(points, points[:1])[:, 0]
    while len(chosen) < most and gap.max(initial=0.0) > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, distances(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


class Cells:
    """Which cell a row belongs to: its nearest pivot among the first ``centres``, and the ring of
    its distance to it."""

    def __init__(self, far: np.ndarray, centres: int, rings: int) -> None:
        self.centres, self.rings = centres, rings
        nearest = far[:, :centres].argmin(axis=1)
        own = far[np.arange(len(far)), nearest]
        cuts = np.linspace(0, 1, rings + 1)[1:-1]
        self.borders = [np.quantile(own[nearest == c], cuts) if (nearest == c).any() else np.zeros(rings - 1)
                        for c in range(centres)]

    def of(self, far: np.ndarray) -> np.ndarray:
        nearest = far[:, :self.centres].argmin(axis=1)
        out = np.zeros(len(far), dtype=np.int64)
        for c in range(self.centres):
            mine = nearest == c
            out[mine] = c * self.rings + np.searchsorted(self.borders[c], far[mine, c])
        return out


def vectors_of(lists: pa.Array) -> list[np.ndarray]:
    values = lists.flatten().to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    return [values[a:b] for a, b in zip(ends, ends[1:])]


def distance_column(vector: Column, space: Space, pivots: np.ndarray, cells: Cells | None) -> Column:
    """Distances to the pivots, and for candidates (``cells`` given) the cell."""
    @F.arrow_udf("struct<far:array<double>,cell:int>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            points = space.lifted(vectors_of(lists), cells is not None)
            far = distances(points, pivots)
            cell = cells.of(far) if cells else np.zeros(len(far), dtype=np.int64)
            ends = pa.array(np.arange(len(far) + 1) * len(pivots), pa.int32())
            yield pa.StructArray.from_arrays(
                [pa.ListArray.from_arrays(ends, pa.array(far.ravel())), pa.array(cell, pa.int32())],
                ["far", "cell"])

    return of(vector)


def score_bound(space: Space, query_squares: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """The largest inner product at a distance of at least ``gap``, with the margin."""
    most = query_squares + space.norm ** 2
    return ((most - gap * gap) / 2 + MARGIN * (1 + most)) * space.scale * space.scale


def cells_column(vector: Column, far: Column, space: Space, summary: dict[str, np.ndarray],
                 first_rows: int) -> Column:
    """For every query its cells (cell, bound on the score, whether it is searched at first),
    best first."""
    @F.arrow_udf("array<struct<cell:int,bound:double,first:boolean>>")
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("cell", pa.int32()), ("bound", pa.float64()), ("first", pa.bool_())]))
        for lists, fars in batches:
            points = space.lifted(vectors_of(lists), False)
            distance = np.stack(vectors_of(fars)) if len(fars) else np.zeros((0, 1))
            out = []
            for square, d in zip((points * points).sum(axis=1), distance):
                gap = np.maximum(np.maximum(summary["least"] - d, d - summary["most"]), 0.0).max(axis=1)
                bound = score_bound(space, square, gap)
                order = np.argsort(-bound, kind="stable")
                before = np.cumsum(summary["rows"][order]) - summary["rows"][order]
                out.append([{"cell": c, "bound": b, "first": f} for c, b, f in zip(
                    summary["cell"][order].tolist(), bound[order].tolist(), (before < first_rows).tolist())])
            yield pa.array(out, kind)

    return of(vector, far)


def exact_type(*matrices: np.ndarray) -> type:
    """The smallest type that holds every sum of products of the rows exactly."""
    most = matrices[0].shape[1] * float(np.prod([np.abs(x).max(initial=0.0) for x in matrices]))
    return np.float32 if most < 2.0 ** 24 else np.float64 if most < 2.0 ** 53 else object


def exact_scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products as longs (of Python's whole numbers, at the limits of a long)."""
    if rows.dtype != object:
        return (rows @ query).astype(np.int64)
    return np.array([min(max(sum(a * b for a, b in zip(row, query)), LONG.min), LONG.max)
                     for row in rows], dtype=np.int64)


def search_piece(k: int, space: Space):
    """The ``k`` best rows of an index piece for every query of a query piece, none below the
    score that the query has already found ``k`` times."""
    columns = {"query": "int64", "vec_id": "int64", "score": "int64", "evaluated": "int64"}

    def search(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in columns.items()})
        index, asked = (np.stack(x["vector"].to_numpy()) for x in (rows, queries))
        ids, lifted = rows["vec_id"].to_numpy(), space.lifted(asked, False)
        squares = (lifted * lifted).sum(axis=1)
        exact = exact_type(index, asked)
        if exact is object:
            index, asked = (np.array([[int(v) for v in row] for row in x], dtype=object) for x in (index, asked))
        index, asked = index.astype(exact), asked.astype(exact)
        table = np.ascontiguousarray(np.stack(rows["far"].to_numpy()).T)        # a row per pivot
        gap, apart = np.empty(len(ids)), np.empty(len(ids))
        found = []
        for at, (far, least) in enumerate(zip(queries["far"], queries["least"])):
            gap.fill(0.0)
            for distance, own in zip(table, far):
                np.subtract(distance, own, out=apart)
                np.maximum(gap, np.abs(apart, out=apart), out=gap)
            bound = score_bound(space, squares[at], gap)
            threshold = -np.inf if np.isnan(least) else least
            order = np.flatnonzero(bound >= threshold)
            order = order[np.argsort(-bound[order])]
            # a query that knows a good score already evaluates more at a time
            done, size, best_ids, best = 0, CHUNK if np.isnan(least) else 8 * CHUNK, ids[:0], np.zeros(0, np.int64)
            while done < len(order) and bound[order[done]] >= threshold:
                some = order[done:done + size]
                score = exact_scores(index[some], asked[at])
                good = np.flatnonzero(score >= threshold)
                best, best_ids = np.append(best, score[good]), np.append(best_ids, ids[some[good]])
                if len(best) >= k:
                    kept = np.lexsort((best_ids, ~best))[:k]    # ~ falls as the score rises, -2**63 too
                    best, best_ids = best[kept], best_ids[kept]
                    # a double below the score, so that ties stay in
                    threshold = max(threshold, np.nextafter(float(best[-1]), -np.inf))
                done, size = done + len(some), size * 8
            found.append((np.full(len(best), queries["query"].iat[at]), best_ids, best,
                          np.full(len(best), done)))
        return pd.DataFrame(dict(zip(columns, map(np.concatenate, zip(*found))))).astype(columns)

    return search


def usable(vectors: DataFrame, vector: str, vec_id: str) -> DataFrame:
    """(vec_id, vector of whole numbers, as doubles) of the rows that take part."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"),
                          F.col(vector).cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    most = F.lit(float(np.finfo(np.float64).max))

    def whole(x: Column) -> Column:
        # above 2 ** 46 a double times 64 has no fraction; the greatest ones would overflow
        near = F.floor(F.when(F.abs(x) < 2.0 ** 46, x * UNITS).otherwise(F.lit(0.0))).cast("double")
        return F.when(F.abs(x) < 2.0 ** 46, near).otherwise(
            F.greatest(F.least(x * UNITS, most), -most))

    return rows.filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).select(
        "vec_id", F.transform("vector", whole).alias("vector"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, pivots: int = PIVOTS,
          cell_rows: int = CELL_ROWS, first_rows: int = FIRST_ROWS, piece: int = PIECE,
          vector: str = "embedding", vec_id: str = "vec_id", seed: int = 5) -> DataFrame:
    """The ``k`` rows with the largest inner products for every query: query_id, rank, vec_id,
    score."""
    asked = materialize(usable(queries, vector, vec_id).dropDuplicates(), "pivot-queries")
    smallest = Window.partitionBy("vector").orderBy("vec_id")
    kept = materialize(usable(vectors, vector, vec_id).dropDuplicates().withColumn(
        "_place", F.row_number().over(smallest)).filter(F.col("_place") <= k + 1).drop("_place"), "pivot-rows")
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    greatest = F.coalesce(F.array_max(F.transform("vector", F.abs)), F.lit(0.0))
    sizes = [df.agg(F.max(F.size("vector")).alias("width"), F.max(greatest).alias("scale"),
                    F.count("*").alias("n")).first() for df in (kept, asked)]
    if not sizes[0].n or not sizes[1].n:
        return empty
    scale = max(sizes[0].scale, sizes[1].scale) or 1.0
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + (x / scale) * (x / scale))
    norm = kept.agg(F.max(F.sqrt(squares)).alias("norm")).first().norm
    space = Space(max(sizes[0].width, sizes[1].width), scale, norm)
    sample = kept.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(SAMPLE_ROWS).collect()
    points = space.lifted([np.array(r.vector, dtype=np.float64) for r in sample], True)
    chosen = far_apart(points, pivots)
    wanted = min(MAX_CELLS, -(-sizes[0].n // cell_rows))
    centres = min(len(chosen), wanted)
    cells = Cells(distances(points, chosen), centres, -(-wanted // centres))

    length = F.size("vector").alias("length")
    index = materialize(kept.withColumn("table", distance_column(
        F.col("vector"), space, chosen, cells)).select("vec_id", "vector", length, "table.*"), "pivot-table")
    borders = [f(F.col("far")[p]).alias(f"{name}{p}") for name, f in (("least", F.min), ("most", F.max))
               for p in range(len(chosen))]
    table = index.groupBy("cell").agg(F.count("*").alias("rows"), *borders).collect()   # MAX_CELLS rows
    summary = {"cell": np.array([r.cell for r in table]), "rows": np.array([r.rows for r in table])}
    for name in ("least", "most"):
        summary[name] = np.array([[r[f"{name}{p}"] for p in range(len(chosen))] for r in table])

    # a repeated id may ask with several vectors: queries have numbers of their own
    distinct = materialize(asked.select("vector").dropDuplicates().withColumn(
        "query", F.monotonically_increasing_id()), "pivot-distinct")
    measured = distinct.withColumn("far", distance_column(
        F.col("vector"), space, chosen, None)["far"])
    planned = materialize(measured.select("query", "vector", length, "far", cells_column(
        F.col("vector"), F.col("far"), space, summary, first_rows).alias("cells")), "pivot-plan")

    def search(pairs: DataFrame) -> DataFrame:
        """query, vec_id, score of the best rows of (query, vector, length, far, least, cell)."""
        place = ["length", "cell"]
        cuts = materialize(index.groupBy(*place).agg(
            F.ceil(F.count("*") / piece).cast("int").alias("row_pieces")).join(
            pairs.groupBy(*place).agg(F.ceil(F.count("*") / piece).cast("int").alias("query_pieces")),
            place), "pivot-pieces")

        def grid(df: DataFrame, key: str, own: str, other: str, *more: str) -> DataFrame:
            mine = F.pmod(F.xxhash64(key), F.col(own)).cast("int").alias(own[:-1])
            theirs = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other[:-1])
            return df.join(cuts, place).select(key, "vector", "far", *more, *place, mine, theirs)

        left = grid(index, "vec_id", "row_pieces", "query_pieces")
        right = grid(pairs, "query", "query_pieces", "row_pieces", "least")
        group = [*place, "row_piece", "query_piece"]
        return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(
            search_piece(k + 1, space), "query long, vec_id long, score long, evaluated long")

    nearest_first = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")

    def best_of(found: DataFrame, name: str) -> DataFrame:
        best = found.groupBy("query", "vec_id").agg(F.max("score").alias("score"))
        return materialize(best.withColumn("_place", F.row_number().over(nearest_first)).filter(
            F.col("_place") <= k + 1), name)

    shipped = planned.select("query", "vector", "length", "far", F.explode("cells").alias("at")).select(
        "query", "vector", "length", "far", "at.*")
    some = best_of(search(shipped.filter("first").withColumn("least", F.lit(None).cast("double"))),
                   "pivot-first")
    # the (k + 1)-th best so far; a double may round it, the bound's margin is wider
    least = some.filter(F.col("_place") == k + 1).select("query", F.col("score").cast("double").alias("least"))
    rest = materialize(shipped.filter("not first").join(least, "query", "left").filter(
        "least IS NULL OR bound >= least"), "pivot-rest")
    best = best_of(some.drop("_place").union(search(rest).drop("evaluated")), "pivot-best")
    members = asked.withColumnRenamed("vec_id", "query_id").join(distinct, "vector").select(
        "query_id", "query")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    pairs = members.join(best, "query").filter("vec_id <> query_id").groupBy(
        "query_id", "vec_id").agg(F.max("score").alias("score"))
    return pairs.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
