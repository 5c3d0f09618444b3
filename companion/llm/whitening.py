"""Embedding whitening by a bidiagonal qd solver.

Every entry c becomes the integer x = floor(64 * c) + 1000000.  The rows are centred,
projected on the eigenvectors of their covariance and scaled to unit variance.

Method: tasks reduce their centred rows block by block with QR decompositions to one
triangle R each, and triangles are reduced in a tree, so R'R is n times the covariance
without its condition number being squared.  R is made bidiagonal by Householder
reflections; dqds (the differential quotient-difference algorithm with shifts) finds the
squared singular values of the bidiagonal to high relative accuracy; a twisted
factorisation of B'B - e, glued where its pivot is least, gives each eigenvector, and
the reflections carry it back to the whitening directions.

Scale: the vectors are read for the sums, for the triangles, for the check of the
result and for the result itself, each time in one pass without a shuffle of rows; what
is shuffled is one triangle (dimensions squared) per task, reduced ``FAN`` at a time.
The driver solves one matrix of dimensions by dimensions.  The means are exact: sums
are integers, and a row is centred by an integer shift and a remainder below one.

Defined cases: rows whose vector is null, empty or holds null or non-finite entries take no
part, nor do rows with an entry of 2 ** 46 or more (no exact integer arithmetic), nor rows
whose length is not the most frequent one (of ties the smallest).  Repeated rows and ids count
as they stand, a null id stays null.  Directions along which the rows don't vary (singular
value below ``FLAT`` times the largest) can't be scaled to unit variance and give no row:
a table of one row or of equal rows gives none.  A deviation beyond a long is null.  An empty
table gives no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from companion.session import materialize

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
LARGEST = float(1 << 46)
HALF = 1 << 30                # sums are kept in two parts: multiples of HALF, and the rest
FAN = 32                      # triangles that a task reduces at a time
ROWS_AT_ONCE = 4096
FLAT = 1e-11
EPS = np.finfo(float).eps
CLOSE = 1e-6                  # relative gap below which eigenvalues are a cluster


# --- the solver -------------------------------------------------------------------------

def triangle(rows: np.ndarray) -> np.ndarray:
    """R of the QR decomposition, filled up to a square."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))])


def reflection(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Unit v and the value a so that (1 - 2 v v') x = a e1."""
    size = np.linalg.norm(x)
    if size == 0.0:
        return np.zeros_like(x), 0.0
    a = -math.copysign(size, x[0])
    v = x / size
    v[0] -= a / size
    return v / np.linalg.norm(v), a


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal, and the right factor V: r = U B V'."""
    a = np.array(r, dtype=np.float64)
    n = len(a)
    right = np.eye(n)
    for k in range(n):
        v, value = reflection(a[k:, k])
        a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        a[k, k] = value
        if k + 2 < n:
            v, value = reflection(a[k, k + 1:])
            a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ v, v)
            right[:, k + 1:] -= 2 * np.outer(right[:, k + 1:] @ v, v)
            a[k, k + 1] = value
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def dqds_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One transform; None if the shift was beyond the least eigenvalue."""
    new_q, new_e = [], []
    d = q[0] - shift
    for k in range(len(e)):
        if d < 0.0:
            return None
        total = d + e[k]
        if total == 0.0:
            return None
        ratio = q[k + 1] / total
        new_q.append(total)
        new_e.append(e[k] * ratio)
        d = d * ratio - shift
    if not d >= 0.0:
        return None
    return new_q + [d], new_e


def pair_values(first: float, between: float, second: float) -> tuple[float, float]:
    """Both eigenvalues of a block of two rows, the larger one first."""
    half = (first + between + second) / 2
    large = half + math.sqrt(max(half * half - first * second, 0.0))
    return large, first * second / large


def squared_singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Eigenvalues of B'B, falling, by dqds with deflation."""
    q = [float(x) ** 2 for x in diagonal]
    e = [float(x) ** 2 for x in above]
    top = max(q + e, default=0.0)
    if top == 0.0:
        return np.zeros(len(q))
    floor = top * EPS ** 3                                # stands for zero
    q = [max(x, floor) for x in q]
    found: list[float] = []
    blocks = [(q, e, 0.0)]
    while blocks:
        q, e, sigma = blocks.pop()
        while len(q) > 2:
            weak = [k for k in range(len(e)) if e[k] <= EPS * EPS * (sigma + min(q[k], q[k + 1]))]
            if weak:                                      # couplings too small to matter
                k = weak[-1]
                blocks.append((q[:k + 1], e[:k], sigma))
                q, e = q[k + 1:], e[k + 1:]
                continue
            if q[0] < q[-1]:                              # small values move to the end
                q, e = q[::-1], e[::-1]
            shift = pair_values(q[-2], e[-1], q[-1])[1]   # of the last two rows
            for part in (0.999, 0.9, 0.6, 0.3, 0.1, 0.01, 0.0):
                done = dqds_step(q, e, part * shift)
                if done:
                    sigma += part * shift
                    break
            q, e = done
        found += [q[0] + sigma] if len(q) == 1 else [x + sigma for x in pair_values(q[0], e[0], q[1])]
    return np.sort(np.array(found))[::-1]


def twisted_vector(diagonal: np.ndarray, above: np.ndarray, value: float) -> np.ndarray:
    """Eigenvector of B'B by the twisted factorisation of B'B - value."""
    n = len(diagonal)
    tiny = max(float(np.max(diagonal ** 2)) * EPS ** 2, np.finfo(float).tiny * 1e10)
    d = np.maximum(diagonal ** 2, tiny)                   # B'B = L D L'
    ell = above * diagonal[:-1] / d[:-1]
    down, s = np.empty(n), np.empty(n)                    # L+ D+ L+': stationary, from the top
    lower = np.empty(max(n - 1, 0))
    s[0] = -value
    for k in range(n - 1):
        down[k] = s[k] + d[k]
        if abs(down[k]) < tiny:
            down[k] = -tiny
        lower[k] = d[k] * ell[k] / down[k]
        s[k + 1] = lower[k] * ell[k] * s[k] - value
    p = np.empty(n)                                       # U- D- U-': progressive, from the end
    upper = np.empty(max(n - 1, 0))
    p[-1] = d[-1] - value
    for k in range(n - 2, -1, -1):
        pivot = d[k] * ell[k] ** 2 + p[k + 1]
        if abs(pivot) < tiny:
            pivot = -tiny
        upper[k] = ell[k] * d[k] / pivot
        p[k] = p[k + 1] * d[k] / pivot - value
    twist = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[twist] = 1.0
    for k in range(twist - 1, -1, -1):
        z[k] = -lower[k] * z[k + 1]
    for k in range(twist, n - 1):
        z[k + 1] = -upper[k] * z[k]
    return z / np.linalg.norm(z)


def eigenvectors(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Columns for the falling ``values``; in clusters, vectors are made orthogonal and
    improved by inverse iteration from seeded starts."""
    n = len(diagonal)
    b = np.diag(diagonal) + np.diag(above, 1)
    t = b.T @ b
    out = np.empty((n, len(values)))
    start = 0                                             # of the present cluster
    for k, value in enumerate(values):
        z = twisted_vector(diagonal, above, value)
        if k and values[k - 1] - value > CLOSE * values[0]:
            start = k
        others = out[:, start:k]
        if start < k:
            rng = np.random.default_rng(k)
            z -= others @ (others.T @ z)
            for _ in range(4):
                size = np.linalg.norm(z)
                if not size > 1e-3:
                    z = rng.normal(size=n)
                    z -= others @ (others.T @ z)
                    size = np.linalg.norm(z)
                z = np.linalg.solve(t - (value * (1 + 4 * EPS * (k - start)) + EPS * values[0]) * np.eye(n), z / size)
                z /= np.linalg.norm(z)
                z -= others @ (others.T @ z)
                z -= others @ (others.T @ z)
            z /= np.linalg.norm(z)
        out[:, k] = z
    return out


def directions(r: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Unit eigenvectors (columns) and eigenvalues of the covariance R'R / n, falling, as far
    as the rows vary, and the covariance's trace."""
    diagonal, above, right = bidiagonal(r)
    squares = squared_singular_values(diagonal, above)
    kept = squares[:most]
    kept = kept[kept > FLAT ** 2 * squares[0]] if squares[0] > 0 else kept[:0]
    vectors = right @ eigenvectors(diagonal, above, kept)
    return vectors, kept / n, float((r * r).sum()) / n


# --- over Spark -------------------------------------------------------------------------

def usable(vectors: DataFrame, vector: str, vec_id: str) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part but for their length."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))
    return rows.filter(F.coalesce(fine, F.lit(False)) & (F.size("vector") > 0))


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, integers) of at most ``ROWS_AT_ONCE`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            lists = part.column("vector")
            values = lists.flatten().to_numpy(zero_copy_only=False)
            x = np.floor(SCALE * values).astype(np.int64) + SHIFT
            yield part.column("vec_id"), x.reshape(len(lists), -1)


class Centre:
    """Exact means, as an integer shift and a remainder below one."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n, self.sums = n, sums
        self.shift = np.array([s // n for s in sums], dtype=np.int64)
        self.rest = np.array([s % n / n for s in sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.shift).astype(np.float64) - self.rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S) ** 2, exact: in longs where they hold it."""
        size = float(np.abs(self.centred(x)).max(initial=0.0)) + 1.0
        if size * self.n < 2 ** 30 and (size * self.n) ** 2 * x.shape[1] < 2 ** 62:
            moved = self.n * (x - self.shift) - np.array([s % self.n for s in self.sums])
            return (moved * moved).sum(axis=1).tolist()
        out = []
        for row in x.tolist():
            total = sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums))
            out.append(total if total < 1 << 63 else None)
        return out


def exact_centre(rows: DataFrame, length: int) -> Centre | None:
    """Numbers and sums by dimension: a row per task and dimension, added up by Spark."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(length, np.int64), np.zeros(length, np.int64)
        for _, x in blocks_of(batches):
            n += len(x)
            high += (x // HALF).sum(axis=0)
            low += (x % HALF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({
                "pos": pa.array(range(length), pa.int32()), "n": pa.array([n] * length, pa.int64()),
                "high": pa.array(high), "low": pa.array(low)})

    sums = rows.mapInArrow(partial, "pos int, n long, high long, low long").groupBy("pos").agg(
        *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")])
    found = {r.pos: r for r in sums.collect()}             # as many rows as dimensions
    if not found:
        return None
    return Centre(int(found[0].n), [int(found[k].high) * HALF + int(found[k].low) for k in range(length)])


def reduced(parts: DataFrame, combine) -> DataFrame:
    """(part, n, values) rows reduced ``FAN`` at a time to one, by ``combine`` of two."""
    def together(key, frame):
        n, values = None, None
        for row in frame.sort_values("part").itertuples():
            mine = np.array(row.values_)
            n, values = (row.n, mine) if values is None else combine(n, values, row.n, mine)
        frame = frame.head(1).copy()
        frame["part"], frame["n"], frame["values_"] = key[0], n, [values]
        return frame

    parts = materialize(parts, "whitening-parts")
    while parts.count() > 1:
        group = F.floor(F.col("part") / FAN).cast("long").alias("group")
        parts = materialize(parts.groupBy(group).applyInPandas(together, parts.schema), "whitening-parts")
    return parts


PART = "part long, n long, values_ array<double>"


def one_part(n: int, values: np.ndarray) -> pa.RecordBatch:
    task = TaskContext.get().partitionId()
    return pa.RecordBatch.from_pydict({
        "part": pa.array([task], pa.int64()), "n": pa.array([n], pa.int64()),
        "values_": pa.array([values.ravel().tolist()], pa.list_(pa.float64()))})


def common_triangle(rows: DataFrame, centre: Centre, length: int) -> np.ndarray:
    """R of all centred rows."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, r = 0, np.zeros((0, length))
        for _, x in blocks_of(batches):
            n += len(x)
            r = triangle(np.vstack([r, centre.centred(x)]))
        if n:
            yield one_part(n, r)

    def combine(n, a, m, b):
        return n + m, triangle(np.vstack([a.reshape(-1, length), b.reshape(-1, length)])).ravel()

    (found,) = reduced(rows.mapInArrow(partial, PART), combine).collect()
    return np.array(found.values_).reshape(length, length)


def whitened_rows(centre: Centre, vectors: np.ndarray, values: np.ndarray, x: np.ndarray) -> np.ndarray:
    return centre.centred(x) @ vectors / np.sqrt(values)


def identity_error(rows: DataFrame, centre: Centre, vectors: np.ndarray, values: np.ndarray) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity: tasks
    centre their rows before multiplying, and means and products of two tasks are merged."""
    width = len(values)

    def merge(n, a, m, b):
        apart = b[:width] - a[:width]
        mean = a[:width] + apart * (m / (n + m))
        return n + m, np.concatenate([mean, a[width:] + b[width:] + (np.outer(apart, apart) * (
            n * m / (n + m))).ravel()])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for _, x in blocks_of(batches):
            w = whitened_rows(centre, vectors, values, x)
            mean = w.mean(axis=0)
            mine = np.concatenate([mean, ((w - mean).T @ (w - mean)).ravel()])
            n, total = (len(w), mine) if total is None else merge(n, total, len(w), mine)
        if n:
            yield one_part(n, total)

    (found,) = reduced(rows.mapInArrow(partial, PART), merge).collect()
    covariance = np.array(found.values_)[width:].reshape(width, width) / found.n
    return float(np.abs(covariance - np.eye(width)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS, vector: str = "embedding",
           vec_id: str = "vec_id") -> DataFrame:
    """Per row that takes part and component: vec_id, component (from 1, by falling variance),
    n, deviation, whitened, explained, identity_error."""
    given = usable(vectors, vector, vec_id)
    sizes = given.groupBy(F.size("vector").alias("length")).count()
    usual = sizes.orderBy(F.desc("count"), "length").first()
    schema = (f"vec_id {given.schema['vec_id'].dataType.simpleString()}, component int, n long, "
              "deviation long, whitened double, explained double, identity_error double")
    if usual is None:
        return vectors.sparkSession.createDataFrame([], schema)
    length = usual.length
    rows = given.filter(F.size("vector") == length)
    centre = exact_centre(rows, length)
    axes, values, trace = directions(common_triangle(rows, centre, length), centre.n, components)
    width = len(values)
    if width == 0:
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(rows, centre, axes, values)
    explained = values / trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in blocks_of(batches):
            w = whitened_rows(centre, axes, values, x)
            each = np.repeat(np.arange(len(x)), width)
            yield pa.RecordBatch.from_pydict({
                "vec_id": ids.take(pa.array(each)),
                "component": pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(x))),
                "n": pa.array(np.full(len(each), centre.n)),
                "deviation": pa.array(centre.deviations(x), pa.int64()).take(pa.array(each)),
                "whitened": pa.array(w.ravel()), "explained": pa.array(np.tile(explained, len(x))),
                "identity_error": pa.array(np.full(len(each), error))})

    return rows.mapInArrow(project, schema)

