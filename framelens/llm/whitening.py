"""Whitening of embeddings by the leading principal components of their covariance.

Every entry becomes a whole number, so counts and sums are exact and do not depend on the order of the rows. The
covariance is taken in a second pass over vectors centred at the rounded mean; the rest of the centring, below one half
per dimension, is a rank-one term without cancellation. A task adds its vectors into one matrix, and the matrices of all
tasks are added row by row in two steps, so no group holds more than the rows of one step.

The matrix of d x d numbers is solved on the driver: Householder reflections make it tridiagonal, bisection on Sturm
counts finds the leading eigenvalues, and inverse iteration their vectors, made orthogonal within clusters of close
eigenvalues. The projection (k vectors) is broadcast. Driver and broadcast depend on the dimension only.

Vectors that are null or hold null or non-finite entries are dropped. All others must share one dimension: the most
frequent one counts (the longer of equally frequent ones) and vectors of other lengths are dropped as well. Entries are
held within +-2**40 after scaling. Repeated rows count again; a null id is kept. Components whose eigenvalue is zero to
working precision have ``whitened`` null and are left out of ``identity_error``, which is null if there is none;
``explained`` is null if nothing varies. A ``deviation`` beyond 64 bits is null. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from framelens.llm.common import in_slices

SCALE, SHIFT, HELD = 1024.0, 100_000, float(1 << 40)
#: Vectors added up at once, and groups in which the tasks' matrices are added first.
ROWS, STEPS = 8192, 64
EPS = np.finfo(np.float64).eps


# --- symmetric eigenproblem, leading part -------------------------------------------------------------------------


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Diagonal, side diagonal and the Householder vectors (first index, unit vector) that bring ``a`` there."""
    a, mirrors = np.array(a, np.float64), []
    d = len(a)
    for k in range(d - 2):
        x = a[k + 1:, k].copy()
        top = np.abs(x[1:]).max()
        if top == 0.0:
            continue
        unit = max(top, abs(x[0]))
        x /= unit
        x[0] += np.copysign(np.sqrt(x @ x), x[0])
        u = x / np.sqrt(x @ x)
        # (I - 2uu') A (I - 2uu') on the rest of the matrix as one update of rank two
        p = a[k + 1:, k + 1:] @ u
        w = 2.0 * (p - (u @ p) * u)
        a[k + 1:, k + 1:] -= np.outer(u, w) + np.outer(w, u)
        side = a[k + 1:, k] - 2.0 * (u @ a[k + 1:, k]) * u
        a[k + 1:, k] = a[k, k + 1:] = side
        mirrors.append((k + 1, u))
    return np.diag(a).copy(), np.diag(a, 1).copy(), mirrors


def above(diag: np.ndarray, side: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues are greater than each ``x``: positive pivots of T - x, that is the Sturm count."""
    least = EPS * max(np.abs(diag).max(), np.abs(side).max(initial=0.0), np.finfo(np.float64).tiny / EPS)
    squares = np.concatenate([[0.0], side * side])
    q, count = np.ones_like(x), np.zeros(len(x), np.int64)
    for i in range(len(diag)):
        q = diag[i] - x - squares[i] / q
        q = np.where(np.abs(q) < least, -least, q)
        count += q > 0
    return count


def leading_values(diag: np.ndarray, side: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` greatest eigenvalues, falling, each bisected until its interval no longer shrinks."""
    reach = np.zeros(len(diag))
    reach[:-1] += np.abs(side)
    reach[1:] += np.abs(side)
    low, high = float((diag - reach).min()), float((diag + reach).max())
    pad = 4 * EPS * max(abs(low), abs(high))
    lo, hi = np.full(k, low - pad), np.full(k, high + pad)
    rank = np.arange(k)
    while True:
        mid = lo + (hi - lo) / 2
        if ((mid <= lo) | (mid >= hi)).all():
            return mid
        more = above(diag, side, mid) > rank  # the eigenvalue of that rank lies above mid
        lo, hi = np.where(more, mid, lo), np.where(more, hi, mid)


def solve_shifted(diag: np.ndarray, side: np.ndarray, x: float):
    """A function that solves (T - x) y = b by elimination with row exchanges; zero pivots become tiny ones."""
    n = len(diag)
    tiny = EPS * max(np.abs(diag).max(), np.abs(side).max(initial=0.0)) or np.finfo(np.float64).tiny
    main, up, up2 = (diag - x).tolist(), side.tolist() + [0.0], [0.0] * n
    low, factor, swapped = side.tolist(), [0.0] * n, [False] * n
    for i in range(n - 1):
        if abs(low[i]) > abs(main[i]):
            swapped[i] = True
            main[i], low[i] = low[i], main[i]
            up[i], main[i + 1] = main[i + 1], up[i]
            up2[i], up[i + 1] = up[i + 1], 0.0
        main[i] = main[i] or tiny
        factor[i] = low[i] / main[i]
        main[i + 1] -= factor[i] * up[i]
        up[i + 1] -= factor[i] * up2[i]
    if abs(main[-1]) < tiny:
        main[-1] = tiny

    def solve(b: np.ndarray) -> np.ndarray:
        y = b.tolist()
        for i in range(n - 1):
            if swapped[i]:
                y[i], y[i + 1] = y[i + 1], y[i]
            y[i + 1] -= factor[i] * y[i]
        for i in range(n - 1, -1, -1):
            s = y[i]
            if i + 1 < n:
                s -= up[i] * y[i + 1]
            if i + 2 < n:
                s -= up2[i] * y[i + 2]
            y[i] = s / main[i]
        return np.array(y)

    return solve


def leading_components(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` greatest eigenvalues of the symmetric ``a``, falling, and their unit vectors as columns."""
    d = len(a)
    k, size = min(k, d), float(np.abs(a).max(initial=0.0))
    if k == 0 or size == 0.0:
        return np.zeros(k), np.eye(d)[:, :k]
    diag, side, mirrors = tridiagonal(a / size)
    values = leading_values(diag, side, k)
    rng, vectors = np.random.default_rng(1), np.zeros((d, k))
    norm = float(np.max(np.abs(diag)) + 2 * np.max(np.abs(side), initial=0.0))
    shift, first = values.copy(), 0
    for i in range(k):
        if i and values[i - 1] - values[i] > 1e-3 * norm:
            first = i  # a new cluster
        elif i and shift[i] >= shift[i - 1] - 10 * EPS * norm:
            shift[i] = shift[i - 1] - 10 * EPS * norm  # equal shifts would give the same vector
        solve = solve_shifted(diag, side, shift[i])
        v = rng.normal(size=d)
        for _ in range(6):
            v = solve(v / np.abs(v).max())
            for _ in range(2):  # twice is enough for orthogonality to working precision
                v -= vectors[:, first:i] @ (vectors[:, first:i].T @ v)
            v /= np.sqrt(v @ v)
        vectors[:, i] = v
    for start, u in reversed(mirrors):
        vectors[start:] -= 2.0 * np.outer(u, u @ vectors[start:])
    vectors /= np.sqrt((vectors * vectors).sum(axis=0))
    # Rayleigh quotients of the original matrix; the order of equal values may change by rounding
    values = ((a @ vectors) * vectors).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


# --- passes over the vectors --------------------------------------------------------------------------------------


def usable(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``vec_id, v`` of the rows whose vector has finite entries only."""
    v = F.col(vector).cast("array<double>")
    ok = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull() & ok)


def whole(vectors, d: int) -> np.ndarray:
    """Vectors as rows of whole numbers."""
    flat = np.concatenate([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.zeros(0)
    with np.errstate(over="ignore"):
        scaled = np.floor(SCALE * flat)
    return np.clip(scaled, -HELD, HELD).astype(np.int64).reshape(-1, d) + SHIFT


def sums(vectors: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of each dimension."""

    def run(batches):
        n, total = 0, [0] * d
        for pdf in in_slices(batches, ROWS):
            n += len(pdf)
            total = [a + b for a, b in zip(total, whole(pdf["v"], d).sum(axis=0).tolist())]
        if n:
            yield pd.DataFrame({"j": np.arange(d), "n": n, "s": [Decimal(s) for s in total]})

    parts = vectors.select("v").mapInPandas(run, "j int, n long, s decimal(38,0)")
    found = parts.groupBy("j").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s")).collect()  # d rows
    by = {r["j"]: r for r in found}
    return (by[0]["n"], [int(by[j]["s"]) for j in range(d)]) if by else (0, [0] * d)


def added(rows: DataFrame, d: int, made) -> np.ndarray:
    """Sum over all vectors of Y'Y, where ``made`` gives Y (a column per dimension of the result) for whole vectors.

    Each task sends the rows of its own sum. They are added in ``STEPS`` groups per row and then once more, in a fixed
    order, so a repeated task changes nothing.
    """
    size = made(np.zeros((0, d), np.int64)).shape[1]

    def run(batches):
        total = np.zeros((size, size))
        some = False
        for pdf in in_slices(batches, ROWS):
            y, some = made(whole(pdf["v"], d)), True
            total += y.T @ y
        if some:
            part = TaskContext.get().partitionId()
            yield pd.DataFrame({"i": np.arange(size), "part": part, "step": part % STEPS, "row": [r.tobytes() for r in total]})

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        total = np.frombuffer(b"".join(table["row"].to_pylist()), np.float64).reshape(-1, size).sum(axis=0)
        return pa.table({"i": table["i"][:1], "part": table["step"][:1].cast("int32"), "step": pa.array([0], pa.int32()),
                         "row": pa.array([total.tobytes()])})

    schema = "i int, part int, step int, row binary"
    parts = rows.select("v").mapInPandas(run, schema)
    for _ in range(2):
        parts = parts.groupBy("i", "step").applyInArrow(add, schema)
    out = np.zeros((size, size))
    for r in parts.select("i", "row").collect():  # one row per dimension
        out[r["i"]] = np.frombuffer(r["row"], np.float64)
    return out


@dataclass(frozen=True)
class Whitening:
    """Components as columns, with what centres and scales a vector of whole numbers."""

    n: int
    total: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def dim(self) -> int:
        return len(self.total)

    @property
    def centre(self) -> np.ndarray:
        """The rounded mean; whole numbers."""
        return np.array([round(Fraction(s, self.n)) for s in self.total], np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n) - round(Fraction(s, self.n))) for s in self.total])

    @property
    def varies(self) -> np.ndarray:
        """Components whose eigenvalue is more than rounding."""
        return self.values > self.dim * EPS * max(self.values.max(initial=0.0), 0.0)

    def project(self):
        """A function of whole vectors giving their whitened coordinates; not-a-number where nothing varies."""
        centre, rest = self.centre, self.rest
        scaled = np.full_like(self.vectors, np.nan)
        scaled[:, self.varies] = self.vectors[:, self.varies] / np.sqrt(self.values[self.varies])
        return lambda x: ((x - centre).astype(np.float64) - rest) @ scaled


def fit(vectors: DataFrame, k: int) -> Whitening:
    """Components of all ``vectors`` (``usable`` rows of one dimension)."""
    lengths = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = lengths[0]["d"] if lengths else 0
    if d == 0:
        return Whitening(0, (), np.zeros(0), np.zeros((0, 0)), 0.0)
    vectors = vectors.filter(F.size("v") == d)
    n, total = sums(vectors, d)
    blank = Whitening(n, tuple(total), np.zeros(0), np.zeros((d, 0)), 0.0)
    centre, rest = blank.centre, blank.rest
    covariance = added(vectors, d, lambda x: (x - centre).astype(np.float64)) / n - np.outer(rest, rest)
    values, components = leading_components(covariance, k)
    return Whitening(n, tuple(total), values, components, float(np.trace(covariance)))


def deviation(x: np.ndarray, n: int, total: np.ndarray | list[int]) -> list:
    """Sum over dimensions of (n x - S)^2 for each row; None beyond 64 bits."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, map(int, total)), default=0)
    if most < 1 << 62:
        r = n * x - np.array(total, np.int64)
        if x.shape[1] * int(np.abs(r).max(initial=0)) ** 2 < 1 << 63:
            return (r * r).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - np.array(total, object)) ** 2).sum(axis=1)
    return [int(s) if s < 1 << 63 else None for s in exact]


def whiten(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 8) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each vector and component."""
    schema = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    spark, vectors = rows.sparkSession, usable(rows, vec_id, vector)
    model = fit(vectors, k)
    if not model.n:
        return spark.createDataFrame([], schema)
    vectors, good = vectors.filter(F.size("v") == model.dim), model.varies
    shared = spark.sparkContext.broadcast(model)  # (k + 1) numbers per dimension
    error = None
    if good.any():
        project = model.project()
        gram = added(vectors, model.dim, lambda x: np.hstack([project(x)[:, good], np.ones((len(x), 1))])) / model.n
        error = float(np.abs(gram[:-1, :-1] - np.outer(gram[:-1, -1], gram[:-1, -1]) - np.eye(int(good.sum()))).max())
    count = len(model.values)
    explained = [float(v) / model.trace if model.trace > 0 else None for v in model.values]

    def run(batches):
        own = shared.value
        project = own.project()
        for pdf in in_slices(batches, ROWS):
            x = whole(pdf["v"], own.dim)
            w = project(x).reshape(-1)
            yield pd.DataFrame({
                "vec_id": pdf["vec_id"].astype("Int64").repeat(count).to_numpy(),
                "component": np.tile(np.arange(1, count + 1, dtype=np.int32), len(x)), "n": own.n,
                "deviation": pd.array(deviation(x, own.n, own.total), "Int64").repeat(count),
                "whitened": pd.array(w, pd.Float64Dtype()) if good.all() else pd.array(np.where(np.isnan(w), None, w), "Float64"),
                "explained": pd.array(explained * len(x), "Float64"), "identity_error": pd.array([error] * len(w), "Float64")})

    return vectors.mapInPandas(run, schema)
