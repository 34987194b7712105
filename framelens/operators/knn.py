"""Exact k-nearest-neighbour search without comparing every pair.

Training vectors belong to cells around pivots, and a large cell is cut into rings by the distance to its pivot. Such a
unit has a lower bound of its distance to any query: the triangle inequality on both sides of the ring, and half of what
its pivot is farther away than the nearest one. The search takes two passes. In the first a query meets the few units
that lie nearest and hold ``k`` rows, which gives a true k-th distance. In the second it meets only the units that this
distance does not rule out, and only rows within it are sent on. Distances are one matrix product per block; what may be
among the best is measured again term by term, so small distances are exact.

Units are joined with their queries by shuffle; a ring of copies and a unit that many queries ask for are cut into blocks
by hash. A training side of at most ``BLOCK_ROWS`` rows is sent to the queries instead.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from framelens.operators.series import drop_stage, stage

#: Pivots that reach the driver: about the root of the training rows, and no more than these, in number and bytes.
MAX_PIVOTS, PIVOT_BYTES = 65_536, 16 << 20
#: Rings of all cells together, beyond one for each cell.
MAX_UNITS = 1 << 18
BLOCK_ROWS = 4_096
#: Numbers of a matrix that a task holds at once.
MATRIX = 1 << 21
SLACK = 1e-6


def vector(columns: list[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in columns])


def standardize(train: DataFrame, others: list[DataFrame], columns: list[str]) -> list[DataFrame]:
    """Zero mean and unit population deviation of the training rows; constant columns are only centred."""
    stats = train.agg(*[F.avg(c).alias(f"m_{c}") for c in columns],
                      *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    scaled = {c: (F.col(c) - F.lit(float(stats[f"m_{c}"]))) / F.lit(float(stats[f"s_{c}"]) or 1.0) for c in columns}
    return [df.withColumns(scaled) for df in (train, *others)]


def _squares(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    return (points**2).sum(1)[:, None] + (others**2).sum(1)[None, :] - 2.0 * points @ others.T


def _distances(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(_squares(points, others), 0.0))


def _pieces(rows: int, width: int) -> Iterator[slice]:
    step = max(1, MATRIX // max(1, width))
    return (slice(lo, min(rows, lo + step)) for lo in range(0, rows, step))


class Pivots:
    """Points on two levels: ``fine`` ones in groups around ``coarse`` ones, so that a vector is placed without being
    measured against all of them."""

    def __init__(self, points: np.ndarray):
        points = np.unique(points, axis=0)
        picked = np.random.default_rng(0).permutation(len(points))[:math.isqrt(len(points) - 1) + 1]
        near = np.concatenate([_distances(points[p], points[picked]).argmin(1) for p in _pieces(len(points), len(picked))])
        used, near = np.unique(near, return_inverse=True)
        order = np.argsort(near, kind="stable")
        self.coarse, self.fine, self.group = points[picked[used]], points[order], near[order]
        self.starts = np.searchsorted(self.group, np.arange(len(used) + 1))

    def place(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The fine pivot nearest in the group of the nearest coarse one, and the distance to it."""
        group = _distances(points, self.coarse).argmin(1)
        cell = np.zeros(len(points), np.int64)
        for g in np.unique(group):
            own = np.flatnonzero(group == g)
            cell[own] = self.starts[g] + _distances(points[own], self.fine[self.starts[g]:self.starts[g + 1]]).argmin(1)
        return cell, np.sqrt(((points - self.fine[cell]) ** 2).sum(1))


class Units:
    """Rings of cells with their number of rows and the least and greatest distance to the pivot."""

    def __init__(self, pivots: Pivots, cell: np.ndarray, rows: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        self.pivots, self.cell, self.rows, self.lo, self.hi = pivots, cell, rows, lo, hi
        #: No training vector is longer.
        self.longest = float(np.sqrt((pivots.fine**2).sum(1)).max() + hi.max())

    def bounds(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every point and unit: no row of the unit is nearer, and none is farther."""
        p = self.pivots
        coarse, fine = _distances(points, p.coarse), _distances(points, p.fine)
        plane = (coarse - coarse.min(1, keepdims=True))[:, p.group]
        np.maximum(plane, fine - np.minimum.reduceat(fine, p.starts[:-1], axis=1)[:, p.group], out=plane)
        d = fine[:, self.cell]
        low = np.maximum(np.maximum(d - self.hi, self.lo - d), plane[:, self.cell] / 2.0)
        return np.maximum(low, 0.0), d + self.hi

    def home(self, points: np.ndarray, k: int) -> list[np.ndarray]:
        """The nearest units of every point that hold ``k`` rows together."""
        out = []
        for piece in _pieces(len(points), len(self.rows) + len(self.pivots.fine)):
            low, high = self.bounds(points[piece])
            rank = low + 1e-3 * high
            for row in rank:
                few = np.argpartition(row, 63)[:64] if len(row) > 64 else np.arange(len(row))
                if self.rows[few].sum() < k:
                    few = np.arange(len(row))
                few = few[np.argsort(row[few], kind="stable")]
                out.append(few[:int(np.searchsorted(np.cumsum(self.rows[few]), k)) + 1].astype(np.int32))
        return out

    def rest(self, points: np.ndarray, kth: np.ndarray, home: list[np.ndarray]) -> list[np.ndarray]:
        """The units that may hold a row within ``kth`` of a point, without those it has met."""
        out = []
        slack = SLACK * (1.0 + np.sqrt((points**2).sum(1)) + self.longest)
        for piece in _pieces(len(points), len(self.rows) + len(self.pivots.fine)):
            open_ = self.bounds(points[piece])[0] <= (kth * (1.0 + SLACK) + slack)[piece, None]
            out += [np.setdiff1d(np.flatnonzero(row), met).astype(np.int32) for row, met in zip(open_, home[piece])]
        return out


def _matrix(vec: pd.Series) -> np.ndarray:
    return np.vstack(vec.to_numpy()).astype(float)


def _placed(train: DataFrame, pivots: Pivots) -> DataFrame:
    @F.pandas_udf("struct<cell:int,radius:double>")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for vec in batches:
            cell, radius = pivots.place(_matrix(vec)) if len(vec) else (np.zeros(0), np.zeros(0))
            yield pd.DataFrame({"cell": cell.astype("int32"), "radius": radius.astype(float)})

    return train.withColumn("_c", place("vec")).select("id", "vec", "_c.cell", "_c.radius")


def _at_home(queries: DataFrame, units: Units, k: int) -> DataFrame:
    @F.pandas_udf("array<int>")
    def home(vec: pd.Series) -> pd.Series:
        return pd.Series(units.home(_matrix(vec), k) if len(vec) else [], dtype=object)

    return queries.withColumn("home", home("vec"))


def _elsewhere(queries: DataFrame, units: Units) -> DataFrame:
    @F.pandas_udf("array<int>")
    def rest(vec: pd.Series, kth: pd.Series, home: pd.Series) -> pd.Series:
        return pd.Series(units.rest(_matrix(vec), kth.to_numpy(), home.tolist()) if len(vec) else [], dtype=object)

    return queries.withColumn("rest", rest("vec", "kth", "home"))


def _best(points: np.ndarray, limits: np.ndarray, names: np.ndarray, base: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Places of points, places of the ``k`` best rows within a point's limit, distances and ranks."""
    code = np.unique(names, return_inverse=True)[1]
    at = min(k, len(base)) - 1
    for piece in _pieces(len(points), len(base)):
        some = points[piece]
        near = _squares(some, base)
        bound = np.minimum(np.partition(near, at, axis=1)[:, at], limits[piece] ** 2)
        bound += 1e-9 * ((some**2).sum(1) + (base**2).sum(1).max())
        i, j = np.nonzero(near <= bound[:, None])
        d = np.concatenate([np.sqrt(((base[j[p]] - some[i[p]]) ** 2).sum(1)) for p in _pieces(len(i), base.shape[1])] or [np.zeros(0)])
        order = np.lexsort((code[j], d, i))
        i, j, d = i[order], j[order], d[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i) + 1
        keep = rank <= k
        yield piece.start + i[keep], j[keep], d[keep], rank[keep]


def _types(queries: DataFrame, train: DataFrame) -> str:
    q, t = (df.schema["id"].dataType.simpleString() for df in (queries, train))
    return f"query_id {q}, train_id {t}, distance double"


def _with_few(queries: DataFrame, train: DataFrame, k: int) -> DataFrame:
    """All training rows, few as they are, meet the queries where these are."""
    rows = train.toPandas()  # BLOCK_ROWS rows at most
    names, base = rows["id"].to_numpy(), _matrix(rows["vec"])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                points, asked = _matrix(pdf["vec"]), pdf["id"].to_numpy()
                for i, j, d, rank in _best(points, np.full(len(points), np.inf), names, base, k):
                    yield pd.DataFrame({"query_id": asked[i], "train_id": names[j], "distance": d, "rank": rank})

    return queries.mapInPandas(compare, _types(queries, train) + ", rank int")


def _met(routes: DataFrame, train: DataFrame, counts: DataFrame, k: int, block_rows: int) -> DataFrame:
    """The best rows of every ``(id, vec, kth, unit)`` route within ``kth``, block by block. ``counts`` has the rows and
    routes of every unit."""
    blocks = counts.select("unit", *[F.ceil(F.col(c) / F.lit(float(block_rows))).cast("int").alias(b) for c, b in (("rows", "tb"), ("routes", "qb"))])
    dealt = lambda df, own, other, o, p: (df.join(F.broadcast(blocks), "unit").withColumn(o, F.pmod(F.xxhash64("id"), F.col(own)).cast("int"))
                                          .withColumn(p, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("tb", "qb"))
    left, right = dealt(routes, "qb", "tb", "_q", "_t"), dealt(train, "tb", "qb", "_t", "_q")

    def compare(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(t):
            asked, names = q["id"].to_numpy(), t["id"].to_numpy()
            for i, j, d, _ in _best(_matrix(q["vec"]), q["kth"].to_numpy(), names, _matrix(t["vec"]), k):
                out.append(pd.DataFrame({"query_id": asked[i], "train_id": names[j], "distance": d}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "train_id": [], "distance": []})

    on = ["unit", "_q", "_t"]
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(compare, _types(routes, train))


def _ranked(near: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("distance", "train_id")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest_neighbours(queries: DataFrame, train: DataFrame, k: int, *, max_pivots: int = MAX_PIVOTS,
                       block_rows: int = BLOCK_ROWS, report: dict | None = None) -> DataFrame:
    """The ``k`` nearest ``(id, vec)`` rows of ``train`` for every ``(id, vec)`` row of ``queries``, which has every id once.

    Columns: ``query_id``, ``train_id``, ``distance``, ``rank``; ties go to the smaller id. Rows without a vector are left
    out; nothing is near if there are no training rows. ``report`` receives the numbers of units and of compared pairs.
    """
    spark = train.sparkSession
    train = stage(train.select("id", "vec").filter("vec IS NOT NULL"))
    queries = queries.select("id", "vec").filter("vec IS NOT NULL")
    n = train.count()
    if n == 0:
        return spark.createDataFrame([], _types(queries, train) + ", rank int")
    if n <= block_rows:
        return _with_few(queries, train, k)
    width = len(train.first()["vec"])
    wanted = max(1, min(max_pivots, math.isqrt(n), PIVOT_BYTES // (8 * width)))
    picked = train.orderBy(F.xxhash64("id"), "id").limit(wanted).select("vec").collect()
    pivots = Pivots(np.array([r["vec"] for r in picked], dtype=float))
    celled = stage(_placed(train, pivots))
    drop_stage(train)
    most = max(1, MAX_UNITS // len(pivots.fine))
    cells = celled.groupBy("cell").agg(
        F.least(F.ceil(F.count(F.lit(1)) / F.lit(float(block_rows))), F.lit(most)).cast("int").alias("cuts"), F.max("radius").alias("widest"))
    ring = F.when(F.col("widest") > 0, F.least(F.floor(F.col("radius") / F.col("widest") * F.col("cuts")), F.col("cuts") - 1)).otherwise(0)
    ringed = stage(celled.join(F.broadcast(cells), "cell").select("id", "vec", "radius", "cell", ring.cast("int").alias("ring")))
    facts = ringed.groupBy("cell", "ring").agg(F.count(F.lit(1)).alias("rows"), F.min("radius").alias("lo"), F.max("radius").alias("hi")
                                               ).toPandas().sort_values(["cell", "ring"])  # MAX_UNITS and one for each cell at most
    units = Units(pivots, *[facts[c].to_numpy() for c in ("cell", "rows", "lo", "hi")])
    facts["unit"] = np.arange(len(facts))
    table = spark.createDataFrame(facts[["unit", "cell", "ring", "rows"]], "unit int, cell int, ring int, rows long")
    named = ringed.join(F.broadcast(table), ["cell", "ring"]).select("id", "vec", "unit")

    def meet(routes: DataFrame) -> DataFrame:
        asked = routes.groupBy("unit").agg(F.count(F.lit(1)).alias("routes")).join(F.broadcast(table), "unit")
        counts = stage(asked.select("unit", "rows", "routes"))
        if report is not None:
            total = counts.agg(F.sum(F.col("rows") * F.col("routes")).alias("n")).first()["n"] or 0
            report.update(units=len(facts), compared=report.get("compared", 0) + total)
        return stage(_met(routes, named, counts, k, block_rows))

    homes = stage(_at_home(queries, units, k))
    first = meet(homes.select("id", "vec", F.lit(float("inf")).alias("kth"), F.explode("home").alias("unit")))
    last = F.max(F.when(F.col("rank") == k, F.col("distance")))
    bound = _ranked(first, k).groupBy("query_id").agg(F.coalesce(last, F.lit(float("inf"))).alias("kth"))
    known = homes.join(bound, F.col("id") == F.col("query_id")).drop("query_id")
    further = stage(_elsewhere(known, units).select("id", "vec", "kth", F.explode("rest").alias("unit")))
    second = meet(further)
    drop_stage(celled, homes, further)
    return _ranked(first.unionByName(second), k)


def vote(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """Share of each label per query, weighted by inverse distance; a zero distance outweighs all others.

    ``labels`` has ``train_id`` and ``label``.
    """
    zero = F.min("distance").over(Window.partitionBy("query_id")) == 0
    weight = F.when(zero, F.when(F.col("distance") == 0, 1.0).otherwise(0.0)).otherwise(1.0 / F.col("distance"))
    weighed = neighbours.withColumn("weight", weight).join(labels, "train_id")
    sums = weighed.groupBy("query_id", "label").agg(F.sum("weight").alias("weight"))
    total = F.sum("weight").over(Window.partitionBy("query_id"))
    return sums.withColumn("share", F.col("weight") / total)


def classify(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """Label with the largest vote per query; on a tie the first in name order."""
    shares = vote(neighbours, labels)
    best = F.min(F.struct((-F.col("weight")).alias("w"), F.col("label").alias("label")))
    return shares.groupBy("query_id").agg(best.alias("_b")).select("query_id", F.col("_b.label").alias("predicted_label"))
