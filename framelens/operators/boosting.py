"""Boosted trees, grown level by level for all open fits at once.

Rows are kept as bins of their features. A pass over them adds up, for every open fit, tree, node, feature and bin, the
statistics that decide the splits; tasks add them tree by tree and pick the splits of a level, which the driver sends with
the next pass. So the number of jobs follows depth times rounds, whatever the number of fits and classes. Margins are
written with the rows every ``KEEP`` rounds; in between a pass applies the few trees grown since.

A training side of at most ``WHOLE`` rows is grown by the same steps within one task, one task per fit: there a level is
a few sums over arrays, while a job for each level costs more than its sums until a side has about a million rows.

Three kinds of boosting share this:

* ``newton``: softmax loss, first and second derivatives, leaf -G / (H + penalty), children of a least weight; rows and
  features may be sampled per tree (Chen and Guestrin, 2016);
* ``residual``: trees fitted to the residuals of the softmax loss by squared error, leaves by one Newton step
  (Friedman, 2001);
* ``samme``: weighted classification trees, rows reweighted by the error of each (Zhu et al., 2009).

Splits lie at ``BINS`` - 1 quantiles of a feature at most. Missing values go to the right.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from framelens.operators.scoring import complete_probabilities
from framelens.operators.series import drop_stage, stage

BINS, KEEP, WHOLE = 64, 4, 500_000
#: Partial sums added at a time; more are first added group by group.
FEW = 32


@dataclass(frozen=True)
class Boost:
    """What is fitted: ``kind`` and its settings. ``rows`` and ``columns`` are the shares that a tree sees."""

    kind: str
    classes: int
    rounds: int
    depth: int
    rate: float
    penalty: float = 0.0
    least: float = 0.0
    rows: float = 1.0
    columns: float = 1.0
    seed: int = 42

    @property
    def trees(self) -> int:
        """Trees of a round."""
        return 1 if self.kind == "samme" else self.classes

    @property
    def stats(self) -> int:
        """Numbers summed per cell."""
        return {"newton": 2, "residual": 3, "samme": self.classes}[self.kind]


@dataclass
class Tree:
    """Nodes in heap order; ``feature`` is -1 at leaves, rows with a bin above ``cut`` go right."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n), np.zeros(n))

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        """The deepest node each row has reached so far."""
        node = np.zeros(len(bins), np.int64)
        while self.step(bins, node):
            pass
        return node

    def step(self, bins: np.ndarray, node: np.ndarray) -> bool:
        """Move the rows at inner nodes one level down; whether there were any."""
        feature = self.feature[node]
        rows = np.flatnonzero(feature >= 0)
        at = node[rows]
        node[rows] = 2 * at + 1 + (bins[rows, feature[rows]] > self.cut[at])
        return len(rows) > 0


@dataclass
class Round:
    """Trees of one round, with the weight of the round (``samme``)."""

    trees: list[Tree]
    weight: float = 1.0


@dataclass
class Growth:
    """A fit in progress; ``kept`` counts the rounds that the stored margins contain."""

    spec: Boost
    features: int
    rounds: list[Round] = field(default_factory=list)
    level: int = 0
    kept: int = 0
    over: bool = False
    wrong: float = 0.0
    mass: float = 0.0

    def __post_init__(self) -> None:
        if not self.rounds:
            self.open_round()

    def open_round(self) -> None:
        self.rounds.append(Round([Tree.empty(self.spec.depth) for _ in range(self.spec.trees)]))
        self.level, self.wrong = 0, 0.0

    def recent(self) -> Growth:
        """What a pass needs: the rounds that the stored margins lack."""
        return Growth(self.spec, self.features, self.rounds[self.kept:], self.level, self.kept, self.over)

    @property
    def done(self) -> int:
        """Finished rounds."""
        return len(self.rounds) - (not self.over)

    @property
    def cells(self) -> int:
        return self.spec.trees * 2**self.level * self.features * BINS * self.spec.stats


def _draw(order: np.ndarray, salt: int) -> np.ndarray:
    """A number in [0, 1) for each row, the same wherever the row is read."""
    z = order.astype(np.int64).view(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))).astype(np.float64) / 2.0**64


class Block:
    """Rows of one training side with the margins of one fit."""

    def __init__(self, bins: np.ndarray, code: np.ndarray, weight: np.ndarray, order: np.ndarray, margin: np.ndarray):
        self.bins, self.code, self.weight, self.order, self.margin = bins, code, weight, order, margin
        self.columns = np.ascontiguousarray(bins.T)

    def apply(self, spec: Boost, rounds: list[Round]) -> None:
        """Add finished rounds to the margins: scores per class, or the logarithm of the row's weight."""
        for r in rounds:
            self.add(spec, r, [tree.leaf(self.bins) for tree in r.trees])

    def add(self, spec: Boost, r: Round, nodes: list[np.ndarray]) -> None:
        """The same for one round, from the leaf of each row in each tree."""
        for k, (tree, node) in enumerate(zip(r.trees, nodes)):
            value = tree.value[node]
            if spec.kind == "samme":
                self.margin[:, 0] += r.weight * (value != self.code)
            else:
                self.margin[:, k] += spec.rate * value

    def statistics(self, spec: Boost, number: int) -> list[np.ndarray]:
        """Per tree of the round, the numbers to sum for each row."""
        own = np.eye(spec.classes)[self.code]
        if spec.kind == "samme":
            return [own * (self.weight * np.exp(self.margin[:, 0]))[:, None]]
        p = np.exp(self.margin - self.margin.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        w = self.weight
        if spec.rows < 1.0:
            w = w * (_draw(self.order, spec.seed + number) < spec.rows)
        r = own - p
        if spec.kind == "newton":
            return [np.stack([r[:, k] * w, np.maximum(2 * p[:, k] * (1 - p[:, k]), 1e-16) * w], axis=1) for k in range(spec.classes)]
        return [np.stack([r[:, k] * w, w, np.abs(r[:, k]) * (1 - np.abs(r[:, k])) * w], axis=1) for k in range(spec.classes)]

    def sums(self, spec: Boost, stats: list[np.ndarray], nodes: list[np.ndarray], level: int,
             counted: list[np.ndarray] | None = None, above: np.ndarray | None = None) -> np.ndarray:
        """trees x nodes x features x bins x statistics, over the rows that reach the level, from each row's ``stats`` and
        node in each tree.

        ``counted`` names the rows of each tree that may count, and is cut to those that do. Given the sums of the level
        ``above``, only the child with fewer rows is summed; its sibling is the rest.
        """
        d, first, width = self.bins.shape[1], 2**level - 1, 2**level
        out = np.empty((len(stats), width, d, BINS, spec.stats))
        counted = counted or [np.flatnonzero((own != 0).any(axis=1)) for own in stats]
        for t, (own, node) in enumerate(zip(stats, nodes)):
            here = counted[t] = counted[t][node[counted[t]] >= first]
            at = node[here] - first
            if above is not None:
                rows = np.bincount(at, minlength=width)
                other = np.arange(width) ^ 1
                rest = (rows > rows[other]) | ((rows == rows[other]) & (rows > 0) & (other < np.arange(width)))
                summed = ~rest[at]
                here, at = here[summed], at[summed]
            start, weights = at * BINS, own[here].T.copy()
            # By feature, so that the sums of one feature stay in the processor's cache.
            for f in range(d):
                cell = start + self.columns[f].take(here)
                for s in range(spec.stats):
                    out[t, :, f, :, s] = np.bincount(cell, weights[s], width * BINS).reshape(width, BINS)
            if above is not None:
                n = np.flatnonzero(rest)
                out[t, n] = above[t, n // 2] - out[t, n ^ 1]
        return out


def _worth(spec: Boost, s: np.ndarray) -> np.ndarray:
    """How well one leaf fits the rows summed up in ``s``; a split gains what its children are worth beyond it."""
    if spec.kind == "newton":
        return s[..., 0] ** 2 / (s[..., 1] + spec.penalty + 1e-300)
    if spec.kind == "residual":
        return s[..., 0] ** 2 / (s[..., 1] + 1e-300)
    return (s * s).sum(axis=-1) / (s.sum(axis=-1) + 1e-300)


def _value(spec: Boost, s: np.ndarray) -> np.ndarray:
    if spec.kind == "newton":
        return s[..., 0] / (s[..., 1] + spec.penalty + 1e-300)
    if spec.kind == "residual":
        return (spec.classes - 1) / spec.classes * s[..., 0] / np.where(s[..., 2] > 1e-150, s[..., 2], np.inf)
    return s.argmax(axis=-1).astype(np.float64)


def _mass(spec: Boost, s: np.ndarray) -> np.ndarray:
    return s[..., 1] if spec.kind != "samme" else s.sum(axis=-1)


#: Per node of a level: weight, whether and where it is split, the gain, values and errors of the node and its children.
_PICKED = 11


def best_splits(growth: Growth, number: int, tree: int, cells: np.ndarray) -> np.ndarray:
    """The best split of every node of a tree's current level, from the sums of its cells; ``number`` counts the rounds."""
    spec = growth.spec
    total = cells[:, 0].sum(axis=1)
    left = cells.cumsum(axis=2)[:, :, :-1]
    right = total[:, None, None] - left
    gain = _worth(spec, left) + _worth(spec, right) - _worth(spec, total)[:, None, None]
    small = max(spec.least, 1e-12 * float(_mass(spec, total).sum()))
    gain[(_mass(spec, left) < small) | (_mass(spec, right) < small)] = -np.inf
    if spec.columns < 1.0:
        rng, most = np.random.default_rng([spec.seed, number]), max(1, round(spec.columns * growth.features))
        gain[:, [rng.permutation(growth.features) for _ in range(tree + 1)][-1][most:]] = -np.inf
    flat = gain.reshape(len(gain), -1)
    # The first of equally good splits, however the sums were rounded.
    best = (flat >= flat.max(axis=1, keepdims=True) - 1e-9 * _worth(spec, total)[:, None]).argmax(axis=1)
    node = np.arange(len(flat))
    f, b = np.divmod(best, BINS - 1)
    won, ends = flat[node, best], (total, left[node, f, b], right[node, f, b])
    split = won > 1e-9 * np.maximum(1e-12, np.abs(_worth(spec, total)))
    wrong = [e.sum(axis=1) - e.max(axis=1) for e in ends]
    return np.stack([_mass(spec, total), split, f, b, won, *[_value(spec, e) for e in ends], *wrong], axis=1)


def split_level(growth: Growth, picked: list[np.ndarray]) -> None:
    """Set the splits of the current level, one array of ``best_splits`` a tree, and go on to the next level or round."""
    spec, trees, level = growth.spec, growth.rounds[-1].trees, growth.level
    first, error, mass = 2**level - 1, 0.0, 0.0
    for tree, nodes in zip(trees, picked):
        for node in np.flatnonzero(nodes[:, 0] > 0):
            _, split, f, b, won, value, *rest = nodes[node].tolist()
            at = first + node
            if level == 0:
                tree.value[at] = value
            if split:
                tree.feature[at], tree.cut[at], tree.gain[at] = f, b, won
                tree.value[2 * at + 1], tree.value[2 * at + 2] = rest[:2]
                error += sum(rest[3:]) if level == spec.depth - 1 else 0.0
            else:
                error += rest[2]
        mass = max(mass, float(nodes[:, 0].sum()))
    growth.wrong += error
    growth.mass = mass if level == 0 else growth.mass
    growth.level += 1
    if growth.level < spec.depth and any((t.feature[first:2 * first + 1] >= 0).any() for t in trees):
        return
    if spec.kind == "samme":
        wrong = growth.wrong / growth.mass
        if wrong >= 1.0 - 1.0 / spec.classes:
            growth.rounds.pop()
            growth.over = True
        elif wrong <= 1e-12:
            growth.over = True
        else:
            growth.rounds[-1].weight = spec.rate * (math.log((1.0 - wrong) / wrong) + math.log(spec.classes - 1.0))
    growth.over = growth.over or len(growth.rounds) >= spec.rounds
    if not growth.over:
        growth.open_round()


# --- plans --------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Side:
    """A training side: rows of ``features`` as doubles, ``code`` and ``weight``."""

    rows: DataFrame
    features: list[str]
    n: int


def cut_points(side: Side) -> list[list[float]]:
    """Quantiles of every feature, each value once."""
    shares = [(i + 1) / BINS for i in range(BINS - 1)]
    row = side.rows.agg(*[F.percentile_approx(F.when(~F.isnan(f), F.col(f)), shares, 10_000).alias(f) for f in side.features]).first()
    return [sorted(set(row[f] or [])) for f in side.features]


def to_bins(values: list[np.ndarray], cuts: list[list[float]]) -> np.ndarray:
    return np.stack([np.where(np.isnan(v), BINS - 1, np.searchsorted(np.array(c), v)) for v, c in zip(values, cuts)],
                    axis=1).astype(np.uint8)


def binned(side: Side, cuts: list[list[float]], name: int, width: int) -> DataFrame:
    """``side, bins, code, weight, place, margin`` of every row; margins of ``width`` numbers start at zero."""
    features, start = side.features, bytes(8 * width)

    def run(batches):
        for pdf in batches:
            bins = to_bins([pdf[f].to_numpy(np.float64, na_value=np.nan) for f in features], cuts)
            yield pd.DataFrame({"side": name, "bins": [b.tobytes() for b in bins], "code": pdf["code"].astype("int32"),
                                "weight": pdf["weight"], "place": pdf["place"], "margin": [start] * len(pdf)})

    # The place of a row among equal rows does not matter, so a hash of its values draws its samples.
    rows = side.rows.select(*features, "code", "weight", F.xxhash64(*features, "code").alias("place"))
    return rows.mapInPandas(run, "side int, bins binary, code int, weight double, place long, margin binary")


def _sides(pdf: pd.DataFrame, fits: list[tuple[int, Growth]]):
    """Per training side its rows, their margins, and the number, growth and block of each of its fits."""
    for name, rows in pdf.groupby("side", sort=False):
        bins = np.frombuffer(b"".join(rows["bins"]), np.uint8).reshape(len(rows), -1)
        margin = np.frombuffer(b"".join(rows["margin"]), np.float64).reshape(len(rows), -1).copy()
        rest = rows["code"].to_numpy(np.int64), rows["weight"].to_numpy(np.float64), rows["place"].to_numpy(np.int64)
        own, lo = [], 0
        for i, (side, g) in enumerate(fits):
            if side == name:
                own.append((i, g, Block(bins, *rest, margin[:, lo:lo + g.spec.classes])))
                lo += g.spec.classes
        yield rows, margin, own


def _added(table: pa.Table) -> tuple[dict, np.ndarray]:
    """Sum of the arrays of a group, in the order of the tasks, and the first row."""
    rows = table.sort_by("part").to_pylist()
    return rows[0], np.sum([np.frombuffer(r["sums"], np.float64) for r in rows], axis=0)


def _level(rows: DataFrame, fits: list[tuple[int, Growth]], parts: int) -> list[list[np.ndarray] | None]:
    """The best splits of the current level of every open fit, from one pass over the rows.

    Tasks' sums meet in Spark, tree by tree, and splits are chosen there: the driver gets a few numbers for each node.
    """
    sizes = [0 if g.over else g.cells for _, g in fits]
    starts = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    shared = rows.sparkSession.sparkContext.broadcast([(side, g.recent()) for side, g in fits])

    def chosen(fit: int, tree: int, sums: np.ndarray) -> bytes:
        g = shared.value[fit][1]
        cells = sums.reshape(2**g.level, g.features, BINS, g.spec.stats)
        return best_splits(g, g.kept + len(g.rounds), tree, cells).tobytes()

    def run(batches):
        total = np.zeros(starts[-1])
        for pdf in batches:
            for _, _, own in _sides(pdf, shared.value):
                for i, g, block in own:
                    if sizes[i]:
                        block.apply(g.spec, g.rounds[:-1])
                        stats = block.statistics(g.spec, g.kept + len(g.rounds) - 1)
                        found = block.sums(g.spec, stats, [t.leaf(block.bins) for t in g.rounds[-1].trees], g.level)
                        total[starts[i]:starts[i + 1]] += found.ravel()
        trees = [(i, t, sums) for i, (lo, hi) in enumerate(zip(starts, starts[1:])) if hi > lo
                 for t, sums in enumerate(total[lo:hi].reshape(shared.value[i][1].spec.trees, -1))]
        yield pd.DataFrame({"part": TaskContext.get().partitionId(), "fit": [i for i, _, _ in trees], "tree": [t for _, t, _ in trees],
                            "sums": [chosen(*t) if parts == 1 else t[2].tobytes() for t in trees]})

    def add(table: pa.Table) -> pa.Table:
        first, total = _added(table)
        return pa.Table.from_pylist([{**first, "part": first["part"] // FEW, "sums": total.tobytes()}], table.schema)

    def choose(table: pa.Table) -> pa.Table:
        first, total = _added(table)
        return pa.Table.from_pylist([{**first, "sums": chosen(first["fit"], first["tree"], total)}], table.schema)

    kinds, count = "part int, fit int, tree int, sums binary", parts
    found = rows.mapInPandas(run, kinds)
    while count > FEW:  # many are first added group by group
        found = found.groupBy(F.floor(F.col("part") / FEW).alias("_"), "fit", "tree").applyInArrow(add, kinds)
        count = -(-count // FEW)
    if parts > 1:
        found = found.groupBy("fit", "tree").applyInArrow(choose, kinds)
    picked = {(r["fit"], r["tree"]): np.frombuffer(r["sums"], np.float64).reshape(-1, _PICKED) for r in found.collect()}
    shared.unpersist()
    return [None if g.over else [picked[i, t] for t in range(g.spec.trees)] for i, (_, g) in enumerate(fits)]


def _kept(rows: DataFrame, fits: list[tuple[int, Growth]]) -> DataFrame:
    """The rows, with the finished rounds of every open fit in their margins."""
    shared = rows.sparkSession.sparkContext.broadcast([(side, g.recent()) for side, g in fits])

    def run(batches):
        for pdf in batches:
            for own_rows, margin, own in _sides(pdf, shared.value):
                for _, g, block in own:
                    if not g.over:
                        block.apply(g.spec, g.rounds[:-1])
                yield own_rows.assign(margin=[m.tobytes() for m in margin])

    out = stage(rows.mapInPandas(run, rows.schema))
    for _, g in fits:
        g.kept = g.kept if g.over else g.done
    return out


def grow_levels(rows: DataFrame, fits: list[tuple[int, Growth]]) -> None:
    """Grow all fits over the staged ``rows`` of their sides, one level of everything at a time."""
    parts = rows.rdd.getNumPartitions()
    while any(not g.over for _, g in fits):
        for (_, g), picked in zip(fits, _level(rows, fits, parts)):
            if picked is not None:
                split_level(g, picked)
        if any(not g.over and g.done - g.kept >= KEEP for _, g in fits):
            before, rows = rows, _kept(rows, fits)
            drop_stage(before)
            parts = rows.rdd.getNumPartitions()


def grow_whole(block: Block, growth: Growth) -> None:
    """Grow one fit over rows that are all at hand; they keep their nodes from level to level."""
    spec = growth.spec
    while not growth.over:
        at, trees = growth.done, growth.rounds[-1].trees
        stats, nodes = block.statistics(spec, at), [np.zeros(len(block.bins), np.int64) for _ in trees]
        counted, sums = [np.flatnonzero((own != 0).any(axis=1)) for own in stats], None
        while not growth.over and growth.rounds[-1].trees is trees:
            # Where children have a least weight, no leaf rests on what rounding leaves of a difference.
            sums = block.sums(spec, stats, nodes, growth.level, counted, sums if spec.least > 0 else None)
            split_level(growth, [best_splits(growth, len(growth.rounds), t, cells) for t, cells in enumerate(sums)])
            for tree, node in zip(trees, nodes):
                tree.step(block.bins, node)
        if growth.done > at:
            block.add(spec, growth.rounds[at], nodes)


_TREES = "fit int, round int, tree int, weight double, feature binary, cut binary, value binary, gain binary"


def tree_rows(fit: int, rounds: list[Round]) -> pd.DataFrame:
    rows = [(fit, i, k, r.weight, *(x.tobytes() for x in (t.feature, t.cut, t.value, t.gain)))
            for i, r in enumerate(rounds) for k, t in enumerate(r.trees)]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _TREES.split(", ")])


def from_rows(rows: list) -> list[Round]:
    out: list[Round] = []
    for r in sorted(rows, key=lambda r: (r["round"], r["tree"])):
        if r["round"] == len(out):
            out.append(Round([], r["weight"]))
        out[-1].trees.append(Tree(np.frombuffer(r["feature"], np.int32), np.frombuffer(r["cut"], np.int32),
                                  np.frombuffer(r["value"], np.float64), np.frombuffer(r["gain"], np.float64)))
    return out


def _in_one_task(rows: DataFrame, side: int, fit: int, spec: Boost, features: int) -> DataFrame:
    def run(batches):
        # Arrays and not objects are kept of each batch; the stored margins of a side are those of all its fits, and zero.
        parts = [[np.frombuffer(b"".join(pdf["bins"]), np.uint8).reshape(len(pdf), -1),
                  *(pdf[c].to_numpy(t) for c, t in (("code", np.int64), ("weight", np.float64), ("place", np.int64)))]
                 for pdf in batches if len(pdf)]
        growth = Growth(spec, features)
        if parts:
            columns = [np.concatenate(c) for c in zip(*parts)]
            parts.clear()
            grow_whole(Block(*columns, np.zeros((len(columns[0]), spec.classes))), growth)
        yield tree_rows(fit, growth.rounds[:growth.done])

    rows = rows.filter(F.col("side") == side).select("bins", "code", "weight", "place")
    return rows.coalesce(1).mapInPandas(run, _TREES)


def boost(wanted: list[tuple[Side, Boost]], whole: int = WHOLE) -> list[BoostedFit]:
    """Fit all ``wanted`` at once; sides are told apart by identity. Labels are given by ``BoostedFit.classes`` later."""
    sides = list({id(side): side for side, _ in wanted}.values())
    number = {id(side): i for i, side in enumerate(sides)}
    cuts = [cut_points(s) for s in sides]
    width = [sum(spec.classes for side, spec in wanted if side is s) for s in sides]
    tables = [binned(s, c, i, w) for i, (s, c, w) in enumerate(zip(sides, cuts, width))]
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    rows = stage(rows)
    fits = [(number[id(side)], Growth(spec, len(side.features))) for side, spec in wanted]
    small = [i for i, (side, _) in enumerate(wanted) if side.n <= whole]
    if small:
        tasks = [_in_one_task(rows, fits[i][0], i, wanted[i][1], len(wanted[i][0].features)) for i in small]
        all_trees = tasks[0]
        for t in tasks[1:]:
            all_trees = all_trees.unionByName(t)
        found: dict[int, list] = {}
        for r in all_trees.collect():  # the models
            found.setdefault(r["fit"], []).append(r)
        for i in small:
            fits[i][1].rounds, fits[i][1].over = from_rows(found.get(i, [])), True
    large = [f for i, f in enumerate(fits) if i not in set(small)]
    if large:
        # Margins lie in the order of the fits of a side, so those of finished fits stay in the list.
        grow_levels(rows, fits)
    drop_stage(rows)
    return [BoostedFit(spec, cuts[n], g.rounds[:g.done], side.features, []) for (side, spec), (n, g) in zip(wanted, fits)]


@dataclass
class BoostedFit:
    """A boosted model: trees over bins, and the quantiles that make the bins."""

    spec: Boost
    cuts: list[list[float]]
    rounds: list[Round]
    features: list[str]
    classes: list[str]

    def scores(self, values: list[np.ndarray]) -> np.ndarray:
        """Probability of each class for rows given by feature."""
        spec, bins = self.spec, to_bins(values, self.cuts)
        out = np.zeros((len(bins), spec.classes))
        for r in self.rounds:
            for k, tree in enumerate(r.trees):
                value = tree.value[tree.leaf(bins)]
                if spec.kind == "samme":
                    hit = value[:, None] == np.arange(spec.classes)
                    out += r.weight * np.where(hit, 1.0, -1.0 / max(1, spec.classes - 1))
                else:
                    out[:, k] += spec.rate * value
        if spec.kind == "samme":
            out /= (sum(r.weight for r in self.rounds) or 1.0) * max(1, spec.classes - 1)
        p = np.exp(out - out.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def predict(self, df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self)  # rounds x trees x nodes

        @F.pandas_udf("array<double>")
        def shares(rows: pd.Series) -> pd.Series:
            own = shared.value
            if not len(rows):
                return pd.Series([], dtype=object)
            x = np.vstack(rows.to_numpy()).astype(np.float64)
            return pd.Series(list(own.scores(list(x.T))))

        nan = F.lit(float("nan"))
        out = df.withColumn("_p", shares(F.array(*[F.coalesce(F.col(f).cast("double"), nan) for f in self.features])))
        best = F.array_position("_p", F.array_max("_p")).cast("int")
        out = out.withColumns({"predicted_label": F.element_at(F.array(*[F.lit(c) for c in self.classes]), best),
                               **{f"prob_{c}": F.get("_p", F.lit(i)) for i, c in enumerate(self.classes)}})
        return complete_probabilities(out.drop("_p"))

    def importances(self) -> list[float]:
        """Share of all gains that splits on each feature brought."""
        total = np.zeros(len(self.features))
        for r in self.rounds:
            for t in r.trees:
                some = t.feature >= 0
                np.add.at(total, t.feature[some], t.gain[some] * (r.weight if self.spec.kind == "samme" else 1.0))
        return list(total / total.sum()) if total.sum() else list(total)

    def save(self, spark: SparkSession, path: str, extra: dict) -> None:
        meta = {"kind": "boost", "features": self.features, "classes": self.classes, "spec": asdict(self.spec), "cuts": self.cuts, **extra}
        spark.range(1).select(F.lit(json.dumps(meta)).alias("value")).coalesce(1).write.mode("overwrite").text(path + "/meta")
        spark.createDataFrame(tree_rows(0, self.rounds), _TREES).write.mode("overwrite").parquet(path + "/trees")

    @staticmethod
    def read_rounds(spark: SparkSession, path: str) -> list[Round]:
        return from_rows(spark.read.parquet(path + "/trees").collect())
