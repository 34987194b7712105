"""Near-duplicates by SimHash fingerprints and vantage-point trees.

Fingerprints within ``RADIUS`` bits are linked and the links' components are the groups. Equal fingerprints are one
point. A vantage-point tree over a bounded sample of points cuts the space into shards: a node holds a vantage point
``v`` and a distance ``m``; points nearer than ``m`` go inside, the others outside. Two points ``x`` inside and ``y``
outside that are linked have d(v, x) >= m - RADIUS by the triangle inequality, so the inside points of that band also go
outside, and every linked pair meets in some shard. A shard is searched by the same rule until a piece is small, then
all its distances are taken at once. What leaves a shard is a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from framelens.llm.common import Scratch, lower_words, mapped, numbered

BITS, SHINGLE, RADIUS, SEED = 64, 3, 2, 42
#: Points of the sample the tree of shards is built from, and points of a shard aimed at.
SAMPLE, SHARD = 20_000, 4_000
#: A piece this small is compared at once.
PIECE = 192
#: Links that a task joins by itself.
LINKS = 1 << 18


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash over the text's shingles, repeats included; zero without a word."""
    found = lower_words(text)
    if not found:
        return 0
    if len(found) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(found), SEED)
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[:len(found) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist())], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[lo:lo + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, point`` (the fingerprint as a signed long) of every row."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "point": np.array(
                [fingerprint(t) for t in pdf["text"]], np.uint64).view(np.int64)})

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, point long")


def distance(a: np.ndarray, b) -> np.ndarray:
    """Hamming distances of unsigned 64-bit numbers."""
    return np.bitwise_count(np.bitwise_xor(a, b)).astype(np.int64)


def threshold(d: np.ndarray) -> int | None:
    """A distance near the median with few points just below it; None if no distance cuts the points."""
    counts = np.bincount(d, minlength=BITS + 2)
    below = np.cumsum(counts) - counts  # points nearer than each distance
    inside = below / len(d)
    fair = np.flatnonzero((inside >= 0.25) & (inside <= 0.75))
    if not len(fair):
        fair = np.flatnonzero((below > 0) & (below < len(d)))
        if not len(fair):
            return None
    band = below[fair] - below[np.maximum(fair - RADIUS, 0)]
    return int(fair[np.argmin(np.maximum(below[fair], len(d) - below[fair] + band))])


def split(points: np.ndarray) -> tuple[np.uint64, int, np.ndarray, np.ndarray] | None:
    """Vantage point, distance, and positions of the points inside and outside; None if that does not make pieces
    smaller. Of a few vantage points the one with the smallest larger piece is taken."""
    best = None
    for v in points[np.linspace(0, len(points) - 1, 4).astype(np.int64)]:
        d = distance(points, v)
        m = threshold(d)
        if m is None:
            continue
        inside, outside = np.flatnonzero(d < m), np.flatnonzero(d >= m - RADIUS)
        size = max(len(inside), len(outside))
        if best is None or size < best[0]:
            best = size, v, m, inside, outside
    return None if best is None or best[0] > 0.9 * len(points) else best[1:]


class Forest:
    """Union-find over positions; the root of a set is its smallest position."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def compare(points: np.ndarray, at: np.ndarray, forest: Forest) -> None:
    """Link all pairs of a piece by their distances, block by block."""
    own = points[at]
    for lo in range(0, len(at), 256):
        block = own[lo:lo + 256]
        i, j = np.nonzero(distance(block[:, None], own[None, lo:]) <= RADIUS)
        for a, b in zip(at[lo + i[i < j]].tolist(), at[lo + j[i < j]].tolist()):
            forest.join(a, b)


def search(points: np.ndarray, forest: Forest) -> None:
    """Link all pairs of ``points`` within RADIUS."""
    open_pieces = [np.arange(len(points))]
    while open_pieces:
        at = open_pieces.pop()
        cut = split(points[at]) if len(at) > PIECE else None
        if cut is None:
            compare(points, at, forest)
        else:
            open_pieces += [at[cut[2]], at[cut[3]]]


def tree(sample: np.ndarray, total: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage point, distance, inside, outside) of the tree of shards; a negative child is shard -child - 1."""
    nodes: list[list[int]] = []
    shards = 0

    def grow(points: np.ndarray, expected: float) -> int:
        nonlocal shards
        cut = split(points) if expected > SHARD and len(points) >= 16 else None
        if cut is None:
            shards += 1
            return -shards
        own = len(nodes)
        nodes.append([int(cut[0]), cut[1], 0, 0])
        for k, part in ((2, cut[2]), (3, cut[3])):
            nodes[own][k] = grow(points[part], expected * len(part) / len(points))
        return own

    grow(sample, float(total))
    return [tuple(n) for n in nodes]


def route(points: np.ndarray, nodes: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(position, shard) of every shard each point belongs to."""
    if not nodes:
        return np.arange(len(points)), np.zeros(len(points), np.int64)
    found, open_nodes = [], [(0, np.arange(len(points)))]
    while open_nodes:
        node, at = open_nodes.pop()
        if node < 0:
            found.append((at, np.full(len(at), -node - 1)))
            continue
        v, m, inside, outside = nodes[node]
        d = distance(points[at], np.uint64(v))
        open_nodes += [(inside, at[d < m]), (outside, at[d >= m - RADIUS])]
    return tuple(np.concatenate(x) for x in zip(*found))


def links(points: DataFrame) -> DataFrame:
    """Spanning forests (a > b) of the links within each shard, for distinct ``point, node`` rows."""
    spark = points.sparkSession
    total = points.count()
    # A bounded sample only shapes the tree; every point is routed and searched.
    sample = points.orderBy(F.xxhash64("point")).limit(SAMPLE).select("point").collect()
    nodes = tree(np.array([r["point"] for r in sample], np.int64).view(np.uint64), total)
    shared = spark.sparkContext.broadcast(nodes)  # a node per shard that the sample can tell apart: SAMPLE / 8 at most

    def deal(batches):
        for pdf in batches:
            p = pdf["point"].to_numpy(np.int64)
            at, shard = route(p.view(np.uint64), shared.value)
            yield pd.DataFrame({"shard": shard, "point": p[at], "node": pdf["node"].to_numpy(np.int64)[at]})

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", kind="stable")
        node, points = pdf["node"].to_numpy(np.int64), pdf["point"].to_numpy(np.int64).view(np.uint64)
        forest = Forest(len(points))
        search(points, forest)
        low = np.fromiter((forest.root(i) for i in range(len(points))), np.int64, len(points))
        far = np.flatnonzero(low != np.arange(len(points)))
        return pd.DataFrame({"a": node[far], "b": node[low[far]]})

    dealt = mapped(points.select("point", "node"), deal, "shard long, point long, node long")
    return dealt.groupBy("shard").applyInPandas(meet, "a long, b long").distinct()


def contracted(edges: DataFrame, parts: int) -> DataFrame:
    """Stars (a > b) of what the links of each part join; the links are dealt evenly over the parts."""

    def run(batches):
        found = [pdf[["a", "b"]].to_numpy(np.int64) for pdf in batches]
        if found:
            names, at = np.unique(np.concatenate(found), return_inverse=True)
            forest = Forest(len(names))
            for i, j in at.reshape(-1, 2).tolist():
                forest.join(i, j)
            low = np.fromiter((forest.root(i) for i in range(len(names))), np.int64, len(names))
            far = np.flatnonzero(low != np.arange(len(names)))
            yield pd.DataFrame({"a": names[far], "b": names[low[far]]})

    return mapped(edges.select("a", "b").repartition(parts), run, "a long, b long")


def all_stars(edges: DataFrame) -> bool:
    """Whether no node has two smaller neighbours, nor a smaller and a larger one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up")))
    met = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return met.filter("ups > 1 OR (ups = 1 AND least = 0)").isEmpty()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, root`` with the smallest node of its component, for every node that has an edge (a > b).

    First each part of at most ``LINKS`` links is reduced to stars by itself; one part is all there is to do for few
    links. Several parts go through alternating large-star and small-star steps (Kiveris et al., 2014): joins with
    combinable minima, no group of neighbours is ever gathered. Each round is a written table that replaces the one before.
    Every shuffle costs the driver a thread for a minute, so rounds are few and their end is seen by one.
    """
    given = scratch.write(edges)
    parts = -(-given.count() // LINKS)
    now = scratch.write(contracted(given, max(parts, 1)))
    scratch.drop(given)
    while parts > 1 and not all_stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # Large star: every larger neighbour of a is linked to the smallest node around a.
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.write(large)
        # Small star: a and its smaller neighbours are linked to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, now = now, scratch.write(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        scratch.drop(before, large)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs``.

    Null and empty texts share fingerprint zero. Repeated rows and repeated ids each keep their row. A row without an
    id gets the component of its fingerprint, which is named by the smallest id in it (null if it has none).
    """
    scratch = Scratch(docs.sparkSession)
    prints = scratch.write(fingerprints(docs))
    points = scratch.write(prints.groupBy("point").agg(F.min("doc_id").alias("node")))
    known = points.filter("node IS NOT NULL")
    # Ids that repeat with other texts stand for one node each: equal nodes are joined by the id itself.
    edges = links(known).filter("a <> b")
    roots = components(edges, scratch)
    named = known.join(roots, "node", "left").select("point", F.coalesce("root", "node").alias("component_id"))
    text = F.lower(F.lpad(F.hex("point"), 16, "0"))
    return prints.join(named, "point", "left").select("doc_id", text.alias("fingerprint"), "component_id")


def heads(found: DataFrame) -> DataFrame:
    """``row`` of one row of each ``root``: the smallest id, the first row of equal ids, one without an id only if none
    has one. Rows with neither id nor words are a group of their own."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("x")
    blank = (F.col("doc_id").isNull() & F.col("wordless")).alias("blank")
    return found.groupBy("root", blank).agg(first).select("x.row")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates. Rows go by a number of their own, so ids may repeat or be missing."""
    rows, row = numbered(docs, Scratch(docs.sparkSession))
    found = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text")).select(
        F.col("doc_id").alias("row"), F.col("component_id").alias("root"), (F.col("fingerprint") == "0" * 16).alias("wordless"))
    kept = heads(found.join(rows.select(F.col(row).alias("row"), "doc_id"), "row")).withColumnRenamed("row", row)
    return rows.join(kept, row, "left_semi").select(*docs.columns)
