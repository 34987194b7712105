"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

Equal sets are one node, named by its smallest row. Pairs of nodes are proposed in two ways and the sets decide:

* SimHashes over the sets that differ in few bits, found by the vantage-point search of ``simhash_vp``. It is exact within
  its radius, but sets with a similarity of 0.8 differ in about ten of 64 bits, and at such a radius the triangle
  inequality excludes nothing (unrelated fingerprints differ in 32).
* Equal bands of a MinHash signature (Broder, 1997): ``BANDS`` bands of ``ROWS`` minima. A pair with a similarity of 0.8
  shares a band with a chance of 0.9996. The number of bands is fixed, so the work grows with the table.

Within a bucket of equal bands members are compared with its smallest node first; what the sets confirm is merged. Then
only pairs of different groups are left. The nodes outside the largest group of a bucket are dealt into classes, and the
most common set of each class is compared with the members of other groups; one class first, then ``GROWTH`` times as many
in each turn, until every class has one node. Before each turn the hashes are counted that a node shares with nodes of other groups
(``open_nodes``): copies that differ in words of their own are no partners, and no pair is made of them. So no pair of a
bucket is left out that can be similar enough, pairs within a group are never made, and no bucket is gathered in a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from framelens.llm.common import Scratch, in_slices, lower_words, mapped, numbered, small_or_not
from framelens.llm.simhash_vp import SEED, components, heads, links

SHINGLE, BANDS, ROWS, GROWTH = 5, 20, 5, 64
#: Pairs whose signatures agree in a smaller share are not compared: four deviations below 0.8.
AGREE = 0.64
_U = np.uint64
_FACTORS = np.random.default_rng(11).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * _U(2) + _U(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; a shorter text is one shingle, one without a word has none."""
    found = lower_words(text)
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(sizes)
    if len(found) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)] if found else [], _U)
    starts = (ends - sizes)[:len(found) - SHINGLE + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1:] - 1).tolist())], _U))


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set, as a signed number."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[lo:lo + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(np.int64)[0])


def signature(hashes: np.ndarray) -> np.ndarray:
    """The minima of the set under ``BANDS * ROWS`` multiplications, their upper halves."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, _U)
    for lo in range(0, len(hashes), 1 << 10):
        np.minimum(least, np.multiply.outer(hashes[lo:lo + (1 << 10)], _FACTORS).min(axis=0), out=least)
    return (least >> _U(32)).astype(np.uint32)


def described(rows: DataFrame) -> DataFrame:
    """``row, key`` (a hash of the set), its size ``n``, SimHash ``point`` and signature ``sig``."""

    def run(batches):
        for pdf in in_slices(batches):
            sets = [shingles(t) for t in pdf["text"]]
            yield pd.DataFrame({"row": pdf["row"].to_numpy(), "key": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                                "n": [len(s) for s in sets], "point": [fingerprint(s) for s in sets],
                                "sig": [signature(s).tobytes() for s in sets]})

    return mapped(rows, run, "row long, key binary, n long, point long, sig binary")


def buckets(nodes: DataFrame) -> DataFrame:
    """``k, node`` of every band that two nodes or more share."""

    def run(batches):
        for pdf in in_slices(batches, 4096):
            sig = np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(len(pdf), BANDS, ROWS)
            keys = [xxhash.xxh64_intdigest(sig[i, b].tobytes(), b) for i in range(len(pdf)) for b in range(BANDS)]
            yield pd.DataFrame({"k": np.array(keys, _U).view(np.int64), "node": np.repeat(pdf["node"].to_numpy(), BANDS)})

    bands = mapped(nodes.select("node", "sig"), run, "k long, node long")
    shared = bands.groupBy("k").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("k")
    return bands.join(shared, "k", "left_semi")


def alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose signatures agree often enough to look at the sets."""

    def run(batches):
        for pdf in in_slices(batches, 4096):
            a, b = (np.frombuffer(b"".join(pdf[c]), np.uint32).reshape(len(pdf), -1) for c in ("sa", "sb"))
            yield pdf.loc[(a == b).mean(axis=1) >= AGREE, ["a", "b"]]

    both = pairs.join(nodes.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(
        nodes.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
    return mapped(both, run, "a long, b long")


def set_table(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, s``: the sets of the wanted nodes, 32 bits of each hash."""

    def run(batches):
        for pdf in in_slices(batches):
            yield pd.DataFrame({"node": pdf["row"].to_numpy(), "s": [np.unique(shingles(t).astype(np.uint32)).tobytes() for t in pdf["text"]]})

    return mapped(rows.join(wanted, "row", "left_semi"), run, "node long, s binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets are similar enough."""

    def run(batches):
        for pdf in in_slices(batches, 64):
            good = []
            for x, y in zip(pdf["sa"], pdf["sb"]):
                a, b = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                both = len(np.intersect1d(a, b, assume_unique=True))
                good.append(10 * both >= 8 * (len(a) + len(b) - both))
            yield pdf.loc[good, ["a", "b"]]

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    return mapped(both, run, "a long, b long")


def open_nodes(live: DataFrame, sets: DataFrame) -> DataFrame:
    """``node, n, c``: nodes that may be linked to a node of another group, the size of their set and how many hashes of it
    some live node of another group has as well.

    Two sets are similar enough only if they share four ninths of their sizes' sum. What they share lies in both counts, so
    a pair needs both counts to be that large; and as the smaller set has at least 0.8 of the larger, a count below 0.8 of
    the own size rules out every partner at once.
    """

    def run(batches):
        for pdf in in_slices(batches, 64):
            hashes = [np.frombuffer(s, np.uint32) for s in pdf["s"]]
            n = [len(h) for h in hashes]
            yield pd.DataFrame({"h": np.concatenate(hashes).view(np.int32), "node": np.repeat(pdf["node"].to_numpy(), n),
                                "root": np.repeat(pdf["root"].to_numpy(), n), "n": np.repeat(np.array(n), n)})

    nodes = live.select("node", "root").distinct()
    told = mapped(sets.join(nodes, "node"), run, "h int, node long, root long, n int")
    met = told.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("h")
    return (told.join(met, "h", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.count(F.lit(1)).cast("int").alias("c"))
            .filter("10 * c >= 8 * n"))


def firsts(live: DataFrame, turn: int) -> DataFrame:
    """``k, x, size``: the node ``x`` that the members of other groups in the bucket are compared with in this turn, one of
    each class, and the nodes of the class.

    ``live`` has ``k, node, root`` of the buckets with several groups, and after the first turn ``n, c`` of ``open_nodes``.
    """
    if turn == 0:
        return live.groupBy("k").agg(F.min(F.struct("node", "root")).alias("x"), F.lit(2).alias("size"))
    sizes = live.groupBy("k", "root").agg(F.count(F.lit(1)).alias("size")).groupBy("k").agg(F.max_by("root", F.struct("size", "root")).alias("largest"))
    rest = live.join(sizes, "k").filter("root <> largest")
    dealt = rest.withColumn("class", F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(GROWTH**(turn - 1))))
    # The set with the fewest hashes of its own comes first: copies differ less from it than from each other.
    best = F.min(F.struct((F.col("n") - F.col("c")).alias("lone"), "node", "root", "n", "c"))
    return dealt.groupBy("k", "class").agg(best.alias("x"), F.count(F.lit(1)).alias("size"))


def proposed(live: DataFrame, one: DataFrame, turn: int) -> DataFrame:
    """Pairs (a > b) of different groups to compare in this turn; ``one`` has the ``firsts``."""
    fits = 9 * F.least(live["c"], F.col("x.c")) >= 4 * (live["n"] + F.col("x.n")) if turn else F.lit(True)
    met = live.join(one, [live["k"] == one["k"], live["root"] != F.col("x.root"), fits])
    return met.select(F.greatest(live["node"], F.col("x.node")).alias("a"), F.least(live["node"], F.col("x.node")).alias("b")).distinct()


def groups(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``row, root, wordless`` of every row of ``row, text``: rows of one group of near copies have one root. Texts
    without a word are equal."""
    described_rows = scratch.write(described(rows))
    nodes = scratch.write(described_rows.groupBy("key").agg(F.min("row").alias("node"), F.first("n").alias("n"),
                                                            F.first("point").alias("point"), F.first("sig").alias("sig")))
    some = nodes.filter("n > 0")
    bands = scratch.write(buckets(some))
    # Nodes with one fingerprint differ in no bit and are linked to the first of them.
    points = scratch.write(some.groupBy("point").agg(F.min("node").alias("node")))
    same = some.join(points.withColumnRenamed("node", "b"), "point").select(F.col("node").alias("a"), "b").filter("a <> b")
    close = scratch.write(links(points).unionByName(same).distinct())
    wanted = scratch.write(bands.select("node").unionByName(close.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
                           .withColumnRenamed("node", "row"))
    sets = scratch.write(set_table(rows, small_or_not(wanted)))
    edges = scratch.write(verified(alike(close, some), sets))
    scratch.drop(points, close, wanted)
    apart, turn, live, grown = edges.limit(0), 0, bands, True
    while True:
        # Groups that did not grow leave everything as it was; the second turn needs the counts of hashes besides.
        if grown:
            roots = components(edges, scratch)
        if grown or turn == 1:
            now = live.select("k", "node").join(roots, "node", "left").select("k", "node", F.coalesce("root", "node").alias("root"))
            mixed = now.groupBy("k").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("k")
            # Groups only grow, so what is not live now never is again.
            old, live = live, scratch.write(now.join(mixed, "k", "left_semi"))
            scratch.drop(old)
            if turn:
                open_ = scratch.write(open_nodes(live, sets))
                old, live = live, scratch.write(live.join(open_, "node"))
                scratch.drop(old, open_)
            if live.isEmpty():
                break
        one = scratch.write(firsts(live, turn))
        pairs = scratch.write(proposed(live, one, turn).join(apart, ["a", "b"], "left_anti"))
        last, grown = one.filter("size > 1").isEmpty(), False
        if not pairs.isEmpty():
            good = scratch.write(verified(alike(pairs, some), sets))
            grown = not good.isEmpty()
            if grown:
                before, edges = edges, scratch.write(edges.unionByName(good))
                scratch.drop(before)
            if not last:
                old, apart = apart, scratch.write(apart.unionByName(pairs.join(good, ["a", "b"], "left_anti")))
                scratch.drop(old)
            scratch.drop(good)
        scratch.drop(one, pairs)
        scratch.sweep()
        if last:
            roots = components(edges, scratch) if grown else roots
            break
        turn += 1
    scratch.drop(live, sets)
    named = scratch.write(nodes.join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("root")))
    scratch.drop(nodes)
    return described_rows.join(named, "key").select("row", "root", (F.col("n") == 0).alias("wordless"))


def one_of_each(docs: DataFrame, scratch: Scratch | None = None, stored: bool = False) -> DataFrame:
    """One row of each group of near copies, as ``heads`` picks it; rows go by a number of their own, so ids may repeat or
    be missing. Null and empty texts are equal to each other. Very long texts count whole. An empty table stays empty.
    All columns are kept, whatever their names. ``stored``: see ``numbered``."""
    scratch = scratch or Scratch(docs.sparkSession)
    rows, row = numbered(docs, scratch, stored)
    found = groups(rows.select(F.col(row).alias("row"), "text"), scratch)
    labelled = scratch.write(found.join(rows.select(F.col(row).alias("row"), "doc_id"), "row"))
    gone = scratch.write(labelled.select("row").join(heads(labelled), "row", "left_anti").withColumnRenamed("row", row))
    return rows.join(small_or_not(gone), row, "left_anti").select(*docs.columns)
