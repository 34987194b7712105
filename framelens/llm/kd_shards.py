"""Shards of nearly equal bytes by a k-d tree over document metadata, with DataFrame functions only.

A node is split at the byte-weighted median along its widest metadata dimension until every leaf is one shard. The
median is exact and never gathers a node: bytes are summed per digit of the sort key, the driver picks the digit that
holds the median (at most ``2**DIGIT`` sums per node), and the next pass looks at the rows with that digit only. A tie
on a dimension is broken by a hash of id and text, so a value that a third of all rows share is split like any other;
rows that are equal altogether are told apart by their place in the written table.

A size is the UTF-8 bytes of the text plus one (null: no bytes). Missing metadata counts as zero or the empty text.
Numbers are scaled to the table's range and names are placed by a hash, both to ``2**WIDTH`` coordinates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from framelens.llm.common import Scratch

NUMBERS, NAMES = ("n_chars",), ("source", "lang")
WIDTH, TIE, DIGIT = 15, 48, 12
_LAST = 2**63 - 1


@dataclass(frozen=True)
class Split:
    """A row goes left if its key along ``axis`` is below ``key``, or equals it and its place is below ``place``."""

    axis: int
    key: int
    place: int


def _hex(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def measured(docs: DataFrame) -> tuple[DataFrame, int]:
    """``doc_id, size, text_crc32``, a key per dimension (coordinate, then tie) and the number of dimensions."""
    numbers, names = [c for c in NUMBERS if c in docs.columns], [c for c in NAMES if c in docs.columns]
    most = docs.agg(F.lit(0).alias("_"), *[F.max(F.col(c).cast("long")).alias(c) for c in numbers]).first()
    top = (1 << WIDTH) - 1
    axes = [F.floor(F.greatest(F.coalesce(F.col(c).cast("long"), F.lit(0)), F.lit(0)) * top / F.lit(max(1, most[c] or 0))).cast("long")
            for c in numbers]
    axes += [_hex(F.coalesce(F.col(c).cast("string"), F.lit("")), 4) % (1 << WIDTH) for c in names] or [F.lit(0).cast("long")] * (not numbers)
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    base = docs.select("doc_id", (F.length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
                       *[a.alias(f"_c{i}") for i, a in enumerate(axes)])
    tie = _hex(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_crc32"), TIE // 4)
    tied = base.withColumn("_tie", tie)
    keys = [(F.call_function("shiftleft", F.col(f"_c{i}"), F.lit(TIE)) + F.col("_tie")).alias(f"key{i}") for i in range(len(axes))]
    return tied.select("doc_id", "size", "text_crc32", *keys, F.monotonically_increasing_id().alias("place")), len(axes)


def _per_node(values: dict[int, int], column: str = "node") -> Column:
    out = None
    for node, v in values.items():
        out = F.when(F.col(column) == node, F.lit(v)) if out is None else out.when(F.col(column) == node, F.lit(v))
    return out


def _medians(rows: DataFrame, by: str, bits: int, totals: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int, int]]:
    """Per node the value of ``by`` that holds the cut, the bytes before it and the rows that have it.

    ``totals[node] = (a, b)``: rows go left while b * (2 * bytes before + size) <= a.
    """
    found, prefix, before, shift = {}, dict.fromkeys(totals, 0), dict.fromkeys(totals, 0), bits
    while prefix:
        step = max(0, shift - DIGIT)
        here = rows.filter(F.col("node").isin(*prefix))
        if shift < bits:
            here = here.filter(F.shiftright(by, shift) == _per_node(prefix))
        sums = here.groupBy("node", F.shiftright(by, step).alias("digit")).agg(
            F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.min(by).alias("low"))
        digits: dict[int, list] = {}
        for r in sums.collect():  # at most 2**DIGIT per node
            digits.setdefault(r["node"], []).append((r["digit"], r["size"], r["n"], r["low"]))
        for node, held in digits.items():
            a, b = totals[node]
            held.sort()
            for i, (digit, size, n, low) in enumerate(held):
                # Whoever holds the cut: the last row of the digit would no longer go left.
                if b * 2 * (before[node] + size) > a or i == len(held) - 1:
                    break
                before[node] += size
            prefix[node] = digit
            if n == 1 or step == 0:
                found[node] = low, before[node], n
                del prefix[node]
        shift = step
    return found


def _grow(rows: DataFrame, axes: int, splits: dict[int, Split], open_nodes: dict[int, int]) -> None:
    """Split every open node (number -> leaves below it) once."""
    at = rows.withColumn("node", _node(splits, 1, {})).filter(F.col("node").isin(*open_nodes))
    keys = [f"key{i}" for i in range(axes)]
    stats = {r["node"]: r for r in at.groupBy("node").agg(
        F.sum("size").alias("size"), *[f(k).alias(f"{g}{k}") for k in keys for f, g in ((F.min, "lo"), (F.max, "hi"))]).collect()}
    axis = {node: max(range(axes), key=lambda i: ((r[f"hikey{i}"] >> TIE) - (r[f"lokey{i}"] >> TIE), -i)) for node, r in stats.items()}
    for node in open_nodes:
        if node not in stats:
            splits[node] = Split(0, 0, 0)
    if not stats:
        return
    chosen = F.col("key0")
    for i in range(1, axes):
        chosen = F.when(F.col("node").isin(*[k for k, a in axis.items() if a == i] or [-1]), F.col(f"key{i}")).otherwise(chosen)
    cut = at.select("node", "size", "place", chosen.alias("key"))
    totals = {node: (2 * r["size"] * (open_nodes[node] // 2), open_nodes[node]) for node, r in stats.items()}
    keyed = _medians(cut, "key", WIDTH + TIE, totals)
    same = {node: k for node, (k, _, rows_) in keyed.items() if rows_ > 1}
    placed = {}
    if same:
        left = {node: (totals[node][0] - totals[node][1] * 2 * keyed[node][1], totals[node][1]) for node in same}
        placed = _medians(cut.filter(F.col("key") == _per_node(same)), "place", 63, left)
    sizes = _sizes(cut, keyed, placed)
    for node, (key, before, _) in keyed.items():
        a, b = totals[node]
        place, more, _ = placed.get(node, (None, 0, 1))
        goes_left = b * (2 * (before + more) + sizes[node]) <= a
        splits[node] = Split(axis[node], key, (_LAST if goes_left else 0) if place is None else place + goes_left)


def _sizes(cut: DataFrame, keyed: dict, placed: dict) -> dict[int, int]:
    """Size of the one row per node that holds the cut."""
    own = cut.filter(F.col("key") == _per_node({k: v[0] for k, v in keyed.items()}))
    if placed:
        own = own.filter((F.col("place") == _per_node({k: v[0] for k, v in placed.items()})) | ~F.col("node").isin(*placed))
    return {r["node"]: r["size"] for r in own.groupBy("node").agg(F.max("size").alias("size")).collect()}


def _node(splits: dict[int, Split], node: int, leaves: dict[int, int]) -> Column:
    """Number of the node a row is in; ``leaves`` names the numbers otherwise."""
    if node not in splits:
        return F.lit(leaves.get(node, node))
    s = splits[node]
    key = F.col(f"key{s.axis}")
    left = (key < s.key) | ((key == s.key) & (F.col("place") < s.place))
    return F.when(left, _node(splits, 2 * node, leaves)).otherwise(_node(splits, 2 * node + 1, leaves))


def shards(docs: DataFrame, n: int) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row: shards 0 to n - 1 of nearly equal bytes, slots from 0
    without gaps in the order of doc_id within a shard (rows without an id first). Repeated rows are rows of their own;
    an empty table gives no rows. A shard's bytes differ from an equal share by about one document per tree level.
    """
    scratch = Scratch(docs.sparkSession)
    narrow, axes = measured(docs)
    rows = scratch.write(narrow)
    splits: dict[int, Split] = {}
    leaves = {1: n}
    while True:
        open_nodes = {k: v for k, v in leaves.items() if v > 1 and k not in splits}
        if not open_nodes:
            break
        _grow(rows, axes, splits, open_nodes)
        for k, v in open_nodes.items():
            leaves[2 * k], leaves[2 * k + 1] = v // 2, v - v // 2
    order = sorted((k for k in leaves if k not in splits), key=lambda k: bin(k)[3:].ljust(64, "0"))
    names = {k: i for i, k in enumerate(order)}
    placed = rows.select("doc_id", "size", "text_crc32", "place", _node(splits, 1, names).cast("int").alias("shard"))
    return numbered(placed, ["shard"], [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("place")], scratch).select(
        "doc_id", "size", "text_crc32", "shard", "slot")


def numbered(rows: DataFrame, keys: list[str], order: list[Column], scratch: Scratch) -> DataFrame:
    """Add ``slot``, 0, 1, ... per key in the given order, without a task that holds a whole key.

    Rows are range-partitioned on keys and order and written; a row's number is its place in its part plus the rows of
    its key in the parts before, which are one count per part and key.
    """
    pieces = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lined = rows.repartitionByRange(pieces, *keys, *order).sortWithinPartitions(*keys, *order)
    held = scratch.write(lined.withColumn("_at", F.monotonically_increasing_id()))
    piece = F.shiftright("_at", 33)
    parts = held.groupBy(*keys, piece.alias("_piece")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
    ahead = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    running = F.sum("_n").over(ahead)
    offsets = parts.select(*keys, "_piece", (F.coalesce(running, F.lit(0)) - F.col("_from")).alias("_shift"))
    joined = held.withColumn("_piece", piece).join(offsets, [*keys, "_piece"])
    return joined.withColumn("slot", F.col("_at") + F.col("_shift")).drop("_piece", "_at", "_shift")
