"""Removal of repeated passages with a distributed sparse suffix array.

A byte goes if a ``LENGTH``-byte string over it also starts earlier (smaller id, or same document and earlier start).
Only some suffixes are sorted. Of the ``GRAM``-byte strings within a ``LENGTH``-byte string the one with the smallest
hash, the leftmost of equals, is its anchor; equal strings have equal anchors at the same place. Consecutive strings
share anchors, so there is one suffix in about thirty positions: the suffix at the anchor, with the stretch of text that
all strings anchored there make up.

1. Suffixes are packed per bucket. Buckets are ranges of (leading bytes, hash of the gram, hash of the stretch), cut by
   sampled splitters, so that a gram that most documents share spreads over buckets. A bucket sorts its suffixes by
   multikey quicksort, digit by digit among ties. Equal stretches are neighbours: all but the earliest repeat as a whole.
   A gram with several stretches, also across the bucket's boundaries, is compared string by string.
2. Strings of those stretches (the earliest of each) are hashed, dealt by hash and sorted likewise; all but the earliest
   of equal ones repeat.
3. The repeats of both steps meet the texts and bytes are removed.

Every task keeps only the earliest of what is equal within it and reports the others at once, so what travels for one
stretch or string is at most one entry per task, however often it occurs. Strings are compared by hashes of 64 bits and
more. What moves is packed by column, texts are compressed; a group of documents is about ``GROUP_BYTES`` of text.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from framelens.llm.common import Scratch, mapped, spread

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1
GROUP_BYTES, BUCKET_BYTES, BUCKET_STRINGS = 8 << 20, 16 << 20, 1_000_000
#: Bytes hashed at a time, entries of a task that are packed at a time, documents the splitters are taken from.
CHUNK, FLUSH, SAMPLE = 1 << 20, 1_000_000, 2_000
_U = np.uint64
_NO_ID = -(1 << 63)
_P = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=_U)


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


def group_of(place: np.ndarray, groups: int) -> np.ndarray:
    return (_mix(place.astype(np.int64).view(_U)) % _U(groups)).astype(np.int64)


class Hashes:
    """Hashes of any stretch of a chunk of text, from sums of its bytes times powers of an odd number."""

    _power: np.ndarray = np.ones(1, _U)
    _inverse: np.ndarray = np.ones(1, _U)

    def __init__(self, text: np.ndarray):
        n = len(text) + 1
        if len(Hashes._power) < n:
            Hashes._power = np.cumprod(np.concatenate([[_U(1)], np.full(n - 1, _P, _U)]), dtype=_U)
            Hashes._inverse = np.cumprod(np.concatenate([[_U(1)], np.full(n - 1, pow(_P, -1, 1 << 64), _U)]), dtype=_U)
        self.sums = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTE[text] * self._power[:n - 1], dtype=_U)])

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return _mix((self.sums[length:] - self.sums[:n]) * self._inverse[:n]) if n > 0 else np.zeros(0, _U)

    def at(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return _mix((self.sums[start + length] - self.sums[start]) * self._inverse[start])


def _first_smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest, leftmost of equals, among ``width`` values from each position on."""
    value, at, span = values, np.arange(len(values), dtype=np.int32), 1
    while span < width:
        step = min(span, width - span)
        n = len(value) - step
        right = value[step:] < value[:n]
        value, at = np.where(right, value[step:], value[:n]), np.where(right, at[step:], at[:n])
        span += step
    return at


def chunks(docs):
    """Pieces of (number of the document, offset in it, bytes), about CHUNK bytes together. A longer text is cut; its
    pieces overlap so that every string is in one, and each string starts in one piece only."""
    held, size = [], 0
    for i, text in docs:
        if len(text) < LENGTH:
            continue
        for lo in range(0, len(text) - LENGTH + 1, CHUNK):
            part = text[lo:lo + CHUNK + LENGTH - 1]
            held.append((i, lo, part))
            size += len(part)
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def suffixes(held) -> dict[str, np.ndarray]:
    """Per anchor: the digits of the sort key (``KEYS``), document number, first start and number of the strings it anchors."""
    parts = [np.frombuffer(t, np.uint8) for _, _, t in held]
    text = np.concatenate(parts)
    sizes = np.array([len(p) for p in parts])
    base = np.cumsum(sizes) - sizes
    hashes = Hashes(text)
    gram = hashes.all(GRAM)
    anchor = _first_smallest(gram, SPAN)
    starts = spread(base, sizes - LENGTH + 1)
    part = np.repeat(np.arange(len(held)), sizes - LENGTH + 1)
    own = anchor[starts].astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (own[1:] != own[:-1]) | (part[1:] != part[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    lo, q, part = starts[first], own[first], part[first]
    stretch = _mix(hashes.at(lo, count + LENGTH - 1) + (q - lo).astype(_U) * _U(_P) + count.astype(_U))
    lead = sum(text[q + i].astype(_U) << _U(24 - 8 * i) for i in range(4))
    h = gram[q]
    return {"k1": (lead << _U(32)) | (h >> _U(32)), "k2": h << _U(32) | (stretch >> _U(32)),
            "tail": stretch & _U(0xFFFFFFFF), "doc": np.array([i for i, _, _ in held])[part], "lo": lo - base[part] + np.array([o for _, o, _ in held])[part],
            "count": count}


#: Leading bytes, 64 bits of the gram's hash, 64 bits of the stretch's hash; k2 has half of each hash.
KEYS = ("k1", "k2", "tail")
_STRETCH_BITS = _U(32)


def multikey_order(digits: list[np.ndarray]) -> np.ndarray:
    """Order by the first digit, ties by the second and so on; each further digit is sorted within ties only."""
    order = np.argsort(digits[0], kind="quicksort")
    tied = np.zeros(len(order), bool)
    same = digits[0][order][1:] == digits[0][order][:-1]
    tied[1:] |= same
    tied[:-1] |= same
    run = np.cumsum(np.concatenate([[True], ~same])) if len(order) else np.zeros(0, np.int64)
    for d in digits[1:]:
        at = np.flatnonzero(tied)
        if not len(at):
            break
        value = d[order[at]]
        inner = np.lexsort((value, run[at]))
        order[at] = order[at][inner]
        value, r = value[inner], run[at]
        same = (value[1:] == value[:-1]) & (r[1:] == r[:-1])
        run[at] = r * (len(order) + 1) + np.cumsum(np.concatenate([[True], ~same]))
        run = np.unique(run, return_inverse=True)[1]
        tied[at] = False
        pair = np.zeros(len(at), bool)
        pair[1:] |= same
        pair[:-1] |= same
        tied[at[pair]] = True
    return order


# --- packed columns --------------------------------------------------------------------------------------------------

def _planes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes()


def pack(columns: dict[str, np.ndarray], docs: tuple[np.ndarray, np.ndarray]) -> bytes:
    """Columns byte by byte, ``doc`` as numbers of a table of (id, place) that holds the documents met."""
    used, doc = np.unique(columns["doc"], return_inverse=True)
    n, out = len(doc), [docs[0][used].astype("<i8").tobytes(), docs[1][used].astype("<i8").tobytes(), _planes(doc.astype("<u4"))]
    for name in sorted(set(columns) - {"doc"}):
        v = columns[name]
        if name == "k1":
            v = np.diff(v, prepend=_U(0))
        out.append(_planes(v.astype("<u8" if name[0] == "k" else "<u4")))
    return struct.pack("<II", n, len(used)) + b"".join(out)


def unpack(blobs, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    """Columns of all blobs with ``id`` and ``place`` of each entry's document."""
    out: dict[str, list] = {k: [] for k in (*names, "id", "place")}
    for raw in blobs:
        n, used = struct.unpack_from("<II", raw)
        at = 8
        tables = [np.frombuffer(raw, "<i8", used, at + 8 * used * i) for i in range(2)]
        at += 16 * used

        def column(width: int, at: int) -> np.ndarray:
            return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(f"<u{width}").reshape(n)

        doc = column(4, at)
        at += 4 * n
        out["id"].append(tables[0][doc])
        out["place"].append(tables[1][doc])
        for name in sorted(names):
            width = 8 if name[0] == "k" else 4
            v = column(width, at)
            at += width * n
            out[name].append(np.cumsum(v, dtype=_U) if name == "k1" else v if width == 8 else v.astype(np.int64))
    return {k: np.concatenate(v) if v else np.zeros(0, _U if k[0] == "k" else np.int64) for k, v in out.items()}


def _spans(entries: dict[str, np.ndarray], at: np.ndarray, groups: int, kind: int, note: bytes | None = None):
    """Rows (kind, target, note, blob) of the chosen entries' ranges of starts, per group of documents."""
    if not len(at):
        return []
    target = group_of(entries["place"][at], groups)
    order = np.argsort(target, kind="stable")
    at, target = at[order], target[order]
    cut = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
    rows = []
    for lo, hi in zip(cut, np.append(cut[1:], len(at))):
        own = at[lo:hi]
        place, doc = np.unique(entries["place"][own], return_inverse=True)
        rows.append((kind, int(target[lo]), note, pack({"doc": doc, "lo": entries["lo"][own], "count": entries["count"][own]},
                                                      (np.zeros(len(place), np.int64), place))))
    return rows


_ROW = "kind int, target long, note binary, blob binary"
REPEAT, COMPARE, MAYBE, EDGE, ENTRY = range(5)


def _frames(rows, most: int = 64):
    for lo in range(0, len(rows), most):
        yield pd.DataFrame(rows[lo:lo + most], columns=["kind", "target", "note", "blob"])


def earliest(entries: dict[str, np.ndarray], keys: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys, then by document and start, and which ordered entries are the earliest of their key."""
    order = multikey_order([entries[k] for k in keys] + [entries["id"], entries["place"], entries["lo"]])
    head = np.ones(len(order), bool)
    if len(order):
        head[1:] = np.logical_or.reduce([entries[k][order][1:] != entries[k][order][:-1] for k in keys])
    return order, head


def bucket_of(k1: np.ndarray, k2: np.ndarray, splitters: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Number of splitters at or below (k1, k2)."""
    s1, s2 = splitters
    out, upto = np.searchsorted(s1, k1, "left"), np.searchsorted(s1, k1, "right")
    for lo in np.unique(out[upto > out]):
        own = np.flatnonzero((out == lo) & (upto > out))
        hi = upto[own[0]]
        out[own] += np.searchsorted(s2[lo:hi], k2[own], "right")
    return out


# --- the steps -------------------------------------------------------------------------------------------------------

def _numbered(pdf: pd.DataFrame):
    """Ids (a missing one counts as the smallest), places and bytes of a batch of documents."""
    ids = pdf["doc_id"].astype("Int64").fillna(_NO_ID).to_numpy(np.int64)
    return ids, pdf["place"].to_numpy(np.int64), [t.encode("utf-8") if t else b"" for t in pdf["text"]]


def _flush(held: list[dict[str, np.ndarray]], keys: tuple[str, ...], deal, groups: int):
    """The earliest entries of a task, packed by bucket, and the others as repeats."""
    entries = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
    order, head = earliest(entries, keys)
    rows = _spans(entries, order[~head], groups, REPEAT)
    own = order[head]
    bucket = deal(entries, own)
    sort = np.argsort(bucket, kind="stable")
    own, bucket = own[sort], bucket[sort]
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(own) else []
    for lo, hi in zip(cut, np.append(cut[1:], len(own))):
        part = own[lo:hi]
        place, first, doc = np.unique(entries["place"][part], return_index=True, return_inverse=True)
        cols = {"doc": doc, "lo": entries["lo"][part], "count": entries["count"][part], **{k: entries[k][part] for k in keys}}
        rows.append((ENTRY, int(bucket[lo]), None, pack(cols, (entries["id"][part][first], place))))
    return _frames(rows)


def _placed(found: dict[str, np.ndarray], ids: np.ndarray, places: np.ndarray) -> dict[str, np.ndarray]:
    doc = found.pop("doc")
    return {**found, "id": ids[doc], "place": places[doc]}


def first_step(docs: DataFrame, groups: int, splitters: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(splitters)  # two numbers per bucket

    def run(batches):
        held, n = [], 0
        deal = lambda e, at: bucket_of(e["k1"][at], e["k2"][at], shared.value)
        for pdf in batches:
            ids, places, texts = _numbered(pdf)
            for part in chunks(enumerate(texts)):
                held.append(_placed(suffixes(part), ids, places))
                n += len(held[-1]["k1"])
                if n > FLUSH:
                    yield from _flush(held, KEYS, deal, groups)
                    held, n = [], 0
        if held:
            yield from _flush(held, KEYS, deal, groups)

    def sort(pdf: pd.DataFrame) -> pd.DataFrame:
        if int(pdf["kind"].iloc[0]) == REPEAT:
            return pdf
        e = unpack(pdf["blob"], (*KEYS, "lo", "count"))
        order, head = earliest(e, KEYS)
        rows = _spans(e, order[~head], groups, REPEAT)
        kept = order[head]
        g1, g2 = e["k1"][kept], e["k2"][kept] >> _STRETCH_BITS
        new = np.append(True, (g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1]))
        run_ = np.cumsum(new) - 1
        several = np.bincount(run_)[run_] > 1
        rows += _spans(e, kept[several], groups, COMPARE)
        # A lone stretch at an end of the bucket may have company in the next one.
        for i in {0, len(kept) - 1}:
            gram = struct.pack("<QQ", int(g1[i]), int(g2[i]))
            rows.append((EDGE, int(pdf["target"].iloc[0]), gram, None))
            if not several[i]:
                rows += _spans(e, kept[i:i + 1], groups, MAYBE, gram)
        return pd.DataFrame(rows, columns=["kind", "target", "note", "blob"])

    packed = mapped(docs, run, _ROW)
    return packed.groupBy("kind", "target").applyInPandas(sort, _ROW)


def second_step(grouped: DataFrame, compare: DataFrame, groups: int, buckets: int) -> DataFrame:
    """Strings of the ranges to be compared, each told by its hash."""

    def strings(docs: pd.DataFrame, ranges: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame([], columns=["kind", "target", "note", "blob"])
        if not len(docs) or not len(ranges):
            return empty
        want = unpack(ranges["blob"], ("lo", "count"))
        order = np.argsort(want["place"], kind="stable")
        cut = np.searchsorted(want["place"][order], docs["place"].to_numpy(np.int64), "left")
        end = np.searchsorted(want["place"][order], docs["place"].to_numpy(np.int64), "right")
        open_ = zstandard.ZstdDecompressor()
        found = []
        for i, (lo, hi) in enumerate(zip(cut, end)):
            if lo == hi:
                continue
            text = np.frombuffer(open_.decompress(docs["packed"].iloc[i]), np.uint8)
            own = order[lo:hi]
            starts = spread(want["lo"][own], want["count"][own])
            for first in range(0, max(1, len(text) - LENGTH + 1), CHUNK):
                here = starts[(starts >= first) & (starts < first + CHUNK)]
                if len(here):
                    h = Hashes(text[first:first + CHUNK + LENGTH - 1]).at(here - first, LENGTH)
                    found.append({"k1": h, "lo": here, "count": np.ones(len(here), np.int64),
                                  "id": np.full(len(here), docs["doc_id"].iloc[i]), "place": np.full(len(here), docs["place"].iloc[i])})
        if not found:
            return empty
        deal = lambda e, at: ((e["k1"][at] >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
        return pd.concat(list(_flush(found, ("k1",), deal, groups)))

    def sort(pdf: pd.DataFrame) -> pd.DataFrame:
        if int(pdf["kind"].iloc[0]) == REPEAT:
            return pdf
        e = unpack(pdf["blob"], ("k1", "lo", "count"))
        order, head = earliest(e, ("k1",))
        return pd.DataFrame(_spans(e, order[~head], groups, REPEAT), columns=["kind", "target", "note", "blob"])

    told = grouped.groupBy("target").cogroup(compare.groupBy("target")).applyInPandas(strings, _ROW)
    return told.groupBy("kind", "target").applyInPandas(sort, _ROW)


def cleaned(grouped: DataFrame, repeats: DataFrame) -> DataFrame:
    """Texts without their repeats, summed up."""

    def run(docs: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
        gone = unpack(spans["blob"], ("lo", "count"))
        order = np.argsort(gone["place"], kind="stable")
        places = docs["place"].to_numpy(np.int64)
        cut, end = (np.searchsorted(gone["place"][order], places, side) for side in ("left", "right"))
        open_ = zstandard.ZstdDecompressor()
        rows = []
        for i in range(len(docs)):
            raw = open_.decompress(docs["packed"].iloc[i])
            text, edge = np.frombuffer(raw, np.uint8), np.zeros(len(raw) + 1, np.int32)
            own = order[cut[i]:end[i]]
            np.add.at(edge, gone["lo"][own], 1)
            np.add.at(edge, gone["lo"][own] + gone["count"][own] + LENGTH - 1, -1)
            covered = np.cumsum(edge[:-1]) > 0
            begins = covered & ~np.append(False, covered[:-1]) if len(raw) else covered
            doc = int(docs["doc_id"].iloc[i])
            rows.append((None if doc == _NO_ID else doc, len(raw), int(covered.sum()), int(begins.sum()),
                         hashlib.sha256(text[~covered].tobytes()).hexdigest()))
        return pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]).astype({"doc_id": "Int64"})

    return grouped.groupBy("target").cogroup(repeats.groupBy("target")).applyInPandas(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def find_splitters(docs: DataFrame, rows: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of the sort keys of a bounded sample of documents, a few suffixes of each; they only shape buckets."""

    def run(batches):
        for pdf in batches:
            ids, places, texts = _numbered(pdf)
            for part in chunks(enumerate(texts)):
                s = suffixes(part)
                step = max(1, len(s["k1"]) // (50 * len(part)))
                yield pd.DataFrame({"k1": s["k1"][::step].view(np.int64), "k2": s["k2"][::step].view(np.int64)})

    every = max(1, rows // SAMPLE)
    sample = docs.filter(F.pmod(F.xxhash64("place"), F.lit(every)) == 0)
    got = mapped(sample, run, "k1 long, k2 long").limit(SAMPLE * 100).collect()
    k1, k2 = (np.array([r[c] for r in got], np.int64).view(_U) for c in ("k1", "k2"))
    order = np.lexsort((k2, k1))
    at = order[(np.arange(1, buckets) * len(order)) // buckets] if len(order) else order
    return k1[at], k2[at]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row; ``docs`` is a table read from files.

    Null and empty texts have no bytes. Rows with equal ids are documents of their own, in the order of their place in
    the table; a row without an id comes before all others. Texts under LENGTH bytes stay whole.
    """
    scratch = Scratch(docs.sparkSession)
    placed = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("place"))
    n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    groups, buckets = max(1, -(-size // GROUP_BYTES)), max(1, -(-size // BUCKET_BYTES))

    def shelve(batches):
        close = zstandard.ZstdCompressor(level=3)
        for pdf in batches:
            ids, places, texts = _numbered(pdf)
            yield pd.DataFrame({"target": group_of(places, groups), "place": places, "doc_id": ids,
                                "packed": [close.compress(t) for t in texts]})

    grouped = mapped(placed, shelve, "target long, place long, doc_id long, packed binary")
    one = scratch.write(first_step(placed, groups, find_splitters(placed, n, buckets)))
    # Two rows per bucket: grams at the ends of buckets that several buckets have.
    edges = one.filter(F.col("kind") == EDGE).groupBy("note").agg(F.countDistinct("target").alias("n")).filter("n > 1")
    compare = one.filter(F.col("kind") == COMPARE).unionByName(
        one.filter(F.col("kind") == MAYBE).join(edges.select("note"), "note", "left_semi").select(one.columns))
    strings = compare.agg(F.sum(F.octet_length("blob"))).first()[0] or 0
    two = scratch.write(second_step(grouped, compare, groups, max(1, -(-strings // (BUCKET_STRINGS // 2)))))
    repeats = one.filter(F.col("kind") == REPEAT).unionByName(two.filter(F.col("kind") == REPEAT))
    return cleaned(grouped, repeats)
