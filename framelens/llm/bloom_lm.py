"""Language-model scores from a log-frequency Bloom filter (Talbot and Osborne, 2007).

Counts of words and of word pairs are quantised on a logarithmic scale, and an n-gram of level q is put into the filter
once for each level 1 to q. A count is read by asking for level 1, 2, ... until one is missing, so errors only ever
raise a count. Pair and word counts give an interpolated probability.

Counting: a task counts its own n-grams and passes on one packed list per segment of the hash range; a segment holds
what about ``SEGMENT_BYTES`` of text can contribute, is merged by one task and becomes a piece of the filter. The pieces
are broadcast in groups of at most ``BROADCAST`` bytes, one scoring pass per group: a pass scores the tokens whose pair
lies in its group, so the size of a broadcast is bounded whatever the corpus, at the price of more passes. Only the
filter of single words, which every pass needs for the contexts, is whole in each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from framelens.llm.common import Scratch, group_sums, in_slices, lengths, lower_words, mapped

SEGMENT_BYTES, BROADCAST, FLUSH = 8 << 20, 96 << 20, 3_000_000
#: Bits per entry and probes per entry of the filter: about one false level in sixteen.
BITS, PROBES = 6, 3
#: A context seen c times is trusted with weight c / (c + TRUST).
TRUST = 4.0
_U = np.uint64
_END = _U(xxhash.xxh64_intdigest(b"\n"))  # no word is a line feed; ends a text and stands before its first word


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


def tokens(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct tokens, number of each token of all texts, of the one before it, and tokens per text."""
    found = [lower_words(t) for t in texts]
    sizes = lengths(found) + 1
    codes, names = pd.factorize(np.array([w for ws in found for w in ws], dtype=object))
    hashes = np.concatenate([np.array([xxhash.xxh64_intdigest(w) for w in names], _U), [_END]])
    ends = np.cumsum(sizes) - 1
    seq = np.full(sizes.sum(), len(names), np.int64)
    inner = np.ones(len(seq), bool)
    inner[ends] = False
    seq[inner] = codes
    before = np.concatenate([[len(names)], seq[:-1]])  # an end stands before every text's first token
    return hashes, seq, before, sizes


def pairs(hashes: np.ndarray, before: np.ndarray, seq: np.ndarray) -> np.ndarray:
    """48-bit keys of the token pairs (in the upper bits); far fewer collide than the filter errs."""
    return _mix(hashes[before] * _U(0x9E3779B97F4A7C15) + hashes[seq]) & _U(0xFFFFFFFFFFFF0000)


def segment(keys: np.ndarray, n: int) -> np.ndarray:
    """Segments are consecutive ranges of the keys."""
    return ((keys >> _U(32)) * _U(n) >> _U(32)).astype(np.int64)


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte, so that the leading zero bytes compress."""
    gaps = np.diff(keys, prepend=_U(0))
    return gaps.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() + counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw) // 12
    planes = np.frombuffer(raw, np.uint8)
    gaps = np.ascontiguousarray(planes[:8 * n].reshape(8, n).T).view("<u8")[:, 0]
    return np.cumsum(gaps, dtype=_U), np.ascontiguousarray(planes[8 * n:].reshape(4, n).T).view("<u4")[:, 0].astype(np.int64)


def count(docs: DataFrame, segments: int) -> DataFrame:
    """``kind`` (0 words, 1 pairs)``, segment, packed`` of the n-grams of the texts, several lists per segment."""

    def flushed(kind: int, keys: list[np.ndarray], times: list[np.ndarray]):
        keys, order = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.bincount(order, np.concatenate(times), len(keys)).astype(np.int64)
        cut = np.searchsorted(segment(keys, segments), np.arange(segments + 1))
        own = [s for s in range(segments) if cut[s] < cut[s + 1]]
        for lo in range(0, len(own), 16):
            part = own[lo:lo + 16]
            yield pd.DataFrame({"kind": kind, "segment": part, "packed": [
                pack(keys[cut[s]:cut[s + 1]], counts[cut[s]:cut[s + 1]]) for s in part]})

    def run(batches):
        held: tuple[list, list, list, list] = ([], [], [], [])
        n = 0
        for pdf in in_slices(batches):
            hashes, seq, before, _ = tokens(pdf["text"])
            held[0].append(hashes)
            held[1].append(np.bincount(seq, minlength=len(hashes)))
            keys, times = np.unique(pairs(hashes, before, seq), return_counts=True)
            held[2].append(keys)
            held[3].append(times)
            n += len(seq)
            if n > FLUSH:
                yield from flushed(0, held[0], held[1])
                yield from flushed(1, held[2], held[3])
                held, n = ([], [], [], []), 0
        if n:
            yield from flushed(0, held[0], held[1])
            yield from flushed(1, held[2], held[3])

    return mapped(docs.select("text"), run, "kind int, segment long, packed binary")


def levels(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1]  # 1 for 1, 2 for 2 and 3, 3 for 4 to 7, ...


def estimate(level: np.ndarray) -> np.ndarray:
    """The middle of a level's counts; zero for level zero."""
    return np.where(level > 0, 1.5 * 2.0 ** (level - 1) - 0.5, 0.0)


def _places(keys: np.ndarray, level: int, size: np.ndarray) -> np.ndarray:
    """Bits of the entries (key, level) within their piece; PROBES rows."""
    h = _mix(keys + _U(level * 0x9E3779B97F4A7C15 % (1 << 64)))
    step = (h >> _U(33)) | _U(1)
    return np.array([((h >> _U(8)) + _U(i) * step) % size for i in range(PROBES)])


def piece(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A filter for the entries of one segment, as packed bits."""
    level = levels(counts)
    size = max(64, -(-int(level.sum()) * BITS // 64) * 64)
    bits = np.zeros(size, np.uint8)
    for q in range(1, int(level.max(initial=0)) + 1):
        bits[_places(keys[level >= q], q, _U(size))] = 1
    return np.packbits(bits)


@dataclass
class Filter:
    """Pieces of consecutive segments laid out one after the other."""

    first: int
    segments: int
    sizes: np.ndarray
    bits: np.ndarray

    @classmethod
    def of(cls, pieces: dict[int, bytes], first: int, last: int, segments: int) -> "Filter":
        own = [pieces.get(s, b"") for s in range(first, last)]
        return cls(first, segments, np.array([8 * len(p) for p in own], np.int64), np.frombuffer(b"".join(own), np.uint8))

    def holds(self, keys: np.ndarray) -> np.ndarray:
        s = segment(keys, self.segments) - self.first
        return (s >= 0) & (s < len(self.sizes))

    def level(self, keys: np.ndarray) -> np.ndarray:
        """Levels of keys that lie in these segments."""
        offset = np.cumsum(self.sizes) - self.sizes
        s = segment(keys, self.segments) - self.first
        out, open_ = np.zeros(len(keys), np.int64), np.flatnonzero(self.sizes[s] > 0)
        q = 0
        while len(open_):
            q += 1
            at = _places(keys[open_], q, self.sizes[s[open_]].astype(_U)).astype(np.int64) + offset[s[open_]]
            open_ = open_[((self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)]
            out[open_] = q
            if q == 64:
                break
        return out


@dataclass
class Pass:
    """What one scoring pass is given: a range of segments of pairs and of exact word counts, and all word levels."""

    words: Filter
    pairs: Filter
    keys: np.ndarray
    counts: np.ndarray
    total: int
    distinct: int

    def score(self, texts) -> dict[str, np.ndarray]:
        hashes, seq, before, sizes = tokens(texts)
        exact = np.zeros(len(hashes), np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            exact = np.where(self.keys[at] == hashes, self.counts[at], 0)
        own = self.pairs.holds(hashes)  # words are dealt over the passes like pairs
        room = self.total + self.distinct + 1
        base = np.where(own, np.log10((exact + 1) / room), 0.0)
        seen = estimate(self.words.level(hashes))
        key = pairs(hashes, before, seq)
        mine = np.flatnonzero(self.pairs.holds(key))
        both = estimate(self.pairs.level(key[mine]))
        context = seen[before[mine]]
        trust = context / (context + TRUST)
        p = trust * np.minimum(1.0, both / np.maximum(context, 1.0)) + (1 - trust) * (seen[seq[mine]] + 1) / room
        value = np.zeros(len(seq))
        value[mine] = np.log10(np.minimum(p, 1.0))
        sums = lambda v: np.add.reduceat(v, np.cumsum(sizes) - sizes)  # noqa: E731  every text has its end
        return {"n_tokens": sizes, "n_known": sums((own & (exact > 0))[seq].astype(np.int64)), "base_score": sums(base[seq]),
                "score": sums(value)}


@dataclass
class Model:
    table: DataFrame
    segments: int
    total: int
    distinct: int
    ranges: list[tuple[int, int]]

    def load(self, first: int, last: int) -> Pass:
        rows = self.table.filter((F.col("kind") == 0) | F.col("segment").between(first, last - 1)).select(
            "kind", "segment", "bits", F.when(F.col("segment").between(first, last - 1), F.col("exact")).alias("exact"))
        words, both, exact = {}, {}, {}
        for r in rows.coalesce(8).toLocalIterator():  # a partition at a time, so that the driver holds the pieces once
            (both if r["kind"] else words)[r["segment"]] = r["bits"]
            if r["exact"] is not None:
                exact[r["segment"]] = unpack(r["exact"])
        held = [exact[s] for s in sorted(exact)]
        empty = (np.zeros(0, _U), np.zeros(0, np.int64))
        keys, counts = (np.concatenate(x) for x in zip(*held)) if held else empty
        return Pass(Filter.of(words, 0, self.segments, self.segments), Filter.of(both, first, last, self.segments), keys,
                    counts.astype(np.uint32), self.total, self.distinct)


def train(docs: DataFrame, scratch: Scratch) -> Model:
    """Count all texts of ``docs`` (null counts as empty) and build the filter's pieces."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    segments = max(1, -(-size // SEGMENT_BYTES))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, times = (np.concatenate(x) for x in zip(*[unpack(r) for r in pdf["packed"]]))
        keys, at = np.unique(keys, return_inverse=True)
        counts = np.bincount(at, times, len(keys)).astype(np.int64)
        kind = int(pdf["kind"].iloc[0])
        return pd.DataFrame({"kind": [kind], "segment": [int(pdf["segment"].iloc[0])], "n": [int(counts.sum())],
                             "distinct": [len(keys)], "bits": [piece(keys, counts).tobytes()],
                             "exact": [None if kind else pack(keys, counts)]})

    table = scratch.write(count(docs, segments).groupBy("kind", "segment").applyInPandas(
        merge, "kind int, segment long, n long, distinct long, bits binary, exact binary"))
    word = table.filter("kind = 0").agg(F.sum("n"), F.sum("distinct")).first()
    # Bytes per segment, a few numbers for every SEGMENT_BYTES of text, cut the segments into passes.
    sizes = table.groupBy("segment").agg(F.sum(F.octet_length("bits") + F.coalesce(F.octet_length("exact"), F.lit(0)))
                                         .alias("bytes")).orderBy("segment").collect()
    ranges, first, held = [], 0, 0
    for r in sizes:
        if held and held + r["bytes"] > BROADCAST:
            ranges.append((first, r["segment"]))
            first, held = r["segment"], 0
        held += r["bytes"]
    ranges.append((first, segments))
    return Model(table, segments, word[0] or 0, word[1] or 0, ranges)


def score(docs: DataFrame, model: Model, scratch: Scratch, held_out: Column) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    A null or empty text is its end token alone; without training tokens all scores are zero. Repeated rows are scored
    each: rows are told apart by their place in the scan.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", held_out.alias("held_out"), F.monotonically_increasing_id().alias("place"), "text")
    parts = []
    for first, last in model.ranges:
        shared = spark.sparkContext.broadcast(model.load(first, last))

        def run(batches, shared=shared):
            for pdf in in_slices(batches):
                yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "held_out": pdf["held_out"],
                                    "place": pdf["place"], **{k: v for k, v in shared.value.score(pdf["text"]).items()}})

        done = mapped(rows, run, "doc_id long, held_out boolean, place long, n_tokens long, n_known long, "
                      "base_score double, score double")
        parts.append(done if len(model.ranges) == 1 else scratch.write(done))
        if len(model.ranges) > 1:
            shared.destroy()
    out = parts[0]
    if len(parts) > 1:
        for p in parts[1:]:
            out = out.unionByName(p)
        out = out.groupBy("place").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"),
                                       F.first("n_tokens").alias("n_tokens"), *[F.sum(c).alias(c) for c in (
                                           "n_known", "base_score", "score")])
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"),
                      "base_score", "score")
