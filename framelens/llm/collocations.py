"""Collocations per language, mined by best-first branch-and-bound growth of phrases.

A phrase of two to five words that occurs ``a`` times is scored by its weakest cut: floor(1000 a n / (l r)), where l and r
count the two parts and n all words of the language. Any phrase that begins with a word occurring l times has r >= a for
the cut after that word, so its score is at most floor(1000 n / l); a phrase that ends with a word occurring r times has
at most floor(1000 n / r). Both bounds are admissible and known before anything is counted but words.

Phrases grow word by word from their prefixes, those with the greatest bound first. A wave takes a bounded number of open
prefixes, the best of each language, and one pass over the corpus counts everything that waits:

* the words that follow an open prefix, whose frequent ones are new phrases;
* parts of new phrases that are not counted yet, because their own first word is too common to be expanded;
* the words before a phrase that would be a result, since a longer phrase as frequent as it supersedes it.

The limit of a language is the score of its last result so far (zero while there are too few); it only rises. What is
bounded below it is never counted. The search ends when nothing open reaches the limit, so all ties with it are settled.

The corpus is read once as text, written as one 64-bit hash per word, and words are counted by their bytes, which tells
whether two words of a language share a hash; in that case it is read again with another seed. So results are exact.
Tables of phrases stay in Spark. A task gets the wave's phrases (``WAVE`` of each kind at most) and a table of
``2**GATE`` truth values for frequent words, both of fixed size, and sends one row per counted pair.

Null languages are ``und``; null and empty texts have no words. Repeated rows and ids count again. An empty table gives
no rows.
"""

from __future__ import annotations

import zlib
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from framelens.llm.common import LOWER, UPPER, Scratch, lengths

LONGEST, LEAST, TOP, PERCENT = 5, 100, 2000, 100
#: Phrases of each kind in a wave, bits of the table of frequent words, words a task counts before it sends them.
WAVE, GATE, WORDS = 1 << 14, 22, 200_000
#: Share of a language's words that the prefixes of a wave make up: one in ``SLOW`` in the first waves, which settle a
#: first limit, then twice as much each time.
SLOW, FIRST = 16, 4
#: Bytes of text split at once, and counted pairs a task holds before it adds them up.
PART, PAIRS = 1 << 21, 1 << 19
GROW, LEFT, WANT = 0, 1, 2
_SEPARATORS = b".,;:!?\n\v\f\r"
#: Upper to lower case, tab to space, every separator to a comma.
_PLAIN = bytes.maketrans(UPPER.encode() + b"\t" + _SEPARATORS, LOWER.encode() + b" " + b"," * len(_SEPARATORS))


# --- the corpus as hashes -----------------------------------------------------------------------------------------


def by_size(batches, column: str):
    """The batches in pieces of about ``PART`` letters or bytes of a column, one row at least."""
    for pdf in batches:
        piece = np.cumsum(pdf[column].map(len, na_action="ignore").fillna(0).to_numpy(np.int64)) // PART
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(pdf)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo < hi:
                yield pdf.iloc[lo:hi]


class Words(dict):
    """Numbers of words in order of appearance; a break between pieces is number 0, nothing is number 1."""

    def __init__(self):
        super().__init__({b",": 0, b"": 1})

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def parts_of(text: str | None) -> list[bytes]:
    """A text in plain letters with commas as words of their own, in parts cut between words."""
    raw = text.encode("utf-8").translate(_PLAIN) if text else b""
    cuts = [0]
    while len(raw) - cuts[-1] > PART and (end := raw.find(b" ", cuts[-1] + PART)) >= 0:
        cuts.append(end)
    return [raw[lo:hi].replace(b",", b" , ") for lo, hi in zip(cuts, cuts[1:] + [len(raw)])]


def numbers(texts: list[str | None], known: Words) -> list[np.ndarray]:
    """Numbers of the words of each text, with breaks between its pieces."""
    parts = [parts_of(t) for t in texts]
    found = pc.ascii_split_whitespace(pa.array([p for x in parts for p in x], pa.large_binary()).cast(pa.large_string()))
    words = found.flatten().dictionary_encode()
    names = words.dictionary.cast(pa.large_binary()).to_pylist()
    at = np.fromiter(map(known.__getitem__, names), np.int32, len(names))[words.indices.to_numpy()]
    # The ends of a part give empty words, number 1.
    real = at != 1
    upto = np.concatenate([[0], np.cumsum(real)])[found.offsets.to_numpy()]
    ends = upto[np.cumsum(lengths(parts))].tolist()
    at = at[real]
    return [at[lo:hi] for lo, hi in zip([0, *ends], ends)]


def hashes(words: list[bytes], seed: int) -> np.ndarray:
    """64-bit hashes of words; zero stands for breaks only."""
    out = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words)).view(np.int64)
    out[out == 0] = 1
    return out


def encoded(docs: DataFrame, seed: int) -> DataFrame:
    """``lang, ids`` of every row with words, and ``lang, word, h, n`` of every word that a task has counted."""

    def run(batches):
        known, code, counts = Words(), np.zeros(2, np.int64), {}

        def counted():
            names = list(known)
            for lang, c in counts.items():
                for lo in range(0, len(c), 1 << 16):
                    at = lo + np.flatnonzero(c[lo:lo + (1 << 16)])
                    at = at[at > 1]
                    if len(at):
                        yield pd.DataFrame({"lang": lang, "ids": None, "word": [names[i] for i in at.tolist()], "h": code[at], "n": c[at]})

        for pdf in by_size(batches, "text"):
            ids = numbers(pdf["text"].tolist(), known)
            if len(known) > len(code):
                code = np.concatenate([code, hashes(list(known)[len(code):], seed)])
            langs = pdf["lang"].tolist()
            some = [(lang, i) for lang, i in zip(langs, ids) if i.any()]
            for lang in {lang for lang, _ in some}:
                c = np.bincount(np.concatenate([i for x, i in some if x == lang]), minlength=len(known))
                if lang in counts:
                    c[:len(counts[lang])] += counts[lang]
                counts[lang] = c
            if some:
                yield pd.DataFrame({"lang": [x for x, _ in some], "ids": [code[i].tobytes() for _, i in some], "word": None, "h": 0, "n": 0})
            if len(known) > WORDS or sum(map(len, counts.values())) > 8 * WORDS:
                yield from counted()
                known, code, counts = Words(), np.zeros(2, np.int64), {}
        yield from counted()

    rows = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    return rows.mapInPandas(run, "lang string, ids binary, word binary, h long, n long")


def corpus(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Written tables: ``lang, ids`` of texts (null in other rows) and the counted words ``lang, h, word, f`` of hashes
    that no two words of a language share."""
    seed = 0
    while True:
        rows = scratch.write(encoded(docs, seed), compression="zstd")
        words = scratch.write(rows.filter("word IS NOT NULL").groupBy("lang", "h").agg(
            F.sum("n").alias("f"), F.min("word").alias("word"), F.max("word").alias("other")))
        if words.filter("word <> other").isEmpty():
            return rows, words
        scratch.drop(rows, words)
        seed += 1


# --- one pass -----------------------------------------------------------------------------------------------------


def _lang(lang: str) -> int:
    return zlib.crc32(lang.encode("utf-8")) & ((1 << GATE) - 1)


def gate(words: DataFrame) -> np.ndarray:
    """Truth values by hash of language and word: all frequent words pass, few others do."""
    langs = words.select("lang").distinct().withColumn("s", F.crc32("lang").bitwiseAND((1 << GATE) - 1))
    slot = F.col("h").bitwiseAND((1 << GATE) - 1).bitwiseXOR(F.col("s")).cast("int")
    bits = words.join(langs, "lang").select(slot.alias("slot")).groupBy((F.col("slot") / 64).cast("int").alias("at")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(63))).alias("bits"))
    table = np.zeros(1 << GATE - 6, np.int64)
    found = bits.toArrow()  # 2**GATE / 64 numbers at most
    table[found["at"].to_numpy()] = found["bits"].to_numpy()
    return np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool)


class Trie:
    """The phrases of one language that a pass looks for, level by level.

    A node of a level is its place among the sorted keys (node of the level before, word); ``roles[level][kind]`` has
    the request that a node stands for, or -1.
    """

    def __init__(self, request: np.ndarray, size: np.ndarray, hashes: np.ndarray, kinds: np.ndarray):
        """Requests with the sizes of their phrases, the phrases' hashes one after the other, and a column per kind."""
        table = np.zeros((len(size), LONGEST), np.int64)
        table[np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = hashes
        self.words = np.unique(table[table != 0])
        self.width = len(self.words)
        self.gate = np.zeros(1 << 18, bool)
        self.gate[self.words & ((1 << 18) - 1)] = True
        at = np.searchsorted(self.words, table)
        node = np.zeros(len(size), np.int64)
        self.keys, self.roles = [], []
        for m in range(int(size.max())):
            deep = size > m
            key = node[deep] * self.width + at[deep, m]
            self.keys.append(np.unique(key))
            node[deep] = np.searchsorted(self.keys[-1], key)
            own = size == m + 1
            roles = np.full((3, len(self.keys[-1])), -1, np.int64)
            for kind in (GROW, LEFT, WANT):
                some = own & kinds[:, kind]
                roles[kind, node[some]] = request[some]
            self.roles.append(roles)

    def find(self, ids: np.ndarray, may: np.ndarray, spread: int):
        """(kind, requests, words) of what follows, what stands before and what is there. ``ids`` starts with a break
        and ends with ``LONGEST`` of them."""
        place = np.flatnonzero(self.gate[ids & ((1 << 18) - 1)])
        where = np.searchsorted(self.words, ids[place])
        real = self.words[np.minimum(where, self.width - 1)] == ids[place]
        word = np.full(len(ids), -1, np.int32)
        word[place[real]] = where[real]
        at, node = place[real], np.zeros(int(real.sum()), np.int64)
        mask = (1 << GATE) - 1
        for m, (keys, roles) in enumerate(zip(self.keys, self.roles)):
            step = word[at + m]
            at, node, step = at[step >= 0], node[step >= 0], step[step >= 0]
            key = node * self.width + step
            node = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            here = keys[node] == key
            at, node = at[here], node[here]
            if not len(at):
                return
            for kind, beside in ((GROW, m + 1), (LEFT, -1)):
                request = roles[kind][node]
                near = ids[at + beside]
                ok = (request >= 0) & (near != 0) & may[(near & mask) ^ spread]
                yield kind, request[ok], near[ok]
            request = roles[WANT][node]
            request = request[request >= 0]
            yield WANT, request, np.zeros(len(request), np.int64)


def tries(asked: pa.Table) -> dict[str, Trie]:
    """The requested phrases by language."""
    out = {}
    for lang in pc.unique(asked["lang"]).to_pylist():
        own = asked.filter(pc.equal(asked["lang"], lang)).combine_chunks()
        column = lambda c: own[c].to_numpy()
        out[lang] = Trie(column("request"), pc.list_value_length(own["w"]).to_numpy().astype(np.int64),
                         pc.list_flatten(own["w"]).to_numpy(), np.stack([column(c) for c in ("grow", "left", "want")], axis=1))
    return out


def totals(kind: np.ndarray, request: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums of ``n`` by the other columns."""
    if not len(n):
        return kind, request, h, n
    order = np.lexsort((h, request, kind))
    kind, request, h, n = kind[order], request[order], h[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (request[1:] != request[:-1]) | (h[1:] != h[:-1])]))
    return kind[new], request[new], h[new], np.add.reduceat(n, new)


def counted(rows: DataFrame, shared: Broadcast, least: int) -> DataFrame:
    """``kind, request, h, n`` over the corpus, where n is at least ``least``; ``shared`` has tries and packed truth values."""

    def run(batches):
        tries, packed = shared.value
        may = np.unpackbits(packed).astype(bool)
        held, size = [], 0

        def merged():
            return totals(*(np.concatenate(x) for x in zip(*held)))

        def sent(found):
            for lo in range(0, len(found[3]), 1 << 17):
                yield pd.DataFrame(dict(zip(("kind", "request", "h", "n"), (x[lo:lo + (1 << 17)] for x in found))))

        ends = bytes(8 * LONGEST)
        for pdf in by_size(batches, "ids"):
            for lang, ids in pdf.groupby("lang", sort=False)["ids"]:
                if lang not in tries:
                    continue
                flat = np.frombuffer(bytes(8) + bytes(8).join(ids) + ends, np.int64)
                for kind, request, h in tries[lang].find(flat, may, _lang(lang)):
                    found = totals(np.full(len(h), kind, np.int8), request, h, np.ones(len(h), np.int64))
                    held.append(found)
                    size += len(found[3])
            if size > PAIRS:
                held = [merged()]
                size = len(held[0][3])
                if size > PAIRS // 2:
                    yield from sent(held[0])
                    held, size = [], 0
        if held:
            yield from sent(merged())

    parts = rows.mapInPandas(run, "kind int, request long, h long, n long")
    return parts.groupBy("kind", "request", "h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


# --- the search ---------------------------------------------------------------------------------------------------


def _per_lang(rows: DataFrame, order: list, most: int) -> DataFrame:
    """At most ``most`` rows, dealt to the languages in turn, each in its own order."""
    ranked = rows.withColumn("turn", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("turn") <= most)
    return ranked.orderBy("turn", "lang").limit(most).drop("turn")


def bounded(phrases: DataFrame, words: DataFrame, sizes: DataFrame) -> DataFrame:
    """``lang, w, f`` with ``n``, ``open`` (bound of what grows from it) and ``most`` (bound of its own score)."""
    ends = words.select("lang", "h", F.col("f").alias("e"))
    rows = phrases.join(sizes, "lang").withColumn("h", F.element_at("w", 1)).join(ends, ["lang", "h"]).withColumnRenamed("e", "first")
    rows = rows.withColumn("h", F.element_at("w", -1)).join(ends, ["lang", "h"]).withColumnRenamed("e", "last").drop("h")
    bound = "cast(1000 as decimal(4,0)) * cast(n as decimal(19,0)) div cast({} as decimal(19,0))"
    return rows.select("lang", "w", "f", "n", F.expr(bound.format("first")).alias("open"),
                       F.expr(bound.format("greatest(first, last)")).alias("most"))


_STATE = {"grown": "boolean", "after": "long", "before": "long", "score": "long", "l": "long", "r": "long"}


def opened(phrases: DataFrame, words: DataFrame, sizes: DataFrame) -> DataFrame:
    """New phrases with nothing known about them but their count."""
    return bounded(phrases, words, sizes).select("*", F.lit(False).alias("grown"), *[
        F.lit(None).cast(t).alias(c) for c, t in _STATE.items() if c != "grown"])


def scored(nodes: DataFrame, limits: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``nodes`` with scores where both parts of all cuts are counted, the parts ``lang, w`` that are not, and the
    written table that both read."""
    due = nodes.filter("score IS NULL AND size(w) > 1").join(limits, "lang").filter("most >= least")
    cuts = due.select("lang", "w", "f", "n", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("*", F.expr("slice(w, 1, k)").alias("head"), F.expr("slice(w, k + 1, size(w) - k)").alias("tail"))
    known = nodes.select("lang", "w", "f")
    for part, f in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(known.select("lang", F.col("w").alias(part), F.col("f").alias(f)), ["lang", part], "left")
    cuts = scratch.write(cuts)
    value = F.expr("cast(1000 as decimal(4,0)) * cast(f as decimal(17,0)) * cast(n as decimal(17,0)) "
                   "div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    lowest = cuts.groupBy("lang", "w").agg(
        F.min(F.struct(value.alias("score"), "k", "l", "r")).alias("x"),
        F.count(F.when(F.col("l").isNull() | F.col("r").isNull(), 1)).alias("missing"))
    done = lowest.filter("missing = 0").select("lang", "w", "x.score", "x.l", "x.r")
    wanted = cuts.select("lang", F.explode(F.array(F.when(F.col("l").isNull(), F.col("head")), F.when(F.col("r").isNull(), F.col("tail")))).alias("w"))
    wanted = wanted.filter("w IS NOT NULL").distinct()
    rows = nodes.join(done.select("lang", "w", *[F.col(c).alias("new_" + c) for c in ("score", "l", "r")]), ["lang", "w"], "left")
    return rows.select("lang", "w", "f", "n", "open", "most", "grown", "after", "before",
                       *[F.coalesce(c, "new_" + c).alias(c) for c in ("score", "l", "r")]), wanted, cuts


def survivors(nodes: DataFrame, percent: int, longest: int) -> DataFrame:
    """Scored phrases that no longer phrase supersedes, as far as that is settled."""
    settled = F.col("grown") & F.col("after").isNotNull() & F.col("before").isNotNull()
    apart = 100 * F.greatest("after", "before") < percent * F.col("f")
    return nodes.filter("score IS NOT NULL").filter((F.size("w") == longest) | (settled & apart))


def limits_of(found: DataFrame, sizes: DataFrame, top: int) -> DataFrame:
    """``lang, least``: the score of the last result, zero while there are not enough."""
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score")))
    last = found.withColumn("place", place).filter(F.col("place") <= top).groupBy("lang").agg(
        F.max(F.when(F.col("place") == top, F.col("score"))).alias("least"))
    return sizes.join(last, "lang", "left").select("lang", F.coalesce("least", F.lit(0).cast("long")).alias("least"))


def best_open(live: DataFrame, wave: int) -> DataFrame:
    """Open prefixes by classes of their bound, as many of the best classes as make up the wave's share of the words.

    Common words have the lowest bounds and most of the occurrences, so a wave leaves them while rarer ones are open.
    """
    share = SLOW / 2.0 ** max(0, wave - FIRST + 1)
    level = F.floor(8 * F.log2(F.col("open") + 1))
    opened = live.filter("NOT grown AND open >= least").withColumn("level", level)
    upto = F.sum("f").over(Window.partitionBy("lang").orderBy(F.desc("level"))) - F.col("f")
    levels = opened.groupBy("lang", "level").agg(F.sum("f").alias("f"), F.max("n").alias("n"))  # some hundreds a language
    levels = levels.withColumn("upto", upto).filter(F.col("upto") * share < F.col("n")).select("lang", "level")
    return _per_lang(opened.join(levels, ["lang", "level"]), [F.desc("open"), F.desc(F.size("w")), "w"], WAVE)


def requests(nodes: DataFrame, wanted: DataFrame, limits: DataFrame, percent: int, longest: int, wave: int) -> DataFrame:
    """``request, lang, w, grow, left, want``: what the next pass counts, at most ``WAVE`` phrases of each kind."""
    live = nodes.join(limits, "lang").filter(F.size("w") < longest)
    grow = best_open(live, wave)
    apart = 100 * F.col("after") < percent * F.col("f")
    left = _per_lang(live.filter("grown AND before IS NULL AND score >= least").filter(apart), [F.desc("score"), "w"], WAVE)
    want = _per_lang(wanted, ["w"], WAVE)
    parts = [t.select("lang", "w", *[F.lit(k == kind).alias(c) for k, c in enumerate(("grow", "left", "want"))])
             for kind, t in enumerate((grow, left, want))]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    once = both.groupBy("lang", "w").agg(*[F.max(c).alias(c) for c in ("grow", "left", "want")])
    return once.select(F.monotonically_increasing_id().alias("request"), "*")


def updated(nodes: DataFrame, asked: DataFrame, found: DataFrame, words: DataFrame, sizes: DataFrame) -> DataFrame:
    """``nodes`` with what a pass has found about them, and its new phrases."""
    got = found.join(asked, "request")
    most = got.groupBy("lang", "w").agg(F.max(F.when(F.col("kind") == GROW, F.col("n"))).alias("a"),
                                        F.max(F.when(F.col("kind") == LEFT, F.col("n"))).alias("b"))
    told = asked.join(most, ["lang", "w"], "left").select(
        "lang", "w", F.col("grow").alias("now"), F.when(F.col("grow"), F.coalesce("a", F.lit(0))).alias("a"),
        F.when(F.col("left"), F.coalesce("b", F.lit(0))).alias("b"))
    old = nodes.join(told, ["lang", "w"], "left").select(
        "lang", "w", "f", "n", "open", "most", (F.col("grown") | F.coalesce("now", F.lit(False))).alias("grown"),
        F.coalesce("after", "a").alias("after"), F.coalesce("before", "b").alias("before"), "score", "l", "r")
    new = got.filter(F.col("kind") != LEFT).select("lang", F.when(F.col("kind") == GROW, F.concat("w", F.array("h"))).otherwise(F.col("w")).alias("w"),
                                                   F.col("n").alias("f")).distinct()
    new = new.join(nodes.select("lang", "w"), ["lang", "w"], "left_anti")
    return old.unionByName(opened(new, words, sizes))


def mine(docs: DataFrame, top: int = TOP, least: int = LEAST, percent: int = PERCENT, longest: int = LONGEST) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of every language."""
    scratch = Scratch(docs.sparkSession)
    written, counts = corpus(docs, scratch)
    rows = written.filter("ids IS NOT NULL").select("lang", "ids")
    sizes = scratch.write(counts.groupBy("lang").agg(F.sum("f").alias("n")))
    words = scratch.write(counts.filter(F.col("f") >= least).drop("other"))
    scratch.drop(counts)
    may = np.packbits(gate(words))
    nodes = scratch.write(opened(words.select("lang", F.array("h").alias("w"), "f"), words, sizes))
    for wave in count():
        limits = scratch.write(limits_of(survivors(nodes, percent, longest), sizes, top))
        valued, wanted, cuts = scored(nodes, limits, scratch)
        after = scratch.write(valued)
        asked = scratch.write(requests(after, wanted, limits, percent, longest, wave))
        by_lang = tries(asked.toArrow())  # 3 * WAVE phrases at most
        if not by_lang:
            scratch.drop(written, nodes, cuts, asked)
            break
        shared = docs.sparkSession.sparkContext.broadcast((by_lang, may))  # fixed size, see WAVE and GATE
        found = scratch.write(counted(rows, shared, least))
        shared.destroy()
        del by_lang
        new = scratch.write(updated(after, asked, found, words, sizes))
        scratch.drop(nodes, limits, cuts, after, asked, found)
        nodes = new
        scratch.sweep()
    best = survivors(after, percent, longest).join(limits, "lang").filter("score >= least")
    spelt = best.select("lang", "w", F.posexplode("w").alias("pos", "h")).join(words.select("lang", "h", F.col("word").cast("string")), ["lang", "h"])
    spelt = spelt.groupBy("lang", "w").agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("x"))  # five words at most
    phrase = F.array_join(F.transform("x", lambda x: x["word"]), " ")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    named = best.join(spelt, ["lang", "w"]).select("lang", phrase.alias("phrase"), F.col("f").alias("a"), "l", "r", "n", "score")
    return named.withColumn("rank", place.cast("long")).filter(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")


def sql(top: int = TOP, least: int = LEAST, percent: int = PERCENT, longest: int = LONGEST) -> str:
    """The same rows from counts of all phrases."""
    sizes = ", ".join(str(m) for m in range(1, longest + 1))
    return f"""WITH p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM p),
s AS (SELECT lang, count(*) AS n FROM i GROUP BY lang),
c AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, any_value(ws[i:i + m - 1]) AS w, count(*) AS a
  FROM i, (SELECT unnest([{sizes}]) AS m) WHERE i + m - 1 <= len(ws) GROUP BY 1, 2, 3 HAVING count(*) >= {least}),
k AS (SELECT lang, phrase, m, w, a, unnest(range(1, m)) AS k FROM c WHERE m > 1),
v AS (SELECT k.lang, k.phrase, k.m, k.a, k.k, l.a AS l, r.a AS r, s.n,
    (1000::HUGEINT * k.a * s.n) // (l.a::HUGEINT * r.a) AS score
  FROM k JOIN s ON s.lang = k.lang
  JOIN c l ON l.lang = k.lang AND l.phrase = array_to_string(k.w[1:k.k], ' ')
  JOIN c r ON r.lang = k.lang AND r.phrase = array_to_string(k.w[k.k + 1:], ' ')),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT lang, array_to_string(w[x:x + y - 1], ' ') AS phrase, max(a) AS a FROM (
    SELECT lang, w, m, a, x, unnest(range(2, m)) AS y FROM (SELECT lang, w, m, a, unnest(range(1, m)) AS x FROM c WHERE m > 2))
  WHERE x + y - 1 <= m GROUP BY 1, 2),
z AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
  FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE NOT coalesce(100 * o.a >= {percent} * b.a, false))
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM z WHERE rank <= {top}"""


SQL = sql()
