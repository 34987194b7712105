"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

A seed is a hash of the words at the ones of a fixed mask; the zeros are ignored, so a copy with single words replaced
still shares seeds with its source. Seeds of test items and of training documents are joined, which gives alignments
(document, item, offset), and an alignment counts if some ``WINDOW`` aligned words agree in a share of ``SHARE``.

Hashing every position with every mask is costly, so two tables of ``2**GATE`` truth values, made from the test items,
let only positions pass that may be seeds: first by the two words every mask starts with, then by the whole seeds. Their
size is fixed; a large benchmark fills them and more positions reach the join, with the same result.

Words are runs of letters and digits in lower case. Items with fewer words than the shortest mask have no seeds and are
never found; an item shorter than ``WINDOW`` words must agree as a whole. Null and empty texts have no words. In
``overlaps``, documents without an id cannot be named and are left out, and rows that share an id count as one document,
found if any of them is; ``decontaminate`` goes by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from framelens.llm.common import Scratch, numbered, small_or_not

MASKS = ("1110111", "11011011", "110011011", "110101011")
WINDOW, SHARE_TENTHS, GATE = 13, 8, 18
_OFFSETS = [[i for i, c in enumerate(m) if c == "1"] for m in MASKS]


def words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _seed(w: Column, at: Column, mask: int) -> Column:
    """Hash of the mask's words from position ``at``; null where the mask reaches over the end."""
    hashed = F.xxhash64(F.lit(mask), *[F.get(w, at + o) for o in _OFFSETS[mask]])
    return F.when(at + len(MASKS[mask]) <= F.size(w), hashed)


def _seeds(w: Column, at: Column) -> Column:
    return F.array_compact(F.array(*[_seed(w, at, m) for m in range(len(MASKS))]))


def _pair(w: Column, at: Column) -> Column:
    return F.xxhash64(F.get(w, at), F.get(w, at + 1))


def _slot(h: Column) -> Column:
    return F.pmod(h, F.lit(1 << GATE)).cast("int")


def _positions(w: Column, least: int) -> Column:
    """0, 1, ... as far as ``least`` words follow."""
    return F.when(F.size(w) >= least, F.sequence(F.lit(0), F.size(w) - least)).otherwise(F.array().cast("array<int>"))


def _gate(hashes: DataFrame):
    """A test of hashes against 2**GATE bits, set at the slots of the hashes ``h``; the bits are a constant of the plan,
    2**GATE / 64 numbers whatever the size of the table."""
    slot = _slot(F.col("h"))
    bits = hashes.groupBy(F.shiftright(slot, 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63))).alias("bits"))
    known = {r["word"]: r["bits"] for r in bits.collect()}
    # One string that folds to an array, in place of thousands of literals.
    table = F.split(F.lit(",".join(str(known.get(i, 0)) for i in range(1 << GATE - 6))), ",").cast("array<bigint>")
    return lambda h: F.call_function("shiftright", F.get(table, F.shiftright(_slot(h), 6)),
                                     _slot(h).bitwiseAND(63)).bitwiseAND(1) == 1


def item_seeds(items: DataFrame) -> DataFrame:
    """``h, item_id, item_at`` of every seed of every item."""
    w = items.filter("item_id IS NOT NULL").select("item_id", words("text").alias("w"))
    at = w.select("item_id", "w", F.explode(_positions(F.col("w"), len(MASKS[0]))).alias("item_at"))
    return at.select("item_id", "item_at", F.explode(_seeds(F.col("w"), F.col("item_at"))).alias("h"),
                     _pair(F.col("w"), F.col("item_at")).alias("pair"))


def alignments(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, shift``: a seed of the document at p meets one of the item at p - shift."""
    seeds = item_seeds(items)
    pairs, wholes = _gate(seeds.select(F.col("pair").alias("h"))), _gate(seeds.select("h"))
    w = docs.filter("doc_id IS NOT NULL").select("doc_id", words("text").alias("w"))
    first = F.filter(_positions(F.col("w"), len(MASKS[0])), lambda p: pairs(_pair(F.col("w"), p)))
    hits = F.flatten(F.transform(first, lambda p: F.transform(
        F.filter(_seeds(F.col("w"), p), wholes),
        lambda h: F.struct(h.alias("h"), p.alias("at")))))
    found = w.select("doc_id", F.explode(hits).alias("x")).select("doc_id", "x.h", "x.at")
    return found.join(seeds.drop("pair"), "h").select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct()


def overlaps(docs: DataFrame, items: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, item_id, n_equal, n_window``: the most equal words in a window of an item aligned with a document,
    for every pair where they are enough."""
    scratch = scratch or Scratch(docs.sparkSession)
    pairs = scratch.write(alignments(docs, items))
    hit = scratch.write(pairs.select("doc_id").distinct())
    item = items.filter("item_id IS NOT NULL").select("item_id", words("text").alias("iw"))
    # Few documents have an alignment; only their texts move.
    texts = docs.select("doc_id", "text").join(small_or_not(hit), "doc_id", "left_semi")
    aligned = pairs.join(texts.select("doc_id", words("text").alias("w")), "doc_id").join(item, "item_id")
    lo = F.greatest(-F.col("shift"), F.lit(0))
    n = F.least(F.size("iw"), F.size("w") - F.col("shift")) - lo
    parts = aligned.filter(n > 0).select(
        "doc_id", "item_id", F.least(F.size("iw"), F.lit(WINDOW)).alias("n_window"),
        F.zip_with(F.slice("iw", lo + 1, n), F.slice("w", lo + F.col("shift") + 1, n),
                   lambda a, b: (a == b).cast("int")).alias("eq"))
    starts = F.when(F.size("eq") >= F.col("n_window"), F.sequence(F.lit(1), F.size("eq") - F.col("n_window") + 1))
    best = F.array_max(F.transform(starts, lambda s: F.aggregate(
        F.slice("eq", s, F.col("n_window")), F.lit(0), lambda acc, x: acc + x)))
    scored = parts.select("doc_id", "item_id", "n_window", best.alias("n_equal"))
    return scored.filter(10 * F.col("n_equal") >= SHARE_TENTHS * F.col("n_window")).groupBy("doc_id", "item_id").agg(
        F.max("n_equal").cast("long").alias("n_equal"), F.max("n_window").cast("long").alias("n_window"))


def decontaminate(docs: DataFrame, items: DataFrame, scratch: Scratch | None = None, stored: bool = False) -> DataFrame:
    """``docs`` without the rows that overlap an item. Each row is a document of its own, also with a repeated id or none.

    Null and empty texts overlap nothing and stay, long texts are compared whole, no rows give no rows. All columns are
    kept, whatever their names. ``stored``: see ``numbered``.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rows, row = numbered(docs, scratch, stored)
    found = overlaps(rows.select(F.col(row).alias("doc_id"), "text"), items, scratch)
    bad = scratch.write(found.select(F.col("doc_id").alias(row)).distinct())
    return rows.join(small_or_not(bad), row, "left_anti").select(*docs.columns)


def _sql() -> str:
    seeds = "\nUNION ALL ".join(
        "SELECT id, i, {m} AS m, concat_ws(' ', {ws}) AS k FROM t WHERE i + {span} <= n".format(
            m=m, span=len(mask), ws=", ".join(f"w{o}" if o else "w" for o in _OFFSETS[m])) for m, mask in enumerate(MASKS))
    leads = ", ".join(f"lead(w, {o}) OVER s AS w{o}" for o in sorted({o for x in _OFFSETS for o in x if o}))

    def side(name: str, table: str, key: str) -> str:
        return f"""{name}_w AS (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i, len(ws) AS n FROM (
  SELECT {key} AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ws
  FROM {table})),
{name}_s AS (WITH t AS (SELECT *, {leads} FROM {name}_w WINDOW s AS (PARTITION BY id ORDER BY i)) {seeds})"""

    return f"""WITH {side("d", "documents", "doc_id")},
{side("b", "benchmark", "item_id")},
a AS (SELECT DISTINCT d.id AS doc_id, b.id AS item_id, d.i - b.i AS shift FROM d_s d JOIN b_s b ON d.m = b.m AND d.k = b.k),
e AS (SELECT doc_id, item_id, shift, b.i, least(b.n, {WINDOW}) AS n_window, (b.w = d.w)::INT AS eq
  FROM a JOIN b_w b ON b.id = item_id JOIN d_w d ON d.id = doc_id AND d.i = b.i + shift),
r AS (SELECT *, sum(eq) OVER x AS n_equal, row_number() OVER x AS k
  FROM e WINDOW x AS (PARTITION BY doc_id, item_id, shift ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW))
SELECT doc_id, item_id, max(n_equal)::BIGINT AS n_equal, max(n_window)::BIGINT AS n_window FROM r
WHERE k >= n_window AND 10 * n_equal >= {SHARE_TENTHS} * n_window GROUP BY doc_id, item_id"""


SQL = _sql()
