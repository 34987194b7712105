"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document and leaves one bit; the measurements stay beside it. A policy is a named mask
of rules, so a new version of it, or the question what a single rule costs, is answered from the bits alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from framelens.llm.common import group_sums, in_slices, lengths, mapped

WINDOW = 8
_SPACE = np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_same_as_last",
            "n_upper", "n_letters")


@dataclass(frozen=True)
class Rule:
    """A document fails the rule where ``fails`` (SQL over the measurements) is true; ``bit`` never changes."""

    bit: int
    name: str
    fails: str


#: Integer comparisons only, so that every engine decides alike. Letters are A-Z and a-z.
RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 30 * n_words"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 40 * n_lines"),
    Rule(4, "stuttering", "100 * n_same_as_last > 30 * n_words"),
    Rule(5, "capitals", "100 * n_upper > 60 * n_letters"),
    Rule(6, "word_length", "word_chars > 20 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A version of the decision: a document is kept if it fails none of the named rules."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        bits = {r.name: r.bit for r in RULES}
        return sum(1 << bits[name] for name in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
CURRENT = Policy("2", tuple(r.name for r in RULES))
POLICIES = (BASE, Policy("1", ("few_words", "repeated_windows", "symbols", "repeated_lines")), CURRENT)


def _in_repeats(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """True for the words inside a WINDOW-word window that its own text has twice or more.

    Windows get exact numbers by doubling: equal numbers of two halves make equal numbers of the whole.
    """
    n, text = len(codes), np.repeat(np.arange(len(sizes)), sizes)
    if n < WINDOW:
        return np.zeros(n, bool)
    rank, span = codes.astype(np.int64), 1
    while span < WINDOW:
        pair = rank[:len(rank) - span] * (rank.max() + 1) + rank[span:]
        rank, span = np.unique(pair, return_inverse=True)[1], 2 * span
    whole = np.flatnonzero(text[:n - WINDOW + 1] == text[WINDOW - 1:])
    key = text[whole] * (rank.max() + 1) + rank[whole]
    _, at, times = np.unique(key, return_inverse=True, return_counts=True)
    starts = whole[times[at] > 1]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return np.cumsum(edge[:n]) > 0


def _lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    if b"\n" not in text:
        return int(bool(text.split())), 0
    full = [x for x in text.split(b"\n") if not x.isspace() and x]
    return len(full), len(full) - len(set(full))


def measure(texts: Sequence[str | None]) -> dict[str, np.ndarray]:
    raw = [t.encode("utf-8") if t else b"" for t in texts]
    found = [t.split() for t in raw]
    sizes = lengths(found)
    histogram = np.array([np.bincount(np.frombuffer(t, np.uint8), minlength=256) for t in raw]).reshape(-1, 256)
    codes = pd.factorize(np.array([w for ws in found for w in ws], dtype=object))[0]
    first = np.zeros(len(codes) + 1, bool)
    first[np.cumsum(sizes) - sizes] = True
    same = np.zeros(len(codes), np.int64)
    same[1:] = (codes[1:] == codes[:-1]) & ~first[1:len(codes)]
    lines = np.array([_lines(t) for t in raw], np.int64).reshape(-1, 2)
    points = histogram.sum(1) - histogram[:, 0x80:0xC0].sum(1)  # bytes that do not continue a character
    upper = histogram[:, 65:91].sum(1)
    return {"n_words": sizes, "word_chars": points - histogram[:, _SPACE].sum(1),
            "n_symbols": histogram[:, _SYMBOLS].sum(1), "n_dup_lines": lines[:, 1],
            "n_repeat_words": group_sums(_in_repeats(codes, sizes).astype(np.int64), sizes), "n_lines": lines[:, 0],
            "n_same_as_last": group_sums(same, sizes), "n_upper": upper, "n_letters": upper + histogram[:, 97:123].sum(1)}


def ledger(docs: DataFrame) -> DataFrame:
    """``doc_id``, the measurements and ``failed`` (one bit per rule) of every row; a null text measures as empty."""

    def run(batches):
        for pdf in in_slices(batches):
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), **measure(pdf["text"])})

    measured = mapped(docs.select("doc_id", "text"), run,
                      "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in RULES]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured.withColumn("failed", failed)


def fails(policy: Policy) -> Column:
    return F.col("failed").bitwiseAND(F.lit(policy.mask)) != 0


def decide(rows: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    return rows.withColumns({"base_failed": fails(BASE), "kept": ~(fails(BASE) | fails(policy))})


def ablations(rows: DataFrame, policies: Sequence[Policy] = POLICIES) -> DataFrame:
    """Per policy and rule: documents that fail the rule, that fail nothing else, and that the policy keeps.

    The ledger is reduced to its distinct bit patterns first (at most one per combination of rules).
    """
    patterns = rows.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    out = None
    for p in policies:
        hit = F.col("failed").bitwiseAND(F.lit(p.mask))
        for r in RULES:
            if r.name not in p.rules:
                continue
            own = F.lit(1 << r.bit)
            count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
            line = patterns.agg(count(F.col("failed").bitwiseAND(own) != 0).alias("failing"),
                                count(hit == own).alias("failing_only_this"), count(hit == 0).alias("kept_by_policy"))
            line = line.select(F.lit(p.version).alias("policy"), F.lit(r.name).alias("rule"), "*")
            out = line if out is None else out.unionByName(line)
    return out


def _sql() -> str:
    space = r"[^\x20\x09-\x0D]+"
    count = lambda pattern, of="t": f"len(regexp_extract_all({of}, '{pattern}'))"
    bits = " + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in RULES)
    leads = ", ".join(f"lead(w, {k}) OVER s AS w{k}" for k in range(1, WINDOW))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(t, '{space}') AS ws FROM d)),
x AS (SELECT doc_id, i, w, lag(w) OVER s AS last, {leads} FROM w WINDOW s AS (PARTITION BY doc_id ORDER BY i)),
y AS (SELECT doc_id, i, w, last, w{WINDOW - 1} IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w, {
    ", ".join(f"w{k}" for k in range(1, WINDOW))}) > 1 AS twice FROM x),
z AS (SELECT doc_id, w, last, bool_or(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING
  AND CURRENT ROW) AS inside FROM y),
a AS (SELECT doc_id, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars,
  count(*) FILTER (inside) AS n_repeat_words, count(*) FILTER (w = last) AS n_same_as_last FROM z GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '{space}') GROUP BY doc_id),
m AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
  {count("[#*$%&|<>]")} AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
  coalesce(n_same_as_last, 0) AS n_same_as_last, {count("[A-Z]")} AS n_upper, {count("[A-Za-z]")} AS n_letters
  FROM d LEFT JOIN a USING (doc_id) LEFT JOIN l USING (doc_id)),
f AS (SELECT *, ({bits})::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & {BASE.mask}) <> 0 AS base_failed,
  (failed & {BASE.mask | CURRENT.mask}) = 0 AS kept, failed FROM f"""


SQL = _sql()
