"""Secret scan: fixed patterns, and automata inferred from the credentials that these label.

The patterns find credentials by their context or prefix. Their values are the labelled strings: per kind a prefix tree
of a bounded sample is generalised by merging statistically compatible states (ALERGIA, Carrasco and Oncina 1994) into
a probabilistic automaton. Another automaton is inferred from ordinary strings of the same alphabet. Every candidate, a
run of the credential alphabet, is scored by the likelihood ratio of the best credential automaton to the ordinary one,
and those above ``THRESHOLD`` that no pattern covers are added as spans of kind ``format``.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from framelens.llm.common import Memo, in_slices, mapped

#: The base patterns, their kinds in the order of ties, and the least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "format")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
_HINTS = ("passw", "secret", "token", "api")
#: Candidates are runs of the alphabet of at least this length (shorter than every access key and hex match).
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
#: Distinct strings per kind, those of the smallest hash, from which automata are inferred.
SAMPLE, ORDINARY = 400, 4000
ALPHA, THRESHOLD = 0.01, 14.0

#: Symbol classes of the automata and their sizes; within a class every character is as likely.
_GROUPS = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+", "/", "_", ".", "=", "-")
_CLASS = {c: i for i, g in enumerate(_GROUPS) for c in g}
_UNIFORM = [-float(np.log(len(g))) for g in _GROUPS]
_END = len(_GROUPS)


@dataclass(frozen=True)
class Automaton:
    """``arcs[state][class] = (state, log probability)``, ``stop[state]`` the log probability of ending there."""

    arcs: tuple[dict[int, tuple[int, float]], ...]
    stop: tuple[float, ...]
    floor: float = -12.0

    def log_likelihood(self, text: str) -> float:
        state, total = 0, 0.0
        for c in text:
            k = _CLASS[c]
            to, p = self.arcs[state].get(k, (0, self.floor))
            total += p + _UNIFORM[k]
            state = to
        return total + self.stop[state]


class _Tree:
    """Prefix tree with counts, and the deterministic merges of its states."""

    def __init__(self, texts: Iterable[str]):
        self.next: list[dict[int, int]] = [{}]
        self.uses: list[dict[int, int]] = [{}]  # strings taking each arc; _END counts those that stop
        for t in texts:
            at = 0
            for c in t:
                k = _CLASS[c]
                self.uses[at][k] = self.uses[at].get(k, 0) + 1
                if k not in self.next[at]:
                    self.next[at][k] = len(self.next)
                    self.next.append({})
                    self.uses.append({})
                at = self.next[at][k]
            self.uses[at][_END] = self.uses[at].get(_END, 0) + 1

    def total(self, s: int) -> int:
        return sum(self.uses[s].values())

    def alike(self, a: int, b: int) -> bool:
        """Hoeffding's test on the stop and arc frequencies of both states and of all states they lead to alike."""
        bound, open_pairs = np.sqrt(0.5 * np.log(2 / ALPHA)), [(a, b)]
        while open_pairs:
            a, b = open_pairs.pop()
            n, m = self.total(a), self.total(b)
            if not n or not m:
                continue
            limit = bound * (n ** -0.5 + m ** -0.5)
            if limit < 1:
                ua, ub = self.uses[a], self.uses[b]
                if any(abs(ua.get(k, 0) / n - ub.get(k, 0) / m) > limit for k in ua.keys() | ub.keys()):
                    return False
            if n > 1 and m > 1:
                open_pairs += [(to, self.next[b][k]) for k, to in self.next[a].items() if k in self.next[b]]
        return True

    def fold(self, a: int, b: int) -> None:
        """Add the subtree of ``b`` to what ``a`` leads to."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if a == b:
                continue
            for k, n in self.uses[b].items():
                self.uses[a][k] = self.uses[a].get(k, 0) + n
            for k, to in self.next[b].items():
                if k in self.next[a]:
                    todo.append((self.next[a][k], to))
                else:
                    self.next[a][k] = to


def infer(texts: Iterable[str]) -> Automaton | None:
    """Merge the states of the prefix tree from the root outwards; None without a string."""
    texts = list(texts)
    if not texts:
        return None
    tree, settled = _Tree(texts), [0]
    while True:
        known = set(settled)
        border = {to: (s, k) for s in settled for k, to in tree.next[s].items() if to not in known}
        if not border:
            break
        state = max(border, key=lambda s: (tree.total(s), -s))
        parent, k = border[state]
        for s in settled:
            if tree.alike(s, state):
                tree.next[parent][k] = s
                tree.fold(s, state)
                break
        else:
            settled.append(state)
    place = {s: i for i, s in enumerate(settled)}
    arcs, stop = [], []
    for s in settled:
        n = tree.total(s) + 1.0
        arcs.append({k: (place[to], float(np.log(tree.uses[s][k] / n))) for k, to in tree.next[s].items()})
        stop.append(float(np.log((tree.uses[s].get(_END, 0) + 0.05) / n)))
    return Automaton(tuple(arcs), tuple(stop))


@dataclass(frozen=True)
class Grammar:
    """Credential automata and the ordinary one; without any, no candidate is a secret by its format. A run of digits
    is at least as ordinary as evenly spread digits, also where the ordinary sample holds few numbers."""

    credentials: tuple[Automaton, ...]
    ordinary: Automaton | None

    def ratio(self, text: str) -> float:
        if not self.credentials or self.ordinary is None:
            return float("-inf")
        ordinary = self.ordinary.log_likelihood(text)
        if text.isdigit():
            ordinary = max(ordinary, len(text) * _UNIFORM[0])
        return max(a.log_likelihood(text) for a in self.credentials) - ordinary


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the fixed patterns' matches, in code points."""
    out = []
    lowered = text.lower()
    if any(h in lowered for h in _HINTS):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return out


def candidates(text: str) -> list[tuple[int, str]]:
    """(start, string) of the candidates; punctuation at the end belongs to the sentence."""
    found = ((m.start(), m[0].rstrip(".-_=")) for m in CANDIDATE.finditer(text))
    return [(s, t) for s, t in found if len(t) >= 16]


def _free(found: list[tuple[int, str]], taken: list[tuple[int, int, int, str]]) -> list[tuple[int, str]]:
    """Candidates that touch no base span."""
    if not taken:
        return found
    return [(s, t) for s, t in found if all(s + len(t) <= a or e <= s for a, _, e, _ in taken)]


def _rank(kind: int, value: str) -> int:
    return zlib.crc32(f"{kind}:{value}".encode())


def learn(docs: DataFrame) -> Grammar:
    """Automata from the strings that the base patterns label in ``docs``, and from ordinary candidates.

    Each task passes on the strings of smallest hash only, which add up to the overall smallest: the sample is the same
    however the table is cut.
    """
    limit = [SAMPLE] * 3 + [ORDINARY]

    def run(batches):
        best: list[dict[str, int]] = [{}, {}, {}, {}]
        for pdf in batches:
            for text in pdf["text"]:
                if not text:
                    continue
                taken = base_spans(text)
                for kind, value in [(k, v) for _, k, _, v in taken] + [(3, v) for _, v in _free(candidates(text), taken)]:
                    best[kind][value] = _rank(kind, value)
            for kind, values in enumerate(best):
                if len(values) > 2 * limit[kind]:
                    best[kind] = dict(sorted(values.items(), key=lambda x: (x[1], x[0]))[:limit[kind]])
        rows = [(k, v, r) for k, values in enumerate(best)
                for v, r in sorted(values.items(), key=lambda x: (x[1], x[0]))[:limit[k]]]
        yield pd.DataFrame(rows, columns=["kind", "value", "rank"]).astype({"kind": "int32", "rank": "int64"})

    strings = mapped(docs.select("text"), run, "kind int, value string, rank long").distinct()
    picked = _smallest(strings, limit)
    made = [infer(picked.get(k, [])) for k in range(4)]
    return Grammar(tuple(a for a in made[:3] if a), made[3])


def _smallest(strings: DataFrame, limit: list[int]) -> dict[int, list[str]]:
    parts = None
    held = strings.persist()
    for k, n in enumerate(limit):
        part = held.filter(F.col("kind") == k).orderBy("rank", "value").limit(n)
        parts = part if parts is None else parts.unionByName(part)
    out: dict[int, list[str]] = {}
    for r in sorted(parts.collect(), key=lambda r: (r["kind"], r["rank"], r["value"])):
        out.setdefault(r["kind"], []).append(r["value"])
    held.unpersist()
    return out


def scanner(grammar: Grammar, spark):
    """A function of a text giving its spans (start, kind, end), in order; the automata are broadcast: their states
    are at most the characters of the bounded samples."""
    shared = spark.sparkContext.broadcast(grammar)

    def make():
        known = shared.value
        secret = Memo(lambda t: known.ratio(t) > THRESHOLD, 200_000)

        def spans(text: str | None) -> list[tuple[int, int, int]]:
            if not text:
                return []
            taken = base_spans(text)
            added = [(s, 3, s + len(t), t) for s, t in _free(candidates(text), taken) if secret[t]]
            return sorted((s, k, e) for s, k, e, _ in taken + added)

        return spans

    return make


def _listed(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_format`` of every row; a null text has no spans."""
    make = scanner(grammar, docs.sparkSession)

    def run(batches):
        spans = make()
        for pdf in in_slices(batches):
            found = [spans(t) for t in pdf["text"]]
            count = [np.bincount([k for _, k, _ in f], minlength=4) if f else np.zeros(4, np.int64) for f in found]
            n = np.array(count, np.int64).reshape(-1, 4)
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].astype("Int64"), "n_assign": n[:, 0], "n_access": n[:, 1], "n_hex": n[:, 2],
                "base_sha256": [hashlib.sha256(_listed(x for x in f if x[1] < 3).encode()).hexdigest() for f in found],
                "spans": [_listed(f) for f in found], "n_format": n[:, 3]})

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, n_assign long, n_access long, n_hex long, "
                  "base_sha256 string, spans string, n_format long")


def redact(docs: DataFrame, grammar: Grammar, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with the spans of every text replaced by ``mark`` and ``n_chars``, if there is one, counted anew."""
    make = scanner(grammar, docs.sparkSession)

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        spans = make()
        for texts in batches:
            yield pd.Series([replaced(t, spans(t), mark) for t in texts], dtype=object)

    out = docs.withColumn("text", clean(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))
    return out


def replaced(text: str | None, spans: list[tuple[int, int, int]], mark: str) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]
