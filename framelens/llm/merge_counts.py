"""Token counts of a byte-level byte-pair encoding, without token ids.

A text is cut at special strings (a token each), the rest into stretches by the tokenizer's pattern. The symbols of a
stretch are its bytes. They form a linked list, adjacent pairs wait in a heap by the rank of their merge and their place,
and the lowest pair is merged until none is left. A stretch has as many tokens as bytes less merges, so only the number
of merges is kept. A stretch of n bytes takes n log n steps, also if a whole document is one stretch.

Counts of stretches are kept in a memo per worker, bounded in entries and in bytes; longer stretches are not kept.

Null and empty texts have no bytes and no tokens. Repeated rows and ids, and rows without an id, each keep their row.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from framelens.llm.common import in_slices

#: Fixed value: the stretches of byte-level encodings, as the library's pre-tokenizer cuts them.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Stretches that a worker keeps at most, and bytes of the longest that it keeps.
KEPT, LONGEST = 1_000_000, 64
LIMIT = 1024
_WORKERS: dict[str, Callable[[str], int]] = {}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, the
    others for the letters from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in printable}
    letters.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))})
    return letters


def check(spec: dict) -> None:
    """Refuse files that ask for more than merges over byte-level stretches."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = {"dropout": (None, 0.0), "continuing_subword_prefix": (None, ""), "end_of_word_suffix": (None, ""),
             "ignore_merges": (None, False)}
    if model.get("type", "BPE") != "BPE" or any(model.get(k) not in v for k, v in plain.items()):
        raise ValueError("only plain byte-pair merges are supported")
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        raise ValueError("only the byte-level pre-tokenizer without a prefix space is supported")
    if spec.get("normalizer") is not None:
        raise ValueError("normalizers are not supported")
    if any(t.get(k) for t in spec.get("added_tokens", ()) for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that look at their surroundings are not supported")


class Merges:
    """Ranks of the merges between symbols, read from a tokenizer file."""

    def __init__(self, spec: dict):
        check(spec)
        letters = byte_letters()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        names: dict[str, int] = dict(letters)
        for a, b in pairs:
            for name in (a, b, a + b):
                names.setdefault(name, len(names))
        self.width = len(names)
        #: pair -> rank * width + merged symbol, so that order in the heap is order of rank
        self.rank = {names[a] * self.width + names[b]: i * self.width + names[a + b] for i, (a, b) in reversed(list(enumerate(pairs)))}
        added = sorted((t["content"] for t in spec.get("added_tokens", ()) if t["content"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.cut = regex.compile(PATTERN)

    def tokens(self, stretch: bytes) -> int:
        """Tokens of one stretch: bytes less merges."""
        n, rank, width = len(stretch), self.rank, self.width
        symbol, last = list(stretch), n - 1
        if n < 2:
            return n
        get = rank.get
        heap = []
        for i in range(last):
            r = get(symbol[i] * width + symbol[i + 1])
            if r is not None:
                heap.append((r, i))
        if not heap:
            return n
        heapify(heap)
        after, before, merges = list(range(1, n + 1)), list(range(-1, last)), 0
        while heap:
            r, i = heappop(heap)
            j = after[i]
            # A pair is stale if a side was merged since: its symbols no longer have that rank.
            if symbol[i] < 0 or j >= n or get(symbol[i] * width + symbol[j]) != r:
                continue
            merges += 1
            new = symbol[i] = r % width
            symbol[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = get(new * width + symbol[k])
                if r is not None:
                    heappush(heap, (r, i))
            h = before[i]
            if h >= 0:
                r = get(symbol[h] * width + new)
                if r is not None:
                    heappush(heap, (r, h))
        return n - merges

    def counter(self) -> Callable[[str], int]:
        """A function giving the tokens of a text, with a memo of stretches of its own."""
        memo: dict[str, int] = {}
        cut, special, tokens = self.cut.findall, self.special, self.tokens

        def plain(text: str) -> int:
            stretches = cut(text)
            counts = list(map(memo.get, stretches))
            if None in counts:
                for i, c in enumerate(counts):
                    if c is None:
                        s = stretches[i]
                        c = memo.get(s)
                        if c is None:
                            raw = s.encode("utf-8")
                            c = tokens(raw)
                            if len(raw) <= LONGEST:
                                if len(memo) >= KEPT:
                                    memo.clear()
                                memo[s] = c
                        counts[i] = c
            return sum(counts)

        def count(text: str) -> int:
            if special is None:
                return plain(text)
            total, at = 0, 0
            for found in special.finditer(text):
                total += 1 + plain(text[at:found.start()])
                at = found.end()
            return total + plain(text[at:] if at else text)

        return count


def token_counter(vocabulary: str) -> Callable[[str], int]:
    """The counter of a tokenizer file (its JSON text), made once per worker process."""
    key = hashlib.sha256(vocabulary.encode("utf-8")).hexdigest()
    if key not in _WORKERS:
        _WORKERS.clear()  # one vocabulary at a time
        _WORKERS[key] = Merges(json.loads(vocabulary)).counter()
    return _WORKERS[key]


def counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``doc_id, text``."""
    check(json.loads(vocabulary))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the tokenizer file, a fixed size

    def run(batches):
        count = token_counter(shared.value)
        for pdf in in_slices(batches):
            texts = ["" if t is None else t for t in pdf["text"]]
            n = np.fromiter(map(count, texts), np.int64, len(texts))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_bytes": [len(t.encode("utf-8")) for t in texts],
                                "n_tokens": n, "over_limit": n > limit})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
