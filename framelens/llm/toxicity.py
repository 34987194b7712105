"""Toxicity by subword-bag embeddings and a linear softmax.

A word is the mean of the vectors of its character n-grams (and of itself), a text the mean of its words, and a linear
softmax reads the text vector. Vectors and softmax are trained jointly. N-grams are hashed to buckets, so a misspelt
or inflected word that was never seen still shares most of its vectors with the words it comes from.

Most n-grams say nothing about the label, and with few labelled rows they are enough to learn those rows by heart. So the
buckets whose presence tells most about the label (log-likelihood ratio on the training rows) get vectors, the others
stay zero. How many is decided on an inner fold of the sample, and so is the cut between the classes.

The model is fitted on a bounded sample: at most ``PER_CLASS[label]`` labelled rows per label, those with the smallest
hash of their id; of rows that repeat an id, ``PER_ID`` at most. The rows reach the driver as bucket weights, never as
texts. Everything is scored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from framelens.llm.common import BATCH_ROWS, Memo, Scratch, group_sums, lengths, lower_words, mapped, remainder

BUCKETS, DIM, SHORTEST, LONGEST = 1 << 18, 16, 3, 5
PER_CLASS = {0: 3000, 1: 1500}
STEPS, BATCH, RATE, SCALE, DECAY = 400, 64, 0.02, 100.0, 0.3
#: Buckets that fewer texts of the sample have get no vector; numbers of vectors that are tried; share of the inner fold.
MIN_TEXTS, CHOICES, INNER = 10, (100, 200, 400, 800, 1600), 4
PER_ID = 4
_EDGE = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def subwords(word: bytes) -> np.ndarray:
    """Buckets of the n-grams of ``<word>`` and of the word itself; punctuation around the word is left off."""
    core = word.strip(_EDGE) or word
    plain = core.isascii()
    w = b"<" + core + b">" if plain else "<" + core.decode("utf-8", "replace") + ">"
    grams = [w] + [w[i:i + n] for n in range(SHORTEST, min(LONGEST + 1, len(w))) for i in range(len(w) - n + 1)]
    return np.fromiter(map(zlib.crc32, grams if plain else map(str.encode, grams)), np.int64, len(grams)) % BUCKETS


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their weights in its mean word vector."""
    found = lower_words(text)
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    names, counts = np.unique(np.array(found, dtype=object), return_counts=True)
    grams = [subwords(w) for w in names]
    sizes = lengths(grams)
    weight = np.bincount(np.concatenate(grams), np.repeat(counts / sizes / len(found), sizes), BUCKETS)
    at = np.flatnonzero(weight)
    return at.astype(np.int32), weight[at].astype(np.float32)


@dataclass(frozen=True)
class Toxicity:
    """The softmax of two classes reads the difference of their logits: one number per bucket and a bias."""

    bucket: np.ndarray
    bias: float

    def word(self, word: bytes) -> float:
        return float(self.bucket[subwords(word)].mean())


def informative(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> np.ndarray:
    """Buckets by how much their presence tells about the label, the most telling first."""
    seen = np.zeros((2, BUCKETS))
    for (at, _), label in zip(bags, labels):
        seen[label, at] += 1
    n = np.bincount(labels, minlength=2).astype(np.float64)
    total, ratio = seen.sum(axis=0), np.zeros(BUCKETS)
    for label in (0, 1):
        for count, all_of in ((seen[label], total), (n[label] - seen[label], n.sum() - total)):
            expected = all_of * n[label] / n.sum()
            ratio += np.where(count > 0, count * np.log(np.maximum(count, 1) / np.maximum(expected, 1e-9)), 0.0)
    ratio[total < MIN_TEXTS] = -1.0
    order = np.argsort(-ratio, kind="stable")
    return order[:int((ratio > 0).sum())]


def _trained(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, kept: np.ndarray, seed: int) -> tuple[np.ndarray, float]:
    """Number per bucket and bias: vectors and softmax trained together by Adam with weight decay."""
    place = np.full(BUCKETS, -1, np.int32)
    place[kept] = np.arange(len(kept), dtype=np.int32)
    x = np.zeros((len(bags), len(kept)), np.float32)
    for i, (at, w) in enumerate(bags):
        column = place[at]
        x[i, column[column >= 0]] = w[column >= 0] * np.float32(SCALE)
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.01, (len(kept), DIM)).astype(np.float32), rng.normal(0, 0.1, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    order = np.zeros(0, np.int64)
    for step in range(1, STEPS + 1):
        if not len(order):
            order = rng.permutation(len(labels))
        picked, order = order[:BATCH], order[BATCH:]
        a = x[picked]
        e, v, b = params
        h = a @ e
        z = h @ v + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(picked)), labels[picked]] -= 1
        p /= len(picked)
        rate = RATE * (1 - step / (STEPS + 1))
        scaled = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for q, g, m, s in zip(params, [a.T @ (p @ v.T), h.T @ p, p.sum(0)], first, second):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            q *= 1 - rate * DECAY
            q -= scaled * m / (np.sqrt(s) + 1e-8)
    e, v, b = params
    bucket = np.zeros(BUCKETS, np.float32)
    bucket[kept] = SCALE * (e @ (v[:, 1] - v[:, 0]))
    return bucket, float(b[1] - b[0])


def _logits(bags: list[tuple[np.ndarray, np.ndarray]], bucket: np.ndarray, bias: float) -> np.ndarray:
    return np.array([bucket[at] @ w + bias for at, w in bags])


def _threshold(logits: np.ndarray, labels: np.ndarray, weight: float) -> float:
    """The cut with the best balance of found and false rows (F1); a row of label 0 stands for ``weight`` rows. Between
    the two logits around the cut, so that it depends on neither alone."""
    order = np.argsort(-logits, kind="stable")
    z, hit = logits[order], labels[order] == 1
    found, false = np.cumsum(hit), weight * np.cumsum(~hit)
    score = 2 * found / (found + false + hit.sum())
    ends = np.append(z[1:] < z[:-1], True)  # equal logits are cut off together
    k = int(np.argmax(np.where(ends, score, -1.0)))
    return float((z[k] + z[k + 1]) / 2) if k + 1 < len(z) else float(z[k] - 1.0)


def _loss(logits: np.ndarray, labels: np.ndarray) -> float:
    z = np.clip(np.where(labels == 1, logits, -logits), -30, 30)
    return float(np.log1p(np.exp(-z)).mean())


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, share: float | None = None,
        seed: int = 7) -> Toxicity:
    """Number of vectors and place of the cut chosen on an inner fold, then trained on all of ``bags``.

    ``share`` is the share of label 1 among all labelled rows: the sample takes the labels in other proportions, so a row
    of label 0 counts for as many as it stands for where the cut is chosen. A single class gives a constant score.
    """
    own = float(labels.mean()) if len(labels) else 0.0
    if own in (0.0, 1.0):
        return Toxicity(np.zeros(BUCKETS, np.float32), -50.0 if own == 0.0 else 50.0)
    inner = np.zeros(len(labels), bool)
    for label in (0, 1):
        inner[np.random.default_rng(seed).permutation(np.flatnonzero(labels == label))[::INNER]] = True
    rest, size, cut = np.flatnonzero(~inner), CHOICES[1], 0.0
    odds = lambda x: x / (1 - x)
    weight = odds(own) / odds(share) if share and share < 1 else 1.0
    if len(set(labels[rest])) == 2:
        learn, judge = [bags[i] for i in rest], [bags[i] for i in np.flatnonzero(inner)]
        ranked, found = informative(learn, labels[rest]), []
        for most in CHOICES:
            logits = _logits(judge, *_trained(learn, labels[rest], ranked[:most], seed))
            found.append((_loss(logits, labels[inner]), most, _threshold(logits, labels[inner], weight)))
        _, size, cut = min(found)
    bucket, bias = _trained(bags, labels, informative(bags, labels)[:size], seed)
    return Toxicity(bucket, bias - cut)


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None) -> Toxicity:
    """Fit on labelled rows that are not held out; rows without a text count as empty, repeated rows count again."""
    known = labels.filter("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("label"))
    known = known.filter(remainder("doc_id", 5) != 0).withColumn("_o", F.xxhash64("doc_id"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    # The sample is picked among narrow rows, at most PER_CLASS of each label.
    parts = [known.filter(F.col("label") == k).orderBy("_o", "doc_id").limit(most) for k, most in PER_CLASS.items()]
    picked = parts[0].unionByName(parts[1])
    texts = docs.filter(remainder("doc_id", 5) != 0).select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    # Rows that repeat an id: those with the smallest hashes of their texts, first within each task, then of all.
    nth = F.row_number().over(Window.partitionBy("doc_id", "label").orderBy(F.xxhash64("text")))
    texts = texts.withColumn("_n", nth).filter(F.col("_n") <= PER_ID)

    def weights(batches):
        for pdf in batches:
            made = [bag(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "o": pdf["_o"], "label": pdf["label"],
                                "at": [x.tobytes() for x, _ in made], "w": [y.tobytes() for _, y in made]})

    # Written once by all tasks, then read a partition at a time, so that the driver holds the sample only once.
    scratch = scratch or Scratch(docs.sparkSession)
    made = scratch.write(mapped(texts.select("doc_id", "text", "_o", "label"), weights,
                                                   "doc_id long, o long, label int, at binary, w binary"))
    held = [(r["o"], r["doc_id"], r["at"], r["w"], r["label"]) for r in made.coalesce(8).toLocalIterator()]
    scratch.drop(made)
    held.sort(key=lambda x: x[:3], reverse=True)
    bags, truth = [], []
    while held and len(bags) < sum(PER_CLASS.values()):  # repeated rows count within the bound
        _, _, at, w, label = held.pop()
        bags.append((np.frombuffer(at, np.int32), np.frombuffer(w, np.float32)))
        truth.append(label)
    held.clear()
    return fit(bags, np.array(truth, np.int64), counts.get(1, 0) / max(1, sum(counts.values())))


def scorer(model: Toxicity, spark):
    """A function of the texts of a batch giving their scores; the model (one float per bucket) is broadcast."""
    shared = spark.sparkContext.broadcast(model)

    def make():
        memo = Memo(shared.value.word)  # of one task: kept longer, it would take memory from later stages

        def scores(texts) -> np.ndarray:
            parts = [texts[lo:lo + BATCH_ROWS] for lo in range(0, len(texts), BATCH_ROWS)]
            return np.concatenate([few(p) for p in parts]) if parts else np.zeros(0)

        def few(texts) -> np.ndarray:
            found = [lower_words(t) for t in texts]
            sizes = lengths(found)
            values = np.fromiter((memo[w] for ws in found for w in ws), np.float64, sizes.sum())
            logit = group_sums(values, sizes) / np.maximum(sizes, 1) + shared.value.bias
            return np.round(1 / (1 + np.exp(-np.clip(logit, -50, 50))), 6)

        return scores

    return make


def score(docs: DataFrame, model: Toxicity) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; a null or empty text gets the score of the bias alone."""
    make = scorer(model, docs.sparkSession)

    def run(batches):
        scores = make()
        for pdf in batches:
            s = scores(pdf["text"])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": s,
                                "predicted": (s >= 0.5).astype("int32")})

    rows = docs.select("doc_id", "text", (remainder("doc_id", 5) == 0).alias("held_out"))
    return mapped(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def reject_toxic(docs: DataFrame, model: Toxicity) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns unchanged; rows without a text go by the bias, each
    repeated row by itself, long texts are read whole, and no rows give no rows."""
    make = scorer(model, docs.sparkSession)

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scores = make()
        for texts in batches:
            yield pd.Series(scores(texts) < 0.5)

    return docs.filter(clean(F.col("text")))
