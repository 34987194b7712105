"""Whitening, token counts and collocations against plain computations."""

import json
import random
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from framelens.llm import collocations, merge_counts, whitening
from framelens.llm.queries import public_bytes, public_file
from tests.llm import cases

SF = "/root/testdata/sf0.001"


# --- whitening ----------------------------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, component int, v int, n string, whitened double")


def padded(items):
    return [(i, v, 1, 2, "x", 0.5) for i, v in items]


def expected(items):
    """Exact covariance by fractions, solved by numpy."""
    x = np.array([[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v in items], object)
    n, total = len(x), x.sum(axis=0)
    r = n * x - total
    cov = np.array([[float(Fraction(int((r[:, i] * r[:, j]).sum()), n**3)) for j in range(x.shape[1])] for i in range(x.shape[1])])
    e, u = np.linalg.eigh(cov)
    return (r * r).sum(axis=1), r.astype(float) / n, e[::-1], u[:, ::-1]


def check(out, items, k=8):
    deviation, centred, e, u = expected(items)
    k = min(k, len(e))
    by = {(r["vec_id"], r["component"]): r for r in out}
    assert len(out) == len(items) * k
    w = np.array([[by[i, c + 1]["whitened"] for c in range(k)] for i, _ in items])
    want = centred @ u[:, :k] / np.sqrt(e[:k])
    assert np.abs(w - want * np.sign((w * want).sum(axis=0))).max() < 1e-9
    for (i, _), d in zip(items, deviation):
        assert by[i, 1]["deviation"] == d and by[i, 1]["n"] == len(items)
    assert np.allclose([by[items[0][0], c + 1]["explained"] for c in range(k)], e[:k] / e.sum(), rtol=1e-9)
    assert by[items[0][0], 1]["identity_error"] < 1e-9


@pytest.mark.parametrize("n, d", [(40, 3), (300, 12), (64, 20)])
def test_whitening_against_exact_covariance(spark, n, d):
    rng = np.random.default_rng(n)
    items = [(i, v.tolist()) for i, v in enumerate(rng.normal(0, 0.2, (n, d)) * rng.uniform(0.2, 2, d))]
    check(whitening.whiten(vectors(spark, padded(items)).repartition(5)).collect(), items)


def test_whitening_drops_unusable_vectors_and_keeps_repeats(spark):
    rng = np.random.default_rng(2)
    items = [(i, v.tolist()) for i, v in enumerate(rng.normal(0, 1, (30, 4)))]
    bad = [(50, None), (51, [1.0, None, 2.0, 3.0]), (52, [float("nan")] * 4), (53, [float("inf"), 0.0, 0.0, 0.0]), (54, []), (55, [1.0])]
    again = items + [(100, items[3][1]), (101, items[3][1])]
    out = whitening.whiten(vectors(spark, padded(again + bad))).collect()
    assert {r["vec_id"] for r in out} == {i for i, _ in again}
    check(out, again)
    unnamed = whitening.whiten(vectors(spark, padded(items + [(None, items[0][1])]))).filter("vec_id IS NULL").collect()
    assert len(unnamed) == 4 and all(r["n"] == 31 for r in unnamed)


def test_whitening_without_variation(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, padded([(1, None)]))).count() == 0
    flat = whitening.whiten(vectors(spark, padded([(i, [0.5, 0.25]) for i in range(3)]))).collect()
    assert len(flat) == 6 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 for r in flat)
    # one direction only: the second component has nothing to divide by
    line = whitening.whiten(vectors(spark, padded([(i, [float(i), 2.0 * i]) for i in range(9)]))).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in line)
    assert all(r["identity_error"] < 1e-9 for r in line)
    huge = whitening.whiten(vectors(spark, padded([(0, [1e300, 0.0]), (1, [-1e300, 1.0]), (2, [0.0, 5.0])]))).collect()
    assert all(r["deviation"] is None for r in huge if r["vec_id"] < 2)


@pytest.mark.parametrize("kind", ["random", "equal", "split", "zero", "graded", "one"])
def test_leading_components(kind):
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.normal(size=(24, 24)))
    values = {"random": rng.uniform(0, 1, 24), "equal": np.repeat([3.0, 2.0, 1.0], 8), "zero": np.zeros(24),
              "split": np.r_[[5.0, 5.0, 5.0], np.zeros(21)], "graded": 10.0 ** -np.arange(24), "one": np.ones(24)}[kind]
    a = np.diag(values) if kind == "one" else (q * values) @ q.T
    a = (a + a.T) / 2
    e, v = whitening.leading_components(a, 8)
    want = np.sort(values)[::-1][:8]
    assert np.abs(e - want).max() < 1e-13 * max(1, want.max())
    assert np.abs(v.T @ v - np.eye(8)).max() < 1e-13
    assert np.abs(a @ v - v * e).max() < 1e-13 * max(1, want.max())


def test_sums_of_many_tasks_do_not_depend_on_their_number(spark):
    rng = np.random.default_rng(3)
    df = vectors(spark, padded([(i, v.tolist()) for i, v in enumerate(rng.normal(0, 0.2, (400, 5)))]))
    parts = [whitening.added(whitening.usable(df.repartition(p), "vec_id", "embedding"), 5, lambda x: (x - 100_000).astype(float)) for p in (1, 90)]
    assert (parts[0] == parts[1]).all()


# --- token counts -------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_file("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def vocabulary():
    return public_bytes("byte_bpe_50k.json").decode("utf-8")


AWKWARD = ["", " ", "   \n\n a  b", "a<|endoftext|>b", "<|endoftext|><|endoftext|>", "<|endoftext|", "x" * 20_000, "ab" * 9_000,
           "it's they'll I'VE 'tis", "１２３ ½ x²", "é̂ ñ 🙂🙂 👩‍👩‍👧", "\x00\x1c\x1d\x85᠎​  ﻿", " " * 5000 + "end",
           "die Straße; größer", "!?#$%&" * 30, "0123456789" * 40, "\t\ttab\r\nline"]


def test_counts_equal_the_library(spark, library, vocabulary, tmp_path):
    texts = AWKWARD + [cases.prose(200, s) for s in range(20)]
    rows = cases.texts_table(spark, dict(enumerate(texts))).repartition(4)
    got = {r["doc_id"]: r for r in merge_counts.counts(rows, vocabulary).collect()}
    for i, t in enumerate(texts):
        want = len(library.encode(t, add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (want, len(t.encode()), want > 1024)


def test_counts_of_stored_documents(spark, library, vocabulary):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r["n_tokens"] for r in merge_counts.counts(docs, vocabulary).collect()}
    rows = docs.collect()
    for r, x in zip(rows, library.encode_batch([r["text"] or "" for r in rows], add_special_tokens=False)):
        assert got[r["doc_id"]] == len(x.ids)


def test_counts_of_awkward_rows(spark, vocabulary):
    out = merge_counts.counts(cases.table(spark), vocabulary).collect()
    assert len(out) == len(cases.rows())
    assert all((r["n_tokens"] == 0) == (r["n_bytes"] == 0) for r in out)
    assert merge_counts.counts(cases.table(spark, []), vocabulary).count() == 0


def test_merges_against_repeated_search_of_the_lowest_pair(vocabulary):
    spec = json.loads(vocabulary)
    merges = merge_counts.Merges(spec)
    rank = {tuple(m): i for i, m in enumerate(spec["model"]["merges"])}
    letters = {b: c for c, b in merge_counts.byte_letters().items()}
    rng = random.Random(1)
    for _ in range(300):
        raw = "".join(rng.choice(["e", "th", "in", "er", " ", "ß", "aaa", "1", "ing"]) for _ in range(rng.randint(1, 30))).encode()
        symbols = [letters[b] for b in raw]
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: rank.get((symbols[i], symbols[i + 1]), 1 << 40))
            if (symbols[best], symbols[best + 1]) not in rank:
                break
            symbols[best:best + 2] = [symbols[best] + symbols[best + 1]]
        assert merges.tokens(raw) == len(symbols)


def test_memo_starts_anew_when_full(monkeypatch, library, vocabulary):
    monkeypatch.setattr(merge_counts, "KEPT", 5)
    monkeypatch.setattr(merge_counts, "LONGEST", 6)
    count = merge_counts.Merges(json.loads(vocabulary)).counter()
    text = cases.prose(300, 9)
    assert count(text) == count(text) == len(library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("change", [{"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}])
def test_other_kinds_of_tokenizers_are_refused(vocabulary, change):
    with pytest.raises(ValueError):
        merge_counts.check({**json.loads(vocabulary), **change})


# --- collocations -------------------------------------------------------------------------------------------------


def brute(rows, top, least, percent=100):
    """Counts of all phrases in plain Python."""
    import re

    counts, out = {}, []
    for lang, text in rows:
        c = counts.setdefault(lang or "und", Counter())
        text = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            for i in range(len(w)):
                for m in range(1, 6):
                    if i + m <= len(w):
                        c[tuple(w[i:i + m])] += 1
    for lang, c in counts.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        some = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in some.items():
            for i in range(len(p)):
                for j in range(i + 1, len(p) + 1):
                    if j - i < len(p):
                        longer[p[i:j]] = max(longer[p[i:j]], a)
        scored = []
        for p, a in some.items():
            if 100 * longer[p] >= percent * a:
                continue
            score, k = min((1000 * a * n // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, le, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, le, r, n, -s))
    return sorted(out)


def corpus(seed, n=60):
    rng = random.Random(seed)
    common, sets = [f"w{i}" for i in range(12)], ["New York City", "ad hoc", "a b a b a", "x, y z", "É é tab\tsep", "\x1c \x1d\x1f \x85 q", " \u2003 \0 "]
    rows = []
    for _ in range(n):
        text = " ".join(rng.choice(sets) if rng.random() < 0.25 else rng.choice(common) + rng.choice(["", "", ".", "\n", "\x0b"]) for _ in range(40))
        rows.append((rng.choice(["en", "en", None, "de"]), text))
    return rows + [(None, None), ("en", ""), ("fr", " . ,\n"), ("en", "x" * 5000), ("en", "a a a a a a a a a a a a a a a")]


def tabled(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, 2, 3) for i, (lang, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, phrase string, n long, score int, h int")


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize("top, least, percent, wave", [(10, 8, 100, 30), (10_000, 6, 80, 1 << 16)])
def test_collocations_against_counting_everything(spark, monkeypatch, top, least, percent, wave):
    monkeypatch.setattr(collocations, "WAVE", wave)
    monkeypatch.setattr(collocations, "PART", 64)
    rows = corpus(top)
    got = collocations.mine(tabled(spark, rows).repartition(6), top, least, percent)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == brute(rows, top, least, percent)


def test_small_buffers_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "PAIRS", 50)
    monkeypatch.setattr(collocations, "WORDS", 10)
    rows = corpus(3, 40)
    got = collocations.mine(tabled(spark, rows).coalesce(1), 30, 4)  # both switches act within the worker's copy only
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == brute(rows, 30, 4)


def test_collocations_of_nothing(spark):
    for rows in ([], [(None, None)], [("en", "one two three")]):
        assert collocations.mine(tabled(spark, rows), 5, 2).count() == 0


def test_shared_hashes_are_told_apart(spark, monkeypatch):
    """With hashes of few values words collide, and another seed is taken until none do."""
    seeds = []
    plain = collocations.encoded

    def poor(docs, seed):
        seeds.append(seed)
        out = plain(docs, seed)
        return out.withColumn("h", F.lit(1).cast("long")) if seed == 0 else out

    monkeypatch.setattr(collocations, "encoded", poor)
    rows = corpus(4, 30)
    got = collocations.mine(tabled(spark, rows), 20, 3)
    assert seeds == [0, 1]
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == brute(rows, 20, 3)


def test_only_part_of_the_phrases_is_grown(spark, monkeypatch):
    """The bound keeps common words closed: the requests to grow are fewer than the phrases there are."""
    monkeypatch.setattr(collocations, "WAVE", 6)
    asked = []
    plain = collocations.requests
    monkeypatch.setattr(collocations, "requests", lambda *a: asked.append(plain(*a).collect()) or plain(*a))
    rng = random.Random(8)
    words = [f"c{i}" for i in range(30)]
    rows = [("en", " ".join(rng.choice(words) for _ in range(60)) + f". rare{i % 6} pair{i % 6}") for i in range(90)]
    got = collocations.mine(tabled(spark, rows), 4, 10).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == brute(rows, 4, 10)
    assert all(sum(r["grow"] for r in t) <= 6 for t in asked)
    grown = {tuple(r["w"]) for t in asked for r in t if r["grow"]}
    assert 0 < sum(len(w) == 1 for w in grown) < 42  # of 30 common and 12 rare words


def test_sql_states_the_same_rows(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.sql(collocations.sql(40, 10)).select(*COLUMNS).fetchall())
    got = collocations.mine(spark.read.parquet(f"{SF}/documents.parquet"), 40, 10)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == want and want
