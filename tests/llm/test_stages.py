"""Stages of the pipeline on tables with clashing columns, and the classifier on rows that it has not seen."""

import numpy as np
import pytest

import corpus_pipeline
from framelens.llm import common, near_copies, piece_transducer, simhash_vp, toxicity
from framelens.llm.queries import op6_toxicity, public_bytes
from tests.llm.cases import prose

CLASH = "doc_id long, text string, lang string, source string, n_chars long, row long, path string, place long, key int, k int, n int, root long, node long, sig string, _metadata string"


def clashing(spark, tmp_path, stored):
    texts = [prose(60, 1), prose(60, 1), prose(60, 2), None, "", prose(40, 3), prose(40, 3)]
    items = [(i, t, "en", "s", 1, 77 + i, "p", 5, 1, 2, 3, 4, 5, "x", "m") for i, t in enumerate(texts)]
    df = spark.createDataFrame(items, CLASH)
    if not stored:
        return df
    df.repartition(2).write.parquet(str(tmp_path / "docs"))
    return spark.read.parquet(str(tmp_path / "docs"))


@pytest.mark.parametrize("stored", [False, True])
def test_columns_with_clashing_names_pass_unchanged(spark, tmp_path, stored):
    docs = clashing(spark, tmp_path, stored)
    kept = corpus_pipeline.one_near_duplicate(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["row"], r["path"], r["sig"]) for r in kept.collect()) == [(i, 77 + i, "p", "x") for i in (0, 2, 3, 5)]
    items = spark.createDataFrame([(1, prose(60, 2))], "item_id long, text string")
    from framelens.llm import spaced_seeds

    clean = spaced_seeds.decontaminate(docs, items, stored=stored)
    assert clean.columns == docs.columns and sorted(r["row"] for r in clean.collect()) == [77, 78, 80, 81, 82, 83]


def test_stored_rows_are_numbered_without_a_copy(spark, tmp_path):
    spark.range(500).repartition(4).write.parquet(str(tmp_path / "t"))
    docs, scratch = spark.read.parquet(str(tmp_path / "t")), common.Scratch(spark)
    one, name = common.numbered(docs, scratch, True)
    again = {r["id"]: r[name] for r in one.collect()}
    assert not scratch._paths and len(set(again.values())) == 500
    assert {r["id"]: r[name] for r in common.numbered(docs, scratch, True)[0].repartition(7).collect()} == again
    assert len(common.numbered(docs, scratch)[0].select("row").distinct().collect()) == 500 and scratch._paths


def test_tables_of_earlier_stages_go(spark, tmp_path):
    docs = clashing(spark, tmp_path, True)
    first = corpus_pipeline.one_near_duplicate(spark, docs, "")
    scratch = corpus_pipeline._OPEN[-1]
    first.write.parquet(str(tmp_path / "out"))
    corpus_pipeline._begin(spark, spark.read.parquet(str(tmp_path / "out")))
    assert scratch not in corpus_pipeline._OPEN


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 2000, np.uint64)
    for shared in (400, 1200, 1778):
        other = np.concatenate([base[:shared], rng.integers(0, 1 << 63, 2000 - shared, np.uint64)])
        want = shared / (4000 - shared)
        got = (near_copies.signature(np.unique(base)) == near_copies.signature(np.unique(other))).mean()
        assert abs(got - want) < 0.17


def test_unseen_toxic_documents_are_found(spark):
    root = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{root}/labels.parquet").filter("toxic in (0, 1)").select("doc_id", "toxic")
    rows = op6_toxicity(spark, root).join(labels, "doc_id").filter("held_out").toPandas()
    assert rows[rows.toxic == 1].predicted.mean() >= 0.85 and rows[rows.toxic == 0].predicted.mean() <= 0.03


def test_subwords_of_plain_and_other_letters():
    for word in (b"idiot", "naïve".encode(), b"...", b"a", b"x,", "🙂".encode()):
        core = word.strip(toxicity._EDGE) or word
        w = "<" + core.decode() + ">"
        grams = [w] + [w[i:i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1) if n < len(w)]
        import zlib

        assert toxicity.subwords(word).tolist() == [zlib.crc32(g.encode()) % toxicity.BUCKETS for g in grams]


def test_merging_looks_up_each_new_neighbour_once():
    """The scores of all neighbours are not looked up again after every merge, and the merges stay the same."""
    class Counted(dict):
        asked = 0

        def get(self, *key):
            self.asked += 1
            return super().get(*key)

    wfst = piece_transducer.Transducer(public_bytes("piece_bpe_32k.model"))
    wfst.score = score = Counted(wfst.score)
    for text in ("▁the", "▁" + prose(30, 5).replace(" ", "") + "\né🙂", "▁" + "a" * 300, "", "x"):
        parts = list(text)
        while found := [(-score[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in score]:
            at = min(found)[1]
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        score.asked = 0
        assert wfst.merge(text) == parts
        assert score.asked <= 3 * len(text)


def test_copies_that_differ_in_words_of_their_own_make_no_pairs(spark, monkeypatch):
    """One text changed in many places of each copy: nearly all copies share bands, few are similar enough to any other."""
    rng, base, texts = np.random.default_rng(4), prose(150, 9).split(), {}
    for k in range(400):
        own = list(base)
        for at in rng.integers(0, 150, rng.integers(1, 16)):
            own[at] = f"new{k}x{at}"
        texts[k] = " ".join(own)
    met, alike = [], near_copies.alike
    monkeypatch.setattr(near_copies, "alike", lambda pairs, nodes: met.append(pairs.count()) or alike(pairs, nodes))
    rows = spark.createDataFrame(list(texts.items()), "row long, text string")
    got = {r["row"]: r["root"] for r in near_copies.groups(rows, common.Scratch(spark)).collect()}
    sets, root = [set(near_copies.shingles(t).tolist()) for t in texts.values()], list(range(400))
    for i in range(400):
        for j in range(i):
            if root[i] != root[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    assert 100 < len(set(root)) < 390
    assert got == dict(enumerate(root))
    assert sum(met) < 30 * 400


@pytest.mark.parametrize("part", [1 << 18, 50, 7])
def test_links_are_joined_in_few_rounds(spark, monkeypatch, part):
    """A chain, a hub and scattered links, in one part and in several."""
    monkeypatch.setattr(simhash_vp, "LINKS", part, raising=False)
    rng = np.random.default_rng(3)
    links = [(i + 1, i) for i in range(60)] + [(100 + i, 100) for i in range(1, 60)] + [(100, 100)]
    links += [(int(max(p)), int(min(p))) for p in rng.integers(200, 320, (70, 2)) if p[0] != p[1]] * 2
    root = {n: n for link in links for n in link}
    for a, b in links:
        lo, hi = sorted((root[a], root[b]))
        root = {n: lo if r == hi else r for n, r in root.items()}
    written, write = [], common.Scratch.write
    monkeypatch.setattr(common.Scratch, "write", lambda self, df: written.append(1) or write(self, df))
    df = spark.createDataFrame([x for x in links if x[0] != x[1]], "a long, b long")
    got = [(r["node"], r["root"]) for r in simhash_vp.components(df, common.Scratch(spark)).filter("node <> root").collect()]
    assert sorted(got) == sorted((n, r) for n, r in root.items() if n != r)
    assert len(written) <= (2 if part > len(links) else 14)
    assert simhash_vp.components(df.limit(0), common.Scratch(spark)).collect() == []


def test_groups_that_do_not_grow_are_not_joined_again(spark, monkeypatch):
    """Texts that share bands but are not similar enough: after the first turn no turn finds a link."""
    texts, base = {}, prose(150, 9).split()
    for k in range(40):
        own = list(base)
        for at in range(0, 150, 30):
            own[at:at + 2] = [f"new{k}x{at}", f"new{k}y{at}"]
        texts[k] = " ".join(own)
    called, components = [], near_copies.components
    monkeypatch.setattr(near_copies, "components", lambda edges, scratch: called.append(1) or components(edges, scratch))
    rows = spark.createDataFrame(list(texts.items()), "row long, text string")
    got = {r["row"]: r["root"] for r in near_copies.groups(rows, common.Scratch(spark)).collect()}
    sets = [set(near_copies.shingles(t).tolist()) for t in texts.values()]
    assert max(10 * len(a & b) - 8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i]) < 0
    assert got == {k: k for k in texts} and len(called) == 1
