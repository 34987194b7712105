"""Each text operator against a plain version of itself, and on rows and tables that are easy to trip over."""

import hashlib
import importlib.util
import json
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

sys.path.insert(0, str(Path(__file__).resolve().parent))
from cases import prose, rows, stored, table, texts_table

from framelens.llm import (bloom_lm, kd_shards, near_copies, piece_transducer, rans_ids, rule_ledger, secret_grammar, simhash_vp,
                           spaced_seeds, suffix_dedup, toxicity)
from framelens.llm.common import Scratch, remainder
from framelens.llm.queries import ORACLE, QUERIES, public_bytes, public_file

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def by_row(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# --- 1 token ids ------------------------------------------------------------------------------------------------------

@settings(max_examples=30, deadline=None)
@given(st.integers(0, 3 * rans_ids.LANES * rans_ids.CHECKPOINT), st.integers(1, 300), st.integers(0, 9))
def test_blocks_decode_to_what_was_encoded(n, vocabulary, seed):
    rng = np.random.default_rng(seed)
    ids = np.minimum(rng.zipf(1.4, n), vocabulary) - 1
    coder = rans_ids.Coder(rans_ids.quantise(np.bincount(ids, minlength=vocabulary + 1)))
    payload = coder.encode(ids)
    assert (coder.decode(payload) == ids).all()


def test_a_damaged_block_is_refused():
    ids = np.arange(1000) % 7
    coder = rans_ids.Coder(rans_ids.quantise(np.bincount(ids)))
    payload = bytearray(coder.encode(ids))
    payload[40] ^= 1
    with pytest.raises(ValueError):
        coder.decode(bytes(payload))


def test_frequencies_leave_no_id_out():
    counts = np.zeros(50_000, np.int64)
    counts[:40_000], counts[7] = 1, 10**12
    freq = rans_ids.quantise(counts)
    assert freq.sum() == 1 << rans_ids.SCALE and (freq[:40_000] > 0).all() and not freq[40_000:].any()


@pytest.mark.parametrize("items", [None, []])
def test_ids_written_and_read_back(spark, items):
    from tokenizers import Tokenizer

    path = public_file("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    got = by_row(rans_ids.round_trip(table(spark, items), Path(path).read_text(), 49_408), "doc_id", "start", "n_tokens", "ids")
    docs = sorted((rows() if items is None else items), key=lambda r: (r[0] is not None, r[0] or 0))
    want = sorted((r[0], np.array(own.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for r in docs if r[0] is not None)
    assert [(g[0], bytes(g[3])) for g in sorted((g for g in got if g[0] is not None), key=lambda g: (g[0], bytes(g[3])))] == want
    assert len(got) == len(docs)
    at = 0
    for g in sorted(got, key=lambda g: g[1]):  # starts follow each other, ids ascend
        assert g[1] == at and g[2] == len(g[3]) // 4
        at += g[2]
    order = [g[0] for g in sorted(got, key=lambda g: g[1])]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aBé'sS \n\t<|>endoftx.,!Σ\x1c\x85🙂日", max_size=40), min_size=1, max_size=8))
def test_word_lookup_is_the_library(texts):
    from tokenizers import Tokenizer

    path = public_file("word_bpe_49k.json")
    want = [e.ids for e in _whole(path).encode_batch(texts, add_special_tokens=False)]
    assert [list(x) for x in _lookup(path)(texts)] == want


def test_a_row_that_is_a_third_of_the_table_is_spread_over_files(spark):
    items = [(7, prose(40, 1)) if i % 3 == 0 else (1000 + i, prose(40, i)) for i in range(600)]
    df = spark.createDataFrame(items, "doc_id long, text string").repartition(4)
    width, scratch = rans_ids.width_of(49_408), Scratch(spark)
    path = f"{scratch.folder}/ids"
    tokens = scratch.write(rans_ids.tokenise(df, Path(public_file("word_bpe_49k.json")).read_text(), 1, width))
    rans_ids.write(tokens, rans_ids.frequencies(tokens, 49_408, width), width, path)
    per_file = {r["file"]: list(r["doc_ids"]).count(7) for r in spark.read.parquet(f"{path}/blocks").collect()}
    assert sum(per_file.values()) == 200 and max(per_file.values()) < 150
    back = rans_ids.read(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in back] == sorted(i for i, _ in items) and back[0]["start"] == 0
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(back, back[1:]))


@pytest.mark.parametrize("change", [{"normalizer": None}, {"pre_tokenizer": {"type": "Whitespace"}}, {"truncation": {"max_length": 5}}])
def test_tokenizers_that_do_not_work_by_words_are_refused(change):
    spec = json.loads(Path(public_file("word_bpe_49k.json")).read_text())
    with pytest.raises(ValueError):
        rans_ids.check(json.dumps({**spec, **change}))


_CACHE = {}


def _whole(path):
    from tokenizers import Tokenizer

    return _CACHE.setdefault("whole", None) or _CACHE.update(whole=Tokenizer.from_file(path)) or _CACHE["whole"]


def _lookup(path):
    return _CACHE.setdefault("lookup", None) or _CACHE.update(lookup=rans_ids.word_tokenizer(Path(path).read_text())) or _CACHE["lookup"]


def test_new_words_are_looked_up_together(monkeypatch):
    """Usual words, with marks, digits and letters of Latin-1, do not go through the library one by one."""
    import tokenizers

    alone, real = [], tokenizers.Tokenizer

    class Counting:
        def __init__(self, spec):
            self.made, self.model = real.from_str(spec), real.from_str(spec).model

        def encode(self, text, **options):
            alone.append(text)
            return self.made.encode(text, **options)

    monkeypatch.setattr(tokenizers, "Tokenizer", type("T", (), {"from_str": Counting}))
    path = public_file("word_bpe_49k.json")
    texts = ["héllo, wörld!! it's 12 don't,(x) É.a  ÀB ", None, "", "\x0bñandú... a'sb 'll", "× ÷ ß zażółć <|endoftext|", " \x00 \x1c"]
    whole = real.from_file(path)
    want = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in rans_ids.word_tokenizer(Path(path).read_text())(texts)] == want
    assert set(alone) == {texts[4], "\x00", "\x1c"}


def test_batches_of_many_slices_keep_their_rows(spark):
    path = public_file("word_bpe_49k.json")
    texts = {i: f"Wörd{i} ß {i % 7}" * (i % 3) for i in range(5_000)}
    df = texts_table(spark, texts).coalesce(1)
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u2").tolist() for r in rans_ids.tokenise(df, Path(path).read_text(), 1, "<u2").collect()}
    whole = rans_ids.word_tokenizer(Path(path).read_text())
    want = {r["doc_id"]: [*whole([r["text"]])[0].tolist(), 1] for r in df.collect()}
    assert got == want


# --- 2 pieces ---------------------------------------------------------------------------------------------------------

def _library(kind):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    if kind not in _CACHE:
        proto = pb.ModelProto()
        proto.ParseFromString(public_bytes("piece_bpe_32k.model"))
        proto.trainer_spec.model_type = kind
        raw = proto.SerializeToString()
        _CACHE[kind] = sentencepiece.SentencePieceProcessor(model_proto=raw), piece_transducer.Encoder(raw), [p.score for p in proto.pieces]
    return _CACHE[kind]


TRICKY = st.text(alphabet="ab \n▁ethoé🙂\0\t.,x0", max_size=60)


@settings(max_examples=200, deadline=None)
@given(TRICKY)
def test_merge_model_paths_are_the_library_result(text):
    library, encoder, _ = _library(piece_transducer.BPE)
    ids = encoder([text])[0].tolist()
    assert ids == library.encode(text) and encoder.wfst.decode(ids) == library.decode(ids)


@settings(max_examples=100, deadline=None)
@given(TRICKY)
def test_unigram_paths_weigh_what_the_library_path_weighs(text):
    library, encoder, score = _library(piece_transducer.UNIGRAM)
    weight = lambda ids: sum(score[i] for i in ids)
    assert weight(encoder([text])[0].tolist()) == pytest.approx(weight(library.encode(text)), rel=1e-5)


def test_pieces_of_awkward_rows(spark):
    model = public_bytes("piece_bpe_32k.model")
    got = piece_transducer.encode(table(spark), model).collect()
    library = _library(piece_transducer.BPE)[0]
    want = sorted((repr(r[0]), library.encode(r[1] or "")) for r in rows())
    assert sorted((repr(g["doc_id"]), g["piece_ids"]) for g in got) == want
    assert all(g["round_trip"] or g["doc_id"] == 9 for g in got)  # text 9 holds U+2581
    back = piece_transducer.decode(piece_transducer.encode(table(spark), model), model)
    assert sorted(r["text"] for r in back.collect()) == sorted((r[1] or "").replace("▁", " ") for r in rows())
    assert piece_transducer.encode(table(spark, []), model).count() == 0


def test_piece_encoder_is_kept_and_bounded():
    model = public_bytes("piece_bpe_32k.model")
    encoder = piece_transducer.worker_encoder(model)
    assert piece_transducer.worker_encoder(bytes(bytearray(model))) is encoder
    assert encoder._paths._limit + encoder.wfst._zero_paths._limit + encoder.wfst._pair._limit <= 900_000


# --- 3 shards ---------------------------------------------------------------------------------------------------------

def _tree(docs, n):
    """The same tree by sorting whole nodes."""
    most = max((d["n_chars"] or 0 for d in docs), default=0)
    digest = lambda s, k: int(hashlib.md5(s.encode()).hexdigest()[:k], 16)
    items = []
    for d in docs:
        raw = (d["text"] or "").encode()
        crc = zlib.crc32(raw)
        items.append((d["doc_id"], len(raw) + 1, crc, [(d["n_chars"] or 0) * 32767 // max(1, most), digest(d["source"] or "", 4) % 32768,
                      digest(d["lang"] or "", 4) % 32768], digest(f"{'' if d['doc_id'] is None else d['doc_id']}:{crc}", 12)))

    def split(held, leaves):
        if leaves == 1:
            return [held]
        wide = [max(x[3][i] for x in held) - min(x[3][i] for x in held) for i in range(3)] if held else [0]
        i, total, before, left, right = wide.index(max(wide)), sum(x[1] for x in held), 0, [], []
        for x in sorted(held, key=lambda x: (x[3][i], x[4])):
            (left if leaves * (2 * before + x[1]) <= 2 * total * (leaves // 2) else right).append(x)
            before += x[1]
        return split(left, leaves // 2) + split(right, leaves - leaves // 2)

    out = []
    for k, held in enumerate(split(items, n)):
        for s, x in enumerate(sorted(held, key=lambda x: (x[0] is not None, x[0] or 0, x[2]))):
            out.append((x[0], x[1], x[2], k, s))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n", [1, 3, 16])
def test_shards_are_the_tree(spark, n):
    docs = table(spark).collect() + table(spark, [(100 + i, prose(i % 50, i), "en", f"s{i % 3}", 7, None, None, None, None, None) for i in range(150)]).collect()
    df = spark.createDataFrame(docs, table(spark).schema)
    assert by_row(kd_shards.shards(df, n), "doc_id", "size", "text_crc32", "shard", "slot") == _tree(docs, n)


def test_one_row_many_times_is_still_split(spark):
    df = table(spark, [(5, "same text", "en", "s", 9, None, None, None, None, None)] * 64)
    got = kd_shards.shards(df, 4).collect()
    assert Counter(r["shard"] for r in got) == dict.fromkeys(range(4), 16)
    assert sorted((r["shard"], r["slot"]) for r in got) == [(k, s) for k in range(4) for s in range(16)]
    assert kd_shards.shards(table(spark, []), 4).count() == 0


# --- 4 ledger ---------------------------------------------------------------------------------------------------------

def _measures(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    inside = set()
    for i in range(len(w) - 7):
        if windows[tuple(w[i:i + 8])] > 1:
            inside |= set(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab #\n\x1c é", max_size=120)), min_size=1, max_size=6))
def test_measures(texts):
    got = rule_ledger.measure(texts)
    assert list(zip(*(got[m].tolist() for m in rule_ledger.MEASURES[:5]))) == [_measures(t) for t in texts]


def test_ledger_policies_and_ablations(spark):
    made = rule_ledger.decide(rule_ledger.ledger(table(spark)))
    assert by_row(made, "doc_id", "n_words") == sorted(((r[0], len(WORD.findall(r[1] or ""))) for r in rows()), key=repr)
    for r in made.collect():
        assert r["kept"] == (r["failed"] == 0) and r["base_failed"] == bool(r["failed"] & 3)
    table_ = rule_ledger.ablations(made).collect()
    failed = [r["failed"] for r in made.collect()]
    for line in table_:
        policy = next(p for p in rule_ledger.POLICIES if p.version == line["policy"])
        bit = next(1 << r.bit for r in rule_ledger.RULES if r.name == line["rule"])
        assert line["failing"] == sum(bool(f & bit) for f in failed)
        assert line["failing_only_this"] == sum(f & policy.mask == bit for f in failed)
        assert line["kept_by_policy"] == sum(not f & policy.mask for f in failed)
    assert rule_ledger.ledger(table(spark, [])).count() == 0


# --- 5 language model -------------------------------------------------------------------------------------------------

def test_packed_lists_come_back():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.uint64))
    counts = rng.integers(1, 1000, len(keys))
    a, b = bloom_lm.unpack(bloom_lm.pack(keys, counts))
    assert (a == keys).all() and (b == counts).all()


def test_filter_never_reads_too_low():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64) << np.uint64(1))
    counts = rng.zipf(1.5, len(keys)).astype(np.int64) % 10_000 + 1
    f = bloom_lm.Filter.of({0: bloom_lm.piece(keys, counts).tobytes()}, 0, 1, 1)
    level, true = f.level(keys), bloom_lm.levels(counts)
    assert (level >= true).all() and (level == true).mean() > 0.9
    other = rng.integers(0, 1 << 63, 5000, dtype=np.uint64) << np.uint64(1)
    assert (f.level(other) > 0).mean() < 0.15


@pytest.mark.parametrize("small", [False, True])
def test_scores(spark, monkeypatch, small):
    if small:  # several passes
        monkeypatch.setattr(bloom_lm, "SEGMENT_BYTES", 3000)
        monkeypatch.setattr(bloom_lm, "BROADCAST", 6000)
    df, scratch = table(spark), Scratch(spark)
    out = remainder("doc_id", 7) == 2
    got = bloom_lm.score(df, bloom_lm.train(df.filter(~out), scratch), scratch, out).collect()
    held = lambda r: zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2
    tokens = lambda r: WORD.findall(lower(r[1])) + [None]
    counts = Counter(t for r in rows() if not held(r) for t in tokens(r))
    n, v = sum(counts.values()), len(counts)
    want = sorted((repr(r[0]), held(r), len(tokens(r)), sum(counts[t] > 0 for t in tokens(r)), n,
                   round(sum(np.log10((counts[t] + 1) / (n + v + 1)) for t in tokens(r)), 6)) for r in rows())
    assert sorted((repr(g["doc_id"]), g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"], round(g["base_score"], 6)) for g in got) == want
    assert all(g["score"] <= 0 for g in got)


def test_scores_without_training_rows(spark):
    scratch, df = Scratch(spark), table(spark, [(1, "a b", "en", "s", 3, None, None, None, None, None)])
    out = remainder("doc_id", 7) == 2
    got = bloom_lm.score(df, bloom_lm.train(df.limit(0), scratch), scratch, out).first()
    assert (got["n_tokens"], got["n_known"], got["train_tokens"], got["base_score"], got["score"]) == (3, 0, 0, 0.0, 0.0)


# --- 6 toxicity -------------------------------------------------------------------------------------------------------

def _toxic_tables(spark):
    docs, labels = [], []
    for i in range(400):
        bad = i % 3 == 0
        text = prose(40, i) + (f" moron{'aeiou'[i % 5]}{'xyz'[i % 3]}ly " if bad else " ") + prose(30, 1000 + i)
        docs.append((i, text, "en", "s", len(text), None, None, None, None, None))
        labels.append((i, int(bad), int(bad)))
    return table(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_unseen_forms_are_scored_toxic(spark):
    docs, labels, truth = _toxic_tables(spark)
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    held = [i for i, _, _ in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in held) for i in got)
    assert np.mean([got[i]["predicted"] == truth[i][2] for i in held]) > 0.9


def test_toxicity_of_awkward_rows(spark):
    docs, labels, _ = _toxic_tables(spark)
    model = toxicity.train(docs, labels)
    got = toxicity.score(table(spark), model).collect()
    assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 for r in got)
    kept = toxicity.reject_toxic(table(spark), model)
    assert kept.columns == table(spark).columns and kept.count() == sum(r["predicted"] == 0 for r in got)
    none = toxicity.train(docs, labels.limit(0))
    assert {r["predicted"] for r in toxicity.score(table(spark), none).collect()} == {0}
    assert toxicity.score(table(spark, []), none).count() == 0


# --- 7 repeated passages ----------------------------------------------------------------------------------------------

def _without_repeats(docs):
    seen, out = set(), []
    for doc, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            if raw[i:i + 100] in seen:
                gone[i:i + 100] = b"\1" * 100
            seen.add(raw[i:i + 100])
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_repeats_are_removed_as_by_hand(spark, tmp_path, monkeypatch, small):
    if small:  # many buckets, groups and pieces of a text
        for name, value in (("GROUP_BYTES", 1 << 12), ("BUCKET_BYTES", 1 << 11), ("BUCKET_STRINGS", 100), ("CHUNK", 700), ("FLUSH", 50)):
            monkeypatch.setattr(suffix_dedup, name, value)
    shared = prose(60, 77)
    texts = {i: prose(20, i) + shared[:len(shared) - i] + prose(10, 500 + i) for i in range(20)}
    texts |= {30: "ab" * 400, 31: "x" * 1000, 32: prose(300, 5) + prose(300, 5), 33: None, 34: "", 35: shared, 36: texts[3], 37: "é" * 200}
    df = stored(spark, texts_table(spark, texts), tmp_path)
    got = by_row(suffix_dedup.remove_repeats(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == _without_repeats(texts.items())


def test_repeats_in_awkward_rows(spark, tmp_path):
    got = suffix_dedup.remove_repeats(stored(spark, table(spark), tmp_path)).collect()
    assert sorted((repr(g["doc_id"]), g["n_bytes"]) for g in got) == sorted((repr(r[0]), len((r[1] or "").encode())) for r in rows())
    assert sum(g["n_removed"] for g in got) == sum(w[2] for w in _without_repeats(
        [(r[0], r[1]) for r in sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0))]))
    assert suffix_dedup.remove_repeats(stored(spark, table(spark, []), tmp_path)).count() == 0


def test_stretches_of_one_gram_are_told_apart_by_all_their_bits(monkeypatch):
    """Hashes that differ in their low bits only, as some of a frequent gram's many contexts do."""
    monkeypatch.setattr(suffix_dedup, "_mix", lambda z: z & np.uint64(0xFFFFFF))
    texts = [prose(60, 5).encode()[:suffix_dedup.LENGTH - 10] + b"%010d" % i for i in range(300)]
    s = suffix_dedup.suffixes([(i, 0, t) for i, t in enumerate(texts)])
    keys = tuple(k for k in s if k not in ("doc", "lo", "count"))
    assert len(set(s["k1"].tolist())) < 50 < len(texts)
    order, head = suffix_dedup.earliest({**s, "id": s["doc"], "place": s["doc"]}, keys)
    assert head.sum() == len(texts)


# --- 8 benchmark ------------------------------------------------------------------------------------------------------

def test_overlaps_tolerate_replaced_words(spark):
    item = prose(40, 9).split()
    changed = [w if i % 7 else "other" for i, w in enumerate(item)]
    heavy = [w if i % 2 else "other" for i, w in enumerate(item)]
    texts = {1: prose(50, 1) + " " + " ".join(item) + " " + prose(5, 2), 2: prose(9, 3) + " " + " ".join(changed).upper(), 3: " ".join(heavy),
             4: prose(200, 4), 5: " ".join(item[:9]), 6: " ".join(item[10:30]), 7: None, 8: ""}
    items = spark.createDataFrame([(1, " ".join(item)), (2, "short one"), (3, None), (None, " ".join(item))], "item_id long, text string")
    docs = texts_table(spark, texts)
    assert by_row(spaced_seeds.overlaps(docs, items), "doc_id", "item_id", "n_window") == [(1, 1, 13), (2, 1, 13), (6, 1, 13)]
    left = spaced_seeds.decontaminate(docs, items)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [3, 4, 5, 7, 8]
    awkward = table(spark)
    assert spaced_seeds.decontaminate(awkward, items).count() == len(rows())
    assert spaced_seeds.overlaps(table(spark, []), items).count() == 0
    assert spaced_seeds.overlaps(docs, items.limit(0)).count() == 0


# --- 9 near-duplicates ------------------------------------------------------------------------------------------------

def _print(text):
    w = WORD.findall(lower(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), seed=42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.none(), st.text(alphabet="aB é\n\x1c", max_size=80)))
def test_fingerprint(text):
    assert simhash_vp.fingerprint(text) == _print(text)


@pytest.mark.parametrize("limits", [{}, {"SHARD": 20, "PIECE": 8}])
def test_search_finds_every_link(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(simhash_vp, k, v)
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    points = [int(c) ^ (1 << int(a)) ^ (1 << int(b)) for c in centres for a, b in rng.integers(0, 63, (10, 2))]
    points = sorted({*points, 0, 1, 7})
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)), i) for i, p in enumerate(points)], "point long, node long")
    own = np.array(points, np.uint64)
    forest = simhash_vp.Forest(len(points))
    for i in range(len(own)):
        for j in np.flatnonzero(np.bitwise_count(own[i + 1:] ^ own[i]) <= 2):
            forest.join(i, i + 1 + int(j))
    want = {i: forest.root(i) for i in range(len(points))}
    found = {r["node"]: r["root"] for r in simhash_vp.components(simhash_vp.links(df), Scratch(spark)).collect()}
    assert {i: found.get(i, i) for i in want} == want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(101, 100)], "a long, b long")
    found = {r["node"]: r["root"] for r in simhash_vp.components(edges, Scratch(spark)).collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_near_duplicates_of_awkward_rows(spark):
    got = simhash_vp.near_duplicates(table(spark)).collect()
    assert sorted((repr(g["doc_id"]), int(g["fingerprint"], 16)) for g in got) == sorted((repr(r[0]), _print(r[1])) for r in rows())
    group = {g["doc_id"]: g["component_id"] for g in got}
    assert group[0] == group[1] == group[2] == 0 and group[4] == group[5] == 4
    kept = simhash_vp.one_of_each(table(spark))
    assert kept.columns == table(spark).columns
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(["None", "None", *map(repr, sorted({c for d, c in group.items() if d is not None}))])
    assert simhash_vp.near_duplicates(table(spark, [])).count() == 0


def test_cleaning_goes_by_row_and_not_by_id(spark):
    a, b, c, item = prose(60, 71), prose(60, 72), prose(60, 73), prose(30, 74)
    row = lambda i, t: (i, t, "en", "s", len(t), None, None, None, None, None)
    docs = table(spark, [row(7, a), row(7, b), row(7, b), row(9, a), row(None, c), row(None, c), row(None, a)])
    assert by_row(simhash_vp.one_of_each(docs), "doc_id", "text") == sorted([(7, a), (7, b), (None, c)], key=repr)
    docs = table(spark, [row(7, a), row(7, b + " " + item), row(None, c), row(None, item + " " + c)])
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert by_row(spaced_seeds.decontaminate(docs, items), "doc_id", "text") == sorted([(7, a), (None, c)], key=repr)


def test_near_copies_are_those_with_similar_shingles(spark, monkeypatch):
    """Of each group the stage of the pipeline keeps one, as comparing all pairs does."""
    import corpus_pipeline
    rng = np.random.default_rng(8)
    texts = {}
    for base, n in enumerate([200, 60, 1000]):
        words = prose(n, 800 + base).split()
        for k in range(60):
            own = list(words)
            for at in rng.integers(0, n, rng.integers(0, n // 22 + 1)):
                own[at] = f"new{k}x{at}"
            texts[len(texts)] = " ".join(own[rng.integers(0, 8):])
    texts |= {500: "one two", 501: "One TWO", 502: None, 503: ""}
    sets = {i: {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for i, t in texts.items()}
    ids = sorted(sets)
    forest, links = simhash_vp.Forest(len(ids)), 0
    for x, i in enumerate(ids):
        for y in range(x):
            a, b = sets[i], sets[ids[y]]
            if 10 * len(a & b) >= 8 * len(a | b):
                forest.join(x, y)
                links += a != b
    want = [i for x, i in enumerate(ids) if forest.root(x) == x]
    assert links > 500 and 10 < len(want) < 150
    kept = corpus_pipeline.one_near_duplicate(spark, texts_table(spark, texts), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == want


# --- 10 secrets -------------------------------------------------------------------------------------------------------

BASE = (("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24))


def _base(text):
    found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE) for m in re.finditer(p, text or "", re.ASCII) if ok(m)]
    return sorted(found)


HEX = "0123456789abcdef"


def _secret_texts():
    rng = np.random.default_rng(3)
    hexed = lambda n: "".join(HEX[i] for i in rng.integers(0, 16, n))
    out = {i: f"{prose(20, i)} API_KEY: '{hexed(40)}' {prose(5, i)}" for i in range(40)}
    out |= {100: "AKIA" + "Q1" * 9, 101: f"é🙂 Token=\"{hexed(22)}\" and {hexed(20)}.", 102: prose(80, 8) + " 4668799872880523", 103: "passwd=abc",
            104: "x" * 3000, 105: None, 106: ""}
    return out


def test_secrets(spark):
    df = texts_table(spark, _secret_texts())
    grammar = secret_grammar.learn(df)
    got = {r["doc_id"]: r for r in secret_grammar.scan(df, grammar).collect()}
    for doc, text in _secret_texts().items():
        base = _base(text)
        listed = ",".join(f"{BASE[k][0]}:{s}:{e}" for s, k, e in base)
        assert got[doc]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [got[doc][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(x[1] == i for x in base) for i in range(3)]
        assert set(filter(None, listed.split(","))) <= set(filter(None, got[doc]["spans"].split(",")))
    assert got[101]["n_format"] == 1  # twenty hexadecimal digits without a name before them
    assert not got[102]["spans"] and not got[104]["spans"]  # ordinary words and numbers


def test_secrets_of_awkward_rows(spark):
    grammar = secret_grammar.learn(table(spark))
    assert secret_grammar.scan(table(spark), grammar).count() == len(rows())
    left = secret_grammar.redact(table(spark), grammar)
    assert left.columns == table(spark).columns and left.count() == len(rows())
    text = secret_grammar.redact(texts_table(spark, _secret_texts()), secret_grammar.learn(texts_table(spark, _secret_texts())))
    assert all("AKIA" not in (r["text"] or "") and r["n_chars"] == len(r["text"] or "") for r in text.collect() if r["text"] is not None)
    none = secret_grammar.learn(table(spark, []))
    assert secret_grammar.scan(table(spark, []), none).count() == 0


def test_automata_tell_formats_apart():
    rng = np.random.default_rng(5)
    hexed = ["".join(HEX[i] for i in rng.integers(0, 16, 40)) for _ in range(200)]
    plain = [prose(3, i).replace(" ", "").replace("é", "e") for i in range(300)]
    grammar = secret_grammar.Grammar((secret_grammar.infer(hexed[:100]),), secret_grammar.infer(plain[:200]))
    assert min(map(grammar.ratio, hexed[100:])) > secret_grammar.THRESHOLD > max(map(grammar.ratio, plain[200:]))
    assert secret_grammar.infer([]) is None


# --- queries and pipeline ---------------------------------------------------------------------------------------------

@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, root, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    df = QUERIES[name](spark, root)
    columns = sorted(df.columns)
    result = con.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in result.fetchall()), key=repr)
    assert sorted(names) == columns and by_row(df, *columns) == want and want


def test_ten_queries_are_registered():
    assert {int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES} == set(range(1, 11))


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="needs the pipeline at the top of the repository")
def test_pipeline_keeps_columns_and_takes_effect(spark, root, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{root}/documents.parquet")
    counts = [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, root)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert made.columns == docs.columns
        made.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4] == counts[5]
    assert corpus_pipeline.run(spark, root).count() == counts[-1]


def test_pipeline_takes_an_empty_table(spark, root, tmp_path):
    import corpus_pipeline

    for t in ("documents", "labels", "benchmark"):
        df = spark.read.parquet(f"{root}/{t}.parquet")
        df.limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
