"""Token ids as a table of range-coded blocks (static asymmetric numeral system, Duda 2013).

All blocks share one frequency table, counted over the whole corpus, so a block decodes on its own. Within a block the
ids are dealt over ``LANES`` interleaved coder states that move in step, which numpy advances together. Every
``CHECKPOINT`` steps the states and the place in the word stream are kept: the pieces between checkpoints decode at the
same time, and a reader can start in the middle. A checksum covers every block.

The file format is a folder of Parquet files. ``frequencies`` has one row: the quantised frequencies as a compressed
array and their checksum. ``blocks`` has one row per block in ascending document order within and across files: number of
the file and of the block, tokens before it in the file, ids and lengths of its documents, and the payload. A payload is
little endian: magic, tokens, crc32 of the frequency table, crc32 of what follows; then the checkpoints (LANES 64-bit
states and a 32-bit word position each) and the 32-bit words.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import struct
import zlib
from array import array
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from framelens.llm.common import Ragged, Scratch, group_sums, in_slices, lengths, mapped, spread

MAGIC, LANES, CHECKPOINT, BLOCK = b"RNS1", 256, 64, 1 << 17
#: log2 of the sum of the quantised frequencies; the states stay in [LOW, LOW << 32).
SCALE, LOW = 20, np.uint64(1 << 31)
_HEAD = struct.Struct("<4sIII")
_U = np.uint64
#: Byte-level vocabularies name a byte by itself if it prints in Latin-1, else by the next free character from U+0100 on.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTE_NAMES = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}
_NAMES = "".join(chr(b if b == 10 else _BYTE_NAMES.get(b, b)) for b in range(256))
#: What is none of printable ASCII without capitals, the letters U+00C0 to U+00FF (all composed) and line feed, in UTF-8.
_UNUSUAL = re.compile(rb"[\x00-\x09\x0b-\x20A-Z\x7f\xc2\xc4-\xff]|\xc3[\x97\xb7]").search
_CAPITAL = re.compile(rb"\xc3[\x80-\x9e]").search
#: The pieces that the pre-tokenizer cuts them into, in byte names (U+00C3 begins a letter), and line feeds.
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|(?:[a-z]|\xc3.)+|[0-9]|\n|[^a-z0-9\n\xc3]+").findall
_PARTED: list = []
#: Texts that are cut into words together.
SLICE = 2_048


def quantise(counts: np.ndarray) -> np.ndarray:
    """Frequencies adding up to 2**SCALE, at least one for every id that occurs (the most frequent ids give way)."""
    counts = counts.astype(np.float64)
    used = np.flatnonzero(counts)
    freq = np.zeros(len(counts), np.int64)
    if not len(used):
        return freq
    if len(used) > 1 << SCALE:
        raise ValueError("more ids than the frequency scale can tell apart")
    freq[used] = np.maximum(1, np.floor(counts[used] / counts.sum() * (1 << SCALE)))
    order = used[np.argsort(-counts[used], kind="stable")]
    rest = (1 << SCALE) - int(freq.sum())
    if rest > 0:
        freq[order[0]] += rest
    for i in order:
        if rest >= 0:
            break
        give = min(-rest, int(freq[i]) - 1)
        freq[i] -= give
        rest += give
    return freq


class Coder:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(_U)
        self.start = (np.cumsum(freq) - freq).astype(_U)
        self.check = zlib.crc32(freq.astype("<u4").tobytes())
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.int32), freq)

    def encode(self, ids: np.ndarray) -> bytes:
        n = len(ids)
        if not n:
            return _HEAD.pack(MAGIC, 0, self.check, zlib.crc32(b""))
        steps = -(-n // LANES)
        grid = np.full(steps * LANES, ids[-1], np.int64)  # the tail repeats the last id
        grid[:n] = ids
        grid = grid.reshape(steps, LANES)
        state, words, points = np.full(LANES, LOW, _U), [None] * steps, []
        freq, start = self.freq[grid], self.start[grid]
        room = freq << _U(63 - SCALE)
        for t in range(steps - 1, -1, -1):
            f = freq[t]
            full = np.flatnonzero(state >= room[t])
            high = state[full]
            words[t] = high.astype("<u4")  # the lower half
            state[full] = high >> _U(32)
            turns = state // f
            state += turns * (_U(1 << SCALE) - f) + start[t]  # the remainder of the division is state - turns * f
            if t % CHECKPOINT == 0:
                points.append(state.copy())
        before = np.cumsum([0] + [len(w) for w in words])[:steps:CHECKPOINT]
        body = b"".join([s.astype("<u8").tobytes() + struct.pack("<I", int(p)) for s, p in zip(points[::-1], before)]
                        + [w.tobytes() for w in words])
        return _HEAD.pack(MAGIC, n, self.check, zlib.crc32(body)) + body

    def decode(self, payload: bytes) -> np.ndarray:
        """All pieces between checkpoints side by side."""
        magic, n, check, crc = _HEAD.unpack_from(payload)
        body = memoryview(payload)[_HEAD.size:]
        if magic != MAGIC or check != self.check or zlib.crc32(body) != crc:
            raise ValueError("a block does not match its checksum or the frequency table")
        if not n:
            return np.zeros(0, np.int32)
        steps = -(-n // LANES)
        pieces = -(-steps // CHECKPOINT)
        size = LANES * 8 + 4
        head = np.frombuffer(body, np.uint8, pieces * size).reshape(pieces, size)
        state = np.ascontiguousarray(head[:, :LANES * 8]).view("<u8").astype(_U)
        place = np.ascontiguousarray(head[:, LANES * 8:]).view("<u4").astype(np.int64)[:, 0]
        words = np.frombuffer(body, "<u4", offset=pieces * size)
        words = np.concatenate([words, np.zeros(LANES, np.uint32)]).astype(_U)
        out = np.zeros((pieces, CHECKPOINT, LANES), np.int32)
        mask = _U((1 << SCALE) - 1)
        for t in range(CHECKPOINT):
            live = pieces if (pieces - 1) * CHECKPOINT + t < steps else pieces - 1
            if not live:
                break
            x = state[:live]
            slot = x & mask
            found = self.symbol[slot]
            out[:live, t] = found
            x = self.freq[found] * (x >> _U(SCALE)) + slot - self.start[found]
            low = x < LOW
            rank = np.cumsum(low, axis=1)
            at = place[:live, None] + rank - 1
            x[low] = (x[low] << _U(32)) | words[at[low]]
            place[:live] += rank[:, -1]
            state[:live] = x
        return out.reshape(-1)[:n]


#: The steps of a tokenizer file for which words can be looked up one by one.
_NORMALISER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_CUTS = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


def check(tokenizer_json: str) -> None:
    """Refuse tokenizer files whose ids do not follow from their words taken one by one."""
    spec = json.loads(tokenizer_json)
    if spec.get("normalizer") != _NORMALISER or spec.get("pre_tokenizer") != _CUTS:
        raise ValueError("this tokenizer's normaliser or pre-tokenizer does not work word by word")
    if spec["model"].get("type", "BPE") != "BPE" or spec["model"].get("dropout") or spec.get("truncation") or spec.get("padding"):
        raise ValueError("only plain byte-pair models without truncation or padding are supported")
    if any(not t["content"].startswith("<|") or t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError("added tokens must be spelled with <| and stand for themselves")


_WORKERS: dict[str, Callable] = {}


def worker_tokenizer(tokenizer_json: str) -> Callable:
    """The ``word_tokenizer`` of a worker process, which keeps it and its memos from task to task."""
    key = hashlib.sha256(tokenizer_json.encode("utf-8")).hexdigest()
    if key not in _WORKERS:
        _WORKERS.clear()
        _WORKERS[key] = word_tokenizer(tokenizer_json)
    return _WORKERS[key]


def word_tokenizer(tokenizer_json: str) -> Callable:
    """Ids of whole texts by the tokenizers library, without special tokens.

    The tokenizer lower-cases, drops white space and never joins what white space separates, so a text's ids are those
    of its words. Arrow cuts the texts and numbers the distinct words, which are looked up in a bounded memo. New ones of
    the usual letters are cut as the pre-tokenizer does and their pieces go to the library's model, others through the
    library one by one. A text with "<|", where special tokens are spelled, goes through the library as a whole.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library's own threads would wait on it
    from tokenizers import Tokenizer

    whole = Tokenizer.from_str(tokenizer_json)
    model = whole.model

    def library(text: str) -> bytes:
        return array("i", whole.encode(text, add_special_tokens=False).ids).tobytes()

    def many(words: list[bytes]) -> list[bytes]:
        joined, other = b"\n".join(words), {}
        if _UNUSUAL(joined):
            other = {i: w for i, w in enumerate(words) if _UNUSUAL(w)}
            joined = b"\n".join([b"" if i in other else w for i, w in enumerate(words)])
        if _CAPITAL(joined):
            joined = joined.decode("utf-8").lower().encode("utf-8")
        pieces = _PIECES(codecs.charmap_decode(joined, "strict", _NAMES)[0])
        found = [_PARTED if p == "\n" else model.tokenize(p) for p in pieces]
        parted = np.fromiter((x is _PARTED for x in found), bool, len(found))
        ids = [t.id for x in found for t in x]
        ends = np.concatenate([[0], np.cumsum(lengths(found))])[np.append(np.flatnonzero(parted), len(found))] * 4
        packed, at = array("i", ids).tobytes(), ends.tolist()
        out = [packed[a:b] for a, b in zip([0, *at], at)]
        for i, w in other.items():
            out[i] = library(w.decode("utf-8"))
        return out

    table = Ragged(many)

    def encode(texts: list[str | None]) -> list[np.ndarray]:
        texts = pa.array(texts, pa.large_string())  # made anew: Arrow's functions go wrong on a cast slice of an array
        special = pc.fill_null(pc.match_substring(texts, "<|"), False)
        cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.if_else(special, None, texts)))
        coded = cut.flatten().dictionary_encode()  # an empty word at the edge of a text has no ids
        flat, sizes = table(coded.dictionary.cast(pa.large_binary()).to_pylist())
        code = coded.indices.to_numpy()
        flat = flat[spread((np.cumsum(sizes) - sizes)[code], sizes[code])]
        per = group_sums(sizes[code], pc.fill_null(pc.list_value_length(cut), 0).to_numpy(zero_copy_only=False))
        ids = np.split(flat, np.cumsum(per)[:-1]) if len(texts) else []
        for i in np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist():
            ids[i] = np.frombuffer(library(texts[i].as_py()), np.int32)
        return ids

    return encode


def _packed(ids: np.ndarray, width: str = "<u4") -> bytes:
    return ids.astype(width).tobytes()


def width_of(vocabulary: int) -> str:
    """Numbers between the steps: two bytes where they hold every id, else four."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def tokenise(docs: DataFrame, tokenizer_json: str, end: int, width: str) -> DataFrame:
    """``doc_id, ids, place`` with ``end`` behind every document; ids are packed as numbers of the given type, ``place``
    tells equal rows apart."""
    check(tokenizer_json)
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # a vocabulary file, whatever the table

    def run(batches):
        encode = worker_tokenizer(shared.value)
        tail = np.array([end], np.int32)
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                some = batch.slice(lo, SLICE)
                ids = [_packed(np.concatenate([x, tail]), width) for x in encode(some.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([some.column(0).cast(pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    made = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")
    return made.withColumn("place", F.monotonically_increasing_id())


def frequencies(tokens: DataFrame, vocabulary: int, width: str) -> np.ndarray:
    """Quantised frequencies over the whole table; tasks pass on one count per id, at most the vocabulary."""

    def run(batches):
        total = np.zeros(vocabulary, np.int64)
        for pdf in in_slices(batches):
            total += np.bincount(np.frombuffer(b"".join(pdf["ids"]), width), minlength=vocabulary)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"id": at, "n": total[at]})

    counts = np.zeros(vocabulary, np.int64)
    for r in mapped(tokens.select("ids"), run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    return quantise(counts)


def write(tokens: DataFrame, freq: np.ndarray, width: str, path: str) -> None:
    """Write ``doc_id, ids, place`` in ascending ``doc_id`` order to the folder ``path``; ties go by crc32 and place, so that a
    row repeated many times is spread over files too."""
    spark = tokens.sparkSession
    raw = freq.astype("<u4").tobytes()
    spark.createDataFrame([(bytearray(zlib.compress(raw)), zlib.crc32(raw))], "table binary, crc32 long").write.parquet(f"{path}/frequencies")
    coder = spark.sparkContext.broadcast(freq)  # one number per id of the vocabulary

    def run(batches):
        made, ids, docs, sizes, block, before = Coder(coder.value), [], [], [], 0, 0

        def close():
            flat = np.concatenate(ids)
            return pd.DataFrame({"block": [block], "before": [before], "n_tokens": [len(flat)], "doc_ids": [docs], "sizes": [sizes],
                                 "payload": [made.encode(flat)]})

        total = 0
        for pdf in batches:
            for doc, raw in zip(pdf["doc_id"], pdf["ids"]):
                own = np.frombuffer(raw, width)
                ids.append(own)
                docs.append(None if pd.isna(doc) else int(doc))
                sizes.append(len(own))
                total += len(own)
                if total >= BLOCK:
                    yield close()
                    ids, docs, sizes, block, before, total = [], [], [], block + 1, before + total, 0
        if ids:
            yield close()

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("doc_id").asc_nulls_first(), F.crc32("ids"), F.col("place")]
    ranged = tokens.repartitionByRange(n, *order).sortWithinPartitions(*order)
    blocks = mapped(ranged.select("doc_id", "ids"), run, "block long, before long, n_tokens long, doc_ids array<long>, sizes array<long>, payload binary")
    # Payloads are dense already; the columns beside them are small.
    blocks.select(F.spark_partition_id().alias("file"), "*").write.option("compression", "none").parquet(f"{path}/blocks")


def read(spark, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document, decoded from the blocks below ``path``."""
    row = spark.read.parquet(f"{path}/frequencies").first()
    raw = zlib.decompress(row["table"])
    if zlib.crc32(raw) != row["crc32"]:
        raise ValueError("the frequency table does not match its checksum")
    shared = spark.sparkContext.broadcast(np.frombuffer(raw, "<u4").astype(np.int64))
    blocks = spark.read.parquet(f"{path}/blocks")
    files = blocks.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One number per file, and there are as many files as the writer had partitions: payloads need not move.
    placed = blocks.join(F.broadcast(files.select("file", ahead.alias("ahead"))), "file").withColumn("start", F.col("ahead") + F.col("before"))

    def run(batches):
        coder = Coder(shared.value)
        for pdf in in_slices(batches, 4):
            for r in pdf.itertuples(index=False):
                ids = coder.decode(r.payload)
                sizes = np.asarray(r.sizes, np.int64)
                ends = np.cumsum(sizes)
                if len(ids) != r.n_tokens or (ends[-1] if len(ends) else 0) != len(ids):
                    raise ValueError("a block has another number of tokens than its documents")
                yield pd.DataFrame({"doc_id": pd.array(list(r.doc_ids), "Int64"), "start": int(r.start) + ends - sizes,
                                    "n_tokens": sizes, "ids": [_packed(x) for x in np.split(ids, ends[:-1])]})

    return mapped(placed.select("doc_ids", "sizes", "n_tokens", "payload", "start"), run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer_json: str, vocabulary: int, end: int = 1) -> DataFrame:
    """Tokenise ``docs``, write the ids and read them back: ``doc_id, start, n_tokens, ids``.

    A null or empty text has the end id alone. Repeated rows are written each; rows without an id come first.
    """
    scratch = Scratch(docs.sparkSession)
    width, path = width_of(vocabulary), f"{scratch.folder}/ids"
    tokens = scratch.write(tokenise(docs, tokenizer_json, end, width), compression="zstd")
    write(tokens, frequencies(tokens, vocabulary, width), width, path)
    scratch.drop(tokens)
    return read(docs.sparkSession, path)
