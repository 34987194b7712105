"""SentencePiece encoding and decoding with a weighted finite-state transducer.

The model file is compiled into three transducers: the normaliser (white space becomes U+2581, a leading one is added),
the pieces (an arc per piece, read character by character, weight minus its score) and the byte fallback (a character
that is no piece becomes its UTF-8 bytes). A text is composed with them and the path of least weight in the tropical
semiring (min, +) gives the ids.

A piece's weight may depend on the piece before it. Unigram models leave that part at zero. A merge (BPE) model is a
bigram automaton: weight zero if merging the joined text of two pieces gives back just these two, else infinity. A
sequence is what merging produces exactly if all its neighbours are such pairs, so one path is finite and it is the
merge result. The pair arcs are expanded when a text first needs them.

No piece contains a U+2581 after another character, so every path passes through one state there. The composition is
cut at these states, and the shortest path of each stretch is worked out once per worker.
"""

from __future__ import annotations

import gc
import re
import zlib
from array import array
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from framelens.llm.common import BATCH_ROWS, Memo, Ragged, lengths, mapped

SPACE = "▁"
UNIGRAM, BPE = 1, 2
_NORMAL, _UNKNOWN, _USER, _UNUSED, _BYTE = 1, 2, 4, 5, 6
#: What an unknown character costs above the worst piece, as the format defines it.
UNKNOWN_PENALTY = 10.0
#: The score of two pieces that are none together.
_NONE = float("-inf")
_STRETCHES = re.compile(r" *[^ ]+| +")


class Transducer:
    """The compiled model: normaliser, pieces, byte fallback and the pair arcs of merge models."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        self.kind = proto.trainer_spec.model_type
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or self.kind not in (UNIGRAM, BPE) or not norm.escape_whitespaces:
            raise ValueError("only unigram and merge models with the identity normaliser can be compiled")
        self.prefix, self.squeeze = norm.add_dummy_prefix, norm.remove_extra_whitespaces
        self.ids, self.score, self.byte, self.spelling = {}, {}, {}, []
        self.unknown = 0
        for i, p in enumerate(proto.pieces):
            if p.type in (_NORMAL, _USER, _UNUSED):
                self.ids[p.piece], self.score[p.piece] = i, p.score
            elif p.type == _BYTE:
                self.byte[int(p.piece[1:-1], 16)] = i
            elif p.type == _UNKNOWN:
                self.unknown = i
            self.spelling.append(bytes([int(p.piece[1:-1], 16)]) if p.type == _BYTE else
                                 p.piece.replace(SPACE, " ").encode() if p.type in (_NORMAL, _USER, _UNUSED) else
                                 " ⁇ ".encode() if p.type == _UNKNOWN else b"")
        #: Whether a start of a piece is a piece itself.
        self.known = {p[:k]: False for p in self.ids for k in range(1, len(p))} | dict.fromkeys(self.ids, True)
        self.worst = -min(self.score.values(), default=0.0) + UNKNOWN_PENALTY
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece with white space inside leaves no states to cut the composition at")
        #: Neighbouring characters within some piece; between any others no arc passes.
        self.inside = {p[k:k + 2] for p in self.ids for k in range(len(p) - 1)}
        self._zero_paths = Memo(lambda text: self._spelled(self._zero(text)), 200_000)
        self.cut_lines = self.prefix and not any("\n" in p for p in self.ids)
        self._pair = Memo(self._fits, 250_000)

    def normalise(self, text: str) -> str:
        """Spaces for U+2581 until a stretch is spelled out; what is cut here holds one symbol of each kind only."""
        text = text.replace(SPACE, " ")
        return " ".join(x for x in text.split(" ") if x) if self.squeeze else text

    def merge(self, text: str) -> list[str]:
        """Merge neighbours by the best score, the leftmost first, as merge models are defined."""
        parts, score = list(text), self.score
        found = [score.get(x + y, _NONE) for x, y in zip(parts, parts[1:])]
        while found:
            best = max(found)
            if best == _NONE:
                break
            at = found.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del found[at]
            if at:
                found[at - 1] = score.get(parts[at - 1] + parts[at], _NONE)
            if at < len(found):
                found[at] = score.get(parts[at] + parts[at + 1], _NONE)
        return parts

    def _fits(self, key: str) -> bool:
        """Whether merging the joined text of two pieces gives back the two; the key tells where the first one ends."""
        cut, text = ord(key[0]), key[1:]
        return self.merge(text) == ([text[:cut], text[cut:]] if cut else [text])

    def shortest(self, text: str) -> bytes:
        """Ids of the least-weight path through the composition with ``text`` (already spelled with U+2581), packed."""
        if self.kind != BPE:
            return self._spelled(self._least(text))
        # No arc crosses a cut, so the parts are independent; texts share far more parts than stretches.
        cuts = [i for i in range(1, len(text)) if text[i - 1:i + 1] not in self.inside]
        if not cuts:
            return self._zero_paths[text]
        return b"".join([self._zero_paths[text[a:b]] for a, b in zip([0, *cuts], [*cuts, len(text)])])

    def _spelled(self, pieces: list[str]) -> bytes:
        ids = self.ids
        try:
            return array("i", [ids[p] for p in pieces]).tobytes()
        except KeyError:
            return array("i", [i for p in pieces for i in self._spell(p)]).tobytes()

    def _arcs(self, text: str, start: int) -> list[int]:
        """Where the pieces that begin at ``start`` end, shortest first; a lone character is always one."""
        end, n, known = start + 1, len(text), self.known
        ends = [end]
        while end < n:
            end += 1
            whole = known.get(text[start:end])
            if whole:
                ends.append(end)
            elif whole is None:
                break
        return ends

    def _zero(self, text: str) -> list[str]:
        """The path of weight zero of a merge model.

        All other paths weigh infinity, so the first complete path is the shortest and the search is depth first,
        longest piece first. A position is reached by one piece only, hence a dead end is a property of the position.
        """
        pieces, at, n, dead, pair, known = [], 0, len(text), set(), self._pair, self.known
        waiting, before = [], "\0"  # the length of the last piece as a character, then the piece
        while at < n:
            if len(waiting) == len(pieces):  # as ``_arcs``, without a call for every piece
                end = at + 1
                ends = [end]
                while end < n:
                    end += 1
                    whole = known.get(text[at:end])
                    if whole:
                        ends.append(end)
                    elif whole is None:
                        break
                waiting.append(ends)
            else:
                ends = waiting[-1]
            while ends:
                end = ends.pop()
                piece = text[at:end]
                if end not in dead and pair[before + piece]:
                    pieces.append(piece)
                    before = chr(end - at) + piece
                    at = end
                    break
            else:
                dead.add(at)
                waiting.pop()
                at -= len(pieces.pop())
                before = chr(len(pieces[-1])) + pieces[-1] if pieces else "\0"
        return pieces

    def _least(self, text: str) -> list[str]:
        """The path of least weight of a unigram model, by distances from the left."""
        n = len(text)
        weight, back = [0.0] + [float("inf")] * n, [0] * (n + 1)
        for start in range(n):
            for end in self._arcs(text, start):
                arc = self.score.get(text[start:end])
                total = weight[start] + (self.worst if arc is None else -arc)
                if total < weight[end]:
                    weight[end], back[end] = total, start
        pieces, end = [], n
        while end:
            pieces.append(text[back[end]:end])
            end = back[end]
        return pieces[::-1]

    def _spell(self, piece: str) -> list[int]:
        if piece in self.ids:
            return [self.ids[piece]]
        return [self.byte.get(b, self.unknown) for b in piece.encode("utf-8", "replace")] if self.byte else [self.unknown]

    def stretches(self, text: str) -> list[str]:
        """Keys of the stretches of a normalised text.

        A stretch is a run of spaces and what follows up to the next one. In the usual case, one space and no line
        feed after it, the space is left out of the key. A line feed is no part of any piece, so that text may also be
        cut before it: such a key starts with the line feed. "\\0" marks a first stretch without any space.
        """
        if not text:
            return []
        if self.cut_lines:
            lined = text.replace("\n", " \n")
            if "  " not in lined and lined[0] != " ":
                return lined.split(" ")
        found = _STRETCHES.findall(" " + text if self.prefix else text)
        return [x[1:] if x[:1] == " " and x[1:2] not in (" ", "\n", "\0") else x if x[:1] == " " else "\0" + x
                for x in found]

    def path(self, key: str) -> bytes:
        """Ids of the stretch with this key, packed."""
        if key[:1] == "\0" and not self.prefix:
            key = key[1:]
        elif key[:1] not in (" ", "\n"):
            key = " " + key
        return self.shortest(key.replace(" ", SPACE))

    def decode(self, ids: Sequence[int]) -> str:
        spelling = self.spelling
        text = b"".join([spelling[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


class Encoder:
    """Encodes batches of texts; shortest paths of stretches are kept per worker, up to a bounded number."""

    def __init__(self, model: bytes):
        self.wfst = Transducer(model)
        self._paths = Ragged(lambda keys: [self.wfst.path(k) for k in keys], 400_000)

    def __call__(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        keys = [self.wfst.stretches(self.wfst.normalise(t)) if t else [] for t in texts]
        flat, sizes = self._paths([k for ks in keys for k in ks])
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(lengths(keys))] if len(keys) else []
        return np.split(flat, ends[:-1]) if len(keys) else []


_WORKERS: dict[bytes, Encoder] = {}


def worker_encoder(model: bytes) -> Encoder:
    """The ``Encoder`` of a worker process, which keeps it from task to task: a new one for each task would stand beside
    the old one until Python collects its cycles."""
    if model not in _WORKERS:
        _WORKERS.clear()
        _WORKERS[model] = Encoder(model)
    return _WORKERS[model]


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """``doc_id, piece_ids, n_pieces, n_byte_pieces, ids_crc32, decoded_crc32, round_trip`` of every row.

    ``ids_crc32`` covers the ids as little-endian unsigned 32-bit numbers, ``decoded_crc32`` the decoded text as UTF-8,
    ``round_trip`` says whether that is the text (null counts as empty). A text that holds U+2581 itself decodes to a
    space there. Repeated rows are encoded each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a model file: half a megabyte, whatever the table

    def run(batches):
        gc.collect()  # what the worker's earlier tasks have left
        pa.default_memory_pool().release_unused()
        encoder = worker_encoder(shared.value)
        byte = np.zeros(len(encoder.wfst.spelling), bool)
        byte[list(encoder.wfst.byte.values())] = True
        for batch in batches:  # an Arrow batch, so that only the texts of a slice are Python's too
            for lo in range(0, batch.num_rows, BATCH_ROWS):
                docs, texts = (c.to_pylist() for c in batch.slice(lo, BATCH_ROWS).columns)
                texts = [t or "" for t in texts]
                ids = encoder(texts)
                back = [encoder.wfst.decode(x.tolist()) for x in ids]
                yield pa.RecordBatch.from_arrays([
                    pa.array(docs, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(lengths(ids)),
                    pa.array([int(byte[x].sum()) for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                    pa.array([zlib.crc32(t.encode("utf-8", "replace")) for t in back], pa.int64()),
                    pa.array([a == b for a, b in zip(texts, back)], pa.bool_())], names)

    kinds = ("doc_id long, piece_ids array<int>, n_pieces long, n_byte_pieces long, ids_crc32 long, decoded_crc32 long, "
             "round_trip boolean")
    names = [k.split()[0] for k in kinds.split(", ")]
    return docs.select("doc_id", "text").mapInArrow(run, kinds)


def decode(rows: DataFrame, model: bytes) -> DataFrame:
    """``doc_id, text`` of rows with ``doc_id, piece_ids``; null ids give an empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        wfst = Transducer(shared.value)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"),
                                "text": [wfst.decode(x) if x is not None else "" for x in pdf["piece_ids"]]})

    return mapped(rows.select("doc_id", "piece_ids"), run, "doc_id long, text string")
