"""A cleaning pipeline for training text: stages over ``documents``, each written as Parquet and read by the next.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the one before it kept. Models are fitted within the
stage on what it gets. All but the last return the columns of ``documents``; the last returns the piece ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framelens.llm import near_copies, piece_transducer, secret_grammar, spaced_seeds, toxicity
from framelens.llm.common import Scratch, documents
from framelens.llm.queries import public_bytes, table


#: Intermediate tables of stages whose results may not be written yet.
_OPEN: list[Scratch] = []


def _begin(spark: SparkSession, docs: DataFrame) -> tuple[Scratch, bool]:
    """Tables of a stage's own, and whether ``docs`` is a stored table. A stage reads the written result of the one before,
    so the tables of earlier stages go, unless ``docs`` still reads them."""
    files = docs.inputFiles()
    for old in list(_OPEN):
        if not any(old.folder.split(":")[-1].rstrip("/") in f for f in files):
            _OPEN.remove(old)
            old.close()
    _OPEN.append(Scratch(spark))
    return _OPEN[-1], bool(files)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of the rows at hand, does not predict toxic.

    Without labels of both kinds nothing is learnt and all rows get the same verdict; rows without a text go by the bias.
    """
    scratch, _ = _begin(spark, docs)
    return toxicity.reject_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), scratch))


def one_near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id.

    Documents are linked if their sets of five-word shingles have a Jaccard similarity of at least 0.8. SimHashes and
    MinHash bands propose pairs, the sets decide. Documents without words are one group.
    """
    scratch, stored = _begin(spark, docs)
    return near_copies.one_of_each(docs, scratch, stored)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item; those without words overlap nothing."""
    scratch, stored = _begin(spark, docs)
    return spaced_seeds.decontaminate(docs, table(spark, sf_dir, "benchmark"), scratch, stored)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced; null and empty texts stay as they are."""
    _begin(spark, docs)
    return secret_grammar.redact(docs, secret_grammar.learn(docs))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document; none for null and empty texts."""
    _begin(spark, docs)
    rows = piece_transducer.encode(docs, public_bytes("piece_bpe_32k.model"))
    return rows.select("doc_id", "n_pieces", "piece_ids", "round_trip")


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", one_near_duplicate), ("decontamination", drop_benchmark),
          ("secret_scan", redact_secrets), ("sentencepiece", encode_pieces)]

#: No stage but the third can be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), documents(spark, sf_dir)
    for _, stage in STAGES:
        done = scratch.write(stage(spark, docs, sf_dir))
        scratch.drop(docs)
        docs = done
    return docs
