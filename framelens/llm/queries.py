"""The text operators as queries over the given tables, and the SQL that states the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from framelens.llm import (bloom_lm, collocations, kd_shards, merge_counts, piece_transducer, rans_ids, rule_ledger,
                           secret_grammar, simhash_vp, spaced_seeds, suffix_dedup, toxicity, whitening)
from framelens.llm.common import Scratch, documents, remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def public_file(name: str) -> str:
    """Place of a public tokenizer's file; another place is given by the operators' own parameters."""
    import public_tokenizers

    return public_tokenizers.path(name)


def public_bytes(name: str) -> bytes:
    with open(public_file(name), "rb") as f:
        return f.read()


@query("op1_rans_ids")
def op1_rans_ids(spark: SparkSession, root: str) -> DataFrame:
    vocabulary = public_bytes("word_bpe_49k.json").decode("utf-8")
    rows = rans_ids.round_trip(documents(spark, root), vocabulary, 49_408)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op2_piece_transducer")
def op2_piece_transducer(spark: SparkSession, root: str) -> DataFrame:
    return piece_transducer.encode(documents(spark, root), public_bytes("piece_bpe_32k.model"))


@query("op3_kd_shards")
def op3_kd_shards(spark: SparkSession, root: str) -> DataFrame:
    return kd_shards.shards(documents(spark, root), 16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query("op4_rule_ledger", rule_ledger.SQL)
def op4_rule_ledger(spark: SparkSession, root: str) -> DataFrame:
    rows = rule_ledger.decide(rule_ledger.ledger(documents(spark, root)))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                       "kept", "failed")


@query("op5_bloom_lm")
def op5_bloom_lm(spark: SparkSession, root: str) -> DataFrame:
    docs, scratch, held_out = documents(spark, root), Scratch(spark), remainder("doc_id", 7) == 2
    return bloom_lm.score(docs, bloom_lm.train(docs.filter(~held_out), scratch), scratch, held_out)


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, root: str) -> DataFrame:
    docs = documents(spark, root)
    return toxicity.score(docs, toxicity.train(docs, table(spark, root, "labels")))


@query("op9_simhash_vp")
def op9_simhash_vp(spark: SparkSession, root: str) -> DataFrame:
    return simhash_vp.near_duplicates(documents(spark, root))


@query("op7_suffix_dedup")
def op7_suffix_dedup(spark: SparkSession, root: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, root))


@query("op8_spaced_seeds", spaced_seeds.SQL)
def op8_spaced_seeds(spark: SparkSession, root: str) -> DataFrame:
    return spaced_seeds.overlaps(documents(spark, root), table(spark, root, "benchmark"))


@query("op10_secret_grammar")
def op10_secret_grammar(spark: SparkSession, root: str) -> DataFrame:
    docs = documents(spark, root)
    return secret_grammar.scan(docs, secret_grammar.learn(docs))


@query("op11_whitening")
def op11_whitening(spark: SparkSession, root: str) -> DataFrame:
    return whitening.whiten(table(spark, root, "embeddings"))


@query("op12_merge_counts")
def op12_merge_counts(spark: SparkSession, root: str) -> DataFrame:
    return merge_counts.counts(documents(spark, root), public_bytes("byte_bpe_50k.json").decode("utf-8"))


@query("op13_collocations", collocations.SQL)
def op13_collocations(spark: SparkSession, root: str) -> DataFrame:
    return collocations.mine(documents(spark, root))
