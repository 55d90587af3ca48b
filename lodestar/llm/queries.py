"""Registered queries of the training-data operators: ``(spark, sf_dir) -> DataFrame``,
each over its whole table, with DuckDB SQL where SQL can express the result."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_records, collocations, decontaminate, jaccard_join, language_model, packing, page_text, prefix_trie, quality_rules, repeated_passages, secrets, token_counts
from .common import load

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return register


@query("op1_quality_rules", quality_rules.ORACLE)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(load(spark, sf_dir, "documents")).drop("clean_text")


@query("op2_secret_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(load(spark, sf_dir, "documents"))
    written = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.withColumn("spans", written)


@query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.with_limit(token_counts.count_tokens(load(spark, sf_dir, "documents")), 1024)


@query("op5_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load(spark, sf_dir, "documents"))


@query("op7_repeated_passages")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages.remove_repeats(load(spark, sf_dir, "documents")).drop("kept_text")


@query("op8_chat_records")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_records.link(load(spark, sf_dir, "conversations"))


@query("op9_page_text")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract(load(spark, sf_dir, "pages"))


@query("op10_benchmark_leaks")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@query("op4_jaccard_join")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(load(spark, sf_dir, "documents"))


@query("op6_language_model")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_held_out(load(spark, sf_dir, "documents"))


@query("op11_collocations", collocations.ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(load(spark, sf_dir, "documents"))


@query("op12_byte_bpe")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(byte_bpe.round_trip(load(spark, sf_dir, "documents")))


@query("op13_prefix_trie", prefix_trie.ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(load(spark, sf_dir, "conversations")).drop("turn_conv_id", "turn_place")
