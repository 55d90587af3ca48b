"""The cleaning pipeline over ``documents``: each stage works on all rows its
predecessor kept, written as Parquet in between.

Stages: quality rules (rejected documents go, failing lines are removed), near
duplicates (one document of each group stays), benchmark leaks (leaking documents
go), secrets (spans are replaced by their kind), packing into sequences.

Null ids and texts follow the operators' own rules; an empty table passes through
all stages.  Extra columns stay up to the last stage.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import decontaminate, jaccard_join, packing, quality_rules, secrets
from lodestar.llm.common import load
from lodestar.plans.materialize import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, load(spark, sf_dir, "benchmark"))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality), ("jaccard_join", near_duplicates), ("benchmark_leaks", benchmark_leaks),
          ("secret_scan", secret_spans), ("packing", sequences)]

#: Near duplicates and packing can't be written in SQL; tests hold the pipeline
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
