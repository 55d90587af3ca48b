"""Sources and sinks.

Everything is a Spark reader/writer with a declared schema; on-disk layout is
parquet with ``split`` as a partition column so split filters prune files.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import datasets as DS
from .csv_blocks import read_csv
from .publish import append_run, commit, current

RECORD_SCHEMA = T.StructType([T.StructField("record_id", T.LongType()),
                              T.StructField("doc_id", T.StringType()),
                              T.StructField("passage_id", T.StringType()),
                              T.StructField("text", T.StringType())])
EMBEDDING_SCHEMA = "record_id long, embedding array<float>"
QUERY_EMBEDDING_SCHEMA = "q_id long, embedding array<float>"
JUDGMENT_SCHEMA = "q_id long, record_id long, rel int"
SPLITS = ("train", "dev", "test")


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_records(spark: SparkSession, path: str, schema=RECORD_SCHEMA) -> DataFrame:
    """S1."""
    return spark.read.schema(schema).parquet(path)


def drop_index_columns(df: DataFrame) -> DataFrame:
    """Stray index columns of earlier CSV writes (blank or 'Unnamed: n')."""
    bad = [c for c in df.columns if c.strip() == "" or c.startswith("Unnamed") or c == "_c0"]
    return df.drop(*bad)


def read_query_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV with an ``input`` text column (quoted, multi-line); a file is
    read by as many tasks as it has blocks."""
    return drop_index_columns(read_csv(spark, path))


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S3: headerless TSV with given column names/types, e.g.
    ``'doc_id string, text string'`` or ``'q_id string, zero int, doc_id string, rel int'``."""
    return spark.read.option("sep", "\t").option("header", False).option("quote", "").schema(schema).csv(path)


def read_kilt(spark: SparkSession, path: str) -> DataFrame:
    """KILT JSON lines with nested provenance."""
    return spark.read.schema(DS.PROVENANCE_SCHEMA).json(path)


def read_beir(spark: SparkSession, root: str):
    """Corpus + queries + qrels for the first split present; the corpus is
    the same for every split.  Returns (corpus, queries, qrels, split)."""
    root = root.rstrip("/")
    split = next((s for s in SPLITS if path_exists(spark, f"{root}/qrels/{s}.tsv")), None)
    if split is None:
        raise FileNotFoundError(f"no qrels under {root}/qrels")
    corpus = (spark.read.schema("_id string, title string, text string").json(f"{root}/corpus.jsonl")
              .select(F.col("_id").alias("doc_id"), "title", "text"))
    queries = (spark.read.schema("_id string, text string").json(f"{root}/queries.jsonl")
               .select(F.col("_id").alias("q_id"), F.col("text").alias("input")))
    qrels = (spark.read.option("sep", "\t").option("header", True)
             .schema("q_id string, doc_id string, rel int").csv(f"{root}/qrels/{split}.tsv"))
    return DS.with_default_passage(corpus), queries, qrels, split


def read_beir_splits(spark: SparkSession, root: str):
    """S5 for every split present: (corpus, queries, qrels); queries and qrels carry their
    ``split``, and a query stands in each split that judges it."""
    root = root.rstrip("/")
    found = [s for s in SPLITS if path_exists(spark, f"{root}/qrels/{s}.tsv")]
    if not found:
        raise FileNotFoundError(f"no qrels under {root}/qrels")
    corpus, queries, _, _ = read_beir(spark, root)
    qrels = None
    for s in found:
        part = (spark.read.option("sep", "\t").option("header", True).schema("q_id string, doc_id string, rel int")
                .csv(f"{root}/qrels/{s}.tsv").withColumn("split", F.lit(s)))
        qrels = part if qrels is None else qrels.unionByName(part)
    judged = qrels.select("q_id", "split").distinct()
    return corpus, queries.join(judged, "q_id"), DS.with_default_passage(qrels)


def write_published(records: DataFrame, queries: DataFrame, judgments: DataFrame, root: str) -> None:
    """Records (dense record_id), queries (dense q_id per split) and long
    judgments, partitioned by split, as a new version of ``root`` that readers see
    once all three are written.  ``judgments`` carries the old q_id."""
    def write(folder: str) -> None:
        rek = DS.rekey_per_split(queries.select("q_id", "split", *[c for c in queries.columns
                                                                    if c not in ("q_id", "split")]))
        m = rek.select("old_q_id", "split", "q_id")
        j = (judgments.withColumnRenamed("q_id", "old_q_id").join(m, "old_q_id")
             .select("split", "q_id", "record_id", "rel"))
        records.write.parquet(f"{folder}/data_records")
        rek.drop("old_q_id").write.partitionBy("split").parquet(f"{folder}/qs")
        j.write.partitionBy("split").parquet(f"{folder}/qs_rel")
    commit(records.sparkSession, root, write)


def read_published(spark: SparkSession, root: str):
    """(records, queries with split, judgments with split) of the committed version, or
    of a folder that holds the three tables itself."""
    root = current(spark, root) or root.rstrip("/")
    return (spark.read.parquet(f"{root}/data_records"), spark.read.parquet(f"{root}/qs"),
            spark.read.parquet(f"{root}/qs_rel"))


def published_query_sets(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, judged queries with split, answers).  Answers are one row per split,
    query and record; ``grade`` is null in a split without grades (no rel above 1)."""
    records, queries, judgments = read_published(spark, root)
    graded = DS.with_rels_flag(judgments).withColumnRenamed("split", "__s")
    one = judgments.groupBy("split", "q_id", "record_id").agg(F.max("rel").alias("rel"))
    answers = one.join(F.broadcast(graded), F.col("split").eqNullSafe(F.col("__s"))) \
        .withColumn("grade", F.when(F.col("with_rels"), F.col("rel"))).drop("__s", "with_rels", "rel")      # one flag per split
    judged = queries.join(answers.select("split", "q_id").distinct(), ["split", "q_id"], "left_semi")
    return records, judged, answers


def load_processed(spark: SparkSession, root: str, embeddings: DataFrame, query_embeddings: DataFrame):
    """Records, per-split query sets with answers (and grades when the
    split is graded), the answerable part of the embeddings and the nontrain
    rest (None when empty)."""
    from ..operators.tune import QuerySet
    recs, qs, rel = read_published(spark, root)
    sets = {}
    for s in SPLITS:
        q = (qs.filter(F.col("split") == s).select("q_id")
             .join(query_embeddings.filter(F.col("split") == s).select("q_id", "embedding"), "q_id"))
        j = rel.filter(F.col("split") == s).select("q_id", "record_id", "rel")
        sets[s] = QuerySet(DS.judged_only(q, j), j)
    td = qs.filter(F.col("split").isin("train", "dev")).select("q_id", "split")
    tdj = rel.join(td, ["q_id", "split"], "left_semi")
    m = tdj.agg(F.max("record_id")).first()[0]
    m = 0 if m is None else int(m) + 1
    ans = embeddings.filter(F.col("record_id") < m)
    rest = embeddings.filter(F.col("record_id") >= m)
    return recs, sets, ans, (None if rest.limit(1).count() == 0 else rest), m


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """A directory of embedding files is one table (no shard loop)."""
    return spark.read.parquet(path)


def shard_layout(n_nontrain: int, cap_gb: float, dim: int) -> tuple[int, int]:
    """S10 sizes: (shards, rows_per_shard) under the memory cap."""
    max_rows = cap_gb * 2 ** 28 / dim
    if n_nontrain <= 0:
        return 0, 0
    shards = int(math.ceil(n_nontrain / max_rows))
    return shards, int(math.ceil(n_nontrain / shards))


def shard_plan(embeddings: DataFrame, m: int, cap_gb: float, dim: int) -> DataFrame:
    """Shard number per nontrain record (record_id >= m)."""
    nt = embeddings.filter(F.col("record_id") >= m)
    n = nt.count()
    shards, per = shard_layout(n, cap_gb, dim)
    return nt.withColumn("shard", F.floor((F.col("record_id") - F.lit(m)) / F.lit(max(per, 1))).cast("long"))


def write_embedding_shards(embeddings: DataFrame, root: str, m: int, cap_gb: float, dim: int,
                           mode: str = "overwrite") -> int:
    """Answerable part as one table, nontrain part in size-capped shards."""
    root = root.rstrip("/")
    embeddings.filter(F.col("record_id") < m).write.mode(mode).parquet(f"{root}/answerable")
    plan = shard_plan(embeddings, m, cap_gb, dim)
    n = plan.count()
    shards, per = shard_layout(n, cap_gb, dim)
    if shards:
        (plan.repartitionByRange(shards, "record_id").write.mode(mode)
         .option("maxRecordsPerFile", per).partitionBy("shard").parquet(f"{root}/nontrain"))
    return shards


def append_result(df: DataFrame, path: str, run_id: str | None = None) -> str:
    """Append result rows; a retry with the same ``run_id`` adds none."""
    return append_run(df, path, run_id)
