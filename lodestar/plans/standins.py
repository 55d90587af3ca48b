"""Stand-in inputs derived from the driver tables for the dataset operators.

* judgments by containment: a document judges a benchmark item when its text
  contains the item text (exact substring; Aho-Corasick over the benchmark
  side, size-checked and broadcast); grade = labels.quality + 1 where
  labelled, else 1.
* KILT-shaped nested queries from ``conversations``: one query per
  conversation, its outputs in parts; each later turn is an output; assistant turns
  cite page ``pmod(conv_id*31 + turn*7, P)`` paragraph ``turn mod 4`` (P = pages count).
* page paragraphs: ``split(html, '<p>')``.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .._ship import ship_package
from ..operators.ranks import ordered_index
from .fixture import load_table

AUTOMATON_CAP = 256 << 20
NEST_CHUNK = 4096             # outputs of one row of a nested query


def _automaton(items: DataFrame, item_key: str):
    import ahocorasick
    A = ahocorasick.Automaton()
    for r in items.select(item_key, "text").toLocalIterator():
        if r["text"]:
            A.add_word(r["text"], A.get(r["text"], ()) + (int(r[item_key]),))
    if len(A):
        A.make_automaton()
    return A


def _scan_fn(bc, doc_key, item_key):
    def scan(batches):
        aut = bc.value
        for b in batches:
            ids = b.column(0).to_pylist()
            texts = b.column(1).to_pylist()
            od, oi = [], []
            for d, t in zip(ids, texts):
                if not t:
                    continue
                hit = set()
                for _, vals in aut.iter(t):
                    hit.update(vals)
                for i in sorted(hit):
                    od.append(d)
                    oi.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(od, pa.int64()), pa.array(oi, pa.int64())],
                                             names=[doc_key, item_key])
    return scan


def containment_pairs(docs: DataFrame, items: DataFrame, doc_key="doc_id", item_key="item_id") -> DataFrame:
    """(doc_key, item_key) for every document text containing an item text.

    The item side becomes Aho-Corasick automata (size-checked; in hash chunks
    beyond ``AUTOMATON_CAP``), broadcast; documents are scanned in place and
    every text is matched whole."""
    spark = docs.sparkSession
    ship_package(spark)
    size = int(items.agg(F.sum(F.length("text"))).first()[0] or 0) * 16
    chunks = max(1, -(-size // AUTOMATON_CAP))
    src = docs.select(F.col(doc_key).cast("long"), "text")
    out = None
    for i in range(chunks):
        part = items if chunks == 1 else items.filter(F.pmod(F.xxhash64(item_key), F.lit(chunks)) == i)
        A = _automaton(part, item_key)
        if len(A) == 0:
            continue
        bc = spark.sparkContext.broadcast(A)
        p = src.mapInArrow(_scan_fn(bc, doc_key, item_key), f"{doc_key} long, {item_key} long")
        out = p if out is None else out.unionByName(p)
    if out is None:
        return spark.createDataFrame([], f"{doc_key} long, {item_key} long")
    return out


def containment_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q_id, doc_id, rel): benchmark items as queries, containing docs as answers."""
    docs = load_table(spark, sf_dir, "documents")
    items = load_table(spark, sf_dir, "benchmark")
    labels = load_table(spark, sf_dir, "labels")
    p = containment_pairs(docs, items)
    return (p.join(labels.select("doc_id", "quality"), "doc_id", "left")
            .select(F.col("item_id").alias("q_id"), "doc_id",
                    F.coalesce(F.col("quality") + 1, F.lit(1)).cast("int").alias("rel")))


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q_id"),
                                                          F.col("text").alias("input"))


def kilt_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, at, answer, provenance): one row per later turn of a conversation that has a
    first one; ``at`` is its place in the order of all turns."""
    turns = load_table(spark, sf_dir, "conversations").filter(F.col("conv_id").isNotNull())
    asked = turns.filter(F.col("turn") == 0).select("conv_id").distinct()
    conv = turns.filter(F.col("turn") > 0).join(asked, "conv_id", "left_semi")
    pages = int(load_table(spark, sf_dir, "pages").agg(F.count(F.lit(1))).first()[0])
    prov = F.when(F.col("role") == "assistant", F.array(F.struct(
        F.pmod(F.col("conv_id") * 31 + F.col("turn") * 7, F.lit(pages)).cast("string").alias("wikipedia_id"),
        (F.col("turn") % 4).cast("int").alias("start_paragraph_id"))))
    rows = conv.select("conv_id", "turn", F.col("text").alias("answer"), prov.alias("provenance"), F.monotonically_increasing_id().alias("row"))
    return ordered_index(rows, [F.col("conv_id"), F.col("turn"), F.col("row")], "at").select(
        F.col("conv_id").cast("string").alias("id"), "at", "answer", "provenance")


def kilt_queries(spark: SparkSession, sf_dir: str, chunk: int = NEST_CHUNK) -> DataFrame:
    """Nested queries in parts: (id, part 0, input, no output) and, for its outputs, rows
    (id, part, null, at most ``chunk`` outputs in order).  No row and no group holds a
    whole conversation."""
    conv = load_table(spark, sf_dir, "conversations")
    kind = "array<struct<answer:string,provenance:array<struct<wikipedia_id:string,start_paragraph_id:int>>>>"
    first = conv.filter(F.col("turn") == 0).select(
        F.col("conv_id").cast("string").alias("id"), F.lit(0).cast("long").alias("part"), F.col("text").alias("input"),
        F.array().cast(kind).alias("output"))
    some = (kilt_outputs(spark, sf_dir).withColumn("part", F.floor(F.col("at") / chunk) + 1).groupBy("id", "part")
            .agg(F.array_sort(F.collect_list(F.struct("at", F.struct("answer", "provenance").alias("o")))).alias("xs")))
    return first.unionByName(some.select("id", "part", F.lit(None).cast("string").alias("input"),
                                         F.transform("xs", lambda e: e["o"]).cast(kind).alias("output")))


def cited_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q_id, doc_id, passage_id, rel): conversations as queries, the paragraphs that their
    answers cite as judged passages; graded 1 or 2 by the answer's length (odd is 2)."""
    cited = kilt_outputs(spark, sf_dir).select("id", "answer", F.explode("provenance").alias("p"))
    return (cited.groupBy(F.col("id").alias("q_id"), F.col("p.wikipedia_id").alias("doc_id"),
                          F.col("p.start_paragraph_id").cast("string").alias("passage_id"))
            .agg(F.max(F.length("answer") % 2 + 1).cast("int").alias("rel")))


def passage_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, passage_id, record_id): every paragraph of every page, ids dense in key order."""
    rows = page_paragraphs(spark, sf_dir).select(F.col("wikipedia_id").alias("doc_id"), F.posexplode("text").alias("place", "text")) \
        .select("doc_id", F.col("place").cast("string").alias("passage_id"))
    return ordered_index(rows, [F.col("doc_id"), F.col("passage_id")], "record_id")


def page_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load_table(spark, sf_dir, "pages")
    return pages.select(F.col("page_id").cast("string").alias("wikipedia_id"),
                        F.split("html", "<p>").alias("text"))
