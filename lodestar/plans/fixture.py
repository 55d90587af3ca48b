"""Retrieval fixture derived from the ``embeddings`` table.

With ``n = max(vec_id)+1``, ``nd = 6n div 10``, ``na = 4n div 10``:
corpus = vectors with ``vec_id < nd``; for every ``d < na`` and ``j in 0..4``
a query ``q_id = 5d+j`` = normalize(0.5 v[d] + 0.6 v[nd+d] + 0.55 v[o]) with
``o = (7d+31j+11) mod nd``; ``j`` in 0,1,2 -> train, 3 -> dev, 4 -> test;
train rows with ``d mod 10 = 9`` are left out.  Judgments: (q, d, 2); for even
``j`` and ``o != d`` also (q, o, 1); for ``j = 1`` and ``d mod 7 = 3`` also
(q, z, 1) with ``z = na + 3d mod (nd-na)``.
All of it is joins and projections on the table, so it grows with it.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import as_double, with_normalized

SPLITS = ("train", "dev", "test")


@dataclass
class Fixture:
    corpus: DataFrame      # record_id, embedding
    queries: DataFrame     # q_id, split, d, j, o, embedding
    judgments: DataFrame   # q_id, record_id, rel
    nd: int
    na: int

    def split(self, name: str) -> DataFrame:
        return self.queries.filter(F.col("split") == name).select("q_id", "embedding")

    def judged(self, name: str) -> DataFrame:
        ids = self.queries.filter(F.col("split") == name).select("q_id")
        return self.judgments.join(ids, "q_id", "left_semi")


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def build_fixture(spark: SparkSession, sf_dir: str) -> Fixture:
    emb = load_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("long").alias("vec_id"), as_double("embedding").alias("v"))
    n = int(emb.agg(F.max("vec_id")).first()[0]) + 1   # one scalar
    nd, na = n * 6 // 10, n * 4 // 10
    corpus = emb.filter(F.col("vec_id") < nd).select(
        F.col("vec_id").alias("record_id"), F.col("v").alias("embedding"))
    base = (emb.filter(F.col("vec_id") < na).select(F.col("vec_id").alias("d"), F.col("v").alias("va"))
            .withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(4))))
            .filter((F.col("j") >= 3) | (F.col("d") % 10 != 9))
            .withColumn("q_id", F.col("d") * 5 + F.col("j"))
            .withColumn("o", (F.col("d") * 7 + F.col("j") * 31 + 11) % nd))
    drift = emb.select(F.col("vec_id").alias("bd"), F.col("v").alias("vb"))
    other = emb.select(F.col("vec_id").alias("o"), F.col("v").alias("vo"))
    raw = (base.join(drift, F.col("bd") == F.col("d") + nd)
           .join(other, "o")
           .withColumn("u", F.zip_with(F.zip_with("va", "vb", lambda x, y: 0.5 * x + 0.6 * y),
                                       F.col("vo"), lambda s, z: s + 0.55 * z)))
    split = (F.when(F.col("j") < 3, "train").when(F.col("j") == 3, "dev").otherwise("test"))
    queries = with_normalized(raw, "u", "embedding").select(
        "q_id", split.alias("split"), "d", "j", "o", "embedding")
    g = base.select("q_id", "d", "j", "o")
    judg = (g.select("q_id", F.col("d").alias("record_id"), F.lit(2).alias("rel"))
            .unionByName(g.filter((F.col("j") % 2 == 0) & (F.col("o") != F.col("d")))
                         .select("q_id", F.col("o").alias("record_id"), F.lit(1).alias("rel")))
            .unionByName(g.filter((F.col("j") == 1) & (F.col("d") % 7 == 3))
                         .select("q_id", (F.lit(na) + (F.col("d") * 3) % (nd - na)).alias("record_id"),
                                 F.lit(1).alias("rel"))))
    return Fixture(corpus, queries, judg, nd, na)


# DuckDB text of the same fixture, for oracle SQL (views: q, judg, corpus)
def duckdb_fixture_ctes() -> str:
    return """
e as (select vec_id, embedding::double[] v from embeddings),
c as (select (max(vec_id)+1)*6//10 nd, (max(vec_id)+1)*4//10 na from e),
corpus as (select vec_id record_id, v from e, c where vec_id < c.nd),
raw as (select a.vec_id*5+j.j q_id, a.vec_id d, j.j j,
  list_transform(range(1, len(a.v)+1), lambda i: 0.5*a.v[i]+0.6*b.v[i]+0.55*n.v[i]) u
  from c, e a, e b, e n, (select unnest(range(5)) j) j
  where a.vec_id<c.na and b.vec_id=a.vec_id+c.nd and n.vec_id=(a.vec_id*7+j.j*31+11)%c.nd
    and (j.j>=3 or a.vec_id%10<>9)),
q as (select q_id, case when j<3 then 'train' when j=3 then 'dev' else 'test' end split,
  list_transform(u, lambda x: x/greatest(sqrt(list_sum(list_transform(u, lambda y: y*y))),1e-12)) qv from raw),
g as (select a.vec_id d, j.j j, a.vec_id*5+j.j q_id, (a.vec_id*7+j.j*31+11)%c.nd o, c.na+(a.vec_id*3)%(c.nd-c.na) z
  from e a, c, (values (0),(1),(2),(3),(4)) j(j)
  where a.vec_id<c.na and (j.j>=3 or a.vec_id%10<>9)),
judg as (select q_id, d record_id, 2 rel from g
  union all select q_id, o, 1 from g where j%2=0 and o<>d
  union all select q_id, z, 1 from g where j=1 and d%7=3)"""
