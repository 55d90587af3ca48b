"""Retrieval metrics (M1-M4).

recall@k = |top-k ∩ truth| / min(|truth|, k)
nDCG@k   = Σ_{rank<k} g / log2(rank+2)  ÷  the same over the grades sorted
           descending (0-based rank; g = graded relevance if the split is
           graded, else 1).
Queries are the judged query set; a query with fewer than k results simply
gets 0 for the missing ranks.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRIC_TYPES = ("recall", "ndcg")
# fixed values: the metric list used for the method report
DEFAULT_METRICS = [("recall", 1), ("recall", 5), ("recall", 10), ("recall", 20), ("recall", 40),
                   ("ndcg", 1), ("ndcg", 5), ("ndcg", 10), ("ndcg", 20), ("ndcg", 40)]


def check_metrics(metrics) -> list[tuple[str, int]]:
    out = []
    for t, k in metrics:
        if t not in METRIC_TYPES:
            raise ValueError(f"unknown metric {t!r}")
        if int(k) < 1:
            raise ValueError("k must be >= 1")
        out.append((t, int(k)))
    return out


def has_grades(judgments: DataFrame) -> bool:
    """Grades count only if some rel > 1 in this split."""
    r = judgments.agg(F.max("rel").alias("m")).first()["m"]
    return r is not None and r > 1


def graded(judgments: DataFrame, with_rels: bool | None = None) -> DataFrame:
    """(q_id, record_id, g) with one row per judged pair."""
    if with_rels is None:
        with_rels = has_grades(judgments)
    g = F.col("rel").cast("double") if with_rels else F.lit(1.0)
    return (judgments.groupBy("q_id", "record_id").agg(F.max("rel").alias("rel"))
            .select("q_id", "record_id", g.alias("g")))


def per_query(top: DataFrame, judgments: DataFrame, queries: DataFrame,
              metrics=(("recall", 10), ("ndcg", 10)), with_rels: bool | None = None) -> DataFrame:
    """One row per judged query with one column per (metric, k)."""
    metrics = check_metrics(metrics)
    max_k = max(k for _, k in metrics)
    j = graded(judgments, with_rels)
    n_true = j.groupBy("q_id").agg(F.count(F.lit(1)).alias("n_true"))
    hits = (top.filter(F.col("rank") < max_k).select("q_id", "record_id", "rank")
            .join(j, ["q_id", "record_id"], "inner"))
    disc = F.lit(1.0) / F.log2(F.col("rank") + 2)
    hit_aggs, ideal_aggs = [], []
    for t, k in metrics:
        if t == "recall":
            hit_aggs.append(F.sum(F.when(F.col("rank") < k, 1).otherwise(0)).alias(f"h_{t}_{k}"))
        else:
            hit_aggs.append(F.sum(F.when(F.col("rank") < k, F.col("g") * disc)
                                  .otherwise(0.0)).alias(f"h_{t}_{k}"))
            ideal_aggs.append(F.sum(F.when(F.col("rank") < k, F.col("g") * disc)
                                    .otherwise(0.0)).alias(f"i_{t}_{k}"))
    hq = hits.groupBy("q_id").agg(*hit_aggs)
    base = (queries.select("q_id").join(j.select("q_id").distinct(), "q_id", "left_semi")
            .join(n_true, "q_id", "left").join(hq, "q_id", "left"))
    if ideal_aggs:
        # ideal ordering: grades descending; the limit is pushed below the shuffle
        w = Window.partitionBy("q_id").orderBy(F.col("g").desc(), F.col("record_id"))
        ideal = (j.withColumn("rank", F.row_number().over(w) - 1)
                 .filter(F.col("rank") < max_k).groupBy("q_id").agg(*ideal_aggs))
        base = base.join(ideal, "q_id", "left")
    cols = [F.col("q_id")]
    for t, k in metrics:
        h = F.coalesce(F.col(f"h_{t}_{k}"), F.lit(0))
        if t == "recall":
            v = h / F.least(F.col("n_true"), F.lit(k))
        else:
            v = F.try_divide(h.cast("double"), F.col(f"i_{t}_{k}"))
        cols.append(v.cast("double").alias(f"{t}_{k}"))
    return base.select(*cols)


def evaluate(top: DataFrame, judgments: DataFrame, queries: DataFrame,
             metrics=(("recall", 10), ("ndcg", 10)), with_rels: bool | None = None) -> DataFrame:
    """M3: metric means over all judged queries -> one row."""
    metrics = check_metrics(metrics)
    pq = per_query(top, judgments, queries, metrics, with_rels)
    return pq.agg(*[F.avg(f"{t}_{k}").alias(f"{t}_{k}") for t, k in metrics],
                  F.count(F.lit(1)).alias("n_queries"))


def hit_at_1(best: DataFrame, judgments: DataFrame, queries: DataFrame) -> DataFrame:
    """M4: share of queries whose best document is judged relevant; records
    outside the judged set (e.g. the untouched corpus) count as misses."""
    j = judgments.select("q_id", "record_id").distinct().withColumn("hit", F.lit(1))
    q = queries.select("q_id").join(judgments.select("q_id").distinct(), "q_id", "left_semi")
    r = (q.join(best.select("q_id", "record_id"), "q_id", "left")
         .join(j, ["q_id", "record_id"], "left"))
    return r.agg(F.avg(F.coalesce(F.col("hit"), F.lit(0)).cast("double")).alias("hit_at_1"),
                 F.count(F.lit(1)).alias("n_queries"))
