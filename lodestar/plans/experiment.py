"""End-to-end plans: flagship query, method evaluation (M5), the method
matrix (M6) and its report (M7)."""
from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as MET
from ..operators import retrieval as RET
from ..operators import tune as TUNE
from ..operators.adapter import DEFAULTS as ADAPTER_SETTINGS
from ..sources.io import load_processed
from .fixture import build_fixture
from .materialize import materialize

METHODS = ("no_ft", "n", "m")          # the adapter ("adapter") is opt-in: it trains


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = build_fixture(spark, sf_dir)
    tr = TUNE.QuerySet(f.split("train"), f.judged("train"))
    dv = TUNE.QuerySet(f.split("dev"), f.judged("dev"))
    ids = f.queries.filter(F.col("split").isin("train", "dev")).select("q_id")
    ans = f.judgments.join(ids, "q_id", "left_semi").select("record_id").distinct()
    tuned_part, untouched = TUNE.split_by_ids(f.corpus, ans)
    res = TUNE.tune_n(tuned_part, tr, dv, untouched=untouched)
    top = RET.topk(f.split("test"), res.embeddings, 10, "cos", untouched=untouched)
    return (MET.evaluate(top, f.judged("test"), f.split("test"))
            .withColumn("gamma", F.lit(res.gamma)))


@dataclass
class DataSet:
    """What a method is evaluated on: corpus (record_id, embedding), query sets by split
    (``train``, ``dev``, ``test``) and records that compete only, if any."""
    corpus: DataFrame
    sets: dict[str, TUNE.QuerySet]
    untouched: DataFrame | None = None


def fixture_set(spark: SparkSession, sf_dir: str) -> DataSet:
    """The retrieval fixture, written once."""
    f = build_fixture(spark, sf_dir)
    return DataSet(materialize(f.corpus, "set-corpus"), {
        s: TUNE.QuerySet(materialize(f.split(s), f"set-{s}"), materialize(f.judged(s), f"set-{s}-judged")) for s in ("train", "dev", "test")})


def processed_set(spark: SparkSession, root: str, embeddings: DataFrame, query_embeddings: DataFrame) -> DataSet:
    """A published data set with its embeddings: the answerable part is tuned, the rest competes."""
    _, sets, answerable, rest, _ = load_processed(spark, root, embeddings, query_embeddings)
    return DataSet(answerable, sets, rest)


def evaluate_set(data: DataSet, method: str, q_set: str = "set", metrics=None, test_name: str = "baseline",
                 adapter_settings: dict | None = None, config: dict | None = None) -> DataFrame:
    """M5: tune with ``method`` (timed: tuning only), retrieve max-k for the test split,
    return one wide row.  ``config`` (plain values) becomes columns ``config_<key>``."""
    metrics = MET.check_metrics(metrics or MET.DEFAULT_METRICS)
    max_k = max(k for _, k in metrics)
    train, dev, test = (data.sets[s] for s in ("train", "dev", "test"))
    t0 = time.time()
    gamma, W, emb, metric = None, None, data.corpus, "cos"
    if method == "adapter":
        from ..operators import adapter as AD
        from ..operators import datasets as DS
        whole = data.corpus.select("record_id", "embedding")
        if data.untouched is not None:
            whole = whole.unionByName(data.untouched.select("record_id", "embedding"))
        pairs = DS.training_pairs(train.queries, train.judgments, whole)
        W = AD.fit_adapter(pairs, dev.queries, dev.judgments, data.corpus, untouched=data.untouched,
                           **(adapter_settings or ADAPTER_SETTINGS)).W
    elif method in ("n", "m"):
        r = (TUNE.tune_n if method == "n" else TUNE.tune_m)(data.corpus, train, dev, untouched=data.untouched)
        emb, metric, gamma = r.embeddings, "cos" if method == "n" else "dot", r.gamma
    elif method != "no_ft":
        raise ValueError(f"unknown method {method!r}")
    train_time = time.time() - t0
    top = RET.topk(test.queries, emb, max_k, metric, untouched=data.untouched, query_matrix=W)
    row = MET.evaluate(top, test.judgments, test.queries, metrics).drop("n_queries")
    return row.select(F.lit(test_name).alias("test_name"), F.lit(method).alias("finetuner"),
                      F.lit(q_set).alias("q_set"), F.lit(train_time).alias("train_time"),
                      "*", F.lit(gamma).cast("double").alias("gamma"),
                      *[F.lit(v).alias(f"config_{k}") for k, v in (config or {}).items()])


def evaluate_method(spark: SparkSession, sf_dir: str, method: str, q_set: str = "fixture",
                    metrics=None, test_name: str = "baseline", adapter_settings: dict | None = None) -> DataFrame:
    """M5 on the fixture of a folder of tables."""
    return evaluate_set(fixture_set(spark, sf_dir), method, q_set, metrics, test_name, adapter_settings)


def method_matrix(spark: SparkSession, datasets: dict[str, str | DataSet], methods=METHODS, metrics=None,
                  adapter_settings: dict | None = None, config: dict | None = None) -> DataFrame:
    """M6: union of M5 rows for every (data set, method); a data set is a ``DataSet`` or a
    folder of tables that its fixture comes from."""
    rows = None
    for q_set, data in datasets.items():
        data = fixture_set(spark, data) if isinstance(data, str) else data
        for m in methods:
            r = evaluate_set(data, m, q_set, metrics, adapter_settings=adapter_settings, config=config)
            rows = r if rows is None else rows.unionByName(r)
    return rows


def method_report(matrix: DataFrame) -> DataFrame:
    """M7: mean recall@1, recall@10, nDCG@10 per method over datasets (the
    ones the matrix has)."""
    cols = [c for c in ("recall_1", "recall_10", "ndcg_10") if c in matrix.columns]
    return matrix.groupBy("finetuner").agg(*[F.avg(c).alias(c) for c in cols])
