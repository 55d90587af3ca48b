"""Physical-plan properties that matter at scale."""
from pyspark.sql import functions as F

from lodestar.operators import retrieval as RET
from lodestar.operators import tune as TUNE


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_topk_does_not_shuffle_the_corpus(spark, fx):
    p = _plan(RET.topk(fx.split("test"), fx.corpus, 10))
    # the only exchange is above the scan (partial top-k rows), none below it
    below = p.split("MapInArrow")[1]
    assert "Exchange" not in below


def test_trained_split_is_a_broadcast_filter(spark, fx):
    tr = TUNE.QuerySet(fx.split("train"), fx.judged("train"))
    part, rest = TUNE.trained_split(fx.corpus, tr)
    assert "BroadcastHashJoin" in _plan(part) and "LeftSemi" in _plan(part)
    assert "BroadcastHashJoin" in _plan(rest) and "LeftAnti" in _plan(rest)


def test_projection_and_filter_reach_the_scan(spark):
    from lodestar.plans.fixture import load_table
    d = load_table(spark, "/root/testdata/sf0.001", "documents")
    q = d.filter(F.col("lang") == "de").select("doc_id")
    p = q._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,de)]" in p
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in p


def test_vector_sum_is_partially_aggregated(spark, fx):
    tr = TUNE.QuerySet(fx.split("train"), fx.judged("train"))
    p = _plan(TUNE.doc_directions(fx.corpus, tr))
    assert p.count("ObjectHashAggregate") >= 2      # partial + final around the exchange


def test_small_key_sets_filter_big_tables_in_place(spark, fx):
    from lodestar.operators import datasets as DS
    p = DS.training_pairs(fx.split("train"), fx.judged("train"), fx.corpus)
    assert "BroadcastHashJoin LeftSemi" in _plan(p).replace("\n", " ") or "LeftSemi" in _plan(p)
    md = TUNE.m_directions(TUNE.doc_directions(fx.corpus, TUNE.QuerySet(fx.split("train"), fx.judged("train"))))
    dv = TUNE.QuerySet(fx.split("dev"), fx.judged("dev"))
    pl = _plan(TUNE.m_pairs(md, dv, untouched=fx.corpus))
    assert "BroadcastHashJoin" in pl and "LeftSemi" in pl


def test_discarded_tables_are_gone(spark):
    import os

    from lodestar.plans.materialize import discard, materialize
    a, b = materialize(spark.range(10), "first"), materialize(spark.range(5), "second")
    folders = [t.inputFiles()[0].replace("file://", "").rsplit("/", 1)[0] for t in (a, b)]
    made = materialize(a.withColumn("x", F.col("id") + 1), "third")
    discard(a)
    assert [os.path.exists(f) for f in folders] == [False, True] and made.count() == 10 and b.count() == 5
