import math

import numpy as np
import pytest

from lodestar.operators import metrics as MET


def py_metrics(metrics, preds, truth, rels):
    """Direct transcription of the published formulas (reference semantics)."""
    out = []
    ordered = sorted(rels.values(), reverse=True)
    for t, k in metrics:
        if t == "recall":
            hits = {p for p in preds[:k] if p in truth}
            out.append(len(hits) / min(len(truth), k))
        else:
            ideal = sum(r / math.log2(i + 2) for i, r in enumerate(ordered[:k]))
            dcg = sum(rels.get(p, 0) / math.log2(i + 2) for i, p in enumerate(preds[:k]))
            out.append(dcg / ideal)
    return out


@pytest.mark.parametrize("graded", [True, False])
def test_metrics_match_formulas(spark, graded):
    rng = np.random.default_rng(0)
    top, judg, want = [], [], []
    ms = [("recall", 1), ("recall", 3), ("recall", 10), ("ndcg", 1), ("ndcg", 3), ("ndcg", 10)]
    for q in range(30):
        n_res = int(rng.integers(2, 12))        # sometimes fewer than k results
        preds = list(rng.choice(40, n_res, replace=False))
        truth = list(rng.choice(40, int(rng.integers(1, 6)), replace=False))
        rels = {int(t): int(rng.integers(1, 4)) if graded else 1 for t in truth}
        top += [(q, r, int(p), 1.0 - r / 100) for r, p in enumerate(preds)]
        judg += [(q, int(t), rels[int(t)]) for t in truth]
        want.append(py_metrics(ms, [int(p) for p in preds] + [-1] * 10, set(rels), rels))
    tdf = spark.createDataFrame(top, "q_id long, rank int, record_id long, score double")
    jdf = spark.createDataFrame(judg, "q_id long, record_id long, rel int")
    qdf = spark.createDataFrame([(q,) for q in range(30)], "q_id long")
    got = MET.per_query(tdf, jdf, qdf, ms).orderBy("q_id").collect()
    for q, r in enumerate(got):
        assert [r[f"{t}_{k}"] for t, k in ms] == pytest.approx(want[q])
    ev = MET.evaluate(tdf, jdf, qdf, ms).first()
    assert ev["recall_10"] == pytest.approx(np.mean([w[2] for w in want]))


def test_unjudged_queries_excluded_and_bounds(spark):
    tdf = spark.createDataFrame([(1, 0, 5, 1.0), (2, 0, 6, 1.0)], "q_id long, rank int, record_id long, score double")
    jdf = spark.createDataFrame([(1, 5, 1)], "q_id long, record_id long, rel int")
    qdf = spark.createDataFrame([(1,), (2,)], "q_id long")
    r = MET.evaluate(tdf, jdf, qdf, [("recall", 1), ("ndcg", 1)]).first()
    assert r["n_queries"] == 1 and r["recall_1"] == 1.0 and 0 <= r["ndcg_1"] <= 1


def test_unknown_metric(spark):
    with pytest.raises(ValueError):
        MET.check_metrics([("map", 10)])


def test_hit_at_1_counts_unjudged_best_as_miss(spark):
    best = spark.createDataFrame([(1, 5, 0.9), (2, 99, 0.8)], "q_id long, record_id long, score double")
    j = spark.createDataFrame([(1, 5, 1), (2, 7, 1)], "q_id long, record_id long, rel int")
    q = spark.createDataFrame([(1,), (2,)], "q_id long")
    assert MET.hit_at_1(best, j, q).first()["hit_at_1"] == 0.5


def test_all_zero_grades_give_null_ndcg(spark):
    """Graded split where a query's grades are all 0: ideal DCG is 0, so nDCG
    is null (not NaN); recall still counts rel-0 judged docs as answers."""
    tdf = spark.createDataFrame([(1, 0, 5, 1.0), (2, 0, 7, 1.0)], "q_id long, rank int, record_id long, score double")
    jdf = spark.createDataFrame([(1, 5, 0), (2, 7, 2)], "q_id long, record_id long, rel int")
    qdf = spark.createDataFrame([(1,), (2,)], "q_id long")
    r = {x["q_id"]: x for x in MET.per_query(tdf, jdf, qdf, [("recall", 1), ("ndcg", 1)]).collect()}
    assert r[1]["ndcg_1"] is None and r[1]["recall_1"] == 1.0
    assert r[2]["ndcg_1"] == 1.0
