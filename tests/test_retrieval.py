import numpy as np
import pytest

from lodestar.operators import retrieval as RET
from tests.helpers import brute_topk, rows, vec_df


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    Q = rng.normal(size=(37, 8))
    D = rng.normal(size=(211, 8))
    D[50] = D[10]            # exact duplicate -> exact tie, broken by id
    D[77] = 3.0 * D[10]      # same direction: tie under cosine only
    return Q, D


@pytest.mark.parametrize("metric", ["cos", "dot"])
@pytest.mark.parametrize("parts", [1, 3, 8])
def test_topk_matches_bruteforce_any_partitioning(spark, data, metric, parts):
    Q, D = data
    q = vec_df(spark, range(len(Q)), Q, "q_id")
    d = vec_df(spark, range(len(D)), D).repartition(parts)
    got = rows(RET.topk(q, d, 7, metric), ["q_id", "rank", "record_id", "score"])
    want = brute_topk(Q, D, 7, metric == "cos")
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want])


def test_large_query_sets_in_turn(spark, data):
    Q, D = data
    q = vec_df(spark, range(len(Q)), Q, "q_id")
    d = RET._corpus_frame(vec_df(spark, range(len(D)), D), True)
    b = rows(RET.final_topk(RET.partial_topk(q, d, 5), 5), ["q_id", "rank", "record_id"])
    for cap, fraction in ((1000, 1 / 16), (1000, 1e-9), (700, 0.9)):
        a = rows(RET.final_topk(RET._topk_in_turn(q, d, 5, cap, fraction), 5), ["q_id", "rank", "record_id"])
        assert a == b


def test_oversized_query_block_goes_in_turn(spark, data):
    Q, D = data
    q = vec_df(spark, range(len(Q)), Q, "q_id")
    d = vec_df(spark, range(len(D)), D)
    small = rows(RET.topk(q, d, 3, cap=64), ["q_id", "rank", "record_id"])
    want = [w[:3] for w in brute_topk(Q, D, 3)]
    assert small == want


def test_chunks_are_under_the_cap(spark, data):
    Q, _ = data
    q = vec_df(spark, [5] * 20 + list(range(17)), Q, "q_id")         # a repeated id spans chunks
    for cap, most in ((64, 1), (130, 2), (640, 10), (2368, 37)):
        chunks = RET.broadcast_chunks(q, "q_id", cap=cap)
        assert [c.count() for c, _ in chunks] == [s[0] for _, s in chunks] and max(s[0] for _, s in chunks) == most
        assert sorted(r.q_id for c, _ in chunks for r in c.collect()) == sorted([5] * 20 + list(range(17)))


def test_scans_of_large_query_sets_shuffle_no_documents(spark, data, monkeypatch):
    Q, D = data
    plans, released = [], []
    keep = RET.final_topk
    monkeypatch.setattr(RET, "final_topk", lambda part, k: plans.append(part._jdf.queryExecution().optimizedPlan().toString()) or keep(part, k))
    made = spark.sparkContext.broadcast
    class Counted:
        def __init__(self, b):
            self.b = b
            released.append(self)
            self.gone = False
        value = property(lambda self: self.b.value)
        def destroy(self):
            self.gone = True
            self.b.destroy()
        def __reduce__(self):
            return self.b.__reduce__()
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda v: Counted(made(v)))
    q, d = vec_df(spark, range(len(Q)), Q, "q_id"), vec_df(spark, range(len(D)), D)
    RET.topk(q, d, 3, cap=800).collect()
    assert plans and all("Repartition" not in p and "Join" not in p for p in plans)
    assert len(released) >= 6 and all(b.gone for b in released)


@pytest.mark.parametrize("scale", [1.0, 1e3])
def test_prefilter_at_large_norms(spark, scale):
    rng = np.random.default_rng(3)
    Q, D = rng.normal(size=(30, 256)) * scale, rng.normal(size=(400, 256)) * scale
    D[100:200] = D[:100]                                             # copies: ties at every floor
    q, d = vec_df(spark, range(30), Q, "q_id"), vec_df(spark, range(400), D).repartition(7)
    plain = rows(RET.topk(q, d, 5, "dot"), ["q_id", "record_id"])
    got = rows(RET.topk(q, d, 5, "dot", prefilter=0.2), ["q_id", "record_id"])
    assert got == plain


def test_two_corpora_and_k_clamp(spark, data):
    Q, D = data
    q = vec_df(spark, range(len(Q)), Q, "q_id")
    a = vec_df(spark, range(0, 5), D[:5])
    b = vec_df(spark, range(5, 9), D[5:9])
    got = rows(RET.topk(q, a, 50, "dot", untouched=b), ["q_id", "rank", "record_id"])
    # tuned part by dot, untouched by cosine, merged
    Dn = D[5:9] / np.linalg.norm(D[5:9], axis=1, keepdims=True)
    S = np.round(np.concatenate([Q @ D[:5].T, Q @ Dn.T], axis=1), 12)
    ids = np.arange(9)
    want = []
    for i in range(len(Q)):
        o = np.lexsort((ids, -S[i]))
        want += [(i, r, int(ids[j])) for r, j in enumerate(o)]
    assert got == sorted(want)          # only 9 docs: k clamps to 9


def test_best_document_and_scores(spark, data):
    Q, D = data
    q = vec_df(spark, range(len(Q)), Q, "q_id")
    d = vec_df(spark, range(len(D)), D)
    t1 = rows(RET.top1(q, d), ["q_id", "record_id"])
    assert t1 == [w[:1] + w[2:3] for w in brute_topk(Q, D, 1)]
    assert RET.topk_scores(q, d, 2).columns == ["q_id", "rank", "score"]


def test_bad_metric(spark, data):
    Q, D = data
    with pytest.raises(ValueError):
        RET.topk(vec_df(spark, [0], Q[:1], "q_id"), vec_df(spark, [0], D[:1]), 1, "l2")


def test_plan_pushes_filter_and_limit(spark, fx):
    top = RET.topk(fx.split("test"), fx.corpus, 10)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan
    opt = top._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in opt


def test_query_matrix_equals_dataframe_hook(spark, data):
    from lodestar.operators.adapter import apply_adapter
    Q, D = data
    W = np.eye(8) + 0.1 * np.arange(64).reshape(8, 8) / 64
    q = vec_df(spark, range(len(Q)), Q, "q_id")
    d = vec_df(spark, range(len(D)), D)
    a = rows(RET.topk(q, d, 4, query_matrix=W), ["q_id", "rank", "record_id"])
    b = rows(RET.topk(q, d, 4, query_transform=lambda x: apply_adapter(x, W)), ["q_id", "rank", "record_id"])
    c = rows(RET.topk(q, d, 4, query_matrix=W, cap=64), ["q_id", "rank", "record_id"])
    assert a == b == c == [w[:3] for w in brute_topk(Q @ W.T, D, 4)]


@pytest.mark.parametrize("fraction", [0.001, 0.05, 0.3])
def test_prefilter_is_exact_and_cuts_candidates(spark, data, fraction):
    Q, D = data
    q = vec_df(spark, range(len(Q)), Q, "q_id")
    d = vec_df(spark, range(len(D)), D).repartition(8)
    got = rows(RET.topk(q, d, 5, prefilter=fraction), ["q_id", "rank", "record_id"])
    assert got == [w[:3] for w in brute_topk(Q, D, 5)]
    c = RET._corpus_frame(d, True)
    full = RET.partial_topk(q, c, 5).count()
    cut = RET.partial_topk(q, c, 5, prefilter=fraction).count()
    assert cut - 5 * len(Q) <= full                                  # the first part's rows stay
