"""Properties of the tuners and numpy brute force."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import tune as TUNE


def _np(df, col="embedding"):
    r = sorted((x["record_id"], x[col]) for x in df.collect())
    return np.array([a for a, _ in r]), np.array([b for _, b in r], dtype=float)


@pytest.fixture(scope="module")
def sets(fx):
    return (TUNE.QuerySet(fx.split("train"), fx.judged("train")),
            TUNE.QuerySet(fx.split("dev"), fx.judged("dev")))


@pytest.fixture(scope="module")
def tuned_n(fx, sets):
    return TUNE.tune_n(fx.corpus, *sets)


def test_n_expected_gamma_and_accuracy(tuned_n):
    g = {r["gamma"]: r["acc"] for r in tuned_n.diagnostics.collect()}
    assert tuned_n.gamma == pytest.approx(0.42)
    assert g[0.0] == pytest.approx(0.365) and max(g.values()) == pytest.approx(0.925)


def test_n_unit_norm_and_step_length(fx, sets, tuned_n):
    """Unit norm, ||v'-v||² = γ for updated unsnapped docs, docs
    without train queries unchanged, snapped docs equal normalize(c)."""
    ids, new = _np(tuned_n.embeddings)
    assert np.allclose(np.linalg.norm(new, axis=1), 1.0)
    st = TUNE.n_stats(TUNE.doc_directions(fx.corpus, sets[0])).collect()
    st = {r["record_id"]: r for r in st}
    g = tuned_n.gamma
    for i, rid in enumerate(ids):
        r = st[rid]
        v = np.array(r["v"])
        if r["c"] is None:
            assert np.allclose(new[i], v)
            continue
        c = np.array(r["c"])
        chat = c / np.linalg.norm(c)
        if r["vTc"] / np.linalg.norm(c) >= 1 - g / 2:
            assert np.allclose(new[i], chat)
        elif r["no_update"]:
            assert np.allclose(new[i], v)
        else:
            assert np.sum((new[i] - v) ** 2) == pytest.approx(g)


def test_n_closed_form_matches_numpy_formula(fx, sets):
    stats = TUNE.n_stats(TUNE.doc_directions(fx.corpus, sets[0]))
    ids, new = _np(TUNE.n_apply(stats, 0.3))
    st = {r["record_id"]: r for r in stats.collect()}
    g = 0.3
    for i, rid in enumerate(ids):
        r = st[rid]
        v = np.array(r["v"])
        if r["c"] is None:
            continue
        c = np.array(r["c"])
        vtc, ctc = v @ c, c @ c
        if vtc / np.sqrt(ctc) >= 1 - g / 2:
            want = c / np.sqrt(ctc)
        elif ctc - vtc ** 2 <= 1e-12 or vtc < 0:
            want = v
        else:     # literal form: mu, delta
            mu = vtc + np.sqrt(g / (4 - g) * (ctc - vtc ** 2))
            want = v + g * (c - mu * v) / (2 * (mu - vtc))
        assert np.allclose(new[i], want, atol=1e-12)


def test_equivalence_untouched_split(fx, sets, tuned_n):
    """Answerable part + untouched competitors == whole corpus."""
    ids = fx.queries.filter(F.col("split").isin("train", "dev")).select("q_id")
    ans = fx.judgments.join(ids, "q_id", "left_semi").select("record_id").distinct()
    part = fx.corpus.join(ans, "record_id", "left_semi")
    rest = fx.corpus.join(ans, "record_id", "left_anti")
    r = TUNE.tune_n(part, *sets, untouched=rest)
    assert r.gamma == tuned_n.gamma
    a_ids, a = _np(r.embeddings)
    w_ids, w = _np(tuned_n.embeddings)
    keep = np.isin(w_ids, a_ids)
    assert np.array_equal(a_ids, w_ids[keep]) and np.allclose(a, w[keep])


def test_n_fixed_gamma_and_range(fx, sets):
    r = TUNE.tune_n(fx.corpus, *sets, gamma=0.0)
    ids, new = _np(r.embeddings)
    _, old = _np(fx.corpus)
    assert np.allclose(new, old / np.linalg.norm(old, axis=1, keepdims=True))
    with pytest.raises(ValueError):
        TUNE.tune_n(fx.corpus, *sets, gamma=2.5)


def test_m_expected_and_interval_property(fx, sets):
    """P5: γ* lies in exactly `overlap` of the valid half-open intervals."""
    r = TUNE.tune_m(fx.corpus, *sets)
    assert r.gamma == pytest.approx(8.411400, abs=1e-6)
    iv = r.diagnostics.filter("valid").collect()
    assert len(iv) == 191 and r.extra["overlap"] == 188
    inside = sum(1 for x in iv if x["low"] <= r.gamma < x["high"])
    assert inside == r.extra["overlap"]


def test_m_intervals_bruteforce(spark):
    """Hand-made corpus with a duplicate of an answer and a tiny Δg."""
    from tests.helpers import vec_df
    rng = np.random.default_rng(3)
    D = rng.normal(size=(12, 5))
    D[7] = D[2]                          # duplicate of answer 2
    Qtr = rng.normal(size=(6, 5))
    Qdv = rng.normal(size=(4, 5))
    tr = TUNE.QuerySet(vec_df(spark, range(6), Qtr, "q_id"),
                       spark.createDataFrame([(i, i % 5, 1) for i in range(6)], "q_id long, record_id long, rel int"))
    dv = TUNE.QuerySet(vec_df(spark, range(100, 104), Qdv, "q_id"),
                       spark.createDataFrame([(100, 2, 1), (101, 3, 1), (102, 0, 1), (103, 1, 1), (103, 4, 1)],
                                             "q_id long, record_id long, rel int"))
    corpus = vec_df(spark, range(12), D)
    md = TUNE.m_directions(TUNE.doc_directions(corpus, tr))
    got = {(r["q_id"], r["x"]): r for r in TUNE.m_intervals(md, dv).collect()}
    V = D / np.linalg.norm(D, axis=1, keepdims=True)
    C = np.zeros_like(D)
    for i in range(6):
        C[i % 5] += Qtr[i]
    U = np.where(np.linalg.norm(C, axis=1, keepdims=True) > 0,
                 C / np.maximum(np.linalg.norm(C, axis=1, keepdims=True), 1e-12), 0)
    for (q, x), r in got.items():
        qv = Qdv[q - 100]
        S = np.round(V @ qv, 12)
        G = np.round(-(U @ qv), 12)
        ds, dg = S - S[x], G - G[x]
        m = np.arange(12) != x
        al = ds / (dg + 1e-8)
        low = max(0.0, max(al[m & (dg > 0)], default=0.0))
        high = min(1e8, min(al[m & (dg < 0)], default=1e8))
        bad = int(((dg == 0) & (ds > 0) & m).sum())
        assert r["low"] == pytest.approx(low) and r["high"] == pytest.approx(high) and r["bad"] == bad
    assert got[(100, 2)]["bad"] == 0          # the duplicate ties exactly, never beats


def test_sweep_semantics(spark):
    iv = spark.createDataFrame([(1, 0.0, 2.0, 0, True), (2, 1.0, 3.0, 0, True), (3, 2.0, 2.0, 0, True),
                                (4, 1.0, 1.5, 0, True), (5, 0.5, 9.0, 1, False)],
                               "pair_id long, low double, high double, bad long, valid boolean")
    g, n = TUNE.m_best_gamma(TUNE.m_sweep(iv))
    assert (g, n) == (1.0, 3)       # [0,2) [1,3) [1,1.5) overlap at 1; zero-width [2,2) cancels
    empty = iv.filter("pair_id < 0")
    assert TUNE.m_best_gamma(TUNE.m_sweep(empty)) == (0.0, 0)


def test_chunked_broadcast_paths_agree(fx, sets, tuned_n, monkeypatch):
    """Dev queries / dev pairs beyond the broadcast cap go in hash chunks."""
    monkeypatch.setattr(TUNE, "QUERY_BLOCK_CAP", 200 * 64 * 8 // 2)     # ~4 chunks of dev queries
    monkeypatch.setattr(TUNE, "PAIR_BLOCK_CAP", 200 * 64 * 8 // 4)
    r = TUNE.tune_n(fx.corpus, *sets)
    assert r.gamma == tuned_n.gamma
    g1 = sorted((x["g"], x["acc_num"]) for x in r.diagnostics.collect())
    g0 = sorted((x["g"], x["acc_num"]) for x in tuned_n.diagnostics.collect())
    assert g1 == g0
    m = TUNE.tune_m(fx.corpus, *sets)
    assert m.gamma == pytest.approx(8.411400, abs=1e-6) and m.extra["overlap"] == 188


def test_empty_dev_and_null_vectors(spark, fx, sets):
    from tests.helpers import vec_df
    tr, dv = sets
    empty = TUNE.QuerySet(dv.queries.limit(0), dv.judgments.limit(0))
    assert TUNE.tune_n(fx.corpus, tr, empty).gamma == 0.0
    assert TUNE.tune_m(fx.corpus, tr, empty).gamma == 0.0
    from lodestar.operators import retrieval as RET
    c = fx.corpus.unionByName(spark.createDataFrame([(10 ** 6, None)], "record_id long, embedding array<double>"))
    assert RET.topk(dv.queries, c, 3).count() == 3 * 200
    assert RET.topk(dv.queries, fx.corpus.limit(0), 3).count() == 0


def test_return_rest_false_gives_same_retrieval(fx, sets, tuned_n):
    from lodestar.operators import retrieval as RET
    r = TUNE.tune_n(fx.corpus, *sets, gamma=tuned_n.gamma, return_rest=False)
    te = fx.split("test")
    a = sorted(map(tuple, RET.topk(te, r.embeddings, 10, untouched=r.rest).select("q_id", "rank", "record_id").collect()))
    b = sorted(map(tuple, RET.topk(te, tuned_n.embeddings, 10).select("q_id", "rank", "record_id").collect()))
    assert a == b and r.embeddings.count() + r.rest.count() == fx.corpus.count()
    m = TUNE.tune_m(fx.corpus, *sets, gamma=1.5, return_rest=False)
    mw = TUNE.tune_m(fx.corpus, *sets, gamma=1.5)
    a = sorted(map(tuple, RET.topk(te, m.embeddings, 10, "dot", untouched=m.rest).select("q_id", "record_id").collect()))
    b = sorted(map(tuple, RET.topk(te, mw.embeddings, 10, "dot").select("q_id", "record_id").collect()))
    assert a == b


def test_prefilter_keeps_tuning_exact(fx, sets, tuned_n):
    r = TUNE.tune_n(fx.corpus, *sets, prefilter=0.2)
    assert r.gamma == tuned_n.gamma
    g1 = sorted((x["g"], x["acc_num"]) for x in r.diagnostics.collect())
    g0 = sorted((x["g"], x["acc_num"]) for x in tuned_n.diagnostics.collect())
    assert g1 == g0
    m = TUNE.tune_m(fx.corpus, *sets, prefilter=0.2)
    assert m.gamma == pytest.approx(8.411400, abs=1e-6) and m.extra["overlap"] == 188


@pytest.mark.parametrize("fraction", [1e-9, 0.1, 0.9])
def test_intervals_in_two_parts(fx, sets, fraction):
    """The same bounds, and fewer rows out of the tasks."""
    dirs = TUNE.m_directions(TUNE.doc_directions(fx.corpus.repartition(24), sets[0]))
    cols = ["pair_id", "q_id", "x", "low", "high", "bad", "valid"]
    want = sorted(map(tuple, TUNE.m_intervals(dirs, sets[1]).select(*cols).collect()))
    got = sorted(map(tuple, TUNE.m_intervals(dirs, sets[1], prefilter=fraction).select(*cols).collect()))
    assert got == want and len(want) == 200
    if fraction == 0.1:
        pairs = TUNE.m_pairs(dirs, sets[1])
        bc = fx.corpus.sparkSession.sparkContext.broadcast(TUNE._pair_block(pairs))
        rows, _ = TUNE._bounds_in_parts(bc, pairs, dirs.select("record_id", "v", "u"), fraction)
        assert rows.count() < 200 * 24 * 0.8
