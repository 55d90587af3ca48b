"""The scans over a broadcast block hold one tile of scores, however large the block is."""
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from lodestar.functions.vectors import matrix_to_list, np_normalize
from lodestar.operators import retrieval as RET
from lodestar.operators import tune as TUNE
from lodestar.operators.topk_kernel import fold_topk, merge_topk, round_scores

TILE = 512 * 1024
R = np.random.default_rng(5)


def _watched(monkeypatch, module):
    sizes = []
    plain = module.block_scores

    def scores(Q, D):
        sizes.append(len(Q) * len(D))
        return plain(Q, D)
    monkeypatch.setattr(module, "block_scores", scores)
    return sizes


def _value(*v):
    return SimpleNamespace(value=v[0] if len(v) == 1 else v)


def test_topk_of_a_large_block_is_scored_in_tiles(monkeypatch):
    sizes = _watched(monkeypatch, RET)
    Q, D = R.normal(size=(3000, 8)), np_normalize(R.normal(size=(2500, 8)))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(2500)), matrix_to_list(D), pa.array([False] * 2500)], names=["r", "e", "c"])
    got = pa.Table.from_batches(list(RET._scan_topk_fn(_value(RET.QueryBlock(np.arange(3000), Q)), 3)([batch])))
    S = round_scores(Q @ D.T)
    want = np.argsort(-S, axis=1, kind="stable")[:, :3]
    assert max(sizes) <= TILE
    assert (got.column("record_id").to_numpy().reshape(3000, 3) == want).all()
    assert np.allclose(got.column("score").to_numpy().reshape(3000, 3), np.take_along_axis(S, want, 1))


def test_folded_blocks_equal_merged_ones():
    state, folded = None, None
    for n in (7, 40, 200, 3):
        S = R.integers(-3, 4, size=(30, n)) / 7 + R.choice([0, 4e-13], size=(30, n))
        S[R.random(S.shape) < 0.05] = np.nan
        S[5] = -1.0
        ids = R.permutation(10 * n)[:n] + 1000 * n
        state = merge_topk(state, round_scores(S), np.broadcast_to(ids, S.shape), 4)
        folded = fold_topk(folded, S, ids, 4)
        assert np.array_equal(state[0], folded[0], equal_nan=True) and (state[1] == folded[1])[~np.isnan(state[0])].all()


def test_intervals_of_many_pairs_are_scored_in_tiles(monkeypatch):
    sizes = _watched(monkeypatch, TUNE)
    n = 2600
    Q, V, U = R.normal(size=(n, 8)), np_normalize(R.normal(size=(1500, 8))), np_normalize(R.normal(size=(1500, 8)))
    x = np.arange(n) % 1500
    s, g = round_scores((Q * V[x]).sum(1)), round_scores(-(Q * U[x]).sum(1))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(1500)), matrix_to_list(V), matrix_to_list(U)], names=["r", "v", "u"])
    got = next(TUNE._interval_scan_fn(_value(np.arange(n), np.arange(n), x, Q, s, g))([batch]))
    ds, dg = round_scores(Q @ V.T) - s[:, None], round_scores(-(Q @ U.T)) - g[:, None]
    other = np.arange(1500)[None] != x[:, None]
    low = np.where(other & (dg > 0), ds / (dg + TUNE.M_EPS), -np.inf).max(axis=1)
    assert max(sizes) <= TILE
    assert np.allclose(got.column("low").to_numpy(), np.maximum(low, 0), rtol=1e-3)


@pytest.mark.parametrize("val_k", [1, 3])
def test_documents_before_an_answer_are_counted_from_few_scored_pairs(monkeypatch, val_k):
    scored = [0]
    plain = TUNE._row_dots

    def dots(a, b):
        scored[0] += len(a)
        return plain(a, b)
    monkeypatch.setattr(TUNE, "_row_dots", dots)
    n, m, gammas = 700, 1500, TUNE.GAMMA_GRID
    V = np_normalize(R.normal(size=(m, 32)))
    C = R.normal(size=(m, 32)) + 3 * V
    none = np.arange(m) % 4 == 0
    x = np.arange(n) * 2
    Q = np_normalize(V[x] + 0.1 * R.normal(size=(n, 32)))
    vtc, ctc = np.where(none, 0, (V * C).sum(1)), np.where(none, 0, (C * C).sum(1))
    C0 = np.where(none[:, None], 0, C)
    every = [round_scores((Q @ V.T) * a + (Q @ C0.T) * b) for a, b in (TUNE._n_coeffs_np(g, vtc, ctc) for g in gammas)]
    bars = np.stack([s[np.arange(n), x] for s in every])
    c = pa.array([None if z else list(r) for z, r in zip(none, C)], pa.list_(pa.float64()))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(m)), matrix_to_list(V), c, pa.array(vtc), pa.array(ctc)], names=list("rvcst"))
    out = list(TUNE._ahead_scan_fn(_value(np.arange(n), x, Q, bars), gammas, val_k)([batch]))
    got = np.zeros((n, len(gammas)), dtype=int)
    for b in out:
        got[b.column("pair").to_numpy()] = np.array(b.column("ahead").to_pylist())
    rid = np.arange(m)[None]
    want = np.stack([((s > bar[:, None] + 1e-11) & (rid != x[:, None])).sum(1) for s, bar in zip(every, bars)], axis=1)
    assert (np.minimum(got, val_k) == np.minimum(want, val_k)).all() and 0 < (want > 0).sum() < want.size
    assert scored[0] < n * m / 2 and sum(b.num_rows for b in out) <= n


def test_repeated_records_and_competitors_count_by_rank(spark):
    e = lambda *rows: spark.createDataFrame([(i, [float(a), float(b)]) for i, a, b in rows], "record_id long, embedding array<double>")
    corpus = e((1, 1, 0), (1, 1, 0), (2, 0.8, 0.6), (3, 0, 1), (4, -1, 0)).unionByName(
        spark.createDataFrame([(9, None)], "record_id long, embedding array<double>"))
    q = spark.createDataFrame([(7, [1.0, 0.1]), (8, [0.0, 1.0]), (6, [1.0, 0.0])], "q_id long, embedding array<double>")
    judged = spark.createDataFrame([(7, 2, 1), (8, 3, 1), (6, 1, 1), (6, 4, 1), (8, 50, 1)], "q_id long, record_id long, rel int")
    none = spark.createDataFrame([], "q_id long, record_id long, rel int")
    stats = TUNE.n_stats(TUNE.doc_directions(corpus, TUNE.QuerySet(q, none)))
    acc = {(k, p): TUNE.n_accuracy_grid(stats, TUNE.QuerySet(q, judged), e((5, 0, 1)) if p else None, val_k=k, gammas=[0.0, 0.1],
                                        prefilter=p).select("acc", "n_dev").collect() for k in (1, 2, 3) for p in (None, 0.5)}
    # query 7 has both rows of 1 before 2; 8 answers 3 and one that doesn't exist; 6 answers 1 twice, of at most 2
    assert {k: [tuple(r) for r in v] for k, v in acc.items()} == {
        (k, p): [(pytest.approx(a), 3)] * 2 for k, a in ((1, 2 / 3), (2, 0.5), (3, 1.5 / 3 + 1 / 3)) for p in (None, 0.5)}
