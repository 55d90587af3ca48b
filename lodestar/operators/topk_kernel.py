"""numpy kernels shared by the block scans (exact top-k under a total order).

Order everywhere: score descending, then record id ascending, after scores
are rounded to ``SCORE_DECIMALS`` places, so results do not depend on block
shapes or on the partitioning of the corpus.
"""
from __future__ import annotations

import numpy as np

SCORE_DECIMALS = 12  # fixed value: rounding of scores before ranking
ROWS = 64                     # block_scores pads both sides to a multiple
# a task scores blocks of so many queries and documents, whatever the query block's size
TILE_ROWS = 8 * ROWS
TILE_DOCS = 16 * ROWS


def tiles(n: int, step: int) -> list[slice]:
    return [slice(i, min(n, i + step)) for i in range(0, n, step)]


def _padded(m: np.ndarray) -> np.ndarray:
    more = -len(m) % ROWS
    return np.concatenate([m, np.zeros((more, m.shape[1]))]) if more else m


def block_scores(Q: np.ndarray, D: np.ndarray) -> np.ndarray:
    """``Q @ D.T`` with both sides padded to whole kernel tiles, so that a product
    does not depend on how many rows stand beside it (edge tiles sum in another
    order, which rounding hides only while norms are near 1)."""
    return (_padded(Q) @ _padded(D).T)[:len(Q), :len(D)]


def round_scores(s: np.ndarray) -> np.ndarray:
    return np.round(s, SCORE_DECIMALS)


def _sort_rows(S: np.ndarray, I: np.ndarray):
    o = np.lexsort((I, -S), axis=-1)
    return np.take_along_axis(S, o, -1), np.take_along_axis(I, o, -1)


def select_topk(S: np.ndarray, I: np.ndarray, k: int):
    """Exact per-row top-k of (S, I) by (S desc, I asc); rows sorted."""
    m = S.shape[1]
    if m > k:
        part = np.argpartition(-S, k - 1, axis=1)[:, :k]
        Sk = np.take_along_axis(S, part, 1)
        Ik = np.take_along_axis(I, part, 1)
        t = Sk.min(axis=1, keepdims=True)
        # a tie straddling the cut: fix those rows exactly (rare)
        bad = np.nonzero((S == t).sum(1) != (Sk == t).sum(1))[0]
        for r in bad:
            o = np.lexsort((I[r], -S[r]))[:k]
            Sk[r] = S[r, o]
            Ik[r] = I[r, o]
        S, I = Sk, Ik
    return _sort_rows(S, I)


def merge_topk(state, S: np.ndarray, I: np.ndarray, k: int):
    """Fold a new score block into a running per-row top-k."""
    if state is not None:
        S = np.concatenate([state[0], S], axis=1)
        I = np.concatenate([state[1], I], axis=1)
    return select_topk(S, I, k)


def fold_topk(state, S: np.ndarray, ids: np.ndarray, k: int):
    """``merge_topk`` of a block of unrounded scores (documents ``ids``): once there are
    k rows, only scores that can reach the k-th are rounded and sorted in."""
    if state is None or state[0].shape[1] < k:
        return merge_topk(state, round_scores(S), np.broadcast_to(ids, S.shape), k)
    Sk, Ik = state
    low = Sk[:, -1]
    with np.errstate(invalid="ignore"):
        bar = low - (10.0 ** -SCORE_DECIMALS + 1e-15 * np.abs(low))
        at = np.flatnonzero(~(S < bar[:, None]))               # what can't be compared counts
    if len(at) == 0:
        return state
    if len(at) > S.size // 8:
        return merge_topk(state, round_scores(S), np.broadcast_to(ids, S.shape), k)
    r, c = np.divmod(at, S.shape[1])
    rows = r[np.concatenate([[True], r[1:] != r[:-1]])]
    every = np.concatenate([np.repeat(rows, k), r])
    score = np.concatenate([Sk[rows].reshape(-1), round_scores(S[r, c])])
    doc = np.concatenate([Ik[rows].reshape(-1), ids[c]])
    o = np.lexsort((doc, -score, every))
    first = o[np.searchsorted(every[o], rows)[:, None] + np.arange(k)]
    Sk[rows], Ik[rows] = score[first], doc[first]
    return Sk, Ik
