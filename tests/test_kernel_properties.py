"""Property tests (hypothesis) for the exact top-k kernels: any block split and
any tie pattern gives the lexsort answer (score desc, id asc)."""
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.operators.topk_kernel import merge_topk, select_topk


def brute(S, I, k):
    o = np.lexsort((I, -S), axis=-1)[:, :k]
    return np.take_along_axis(S, o, 1), np.take_along_axis(I, o, 1)


@settings(max_examples=200, deadline=None)
@given(rows=st.integers(1, 5), cols=st.integers(1, 40), k=st.integers(1, 12),
       levels=st.integers(1, 4), seed=st.integers(0, 10 ** 6), cuts=st.integers(1, 5))
def test_running_topk_equals_full_sort(rows, cols, k, levels, seed, cuts):
    rng = np.random.default_rng(seed)
    S = rng.integers(0, levels, size=(rows, cols)).astype(float)     # few levels: many ties
    ids = rng.permutation(cols).astype(np.int64)
    I = np.broadcast_to(ids, S.shape)
    state = None
    bounds = np.linspace(0, cols, cuts + 1).astype(int)
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b > a:
            state = merge_topk(state, S[:, a:b], I[:, a:b], k)
    ws, wi = brute(S, np.ascontiguousarray(I), k)
    assert np.array_equal(state[0], ws) and np.array_equal(state[1], wi)
    ss, si = select_topk(S, np.ascontiguousarray(I), k)
    assert np.array_equal(si, wi)
