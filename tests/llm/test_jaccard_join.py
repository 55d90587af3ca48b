import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from lodestar.llm import jaccard_join as J
from lodestar.llm.components import components

SCHEMA = "doc_id long, text string"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    least = {i: i for i in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x
    for a, b in itertools.combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            least[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed, groups=12, size=14):
    r = random.Random(seed)
    word = lambda: f"w{r.randint(0, 400)}"
    shared = [word() for _ in range(30)]
    rows, i = [], 0
    for _ in range(groups):
        base = [word() for _ in range(r.randint(3, 90))]
        if r.random() < 0.5:
            base += shared
        for _ in range(r.randint(1, size)):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = word()
            if r.random() < 0.3:
                w += [word() for _ in range(r.randint(1, 15))]
            rows.append((i, " ".join(w)))
            i += r.randint(1, 3)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_POINTS", 5)
    monkeypatch.setattr(J, "FREQUENT", 3)
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_edges(spark):
    rows = [(5, None), (3, ""), (9, " \n"), (7, "one two"), (2, "ONE  two"), (2, "ONE  two"), (None, "one two"), (4, "é " * 3000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as point", "1 as component_id", "2 as n_shingles")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 0, 5), (3, 0, 3), (9, 0, 9), (7, 1, 2), (2, 1, 2), (2, 1, 2), (None, 1, None), (4, 1, 4)], key=str)
    kept = J.keep_one_of_each(df)
    assert kept.columns == df.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [2, 2, 3, 4, 5, 9, None]
    assert J.near_duplicates(df.limit(0)).collect() == []


def test_anchor_regions_across_batches():
    r = random.Random(3)
    rows = sorted((r.randint(0, 4), n := r.randint(1, 60), n + r.randint(-3, 12), r.randint(0, 99)) for _ in range(300))
    rows = sorted({(a, n, m, p) for a, n, m, p in rows}, key=lambda x: (x[0], x[1], x[3]))
    want, at, pivot, reach = set(), None, None, None
    for a, n, m, p in rows:
        if a != at or reach < n:
            pivot = p
        elif p != pivot:
            want |= {(pivot, p), (pivot, pivot)}
        reach = m if a != at else max(reach, m)
        at = a
    for step in (1, 7, 300):
        got = set()
        for b in J._met(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i:i + step])], names=list("asmp"))
                        for i in range(0, len(rows), step)):
            got |= set(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        assert got == want


def test_partner_limit_is_safe():
    for n in range(1, 60):
        limit = J.partner_limit(n)
        assert len(limit) == J.window_length(n)
        for rank, most in enumerate(limit):
            for m in range(1, 100):
                fits = any(100 * c >= 75 * (n + m - c) for c in range(1, min(n - rank, m) + 1))
                assert not fits or m <= most


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 120), (7, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 99: 99, 100: 99, 120: 99}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_region_links_cover_every_component():
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 60, 40).astype(np.uint64)) for _ in range(80)]
    docs = list(range(80))
    link = {frozenset(x) for x in J.region_links(docs, sets)}
    true = {frozenset((a, b)) for a, b in itertools.combinations(docs, 2)
            if 100 * (n := len(np.intersect1d(sets[a], sets[b]))) >= 75 * (len(sets[a]) + len(sets[b]) - n)}
    assert link <= true

    def comps(edges):
        least = {i: i for i in docs}
        for _ in docs:
            for e in edges:
                a, b = tuple(e)
                least[a] = least[b] = min(least[a], least[b])
        return least
    assert comps(link) == comps(true)
