import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestar.llm import collocations as C

R = random.Random(11)
WORDS = ["the", "The", "of", "né", "ß", "x1", "it's", "long-word", "日本", "a\xa0b", "w" * 90, "w" * 89 + "v"]
GAPS = [" "] * 12 + ["  ", "\t", ".", ", ", "\n", "\x0b", "; ", "!", "?", ":", "\r\n", " . "]


def text(n):
    return "".join(R.choice(WORDS) + R.choice(GAPS) for _ in range(n))


ROWS = [(None, None), ("en", ""), ("en", None), ("en", " .\n"), (None, text(60)), ("", text(60)), ("und", text(60)),
        ("en", text(3000)), ("de", text(1500)), ("fr", "one word " * 8)] + [("en", "hot phrase here")] * 40
SCHEMA = "lang string, text string"


def frame(spark, rows=ROWS, parts=5):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as phrase", "1 as n", "2 as words").repartition(parts)


def counts(rows, longest):
    f, total = Counter(), Counter()
    for lang, t in rows:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        for piece in re.split("[.,;:!?\n-\r]", t):
            w = re.findall("[^ \t]+", piece)
            total[lang or "" if lang is not None else "und"] += len(w)
            for n in range(1, longest + 1):
                for i in range(len(w) - n + 1):
                    f[("und" if lang is None else lang, tuple(w[i:i + n]))] += 1
    return f, total


def brute(rows, least=10, longest=3, share=50, top=2000):
    f, total = counts(rows, longest)
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, w), a in found.items():
        if any(g == lang and len(v) > len(w) and 100 * b >= share * a and any(v[i:i + len(w)] == w for i in range(len(v)))
               for (g, v), b in found.items()):
            continue
        score, _, left, right = min((10 ** 6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]])
                                    for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, total[lang], -s)
                  for lang, some in out.items() for i, (s, a, p, left, right) in enumerate(sorted(some)[:top]))


@pytest.mark.parametrize("options", [{}, {"least": 2, "top": 7}, {"least": 4, "longest": 5, "share": 80}, {"longest": 2}])
def test_brute_force(spark, options):
    got = sorted(map(tuple, C.mine(frame(spark), **options).collect()))
    assert got == brute(ROWS, **options) and len(got) > 5


def test_texts_longer_than_a_slice(spark, monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in ROWS]), pa.array([g for g, _ in ROWS])], names=["text", "lang"])
    for size in (1, 10, 300, 10 ** 6):
        monkeypatch.setattr(C, "SLICE", size)
        f, total = Counter(), Counter()
        for texts in C.joined_texts([batch, batch.slice(5, 3), batch.slice(0, 0)]):
            words = C.Words(*texts)
            total.update(words.langs[g] for g in words.lang.tolist())
            for n in (1, 2, 3):
                f.update((words.langs[words.lang[i]], tuple(words.word(i + k).decode() for k in range(n))) for i in words.phrases(n).tolist())
        expected, words_of = counts(ROWS + ROWS[5:8], 3)
        assert f == expected and total == +words_of


def test_equal_hashes_are_told_apart():
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in ROWS]), pa.array([g for g, _ in ROWS])], names=["text", "lang"])
    words = C.Words(*next(C.joined_texts([batch])))
    true = [(words.lang[i], words.word(i)) for i in range(len(words.at))]
    for clash in (None, 1, 5):
        if clash:
            words.hashes = words.hashes % np.uint64(clash)
        ids, first = words.ids()
        assert len(set(true)) == len(first) == len(set(zip(true, ids.tolist())))
        assert [true[first[i]] for i in ids] == true


def test_a_full_filter_changes_nothing(spark):
    full = C.Filter(C.CHUNK_BITS, np.full(C.CHUNK, 255, np.uint8))
    rows = C.counted_phrases(frame(spark).select("text", "lang"), full, 10, 3).collect()
    f, total = counts(ROWS, 3)
    assert {(r.lang, r.phrase): r.n for r in rows if r.words} == {(g, " ".join(w)): n for (g, w), n in f.items() if n >= 10}
    assert {r.lang: r.n for r in rows if not r.words} == +total


def test_mining_misses_nothing(spark):
    keys = C.locally_frequent(frame(spark, parts=7).select("text", "lang"), 10, 3)
    kept = C.build_filter(keys)
    assert 0 < keys.count() and not kept.has(np.arange(1 << 20, dtype=np.uint64) * C.MIX).all()
    rows = C.counted_phrases(frame(spark).select("text", "lang"), kept, 10, 3).collect()
    f, _ = counts(ROWS, 3)
    assert {(r.lang, r.phrase): r.n for r in rows if r.words > 1} == {(g, " ".join(w)): n for (g, w), n in f.items() if n >= 10 and len(w) > 1}


def test_no_rows(spark):
    for rows in ([], [("en", None), (None, "")]):
        got = C.mine(frame(spark, rows))
        assert got.collect() == [] and got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_scores_of_large_counts(spark):
    a, left, right = 4 * 10 ** 12 + 7, 9 * 10 ** 12 + 1, 8 * 10 ** 12 + 3
    rows = [("en", 2, "x y", a), ("en", 1, "x", left), ("en", 1, "y", right)]
    got = C.scored(spark.createDataFrame(rows, "lang string, words int, phrase string, n long")).collect()
    assert [(r.a, r.l, r.r, r.score) for r in got] == [(a, left, right, 10 ** 6 * a * a // (left * right))]
