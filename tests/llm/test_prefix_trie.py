import hashlib
import random
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.llm import prefix_trie as T

R = random.Random(3)
SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def base_of(c):
    return c - c % 5


def head_of(c):
    return zlib.crc32(str(c).encode()) % 9


def brute(rows, base=base_of, head=head_of):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(some)] for c, some in turns.items()}
    built = {c: tuple(turns.get(base(c), [])[:head(c)] + own[head(c):]) for c, own in turns.items()}
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
            if d:
                children[seq[:d - 1]].add(seq[:d])
        ends[seq].append(c)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) if children[k] else 1
        saved[k] = sum(saved[x] for x in children[k]) + (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0)
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k],
                   hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()) for k, m in members.items())


def conversation(c, n, words=3):
    return [(c, t, R.choice(["user", "assistant", None]), R.choice(["hi", "né", "", None, "x " * words])) for t in range(n)]


ROWS = [r for c in range(60) if c % 7 for r in conversation(c, R.randint(1, 14))]
ROWS += [(c, t, "user", f"turn {t}") for c in range(100, 140) for t in range(9)]                  # copies
ROWS += [(200, None, "user", "first"), (200, None, None, "first"), (200, 3, "user", "b"), (200, 3, "user", "a"), (200, 3, "user", "a")]
ROWS += [(None, 1, "user", "no id"), (10 ** 15, 0, "a", "bc"), (10 ** 15 + 1, 0, "ab", "c")]


def frame(spark, rows, parts=5):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as conv", "1 as depth", "2 as fa", "3 as pos").repartition(parts)


def result(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def test_brute_force(spark):
    assert result(T.trie(frame(spark, ROWS))) == brute(ROWS)


def test_long_conversations(spark):
    n = 2 * T.CHUNK + 10
    rows = [(c, t, "user", f"{t % 11}" if t < n - 5 * c else f"own {c}") for c in (0, 1, 2, 5) for t in range(n)]
    assert result(T.trie(frame(spark, rows))) == brute(rows)


def test_other_bases_and_heads(spark):
    got = T.trie(frame(spark, ROWS), base=lambda c: F.lit(104).cast("long"), head=lambda c: F.when(c % 2 == 0, 8).otherwise(0))
    assert result(got) == brute(ROWS, lambda c: 104, lambda c: 0 if c % 2 else 8)


def test_references_give_the_texts(spark):
    texts = {(r.conv, r.at): (r.role, r.text) for r in T.numbered_turns(T._rows(frame(spark, ROWS), "conv_id", "turn", "role", "text")).collect()}
    start = {}
    for c, at in sorted(texts):
        start.setdefault(c, at)
    for r in T.trie(frame(spark, ROWS)).filter("depth > 0 and conv_id >= 100 and conv_id < 140").collect():
        assert texts[r.turn_conv_id, start[r.turn_conv_id] + r.turn_place] == ("user", f"turn {r.depth - 1}")


@pytest.mark.parametrize("broken", ["bases", "_keys"])
def test_clashes_are_seen(spark, monkeypatch, broken):
    rows = [(0, 0, "u", "a"), (0, 1, "u", "b"), (5, 0, "u", "b"), (5, 1, "u", "a"), (10, 0, "u", "a"), (10, 1, "u", "b")]
    good, calls = getattr(T, broken), []

    def first_bad(attempt):
        calls.append(attempt)
        if attempt:
            return good(attempt)
        return [1] * T.LANES if broken == "bases" else [F.lit(7).cast("long").alias("k1"), F.lit(8).cast("long").alias("k2")]
    monkeypatch.setattr(T, broken, first_bad)
    assert result(T.trie(frame(spark, rows))) == brute(rows) and {0, 1} <= set(calls)
    monkeypatch.setattr(T, broken, lambda attempt: first_bad(0))
    with pytest.raises(RuntimeError, match="clash"):
        T.trie(frame(spark, rows))


def test_blocks_of_ends(monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 3)
    rows = [(1, 5, 6, c) for c in range(8)] + [(1, 5, 7, 4)] + [(2, 5, 6, c) for c in range(-2, 3)]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*some)], names=[*T.NODE, "conv"]) for some in (rows[:5], rows[5:6], rows[6:])]
    blocks = list(T._blocks(batches))
    assert max(len(i.split(",")) for b in blocks for i in b.column(4).to_pylist()) == 3
    got = {tuple(r) for b in T._hashed(blocks) for r in zip(*[c.to_pylist() for c in b.columns])}
    assert got == {(*k, hashlib.sha256(",".join(str(r[3]) for r in rows if r[:3] == k).encode()).hexdigest()) for k in {r[:3] for r in rows}}


def test_empty_tables(spark):
    got = T.trie(frame(spark, []))
    assert got.collect() == [] and got.columns[:8] == COLUMNS
    alone = [(c, 0, None, None) for c in (3, 8)]                       # heads of absent bases
    assert result(T.trie(frame(spark, alone))) == brute(alone)
    assert T.trie(frame(spark, [(None, 0, "u", "x")])).collect() == []
