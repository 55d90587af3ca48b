"""Conversation prefix trie by composable fingerprints.

A conversation c is rebuilt from the first ``head`` turns of another one, its base, and its
own turns after its first ``head``.  Rebuilt texts are never written: a run of turns has the
fingerprint sum(x_i B^i) mod p over its turns' content keys, in four lanes of 31 bits.  These
form a monoid, so that a prefix of a rebuilt conversation is the base's prefix joined with a
difference of two own prefixes, moved by a power of B if the base is short.

Prefixes of equal depth and fingerprint are one node.  Equality is then verified through the
turns that the rows refer to: a content key must stand for one (role, text), and a node's
rows must agree in the key of their last turn and in their parent; then equal nodes are equal
prefixes by induction.  If a clash shows, all is done again with other keys and bases.

What a node sums over its subtree comes from its members alone.  The smallest member owns a
node.  Below the depth q of the last node that c doesn't own it owns all, and every row that
isn't owned is one occurrence saved; so c saves bytes(q) - bytes(d - 1) below its node of
depth d, and each leaf counts at its owner.

No group holds a conversation or a node's members: turns are numbered by ranges, prefix sums
run in chunks with offsets, nodes are counted by partial aggregates, and the list of a node's
ends is written by ranges in blocks, which one hash reads in order (a digest can't be split).

Edge cases: turns are ordered by turn (null first), then role and text, as which null is
empty; repeated rows are turns of their own.  Rows without an id are left out.  For negative
ids ``c % 5`` has the sign of c, as in SQL.  A conversation without rebuilt turns ends at the
root.  An empty table has no nodes, no root either.  Other columns are not read.
"""
from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .._ship import ship_package
from ..operators.ranks import ordered_index
from ..plans.materialize import materialize

P = (1 << 31) - 1
LANES = 4
CHUNK = 4096                  # turns of one conversation that are summed together
BLOCK = 8192                  # ids of one block of a node's ends
HEAD_MOST = 8                 # turns of a head, at most
ATTEMPTS = 4
NODE = ["depth", "fa", "fb"]


def default_base(c: Column) -> Column:
    return c - c % 5


def default_head(c: Column) -> Column:
    return F.crc32(c.cast("string").cast("binary")) % 9


def bases(attempt: int) -> list[int]:
    r = random.Random(1000 + attempt)
    return [r.randrange(1 << 24, P) for _ in range(LANES)]


def _lanes(k: str) -> Column:
    """Two 31-bit numbers of a 64-bit key."""
    return F.array(F.col(k).bitwiseAND(F.lit(P)), F.shiftrightunsigned(k, 32).bitwiseAND(F.lit(P)))


def _weighed(base: list[int]):
    """Columns conv, pos, n, b, k1, k2; adds v0.. = content * B^pos mod p."""
    low = [np.array([pow(b, i, P) for i in range(CHUNK)], np.int64) for b in base]

    def run(batches):
        for batch in batches:
            pos, k = batch.column(1).to_numpy(), [batch.column(4 + j).to_numpy().view(np.uint64) for j in (0, 1)]
            content = [(x >> np.uint64(s)).astype(np.int64) & P for x in k for s in (0, 32)]
            high, which = np.unique(pos // CHUNK, return_inverse=True)
            out = []
            for b, table, x in zip(base, low, content):
                lift = np.array([pow(b, CHUNK * h, P) for h in high.tolist()], np.int64)
                out.append(pa.array(table[pos % CHUNK] * lift[which] % P * (x % P) % P))
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, *[f"v{j}" for j in range(LANES)]])
    return run


def _rows(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    return (conversations.select(F.col(f"`{id_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").alias("turn"),
                                 F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"),
                                 F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
            .filter(F.col("conv").isNotNull()))


def _keys(attempt: int) -> list[Column]:
    return [F.xxhash64(F.lit(2 * attempt + k), "role", F.length("role"), "text").alias(f"k{k + 1}") for k in (0, 1)]


def clashing_contents(rows: DataFrame, attempt: int = 0) -> DataFrame:
    """Content keys that stand for more than one (role, text)."""
    content = F.struct("role", "text")
    return (rows.select("role", "text", *_keys(attempt)).groupBy("k1", "k2")
            .agg(F.min(content).alias("least"), F.max(content).alias("most")).filter(F.col("least") != F.col("most")))


def numbered_turns(rows: DataFrame) -> DataFrame:
    """(conv, at, role, text): a dense number in the order of conversations and turns."""
    order = [F.asc("conv"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text"), F.asc("row")]
    return ordered_index(rows.withColumn("row", F.monotonically_increasing_id()), order, "at")


def turn_prefixes(numbered: DataFrame, attempt: int = 0) -> DataFrame:
    """One row per turn: conv, pos, n (turns of conv), b (bytes of the text), k1, k2, v0.. (its part of
    the fingerprint), s0.. (the fingerprint up to it) and sb (bytes up to it)."""
    places = materialize(numbered.select("conv", "at", F.octet_length("text").cast("long").alias("b"), *_keys(attempt)), "turn-places")
    starts = places.groupBy("conv").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("n"))
    rows = places.join(starts, "conv").select("conv", (F.col("at") - F.col("start")).alias("pos"), "n", "b", "k1", "k2")
    names = [f"v{j}" for j in range(LANES)]
    weighed = rows.mapInArrow(_weighed(bases(attempt)), "conv long, pos long, n long, b long, k1 long, k2 long, "
                              + ", ".join(f"{v} long" for v in names)).withColumn("chunk", F.floor(F.col("pos") / CHUNK))
    weighed = materialize(weighed, "turn-weights")
    sums = [*names, "b"]
    within = Window.partitionBy("conv", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (weighed.filter(F.col("n") > CHUNK).groupBy("conv", "chunk").agg(*[F.sum(c).alias(c) for c in sums])
               .select("conv", "chunk", *[F.sum(c).over(before).alias(f"off_{c}") for c in sums]))
    running = weighed.select("*", *[F.sum(c).over(within).alias(f"run_{c}") for c in sums]).join(offsets, ["conv", "chunk"], "left")
    total = {c: F.col(f"run_{c}") + F.coalesce(F.col(f"off_{c}"), F.lit(0)) for c in sums}
    return running.select("conv", "pos", "n", "b", "k1", "k2", *names,
                          *[(total[v] % P).alias(f"s{j}") for j, v in enumerate(names)], total["b"].alias("sb"))


def _packed(lanes: list[Column]) -> tuple[Column, Column]:
    return lanes[0] * (1 << 31) + lanes[1], lanes[2] * (1 << 31) + lanes[3]


def rebuilt(turns: DataFrame, attempt: int, base, head) -> DataFrame:
    """One row per rebuilt conversation and depth (0 too): conv, depth, its node's and its
    parent's fingerprints, length, b, sb (bytes up to it), k1, k2 and the turn it refers to."""
    lanes = range(LANES)
    turn = F.struct("pos", "conv", "b", "sb", "k1", "k2", F.array(*[F.col(f"s{j}") for j in lanes]).alias("s"),
                    F.array(*[F.col(f"v{j}") for j in lanes]).alias("v"))
    heads = (turns.filter(F.col("pos") < HEAD_MOST).groupBy("conv")         # HEAD_MOST structs at most
             .agg(F.array_sort(F.collect_list(turn)).alias("first"), F.max("n").alias("n")))
    h = F.least(head(F.col("conv")), F.lit(HEAD_MOST)).cast("int")
    convs = (heads.withColumn("h", h).withColumn("base", base(F.col("conv")))
             .join(heads.select(F.col("conv").alias("base"), F.col("first").alias("base_first"), F.col("n").alias("base_n")), "base", "left")
             .withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0))).cast("int"))
             .withColumn("length", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
             .withColumn("joint", F.try_element_at("base_first", F.col("m")))
             .withColumn("own", F.try_element_at("first", F.col("h"))))
    convs = convs.withColumn("joint", F.when(F.col("m") > 0, F.col("joint"))).withColumn("own", F.when(F.col("h") > 0, F.col("own")))
    convs = materialize(convs.drop("first"), "rebuilt-heads")
    zero = F.array(*[F.lit(0).cast("long") for _ in lanes])
    s, v = "turn.s", "turn.v"

    def node(depth: Column, full: list[Column], part: list[Column], upto: Column) -> list[Column]:
        fa, fb = _packed(full)
        pa_, pb = _packed([F.pmod(f - p, F.lit(P)) for f, p in zip(full, part)])
        return ["conv", depth.cast("long").alias("depth"), fa.alias("fa"), fb.alias("fb"), pa_.alias("pa"), pb.alias("pb"),
                F.col("length").cast("long").alias("length"), F.col("turn.b").alias("b"), upto.alias("sb"),
                F.col("turn.k1").alias("k1"), F.col("turn.k2").alias("k2"),
                F.col("turn.conv").alias("turn_conv_id"), F.col("turn.pos").alias("turn_place")]

    front = (convs.filter("m > 0").select("conv", "length", F.explode(F.slice("base_first", 1, F.col("m"))).alias("turn"))
             .select(*node(F.col("turn.pos") + 1, [F.col(s)[j] for j in lanes], [F.col(v)[j] for j in lanes], F.col("turn.sb"))))
    # own turns after the head: the joint's fingerprint, and the difference of own prefixes moved back by h - m places
    per = convs.filter("n > h").select("conv", "length", "h", "m", F.coalesce("joint.s", zero).alias("js"), F.coalesce("own.s", zero).alias("os"),
                                       (F.coalesce("joint.sb", F.lit(0)) - F.coalesce("own.sb", F.lit(0))).alias("more"))
    back = [[pow(b, -i, P) for i in range(HEAD_MOST + 1)] for b in bases(attempt)]
    moved = [F.element_at(F.array(*[F.lit(x).cast("long") for x in row]), F.col("h") - F.col("m") + 1) for row in back]
    part = [F.col(v)[j] * moved[j] % P for j in lanes]
    full = [(F.col("js")[j] + F.pmod(F.col(s)[j] - F.col("os")[j], F.lit(P)) * moved[j]) % P for j in lanes]
    rear = (turns.select("conv", turn.alias("turn")).join(per, "conv").filter(F.col("turn.pos") >= F.col("h"))
            .select(*node(F.col("turn.pos") - F.col("h") + F.col("m") + 1, full, part, F.col("turn.sb") + F.col("more"))))
    none = F.lit(None).cast("long")
    nought = F.lit(0).cast("long")
    root = convs.select("conv", nought.alias("depth"), nought.alias("fa"), nought.alias("fb"), none.alias("pa"), none.alias("pb"),
                        F.col("length").cast("long").alias("length"), nought.alias("b"), nought.alias("sb"), none.alias("k1"), none.alias("k2"),
                        none.alias("turn_conv_id"), none.alias("turn_place"))
    return root.unionByName(front).unionByName(rear)


def _nodes(rows: DataFrame) -> DataFrame:
    """One row per node: its owner's id, the turn that the owner's row refers to, members,
    bytes, parent, and whether its rows agree."""
    agree = F.lit(True)
    for c in ("pa", "pb", "k1", "k2"):
        agree = agree & F.min(c).eqNullSafe(F.max(c))
    owner = F.min(F.struct("conv", "turn_conv_id", "turn_place"))
    return (rows.groupBy(*NODE).agg(owner.alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.min("b").alias("b"),
                                    F.min("pa").alias("pa"), F.min("pb").alias("pb"), agree.alias("agree"))
            .select(*NODE, F.col("owner.conv").alias("conv_id"), "owner.turn_conv_id", "owner.turn_place", "n_convs", "b", "pa", "pb", "agree"))


def _blocks(batches):
    """Sorted (depth, fa, fb, conv) to blocks (depth, fa, fb, first, ids as text)."""
    def block(key, ids):
        return pa.RecordBatch.from_arrays([*[pa.array([k]) for k in key], pa.array(ids[:1]), pa.array([",".join(map(str, ids))])],
                                          names=[*NODE, "first", "ids"])
    key, ids = None, []
    for b in batches:
        for *mine, conv in zip(*[c.to_pylist() for c in b.columns]):
            if ids and (mine != key or len(ids) == BLOCK):
                yield block(key, ids)
                ids = []
            key = mine
            ids.append(conv)
    if ids:
        yield block(key, ids)


def _hashed(batches):
    """Sorted blocks to the digest of each node's ids, read in order and never held."""
    def row(key, sha):
        return pa.RecordBatch.from_arrays([*[pa.array([k]) for k in key], pa.array([sha.hexdigest()])], names=[*NODE, "ends_sha256"])
    key, sha = None, None
    for b in batches:
        for *mine, ids in zip(*[b.column(i).to_pylist() for i in (0, 1, 2, 4)]):
            if mine == key:
                sha.update(b",")
            else:
                if key is not None:
                    yield row(key, sha)
                key, sha = mine, hashlib.sha256()
            sha.update(ids.encode())
    if key is not None:
        yield row(key, sha)


def ends_digest(ends: DataFrame) -> DataFrame:
    """(depth, fa, fb, ends_sha256) of rows (depth, fa, fb, conv)."""
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*NODE, "conv"]
    blocks = (ends.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order)
              .mapInArrow(_blocks, "depth long, fa long, fb long, first long, ids string"))
    return (blocks.repartition(*NODE).sortWithinPartitions(*NODE, "first")
            .mapInArrow(_hashed, "depth long, fa long, fb long, ends_sha256 string"))


def _verified(conversations: DataFrame, columns: tuple, base, head) -> tuple[DataFrame, DataFrame]:
    """(rows of rebuilt conversations, nodes), with keys and bases without a clash."""
    rows = _rows(conversations, *columns)
    numbered = numbered_turns(rows)
    for attempt in range(ATTEMPTS):
        if not clashing_contents(rows, attempt).isEmpty():
            continue
        members = materialize(rebuilt(materialize(turn_prefixes(numbered, attempt), "turn-prefixes"), attempt, base, head), "trie-rows")
        nodes = materialize(_nodes(members), "trie-nodes")
        if nodes.filter(~F.col("agree")).isEmpty():
            return members, nodes
    raise RuntimeError("fingerprints clash with every choice of keys")


def trie(conversations: DataFrame, base=default_base, head=default_head, id_col: str = "conv_id", turn_col: str = "turn",
         role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256, and the stored turn that its last one refers to
    (turn_conv_id, turn_place).  ``base`` and ``head`` make columns of the id; a head has
    ``HEAD_MOST`` turns at most."""
    ship_package(conversations.sparkSession)
    members, nodes = _verified(conversations, (id_col, turn_col, role_col, text_col), base, head)
    parent = [(F.col("depth") - 1).alias("depth"), F.col("pa").alias("fa"), F.col("pb").alias("fb")]
    children = nodes.filter("depth > 0").select(*parent).groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialize(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-children")

    shared = nodes.filter("n_convs > 1").select(*NODE, F.col("conv_id").alias("owner"))
    last = (members.join(shared, NODE).filter(F.col("owner") < F.col("conv")).groupBy("conv")
            .agg(F.max(F.struct("depth", "sb")).alias("last")).select("conv", F.col("last.depth").alias("q"), F.col("last.sb").alias("q_bytes")))
    ends = members.filter("depth = length")
    leaves = ends.join(nodes.filter("n_children = 0").select(*NODE, F.col("conv_id").alias("conv")), [*NODE, "conv"], "left_semi") \
        .select("conv", F.lit(1).cast("long").alias("leaf"))
    per = members.select("conv").filter("depth = 0").join(last, "conv", "left").join(leaves, "conv", "left") \
        .filter("q is not null or leaf is not null")
    saved = F.when(F.col("depth") <= F.col("q"), F.col("q_bytes") - F.col("sb") + F.col("b"))
    sums = (members.select(*NODE, "conv", "sb", "b").join(per, "conv").groupBy(*NODE)
            .agg(F.sum("leaf").alias("n_leaves"), F.sum(saved).alias("saved_tokens")))

    first = nodes.filter("depth = 0").first()
    top = F.lit(None if first is None else first.conv_id).cast("long")      # every node of depth 1 has the root as parent
    owners = nodes.select(*NODE, F.col("conv_id").alias("parent_conv_id"))
    deep = nodes.filter("depth > 1").select(*[F.col(c).alias(f"node_{c}") for c in NODE], *parent).join(owners, NODE) \
        .select(*[F.col(f"node_{c}").alias(c) for c in NODE], "parent_conv_id")
    out = nodes.join(sums, NODE, "left").join(ends_digest(ends), NODE, "left").join(deep, NODE, "left")
    return out.select("conv_id", "depth", F.when(F.col("depth") == 1, top).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"),
                      "n_convs", "n_children", F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"),
                      F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"),
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), "turn_conv_id", "turn_place")


ORACLE = """
WITH codes AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)),
                          lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) AS v
    FROM range(256) AS bytes(i))),
turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, c - c % 5 AS base, xor(4294967295, list_reduce(
           list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
           lambda crc, b: xor(crc >> 8, t[(xor(crc, b) & 255) + 1]))) % 9 AS h
  FROM (SELECT DISTINCT c FROM turns), codes),
joined AS (
  SELECT v.c, t.place, t.role, t.text FROM convs v JOIN turns t ON t.c = v.base AND t.place < v.h
  UNION ALL SELECT v.c, t.place, t.role, t.text FROM convs v JOIN turns t ON t.c = v.c AND t.place >= v.h),
seqs AS (
  SELECT v.c, coalesce(list({'r': j.role, 'x': j.text} ORDER BY j.place) FILTER (WHERE j.place IS NOT NULL), []) AS seq
  FROM convs v LEFT JOIN joined j ON j.c = v.c GROUP BY v.c),
prefixes AS (SELECT c, len(seq) AS length, d, seq[1:d] AS k FROM seqs, unnest(range(len(seq) + 1)) AS depths(d)),
nodes AS (
  SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, CASE WHEN d = 0 THEN 0 ELSE strlen(k[d].x) END AS b,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE length = d), '')) AS ends_sha256
  FROM prefixes GROUP BY d, k),
children AS (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
counted AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.d = n.d AND c.k = n.k),
below AS (
  SELECT a.up AS d, u.k[1:a.up] AS k, sum((u.n_children = 0)::INT) AS n_leaves, sum((u.n_convs - 1) * u.b) AS saved_tokens
  FROM counted u, unnest(range(u.d + 1)) AS a(up) GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM counted n JOIN below s ON s.d = n.d AND s.k = n.k
LEFT JOIN nodes p ON n.d > 0 AND p.d = n.d - 1 AND p.k = n.k[1:n.d - 1]
"""
