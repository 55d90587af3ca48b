"""Hierarchical Pitman-Yor language model: seating by Gibbs sampling, averaged
predictive probabilities.

Restaurants: one for each context (the text's start and every word that another
token follows) and the root, which all contexts share as parent; the root's base is
uniform over the words seen and one for all others.  A word's customers in a context
sit at tables; each table is a customer of the root.

The pairs of all training documents are counted in groups of contexts; those of a
frequent context are dealt over several groups by their words (which ones, a sample
of the texts tells; it settles nothing but where a pair lies).  A group's pairs are
one row of packed arrays: its contexts, its words and, for each pair, where its word
stands.  Contexts and words have rows of their own, by ranges of their hash (homes),
which know the groups that hold them.  The number of groups follows the bytes of text,
that of homes the keys which the groups hold: with more than one home, a group has
MESSAGE_KEYS keys or more for each, on average.  So there are as many messages as the
data asks for, however many partitions a shuffle has.  In a sweep these rows send each group the totals of its
contexts and words, every customer draws a seat given the totals of the last sweep,
first in the contexts, then in the root, and the groups send back the tables of each
context and word.  So no pair moves: what travels is one number for each key of a
group.  A pair's only customer always has one table, so that such pairs draw nothing.
Beyond the first customers of a large count the number of new tables is drawn at once
from its Poisson limit.  Draws depend on the seed and the pair alone.  After the
burn-in, the predictive probabilities of all sweeps are averaged: a pair has c
customers and the mean of its tables, contexts and words have one factor for each
sweep; the probability of a pair is computed where it is asked for.

Scoring: documents are read in chunks.  The most frequent pairs travel to them as a
list of bounded size; every other pair of a chunk travels once to its group, with the
places of its documents, and one sum for each document returns.  Pairs that training
doesn't have go on to their context and word.  Nothing is left out either way; the
list only saves traffic.  Documents are scored in ROUNDS parts, one after the other,
so that the requests of one part only are on disk.

Edge cases: a null or empty text is its end token alone.  Rows without an id are
training rows.  Rows of equal id and text are scored alike, each in its row; of
equal id and different text, apart.  Without training tokens all words are
unknown.  Other columns are not read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .._ship import ship_package
from ..plans.materialize import discard, materialize
from .common import slices
from .repeated_passages import release_shuffles
from .words import MIX, hashes_of_words, mixed

FREQUENT_PAIRS = 1 << 18       # broadcast (context, word) pairs, at most
HOT_KEYS = 2000                # contexts or words whose pairs are dealt over several groups, at most
HOT_LEAST = 1000               # pairs (tokens of the sample, for contexts) that a key has at least before that
GROUP_BYTES = 1 << 20          # of text for each group, at least ...
LEAST_GROUPS = 16              # ... beyond so many groups; at most two for each partition of a shuffle
MESSAGE_KEYS = 512             # contexts and words of a group for each home, on average, at least
HOT_SAMPLE = 32                # one text in so many tells which contexts are frequent
SWEEPS, BURN_IN = 3, 1
STRENGTH = 1.0
ONE_BY_ONE = 32                # customers of a count that are seated one by one
CHUNK_TOKENS = 1 << 20         # tokens that a task gathers before it sends their pairs
CHUNK_TEXTS = 1 << 16          # and texts, at most
ROUNDS = 3                     # parts in which documents are scored
END = xxhash.xxh64_intdigest(b"end of text", 7)
START = xxhash.xxh64_intdigest(b"start of text", 7)


def contexts_of(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The context of each token of joined texts: the token before, or the start."""
    out = np.roll(tokens, 1)
    out[starts] = START
    return out


def _joined(part):
    """(token hashes of all texts, each with its end token, tokens of each text, first token of each)."""
    words, n = hashes_of_words(part, lower=True)
    last = np.cumsum(n)
    size = n + 1
    return np.insert(words, last, np.uint64(END)), size, last - n + np.arange(len(n))


def _pair_key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mixed(u * MIX + w)


def _chunks(batches):
    """(contexts, words, tokens of each text, other columns) of some texts at a time; the text comes first."""
    held, tokens, texts = [], 0, 0

    def joined():
        return [np.concatenate(x) for x in list(zip(*held))[:3]] + [pa.Table.from_batches([x[3] for x in held])]
    for b in batches:
        for start, n in slices(b.column(0)):
            if texts + n > CHUNK_TEXTS:
                yield joined()
                held, tokens, texts = [], 0, 0
            part = b.slice(start, n)
            w, size, starts = _joined(part.column(0))
            held.append((contexts_of(w, starts), w, size, part.select(b.schema.names[1:])))
            tokens, texts = tokens + len(w), texts + n
            if tokens >= CHUNK_TOKENS:
                yield joined()
                held, tokens, texts = [], 0, 0
    if held:
        yield joined()


def _flat(column, kind) -> np.ndarray:
    """The values of all blocks of a column, joined."""
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), kind)


def _cut(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """``values`` as blocks that end at ``ends``."""
    values = np.ascontiguousarray(values)
    size = values.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    offsets = (np.append(0, ends) * size).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(values)]).cast(pa.binary())


def _one(values: np.ndarray) -> pa.Array:
    return _cut(values, np.array([len(values)]))


def _planes(values: np.ndarray) -> bytes:
    """All first bytes of the values, then all second ones and so on: files and shuffles compress that better."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _from_planes(block: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(block, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _cut_planes(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.array([_planes(x) for x in np.split(values, ends[:-1])], pa.binary())


def _flat_planes(column, kind) -> np.ndarray:
    return np.concatenate([_from_planes(x, kind) for x in column.to_pylist()])


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the one before."""
    first = np.zeros(len(columns[0]), bool)
    first[:1] = True
    for x in columns:
        first[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(first)


def _order(keys: np.ndarray) -> np.ndarray:
    """Places of the sorted keys.  Their first bits are sorted along with the places, which takes a fraction of the time
    of an argsort; keys that agree in these bits and no further are rare."""
    places = np.uint64((1 << (len(keys) - 1).bit_length()) - 1)
    order = (np.sort(keys & ~places | np.arange(len(keys), dtype=np.uint64)) & places).view(np.int64)
    found = keys[order]
    return order if (found[1:] >= found[:-1]).all() else np.argsort(keys)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, sorted; where among them each key stands)."""
    order = _order(keys)
    found = keys[order]
    first = _starts(found)
    at = np.empty(len(keys), np.int64)
    at[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
    return found[first], at


def _home(keys: np.ndarray, homes: int) -> np.ndarray:
    """Keys are hashes; homes ascend with them."""
    return ((keys >> np.uint64(32)) * np.uint64(homes) >> np.uint64(32)).astype(np.int64)


def _group_of(u: np.ndarray, w: np.ndarray, groups: int, hot) -> np.ndarray:
    """The group of each pair: its context's, or one of several of a frequent context."""
    out, (keys, parts) = _home(u, groups), hot
    if len(keys):
        at = np.minimum(np.searchsorted(keys, u), len(keys) - 1)
        many = np.flatnonzero(keys[at] == u)
        out[many] = (out[many] + (mixed(w[many]) % parts[at[many]]).astype(np.int64)) % groups
    return out


def _by_group(u: np.ndarray, w: np.ndarray, groups: int, hot):
    """(order, group of each sorted pair, first pair of each run of one context, groups met, their last pairs, their last runs)."""
    to = _group_of(u, w, groups, hot)
    high, low = groups.bit_length(), (len(u) - 1).bit_length()       # bits of the group, and those that _order takes
    code = (u << np.uint64(high + low + 8) >> np.uint64(high)) | (w >> np.uint64(56) << np.uint64(low))
    order = _order((to.astype(np.uint64) << np.uint64(64 - high)) | code)
    to, u = to[order], u[order]
    runs, firsts = _starts(to, u), _starts(to)
    ends = np.append(firsts[1:], len(to)) if len(to) else firsts
    return order, runs, to[firsts], ends, np.searchsorted(runs, ends)


_PAIRS = "to long, u binary, r binary, w binary, c binary"


def _packer(groups: int, hot):
    """Distinct pairs of each chunk with their counts, packed by group."""
    def run(batches):
        for u, w, _, _ in _chunks(batches):
            key = _pair_key(u, w)
            order = _order(key)
            first = _starts(key[order])
            c, first = np.diff(np.append(first, len(key))), order[first]
            u, w = u[first], w[first]
            order, runs, to, ends, run_ends = _by_group(u, w, groups, hot)
            size = np.diff(np.append(runs, len(order))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(to), _cut(u[order][runs], run_ends), _cut_planes(size, run_ends), _cut(w[order], ends),
                 _cut_planes(c[order].astype(np.int32), ends)],
                names=["to", "u", "r", "w", "c"])
    return run


_BLOCK = "to long, u binary, r binary, w binary, at binary, many binary, c binary, ones long, twos long, keys long"


def _merged(key, t):
    """A group's pairs as one row: contexts (u) with their numbers of pairs (r), words (w), the place of each pair's
    word (at), and which pairs occur more than once (many), how often (c)."""
    (contexts, of), (words, at) = _distinct(_flat(t["u"], np.uint64)), _distinct(_flat(t["w"], np.uint64))
    code = (np.repeat(of, _flat_planes(t["r"], np.int32)) * len(words) + at).astype(np.uint64)
    order = _order(code << np.uint64(64 - (len(contexts) * len(words)).bit_length()))
    code = code[order]
    first = _starts(code)
    c, of, at = np.add.reduceat(_flat_planes(t["c"], np.int32)[order].astype(np.int64), first), *np.divmod(code[first].astype(np.int64), len(words))
    many = np.flatnonzero(c > 1)
    columns = [contexts, np.bincount(of).astype(np.int32), words, at.astype(np.int32), many.astype(np.int32), c[many]]
    return pa.table([pa.array([key[0].as_py()], pa.int64()), *(pa.array([_planes(x)]) for x in columns),
                     *(pa.array([n], pa.int64()) for n in (int((c == 1).sum()), int((c == 2).sum()), len(contexts) + len(words)))],
                    names=[x.split()[0] for x in _BLOCK.split(", ")])


class _Group:
    """A group's row, unpacked; ``row`` is one of its blocks as a mapping."""

    def __init__(self, row, homes: int):
        self.u, self.w = (_from_planes(row[x], np.uint64) for x in "uw")
        self.at, self.many, runs = (_from_planes(row[x], np.int32) for x in ("at", "many", "r"))
        self.of = np.repeat(np.arange(len(self.u)), runs)
        self.often = _from_planes(row["c"], np.int64)
        self.c = np.ones(len(self.at), np.int64)
        self.c[self.many] = self.often
        home = np.append(_home(self.u, homes), homes + _home(self.w, homes))
        first = _starts(home)
        self.homes, self.ends = home[first], np.append(first[1:], len(home))

    def sent(self, contexts: np.ndarray, words: np.ndarray) -> pa.Array:
        """One value for each context and word, as blocks for their homes."""
        return _cut(np.append(contexts, words), self.ends)

    def received(self, column, kind, width: int = 1):
        """Values of contexts and of words from the answers of their homes, in the order of these."""
        got = _flat(column, kind)
        got = got.reshape(-1, width) if width > 1 else got
        return got[:len(self.u)], got[len(self.u):]


def _seen(homes: int):
    """What the rows of contexts and words get to know of a group: their tokens, pairs and pairs that occur once."""
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                g = _Group(row, homes)
                per = lambda x: g.sent(*(np.bincount(k, weights=x, minlength=len(y)).astype(np.int64) for k, y in ((g.of, g.u), (g.at, g.w))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g.homes), pa.array(np.full(len(g.homes), row["to"])), g.sent(g.u, g.w), per(g.c), per(np.ones(len(g.c))), per(g.c == 1)],
                    names=["to", "group", "k", "c", "n", "s"])
    return run


_KEYS = ("to long, groups binary, sizes binary, k binary, at binary, c binary, s binary, n binary, t binary, past binary, "
         "sum_c long, sum_n long, sum_t long, keys long, ones long, twos long")


def _keys_row(to: int, groups, sizes, k, at, c, s, n, t, past) -> dict:
    return {"to": to, **{x: _planes(y) for x, y in (("groups", groups), ("sizes", sizes), ("k", k), ("at", at), ("c", c), ("s", s), ("n", n), ("t", t))},
            "past": past.tobytes(),
            "sum_c": int(c.sum()), "sum_n": int(n.sum()), "sum_t": int(t.sum()), "keys": len(k), "ones": int((c == 1).sum()), "twos": int((c == 2).sum())}


def _table(rows: list[dict], ddl: str) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.Table.from_pylist(rows, pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))]))


def _keys_of(homes: int):
    """The row of all contexts or words with one home: the groups that hold them, where each of their keys stands (at),
    tokens (c), pairs that occur once (s), and the customers and tables in the root (n, t); contexts have as n the
    tables of their other pairs."""
    def run(key, t):
        t, to = t.sort_by("group"), key[0].as_py()
        k, at = _distinct(_flat(t["k"], np.uint64))
        total = lambda x: np.bincount(at, weights=_flat(t[x], np.int64)).astype(np.int64)
        c, n, s = total("c"), total("n"), total("s")
        sizes = np.array([len(x) // 8 for x in t["k"].to_pylist()], np.int64)
        return _table([_keys_row(to, t["group"].to_numpy(), sizes, k, at.astype(np.int32), c, s, n if to >= homes else n - s, np.ones_like(n),
                                 np.zeros((len(k), 0)))], _KEYS)
    return run


class _Keys:
    def __init__(self, row, homes: int):
        self.to, self.words = row["to"], row["to"] >= homes
        self.groups, self.sizes, self.c, self.s, self.n, self.t = (_from_planes(row[x], np.int64) for x in ("groups", "sizes", "c", "s", "n", "t"))
        self.k, self.at = _from_planes(row["k"], np.uint64), _from_planes(row["at"], np.int32)
        self.past = np.frombuffer(row["past"], np.float64).reshape(len(self.k), -1)

    def now(self, d1: float, d0: float, new: float, n0: float) -> np.ndarray:
        """Weight of a new table in each context, or probability of each word in the root."""
        return (self.n - d0 * self.t + new) / (STRENGTH + n0) if self.words else STRENGTH + d1 * (self.s + self.n)

    def with_past(self, now: np.ndarray) -> np.ndarray:
        return np.column_stack([self.past, now if self.words else now / (STRENGTH + self.c)])


_ANSWER = "to long, kind long, `from` long, a binary, b binary, c binary, d binary, e binary"
NOW, SEATS, ASKED, TEXTS = range(4)


def _answers(rows) -> pa.RecordBatch:
    """Rows of _ANSWER from (to, kind, from, blocks of a, b, ...)."""
    to, kind, source, *blocks = rows
    n = len(to)
    blocks = [*blocks, *[pa.nulls(n, pa.binary())] * (5 - len(blocks))]
    return pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(np.full(n, kind)), pa.array(np.broadcast_to(source, n), pa.int64()), *blocks],
                                      names=["to", "kind", "from", *"abcde"])


def _told(homes: int, scalars):
    """What the rows of contexts and words answer to the groups: the totals of this sweep, or at the end (without
    ``scalars``) tokens and factors."""
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                k = _Keys(row, homes)
                ends = np.cumsum(k.sizes)
                blocks = [_cut(k.now(*scalars)[k.at], ends)] if scalars else [_cut(k.c[k.at], ends), _cut(k.past[k.at], ends)]
                yield _answers([k.groups, NOW, k.to, *blocks])
    return run


def _kept(seats: DataFrame) -> DataFrame:
    none = F.lit(None).cast("binary")
    return seats.select("to", F.lit(SEATS).cast("long").alias("kind"), F.lit(-1).cast("long").alias("from"), F.col("t").alias("a"), F.col("sum").alias("b"),
                        *[none.alias(x) for x in "cde"])


def _of_kind(t: pa.Table, kind: int) -> pa.Table:
    return t.filter(pa.array(t["kind"].to_numpy() == kind)).sort_by("from")


_SEATS = "to long, t binary, sum binary, homes binary, ends binary, tables binary"


def _seated(homes: int, d1: float, seed: int, count: bool):
    """New tables of a group's pairs, and of its contexts and words for their homes; ``count``: the old ones are summed up."""
    def run(key, left, right):
        g, old = _Group(left.to_pylist()[0], homes), _of_kind(right, SEATS)
        t, total = (_from_planes(old[x][0].as_py(), np.int64) for x in "ab") if old.num_rows else (np.ones(len(g.many), np.int64), np.zeros(len(g.many), np.int64))
        weight, now = g.received(_of_kind(right, NOW)["a"], np.float64)
        u, w = g.of[g.many], g.at[g.many]
        new = seat(g.often, weight[u] * now[w], d1, _pair_key(g.u[u], g.w[w]), seed).astype(np.int64)
        per = np.concatenate([np.bincount(k, weights=new, minlength=len(x)).astype(np.int64) for k, x in ((u, g.u), (w, g.w))])
        return _table([{"to": key[0].as_py(), "t": _planes(new), "sum": _planes(total + t * count), "homes": g.homes.tobytes(),
                        "ends": g.ends.tobytes(), "tables": _planes(per)}], _SEATS)
    return run


def _tables_sent(batches):
    """Tables of each group's contexts and words, for their homes."""
    for b in batches:
        for row in b.to_pylist():
            homes, ends = (np.frombuffer(row[x], np.int64) for x in ("homes", "ends"))
            yield pa.RecordBatch.from_arrays([pa.array(homes), pa.array(np.full(len(homes), row["to"])), _cut(_from_planes(row["tables"], np.int64), ends)],
                                             names=["to", "group", "t"])


def _reseated(homes: int, scalars, seed: int, count: bool):
    """The rows of contexts and words after a sweep; the words' new customers take their seats in the root."""
    def run(key, left, right):
        k = _Keys(left.to_pylist()[0], homes)
        n = np.bincount(k.at, weights=_flat(right.sort_by("group")["t"], np.int64), minlength=len(k.k)).astype(np.int64)
        past, t = k.with_past(k.now(*scalars)) if count else k.past, k.t
        if k.words:
            n = n + k.s
            t = seat(n, np.full(len(n), scalars[2]), scalars[1], _pair_key(k.k, k.k), seed).astype(np.int64)
        return _table([_keys_row(k.to, k.groups, k.sizes, k.k, k.at, k.c, k.s, n, t, past)], _KEYS)
    return run


def _ended(homes: int, scalars):
    """Rows of contexts and words with the last factor; what only the sweeps need is left out."""
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                k, none = _Keys(row, homes), np.zeros(0, np.int64)
                out = _keys_row(k.to, k.groups, k.sizes, k.k, k.at, k.c, none, none, none, k.with_past(k.now(*scalars)))
                yield from _table([out], _KEYS).to_batches()
    return run


def seat(customers: np.ndarray, weight: np.ndarray, discount: float, keys: np.ndarray, seed: int) -> np.ndarray:
    """Tables of each dish: every customer opens one with its seat's probability."""
    tables = (customers > 0).astype(np.float64)
    salt = mixed(np.arange(ONE_BY_ONE * seed, ONE_BY_ONE * (seed + 1), dtype=np.uint64) * MIX)
    for j in range(1, min(ONE_BY_ONE, int(customers.max(initial=0)))):
        more = np.flatnonzero(customers > j)
        new = weight[more]
        p = new / (new + j - discount * tables[more])
        tables[more] += mixed(keys[more] ^ salt[j]) / 2.0 ** 64 < p
    large = np.flatnonzero(customers > ONE_BY_ONE)
    if len(large):
        a, c, t = weight[large], customers[large], tables[large]
        mean = np.maximum(a * np.log((a + c - discount * t) / (a + ONE_BY_ONE - discount * t)), 0)
        more = [np.random.default_rng([seed, k]).poisson(m) for k, m in zip(keys[large].tolist(), mean.tolist())]
        tables[large] = np.minimum(c, t + np.array(more))
    return tables


class Model:
    """Groups of pairs, their seats, and rows of contexts and words."""

    def __init__(self, blocks: DataFrame, seats: DataFrame, keys: DataFrame, d1: float, unknown: list[float], tokens: int, v: int,
                 groups: int, homes: int, hot):
        self.blocks, self.seats, self.keys, self.d1, self.unknown = blocks, seats, keys, d1, unknown
        self.tokens, self.v, self.groups, self.homes, self.hot = tokens, v, groups, homes, hot

    def told(self) -> DataFrame:
        """What a group needs beside its pairs: their seats, the tokens and factors of its contexts and words."""
        return _kept(self.seats).unionByName(self.keys.mapInArrow(_told(self.homes, None), _ANSWER))

    def pairs_from(self, least: int) -> DataFrame:
        """u, w, c, p, wc of the pairs that occur ``least`` times or more."""
        homes, d1 = self.homes, self.d1

        def run(key, left, right):
            g, p, wc = _probabilities(left, right, homes, d1)
            some = np.flatnonzero(g.c >= least)
            u, w = g.u[g.of[some]].view(np.int64), g.w[g.at[some]].view(np.int64)
            return pa.table([u, w, g.c[some], p[some], wc[g.at[some]]], names=["u", "w", "c", "p", "wc"])
        return self.blocks.groupBy("to").cogroup(self.told().groupBy("to")).applyInArrow(run, "u long, w long, c long, p double, wc long")

    @property
    def pairs(self) -> DataFrame:
        return self.pairs_from(1)

    def _rows(self, words: bool, names: list[str]) -> DataFrame:
        homes = self.homes

        def run(batches):
            for b in batches:
                for row in b.to_pylist():
                    k = _Keys(row, homes)
                    past = pa.FixedSizeListArray.from_arrays(pa.array(k.past.ravel()), k.past.shape[1]).cast(pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([pa.array(k.k.view(np.int64)), pa.array(k.c), past], names=names)
        rows = self.keys.filter(F.col("to") >= homes if words else F.col("to") < homes)
        return rows.mapInArrow(run, f"{names[0]} long, {names[1]} long, {names[2]} array<double>")

    @property
    def contexts(self) -> DataFrame:
        return self._rows(False, ["u", "c", "backs"]).select("u", "backs")

    @property
    def words(self) -> DataFrame:
        return self._rows(True, ["w", "c", "roots"])


def _probabilities(left: pa.Table, right: pa.Table, homes: int, d1: float):
    """(group, probability of each of its pairs, tokens of each of its words)."""
    g, seats, told, used = _Group(left.to_pylist()[0], homes), _of_kind(right, SEATS), _of_kind(right, NOW), SWEEPS - BURN_IN
    t = np.ones(len(g.c))
    t[g.many] = sum(_from_planes(seats[x][0].as_py(), np.int64) for x in "ab") / used
    (cu, wc), (backs, roots) = g.received(told["a"], np.int64), g.received(told["b"], np.float64, used)
    both = np.zeros(len(t))
    for back, root in zip(backs.reshape(-1, used).T, roots.reshape(-1, used).T):
        both += back[g.of] * root[g.at]
    return g, (g.c - d1 * t) / (STRENGTH + cu[g.of]) + both / used, wc


def _discount(ones: int | None, twos: int | None) -> float:
    a, b = ones or 0, twos or 0
    return min(0.95, max(0.05, a / (a + 2 * b))) if a else 0.5


def _with_side(pairs: DataFrame, side: DataFrame, key: str, other: str, hot: DataFrame) -> DataFrame:
    """``pairs`` with the columns of ``side``; the pairs of a hot key go to ``parts`` groups by their other key."""
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    left = (pairs.join(F.broadcast(hot), key, "left").withColumn("salt", F.pmod(F.xxhash64(other), parts)).drop("parts"))
    right = (side.join(F.broadcast(hot), key, "left")
             .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts"))
    return left.join(right, [key, "salt"]).drop("salt")


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _context_counts(batches):
    for u, _, _, _ in _chunks(batches):
        k, n = np.unique(u, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], names=["u", "n"])


def _hot_contexts(texts: DataFrame, groups: int):
    """Contexts that are frequent in a sample of the texts, sorted, and over how many groups their pairs are dealt."""
    sample = texts.filter(F.pmod(F.xxhash64("text"), F.lit(HOT_SAMPLE)) == 0)
    counts = materialize(sample.mapInArrow(_context_counts, "u long, n long").groupBy("u").agg(F.sum("n").alias("n")), "lm-sample")
    least = max(HOT_LEAST, (counts.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS)
    found = sorted((x["u"] % (1 << 64), min(groups, -(-x["n"] // least))) for x in counts.filter(F.col("n") > least).collect())
    discard(counts)
    return tuple(np.array([x[i] for x in found], np.uint64) for i in (0, 1))


def fit(texts: DataFrame, seed: int = 11) -> Model:
    """Learn from the column ``text``."""
    spark = texts.sparkSession
    ship_package(spark)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = min(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), max(LEAST_GROUPS, size // GROUP_BYTES))
    hot = _hot_contexts(texts, groups)
    blocks = materialize(texts.mapInArrow(_packer(groups, hot), _PAIRS).groupBy("to").applyInArrow(_merged, _BLOCK), "lm-pairs")
    release_shuffles(spark)
    sums = lambda df, *names: df.agg(*[F.sum(x).alias(x) for x in names]).first()
    held = sums(blocks, "ones", "twos", "keys")
    homes = min(groups, max(1, (held["keys"] or 0) // (groups * MESSAGE_KEYS)))
    keys = materialize(blocks.mapInArrow(_seen(homes), "to long, `group` long, k binary, c binary, n binary, s binary")
                       .groupBy("to").applyInArrow(_keys_of(homes), _KEYS), "lm-keys")
    release_shuffles(spark)
    words = sums(keys.filter(F.col("to") >= homes), "sum_c", "keys", "ones", "twos")
    tokens, v = int(words["sum_c"] or 0), int(words["keys"] or 0)
    d1, d0 = _discount(held["ones"], held["twos"]), _discount(words["ones"], words["twos"])
    seats, unknown, base = None, [], 1.0 / (v + 1)
    for s in range(SWEEPS + 1):
        r = sums(keys.filter(F.col("to") >= homes), "sum_n", "sum_t")
        n0, new = float(r["sum_n"] or 0), (STRENGTH + d0 * float(r["sum_t"] or 0)) * base
        scalars, count, old = (d1, d0, new, n0), s > BURN_IN, [keys]
        if count:
            unknown.append(new / (STRENGTH + n0))
        if s < SWEEPS:
            told = keys.mapInArrow(_told(homes, scalars), _ANSWER)
            if seats is not None:
                old.append(seats)
                told = told.unionByName(_kept(seats))
            seats = materialize(blocks.groupBy("to").cogroup(told.groupBy("to"))
                                .applyInArrow(_seated(homes, d1, seed + s, count), _SEATS), "lm-seats")
            release_shuffles(spark)
            tables = seats.select("to", "homes", "ends", "tables").mapInArrow(_tables_sent, "to long, `group` long, t binary")
            keys = materialize(keys.groupBy("to").cogroup(tables.groupBy("to"))
                               .applyInArrow(_reseated(homes, scalars, seed + s, count), _KEYS), "lm-keys")
        else:
            keys = materialize(keys.mapInArrow(_ended(homes, scalars), _KEYS), "lm-keys")
        discard(*old)
        release_shuffles(spark)
    return Model(blocks, seats, keys, d1, unknown, tokens, v, groups, homes, hot)


def _list_of(model: Model):
    """Keys, logarithms of the probabilities and of the base of the most frequent pairs, at most FREQUENT_PAIRS."""
    def counts(batches):
        for b in batches:
            for x in b.column(0).to_pylist():
                c, n = np.unique(_from_planes(x, np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(n)], names=["c", "n"])
    room, least = FREQUENT_PAIRS, None
    for c, n in model.blocks.select("c").mapInArrow(counts, "c long, n long").groupBy("c").agg(F.sum("n")).orderBy(F.desc("c")).collect():
        if n > room:
            break
        room, least = room - n, c
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
    often = model.pairs_from(least).toArrow()
    u, w, _, p, wc = (often.column(i).to_numpy() for i in range(5))
    keys = _pair_key(u.view(np.uint64), w.view(np.uint64))
    order = np.argsort(keys)
    return keys[order], np.log10(p[order]), np.log10((wc[order] + 0.1) / _per_token(model))


def _per_token(model: Model) -> float:
    return model.tokens + 0.1 * (model.v + 1)


def _asker(bc, groups: int, hot, part: int):
    """Of each chunk: a row of its texts with the sums of the listed pairs, and its other pairs for their groups."""
    def run(batches):
        keys, log_p, log_base = bc.value
        for i, (u, w, size, rows) in enumerate(_chunks(batches)):
            chunk = (part << 56) + (TaskContext.get().partitionId() << 24) + i
            texts = len(size)
            doc = np.repeat(np.arange(texts), size)
            key = _pair_key(u, w)
            order = _order(key)
            first = _starts(key[order])
            times = np.diff(np.append(first, len(key)))
            key, u, w, doc = key[order[first]], u[order[first]], w[order[first]], doc[order]
            at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
            done = keys[at] == key if len(keys) else np.zeros(len(key), bool)
            each = np.repeat(done, times)
            where = np.repeat(at[done], times[done])
            sums = [np.bincount(doc[each], minlength=texts), *(np.bincount(doc[each], weights=x[where], minlength=texts) for x in (log_base, log_p))]
            ids, held = rows.column(0), rows.column(1)
            yield _answers([[-1 - chunk], TEXTS, chunk, _one(ids.fill_null(0).to_numpy()), _one(ids.is_null().to_numpy() * 2 + held.to_numpy()),
                            _one(size), _one(sums[0]), _one(np.column_stack(sums[1:]))])
            u, w, doc, times = u[~done], w[~done], doc[~each].astype(np.uint16), times[~done]
            if not len(u):
                continue
            order, runs, to, ends, run_ends = _by_group(u, w, groups, hot)
            firsts, times = (np.cumsum(times) - times)[order], times[order]
            stop = np.cumsum(times)
            doc = doc[np.repeat(firsts - (stop - times), times) + np.arange(stop[-1])]
            length = np.diff(np.append(runs, len(order))).astype(np.int32)
            yield _answers([to, ASKED, chunk, _cut(u[order][runs], run_ends), _cut_planes(length, run_ends), _cut(w[order], ends),
                            _cut_planes(times.astype(np.int32), ends), _cut_planes(doc, stop[ends - 1])])
    return run


_SUMS = ("chunk long, doc_id binary, flags binary, n_tokens binary, place binary, n_known binary, sums binary, "
         "new_place binary, new_u binary, new_w binary")


def _scorer(homes: int, d1: float, per_token: float):
    """Sums over the known pairs of each document that asks; its other pairs."""
    def run(left, right):
        texts = _of_kind(right, TEXTS)
        out = [{"chunk": x["from"], "doc_id": x["a"], "flags": x["b"], "n_tokens": x["c"], "n_known": x["d"], "sums": x["e"]} for x in texts.to_pylist()]
        asked = _of_kind(right, ASKED)
        if not asked.num_rows:
            return _table(out, _SUMS)
        if left.num_rows:
            g, p, wc = _probabilities(left, right, homes, d1)
            codes = g.of.astype(np.int64) * len(g.w) + g.at
            log_p, log_base = np.log10(p), np.log10((wc + 0.1) / per_token)
        for x in asked.to_pylist():
            u, w = (np.frombuffer(x[n], np.uint64) for n in "ac")
            r, times, doc = _from_planes(x["b"], np.int32), _from_planes(x["d"], np.int32), _from_planes(x["e"], np.uint16)
            known = np.zeros(len(w), bool)
            if left.num_rows:
                i, j = np.minimum(np.searchsorted(g.u, u), len(g.u) - 1), np.minimum(np.searchsorted(g.w, w), len(g.w) - 1)
                code = np.repeat(i, r) * len(g.w) + j
                at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                known = (codes[at] == code) & np.repeat(g.u[i] == u, r) & (g.w[j] == w)
            each = np.repeat(known, times)
            row = {"chunk": x["from"]}
            if known.any():
                d, n = doc[each], times[known]
                count = np.bincount(d)
                place = np.flatnonzero(count)
                sums = [np.bincount(d, weights=np.repeat(y, n))[place] for y in (log_base[j[known]], log_p[at[known]])]
                row |= {"place": _planes(place.astype(np.uint16)), "n_known": _planes(count[place]), "sums": np.column_stack(sums).tobytes()}
            if not known.all():
                n = times[~known]
                row |= {"new_place": doc[~each].tobytes(), "new_u": np.repeat(np.repeat(u, r)[~known], n).tobytes(), "new_w": np.repeat(w[~known], n).tobytes()}
            out.append(row)
        return _table(out, _SUMS)
    return run


_TEXT = "chunk long, place long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"


def _summed(key, t):
    """The documents of a chunk with the sums of all their known pairs."""
    rows = t.to_pylist()
    head = next(x for x in rows if x["doc_id"] is not None)
    ids, flags, size, known = (np.frombuffer(head[x], np.int64) for x in ("doc_id", "flags", "n_tokens", "n_known"))
    known, sums = known.copy(), np.frombuffer(head["sums"], np.float64).reshape(-1, 2).copy()
    for x in rows:
        if x["place"]:
            place = _from_planes(x["place"], np.uint16)
            known[place] += _from_planes(x["n_known"], np.int64)
            sums[place] += np.frombuffer(x["sums"], np.float64).reshape(-1, 2)
    n = len(ids)
    return pa.table([pa.array(np.full(n, key[0].as_py())), pa.array(np.arange(n)), pa.array(ids, mask=flags >= 2), pa.array(flags % 2 == 1),
                     pa.array(size), pa.array(known), pa.array(sums[:, 0]), pa.array(sums[:, 1])], names=[x.split()[0] for x in _TEXT.split(", ")])


def _new_pairs(batches):
    for b in batches:
        for x in b.to_pylist():
            place = np.frombuffer(x["new_place"], np.uint16).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), x["chunk"])), pa.array(place),
                                              *(pa.array(np.frombuffer(x[k], np.int64)) for k in ("new_u", "new_w"))], names=["chunk", "place", "u", "w"])


def score(rows: DataFrame, model: Model) -> DataFrame:
    """``rows``: text, doc_id, held_out.  Returns doc_id, held_out, n_tokens,
    n_known, train_tokens, base_score, score."""
    spark = rows.sparkSession
    per_token = _per_token(model)
    bc = spark.sparkContext.broadcast(_list_of(model))
    rows, known, rest = rows.select("text", "doc_id", "held_out"), None, None
    for part in range(ROUNDS):
        some = rows.filter(F.pmod(F.xxhash64("text", "doc_id"), F.lit(ROUNDS)) == part)
        asked = some.mapInArrow(_asker(bc, model.groups, model.hot, part), _ANSWER).unionByName(model.told())
        found = materialize(model.blocks.groupBy("to").cogroup(asked.groupBy("to"))
                            .applyInArrow(_scorer(model.homes, model.d1, per_token), _SUMS), "lm-scores")
        release_shuffles(spark)
        one = materialize(found.drop("new_place", "new_u", "new_w").groupBy("chunk").applyInArrow(_summed, _TEXT), "lm-texts")
        new = materialize(found.filter("new_place is not null").select("chunk", "new_place", "new_u", "new_w")
                          .mapInArrow(_new_pairs, "chunk long, place long, u long, w long"), "lm-new")
        discard(found)
        release_shuffles(spark)
        known, rest = (one, new) if known is None else (known.unionByName(one), rest.unionByName(new))
    least = max(HOT_LEAST, rest.count() // HOT_KEYS)
    hot = lambda k: rest.groupBy(k).count().filter(F.col("count") > least).select(k, F.ceil(F.col("count") / least).alias("parts"))
    ones = F.array(*[F.lit(1.0) for _ in model.unknown])
    left = lambda k, side: rest.select(k).distinct().join(side, k, "left")
    both = _with_side(_with_side(rest, left("u", model.contexts), "u", "w", hot("u")), left("w", model.words), "w", "u", hot("w"))
    p = _dot(F.coalesce("backs", ones), F.coalesce("roots", F.array(*[F.lit(x) for x in model.unknown]))) / len(model.unknown)
    new = (both.groupBy("chunk", "place")
           .agg(F.sum(F.col("c").isNotNull().cast("long")).alias("more"),
                F.sum(F.log10((F.coalesce("c", F.lit(0)) + 0.1) / F.lit(per_token))).alias("more_base"), F.sum(F.log10(p)).alias("more_score")))
    with_new = lambda c, more: F.col(c) + F.coalesce(more, F.lit(0))
    return (known.join(new, ["chunk", "place"], "left")
            .select("doc_id", "held_out", "n_tokens", with_new("n_known", "more").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
                    with_new("base", "more_base").alias("base_score"), with_new("score", "more_score").alias("score")))


def score_held_out(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", fold: int = 0, folds: int = 10) -> DataFrame:
    """Learn from all folds but one (by crc32 of the id as text); score every row."""
    text = F.col(f"`{id_col}`").cast("string")
    rows = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.coalesce(F.crc32(text.cast("binary")) % folds == fold, F.lit(False)).alias("held_out"))
    model = fit(rows.filter("not held_out").select("text"))
    out = score(rows, model)
    discard(model.blocks, model.seats)
    return out
