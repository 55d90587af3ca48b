"""Token counts of byte-level BPE by compiled finite-state transducers.

Two deterministic transducers read a text:

1. The *splitter* over character classes marks where a piece starts.  Its eight
   states are few enough to run a chunk from every state at once: a chunk is a
   map from entry state to exit state.  The maps of all chunks compose by a
   parallel prefix scan; then every chunk runs once from its true entry state.
2. The *merger* over bytes counts the tokens of a piece.  Its state holds, for
   every suffix of the prefix read that a token could still extend, the place in
   the token trie, the last token before the suffix, and the count there against
   the count here.  A byte leads to exactly one new last token, the one whose
   pair with its predecessor survives merging; the change in the count is the
   transition's annotation.  States and transitions are compiled when a byte
   first needs them and kept in tables, which all pieces of a batch step through
   side by side.  The tables are cleared when full, which costs time only.

Character classes are asked of the library once per code point, so that its
Unicode version holds.  Special strings inside a text count as one token each
and split it, the library's default.

Edge cases: a null or empty text has 0 bytes and 0 tokens.  Rows are counted one
by one, in whole: a long text is cut only before a blank between two words, where
a piece starts in any case.  Repeated rows and null ids pass through; other
columns, whatever their names, are not read.
"""
from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns

# --- the splitter ---------------------------------------------------------
# Symbols: letter, number, other, apostrophe before a one- or two-letter ending,
# a blank / other space before a further space or the end, the same before
# anything else, and the end of a segment.
LETTER, NUMBER, OTHER, AP1, AP2, BLANK, SPACE, BLANK_LAST, SPACE_LAST, END = range(10)
# States: piece ended, in letters, numbers, others, after a joining blank, in
# spaces, one and two letters of an ending to come.
FREE, IN_L, IN_N, IN_O, JOIN, IN_S, END1, END2 = range(8)
STATES, SYMBOLS, CHUNK = 8, 10, 64


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    to = np.zeros((STATES, SYMBOLS), np.uint8)
    mark = np.ones((STATES, SYMBOLS), np.uint8)
    for symbol, state in ((LETTER, IN_L), (NUMBER, IN_N), (OTHER, IN_O)):
        to[:, symbol] = state
        mark[[state, JOIN], symbol] = 0
    to[END1, LETTER], mark[END1, LETTER] = FREE, 0
    to[END2, LETTER], mark[END2, LETTER] = END1, 0
    for symbol, state in ((AP1, END1), (AP2, END2)):
        to[:, symbol] = state
        to[[IN_O, JOIN], symbol] = IN_O
        mark[[IN_O, JOIN], symbol] = 0
    for symbol in (BLANK, SPACE):
        to[:, symbol] = IN_S
        mark[IN_S, symbol] = 0
    to[:, BLANK_LAST], to[:, SPACE_LAST], to[:, END] = JOIN, FREE, FREE
    return to.ravel(), mark.ravel()


_TO, _MARK = _splitter()


def piece_starts(symbols: np.ndarray) -> np.ndarray:
    """1 where a piece starts: chunk maps, their prefix scan, then the marks."""
    n = len(symbols)
    blocks = -(-n // CHUNK) if n else 0
    padded = np.full(blocks * CHUNK, END, np.intp)
    padded[:n] = symbols
    lanes = np.ascontiguousarray(padded.reshape(blocks, CHUNK).T)
    maps = np.repeat(np.arange(STATES, dtype=np.intp)[:, None], blocks, axis=1)
    for row in lanes:
        maps = _TO[maps * SYMBOLS + row].astype(np.intp)
    step = 1
    while step < blocks:                      # maps[:, i] := maps[:, i - step] then maps[:, i]
        maps[:, step:] = np.take_along_axis(maps[:, step:], maps[:, :-step], axis=0)
        step *= 2
    state = np.concatenate([[FREE], maps[FREE, :-1]]) if blocks else np.zeros(0, np.intp)
    marks = np.empty((CHUNK, blocks), np.uint8)
    for k, row in enumerate(lanes):
        at = state * SYMBOLS + row
        marks[k] = _MARK[at]
        state = _TO[at].astype(np.intp)
    return marks.T.ravel()[:n]


class Classes:
    """Class of each code point, asked of the library when it is first seen."""

    def __init__(self, splits):
        self.splits = splits                  # text -> number of pieces
        self.of = np.full(0x110000, 255, np.uint8)
        self.of[10], self.of[32] = SPACE, BLANK

    def __call__(self, points: np.ndarray) -> np.ndarray:
        got = self.of[points]
        if (got == 255).any():
            for p in np.unique(points[got == 255]):
                c = chr(p)
                self.of[p] = (LETTER if self.splits("a" + c) == 1 else NUMBER if self.splits("1" + c) == 1
                              else OTHER if self.splits("!" + c) == 1 else SPACE)
            got = self.of[points]
        return got


ONE = np.array([ord(c) for c in "stmd"])


def symbols_of(points: np.ndarray, ends: np.ndarray, classes: Classes) -> np.ndarray:
    """Symbols of code points; ``ends`` marks the separators between segments."""
    s = classes(points).astype(np.intp)
    s[ends] = END
    after = np.concatenate([s[1:], [END]])
    last = (after != BLANK) & (after != SPACE) & (after != END)
    s[(s == BLANK) & last] = BLANK_LAST
    s[(s == SPACE) & last] = SPACE_LAST
    ap = np.flatnonzero((points == 39) & (s == OTHER))
    if len(ap):
        wide = np.concatenate([np.where(ends, 0, points), [0, 0]])
        one, two = wide[ap + 1], wide[ap + 2]
        pair = (((one == 114) | (one == 118)) & (two == 101)) | ((one == 108) & (two == 108))
        s[ap[pair]] = AP2
        s[ap[np.isin(one, ONE)]] = AP1
    return s


# --- the merger -----------------------------------------------------------
class Merger:
    """Lazily compiled transducer: byte by byte, the change in the token count."""

    LIMIT = 200_000                           # states kept at once
    WIDTH = 64                                # columns to begin with

    def __init__(self, merges: list[tuple[bytes, bytes]], singles):
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.tokens: dict[bytes, int] = {}
        for t in [*singles, *(a + b for a, b in merges)]:
            self.tokens.setdefault(t, len(self.tokens))
        self.text = list(self.tokens)
        self.child: dict[int, int] = {}       # node << 8 | byte -> node
        self.token_at: dict[int, int] = {}
        self.inner: set[int] = {0}
        nodes = 1
        for t, i in self.tokens.items():
            node = 0
            for b in t:
                self.inner.add(node)
                node, seen = self.child.get(key := node << 8 | b, 0), node
                if not node:
                    node = self.child[key] = nodes
                    nodes += 1
            self.token_at[node] = i
        self.pairs: dict[int, bool] = {}
        self._clear()

    def _clear(self):
        self.ids = {((0, -1, 0),): 0}
        self.states = [((0, -1, 0),)]
        self.step = np.full((4096, self.WIDTH), -1, np.int32)    # next state << 8 | change + 128
        self.column = np.full(256, -1, np.intp)                 # columns of the bytes met so far
        self.byte: list[int] = []

    def encode(self, piece: bytes) -> list[bytes]:
        """Plain merging, lowest rank first."""
        parts = [bytes([b]) for b in piece]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 30))
            pair = (parts[best], parts[best + 1])
            if pair not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def survives(self, left: int, right: int) -> bool:
        """True if merging the two tokens' text gives the two tokens."""
        key = left << 20 | right
        if (got := self.pairs.get(key)) is None:
            a, b = self.text[left], self.text[right]
            got = self.pairs[key] = self.encode(a + b) == [a, b]
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
        return got

    def advance(self, state: tuple, byte: int) -> tuple[tuple, int]:
        """The state after ``byte`` and the change in the count."""
        grown, last, count = [], -1, 0
        for node, before, rel in state:
            node = self.child.get(node << 8 | byte, 0)
            if not node:
                continue
            token = self.token_at.get(node, -1)
            if last < 0 and token >= 0 and (before < 0 or self.survives(before, token)):
                last, count = token, rel + 1
            if node in self.inner:
                grown.append((node, before, rel))
        # the longest token is tried first: suffixes stand longest first
        return (*((n, b, r - count) for n, b, r in grown), (0, last, 0)), count

    def columns(self, data: np.ndarray) -> np.ndarray:
        """The column of each byte; bytes not met before get one."""
        got = self.column[data]
        if len(got) and got.min() < 0:
            for b in np.unique(data[got < 0]).tolist():
                self.column[b] = len(self.byte)
                self.byte.append(b)
            if len(self.byte) > self.step.shape[1]:
                self.step = np.hstack([self.step, np.full_like(self.step, -1)])
            got = self.column[data]
        return got

    def compile(self, state: int, column: int) -> None:
        new, count = self.advance(self.states[state], self.byte[column])
        if (i := self.ids.get(new)) is None:
            i = self.ids[new] = len(self.states)
            self.states.append(new)
            if i >= len(self.step):
                self.step = np.vstack([self.step, np.full_like(self.step, -1)])
        self.step[state, column] = i << 8 | count + 128          # a token has at most 128 bytes

    def counts(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each piece of ``data``."""
        if len(self.states) > self.LIMIT:
            self._clear()
        data = self.columns(data)
        width = self.step.shape[1]
        order = np.argsort(-lengths, kind="stable")
        where, left = starts[order], lengths[order]
        state = np.zeros(len(order), np.intp)
        total = np.zeros(len(order), np.int64)
        alive, k = len(order), 0
        longest = int(left[0]) if len(order) else 0
        ends = np.searchsorted(-left, -np.arange(longest), side="left")   # pieces longer than k
        while k < longest:
            alive = int(ends[k])
            at = state[:alive] * width + data[where[:alive] + k]
            found = self.step.ravel()[at]
            if found.min() < 0:
                for key in np.unique(at[found < 0]).tolist():
                    self.compile(*divmod(key, width))
                found = self.step.ravel()[at]
            total[:alive] += (found & 255) - 128
            state[:alive] = found >> 8
            k += 1
        out = np.empty(len(order), np.int64)
        out[order] = total
        return out


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter:
    """Token counts as the library gives them for a byte-level BPE file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if (spec["model"]["type"], pre.get("type"), pre.get("use_regex"), pre.get("add_prefix_space"),
                spec.get("normalizer")) != ("BPE", "ByteLevel", True, False, None):
            raise ValueError(f"{path}: byte-level BPE with its own pattern and no normalizer is expected")
        pieces = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.classes = Classes(lambda t: len(pieces(t)))
        byte = _byte_of_char()
        raw = lambda t: bytes(byte[c] for c in t)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.merger = Merger([(raw(a), raw(b)) for a, b in merges], [bytes([b]) for b in range(256)])
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def __call__(self, texts: list[str]) -> np.ndarray:
        """Token counts of whole texts."""
        segments, owner = [], []
        extra = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if self.special is not None and self.special.search(text):
                extra[i] = len(self.special.findall(text))
                parts = [p for p in self.special.split(text) if p]
            else:
                parts = [text] if text else []
            segments += parts
            owner += [i] * len(parts)
        if not segments:
            return extra
        joined = "\n".join(segments) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.zeros(len(points), bool)
        chars = np.array([len(s) + 1 for s in segments])
        ends[np.cumsum(chars) - 1] = True
        marks = piece_starts(symbols_of(points, ends, self.classes)).astype(bool)
        data = np.frombuffer(joined.encode(), np.uint8)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        begins = lead[marks]
        own = np.repeat(np.array(owner), chars)[marks]
        real = ~ends[marks]
        lengths = np.diff(np.append(begins, len(data)))
        counts = self.merger.counts(data, begins[real], lengths[real])
        return extra + np.bincount(own[real], weights=counts, minlength=len(texts)).astype(np.int64)


_COUNTERS: dict[str, Counter] = {}
PART = 1 << 21
CUT = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")


def _parts(text: str):
    """``text`` in parts, cut before a blank between two letters."""
    at = 0
    while len(text) - at > PART and (m := CUT.search(text, at + PART)):
        yield text[at:m.start()]
        at = m.start()
    yield text[at:]


def tokenizer_path(name_or_path: str) -> str:
    """A file's place on this machine: a path, or a name of the public tokenizers."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers
    return public_tokenizers.path(name_or_path)


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", text_col: str = "text",
                 keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default ``doc_id``), ``n_bytes`` and ``n_tokens``."""
    def count(texts):
        if tokenizer not in _COUNTERS:
            _COUNTERS[tokenizer] = Counter(tokenizer_path(tokenizer))
        counter = _COUNTERS[tokenizer]
        values = pc.fill_null(texts, "").to_pylist()
        if max(map(len, values), default=0) <= PART:
            n = counter(values)
        else:
            n = np.array([sum(int(counter([p])[0]) for p in _parts(v)) for v in values], np.int64)
        size = pc.cast(pc.fill_null(pc.binary_length(texts), 0), pa.int64())
        return [size, pa.array(n, pa.int64())]

    return add_columns(docs, text_col, ["doc_id"] if keep is None else keep, count, "n_bytes long, n_tokens long")


def with_limit(counted: DataFrame, limit: int = 1024) -> DataFrame:
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
