"""Benchmark decontamination by template canonicalisation.

Numbers, names (capitalised words that occur inside a sentence) and units after a number
become typed placeholders; every run of 8 tokens of the result is a template
window.  The windows of documents are hash-joined to those of the benchmark; windows
poor in literal tokens are joined by their tokens and values, too, and those without
any literal by these alone.  Where windows meet, document and item are aligned and
the tokens compared: literal tokens must be equal, and the values in the slots must
replace the item's values one to one throughout the document, as they do where a
question was given other parameters.  A window poor in literals counts where its
values are the item's, where the aligned run around it holds the literals of a full
window, or where the whole item aligns.  A document is a leak of an item when
consistent windows cover 60 % of the item's tokens.

Each text is also read without name slots, so that a copy that lost its
punctuation or its capitals still meets its item.

The benchmark side is the stated query set: it is broadcast in blocks of a
bounded number of windows, and every document is read against every block.

Edge cases: null and empty texts match nothing.  Items of fewer than 8 tokens
have one window, the whole item; items of fewer than 4 tokens are only met by
documents that are as long.  Rows of equal id are read one by one and their
pairs are merged, the widest kept; null ids pass through.  Items with equal
texts each get their pair.  Other columns are not read.
"""
from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .._ship import ship_package
from .common import slices
from .words import gram_hashes

WINDOW = 8
LEAST_WORDS = 5               # literal tokens of a full window that isn't poor in them
COVER = 0.6
KNOWN_TOKENS = 400_000        # distinct tokens that a task remembers
BLOCK_ITEMS = 20_000          # items of a broadcast block
BLOCK_TOKENS = 1_000_000      # tokens of a broadcast block
TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+(?:['’-][^\W\d_]+)*|[.!?…:;\n]")
# Units that follow a number.
UNITS = frozenset("""mm cm m km in inch inches ft foot feet yard yards mile miles mg g kg lb lbs oz ounce ounces ton tons
ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month
months year years percent degrees dollars dollar cents euros euro pounds mph kmh""".split())
NUM, NAME, UNIT = 1, 2, 3     # slot kinds; 0 is a literal
EXACT = np.uint64(0x5851F42D4C957F2D)


class Reader:
    """Token tables of a task: one entry per distinct token."""

    def __init__(self):
        self.ids: dict[str, int] = {}
        self.low: list[str] = []
        self.hash: list[int] = []
        self.kind: list[int] = []             # 0 word, 1 capitalised word, 2 unit, 3 number, 4 mark

    def add(self, t: str) -> int:
        low = t.lower()
        self.low.append(low)
        self.hash.append(xxhash.xxh64_intdigest(low))
        self.kind.append(4 if t in ".!?…:;\n" else 3 if t[0].isdigit() else 2 if low in UNITS else int(t[0].isupper()))
        i = self.ids[t] = len(self.ids)
        return i

    def tokens(self, text: str) -> list[int]:
        get, add = self.ids.get, self.add
        return [add(t) if (i := get(t)) is None else i for t in TOKEN.findall(text)]


SLOT = np.array([0, *(xxhash.xxh64_intdigest(f"<{n}>") for n in ("number", "name", "unit"))], np.uint64)


def templates(ids: np.ndarray, hashes: np.ndarray, kinds: np.ndarray):
    """(token ids without marks, [(slots, canonical hashes) with names, the same without], numbers and units)."""
    kind = kinds[ids]
    keep = kind != 4
    before = np.concatenate([[4], kind[:-1]])
    ids, kind, before = ids[keep], kind[keep], before[keep]
    slots = np.zeros(len(ids), np.int8)
    slots[kind == 3] = NUM
    slots[(kind == 2) & (before == 3)] = UNIT
    named = slots.copy()
    inside = (kind == 1) & (before != 4)
    named[inside | ((kind == 1) & np.isin(ids, ids[inside]))] = NAME
    return ids, [(s, np.where(s > 0, SLOT[s], hashes[ids])) for s in (named, slots)], (kind == 2) | (kind == 3)


def least(size: int) -> int:
    """Literal tokens of a window of ``size`` that isn't poor in them."""
    return -(-LEAST_WORDS * size // WINDOW)


def literals(slots: np.ndarray, size: int) -> np.ndarray:
    """Literal tokens of each window of ``size`` tokens."""
    n = np.cumsum(np.concatenate([[0], slots == 0]))
    return n[size:] - n[:-size]


def windows(slots: np.ndarray, canon: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the windows of ``size`` tokens with a literal."""
    h = gram_hashes(canon, size)
    at = np.flatnonzero(literals(slots, size)) if len(h) else np.zeros(0, np.int64)
    return at, h[at]


def exact_windows(hard: np.ndarray, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes of the tokens) of the windows poor in tokens other than numbers and units."""
    poor = np.flatnonzero(literals(hard, size) < least(size)) if len(hard) >= size else np.zeros(0, np.int64)
    return poor, (gram_hashes(hashes, size) ^ EXACT)[poor] if len(poor) else np.zeros(0, np.uint64)


class Items:
    """Windows of a block of benchmark items."""

    def __init__(self, rows):
        self.reader = Reader()
        self.texts: list[tuple] = []          # item_id, tokens, [slots, slots]
        entries = defaultdict(lambda: defaultdict(list))
        for item_id, text in rows:
            raw = np.array(self.reader.tokens(text or ""), np.int64)
            hashes = np.array(self.reader.hash, np.uint64)
            ids, kinds, hard = templates(raw, hashes, np.array(self.reader.kind, np.int8))
            if not len(ids):
                continue
            k = len(self.texts)
            self.texts.append((item_id, [self.reader.low[i] for i in ids], [s.tolist() for s, _ in kinds]))
            size = min(WINDOW, len(ids))
            for variant, (at, h) in enumerate([*(windows(*x, size) for x in kinds), exact_windows(hard, hashes[ids], size)]):
                for p, x in zip(at.tolist(), h.tolist()):
                    entries[size][x].append((k, p, variant))
        self.entries = {size: dict(e) for size, e in entries.items()}
        self.filters = {}
        for size, e in self.entries.items():
            f = np.zeros(1 << 22, bool)
            f[np.fromiter(e, np.uint64, len(e)) & np.uint64((1 << 22) - 1)] = True
            self.filters[size] = f
        self.reader = None


def aligned(tokens, slots, own, words, shift: int, size: int):
    """(first, behind) of the runs of ``size`` tokens or more where an item and a document are alike."""
    start = None
    for q in range(max(0, -shift), min(len(tokens), len(words) - shift) + 1):
        alike = q < len(tokens) and q + shift < len(words) and (
            tokens[q] == words[q + shift] or (slots[q] > 0 and slots[q] == own[q + shift]))
        if alike and start is None:
            start = q
        elif not alike and start is not None:
            if q - start >= size:
                yield start, q
            start = None


def matches(ids, variants, hard, hashes, low, items: Items) -> list[tuple]:
    """(item index, covered tokens, changed slots) of the items that a document leaks."""
    met = defaultdict(int)                    # (item, variant, diagonal) -> windows
    for size, filt in items.filters.items():
        if len(ids) < size or (size < 4 and len(ids) != size):
            continue
        for variant, (at, h) in enumerate([*(windows(*x, size) for x in variants), exact_windows(hard, hashes, size)]):
            for j in np.flatnonzero(filt[h & np.uint64((1 << 22) - 1)]).tolist():
                for k, p, v in items.entries[size].get(int(h[j]), ()):
                    if v == variant:
                        met[k, min(variant, 1), int(at[j]) - p] += 1
    if not met:
        return []
    by_item = defaultdict(list)
    for (k, variant, shift), n in met.items():
        by_item[k, variant].append((-n, shift))
    words = [low[i] for i in ids.tolist()]
    all_own = [s.tolist() for s, _ in variants]
    best: dict[int, tuple] = {}
    for (k, variant), shifts in by_item.items():
        _, tokens, item_slots = items.texts[k]
        slots, own = item_slots[variant], all_own[variant]
        size = min(WINDOW, len(tokens))
        covered, changed, to, back = set(), set(), {}, {}
        for _, shift in sorted(shifts):       # the longest alignment sets the values
            for first, behind in aligned(tokens, slots, own, words, shift, size):
                n = slots[first:behind].count(0)
                rich = n >= LEAST_WORDS or (n > 0 and behind - first == len(tokens))
                for p in range(first, behind - size + 1):
                    pairs = [(slots[q], tokens[q], words[q + shift], q) for q in range(p, p + size) if slots[q]]
                    if not (rich or size - len(pairs) >= least(size) or all(x == y for _, x, y, _ in pairs)):
                        continue
                    new, old = {}, {}
                    if all(new.setdefault((s, x), to.get((s, x), y)) == y and old.setdefault((s, y), back.get((s, y), x)) == x
                           for s, x, y, _ in pairs):
                        to.update(new)
                        back.update(old)
                        changed.update(q for _, x, y, q in pairs if x != y)
                        covered.update(range(p, p + size))
        if len(covered) >= COVER * len(tokens) and len(covered) > best.get(k, (0,))[0]:
            best[k] = (len(covered), len(changed))
    return [(k, *v) for k, v in sorted(best.items())]


_OUT = "item_index int, covered_tokens long, changed_slots long"


def _finder(bc, id_type):
    def run(batches):
        items: Items = bc.value
        reader = Reader()
        for b in batches:
            for start, n in slices(b.column(0)):
                part = b.slice(start, n)
                rows = []
                if len(reader.low) > KNOWN_TOKENS:
                    reader = Reader()
                texts = [np.array(reader.tokens(t), np.int64) if t else None for t in part.column(0).to_pylist()]
                hashes, kinds = np.array(reader.hash, np.uint64), np.array(reader.kind, np.int8)
                for doc, raw in zip(part.column(1).to_pylist(), texts):
                    if raw is not None and len(raw):
                        ids, variants, hard = templates(raw, hashes, kinds)
                        rows += [(doc, *r) for r in matches(ids, variants, hard, hashes[ids], reader.low, items)]
                cols = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], id_type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()),
                     pa.array(cols[3], pa.int64())], names=["doc_id", "item_index", "covered_tokens", "changed_slots"])
    return run


def _blocks(benchmark: DataFrame, text_col: str, id_col: str):
    """Items of the benchmark, read in order, in bounded blocks."""
    rows, size = [], 0
    for r in benchmark.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t")).toLocalIterator():
        rows.append((r["i"], r["t"]))
        size += len(r["t"] or "") // 4
        if len(rows) >= BLOCK_ITEMS or size >= BLOCK_TOKENS:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def leaks(docs: DataFrame, benchmark: DataFrame, doc_text: str = "text", doc_id: str = "doc_id",
          item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(doc_id, item_id, item_tokens, covered_tokens, changed_slots) of every leak."""
    rows = docs.select(F.col(f"`{doc_text}`").alias("text"), F.col(f"`{doc_id}`").alias("doc_id"))
    return _leaks(rows, benchmark, item_text, item_id)


def _leaks(rows: DataFrame, benchmark: DataFrame, item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The leaks of ``rows`` (text, doc_id of any type)."""
    from pyspark.sql.pandas.types import to_arrow_type
    spark = rows.sparkSession
    ship_package(spark)
    kind, item_kind = rows.schema["doc_id"].dataType, benchmark.schema[item_id].dataType
    schema = f"doc_id {kind.simpleString()}, {_OUT}"
    found = None
    for block in _blocks(benchmark, item_text, item_id):
        items = Items(block)
        names = spark.createDataFrame(
            [(k, t[0], len(t[1])) for k, t in enumerate(items.texts)],
            f"item_index int, item_id {item_kind.simpleString()}, item_tokens long")
        part = rows.mapInArrow(_finder(spark.sparkContext.broadcast(items), to_arrow_type(kind)), schema) \
            .join(F.broadcast(names), "item_index").drop("item_index")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"doc_id {kind.simpleString()}, item_id {item_kind.simpleString()}, "
                                         "item_tokens long, covered_tokens long, changed_slots long")
    return found.groupBy("doc_id", "item_id", "item_tokens").agg(
        F.max(F.struct("covered_tokens", (-F.col("changed_slots")).alias("c"))).alias("best")) \
        .select("doc_id", "item_id", "item_tokens", "best.covered_tokens", (-F.col("best.c")).alias("changed_slots"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that leak an item (rows without an id stay).  Rows of
    equal id are judged by their texts."""
    def tag(text):
        return F.xxhash64(F.coalesce(text, F.lit("")))
    rows = docs.select("text", F.struct(F.col("doc_id").alias("id"), tag(F.col("text")).alias("tag")).alias("doc_id"))
    bad = _leaks(rows, benchmark).select(F.col("doc_id.id").alias("leaked_id"), F.col("doc_id.tag").alias("leaked_tag")).distinct()
    return docs.join(bad, (docs["doc_id"] == bad["leaked_id"]) & (tag(docs["text"]) == bad["leaked_tag"]), "left_anti")
