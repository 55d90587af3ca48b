"""Removal of repeated passages by super-k-mer partitioning.

A window is 13 consecutive words.  Its minimiser is the word triple in it with
the least hash, the leftmost on ties; consecutive windows of one document that
share the same triple travel as one packed string to the triple's bucket.  There
the strings are sorted by the least document id that has them, so that the first
one seen with a window is the window's first document; every other document's
window is marked.  Windows are compared as words, not as hashes.

Equal strings of one task travel once, with the places they come from: a passage
that a third of all documents share reaches its bucket as one row for each task.
A task's strings for one part of the buckets go compressed as one block; Spark
sorts them after unpacking.
A bucket is read as a stream; it holds its distinct windows, not their places.

Marks return as ranges of words and are joined to the documents again.  The
packed strings' shuffle is released before that join.

Edge cases: null text has no words.  A row without an id neither removes nor
loses words.  Rows that share an id are one document where their texts are equal
and documents of equal id otherwise; neither removes words of the other, as
neither id is smaller.  Texts under 13 words stay.  Other columns are not read.
"""
from __future__ import annotations

import gc
import hashlib
import struct
from array import array

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .._ship import ship_package
from ..plans.materialize import materialize
from .common import add_columns, slices
from .words import gram_hashes, split_words, word_hashes

WINDOW, TRIPLE = 13, 3
FLUSH_BYTES = 64 << 20       # of packed strings held by a task
STRING_BYTES, PLACE_BYTES = 200, 24   # what a string takes beside its words, and a place
PARTS_PER_PARTITION = 4
TAG_BITS, START_BITS = 24, 39
_PLACE = struct.Struct("<qq")


def tag_of(text: bytes) -> int:
    """Tells rows of one id apart by their text; Spark's xxhash64 gives the same."""
    return xxhash.xxh64_intdigest(text, 42) & ((1 << TAG_BITS) - 1)


def super_kmers(hashes: np.ndarray, window: int = WINDOW, gram: int = TRIPLE):
    """(first window, last window, minimiser) of each run of windows that share
    their minimiser's place, for one document's word hashes."""
    n = len(hashes) - window + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    grams = gram_hashes(hashes, gram)
    best, at = grams[:n].copy(), np.arange(n)
    for k in range(1, window - gram + 1):
        less = grams[k:k + n] < best
        best = np.where(less, grams[k:k + n], best)
        at = np.where(less, np.arange(k, k + n), at)
    cuts = np.flatnonzero(np.diff(at)) + 1
    first = np.concatenate([[0], cuts])
    last = np.concatenate([cuts, [n]]) - 1
    return first, last, best[first].view(np.int64)


def _block(keys: list[bytes], bucket: np.ndarray, places: np.ndarray, doc: np.ndarray, start: np.ndarray) -> bytes:
    """Packed strings with their buckets and places, compressed."""
    head = np.array([len(keys)], np.int64)
    size = np.fromiter(map(len, keys), np.int32, len(keys))
    columns = (head, bucket, size, places.astype(np.int32), doc, start)
    return zstandard.compress(b"".join([*(c.tobytes() for c in columns), *keys]), 3)


def _unpacked(batches):
    """Rows (bucket, least id, packed words, places) of the blocks."""
    for b in batches:
        for block in b.column(0):
            raw = zstandard.decompress(block.as_buffer())
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            at = 8

            def take(kind, count):
                nonlocal at
                out = np.frombuffer(raw, kind, count, at)
                at += out.nbytes
                return out

            bucket, size, places = take(np.int64, n), take(np.int32, n), take(np.int32, n)
            total = int(places.sum())
            doc, start = take(np.int64, total), take(np.int64, total)
            first = np.concatenate([[0], np.cumsum(places)])
            words = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
            for a in range(0, n, 20_000):
                z = min(n, a + 20_000)
                p, q = int(first[a]), int(first[z])
                yield pa.RecordBatch.from_arrays([
                    pa.array(bucket[a:z]), pa.array(np.minimum.reduceat(doc[p:q], first[a:z] - p)),
                    _binary(raw[at + int(words[a]):at + int(words[z])], words[a:z + 1] - words[a]),
                    _binary(np.stack([doc[p:q], start[p:q]], 1).tobytes(), (first[a:z + 1] - p) * 16),
                ], names=["bucket", "least", "words", "places"])


def _binary(data: bytes, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1,
                                 [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data)])


def _packer(parts: int):
    def run(batches):
        return _packed(batches, parts)
    return run


def _packed(batches, parts: int):
    """Blocks (part, compressed strings) of one task's documents."""
    held: dict[bytes, int] = {}                 # the number of a string
    buckets, of, docs, starts = (array("q") for _ in range(4))      # by string; by place: its string, document and start
    size = 0

    def flush():
        keys = list(held)
        held.clear()
        bucket, string, doc, begin = (np.array(c, np.int64) for c in (buckets, of, docs, starts))
        for c in (buckets, of, docs, starts):
            del c[:]
        part = bucket.view(np.uint64) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        part, bucket = part[order].astype(np.int64), bucket[order]
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.arange(len(keys))
        string = rank[string]
        places = np.bincount(string, minlength=len(keys))
        by_string = np.argsort(string, kind="stable")
        doc, begin = doc[by_string], begin[by_string]
        first = np.concatenate([[0], np.cumsum(places)])
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(keys)] if keys else [0]
        for a, z in zip(cuts, cuts[1:]):
            p, q = first[a], first[z]
            block = _block([keys[i] for i in order[a:z].tolist()], bucket[a:z], places[a:z], doc[p:q], begin[p:q])
            yield pa.RecordBatch.from_arrays([pa.array([int(part[a])], pa.int64()), pa.array([block], pa.binary())],
                                             names=["part", "block"])

    for b in batches:
        for start, n in slices(b.column(0)):
            part = b.slice(start, n)
            texts, ids = part.column(0), part.column(1).to_pylist()
            words = split_words(texts)
            hashes = word_hashes(words)
            for i, (doc, ws) in enumerate(zip(ids, words)):
                if doc is None or len(ws) < WINDOW:
                    continue
                tag = tag_of(texts[i].as_buffer().to_pybytes()) << START_BITS
                first, last, bucket = super_kmers(hashes[i])
                line = b" ".join(ws)
                ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1)
                begin = np.concatenate([[0], ends])[first].tolist()
                end = (ends[last + WINDOW - 1] - 1).tolist()
                for a, p, q, m in zip(first.tolist(), begin, end, bucket.tolist()):
                    key = line[p:q]
                    if (at := held.get(key)) is None:
                        at = held[key] = len(held)
                        buckets.append(m)
                        size += q - p + STRING_BYTES
                    of.append(at)
                    docs.append(doc)
                    starts.append(tag | a)
                    size += PLACE_BYTES
            if size > FLUSH_BYTES:
                yield from flush()
                size = 0
    yield from flush()


_MARK = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("from", pa.int64()), ("to", pa.int64())])


def _marked(batches):
    """Ranges of words to remove, from rows sorted by bucket and least id."""
    bucket, first = None, {}
    waiting = None                              # the bucket's first row: most buckets have no other
    out: list[tuple] = []

    def look(least, line, places):
        at = [-1]
        while (p := line.find(b" ", at[-1] + 1)) >= 0:
            at.append(p)
        at.append(len(line))
        seen = [first.setdefault(line[at[k] + 1:at[k + WINDOW]], least) for k in range(len(at) - WINDOW)]
        low = min(seen)
        for doc, where in _PLACE.iter_unpack(places):
            if doc <= low:
                continue
            tag, start = where >> START_BITS, where & ((1 << START_BITS) - 1)
            open_at = -1
            for k, d in enumerate(seen):
                if d < doc:
                    if open_at < 0:
                        open_at = k
                elif open_at >= 0:
                    out.append((doc, tag, start + open_at, start + k - 1 + WINDOW))
                    open_at = -1
            if open_at >= 0:
                out.append((doc, tag, start + open_at, start + len(seen) - 1 + WINDOW))

    def written():
        rows = list(zip(*out)) or [()] * 4
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], schema=_MARK)

    def close():
        nonlocal waiting
        if waiting is not None and len(waiting[2]) > _PLACE.size:
            look(*waiting)
        waiting = None

    for b in batches:
        for m, *row in zip(*(c.to_pylist() for c in b.columns)):
            if m != bucket:
                close()
                first.clear()
                bucket, waiting = m, row
                continue
            if waiting is not None:
                look(*waiting)
                waiting = None
            look(*row)
        yield written()
    close()
    yield written()


def release_shuffles(spark) -> None:
    """Let Spark delete the files of shuffles that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def repeated_ranges(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, tag, from, to): words covered by windows that start in a document of smaller id too."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{id_col}`").cast("long").alias("doc_id"))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = rows.mapInArrow(_packer(PARTS_PER_PARTITION * partitions), "part long, block binary")
    return (packed.repartition(partitions, "part").select("block")
            .mapInArrow(_unpacked, "bucket long, least long, words binary, places binary")
            .sortWithinPartitions("bucket", "least")
            .mapInArrow(_marked, "doc_id long, tag long, `from` long, `to` long"))


def _kept(texts: pa.Array, ranges: pa.Array) -> list[pa.Array]:
    words, removed, sha, kept = [], [], [], []
    for ws, cuts in zip(split_words(texts), ranges.to_pylist()):
        n = len(ws)
        if cuts:
            drop = np.zeros(n + 1, np.int64)
            for c in cuts:
                drop[c["from"]] += 1
                drop[c["to"]] -= 1
            keep = np.cumsum(drop[:n]) == 0
            ws = [w for w, k in zip(ws, keep.tolist()) if k]
        line = b" ".join(ws)
        words.append(n)
        removed.append(n - len(ws))
        sha.append(hashlib.sha256(line).hexdigest())
        kept.append(line)
    return [pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()),
            pa.array(kept, pa.binary()).cast(pa.string())]


def remove_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: the id, n_words, n_removed, kept_sha256 and kept_text (words joined by one space)."""
    spark = docs.sparkSession
    ranges = materialize(repeated_ranges(docs, text_col, id_col), "repeated-ranges")
    release_shuffles(spark)
    per_row = (ranges.groupBy("doc_id", "tag")
               .agg(F.collect_list(F.struct("from", "to")).alias("ranges"))
               .select(F.col("doc_id").alias("mark_id"), F.col("tag").alias("mark_tag"), "ranges"))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")) \
        .withColumn("tag", F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit((1 << TAG_BITS) - 1)))
    joined = rows.join(per_row, (F.col("doc_id").cast("long") == F.col("mark_id")) & (F.col("tag") == F.col("mark_tag")), "left")
    schema = "n_words long, n_removed long, kept_sha256 string, kept_text string"

    def both(texts_and_ranges):
        return _kept(texts_and_ranges.field("text"), texts_and_ranges.field("ranges"))

    return add_columns(joined.select("doc_id", F.struct("text", "ranges").alias("both")), "both", ["doc_id"], both, schema)
