"""Packing documents into token sequences of a fixed size, with few cuts.

Every document's ids are cut into pieces of at most the sequence size.  The
pieces are dealt at random into groups of bounded expected size, and each group
is packed by itself: first-fit decreasing, where a tournament tree over the free
room of the bins finds the first bin with enough room in logarithmic time.

Only piece sizes and checksums travel, never texts or ids.  Groups depend on a
seeded draw per row, not on any key, so that no hot key fills one.

Edge cases: a null or empty text is one piece, the end id alone.  Repeated rows
and null ids are packed as rows of their own.  An empty table gives no pieces.
Other columns, whatever their names, are not read.
"""
from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .common import add_columns
from .token_counts import tokenizer_path

SIZE = 2048
GROUP_PIECES = 16384          # expected pieces of a group
CACHE_WORDS = 1_000_000       # words whose ids a worker remembers, at about 130 bytes each
MARK = b"\x01"                # stands between words that are encoded together
TOGETHER = 128                # words of one call of the library
_IDS: dict[str, tuple] = {}


def word_ids(tokenizer: str):
    """(library, remembered ids by word, those of the generation before, the mark's
    id or None) of this worker."""
    if tokenizer not in _IDS:
        from tokenizers import Tokenizer
        library = Tokenizer.from_file(tokenizer_path(tokenizer))
        mark = library.encode(MARK.decode(), add_special_tokens=False).ids
        _IDS[tokenizer] = (library, {}, {}, mark[0] if len(mark) == 1 else None)
    return _IDS[tokenizer]


def learn(words: list[bytes], library, known: dict, mark: int | None) -> None:
    """Put the ids of ``words`` into ``known``.  Words travel to the library in one
    text, a mark between them; words that hold the mark's character go alone."""
    alone = [w for w in words if MARK in w] if mark is not None else words
    for w, e in zip(alone, library.encode_batch_fast([w.decode() for w in alone], add_special_tokens=False)):
        known[w] = np.array(e.ids, "<u4").tobytes()
    if mark is None:
        return
    rest = [w for w in words if MARK not in w] if alone else words
    for at in range(0, len(rest), TOGETHER):
        some = rest[at:at + TOGETHER]
        text = (b" " + MARK + b" ").join(some).decode()
        ids = np.array(library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        marks = np.flatnonzero(ids == mark) * 4
        raw, start = ids.tobytes(), 0
        for w, end in zip(some, [*marks.tolist(), len(raw)], strict=True):
            known[w] = raw[start:end]
            start = end + 4


def encode(texts: list[bytes], tokenizer: str) -> list[bytes]:
    """Little-endian 32-bit ids of each text.  The tokenizer must drop white
    space, as the word tokenizers do: then words can be encoded one by one."""
    library, known, before, mark = word_ids(tokenizer)
    split = [t.split() for t in texts]
    new = [w for w in set().union(*split) if w not in known]
    if new:
        if len(known) + len(new) > CACHE_WORDS // 2:      # half of the cache is the generation before
            before.clear()
            before.update(known)
            known.clear()
            new = list(set().union(*split))
        for w in new:
            if w in before:
                known[w] = before[w]
        learn([w for w in new if w not in known], library, known, mark)
    get = known.__getitem__
    return [b"".join(map(get, ws)) for ws in split]


def cut(docs: DataFrame, tokenizer: str, size: int, end_id: int, text_col: str, keep: list[str]) -> DataFrame:
    """One row per piece: ``keep``, start, length, ids_crc32, doc_tokens."""
    end = np.array([end_id], "<u4").tobytes()

    def pieces(texts):
        out, total = [], []
        for ids in encode([t.as_buffer().to_pybytes() if t.is_valid else b"" for t in texts], tokenizer):
            ids += end
            n = len(ids) // 4
            total.append(n)
            out.append([{"start": s, "length": min(size, n - s), "ids_crc32": zlib.crc32(ids[4 * s:4 * (s + size)])}
                        for s in range(0, n, size)])
        piece = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        return [pa.array(total, pa.int64()), pa.array(out, pa.list_(piece))]

    rows = add_columns(docs, text_col, keep, pieces,
                       "doc_tokens long, piece array<struct<start:long,length:long,ids_crc32:long>>")
    return rows.select(*[F.col(f"`{c}`") for c in keep], F.explode("piece").alias("piece"), "doc_tokens") \
        .select(*[F.col(f"`{c}`") for c in keep], "piece.*", "doc_tokens")


def first_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece."""
    n = len(lengths)
    leaves = 1 << max(0, n - 1).bit_length()
    room = [size] * (2 * leaves)                    # a node holds its children's larger room
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[i]), 1
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        bins[i], offsets[i] = node - leaves, size - room[node]
        room[node] -= need
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return bins, offsets


def pack_pieces(pieces: DataFrame, size: int = SIZE, group_pieces: int = GROUP_PIECES, seed: int = 17) -> DataFrame:
    """``pieces`` (with a ``length``, a table that reads alike each time) with
    ``sequence_id`` and ``offset``."""
    groups = max(1, -(-pieces.count() // group_pieces))
    order = [c for c in pieces.columns]

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, kind="stable", na_position="first").reset_index(drop=True)
        bins, offsets = first_fit_decreasing(part["length"].to_numpy(), size)
        part["sequence_id"] = (part["sequence_group"].to_numpy().astype(np.int64) << 32) | bins
        part["offset"] = offsets
        return part.drop(columns="sequence_group")

    dealt = pieces.withColumn("sequence_group", F.floor(F.rand(seed) * groups).cast("long"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields]
                       + ["sequence_id long", "offset long"])
    return dealt.groupBy("sequence_group").applyInPandas(pack, schema)


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", size: int = SIZE, end_id: int = 1,
                   text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per piece: ``keep`` (default ``doc_id``), start, length, ids_crc32,
    doc_tokens, sequence_id, offset."""
    keep = ["doc_id"] if keep is None else keep
    return pack_pieces(materialize(cut(docs, tokenizer, size, end_id, text_col, keep), "pieces"), size)
