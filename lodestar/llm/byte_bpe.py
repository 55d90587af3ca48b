"""Byte-level BPE: encoding and decoding with a public file of ranks.

The tokenizers library encodes Arrow batches.  Its model works on characters, so that
every byte stands for one printable character; each pair of known tokens whose join is
known is a merge, in the order of the join's rank.  The split pattern cuts a text into
matches, each of which is merged by itself.  Decoding turns ids back into bytes by the
reversed table; a token may hold a part of a character, so that bytes become text only
when all tokens of a row are joined.

A match of the pattern never goes on from another character into white space, nor from a
letter into a stop or comma, so that a text falls into units there.  A worker remembers the
tokens of the units it has met; the library gets the new ones.  What a task holds is bounded
by a batch of texts.

Edge cases: a null or empty text has no tokens; null ids decode to null, no ids to
nothing.  An id that is not in the file is an error.  Repeated rows stay rows.  An empty
table gives no rows.  Only the named columns are read.
"""
from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from .._ship import ship_package
from .common import add_columns, column_name
from .token_counts import tokenizer_path

RANKS = "byte_bpe_multi_50k.tiktoken"
KNOWN_UNITS = 500_000         # units that a worker remembers, at about 200 bytes each
LONG_UNIT = 100               # characters; longer ones are not remembered
ROWS = 512                    # rows that are handled together
#: The characters with the property White_Space.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNIT = re.compile(f"[{WHITE}]*[A-Za-z]+(?=[.,;:!?])|[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
INNER = re.compile(f"[{WHITE}]+[^{WHITE}]")
_LOADED: dict[str, tuple] = {}
_KNOWN: dict[tuple, dict] = {}


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if it is printed and no blank,
    else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b if b in shown else next(other)) for b in range(256)]


def read_ranks(name: str) -> dict[bytes, int]:
    with open(tokenizer_path(name), "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def library(name: str):
    """(the library's tokenizer, bytes of each id, their number) of a file of ranks, on this worker."""
    if name not in _LOADED:
        from public_tokenizers import PATTERN
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers
        ranks, char = read_ranks(name), byte_characters()
        shown = {token: "".join([char[b] for b in token]) for token in ranks}
        merges = [(shown[t[:k]], shown[t[k:]]) for t in sorted(ranks, key=ranks.get)
                  for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        made = Tokenizer(models.BPE({shown[t]: i for t, i in ranks.items()}, merges, ignore_merges=True))
        made.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(Regex(PATTERN), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        byte = {c: b for b, c in enumerate(char)}
        raw = {i: bytes([byte[c] for c in made.id_to_token(i)]) for i in ranks.values()}
        width = np.zeros(max(raw) + 1, np.int64)
        width[list(raw)] = [len(b) for b in raw.values()]
        _LOADED[name] = made, raw, width
    return _LOADED[name]


def learn(units: list[str], name: str, known: dict, offsets: bool) -> None:
    """Put the tokens of ``units`` into ``known``: bytes of the ids, with ``offsets`` also those
    of the first characters and of the characters after the last.

    Units that open with white space and end with another character travel to the library
    in one text; the bytes of the tokens tell where each ends."""
    made, _, width = library(name)
    if offsets:
        for at in range(0, len(units), ROWS):
            some = units[at:at + ROWS]
            for unit, e in zip(some, made.encode_batch(some, add_special_tokens=False)):
                places = np.array(e.offsets, np.int32).reshape(-1, 2)
                known[unit] = np.array(e.ids, np.int32).tobytes(), places[:, 0].tobytes(), places[:, 1].tobytes()
        return
    inner = [bool(INNER.match(u)) for u in units]
    alone, rest = [u for u, i in zip(units, inner) if not i], [u for u, i in zip(units, inner) if i]
    for unit, e in zip(alone, made.encode_batch_fast(alone, add_special_tokens=False)):
        known[unit] = np.array(e.ids, np.int32).tobytes()
    for at in range(0, len(rest), ROWS):
        some = rest[at:at + ROWS]
        ids = np.array(made.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, np.int32)
        stops = np.searchsorted(np.cumsum(width[ids]), np.cumsum([len(u.encode()) for u in some])) + 1
        raw, start = ids.tobytes(), 0
        for unit, stop in zip(some, (4 * stops).tolist()):
            known[unit] = raw[start:stop]
            start = stop


def encoded(texts: list[str | None], name: str, offsets: bool = False) -> list[tuple]:
    """(ids,) of each text, or (ids, first characters, characters after the last)."""
    known = _KNOWN.setdefault((name, offsets), {})
    units = [UNIT.findall(t or "") for t in texts]
    new = list(set().union(*units) - known.keys())
    learn(new, name, known, offsets)
    out = []
    for some in units:
        found = [known[u] for u in some]
        if not offsets:
            out.append((np.frombuffer(b"".join(found), np.int32),))
            continue
        columns = [np.frombuffer(b"".join(column), np.int32) for column in zip(*found)] or [np.zeros(0, np.int32)] * 3
        ends = np.cumsum([len(u) for u in some])
        shift = np.repeat(ends - [len(u) for u in some], [len(f[0]) // 4 for f in found]).astype(np.int32)
        out.append((columns[0], columns[1] + shift, columns[2] + shift))
    if len(known) > KNOWN_UNITS:
        known.clear()
    for unit in new:
        if len(unit) > LONG_UNIT:
            known.pop(unit, None)
    return out


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *arrays])))


def encode(docs: DataFrame, ranks: str = RANKS, text_col: str = "text", keep: list[str] | None = None,
           offsets: bool = False) -> DataFrame:
    """``keep`` (default ``doc_id``) and ``ids``; with ``offsets`` also ``starts`` and
    ``ends`` of each token in characters (tokens that share a character all hold it)."""
    names = ["ids", "starts", "ends"][:3 if offsets else 1]

    def run(texts):
        found = encoded(texts.to_pylist(), ranks, offsets)
        return [_lists([f[k] for f in found]) for k in range(len(names))]

    return add_columns(docs, text_col, ["doc_id"] if keep is None else keep, run, ", ".join(f"{n} array<int>" for n in names))


def decode(tokens: DataFrame, ranks: str = RANKS, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default ``doc_id``), the ``decoded`` bytes, and ``decoded_text``, where a
    character that is not whole reads as U+FFFD."""
    ship_package(tokens.sparkSession)
    keep = ["doc_id"] if keep is None else keep
    rows = tokens.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{ids_col}`").alias(column_name(tokens, "input")))
    out = StructType([*rows.schema.fields[:-1], StructField("decoded", BinaryType()), StructField("decoded_text", StringType())])

    def run(batches):
        of = library(ranks)[1].__getitem__
        for b in batches:
            for start in range(0, b.num_rows, ROWS):
                some = b.slice(start, ROWS)
                raw = [None if ids is None else b"".join(map(of, ids)) for ids in some.columns[-1].to_pylist()]
                text = [None if r is None else r.decode(errors="replace") for r in raw]
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(raw, pa.binary()), pa.array(text, pa.string())],
                                                 names=out.names)

    return rows.mapInArrow(run, out)


def round_trip(docs: DataFrame, ranks: str = RANKS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Ids of every text and the bytes that they decode to: ``id_col``, ``ids``, ``decoded``."""
    ids = encode(docs, ranks, text_col, [id_col])
    return decode(ids, ranks, "ids", [id_col, "ids"]).select(id_col, "ids", "decoded")


def digests(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Number of tokens and checksums of ids (decimal, joined by commas) and bytes."""
    written = F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary")
    return rows.select(id_col, F.size("ids").cast("long").alias("n_tokens"), F.sha2(written, 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
