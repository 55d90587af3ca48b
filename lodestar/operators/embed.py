"""Text preparation and bulk embedding.

Text clean-up is built-in string functions.  Embedding is a ``mapInArrow``
over the text table with a caller-supplied ``fn(list[str]) -> ndarray``; the
default is a deterministic feature-hashing embedder (signed token hashes,
L2-normalised) so pipelines and tests run offline.  Resume is an anti join
of the work list against what is already written, then an append.
"""
from __future__ import annotations

from typing import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .._ship import ship_package
from ..functions.vectors import matrix_to_list

# fixed values
MAX_TOKENS_HOSTED = 8191      # token cut for the hosted embedding model
MAX_TOKENS_CAPTION = 77       # token cut for the caption encoder
MAX_BATCH = 2048              # largest batch one embedding call accepts
EMPTY_TEXT = "."              # empty strings are replaced before embedding


def clean_newlines(c) -> F.Column:
    """Newline -> space."""
    return F.replace(F.col(c) if isinstance(c, str) else c, F.lit("\n"), F.lit(" "))


def fix_empty(c) -> F.Column:
    """Null -> '' then '' -> '.'."""
    col = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.when(col == "", F.lit(EMPTY_TEXT)).otherwise(col)


def truncate_tokens(c, n: int = MAX_TOKENS_HOSTED) -> F.Column:
    """T3 (whitespace tokens): keep the first ``n`` space-separated tokens."""
    col = F.col(c) if isinstance(c, str) else c
    return F.array_join(F.slice(F.split(col, " "), 1, n), " ")


def truncate_with_tokenizer(df: DataFrame, col: str, encode: Callable, decode: Callable,
                            n: int = MAX_TOKENS_HOSTED, out: str | None = None) -> DataFrame:
    """T3 with an injected tokenizer, Arrow-batched (pandas UDF)."""

    @F.pandas_udf("string")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else decode(encode(x)[:n]))
    ship_package(df.sparkSession)
    return df.withColumn(out or col, cut(F.col(col)))


def with_prompt(c, prompt: str) -> F.Column:
    """T4: instruction prefix for query-side embedding."""
    return F.concat(F.lit(prompt), F.col(c) if isinstance(c, str) else c)


def length_ordered(df: DataFrame, col: str = "text", id_col: str | None = None,
                   partitions: int | None = None) -> DataFrame:
    """T5: longest texts first within range partitions of length (cuts
    padding); ids travel with the rows so no scatter back is needed.  The id
    is a secondary range key so equal lengths still spread over partitions."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col("__len").desc()] + ([F.col(id_col)] if id_col else [])
    return (df.withColumn("__len", F.length(col))
            .repartitionByRange(n, *keys)
            .sortWithinPartitions(*keys).drop("__len"))


def hashing_embedder(dim: int = 64, seed: int = 0) -> Callable[[list], np.ndarray]:
    """Deterministic offline embedder: signed feature hashing of lower-cased
    whitespace tokens, L2-normalised.  Vectorised per batch (one C-level
    hash over all tokens, one scatter-add)."""
    key = f"{seed:016d}"[:16]

    def fn(texts):
        s = pd.Series([t or "" for t in texts], dtype=object).str.lower().str.split()
        lens = s.map(len).to_numpy()
        out = np.zeros((len(texts), dim), dtype=np.float64)
        if lens.sum():
            toks = np.concatenate([np.asarray(x, dtype=object) for x in s if x])
            h = pd.util.hash_array(toks, hash_key=key, categorize=False)
            rows = np.repeat(np.arange(len(texts)), lens)
            sign = np.where((h >> np.uint64(63)) & np.uint64(1), 1.0, -1.0)
            np.add.at(out, (rows, (h % np.uint64(dim)).astype(np.int64)), sign)
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.maximum(n, 1e-12)).astype(np.float32)
    return fn


def embed_column(df: DataFrame, col: str, fn: Callable | None = None, id_col: str = "record_id",
                 batch: int = 256, dim: int = 64, prep: bool = True, max_tokens: int | None = None,
                 out: str = "embedding") -> DataFrame:
    """(id, embedding array<float>) for every row; ``fn`` gets at most
    ``batch`` (<= 2048) texts per call.  Whole texts are embedded; pass
    ``max_tokens=MAX_TOKENS_HOSTED`` for a model with an input limit (T3)."""
    if batch > MAX_BATCH:
        raise ValueError(f"batch must be <= {MAX_BATCH}")
    fn = fn or hashing_embedder(dim)
    ship_package(df.sparkSession)
    t = F.col(col)
    if prep:
        t = fix_empty(clean_newlines(t))
        if max_tokens:
            t = truncate_tokens(t, max_tokens)
    src = df.select(F.col(id_col).cast("long").alias("id"), t.alias("t"))

    def run(batches):
        for b in batches:
            ids = b.column(0)
            texts = b.column(1).to_pylist()
            for s in range(0, len(texts), batch):
                m = np.asarray(fn(texts[s:s + batch]), dtype=np.float64)
                yield pa.RecordBatch.from_arrays([ids.slice(s, len(texts[s:s + batch])),
                                                  matrix_to_list(m).cast(pa.list_(pa.float32()))],
                                                 names=[id_col, out])
    return src.mapInArrow(run, f"{id_col} long, {out} array<float>")


def token_batches(tokens: list[int], budget: int, most: int = MAX_BATCH) -> list[tuple[int, int]]:
    """(first, behind) of batches in the given order: rows x longest row <= ``budget``
    (a longer row is a batch of its own) and ``most`` rows."""
    out, first, longest = [], 0, 0
    for i, n in enumerate(tokens):
        longest = max(longest, n)
        if i > first and (longest * (i + 1 - first) > budget or i - first >= most):
            out.append((first, i))
            first, longest = i, n
    return out + [(first, len(tokens))] if tokens else []


def embed_in_length_order(df: DataFrame, col: str, fn: Callable | None = None, id_col: str = "record_id",
                          budget: int = 1 << 15, batch: int = MAX_BATCH, dim: int = 64, tokens=None,
                          max_tokens: int | None = None) -> DataFrame:
    """T5 + T6: (id, embedding, tokens, padded, batch_rows) of every row.  Rows go through
    ``length_ordered``; each partition forms batches of ``budget`` tokens, padding
    included, from its rows in order.  ``tokens`` makes the token count of the
    prepared text column (default: its space-separated parts); ``padded`` is the
    longest row of the row's batch, so that 1 - sum(tokens) / sum(padded) is the
    share of padding."""
    if batch > MAX_BATCH:
        raise ValueError(f"batch must be <= {MAX_BATCH}")
    fn = fn or hashing_embedder(dim)
    ship_package(df.sparkSession)
    t = fix_empty(clean_newlines(F.col(col)))
    if max_tokens:
        t = truncate_tokens(t, max_tokens)
    count = tokens or (lambda c: F.size(F.split(c, " ")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), t.alias("t")).withColumn("n", count(F.col("t")).cast("long"))
    ordered = length_ordered(rows, "t", "id")

    def run(batches):
        for b in batches:
            ids, texts, n = b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()
            for first, behind in token_batches(n, budget, batch):
                m = np.asarray(fn(texts[first:behind]), dtype=np.float64)
                size = behind - first
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, size), matrix_to_list(m).cast(pa.list_(pa.float32())), b.column(2).slice(first, size),
                     pa.array([max(n[first:behind])] * size, pa.int64()), pa.array([size] * size, pa.int64())],
                    names=[id_col, "embedding", "tokens", "padded", "batch_rows"])
    return ordered.mapInArrow(run, f"{id_col} long, embedding array<float>, tokens long, padded long, batch_rows long")


def pending(todo: DataFrame, done: DataFrame | None, id_col: str = "record_id") -> DataFrame:
    """Rows not yet embedded (anti join on the key)."""
    if done is None:
        return todo
    return todo.join(done.select(id_col), id_col, "left_anti")


def embed_resumable(df: DataFrame, col: str, path: str, fn: Callable | None = None,
                    id_col: str = "record_id", **kw) -> DataFrame:
    """Embed only what ``path`` does not hold yet, append, return all.
    Safe to re-run after a failure: written rows are never recomputed."""
    from ..sources.io import path_exists
    spark = df.sparkSession
    done = spark.read.parquet(path) if path_exists(spark, path) else None
    todo = pending(df, done, id_col)
    if todo.limit(1).count():
        embed_column(todo, col, fn, id_col, **kw).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def embed_pairs(items: DataFrame, captions: DataFrame, item_col: str, caption_col: str,
                item_fn: Callable | None = None, text_fn: Callable | None = None,
                item_id: str = "doc_id", caption_id: str = "q_id"):
    """Two-tower embedding of items and their captions (independent
    passes; the keys keep them aligned)."""
    return (embed_column(items, item_col, item_fn, item_id),
            embed_column(captions, caption_col, text_fn, caption_id))
