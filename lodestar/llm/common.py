"""Shared helpers of the training-data operators."""
from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
SPACE_CHARS = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_array(text: Column) -> Column:
    """The words of a text; null has none.  Splitting at one literal character
    is several times faster than at a pattern."""
    spaced = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), SPACE_CHARS[1:], F.coalesce(text, F.lit("")))
    return F.array_remove(F.split(spaced, " "), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it
    inside a lambda (a plain column would be inlined and recomputed there)."""
    return F.transform(F.array(value), body)[0]


def column_name(df: DataFrame, wanted: str) -> str:
    """A name that no column of ``df`` has, for a helper column."""
    have = {c.lower() for c in df.columns}
    while wanted.lower() in have:
        wanted = f"_{wanted}"
    return wanted


#: Texts are handled in slices of about this many bytes, whatever the batch.
SLICE_BYTES = 4 << 20


def slices(texts) -> list[tuple[int, int]]:
    """(start, length) of runs of rows with about SLICE_BYTES of text each."""
    import pyarrow as pa
    import pyarrow.compute as pc
    if pa.types.is_struct(texts.type):
        texts = texts.field("text")
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    out, start, total = [], 0, 0
    for i, n in enumerate(sizes):
        total += int(n) + 64
        if total >= SLICE_BYTES:
            out.append((start, i + 1 - start))
            start, total = i + 1, 0
    if start < len(sizes):
        out.append((start, len(sizes) - start))
    return out


def add_columns(df: DataFrame, text_col: str, keep: list[str], fn, schema: str) -> DataFrame:
    """The ``keep`` columns and what ``fn`` makes of the text column, a list of
    arrays of the fields in ``schema``; in Arrow batches, without a shuffle."""
    import pyarrow as pa
    from pyspark.sql.types import StructType

    from .._ship import ship_package
    ship_package(df.sparkSession)
    fields = StructType.fromDDL(schema).fields
    out = StructType([*df.select(*[F.col(f"`{c}`") for c in keep]).schema.fields, *fields])
    names = [f.name for f in out.fields]

    def run(batches):
        for b in batches:
            for start, n in slices(b.column(0)):
                part = b.slice(start, n)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *fn(part.column(0))], names=names)

    return df.select(F.col(f"`{text_col}`").alias(column_name(df, "input")),
                     *[F.col(f"`{c}`") for c in keep]).mapInArrow(run, out)
