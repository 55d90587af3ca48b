"""Resumable bulk embedding as a Structured Streaming job (T6 + T7).

New record files landing in ``source_dir`` are embedded exactly once: the
file source remembers which files were processed in the checkpoint (kept in
the shared checkpoint folder), ``foreachBatch`` appends each micro-batch's
embeddings, and an anti join against what the sink already holds makes a
retried batch idempotent.  ``trigger(availableNow=True)`` processes what is
there and stops, so the same call both starts and resumes the work.
"""
from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.embed import embed_column, pending


def embed_stream(spark: SparkSession, source_dir: str, schema: str, out_dir: str, checkpoint: str,
                 text_col: str = "text", id_col: str = "record_id", fn: Callable | None = None,
                 max_files_per_trigger: int | None = None, **kw):
    """Start (or resume) the stream; returns the finished StreamingQuery."""
    from ..sources.io import path_exists
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.parquet(source_dir)

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        done = batch.sparkSession.read.parquet(out_dir) if path_exists(spark, out_dir) else None
        todo = pending(batch, done, id_col)
        embed_column(todo, text_col, fn, id_col, **kw).write.mode("append").parquet(out_dir)

    q = (src.writeStream.foreachBatch(write_batch)
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q
