"""Cut lineage by writing a table to the shared checkpoint folder.

Reading it back gives every later job the same numbers (no recomputation
with a different summation order) and survives executor loss.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..session import shared_dir


def materialize(df: DataFrame, name: str, partition_by: list | None = None) -> DataFrame:
    path = shared_dir(df.sparkSession, f"{name}-{uuid.uuid4().hex[:12]}")
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the folders of tables that ``materialize`` wrote and nothing reads any
    more (what was made of them has been written itself)."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        conf = t.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
