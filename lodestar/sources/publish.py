"""Versions of a folder: staged, then committed by a manifest.

A version is written into a folder of its own; readers follow the manifest with the
highest number, which is created last, in one step (a rename that fails if the name is
taken).  A writer that dies leaves the version before it in place; two writers get two
numbers.  Rows of a run are appended as one partition by its id, so that a retry
replaces them.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MANIFESTS, VERSIONS = "_manifests", "versions"


def _fs(spark: SparkSession, path: str):
    """(file system, path maker) of the JVM for ``path``."""
    jvm = spark.sparkContext._jvm
    make = jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def _names(spark: SparkSession, root: str) -> list[str]:
    fs, make = _fs(spark, root)
    folder = make(f"{root}/{MANIFESTS}")
    if not fs.exists(folder):
        return []
    return sorted(f.getPath().getName() for f in fs.listStatus(folder) if not f.getPath().getName().startswith("."))


def current(spark: SparkSession, root: str) -> str | None:
    """The folder of the committed version, or None."""
    names = _names(spark, root.rstrip("/"))
    return f"{root.rstrip('/')}/{VERSIONS}/{names[-1].split('-', 1)[1]}" if names else None


def commit(spark: SparkSession, root: str, write: Callable[[str], None]) -> str:
    """``write(folder)`` into a new version, then make it current; returns its folder.  The
    manifest's name holds its number and the version, so that creating it is the commit."""
    root = root.rstrip("/")
    fs, make = _fs(spark, root)
    version = uuid.uuid4().hex[:16]
    folder = f"{root}/{VERSIONS}/{version}"
    write(folder)
    fs.mkdirs(make(f"{root}/{MANIFESTS}"))
    staged = make(f"{folder}/_committed")
    fs.create(staged, True).close()
    names = _names(spark, root)
    number = int(names[-1].split("-")[0]) + 1 if names else 0
    if not fs.rename(staged, make(f"{root}/{MANIFESTS}/{number:012d}-{version}")):
        raise OSError(f"cannot commit {folder}")
    return folder


def drop_old_versions(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Delete all committed versions but the last ``keep``; returns how many went."""
    root = root.rstrip("/")
    fs, make = _fs(spark, root)
    old = _names(spark, root)[:-max(keep, 1)]
    for name in old:
        fs.delete(make(f"{root}/{MANIFESTS}/{name}"), False)
        fs.delete(make(f"{root}/{VERSIONS}/{name.split('-', 1)[1]}"), True)
    return len(old)


def append_run(df: DataFrame, path: str, run_id: str | None = None) -> str:
    """Append the rows of one run; the same ``run_id`` again replaces them.  Returns the id
    (a new one if none is given), which readers see as the column ``run_id``."""
    run_id = run_id or uuid.uuid4().hex
    if not run_id.replace("-", "").replace("_", "").isalnum():
        raise ValueError("a run id has letters, digits, - and _ only")
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/run_id={run_id}")
    return run_id
