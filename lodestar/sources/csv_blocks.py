"""CSV with records over several lines, read by many tasks per file.

A file is read as text lines, in the blocks that Spark deals out.  Whether a line
starts inside a quoted field depends on all lines before it, so that every block
first gives its map of that state, {outside, inside} -> {outside, inside}.  The maps
are composed along the file (a running window over one small row per block), then
each block cuts its lines into records from its true state.  Records within a block
are done; what crosses block ends travels as fragments to the block that it started
in.  ``from_csv`` parses the records, with the options of Spark's own reader.

A quote opens a field only at its start; inside a quoted field two quotes are one.
A file may lack the last line end.  Line ends are \\n or \\r\\n.  Every file has the
same header.  Blank lines outside of quotes are no records, as in Spark's reader.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .._ship import ship_package

OPTIONS = {"escape": '"', "multiLine": "true"}
BLOCK = ["path", "start"]


def ends_inside(line: str, inside: bool, sep: str = ",") -> bool:
    """Whether a line that starts outside or inside a quoted field ends inside one."""
    at = 0
    while True:
        if inside:
            quote = line.find('"', at)
            if quote < 0:
                return True
            if line[quote + 1:quote + 2] == '"':
                at = quote + 2
                continue
            inside, at = False, quote + 1
        elif line[at:at + 1] == '"':
            inside, at = True, at + 1
            continue
        at = line.find(sep, at) + 1
        if not at:
            return False


def _lines(batches):
    """(path, start of the block, line) of Arrow batches."""
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns])


def _maps(sep: str):
    """One row per block: the state after it if it starts outside and if it starts
    inside, and whether it gets outside from inside."""
    def row(key, out, into, closes):
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, out, into, closes)],
                                          names=[*BLOCK, "from_outside", "from_inside", "closes"])

    def run(batches):
        key = None
        for path, start, line in _lines(batches):
            if (path, start) != key:
                if key:
                    yield row(key, out, into, closes)
                key, out, into, closes = (path, start), False, True, False
            if '"' in line:
                out, into = ends_inside(line, out, sep), ends_inside(line, into, sep)
                closes = closes or not into
        if key:
            yield row(key, out, into, closes)
    return run


def block_states(maps: DataFrame) -> DataFrame:
    """(path, start, inside, opener): the state at the start of each block, and the block
    that its first record started in, where that is an earlier one."""
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    swap = F.col("from_outside") & ~F.col("from_inside")
    fixed = F.when(F.col("from_outside") == F.col("from_inside"), F.struct("from_outside", F.col("swaps").alias("at")))
    counted = maps.withColumn("swaps", F.sum(swap.cast("int")).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    last = counted.withColumn("last", F.last(fixed, ignorenulls=True).over(before)) \
        .withColumn("so_far", F.coalesce(F.sum(swap.cast("int")).over(before), F.lit(0)))
    odd = (F.col("so_far") - F.coalesce("last.at", F.lit(0))) % 2 == 1
    states = last.withColumn("inside", F.coalesce("last.from_outside", F.lit(False)) != odd)
    starts = F.when(~F.col("inside") | F.col("closes"), F.col("start"))
    return states.withColumn("opener", F.last(starts, ignorenulls=True).over(before)) \
        .select(*BLOCK, "inside", F.when(F.col("inside"), F.col("opener")).alias("opener"))


def _records(sep: str):
    """Whole records (part 0) and fragments: (path, block the record started in, block of the
    text, part, text, first record of its file).  Parts: 1 opens, 2 goes on."""
    kinds = {"path": pa.string(), "opener": pa.int64(), "start": pa.int64(), "part": pa.int32(), "text": pa.string(), "head": pa.bool_()}

    def rows(held):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds.values())], names=list(kinds))

    def run(batches):
        held, key, lines = [], None, []
        for b in batches:
            for path, start, line, begins_inside, opener in zip(*[c.to_pylist() for c in b.columns]):
                if (path, start) != key:
                    if lines:
                        held.append((*key, key[1], 1, "\n".join(lines), head) if whole else (key[0], first, key[1], 2, "\n".join(lines), False))
                    key, lines, inside, whole, first, head = (path, start), [], begins_inside, not begins_inside, opener, start == 0
                lines.append(line)
                inside = ends_inside(line, inside, sep) if '"' in line else inside
                if not inside:
                    if not whole:
                        held.append((path, first, start, 2, "\n".join(lines), False))
                    elif len(lines) > 1 or line.strip("\r"):
                        held.append((path, start, start, 0, "\n".join(lines), head))
                        head = False
                    lines, whole = [], True
            if len(held) >= 4096:
                yield rows(held)
                held = []
        if lines:
            held.append((*key, key[1], 1, "\n".join(lines), head) if whole else (key[0], first, key[1], 2, "\n".join(lines), False))
        if held:
            yield rows(held)
    return run


def csv_records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(text, head): the records of all files, headers marked."""
    ship_package(spark)
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))
    states = block_states(lines.mapInArrow(_maps(sep), "path string, start long, from_outside boolean, from_inside boolean, closes boolean"))
    # one row per block (input bytes / spark.sql.files.maxPartitionBytes); a hash join keeps the order of the lines
    placed = lines.join(F.broadcast(states), BLOCK).select(*BLOCK, "line", "inside", "opener")
    found = placed.mapInArrow(_records(sep), "path string, opener long, start long, part int, text string, head boolean")
    whole = found.filter("part = 0").select("text", "head")
    crossing = (found.filter("part > 0").groupBy("path", "opener")
                .agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("parts"), F.max("head").alias("head")))
    joined = crossing.select(F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"), "head")
    return whole.unionByName(joined)


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Header CSV, all columns strings, null where a field is empty and unquoted."""
    options = {**OPTIONS, "sep": sep}
    names = spark.read.options(header="true", **options).csv(path).columns
    schema = StructType([StructField(f"c{i}", StringType()) for i in range(len(names))])
    if not names:
        return spark.createDataFrame([], schema)
    body = csv_records(spark, path, sep).filter(~F.col("head"))
    record = F.from_csv(F.rtrim(F.col("text"), F.lit("\r")), schema.simpleString(), options)
    return body.select(record.alias("r")).select(*[F.col("r")[f"c{i}"].alias(n) for i, n in enumerate(names)])
