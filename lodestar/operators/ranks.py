"""Global prefix sums and dense row indexes without a single-task window.

Rows are range-bucketed on a numeric key using bounds from
``percentile_approx`` (a handful of scalars); per-bucket totals (at most
``buckets`` rows) give each bucket its offset; inside a bucket an ordinary
partitioned window finishes the running sum.  Equal keys always share a
bucket, so the result equals the global ordered running sum.  Give it a
unique key: a value repeated by a third of all rows would land in one bucket,
i.e. one task.  Dense ids come from ``ordered_index``, which deals the rows out
by ranges of all columns of their order.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import discard, materialize

ROWS_PER_BUCKET = 2_000_000   # rows one bucket's window may hold (bounded, spillable)
RANGES_MOST = 1_000_000       # ranges of one order


def _bounds(df: DataFrame, key: str, buckets: int) -> list:
    """Range bounds from one aggregate job (row count + quantiles); the bucket
    count is cut to what the data needs, so small inputs get one bucket."""
    if buckets <= 1:
        return []
    qs = [i / buckets for i in range(1, buckets)]
    r = df.agg(F.count(F.lit(1)).alias("n"),
               F.percentile_approx(F.col(key).cast("double"), qs, 10000).alias("b")).first()
    need = max(1, -(-int(r["n"] or 0) // ROWS_PER_BUCKET))
    if need <= 1:
        return []
    b = [x for x in (r["b"] or []) if x is not None]
    step = max(1, len(b) // (need - 1)) if need < buckets else 1
    return sorted(set(b[step - 1::step]))


def bucket_of(key: str, bounds: list) -> Column:
    if not bounds:
        return F.lit(0)
    arr = F.array(*[F.lit(float(b)) for b in bounds])
    k = F.col(key).cast("double")
    return F.size(F.filter(arr, lambda b: b < k))


def _offsets(totals: DataFrame) -> DataFrame:
    """Totals of the buckets before; at most `buckets` rows, an ordered window over them is trivial."""
    return totals.withColumn("__off", F.coalesce(F.sum("__t").over(
        Window.orderBy("__bk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def prefix_sum(df: DataFrame, key: str, value: Column | str, out: str,
               order: list | None = None, buckets: int | None = None,
               max_rows: int | None = None) -> DataFrame:
    """Inclusive running sum of ``value`` in the order ``order`` (default:
    ``key``); ``order`` must sort by ``key`` first.  ``max_rows`` is a known
    upper bound of the row count: when it fits one bucket, no bounds job runs."""
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = order or [F.col(key)]
    val = F.col(value) if isinstance(value, str) else value
    if max_rows is not None and max_rows <= ROWS_PER_BUCKET:
        buckets = 1
    bounds = _bounds(df, key, buckets)
    b = df.withColumn("__bk", bucket_of(key, bounds)).withColumn("__v", val)
    tot = b.groupBy("__bk").agg(F.sum("__v").alias("__t"))
    off = _offsets(tot)
    w = Window.partitionBy("__bk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (b.join(F.broadcast(off.select("__bk", "__off")), "__bk")
            .withColumn(out, F.col("__off") + F.sum("__v").over(w))
            .drop("__bk", "__v", "__off"))


def in_ranges(df: DataFrame, order: list) -> DataFrame:
    """``df`` dealt out by ranges of ``order`` (columns of any type, together unique)
    and written, with its range ``__bk``; ranges follow each other in that order.
    The input is written first, so that it is computed once and the ranges are taken
    from the rows that are dealt.  A range of more than ``ROWS_PER_BUCKET`` rows makes
    the written rows be dealt again, over more ranges."""
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(df, "order-input")
    while True:
        dealt = materialize(rows.repartitionByRange(buckets, *order).withColumn("__bk", F.spark_partition_id()), "ordered")
        largest = dealt.groupBy("__bk").count().agg(F.max("count")).first()[0] or 0
        if largest <= ROWS_PER_BUCKET or buckets >= RANGES_MOST:
            discard(rows)
            return dealt
        discard(dealt)
        buckets = min(RANGES_MOST, buckets * -(-2 * largest // ROWS_PER_BUCKET))


def ordered_index(df: DataFrame, order: list, out: str) -> DataFrame:
    """Dense 0-based global index in the order of several columns of any type
    (together unique).  Each range counts on from the rows of the ranges before it;
    one hot value of the first column spreads over many ranges."""
    b = in_ranges(df, order)
    off = _offsets(b.groupBy("__bk").agg(F.count(F.lit(1)).alias("__t")))
    w = Window.partitionBy("__bk").orderBy(*order)
    return (b.join(F.broadcast(off.select("__bk", "__off")), "__bk")
            .withColumn(out, F.col("__off") + F.row_number().over(w) - 1).drop("__bk", "__off"))
