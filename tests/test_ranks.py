import numpy as np
from pyspark.sql import functions as F

from lodestar.operators.ranks import ordered_index, prefix_sum


def test_prefix_sum_equals_cumsum_with_ties(spark):
    rng = np.random.default_rng(5)
    vals = rng.integers(0, 50, 500).astype(float)
    sg = rng.choice([-1, 1], 500)
    df = spark.createDataFrame([(float(v), int(s)) for v, s in zip(vals, sg)], "value double, s long")
    g = df.groupBy("value").agg(F.sum("s").alias("net"))
    got = sorted((r["value"], r["total"]) for r in prefix_sum(g, "value", "net", "total", buckets=4).collect())
    u = sorted(set(vals))
    net = {v: int(sg[vals == v].sum()) for v in u}
    cum = np.cumsum([net[v] for v in u])
    assert got == list(zip(u, cum.tolist()))


def test_index_is_dense_and_ordered(spark):
    df = spark.range(0, 1000).select(((F.col("id") * 7919) % 1000).alias("k"))
    r = ordered_index(df, [F.col("k")], "i").collect()
    assert sorted((x["k"], x["i"]) for x in r) == [(i, i) for i in range(1000)]


def test_range_count_follows_data_size(spark, monkeypatch):
    """Ranges stay under the bound, also where one value of the first column is hot."""
    from lodestar.operators import ranks
    df = spark.range(0, 3000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 11).alias("a"), ((F.col("id") * 7919) % 3000).alias("k"))
    monkeypatch.setattr(ranks, "ROWS_PER_BUCKET", 150)
    order = [F.col("a"), F.desc("k")]
    sizes = [r["count"] for r in ranks.in_ranges(df, order).groupBy("__bk").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) <= 150
    got = [(r.a, -r.k) for r in ordered_index(df, order, "i").orderBy("i").collect()]
    assert got == sorted(got) and len(got) == 3000


def test_input_is_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    df = spark.range(0, 500).mapInArrow(look, "id long")
    assert ordered_index(df, [F.desc("id")], "i").filter("i + id <> 499").count() == 0 and seen.value == 500


def test_bucket_count_follows_data_size(spark, monkeypatch):
    from lodestar.operators import ranks
    df = spark.range(0, 3000).select(((F.col("id") * 7919) % 3000).alias("k"), F.lit(1).alias("v"))
    monkeypatch.setattr(ranks, "ROWS_PER_BUCKET", 1000)
    assert 1 <= len(ranks._bounds(df, "k", 8)) <= 3
    r = prefix_sum(df, "k", "v", "i", buckets=8).collect()
    assert sorted((x["k"], x["i"]) for x in r) == [(i, i + 1) for i in range(3000)]
    monkeypatch.setattr(ranks, "ROWS_PER_BUCKET", 10 ** 9)
    assert ranks._bounds(df, "k", 8) == []
