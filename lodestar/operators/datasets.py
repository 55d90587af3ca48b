"""Dataset building operators (O1-O23): flattening, dedup, judgments,
referential checks, seeded splits, dense keys, train-first order.

All of it is DataFrame algebra: explode / semi and anti joins / two-phase
aggregates; ordered dense ids use the bucketed prefix count in ``ranks``
rather than an unpartitioned window.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .joins import keep_keys, missing_keys, small
from .ranks import ordered_index

# fixed values
DEV_FRACTION, DEV_CAP = 0.1, 10000
TEST_FRACTION, TEST_CAP = 0.2, 10000
DEFAULT_PASSAGE_ID = "0"

PROVENANCE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("input", T.StringType()),
    T.StructField("output", T.ArrayType(T.StructType([
        T.StructField("answer", T.StringType()),
        T.StructField("provenance", T.ArrayType(T.StructType([
            T.StructField("wikipedia_id", T.StringType()),
            T.StructField("start_paragraph_id", T.IntegerType()),
        ]))),
    ]))),
])


# ------------------------------------------------------------ O1-O4 nesting
def flatten_provenance(kilt: DataFrame) -> DataFrame:
    """O1: per query the distinct (page, paragraph) pairs over all outputs;
    outputs without provenance are skipped.  A query's outputs may stand in one
    row or in several (``part``)."""
    o = kilt.select("id", F.explode_outer("output").alias("o"))
    p = o.select("id", F.explode("o.provenance").alias("p"))
    return (p.select("id", F.col("p.wikipedia_id").alias("wikipedia_id"),
                     F.col("p.start_paragraph_id").alias("start_paragraph_id"))
            .dropDuplicates(["id", "wikipedia_id", "start_paragraph_id"]))


def queries_with_provenance(kilt: DataFrame) -> DataFrame:
    """O2: drop queries without any provenance (semi join on O1).  Of a query in
    parts the row of its input (part 0) is returned."""
    prov = flatten_provenance(kilt).select("id").distinct()
    queries = kilt.filter("part = 0") if "part" in kilt.columns else kilt
    return queries.join(prov, "id", "left_semi")


def referenced_pages(*flat: DataFrame) -> DataFrame:
    """O3: distinct referenced page ids over several flattened query sets."""
    u = flat[0].select("wikipedia_id")
    for f in flat[1:]:
        u = u.unionByName(f.select("wikipedia_id"))
    return u.distinct()


def pages_to_passages(pages: DataFrame, referenced: DataFrame) -> DataFrame:
    """One row per paragraph (position, right-trimmed) of referenced pages.
    ``pages`` has (wikipedia_id string, text array<string>)."""
    p = keep_keys(pages, referenced, "wikipedia_id")
    return p.select(F.col("wikipedia_id").alias("doc_id"),
                    F.posexplode("text").alias("passage_id", "text")).select(
        "doc_id", F.col("passage_id").cast("string").alias("passage_id"),
        F.regexp_replace("text", r"\s+$", "").alias("text"))


# ------------------------------------------------------------ O5-O11
def first_non_null_by_key(files: list[DataFrame], key: str = "doc_id", value: str = "text", pos: str | None = None) -> DataFrame:
    """Union of files; per key the first non-null value by (file order, position);
    sorted by key.  Without a position column a key repeated in one file gives its
    least value."""
    u = None
    for i, f in enumerate(files):
        x = f.select(key, value, F.lit(i).alias("__src"), (F.col(pos) if pos else F.lit(0)).alias("__pos"))
        u = x if u is None else u.unionByName(x)
    r = (u.filter(F.col(value).isNotNull()).groupBy(key)
         .agg(F.min_by(value, F.struct("__src", "__pos", value)).alias(value)))
    return r.orderBy(key)


def dedup_queries_by_text(files: list[DataFrame], pos: str = "pos") -> DataFrame:
    """Union of query files; dedup on text, keep the first q_id by
    (file order, position)."""
    u = None
    for i, f in enumerate(files):
        x = f.select("q_id", "input", pos, F.lit(i).alias("__src"))
        u = x if u is None else u.unionByName(x)
    return (u.filter(F.col("q_id").isNotNull()).groupBy("input")
            .agg(F.min_by("q_id", F.struct("__src", pos)).alias("q_id")))


MAX_ANSWERS_PER_ROW = 100_000


def judgment_sets(qrels: DataFrame, pos: str | None = None,
                  max_per_row: int = MAX_ANSWERS_PER_ROW) -> DataFrame:
    """Per query the answer set (sorted ids) and the {doc: rel} map;
    the last grade wins on repeated pairs (by ``pos``, else the max grade).

    A query with more than ``max_per_row`` answers is spread over several
    rows (``part``) by a hash of the answer id, sized from a partial count, so
    no single group collects an unbounded list; ordinary queries get one row
    with ``part = 0``."""
    key = "record_id" if "record_id" in qrels.columns else "doc_id"
    last = (F.max_by("rel", pos) if pos else F.max("rel")).alias("rel")
    d = qrels.groupBy("q_id", key).agg(last)
    n = d.groupBy("q_id").agg(F.count(F.lit(1)).alias("__n"))
    parts = F.ceil(F.col("__n") / F.lit(max_per_row)).cast("long")
    d = (d.join(n, "q_id").withColumn(
        "part", F.when(parts <= 1, F.lit(0).cast("long"))
        .otherwise(F.pmod(F.xxhash64(F.col(key)), parts))).drop("__n"))
    return d.groupBy("q_id", "part").agg(
        F.array_sort(F.collect_list(key)).alias("answers"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "rel")))).alias("rels"))


def unjudged_queries(queries: DataFrame, judgments: DataFrame) -> DataFrame:
    """Queries without judgments (must be empty for a valid set)."""
    return queries.join(judgments.select("q_id").distinct(), "q_id", "left_anti")


def assert_all_judged(queries: DataFrame, judgments: DataFrame) -> None:
    if unjudged_queries(queries, judgments).limit(1).count():
        raise ValueError("some queries have no judgments")


def repair_missing_docs(queries: DataFrame, qrels: DataFrame, corpus: DataFrame,
                        key: str = "doc_id") -> DataFrame:
    """Drop every query with any judged doc missing from the corpus."""
    gone = missing_keys(qrels, corpus, key)
    bad = qrels.join(gone, key, "left_semi").select("q_id").distinct()
    return queries.join(bad, "q_id", "left_anti")


def with_default_passage(docs: DataFrame) -> DataFrame:
    """Constant passage id."""
    return docs.withColumn("passage_id", F.lit(DEFAULT_PASSAGE_ID))


def pool_splits(splits: dict[str, tuple[DataFrame, bool]]) -> tuple[DataFrame, bool]:
    """Union of the pre-splits present; grades are kept only when
    every present split has them."""
    u, graded = None, True
    for name, (df, has_rel) in splits.items():
        x = df.withColumn("pre_split", F.lit(name))
        u = x if u is None else u.unionByName(x)
        graded = graded and bool(has_rel)
    return u, graded


def pool_judgments(splits: dict[str, tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """O11 with answers and grades: (queries, judgments) of the pre-splits present, in their
    order, as one set.  Queries get a dense ``q_id`` over (pre-split, old id), kept as
    ``pre_split`` and ``old_q_id``; their judgments follow by that key.  ``grade`` is kept
    only if every pre-split has grades (some rel above 1), else null."""
    queries, judgments = None, None
    for place, (name, (q, j)) in enumerate(splits.items()):
        q = q.withColumnRenamed("q_id", "old_q_id").withColumn("pre_split", F.lit(name)).withColumn("__p", F.lit(place))
        j = j.select(F.lit(name).alias("pre_split"), F.col("q_id").alias("old_q_id"), "record_id", "rel")
        queries = q if queries is None else queries.unionByName(q)
        judgments = j if judgments is None else judgments.unionByName(j)
    pooled = ordered_index(queries, [F.col("__p"), F.col("old_q_id")], "q_id").drop("__p")
    flags = judgments.groupBy("pre_split").agg((F.max("rel") > 1).alias("graded")).agg(
        F.bool_and("graded").alias("all_graded"), F.count(F.lit(1)).alias("present"))
    one = judgments.groupBy("pre_split", "old_q_id", "record_id").agg(F.max("rel").alias("rel"))
    graded = F.col("all_graded") & (F.col("present") == len(splits))
    keyed = one.join(pooled.select("pre_split", "old_q_id", "q_id"), ["pre_split", "old_q_id"])
    return pooled, keyed.join(F.broadcast(flags)).select("q_id", "record_id", F.when(graded, F.col("rel")).alias("grade"))


# ------------------------------------------------------------ O12-O23
def split_sizes(n: int) -> tuple[int, int, int]:
    dev = min(DEV_CAP, int(DEV_FRACTION * n))
    test = min(TEST_CAP, int(TEST_FRACTION * n))
    return n - dev - test, dev, test


def seeded_split(queries: DataFrame, seed: int = 0, key: str = "q_id") -> DataFrame:
    """Permutation by md5(seed:key); train, dev, test take consecutive
    ranges of it with the reference sizes.  Adds ``split``."""
    h = F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col(key).cast("string")))
    r = ordered_index(queries.withColumn("__h", h), [F.col("__h"), F.col(key)], "__perm")
    n_tr, n_dev, _ = split_sizes(r.count())
    split = (F.when(F.col("__perm") < n_tr, "train")
             .when(F.col("__perm") < n_tr + n_dev, "dev").otherwise("test"))
    return r.withColumn("split", split).drop("__h", "__perm")


def dense_ids(df: DataFrame, order_key: str, out: str = "record_id", order: list | None = None) -> DataFrame:
    """Dense 0-based ids over an explicit order column, or the columns ``order``."""
    return ordered_index(df, order or [F.col(order_key)], out)


def judged_only(queries: DataFrame, judgments: DataFrame) -> DataFrame:
    """Judged queries, one row each, ordered by q_id."""
    return queries.join(judgments.select("q_id").distinct(), "q_id", "left_semi").orderBy("q_id")


def train_first_order(records: DataFrame, judgments: DataFrame, train_dev_queries: DataFrame) -> DataFrame:
    """Records answering any train/dev query first, then the rest; both
    stable by old record_id; adds ``new_id``."""
    ans = (judgments.join(train_dev_queries.select("q_id"), "q_id", "left_semi")
           .select("record_id").distinct().withColumn("__t", F.lit(1)))
    r = records.join(small(ans), "record_id", "left").withColumn("__t", F.lit(1) - F.coalesce("__t", F.lit(0)))
    return ordered_index(r, [F.col("__t"), F.col("record_id")], "new_id").drop("__t")


def answerable_cut(records: DataFrame, judgments: DataFrame, train_dev_queries: DataFrame):
    """m = max(answer id over train+dev)+1 -> (answerable, nontrain),
    nontrain is None when empty.  Expects train-first ids (O16)."""
    ans = judgments.join(train_dev_queries.select("q_id"), "q_id", "left_semi")
    m = ans.agg(F.max("record_id")).first()[0]
    m = -1 if m is None else int(m)
    a = records.filter(F.col("record_id") <= m)
    rest = records.filter(F.col("record_id") > m)
    return a, (None if rest.limit(1).count() == 0 else rest), m + 1


def with_rels_flag(judgments: DataFrame, split_col: str = "split") -> DataFrame:
    """Per split, grades are used only if some rel > 1."""
    return judgments.groupBy(split_col).agg((F.max("rel") > 1).alias("with_rels"))


def resolve_keys(qrels: DataFrame, records: DataFrame, check: bool = True) -> DataFrame:
    """(doc_id, passage_id) -> record_id, deduplicated per query, grade
    carried along; a judged key missing from the records is an error."""
    k = ["doc_id", "passage_id"]
    if check:
        if missing_keys(qrels, records, k).limit(1).count():
            raise KeyError("judged (doc_id, passage_id) missing from the records")
    j = qrels.join(keep_keys(records.select(*k, "record_id"), qrels, k), k, "inner")
    return j.groupBy("q_id", "record_id").agg(F.max("rel").alias("rel"))


def judgments_long(nested: DataFrame) -> DataFrame:
    """Nested (answers, rels map) -> long rows; missing grade => 1."""
    e = nested.select("q_id", "rels", F.explode("answers").alias("record_id"))
    return e.select("q_id", "record_id",
                    F.coalesce(F.element_at("rels", F.col("record_id")), F.lit(1)).alias("rel"))


def explode_captions(items: DataFrame, item_key: str, pos_col: str, text_col: str) -> DataFrame:
    """One query per caption with a dense q_id in (item, position)
    order; ``doc_id`` points at the caption's own item (its truth)."""
    q = items.select(F.col(item_key).alias("doc_id"), F.col(pos_col).alias("pos"),
                     F.col(text_col).alias("input"))
    return ordered_index(q, [F.col("doc_id"), F.col("pos")], "q_id")


def rekey_per_split(queries: DataFrame, split_col: str = "split", old: str = "q_id") -> DataFrame:
    """Dense q_id per split in old-id order (old kept as ``old_q_id``)."""
    q = queries.withColumnRenamed(old, "old_q_id")
    r = ordered_index(q, [F.asc_nulls_first(split_col), F.col("old_q_id")], "__g")
    first = r.groupBy(F.col(split_col).alias("__s")).agg(F.min("__g").alias("__m"))
    return (r.join(first, F.col(split_col).eqNullSafe(F.col("__s"))).withColumn("q_id", F.col("__g") - F.col("__m"))
            .drop("__s", "__g", "__m"))


def training_pairs(queries: DataFrame, judgments: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query vector, positive vector) for every judged pair."""
    j = judgments.select("q_id", "record_id").distinct()
    docs = keep_keys(corpus.select("record_id", F.col("embedding").alias("dv")), j, "record_id")
    return (j.join(queries.select("q_id", F.col("embedding").alias("qv")), "q_id")
            .join(docs, "record_id"))
