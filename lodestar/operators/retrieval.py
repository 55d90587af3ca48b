"""Exact top-k retrieval.

Physical design: the query side is the small side.  Its size is checked
(``count`` x ``dim`` scalars) and, when under ``QUERY_BLOCK_CAP``, it is
packed into one numpy block and broadcast; the corpus is scanned in place by
``mapInArrow`` (matmul + running top-k per task, one emit per task) and the
per-task partials are merged by a ``row_number`` window whose limit Catalyst
pushes below the shuffle (``WindowGroupLimit``).  Beyond the cap the queries
are dealt into chunks under it, which scan the corpus in place one after
another: a first part of the corpus gives every query its k-th best score so
far, and the scan of the rest emits only what reaches it.  Each chunk's result
is written before the next one starts, and its broadcasts are destroyed, so
that neither the driver nor a task holds more than one chunk and the corpus is
never shuffled.
"""
from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import as_double, list_to_matrix, np_normalize
from .._ship import ship_package
from ..plans.materialize import materialize
from ..session import shared_dir
from .ranks import ordered_index
from .topk_kernel import TILE_DOCS, TILE_ROWS, block_scores, fold_topk, tiles

QUERY_BLOCK_CAP = 256 << 20   # bytes of float64 query block we allow to broadcast
METRICS = ("cos", "dot")
TOPK_SCHEMA = "q_id long, record_id long, score double"
FIRST_PART = 1 / 16           # share of the corpus that gives the floors for the rest, for large query sets
_PARTS = 1 << 20


def check_metric(metric: str) -> None:
    """Only cosine (doc side normalised) or raw dot product."""
    if metric not in METRICS:
        raise ValueError(f"unknown distance metric {metric!r}; use 'cos' or 'dot'")


@dataclass
class QueryBlock:
    ids: np.ndarray
    mat: np.ndarray

    @property
    def nbytes(self) -> int:
        return self.mat.nbytes + self.ids.nbytes


def block_size(df: DataFrame, vec_col: str = "embedding"):
    """(rows, dim) scalars of a vector table -> bytes of its float64 block."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec_col)).alias("d")).first()
    n, d = int(r["n"] or 0), int(r["d"] or 0)
    return n, d, n * max(d, 1) * 8


def collect_block(df: DataFrame, id_col: str = "q_id", vec_col: str = "embedding",
                  cap: int = QUERY_BLOCK_CAP, sizes: tuple | None = None) -> QueryBlock:
    """Pack a *size-checked* small vector table into one numpy block
    (``sizes`` = a (rows, dim, bytes) check already made on ``df``)."""
    n, d, nbytes = sizes or block_size(df, vec_col)
    if nbytes > cap:
        raise OverflowError(f"query block of {nbytes} bytes exceeds cap {cap}")
    tbl = df.filter(F.col(vec_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), as_double(vec_col).alias("v")).toArrow()
    ids = tbl.column("id").to_numpy().astype(np.int64)
    mat = list_to_matrix(tbl.column("v")) if n else np.zeros((0, d))
    return QueryBlock(ids, mat)


def broadcast_chunks(df: DataFrame, id_col: str, vec_col: str = "embedding",
                     cap: int = QUERY_BLOCK_CAP) -> list[tuple[DataFrame, tuple]]:
    """A vector table in chunks whose blocks fit ``cap`` (one vector at least; the
    table itself when it fits), with their (rows, dim, bytes).  Rows are dealt by
    their number in the order of ``id_col``, so that no chunk is over the cap
    however ids repeat, and written once."""
    sizes = block_size(df, vec_col)
    n, d, nbytes = sizes
    if nbytes <= cap:
        return [(df, sizes)]
    most = max(1, cap // (8 * max(d, 1)))
    dealt = materialize(ordered_index(df.withColumn("__row", F.monotonically_increasing_id()), [F.col(id_col), F.col("__row")], "__at")
                        .withColumn("__chunk", F.floor(F.col("__at") / most)).drop("__at", "__row"), "query-chunks", ["__chunk"])
    rows = [min(most, n - i) for i in range(0, n, most)]
    return [(dealt.filter(F.col("__chunk") == i).drop("__chunk"), (r, d, 8 * r * max(d, 1))) for i, r in enumerate(rows)]


def _scan_topk_fn(bc, k: int, bc_floor=None):
    """Top-k of each query over a task's documents; with ``bc_floor`` (a score per
    query) only what reaches the floor.  Queries are scored and emitted in tiles, so
    that beside the block and its top-k a task holds one tile of scores."""
    def fn(batches):
        blk = bc.value
        qids, Q = blk.ids, blk.mat
        parts = tiles(len(qids), TILE_ROWS)
        state = [None] * len(parts)
        for b in batches:
            if b.num_rows == 0 or len(qids) == 0:
                continue
            rid = b.column(0).to_numpy().astype(np.int64)
            D = list_to_matrix(b.column(1))
            cos = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            if cos.any():
                D[cos] = np_normalize(D[cos])
            for docs in tiles(len(rid), TILE_DOCS):
                for i, part in enumerate(parts):
                    state[i] = fold_topk(state[i], block_scores(Q[part], D[docs]), rid[docs], k)
        for i, part in enumerate(parts):
            if state[i] is None:
                return
            S, I = state[i]
            kk = S.shape[1]
            q = np.repeat(qids[part], kk)
            S, I = S.reshape(-1), I.reshape(-1)
            if bc_floor is not None:
                keep = S >= np.repeat(bc_floor.value[part], kk)
                q, S, I = q[keep], S[keep], I[keep]
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(I), pa.array(S)],
                                             names=["q_id", "record_id", "score"])
    return fn


def _corpus_frame(corpus: DataFrame, cos: bool) -> DataFrame:
    """Scan input: (record_id, embedding as double, cosine flag); rows
    without a vector cannot be scored and are skipped."""
    return corpus.filter(F.col("embedding").isNotNull()).select(
        F.col("record_id").cast("long").alias("record_id"),
        as_double("embedding").alias("embedding"), F.lit(cos).alias("__cos"))


def scan_in_parts(bc, corpus: DataFrame, k: int, fraction: float) -> tuple[DataFrame, object]:
    """Partial top-k rows of a corpus that is scanned in two parts, and the second
    broadcast.  The first part (a share of the record ids' hashes) is merged and
    written; its k-th best score of a query, if it has k, is the floor for the
    rest.  Rows of the first part are kept as they were scored, so that nothing
    is scored twice and the result doesn't rest on a rounding margin."""
    spark = corpus.sparkSession
    part = F.pmod(F.xxhash64("record_id"), F.lit(_PARTS))
    cut = min(_PARTS, max(1, int(fraction * _PARTS)))
    first = materialize(final_topk(corpus.filter(part < cut).mapInArrow(_scan_topk_fn(bc, k), TOPK_SCHEMA), k)
                        .select("q_id", "record_id", "score"), "topk-first")
    kth = (first.groupBy("q_id").agg(F.min("score").alias("t"), F.count(F.lit(1)).alias("n"))
           .filter(F.col("n") >= k).select("q_id", "t").toArrow())
    known = dict(zip(kth.column("q_id").to_pylist(), kth.column("t").to_pylist()))
    floor = spark.sparkContext.broadcast(np.array([known.get(q, -np.inf) for q in bc.value.ids.tolist()]))
    rest = corpus.filter(part >= cut).mapInArrow(_scan_topk_fn(bc, k, floor), TOPK_SCHEMA)
    return first.unionByName(rest), floor


def partial_topk(queries: DataFrame, corpus_flagged: DataFrame, k: int,
                 cap: int = QUERY_BLOCK_CAP, query_matrix=None, prefilter: float | None = None) -> DataFrame:
    """Per-task top-k rows (q_id, record_id, score); needs a final merge.
    ``query_matrix`` W (dim x dim) maps every query q -> W q first.
    ``prefilter`` (a fraction) scans that share of the corpus first, so that the
    tasks of the rest emit only candidates that can still make the top-k (exact;
    shrinks the partial shuffle for large corpora)."""
    spark = corpus_flagged.sparkSession
    ship_package(spark)
    queries = queries.filter(F.col("embedding").isNotNull())     # on every path alike
    if query_matrix is not None and block_size(queries)[2] > cap:
        from .adapter import apply_adapter
        queries, query_matrix = apply_adapter(queries, query_matrix), None
    sizes = block_size(queries)
    if sizes[2] > cap:
        return _topk_in_turn(queries, corpus_flagged, k, cap, prefilter or FIRST_PART)
    blk = collect_block(queries, cap=cap, sizes=sizes)
    if query_matrix is not None:
        blk = QueryBlock(blk.ids, blk.mat @ np.asarray(query_matrix, dtype=np.float64).T)
    bc = spark.sparkContext.broadcast(blk)
    if prefilter:
        return scan_in_parts(bc, corpus_flagged, k, prefilter)[0]
    return corpus_flagged.mapInArrow(_scan_topk_fn(bc, k), TOPK_SCHEMA)


def _topk_in_turn(queries: DataFrame, corpus: DataFrame, k: int, cap: int, fraction: float = FIRST_PART) -> DataFrame:
    """Large query sets: chunks under ``cap``, one after another; the top-k rows of
    each are written, then its broadcasts go."""
    spark = corpus.sparkSession
    folder = shared_dir(spark, f"topk-large-{uuid.uuid4().hex[:12]}")
    for i, (chunk, sizes) in enumerate(broadcast_chunks(queries, "q_id", cap=cap)):
        bc = spark.sparkContext.broadcast(collect_block(chunk, cap=max(cap, sizes[2]), sizes=sizes))
        part, floor = scan_in_parts(bc, corpus, k, fraction)
        final_topk(part, k).select("q_id", "record_id", "score").write.mode("overwrite").parquet(f"{folder}/chunk={i}")
        floor.destroy()
        bc.destroy()
    return spark.read.parquet(folder).drop("chunk")


def final_topk(partial: DataFrame, k: int, keys=("q_id",)) -> DataFrame:
    """Merge partial top-k rows: 0-based ``rank`` by (score desc, record_id asc).
    k = 1 is a two-phase hash aggregate (partial max before the shuffle);
    larger k a row_number window whose limit Catalyst pushes below the shuffle."""
    if k == 1:
        best = partial.groupBy(*keys).agg(
            F.max(F.struct(F.col("score"), (-F.col("record_id")).alias("nid"))).alias("__b"))
        return best.select(*keys, (-F.col("__b.nid")).alias("record_id"),
                           F.col("__b.score").alias("score"), F.lit(0).alias("rank"))
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("record_id").asc())
    # filter on row_number itself so Catalyst inserts WindowGroupLimit
    return (partial.withColumn("__rn", F.row_number().over(w))
            .filter(F.col("__rn") <= k)
            .withColumn("rank", F.col("__rn") - 1).drop("__rn"))


def topk(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cos",
         untouched: DataFrame | None = None, query_transform=None,
         cap: int = QUERY_BLOCK_CAP, query_matrix=None, prefilter: float | None = None) -> DataFrame:
    """Exact top-k of every query.

    ``corpus`` is scored with ``metric``; ``untouched`` (optional second corpus,
    disjoint record ids) is always scored with cosine.  ``query_transform`` is
    a DataFrame -> DataFrame hook applied to the queries first; a linear hook
    can instead be given as ``query_matrix`` W (applied to the broadcast block).
    ``prefilter=fraction`` scans that share of the corpus first for score floors (exact).
    Returns (q_id, rank, record_id, score).
    """
    check_metric(metric)
    if k < 1:
        raise ValueError("k must be >= 1")
    if query_transform is not None:
        queries = query_transform(queries)
    c = _corpus_frame(corpus, metric == "cos")
    if untouched is not None:
        c = c.unionByName(_corpus_frame(untouched, True))
    part = partial_topk(queries, c, k, cap, query_matrix, prefilter)
    return final_topk(part, k).select("q_id", "rank", "record_id", "score")


def topk_scores(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cos",
                untouched: DataFrame | None = None) -> DataFrame:
    """Scores only."""
    return topk(queries, corpus, k, metric, untouched).select("q_id", "rank", "score")


def top1(queries: DataFrame, corpus: DataFrame, metric: str = "cos",
         untouched: DataFrame | None = None) -> DataFrame:
    """Best document per query as a two-phase ``max`` aggregate."""
    check_metric(metric)
    c = _corpus_frame(corpus, metric == "cos")
    if untouched is not None:
        c = c.unionByName(_corpus_frame(untouched, True))
    part = partial_topk(queries, c, 1)
    best = part.groupBy("q_id").agg(
        F.max(F.struct(F.col("score"), (-F.col("record_id")).alias("nid"))).alias("b"))
    return best.select("q_id", (-F.col("b.nid")).alias("record_id"),
                       F.col("b.score").alias("score"))


def candidate_narrowing(dev_queries: DataFrame, answerable: DataFrame,
                        nontrain: DataFrame, k: int = 15) -> DataFrame:
    """Answerable records plus the nontrain records that occur in any
    dev query's top-k over the whole corpus.  Returns record ids."""
    hits = topk(dev_queries, answerable, k, "cos", untouched=nontrain)
    # hits ⊆ answerable ∪ nontrain: the nontrain hits are the hits that are
    # not answerable -- two small sides, the nontrain table is never joined
    extra = (hits.select("record_id").distinct()
             .join(answerable.select("record_id"), "record_id", "left_anti"))
    return answerable.select("record_id").unionByName(extra)
