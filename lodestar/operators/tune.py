"""Closed-form embedding tuning.

Notation: ``v`` unit document vector, ``c`` the sum of its training query
vectors (queries are not normalised), ``u = c/max(|c|, 1e-12)``.

* N variant: documents stay on the unit sphere and move by squared distance
  ``<= γ`` towards ``c``: ``v' = a v + b c`` with ``b = ½√(γ(4-γ)/D)``,
  ``a = 1 - γ/2 - b·vTc``, ``D = cTc - vTc²``; no move when ``D <= 1e-12`` or
  ``vTc < 0``; a doc with ``vTc/|c| >= 1 - γ/2`` lands on ``u``.  γ is chosen
  on a grid by dev accuracy at ``val_k``.
* M variant: ``v' = v + γ u`` with one common γ found exactly: each dev
  (query, answer) pair gives the interval of γ for which the answer outranks
  every document, and the point covered by most intervals wins.

Physical plan: the corpus is split (broadcast semi/anti join on the answer
ids) into the documents with training queries and the rest, which never
moves and competes only through its scores (F15).  Direction sums are a
JVM-side partial aggregate keyed by record id; the dev side (queries or
pairs) is size-checked and broadcast; the corpus is scanned once by
``mapInArrow``, which for N counts what comes before each dev answer at every
γ (``q·v' = a(q·v) + b(q·c)``) and for M emits partial interval bounds per
task.
Only γ* reaches the driver.
"""
from __future__ import annotations

import math
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .._ship import ship_package
from ..functions.vectors import (EPS_NORM, as_double, dot, list_to_matrix, matrix_to_list, nan_to_zero,
                                 vector_sum, with_normalized)
from .joins import KEY_BROADCAST_CAP as ID_BROADCAST_CAP
from .ranks import prefix_sum
from .retrieval import (QUERY_BLOCK_CAP, TOPK_SCHEMA, QueryBlock, _corpus_frame, _scan_topk_fn,
                        broadcast_chunks, collect_block, final_topk, scan_in_parts)
from .topk_kernel import TILE_DOCS, TILE_ROWS, block_scores, round_scores, tiles

# fixed values
GAMMA_GRID = [0.02 * i for i in range(25)]   # 0, 0.02, ..., 0.48
M_EPS = 1e-8                                 # denominator guard in the interval quotient
M_LARGE = 1e8                                # upper bound of an interval
ZERO_D = 1e-12                               # cTc - vTc² at or below this counts as 0


@dataclass
class QuerySet:
    """Queries (q_id, embedding) and their judgments (q_id, record_id, rel)."""
    queries: DataFrame
    judgments: DataFrame

    def dedup_judgments(self) -> DataFrame:
        return self.judgments.select("q_id", "record_id").distinct()

    def judged_queries(self) -> DataFrame:
        return self.queries.join(self.judgments.select("q_id").distinct(), "q_id", "left_semi")


@dataclass
class TuneResult:
    embeddings: DataFrame          # record_id, embedding (tuned corpus)
    gamma: float
    diagnostics: DataFrame | None = None
    extra: dict = field(default_factory=dict)
    rest: DataFrame | None = None  # corpus documents that never move (no training query), as given


# --------------------------------------------------------------------------
# split the corpus so only documents with training queries are tuned
# --------------------------------------------------------------------------

def split_by_ids(corpus: DataFrame, ids: DataFrame, key: str = "record_id"):
    """(part, rest) = corpus ⋉ ids, corpus ▷ ids.  The id side is broadcast
    when its size is proven small, so the corpus is filtered in place."""
    n = ids.count()
    side = F.broadcast(ids) if n <= ID_BROADCAST_CAP else ids
    on = F.col(key) == F.col("__id")
    side = side.select(F.col("record_id").alias("__id"))
    return corpus.join(side, on, "left_semi"), corpus.join(side, on, "left_anti")


def trained_split(corpus: DataFrame, train: "QuerySet"):
    """Documents with at least one training query vs. the rest.  The rest
    never moves (c = 0) and only competes through its scores, with its own
    ids and labels (F15).  A document without a vector belongs to the rest.
    The ids are written once: the size check and both joins read them."""
    from ..plans.materialize import materialize
    ids = materialize(train.judgments.select(F.col("record_id").cast("long")).distinct(), "trained-ids")
    marked = corpus.withColumn("__trained", F.when(F.col("embedding").isNotNull(), F.col("record_id")))
    part, rest = split_by_ids(marked, ids, "__trained")
    return part.drop("__trained"), rest.drop("__trained")


def normalized(corpus: DataFrame) -> DataFrame:
    return with_normalized(corpus.select(F.col("record_id").cast("long"),
                                         as_double("embedding").alias("embedding")), "embedding")


def _static(untouched: DataFrame | None, rest: DataFrame | None) -> DataFrame | None:
    if untouched is None:
        return rest
    if rest is None:
        return untouched
    return untouched.select("record_id", "embedding").unionByName(rest.select("record_id", "embedding"))


# --------------------------------------------------------------------------
# F1 / F2 / V4: directions
# --------------------------------------------------------------------------

def doc_directions(corpus: DataFrame, train: QuerySet) -> DataFrame:
    """(record_id, v, c): v unit, c = Σ train queries answering the doc
    (repeated judgments counted once); docs without train queries get c=null."""
    inv = (train.dedup_judgments()
           .join(train.queries.select("q_id", as_double("embedding").alias("qv")).filter(F.col("qv").isNotNull()), "q_id"))
    sums = (inv.groupBy("record_id").agg(vector_sum("qv").alias("c"))
            .withColumn("c", nan_to_zero("c")))
    docs = with_normalized(corpus.select(F.col("record_id").cast("long"),
                                         as_double("embedding").alias("v")), "v")
    return docs.join(sums, "record_id", "left")


def n_stats(dirs: DataFrame) -> DataFrame:
    """vTc, cTc (0 for docs without direction) and the no-update flag."""
    vtc = F.coalesce(dot("v", "c"), F.lit(0.0))
    ctc = F.coalesce(dot("c", "c"), F.lit(0.0))
    return (dirs.withColumn("vTc", vtc).withColumn("cTc", ctc)
            .withColumn("no_update", ((F.col("cTc") - F.col("vTc") * F.col("vTc")) <= ZERO_D)
                        | (F.col("vTc") < 0)))


def _n_coeffs_np(gamma, vtc, ctc):
    """numpy twin of ``n_coefficients`` (same operation order)."""
    vtc = np.asarray(vtc, dtype=np.float64)
    ctc = np.asarray(ctc, dtype=np.float64)
    if gamma == 0:
        return np.ones_like(vtc), np.zeros_like(vtc)
    d = ctc - vtc * vtc
    no_upd = (d <= ZERO_D) | (vtc < 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        b = 0.5 * np.sqrt(gamma * (4.0 - gamma) / np.where(no_upd, 1.0, d))
    b = np.where(no_upd, 0.0, b)
    a = np.where(no_upd, 1.0, 1.0 - gamma / 2.0 - b * vtc)
    cn = np.maximum(np.sqrt(ctc), EPS_NORM)
    snap = (ctc > 0) & (vtc / cn >= 1.0 - gamma / 2.0)
    a = np.where(snap, 0.0, a)
    b = np.where(snap, 1.0 / cn, b)
    return a, b


def n_coefficients(gamma: float):
    """F8/F9 as Catalyst expressions: (a, b) with ``v' = a v + b c``."""
    if gamma == 0:
        return F.lit(1.0), F.lit(0.0)
    vtc, ctc = F.col("vTc"), F.col("cTc")
    d = ctc - vtc * vtc
    no_upd = (d <= ZERO_D) | (vtc < 0)
    b = F.when(no_upd, F.lit(0.0)).otherwise(
        F.lit(0.5) * F.sqrt(F.lit(gamma * (4.0 - gamma)) / d))
    a = F.when(no_upd, F.lit(1.0)).otherwise(F.lit(1.0 - gamma / 2.0) - b * vtc)
    cn = F.greatest(F.sqrt(ctc), F.lit(EPS_NORM))
    snap = (ctc > 0) & (vtc / cn >= F.lit(1.0 - gamma / 2.0))
    return (F.when(snap, F.lit(0.0)).otherwise(a), F.when(snap, F.lit(1.0) / cn).otherwise(b))


def n_apply(stats: DataFrame, gamma: float) -> DataFrame:
    """F8/F9 projection: tuned unit vectors."""
    check_gamma(gamma)
    a, b = n_coefficients(gamma)
    s = stats.withColumn("__a", a).withColumn("__b", b)
    emb = F.when(F.col("c").isNull() | (F.col("__b") == 0), F.col("v")).otherwise(
        F.zip_with("v", "c", lambda x, y: F.col("__a") * x + F.col("__b") * y))
    return s.select("record_id", emb.alias("embedding"))


def check_gamma(gamma: float) -> None:
    if not (0.0 <= gamma < 2.0):
        raise ValueError("gamma must lie in [0, 2)")


# --------------------------------------------------------------------------
# Dev accuracy of every γ in one scan
# --------------------------------------------------------------------------

_AHEAD_SCHEMA = "pair long, ahead array<int>"
_SOME = 1 << 16               # pairs of a query and a document that are scored at once


def _filled(column: pa.Array, like: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A column of vectors as a matrix of the shape of ``like``, zero where null, and where it isn't."""
    has = ~np.asarray(column.is_null().to_numpy(zero_copy_only=False), dtype=bool)
    m = np.zeros_like(like)
    if has.any():
        m[has] = list_to_matrix(column.filter(pa.array(has)))
    return m, has


def _row_dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """q·d of rows that stand beside each other; a row's sum doesn't depend on the others."""
    return (a * b).sum(axis=1)


def _pair_scores_fn(gammas):
    """The score of each (query, answer) row at every γ."""
    def fn(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            Q, V = list_to_matrix(b.column("qv")), list_to_matrix(b.column("v"))
            C, _ = _filled(b.column("c"), V)
            vtc, ctc = b.column("vTc").to_numpy(), b.column("cTc").to_numpy()
            s, t = _row_dots(Q, V), _row_dots(Q, C)
            scores = [round_scores(s * x + t * y) for x, y in (_n_coeffs_np(g, vtc, ctc) for g in gammas)]
            yield pa.RecordBatch.from_arrays([b.column("q_id"), b.column("x"), matrix_to_list(np.stack(scores, axis=1))],
                                             names=["q_id", "x", "scores"])
    return fn


def _ahead_scan_fn(bc, gammas, val_k, bc_closed=None):
    """For each (query, answer) row and γ the number of a task's documents that come
    before the answer (counted on to ``val_k`` at least).

    ``a(q·v) + b(q·c) <= (a + b|c|) max(q·v, q·u, 0)``, so that one product in single
    precision finds the few documents that can come before the answer at any γ that is
    still open; these are scored exactly, as the answers were.  ``bc_closed``: where
    ``val_k`` documents are known to come before."""
    def fn(batches):
        pair, x, Q, bars = bc.value                              # bars: a row per γ
        if bc_closed is not None:
            bars = np.where(bc_closed.value, np.inf, bars)
        n = len(pair)
        ahead = np.zeros((len(gammas), n), dtype=np.int32)
        lowest = bars.min(axis=0)
        live = np.flatnonzero(lowest < np.inf)
        Qf = Q.astype(np.float32)
        slack = np.sqrt(_row_dots(Q, Q)) * (1e-6 + 1.2e-7 * (Q.shape[1] + 16))

        def count(rows, r, d):
            q = rows[r]
            q_rows = Q[q]
            s, t = _row_dots(q_rows, V[d]), _row_dots(q_rows, C[d])
            other, before = rid[d] != x[q], rid[d] < x[q]
            for g in range(len(gammas)):
                score, bar = round_scores(s * A[g, d] + t * B[g, d]), bars[g, q]
                won = other & ((score > bar) | ((score == bar) & before))
                if won.any():
                    ahead[g, rows] += np.bincount(r[won], minlength=len(rows)).astype(np.int32)

        for b in batches:
            if b.num_rows == 0 or len(live) == 0:
                continue
            rid = b.column(0).to_numpy().astype(np.int64)
            V = list_to_matrix(b.column(1))
            C, has = _filled(b.column(2), V)
            ctc = np.where(has, b.column(4).to_numpy().astype(np.float64), 0.0)
            vtc = b.column(3).to_numpy().astype(np.float64)
            length = np.maximum(np.sqrt(ctc), EPS_NORM)
            A, B = (np.stack(m) for m in zip(*(_n_coeffs_np(g, vtc, ctc) for g in gammas)))
            reach = (np.abs(A) + np.abs(B) * length).max(axis=0)
            moves = ctc > 0
            for docs in tiles(len(rid), TILE_DOCS):
                order = docs.start + np.argsort(~moves[docs], kind="stable")       # what moves comes first
                to = order[:int(moves[docs].sum())]
                stay, go = V[order] * reach[order, None], C[to] * (reach[to] / length[to])[:, None]
                most = np.sqrt(np.maximum(_row_dots(stay, stay).max(), _row_dots(go, go).max(initial=0.0)))
                stay, go = stay.astype(np.float32).T.copy(), go.astype(np.float32).T.copy()
                bar = lowest - slack * most
                bar = np.where(bar > 0, bar, -np.inf).astype(np.float32)
                for part in tiles(len(live), TILE_ROWS):
                    rows = live[part]
                    q = Qf[rows]
                    high = q @ stay
                    if len(to):
                        np.maximum(high[:, :len(to)], q @ go, out=high[:, :len(to)])
                    some_can = np.flatnonzero(~(high.max(axis=1) < bar[rows]))      # what can't be compared counts
                    high, rows = high[some_can], rows[some_can]
                    r, d = np.divmod(np.flatnonzero(~(high < bar[rows, None])), len(order))
                    for some in tiles(len(r), _SOME):
                        count(rows, r[some], order[d[some]])
                lowest[live] = np.where(ahead[:, live] < val_k, bars[:, live], np.inf).min(axis=0)
                live = live[lowest[live] < np.inf]
        found = np.flatnonzero(ahead.any(axis=0))
        for some in tiles(len(found), _SOME):
            counts = ahead[:, found[some]].T.reshape(-1)
            offsets = np.arange(0, len(counts) + 1, len(gammas), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(pair[found[some]]), pa.ListArray.from_arrays(offsets, pa.array(counts))],
                                             names=["pair", "ahead"])
    return fn


def _ahead_block(chunk: DataFrame, n_gammas: int):
    tbl = chunk.select("pair", "x", "qv", "scores").toArrow()
    n = tbl.num_rows
    return (tbl.column("pair").to_numpy(), tbl.column("x").to_numpy(), list_to_matrix(tbl.column("qv")) if n else np.zeros((0, 1)),
            np.ascontiguousarray(list_to_matrix(tbl.column("scores")).T) if n else np.zeros((n_gammas, 0)))


def _merged_ahead(part: DataFrame, n_gammas: int) -> DataFrame:
    sums = part.groupBy("pair").agg(*[F.sum(F.col("ahead")[g]).alias(f"g{g}") for g in range(n_gammas)])
    return sums.select("pair", F.array(*[f"g{g}" for g in range(n_gammas)]).alias("ahead"))


def _closed(first: DataFrame, pair: np.ndarray, n_gammas: int, val_k: int) -> np.ndarray:
    """Where ``val_k`` documents come before the answer, by γ and row of the block."""
    tbl = first.toArrow()
    closed = np.zeros((n_gammas, len(pair)), dtype=bool)
    if tbl.num_rows:
        known, full = tbl.column("pair").to_numpy(), list_to_matrix(tbl.column("ahead")) >= val_k
        o = np.argsort(known)
        at = np.minimum(np.searchsorted(known, pair, sorter=o), len(known) - 1)
        closed[:, :] = (full[o[at]] & (known[o[at]] == pair)[:, None]).T
    return closed


def _answer_scores(docs: DataFrame, ans: DataFrame, devq: DataFrame, gammas: list) -> DataFrame:
    """(q_id, x, scores): the dev answers that the corpus has and their score at every γ."""
    found, _ = split_by_ids(docs, ans.select("record_id").distinct())
    rows = (ans.join(devq, "q_id").select("q_id", F.col("record_id").alias("x"), "qv")
            .join(found.withColumnRenamed("record_id", "x"), "x").select("q_id", "x", "qv", "v", "c", "vTc", "cTc"))
    return rows.mapInArrow(_pair_scores_fn(gammas), "q_id long, x long, scores array<double>")


def n_accuracy_grid(stats: DataFrame, dev: QuerySet, untouched: DataFrame | None = None,
                    val_k: int = 1, gammas=None, prefilter: float | None = None,
                    cap: int | None = None) -> DataFrame:
    """(g, gamma, acc_num, n_dev, acc, place) for every γ of the grid.

    An answer is among a query's top ``val_k`` if fewer documents come before it.  The
    answers are scored first; the corpus is then scanned once for what comes before
    them, and a task emits one row of counts per answer that is passed at all.

    Hits are summed for each denominator ``min(answers, val_k)`` and added as
    fractions on the driver (grid x val_k numbers), so that equal accuracies compare
    equal for any ``val_k``: ``place`` is the dense rank of the accuracy (0 = best).
    ``acc_num`` is its numerator over the denominators' common multiple (null where
    that passes 64 bits).  Answers over ``cap`` scan in chunks, one after another.
    With ``prefilter`` that share of the corpus is scanned first, and the tasks of the
    rest leave out what ``val_k`` of its documents pass."""
    from ..plans.materialize import materialize
    # the same numbers for the answers and for the scan
    stats = materialize(stats.select("record_id", "v", "c", "vTc", "cTc"), "grid-stats")
    return _written_grid(stats, dev, untouched, val_k, gammas, prefilter, cap)


def _written_grid(stats: DataFrame, dev: QuerySet, untouched: DataFrame | None, val_k: int, gammas,
                  prefilter: float | None, cap: int | None = None) -> DataFrame:
    from ..plans.materialize import materialize
    cap = cap or QUERY_BLOCK_CAP // 2
    gammas = list(GAMMA_GRID if gammas is None else gammas)
    for g in gammas:
        check_gamma(g)
    spark = stats.sparkSession
    ship_package(spark)
    docs = stats.select("record_id", "v", "c", "vTc", "cTc")
    if untouched is not None:                                   # never moves
        docs = docs.unionByName(normalized(untouched).select(
            "record_id", F.col("embedding").alias("v"), F.lit(None).cast("array<double>").alias("c"),
            F.lit(0.0).alias("vTc"), F.lit(0.0).alias("cTc")))
    docs = docs.filter(F.col("v").isNotNull())
    ans = dev.dedup_judgments()
    devq = dev.judged_queries().select("q_id", as_double("embedding").alias("qv")).filter(F.col("qv").isNotNull())
    scored = materialize(_answer_scores(docs, ans, devq, gammas).withColumn("pair", F.monotonically_increasing_id()), "grid-answers")
    block = materialize(scored.join(devq, "q_id"), "grid-pairs")     # a repeated query's rows compete with each other
    key = F.pmod(F.xxhash64("record_id"), F.lit(1 << 20))
    cut = min(1 << 20, max(1, int(prefilter * (1 << 20)))) if prefilter else 0
    merged = None
    for chunk, _ in broadcast_chunks(block, "pair", "qv", cap=cap):
        blk = _ahead_block(chunk, len(gammas))
        bc = spark.sparkContext.broadcast(blk)
        held = [bc]
        if prefilter:
            first = materialize(_merged_ahead(docs.filter(key < cut).mapInArrow(_ahead_scan_fn(bc, gammas, val_k), _AHEAD_SCHEMA),
                                              len(gammas)), "grid-first")
            held.append(spark.sparkContext.broadcast(_closed(first, blk[0], len(gammas), val_k)))
            part = docs.filter(key >= cut).mapInArrow(_ahead_scan_fn(bc, gammas, val_k, held[1]), _AHEAD_SCHEMA).unionByName(
                first.select("pair", F.col("ahead").cast("array<int>")))
        else:
            part = docs.mapInArrow(_ahead_scan_fn(bc, gammas, val_k), _AHEAD_SCHEMA)
        part = materialize(_merged_ahead(part, len(gammas)), "grid-ahead")
        for b in held:
            b.destroy()
        merged = part if merged is None else merged.unionByName(part)
    n_ans = ans.groupBy("q_id").agg(F.least(F.count(F.lit(1)), F.lit(val_k)).alias("m"))
    none = F.array_repeat(F.lit(0).cast("long"), len(gammas))
    passed = (scored.select("pair", "q_id", "x").join(_merged_ahead(merged, len(gammas)), "pair", "left")
              .select("q_id", "x", F.posexplode(F.coalesce("ahead", none)).alias("g", "ahead")).filter(F.col("ahead") < val_k))
    # rows of one record come behind each other
    copies = F.row_number().over(Window.partitionBy("q_id", "x", "g").orderBy("ahead")) - 1
    got = (passed.withColumn("copies", copies).filter(F.col("ahead") + F.col("copies") < val_k)
           .join(n_ans, "q_id").groupBy("g", "m").agg(F.count(F.lit(1)).alias("hits")).collect())
    seen = {} if docs.isEmpty() else {r.m: r.n for r in devq.select("q_id").distinct().join(n_ans, "q_id")
                                      .groupBy("m").agg(F.count(F.lit(1)).alias("n")).collect()}
    hits = [{m: 0 for m in seen} for _ in gammas]
    for r in got:
        hits[r.g][r.m] += r.hits
    common = math.lcm(*seen)
    n_dev = sum(seen.values())
    total = [sum(Fraction(h, m) for m, h in by_m.items()) for by_m in hits]
    place = {t: i for i, t in enumerate(sorted(set(total), reverse=True))}
    rows = []
    for i, g in enumerate(gammas):
        if n_dev:
            num = int(total[i] * common)
            rows.append((i, float(g), num if num < 1 << 63 else None, n_dev, float(total[i] / n_dev), place[total[i]]))
    return spark.createDataFrame(rows, "g int, gamma double, acc_num long, n_dev long, acc double, place int")


def n_best_gamma(grid: DataFrame) -> float:
    """Strict improvement in increasing γ: best accuracy, smallest γ."""
    r = grid.orderBy(F.col("place").asc(), F.col("gamma").asc()).first()
    return 0.0 if r is None else float(r["gamma"])


def tune_n(corpus: DataFrame, train: QuerySet, dev: QuerySet, untouched: DataFrame | None = None,
           val_k: int = 1, gamma: float | None = None, gammas=None, return_rest: bool = True,
           prefilter: float | None = None) -> TuneResult:
    """N variant end to end.  ``untouched`` records are competitors only
    (scored with cosine, keep ids and labels) and are not returned; corpus
    documents without training queries are split off the same way and come
    back normalised and unchanged -- or, with ``return_rest=False``, are not
    rewritten at all and are handed back as ``result.rest`` for a two-corpus
    search (``topk(..., untouched=result.rest)``).  ``prefilter`` applies the
    exact sample-threshold filter to the untouched scans (see ``topk``)."""
    from ..plans.materialize import materialize
    part, rest = trained_split(corpus, train)
    stats = materialize(n_stats(doc_directions(part, train)), "n-stats")
    grid = None
    if gamma is None:
        grid = _written_grid(stats, dev, _static(untouched, rest), val_k, gammas, prefilter)
        gamma = n_best_gamma(grid)
    check_gamma(gamma)
    emb = n_apply(stats, gamma)
    if return_rest:
        emb = emb.unionByName(normalized(rest))
    return TuneResult(emb, float(gamma), grid, rest=rest)


# --------------------------------------------------------------------------
# M variant
# --------------------------------------------------------------------------

def m_directions(dirs: DataFrame) -> DataFrame:
    """u = normalize(c); zero (null) for docs without train queries."""
    n = F.greatest(F.sqrt(dot("c", "c")), F.lit(EPS_NORM))
    return dirs.withColumn("__n", n).withColumn(
        "u", F.when(F.col("c").isNull(), F.lit(None).cast("array<double>"))
        .otherwise(F.transform("c", lambda x: x / F.col("__n")))).drop("__n")


def m_pairs(mdirs: DataFrame, dev: QuerySet, untouched: DataFrame | None = None) -> DataFrame:
    """(pair_id, q_id, x, qv, s_x, g_x): dev (query, answer) pairs with the
    answer's current score ``q·v`` and ``g = q·(-u)``, both rounded.  A doc's
    score at γ is ``s - γ g``, so x beats d iff ``γ (g_d - g_x) >= s_d - s_x``."""
    docs = mdirs.select("record_id", "v", "u")
    if untouched is not None:
        # only the answers' own vectors are needed: filter the (large)
        # untouched side in place by the answer ids before any shuffle
        xs = dev.dedup_judgments().select(F.col("record_id").cast("long")).distinct()
        ux, _ = split_by_ids(untouched.select(F.col("record_id").cast("long"), "embedding"), xs)
        u = with_normalized(ux.filter(F.col("embedding").isNotNull()).select("record_id", as_double("embedding").alias("v")), "v")
        docs = docs.unionByName(u.select("record_id", "v", F.lit(None).cast("array<double>").alias("u")))
    pairs = (dev.dedup_judgments()
             .join(dev.queries.select("q_id", as_double("embedding").alias("qv")).filter(F.col("qv").isNotNull()), "q_id")
             .join(docs.withColumnRenamed("record_id", "x"),
                   F.col("record_id") == F.col("x")).drop("record_id"))
    return (pairs.withColumn("s_x", F.round(dot("qv", "v"), 12))
            .withColumn("g_x", F.round(-F.coalesce(dot("qv", "u"), F.lit(0.0)), 12))
            .withColumn("pair_id", F.xxhash64("q_id", "x"))
            .select("pair_id", "q_id", "x", "qv", "s_x", "g_x"))


_INT_SCHEMA = "pair_id long, q_id long, x long, low double, high double, bad long"


def _interval_scan_fn(bc, bc_known=None):
    """Bounds of each pair over a task's documents; with ``bc_known`` (low, high of
    each pair so far) only those of pairs that a document of the task moves."""
    def fn(batches):
        pid, qid, x, Qp, sx, gx = bc.value
        npairs = len(pid)
        low = np.zeros(npairs)
        high = np.full(npairs, M_LARGE)
        bad = np.zeros(npairs, dtype=np.int64)
        seen = False
        for b in batches:
            if b.num_rows == 0 or npairs == 0:
                continue
            seen = True
            rid = b.column(0).to_numpy().astype(np.int64)
            V = list_to_matrix(b.column(1))
            U, _ = _filled(b.column(2), V)
            for docs in tiles(len(rid), TILE_DOCS):
                for part in tiles(npairs, TILE_ROWS):
                    S = round_scores(block_scores(Qp[part], V[docs]))
                    G = round_scores(-block_scores(Qp[part], U[docs]))
                    ds = S - sx[part, None]
                    dg = G - gx[part, None]
                    other = rid[None, docs] != x[part, None]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        al = ds / (dg + M_EPS)
                    pos = other & (dg > 0)
                    neg = other & (dg < 0)
                    if pos.any():
                        low[part] = np.maximum(low[part], np.where(pos, al, -np.inf).max(axis=1))
                    if neg.any():
                        high[part] = np.minimum(high[part], np.where(neg, al, np.inf).min(axis=1))
                    bad[part] += (other & (dg == 0) & (ds > 0)).sum(axis=1)
        if not seen:
            return
        cols = [pid, qid, x, low, high, bad]
        if bc_known is not None:
            moved = ~((low <= bc_known.value[0]) & (high >= bc_known.value[1]) & (bad == 0))     # NaN bounds count
            cols = [c[moved] for c in cols]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["pair_id", "q_id", "x", "low", "high", "bad"])
    return fn


def _merged_bounds(part: DataFrame) -> DataFrame:
    return part.groupBy("pair_id", "q_id", "x").agg(F.max("low").alias("low"), F.min("high").alias("high"), F.sum("bad").alias("bad"))


def _bounds_in_parts(bc, pairs: DataFrame, scan: DataFrame, fraction: float) -> tuple[DataFrame, object]:
    """Partial bounds of a corpus that is scanned in two parts, and the second
    broadcast.  The first part's merged bounds are written; a task of the rest emits
    a pair only if it moves them, so that the rows that are shuffled grow with pairs
    / ``fraction`` and not with pairs x tasks."""
    from ..plans.materialize import materialize
    key = F.pmod(F.xxhash64("record_id"), F.lit(1 << 20))
    cut = min(1 << 20, max(1, int(fraction * (1 << 20))))
    start = pairs.select("pair_id", "q_id", "x", F.lit(0.0).alias("low"), F.lit(M_LARGE).alias("high"), F.lit(0).cast("long").alias("bad"))
    first = materialize(_merged_bounds(start.unionByName(scan.filter(key < cut).mapInArrow(_interval_scan_fn(bc), _INT_SCHEMA))), "m-first")
    pid = bc.value[0]
    low, high, order = np.zeros(len(pid)), np.full(len(pid), M_LARGE), np.argsort(pid)
    got = first.select("pair_id", "low", "high").toArrow()             # one row per pair of the block
    at = order[np.searchsorted(pid, got.column("pair_id").to_numpy(), sorter=order)] if len(pid) else order
    low[at], high[at] = got.column("low").to_numpy(), got.column("high").to_numpy()
    known = scan.sparkSession.sparkContext.broadcast((low, high))
    rest = scan.filter(key >= cut).mapInArrow(_interval_scan_fn(bc, known), _INT_SCHEMA)
    return first.unionByName(rest), known


PAIR_BLOCK_CAP = QUERY_BLOCK_CAP // 2


def _pair_block(pairs: DataFrame):
    tbl = pairs.select("pair_id", "q_id", "x", "qv", "s_x", "g_x").toArrow()
    n = tbl.num_rows
    return (tbl.column("pair_id").to_numpy(), tbl.column("q_id").to_numpy(), tbl.column("x").to_numpy(),
            list_to_matrix(tbl.column("qv")) if n else np.zeros((0, 1)),
            tbl.column("s_x").to_numpy(), tbl.column("g_x").to_numpy())


def _untouched_bounds(pairs: DataFrame, best: DataFrame) -> DataFrame:
    """Untouched docs have u = 0, so for a pair their Δg is the same
    (-g_x) and only the best untouched score other than x itself can bind:
    collapse them to the top-2 cosine per dev query (exact) and turn the best
    one that is not x into one bound row per pair."""
    j = (pairs.select("pair_id", "q_id", "x", "s_x", "g_x")
         .join(best.select("q_id", F.col("record_id").alias("d"), F.col("score").alias("sc")), "q_id")
         .filter(F.col("d") != F.col("x"))
         .groupBy("pair_id", "q_id", "x", "s_x", "g_x").agg(F.max("sc").alias("s_c")))
    ds = F.col("s_c") - F.col("s_x")
    dg = F.lit(0.0) - F.col("g_x")
    al = ds / (dg + F.lit(M_EPS))
    return j.select("pair_id", "q_id", "x",
                    F.when(dg > 0, F.greatest(al, F.lit(0.0))).otherwise(F.lit(0.0)).alias("low"),
                    F.when(dg < 0, F.least(al, F.lit(M_LARGE))).otherwise(F.lit(M_LARGE)).alias("high"),
                    F.when((dg == 0) & (ds > 0), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("bad"))


def m_intervals(mdirs: DataFrame, dev: QuerySet, untouched: DataFrame | None = None,
                prefilter: float | None = None) -> DataFrame:
    return _m_intervals(mdirs, dev, untouched, prefilter)[0]


def _m_intervals(mdirs: DataFrame, dev: QuerySet, untouched: DataFrame | None = None,
                 prefilter: float | None = None, cap: int | None = None):
    """(pair_id, q_id, x, low, high, bad, valid) per dev pair, and the number of pairs.

    The pair block (query vector + the answer's two scores) is size-checked
    and broadcast; the corpus is scanned by ``mapInArrow`` emitting one partial
    (max, min, count) row per pair per task, merged by a two-phase aggregate.  With
    ``prefilter`` that share of the corpus is scanned first, and the tasks of the rest
    emit only the pairs whose bounds they move.
    Pairs over ``cap`` scan in chunks, one after another, each written before its
    broadcast goes."""
    from ..plans.materialize import materialize
    from .retrieval import topk
    cap = cap or PAIR_BLOCK_CAP
    spark = mdirs.sparkSession
    ship_package(spark)
    pairs = materialize(m_pairs(mdirs, dev, untouched), "m-pairs")     # size check, collection and bounds read it
    scan = mdirs.select("record_id", "v", "u")
    part, best, n_pairs = None, None, 0
    chunks = broadcast_chunks(pairs, "pair_id", "qv", cap=cap)
    for chunk, _ in chunks:
        blk = _pair_block(chunk)
        n_pairs += len(blk[0])
        bc = spark.sparkContext.broadcast(blk)
        held = [bc]
        if prefilter:
            p, known = _bounds_in_parts(bc, chunk, scan, prefilter)
            held.append(known)
        else:
            p = scan.mapInArrow(_interval_scan_fn(bc), _INT_SCHEMA)
        if len(chunks) > 1:
            p = materialize(_merged_bounds(p), "m-bounds")
            for h in held:
                h.destroy()
        elif untouched is not None:
            # every judged dev query is in the pair block: reuse its vectors
            _, first = np.unique(blk[1], return_index=True)
            qbc = spark.sparkContext.broadcast(QueryBlock(blk[1][first], blk[3][first]))
            uc = _corpus_frame(untouched, True)
            best = final_topk(scan_in_parts(qbc, uc, 2, prefilter)[0] if prefilter
                              else uc.mapInArrow(_scan_topk_fn(qbc, 2), TOPK_SCHEMA), 2)
        part = p if part is None else part.unionByName(p)
    if untouched is not None:
        if best is None:
            best = topk(dev.judged_queries().select("q_id", "embedding"), untouched, 2, "cos", cap=cap, prefilter=prefilter)
        part = part.unionByName(_untouched_bounds(pairs, best))
    agg = _merged_bounds(part)
    return agg.withColumn("valid", (F.col("bad") == 0) & (F.col("high") >= F.col("low"))), n_pairs


def m_sweep(intervals: DataFrame, n_pairs: int | None = None) -> DataFrame:
    """coverage count after each distinct end point (half-open [low, high)).
    ``n_pairs`` (known from the pair block) bounds the events by 2 per pair."""
    v = intervals.filter("valid")
    ev = (v.select(F.col("low").alias("value"), F.lit(1).alias("sign"))
          .unionByName(v.select(F.col("high").alias("value"), F.lit(-1).alias("sign")))
          .groupBy("value").agg(F.sum("sign").alias("net")))
    return prefix_sum(ev, "value", "net", "total", max_rows=None if n_pairs is None else 2 * n_pairs)


def m_best_gamma(sweep: DataFrame) -> tuple[float, int]:
    r = sweep.orderBy(F.col("total").desc(), F.col("value").asc()).first()
    if r is None or r["total"] <= 0:
        return 0.0, 0
    return float(r["value"]), int(r["total"])


def m_apply(mdirs: DataFrame, gamma: float) -> DataFrame:
    """v + γ u (unnormalised; search with dot product)."""
    emb = F.when(F.col("u").isNull(), F.col("v")).otherwise(
        F.zip_with("v", "u", lambda x, y: x + F.lit(float(gamma)) * y))
    return mdirs.select("record_id", emb.alias("embedding"))


def tune_m(corpus: DataFrame, train: QuerySet, dev: QuerySet, untouched: DataFrame | None = None,
           gamma: float | None = None, return_rest: bool = True,
           prefilter: float | None = None) -> TuneResult:
    """M variant end to end (same corpus split and ``return_rest`` as
    ``tune_n``; search the tuned part with ``dot`` and the rest with cosine)."""
    from ..plans.materialize import materialize
    part, rest = trained_split(corpus, train)
    mdirs = materialize(m_directions(doc_directions(part, train)), "m-dirs")
    diag, extra = None, {}
    if gamma is None:
        ivp, n_pairs = _m_intervals(mdirs, dev, _static(untouched, rest), prefilter)
        iv = materialize(ivp, "m-intervals")
        diag = iv
        gamma, best = m_best_gamma(m_sweep(iv, n_pairs))
        extra["overlap"] = best
    emb = m_apply(mdirs, gamma)
    if return_rest:
        emb = emb.unionByName(normalized(rest))
    return TuneResult(emb, float(gamma), diag, extra, rest=rest)
