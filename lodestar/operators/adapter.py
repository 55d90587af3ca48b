"""Linear query adapter baseline (B1-B4), re-aimed as Spark jobs.

B1 in-batch-negatives ranking loss: per batch, cosine matrix of transformed
queries vs positives, entries below ``sim_thresh`` zeroed, times ``scale``,
softmax cross-entropy against the diagonal.  Batches are bounded (batch_size
rows) and evaluated per group with ``applyInArrow``.
B2 synchronous training: the pairs are written by batch; one job runs the steps
between two validations in one task, which reads just their batches and keeps W and
the AdamW state (linear warm-up).  The driver validates every ``val_freq`` steps (B4).
"""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .._ship import ship_package
from ..functions.vectors import as_double, list_to_matrix, matrix_to_list, np_normalize
from .ranks import ordered_index

# fixed values (baseline settings)
DEFAULTS = dict(batch_size=4096, steps=10000, val_freq=50, loss_scale=20.0, loss_sim_thresh=-1.0,
                warmup_steps=10000, lr=1e-3, step_wait=1000, acc_diff_wait=0.05, val_k=1)
ADAMW = dict(beta1=0.9, beta2=0.999, eps=1e-8, weight_decay=0.01)


def batch_pairs(pairs: DataFrame, batch_size: int, seed: int | None = None) -> DataFrame:
    """Assign ``batch_id`` over a deterministic order of (q_id, record_id)
    (shuffled by a seeded hash when ``seed`` is given)."""
    if seed is None:
        r = ordered_index(pairs, [F.col("q_id"), F.col("record_id")], "__i")
    else:
        r = ordered_index(pairs.withColumn("__k", F.xxhash64(F.lit(seed), "q_id", "record_id")),
                          [F.col("__k"), F.col("q_id"), F.col("record_id")], "__i").drop("__k")
    return r.withColumn("batch_id", (F.col("__i") / F.lit(batch_size)).cast("long")).drop("__i")


def _loss_and_grad(Qb, Db, W, scale, thresh, want_grad):
    Y = Qb @ W.T
    yn = np.maximum(np.linalg.norm(Y, axis=1, keepdims=True), 1e-12)
    Yh = Y / yn
    Dh = np_normalize(Db)
    S = Yh @ Dh.T
    M = (S >= thresh).astype(np.float64)
    Z = S * M * scale
    Z = Z - Z.max(axis=1, keepdims=True)
    P = np.exp(Z)
    P /= P.sum(axis=1, keepdims=True)
    n = len(Qb)
    loss = float(-np.log(np.maximum(P[np.arange(n), np.arange(n)], 1e-300)).mean())
    if not want_grad:
        return loss, None
    G = (P - np.eye(n)) / n
    gS = G * M * scale
    gYh = gS @ Dh
    gY = (gYh - Yh * (Yh * gYh).sum(axis=1, keepdims=True)) / yn
    return loss, gY.T @ Qb


def ranking_loss(pairs: DataFrame, W: np.ndarray | None = None, scale: float = 20.0,
                 sim_thresh: float = -1.0) -> DataFrame:
    """B1: (batch_id, n, loss) for pairs (batch_id, qv, dv)."""
    spark = pairs.sparkSession
    ship_package(spark)
    bc = spark.sparkContext.broadcast(W)

    def fn(t: pa.Table) -> pa.Table:
        o = np.lexsort((t.column("record_id").to_numpy(), t.column("q_id").to_numpy()))
        Q = list_to_matrix(t.column("qv"))[o]
        D = list_to_matrix(t.column("dv"))[o]
        w = bc.value if bc.value is not None else np.eye(Q.shape[1])
        loss, _ = _loss_and_grad(Q, D, w, scale, sim_thresh, False)
        return pa.table({"batch_id": pa.array([t.column("batch_id")[0].as_py()], pa.int64()),
                         "n": pa.array([t.num_rows], pa.int64()), "loss": pa.array([loss])})
    return (pairs.select("batch_id", "q_id", "record_id", as_double("qv").alias("qv"), as_double("dv").alias("dv"))
            .groupBy("batch_id").applyInArrow(fn, "batch_id long, n long, loss double"))


def apply_adapter(queries: DataFrame, W: np.ndarray, vec: str = "embedding") -> DataFrame:
    """B3 / R7 hook: q -> W q (broadcast W, Arrow-batched matmul)."""
    spark = queries.sparkSession
    ship_package(spark)
    bc = spark.sparkContext.broadcast(np.asarray(W, dtype=np.float64))
    cols = [c for c in queries.columns if c != vec]
    src = queries.select(*cols, as_double(vec).alias(vec))
    schema = src.schema

    def fn(batches):
        w = bc.value
        for b in batches:
            if b.num_rows == 0:
                continue
            Q = list_to_matrix(b.column(vec))
            arrs = [b.column(c) for c in cols] + [matrix_to_list(Q @ w.T)]
            yield pa.RecordBatch.from_arrays(arrs, names=cols + [vec])
    return src.mapInArrow(fn, schema)


def adapter_accuracy(dev_queries: DataFrame, dev_judgments: DataFrame, corpus: DataFrame,
                     W: np.ndarray | None, untouched: DataFrame | None = None, val_k: int = 1) -> DataFrame:
    """Top-val_k accuracy of transformed dev queries over the corpus
    (cosine) plus untouched competitors; hits / min(#answers, val_k)."""
    from .retrieval import topk
    q = dev_queries.join(dev_judgments.select("q_id").distinct(), "q_id", "left_semi")
    top = topk(q, corpus, val_k, "cos", untouched=untouched, query_matrix=W)
    ans = dev_judgments.select("q_id", "record_id").distinct()
    n_ans = ans.groupBy("q_id").agg(F.count(F.lit(1)).alias("n_ans"))
    per = (q.select("q_id").join(top.join(ans.withColumn("hit", F.lit(1)), ["q_id", "record_id"], "left")
                                 .groupBy("q_id").agg(F.sum(F.coalesce("hit", F.lit(0))).alias("hits")), "q_id", "left")
           .join(n_ans, "q_id"))
    return per.agg(F.avg(F.coalesce("hits", F.lit(0)) / F.least("n_ans", F.lit(val_k))).alias("acc"),
                   F.count(F.lit(1)).alias("n_queries"))


SEGMENT_CAP = 256 << 20   # bytes of pair vectors one training task may hold


def _lr(step: int, T: int, warm: int, lr0: float) -> float:
    """Linear warm-up then linear decay (constant when warm == 0)."""
    if warm <= 0:
        return lr0
    if step < warm:
        return lr0 * step / warm
    return lr0 * max(0.0, (T - step) / max(1, T - warm))


def _adamw(W, m1, m2, g, step, lr):
    t = step + 1
    W = W * (1 - lr * ADAMW["weight_decay"])
    m1 = ADAMW["beta1"] * m1 + (1 - ADAMW["beta1"]) * g
    m2 = ADAMW["beta2"] * m2 + (1 - ADAMW["beta2"]) * g * g
    mh = m1 / (1 - ADAMW["beta1"] ** t)
    vh = m2 / (1 - ADAMW["beta2"] ** t)
    return W - lr * mh / (np.sqrt(vh) + ADAMW["eps"]), m1, m2


def _segment_fn(bc, plan, scale, thresh, T, warm, lr0):
    """Run the consecutive steps ``plan`` = [(step, batch_id), ...] in one
    task: the state (W, m1, m2) stays local between them."""
    def run(batches):
        tbl = pa.Table.from_batches(list(batches))
        W, m1, m2 = (np.array(x, dtype=np.float64) for x in bc.value)
        if tbl.num_rows:
            bid = tbl.column("batch_id").to_numpy()
            qid = tbl.column("q_id").to_numpy()
            rid = tbl.column("record_id").to_numpy()
            Qa = list_to_matrix(tbl.column("qv"))
            Da = list_to_matrix(tbl.column("dv"))
            for step, b in plan:
                sel = np.nonzero(bid == b)[0]
                if len(sel) == 0:
                    continue
                o = sel[np.lexsort((rid[sel], qid[sel]))]
                _, g = _loss_and_grad(Qa[o], Da[o], W, scale, thresh, True)
                W, m1, m2 = _adamw(W, m1, m2, g, step, _lr(step, T, warm, lr0))
        yield pa.RecordBatch.from_arrays(
            [matrix_to_list(x.reshape(1, -1)) for x in (W, m1, m2)], names=["W", "m1", "m2"])
    return run


@dataclass
class AdapterResult:
    W: np.ndarray
    best_step: int
    history: list = field(default_factory=list)   # (step, val_acc)


def fit_adapter(pairs: DataFrame, dev_queries: DataFrame, dev_judgments: DataFrame, corpus: DataFrame,
                untouched: DataFrame | None = None, seed: int = 0, **kw) -> AdapterResult:
    """B2: identity start, AdamW with linear warm-up, validation every
    ``val_freq`` steps, best weights kept; stops at a validation step after
    ``step_wait`` steps without gain or a drop larger than ``acc_diff_wait``.

    Steps are sequential, so the steps between two validations run as one
    job: a single task reads just those batches (pruned by batch folder,
    bounded by ``SEGMENT_CAP``), keeps W and the optimiser state local and
    returns them; the driver only validates and holds dim x dim matrices."""
    cfg = dict(DEFAULTS)
    cfg.update(kw)
    spark = pairs.sparkSession
    ship_package(spark)
    bp = batch_pairs(pairs, cfg["batch_size"], seed).select(
        "batch_id", "q_id", "record_id", as_double("qv").alias("qv"), as_double("dv").alias("dv"))
    from ..plans.materialize import materialize
    # written once to the shared folder, partitioned by batch: each job
    # prunes to its own batches and survives executor loss
    bp = materialize(bp, "adapter-batches", partition_by=["batch_id"])
    n_batches = int(bp.agg(F.max("batch_id")).first()[0]) + 1
    dim = int(bp.select(F.size("qv")).first()[0])
    W = np.eye(dim)
    m1 = np.zeros_like(W)
    m2 = np.zeros_like(W)
    best_W, best_step, best_acc = W.copy(), 0, 0.0
    hist = []
    scale, thresh = cfg["loss_scale"], cfg["loss_sim_thresh"]
    T, warm, lr0, vf = cfg["steps"], cfg["warmup_steps"], cfg["lr"], cfg["val_freq"]
    per_batch = cfg["batch_size"] * 2 * dim * 8
    seg = max(1, min(vf, SEGMENT_CAP // max(1, per_batch)))
    step = 0
    while step < T:
        if step % vf == 0:
            acc = float(adapter_accuracy(dev_queries, dev_judgments, corpus, W, untouched,
                                         cfg["val_k"]).first()["acc"] or 0.0)
            hist.append((step, acc))
            if step == 0 or acc > best_acc:
                best_acc, best_W, best_step = acc, W.copy(), step
            if step - best_step > cfg["step_wait"] or best_acc - acc > cfg["acc_diff_wait"]:
                break
        end = min(T, step + seg, (step // vf + 1) * vf)
        plan = [(t, t % n_batches) for t in range(step, end)]
        W, m1, m2 = run_segment(bp, (W, m1, m2), plan, scale, thresh, T, warm, lr0)
        step = end
    return AdapterResult(best_W, best_step, hist)


def run_segment(bp: DataFrame, state, plan, scale, thresh, T, warm, lr0):
    """One job: the steps of ``plan`` in a single task over just their
    batches; returns the new (W, m1, m2)."""
    spark = bp.sparkSession
    dim = state[0].shape[0]
    bc = spark.sparkContext.broadcast(state)
    ids = sorted({b for _, b in plan})
    r = (bp.filter(F.col("batch_id").isin(ids)).select("batch_id", "q_id", "record_id", "qv", "dv")
         .coalesce(1).mapInArrow(_segment_fn(bc, plan, scale, thresh, T, warm, lr0),
                                 "W array<double>, m1 array<double>, m2 array<double>").first())
    bc.unpersist()
    return tuple(np.asarray(r[c]).reshape(dim, dim) for c in ("W", "m1", "m2"))
