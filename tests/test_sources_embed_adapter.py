import json
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import adapter as AD
from lodestar.operators import embed as EM
from lodestar.sources import io as IO


@pytest.fixture(scope="module")
def tmp():
    return tempfile.mkdtemp(prefix="lodestar-test-")


def test_csv_tsv_kilt_beir(spark, tmp):
    p = os.path.join(tmp, "qs.csv")
    with open(p, "w") as f:
        f.write(',q_id,input\n0,7,"multi\nline, ""quoted"""\n1,8,plain\n')
    q = IO.read_query_csv(spark, p)
    assert q.columns == ["q_id", "input"]
    assert sorted(r["input"] for r in q.collect()) == ['multi\nline, "quoted"', "plain"]
    t = os.path.join(tmp, "q.qrel")
    with open(t, "w") as f:
        f.write("q1\t0\td1\t2\nq1\t0\td2\t1\n")
    r = IO.read_tsv(spark, t, "q_id string, zero int, doc_id string, rel int")
    assert r.count() == 2 and r.agg(F.sum("rel")).first()[0] == 3
    k = os.path.join(tmp, "kilt.jsonl")
    with open(k, "w") as f:
        f.write(json.dumps({"id": "a", "input": "x", "output": [{"answer": "y", "provenance": [
            {"wikipedia_id": "w1", "start_paragraph_id": 2}, {"wikipedia_id": "w1", "start_paragraph_id": 2}]},
            {"answer": "z"}]}) + "\n")
        f.write(json.dumps({"id": "b", "input": "x2", "output": [{"answer": "n"}]}) + "\n")
    from lodestar.operators import datasets as DS
    kq = IO.read_kilt(spark, k)
    assert [tuple(x) for x in DS.flatten_provenance(kq).collect()] == [("a", "w1", 2)]
    assert [x["id"] for x in DS.queries_with_provenance(kq).collect()] == ["a"]
    b = os.path.join(tmp, "beir")
    os.makedirs(f"{b}/qrels")
    with open(f"{b}/corpus.jsonl", "w") as f:
        f.write(json.dumps({"_id": "d1", "title": "t", "text": "body"}) + "\n")
    with open(f"{b}/queries.jsonl", "w") as f:
        f.write(json.dumps({"_id": "q1", "text": "what"}) + "\n")
    with open(f"{b}/qrels/dev.tsv", "w") as f:
        f.write("query-id\tcorpus-id\tscore\nq1\td1\t1\n")
    c, qq, qr, split = IO.read_beir(spark, b)
    assert split == "dev" and c.first()["passage_id"] == "0" and qr.first()["doc_id"] == "d1"


def test_published_roundtrip_and_shards(spark, tmp, fx):
    root = os.path.join(tmp, "pub")
    IO.write_published(fx.corpus, fx.queries.select("q_id", "split"), fx.judgments, root)
    recs, qs, rel = IO.read_published(spark, root)
    assert rel.count() == fx.judgments.count()
    dev = qs.filter("split = 'dev'")
    assert dev.agg(F.min("q_id"), F.max("q_id")).first()[:] == (0, dev.count() - 1)
    n = IO.write_embedding_shards(fx.corpus, os.path.join(tmp, "emb"), m=200, cap_gb=1 / 2 ** 16, dim=64)
    assert n == 2
    back = IO.read_shards(spark, os.path.join(tmp, "emb", "nontrain"))
    assert back.count() == 100 and sorted(r[0] for r in back.select("shard").distinct().collect()) == [0, 1]


def test_embed_and_resume(spark, tmp):
    d = spark.createDataFrame([(i, f"text {i} word") for i in range(50)] + [(50, None)], "record_id long, text string")
    e = EM.embed_column(d, "text", batch=7)
    rows = e.collect()
    assert len(rows) == 51 and all(abs(np.linalg.norm(r["embedding"]) - 1) < 1e-5 for r in rows)
    path = os.path.join(tmp, "resume")
    EM.embed_resumable(d.filter("record_id < 20"), "text", path)
    calls = []

    def counting(texts):
        calls.append(len(texts))
        return EM.hashing_embedder()(texts)
    out = EM.embed_resumable(d, "text", path, fn=counting)
    assert out.count() == 51 and out.select("record_id").distinct().count() == 51
    with pytest.raises(ValueError):
        EM.embed_column(d, "text", batch=4096)


def test_adapter_gradient_matches_finite_differences():
    rng = np.random.default_rng(2)
    Q, D = rng.normal(size=(6, 4)), rng.normal(size=(6, 4))
    W = np.eye(4) + 0.1 * rng.normal(size=(4, 4))
    loss, g = AD._loss_and_grad(Q, D, W, 20.0, -1.0, True)
    num = np.zeros_like(W)
    h = 1e-6
    for i in range(4):
        for j in range(4):
            Wp, Wm = W.copy(), W.copy()
            Wp[i, j] += h
            Wm[i, j] -= h
            num[i, j] = (AD._loss_and_grad(Q, D, Wp, 20.0, -1.0, False)[0]
                         - AD._loss_and_grad(Q, D, Wm, 20.0, -1.0, False)[0]) / (2 * h)
    assert np.allclose(g, num, atol=1e-5)


def test_adapter_fit_never_worse_than_identity(spark, fx):
    """Step 0 (identity) is always recorded."""
    from lodestar.operators import datasets as DS
    p = DS.training_pairs(fx.split("train"), fx.judged("train"), fx.corpus)
    r = AD.fit_adapter(p, fx.split("dev"), fx.judged("dev"), fx.corpus, batch_size=128, steps=3,
                       val_freq=1, warmup_steps=3)
    assert r.history[0][0] == 0
    best = max(a for _, a in r.history)
    assert best >= r.history[0][1]
    ident = AD.adapter_accuracy(fx.split("dev"), fx.judged("dev"), fx.corpus, None).first()["acc"]
    assert r.history[0][1] == pytest.approx(ident)


def test_load_processed_and_append(spark, tmp, fx):
    root = os.path.join(tmp, "proc")
    qsel = fx.queries.select("q_id", "split")
    IO.write_published(fx.corpus, qsel, fx.judgments, root)
    from lodestar.operators import datasets as DS
    rek = DS.rekey_per_split(fx.queries.select("q_id", "split", "embedding"))
    qemb = rek.select("q_id", "split", "embedding")
    recs, sets, ans, rest, m = IO.load_processed(spark, root, fx.corpus, qemb)
    assert set(sets) == {"train", "dev", "test"}
    assert sets["dev"].queries.count() == 200 and sets["test"].judgments.count() > 0
    assert ans.count() == m and (rest is None or rest.count() == 300 - m)
    out = os.path.join(tmp, "res")
    row = spark.createDataFrame([("t", "n", 0.5)], "test_name string, finetuner string, recall_10 double")
    IO.append_result(row, out)
    IO.append_result(row, out)
    assert spark.read.parquet(out).count() == 2


def test_embed_pairs_two_towers(spark):
    items = spark.createDataFrame([(1, "red car"), (2, "blue sky")], "doc_id long, text string")
    caps = spark.createDataFrame([(10, 1, "a red car"), (11, 2, "sky")], "q_id long, doc_id long, input string")
    a, b = EM.embed_pairs(items, caps, "text", "input")
    assert a.count() == 2 and b.count() == 2 and a.columns == ["doc_id", "embedding"]


def test_segmented_training_equals_step_by_step(spark, fx):
    """Several steps inside one task give the same state as applying the
    same updates one at a time on the driver."""
    from lodestar.operators import datasets as DS
    p = DS.training_pairs(fx.split("train"), fx.judged("train"), fx.corpus)
    bp = AD.batch_pairs(p, 128, 0).select("batch_id", "q_id", "record_id", "qv", "dv")
    rows = bp.collect()
    dim = len(rows[0]["qv"])
    nb = max(r["batch_id"] for r in rows) + 1
    plan = [(t, t % nb) for t in range(nb + 2)]          # wraps around: a batch is reused
    state = (np.eye(dim), np.zeros((dim, dim)), np.zeros((dim, dim)))
    W, m1, m2 = AD.run_segment(bp, state, plan, 20.0, -1.0, 10, 3, 1e-3)
    w, a, b = state
    for t, bid in plan:
        rs = sorted((r for r in rows if r["batch_id"] == bid), key=lambda r: (r["q_id"], r["record_id"]))
        Q = np.array([r["qv"] for r in rs])
        D = np.array([r["dv"] for r in rs])
        _, g = AD._loss_and_grad(Q, D, w, 20.0, -1.0, True)
        w, a, b = AD._adamw(w, a, b, g, t, AD._lr(t, 10, 3, 1e-3))
    assert not np.allclose(w, np.eye(dim))
    assert np.allclose(W, w) and np.allclose(m1, a) and np.allclose(m2, b)


def test_method_matrix_with_adapter(spark):
    from lodestar.plans import experiment as EX
    m = EX.method_matrix(spark, {"fx": "/root/testdata/sf0.001"}, methods=("no_ft", "adapter"),
                         metrics=[("recall", 10), ("ndcg", 10)],
                         adapter_settings=dict(batch_size=256, steps=4, val_freq=2, warmup_steps=4))
    rows = {r["finetuner"]: r for r in m.collect()}
    assert set(rows) == {"no_ft", "adapter"} and rows["no_ft"]["recall_10"] == pytest.approx(1.0)
    assert 0 <= rows["adapter"]["ndcg_10"] <= 1
    rep = EX.method_report(m).collect()
    assert len(rep) == 2


def test_method_matrix_on_own_tables(spark, tmp, fx):
    """A published set of one's own: answerable records are tuned, the rest competes, the adapter trains."""
    from lodestar.operators import datasets as DS
    from lodestar.plans import experiment as EX
    root = os.path.join(tmp, "own")
    order = DS.train_first_order(fx.corpus, fx.judgments, fx.queries.filter("split <> 'test'").select("q_id"))
    corpus = order.drop("record_id").withColumnRenamed("new_id", "record_id")
    judged = fx.judgments.join(order.select("record_id", "new_id"), "record_id").select("q_id", F.col("new_id").alias("record_id"), "rel")
    IO.write_published(corpus.select("record_id"), fx.queries.select("q_id", "split"), judged, root)
    emb = DS.rekey_per_split(fx.queries.select("q_id", "split", "embedding")).select("q_id", "split", "embedding")
    own = EX.processed_set(spark, root, corpus, emb)
    m = EX.method_matrix(spark, {"own": own, "fx": "/root/testdata/sf0.001"}, methods=("no_ft", "n", "m", "adapter"),
                         metrics=[("recall", 10), ("ndcg", 10)], config={"model": "hash", "dim": 64},
                         adapter_settings=dict(batch_size=256, steps=2, val_freq=2, warmup_steps=2))
    rows = {(r["q_set"], r["finetuner"]): r for r in m.collect()}
    assert len(rows) == 8 and all(r["config_model"] == "hash" and r["config_dim"] == 64 for r in rows.values())
    for method in ("no_ft", "n", "m", "adapter"):
        a, b = rows["own", method], rows["fx", method]
        assert (a["recall_10"], a["ndcg_10"]) == pytest.approx((b["recall_10"], b["ndcg_10"]), abs=2e-3), method
        assert a["gamma"] == b["gamma"] or a["gamma"] == pytest.approx(b["gamma"])


def test_shard_layout_arithmetic():
    # max_rows = cap_gb * 2^28 / dim; shards = ceil(n / max_rows); rows = ceil(n / shards)
    assert IO.shard_layout(1000, 1 / 2 ** 16, 64) == (16, 63)
    assert IO.shard_layout(64, 1 / 2 ** 16, 64) == (1, 64)
    assert IO.shard_layout(0, 1.0, 64) == (0, 0)
    assert IO.shard_layout(10 ** 9, 80, 384) == (18, 55555556)
