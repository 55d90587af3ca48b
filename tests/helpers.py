import numpy as np


def vec_df(spark, ids, mat, id_col="record_id"):
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(ids, mat)]
    return spark.createDataFrame(rows, f"{id_col} long, embedding array<double>")


def brute_topk(Q, D, k, cos=True, qids=None, dids=None):
    """numpy reference: score desc, id asc, scores rounded to 12 places."""
    qids = np.arange(len(Q)) if qids is None else np.asarray(qids)
    dids = np.arange(len(D)) if dids is None else np.asarray(dids)
    if cos:
        D = D / np.maximum(np.linalg.norm(D, axis=1, keepdims=True), 1e-12)
    S = np.round(Q @ D.T, 12)
    out = []
    for i, q in enumerate(qids):
        o = np.lexsort((dids, -S[i]))[:k]
        out += [(int(q), r, int(dids[j]), float(S[i, j])) for r, j in enumerate(o)]
    return sorted(out)


def rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
