import os
import tempfile

from lodestar.streaming.embed_stream import embed_stream


def test_stream_resumes_and_embeds_each_record_once(spark):
    root = tempfile.mkdtemp(prefix="lodestar-stream-")
    src = f"{root}/in"
    d = spark.createDataFrame([(i, f"w{i} x") for i in range(30)], "record_id long, text string")
    d.filter("record_id < 20").write.parquet(f"{src}/a")
    calls = []

    def fn(texts):
        from lodestar.operators.embed import hashing_embedder
        calls.append(len(texts))
        return hashing_embedder()(texts)
    args = (spark, f"{src}/*", "record_id long, text string", f"{root}/out", f"{root}/ckpt")
    embed_stream(*args, fn=fn)
    assert spark.read.parquet(f"{root}/out").count() == 20
    d.filter("record_id >= 20").write.parquet(f"{src}/b")
    embed_stream(*args, fn=fn)
    out = spark.read.parquet(f"{root}/out")
    assert out.count() == 30 and out.select("record_id").distinct().count() == 30
    embed_stream(*args, fn=fn)                   # nothing new: no-op
    assert spark.read.parquet(f"{root}/out").count() == 30
    assert os.path.isdir(f"{root}/ckpt")
