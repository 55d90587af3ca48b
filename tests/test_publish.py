import json
import os

import pytest
from pyspark.sql import functions as F

from lodestar.operators import datasets as DS
from lodestar.operators import embed as EM
from lodestar.sources import io as IO
from lodestar.sources import publish as P


def tables(spark, n):
    records = spark.range(n).select(F.col("id").alias("record_id"), F.lit(f"text {n}").alias("text"))
    queries = spark.createDataFrame([(5, "train"), (9, "train"), (7, "dev")], "q_id long, split string")
    judged = spark.createDataFrame([(5, 0, 1), (9, 1, 2), (9, 1, 1), (7, 1, 1)], "q_id long, record_id long, rel int")
    return records, queries, judged


def test_a_failed_write_leaves_the_version_before(spark, tmp_path):
    root = str(tmp_path / "set")
    assert P.current(spark, root) is None
    IO.write_published(*tables(spark, 3), root)
    first = P.current(spark, root)
    records, queries, judged = tables(spark, 4)
    broken = judged.withColumn("rel", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        IO.write_published(records, queries, broken, root)
    assert P.current(spark, root) == first and IO.read_published(spark, root)[0].count() == 3
    IO.write_published(records, queries, judged, root)
    assert [t.count() for t in IO.read_published(spark, root)] == [4, 3, 4]
    assert P.drop_old_versions(spark, root) == 1 and IO.read_published(spark, root)[0].count() == 4
    assert P.drop_old_versions(spark, root) == 0 and not os.path.exists(first)


def test_a_plain_folder_is_read_too(spark, tmp_path):
    root = str(tmp_path / "set")
    IO.write_published(*tables(spark, 3), root)
    assert IO.read_published(spark, P.current(spark, root))[0].count() == 3


def test_published_query_sets(spark, tmp_path):
    root = str(tmp_path / "set")
    records, queries, judged = tables(spark, 3)
    IO.write_published(records, queries.unionByName(spark.createDataFrame([(8, "dev")], queries.schema)), judged, root)
    _, asked, answers = IO.published_query_sets(spark, root)
    assert sorted((r.split, r.q_id) for r in asked.collect()) == [("dev", 0), ("train", 0), ("train", 1)]       # an unjudged query goes
    assert sorted((r.split, r.q_id, r.record_id, r.grade) for r in answers.collect()) == [
        ("dev", 0, 1, None), ("train", 0, 0, 1), ("train", 1, 1, 2)]


def test_a_retried_append_adds_no_row(spark, tmp_path):
    path = str(tmp_path / "results")
    row = spark.createDataFrame([("n", 0.5)], "finetuner string, recall_10 double")
    assert IO.append_result(row, path, "run-1") == "run-1"
    IO.append_result(row.withColumn("recall_10", F.lit(0.7)), path, "run-1")
    IO.append_result(row, path)
    assert sorted(r.recall_10 for r in spark.read.parquet(path).collect()) == [0.5, 0.7]
    with pytest.raises(ValueError):
        IO.append_result(row, path, "../x")


def test_beir_with_several_splits(spark, tmp_path):
    root = tmp_path / "beir"
    (root / "qrels").mkdir(parents=True)
    (root / "corpus.jsonl").write_text("".join(json.dumps({"_id": f"d{i}", "title": "t", "text": "x"}) + "\n" for i in range(3)))
    (root / "queries.jsonl").write_text("".join(json.dumps({"_id": f"q{i}", "text": f"question {i}"}) + "\n" for i in range(4)))
    for split, rows in (("train", ["q0\td0\t1", "q1\td1\t2"]), ("test", ["q1\td2\t1", "q2\td0\t1"])):
        (root / "qrels" / f"{split}.tsv").write_text("query-id\tcorpus-id\tscore\n" + "\n".join(rows) + "\n")
    corpus, queries, qrels = IO.read_beir_splits(spark, str(root))
    assert corpus.count() == 3
    assert sorted((r.split, r.q_id) for r in queries.collect()) == [("test", "q1"), ("test", "q2"), ("train", "q0"), ("train", "q1")]
    assert sorted((r.split, r.q_id, r.doc_id, r.passage_id, r.rel) for r in qrels.collect()) == [
        ("test", "q1", "d2", "0", 1), ("test", "q2", "d0", "0", 1), ("train", "q0", "d0", "0", 1), ("train", "q1", "d1", "0", 2)]
    with pytest.raises(FileNotFoundError):
        IO.read_beir_splits(spark, str(tmp_path))


def test_pooled_answers_and_grades(spark):
    def part(ids, judged):
        return (spark.createDataFrame([(i,) for i in ids], "q_id long"), spark.createDataFrame(judged, "q_id long, record_id long, rel int"))
    dev, test = part([4, 2], [(4, 10, 2), (2, 11, 1), (2, 11, 3)]), part([2, 9], [(2, 12, 1), (9, 10, 2)])
    pooled, judged = DS.pool_judgments({"dev": dev, "test": test})
    assert sorted((r.q_id, r.pre_split, r.old_q_id) for r in pooled.collect()) == [(0, "dev", 2), (1, "dev", 4), (2, "test", 2), (3, "test", 9)]
    assert sorted(map(tuple, judged.collect())) == [(0, 11, 3), (1, 10, 2), (2, 12, 1), (3, 10, 2)]
    plain = part([2, 9], [(2, 12, 1), (9, 10, 1)])
    assert all(r.grade is None for r in DS.pool_judgments({"dev": dev, "test": plain})[1].collect())
    unjudged = part([1], [])
    assert all(r.grade is None for r in DS.pool_judgments({"dev": dev, "test": unjudged})[1].collect())


def test_token_batches():
    assert EM.token_batches([], 10) == []
    assert EM.token_batches([30, 5, 5, 1], 10) == [(0, 1), (1, 3), (3, 4)]
    assert EM.token_batches([1] * 7, 100, 3) == [(0, 3), (3, 6), (6, 7)]
    for tokens in ([9, 8, 8, 7, 3, 2, 2, 1], [1, 2, 3, 50, 1]):
        got = EM.token_batches(tokens, 20)
        assert [i for a, b in got for i in range(a, b)] == list(range(len(tokens)))
        assert all(max(tokens[a:b]) * (b - a) <= 20 or b - a == 1 for a, b in got)


def test_length_order_saves_padding(spark):
    rows = [(i, "w " * (1 + i * 7919 % 97)) for i in range(600)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "record_id long, text string").repartition(3)
    seen = EM.embed_in_length_order(df, "text", budget=500).collect()
    assert sorted(r.record_id for r in seen) == sorted(i for i, _ in rows)
    plain = {r.record_id: r.embedding for r in EM.embed_column(df, "text").collect()}
    assert all(r.embedding == plain[r.record_id] for r in seen)
    assert all(r.padded * r.batch_rows <= 500 or r.batch_rows == 1 for r in seen)
    padding = 1 - sum(r.tokens for r in seen) / sum(r.padded for r in seen)
    tokens = [t.count(" ") + 1 for _, t in rows if t]
    mixed = 1 - sum(tokens) / sum(max(tokens[a:b]) * (b - a) for a, b in EM.token_batches(tokens, 500))
    assert padding < 0.1 < mixed
