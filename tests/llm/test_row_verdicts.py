"""Rows of equal id are judged by their own texts: no clean row goes with another's verdict."""
import random

import corpus_pipeline
from lodestar.llm import decontaminate, jaccard_join

R = random.Random(21)
NAMES = [a + b for a in ("ka", "lo", "mi", "ru", "te", "zo") for b in ("ban", "dor", "fel", "gim", "hus", "jax", "pol", "ver")]


def prose(n):
    return " ".join(R.choice(NAMES) for _ in range(n))


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema).selectExpr("*", "'x' as tag", "1 as away_id", "2 as leaked_id", "'y' as point")


def test_near_copies_that_share_an_id(spark):
    base, other, third = prose(80), prose(80), prose(80)
    near = base + " " + prose(3)
    rows = [(1, base), (5, near), (5, other), (5, None), (7, other + " more"), (9, third), (None, base)]
    kept = [(r.doc_id, r.text) for r in jaccard_join.keep_one_of_each(frame(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([(1, base), (5, other), (5, None), (9, third), (None, base)], key=str)
    classes = {(r.doc_id, r.n_shingles > 0, r.component_id) for r in jaccard_join.near_duplicates(frame(spark, rows)).collect()}
    assert (5, True, 1) in classes and (5, True, 5) in classes and (7, True, 5) in classes and (5, False, 5) in classes


def test_leaks_that_share_an_id(spark):
    item = "Which of these nine blue boxes holds the seven red marbles that Tom lost in May?"
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    rows = [(1, prose(30) + " " + item + " " + prose(30)), (1, prose(60)), (2, prose(60)), (None, item), (1, None)]
    kept = [(r.doc_id, r.text) for r in decontaminate.without_leaks(frame(spark, rows), bench).collect()]
    assert sorted(kept, key=str) == sorted(rows[1:], key=str)
    assert {r.doc_id for r in decontaminate.leaks(frame(spark, rows), bench).collect()} == {1, None}


def test_whole_pipeline_keeps_clean_rows(spark, tmp_path):
    """run() on documents of which the fate is known by construction."""
    item = "Which of these nine blue boxes holds the seven red marbles that Tom lost in May?"

    def lines(n):
        return "\n".join(" ".join(R.choice(NAMES) for _ in range(12)).capitalize() + "." for _ in range(n))
    clean = [(i, lines(6 + i % 5)) for i in range(1, 25)]
    base, secret = clean[0][1], "password = hunter2hunter2XY"
    rows = clean + [(100, base + "\nOne more line of prose stands here, and it ends with a stop."),          # near copy
                    (2, base), (101, base),                                                          # copies, one under another's id
                    (102, lines(5) + "\n" + item + "\n" + lines(5)), (3, lines(5) + "\n" + item),     # leaks, one under another's id
                    (103, lines(6) + "\nThe " + secret + " was written on a note that stood there."),
                    (104, "too short"), (105, None), (106, ""), (None, lines(7))]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows],
                               "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, left = df, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == df.columns
        left[name] = sorted(((r.doc_id or 0, r.text) for r in docs.collect()))
    good = sorted([*clean, (0, rows[-1][1])])
    by_quality = [r for r in left["quality_rules"] if r[0] not in (100, 101, 102, 103) and r != (2, base) and r[1] and item not in r[1]]
    assert by_quality == good and not {104, 105, 106} & {r[0] for r in left["quality_rules"]}
    kept = left["jaccard_join"]
    assert [r for r in kept if r[0] < 100 and item not in r[1]] == good and not {100, 101} & {r[0] for r in kept}
    assert [r for r in left["benchmark_leaks"] if r[0] != 103] == good
    last = left["secret_scan"]
    assert [r for r in last if r[0] != 103] == good and all(secret.split(" = ")[1] not in t for _, t in last)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id or 0 for r in packed} == {r[0] for r in last}
