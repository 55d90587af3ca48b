"""What the language model writes while it learns."""
from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lodestar.llm import language_model


def test_pairs_stay_packed(spark, monkeypatch):
    """95 000 pairs: no table that is written, nor the model that is left, has a row for each."""
    r = np.random.default_rng(3)
    rows = [(" ".join(f"w{x}" for x in r.integers(0, 3000, 500)),) for _ in range(200)]
    counts, write = [], language_model.materialize

    def written(df, name, *more):
        out = write(df, name, *more)
        counts.append(out.count())
        return out

    monkeypatch.setattr(language_model, "materialize", written)
    model = language_model.fit(spark.createDataFrame(rows, "text string"))
    assert model.tokens == 200 * 501 and model.v == 3001
    assert model.pairs.count() == len({p for t, in rows for p in zip([None, *t.split()], [*t.split(), ""])}) > 90000
    assert max(counts) <= 3001


def test_messages_follow_the_data(spark, monkeypatch):
    """8000 tokens, however many partitions a shuffle has: few groups, and few messages from these to their homes in a sweep."""
    r = np.random.default_rng(5)
    rows = [(" ".join(f"w{x}" for x in r.integers(0, 300, 200)),) for _ in range(40)]
    groups, messages, write = [], [], language_model.materialize

    def written(df, name, *more):
        out = write(df, name, *more)
        if name == "lm-pairs":
            groups.append(out.count())
        if name == "lm-seats":
            messages.append(out.agg(F.sum(F.length("homes") / 8)).first()[0])
        return out

    monkeypatch.setattr(language_model, "materialize", written)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        model = language_model.fit(spark.createDataFrame(rows, "text string"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert model.tokens == 40 * 201 and model.v == 301
    assert groups[0] <= 16 and len(messages) == language_model.SWEEPS and max(messages) <= 100


def test_sorted_places():
    r = np.random.default_rng(7)
    many = r.integers(0, 1 << 63, 5000).astype(np.uint64)
    for keys in (many[:0], many[:1], many, many[r.integers(0, 50, 5000)], r.integers(0, 999, 5000).astype(np.uint64), many | np.uint64(1 << 63)):
        assert (keys[language_model._order(keys)] == np.sort(keys)).all()
        found, at = language_model._distinct(keys)
        assert (found == np.unique(keys)).all() and (found[at] == keys).all()
