import csv
import io
import random

import pytest

from lodestar.sources import csv_blocks as C
from lodestar.sources.io import read_query_csv

R = random.Random(2)
PIECES = ["a", "word", '"', '""', ",", "\n", "\r\n", "\n\n", " ", "é", '",', ',"', '"\n"', "long text " * 9]


def field():
    return "".join(R.choice(PIECES) for _ in range(R.randint(0, 6)))


def written(rows, end):
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end)
    w.writerows(rows)
    return out.getvalue()


@pytest.fixture
def blocks(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def rows_of(df):
    return sorted(tuple(v or "" for v in r) for r in df.collect())


@pytest.mark.parametrize("size", [30, 100, 1000, 10 ** 6])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_any_block_size(spark, blocks, tmp_path, size, end):
    rows = [(str(i), field(), field()) for i in range(60)] + [("x", '"' + "\n" * 400 + '"', "many blocks inside")]
    R.shuffle(rows)
    for name, some in (("a", rows[:30]), ("b", rows[30:])):
        (tmp_path / f"{name}.csv").write_bytes(written([("id", "in\nput", 'o"ther'), *some], end).encode())
    blocks(size)
    got = C.read_csv(spark, str(tmp_path))
    assert got.columns == ["id", "in\nput", 'o"ther']
    assert rows_of(got) == sorted(rows)
    if size == 30:
        lines = spark.read.option("lineSep", "\n").text(str(tmp_path))
        assert lines.rdd.getNumPartitions() > 20


def test_bare_quotes_blank_lines_and_a_missing_line_end(spark, blocks, tmp_path):
    text = 'id,input\n\n1,5" disk\n2,"two ""quoted"" words\nand a line"\n\n3,\n4,""\n5,end "of" it\n6,"no\nline end"'
    (tmp_path / "q.csv").write_text(text)
    for size in (7, 20, 10 ** 6):
        blocks(size)
        got = {r.id: r.input for r in read_query_csv(spark, str(tmp_path / "q.csv")).collect()}
        plain = spark.read.options(header=True, **C.OPTIONS).csv(str(tmp_path / "q.csv"))
        assert got == {r.id: r.input for r in plain.collect()}
        assert got == {"1": '5" disk', "2": 'two "quoted" words\nand a line', "3": None, "4": got["4"], "5": 'end "of" it', "6": "no\nline end"}


def test_state_of_lines():
    def slow(line, inside):
        state = "in" if inside else "start"
        for i, c in enumerate(line):
            if state == "in":
                state = "quote" if c == '"' else "in"
            elif state == "quote":
                state = "in" if c == '"' else "start" if c == "," else "plain"
            elif c == ",":
                state = "start"
            else:
                state = "in" if state == "start" and c == '"' else "plain"
        return state == "in"
    for _ in range(3000):
        line = "".join(R.choice('a",') for _ in range(R.randint(0, 12)))
        for inside in (False, True):
            assert C.ends_inside(line, inside) == slow(line, inside), line


def test_no_rows(spark, tmp_path):
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "head.csv").write_text("id,input\n")
    assert C.read_csv(spark, str(tmp_path / "none.csv")).collect() == []
    got = C.read_csv(spark, str(tmp_path / "head.csv"))
    assert got.collect() == [] and got.columns == ["id", "input"]
