import hashlib
import random

import pytest
import tiktoken
from public_tokenizers import PATTERN

from lodestar.llm import byte_bpe
from lodestar.llm.common import load

R = random.Random(5)
ODD = ["a", " ", "  ", "\n", "\t", "'s", "'LL", "é", "é", "日本語", "👍🏽", "\u200d", "\x1c", "\x85", "\xa0", "\ufeff", "\u3000", "123", "٣", "-=-", "<|endoftext|>"]


@pytest.fixture(scope="module")
def expected():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(byte_bpe.RANKS), special_tokens={})


def odd_text(n):
    return "".join(R.choice(ODD) for _ in range(n))


ROWS = [(1, None), (2, ""), (3, " \n\t "), (4, "Twice the same"), (4, "Twice the same"), (None, "no id"), (5, odd_text(400)),
        (6, "a" * 5000), (7, " " * 5000), (8, odd_text(20000))] + [(10 + k, odd_text(R.randint(1, 60))) for k in range(150)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as ids", "'y' as input", "1 as decoded")


def test_byte_table():
    table = byte_bpe.byte_characters()
    assert len(set(table)) == 256 and table[ord("A")] == "A" and table[32] == "Ġ" and table[10] == "Ċ" and table[173] == "Ń"


def test_digests_equal_the_other_library(spark, expected):
    def row(i, t):
        ids = expected.encode_ordinary(t or "")
        return (i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256((t or "").encode()).hexdigest())
    got = byte_bpe.digests(byte_bpe.round_trip(frame(spark, ROWS)))
    key = str
    assert sorted(map(tuple, got.collect()), key=key) == sorted((row(*r) for r in ROWS), key=key)


def test_whole_table(spark, expected):
    docs = load(spark, "/root/testdata/sf0.001", "documents")
    rows = byte_bpe.round_trip(docs)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    found = rows.collect()
    assert len(found) == len(texts)
    for r in found:
        assert r.ids == expected.encode_ordinary(texts[r.doc_id]) and bytes(r.decoded) == texts[r.doc_id].encode()


def test_offsets_cover_the_text(spark):
    for r, (_, text) in zip(byte_bpe.encode(frame(spark, ROWS).coalesce(1), offsets=True).collect(), ROWS):
        text = text or ""
        assert len(r.ids) == len(r.starts) == len(r.ends)
        assert (r.starts[0], r.ends[-1]) == (0, len(text)) if text else not r.ids
        decoded = byte_bpe.library(byte_bpe.RANKS)[1]
        for i, a, z in zip(r.ids, r.starts, r.ends):
            assert decoded[i] in text[a:z].encode()
        assert all(b <= z and a <= b for a, z, b in zip(r.starts, r.ends, r.starts[1:]))


def test_units_are_encoded_alike(expected, monkeypatch):
    monkeypatch.setattr(byte_bpe, "KNOWN_UNITS", 50)
    for text in [odd_text(300) for _ in range(60)] + ["x" * 1000, " \n" * 60, "word " * 60, " ", "a\xa0  b\x0b\x0b c\u3000 d \x1c !\x1c "]:
        assert "".join(byte_bpe.UNIT.findall(text)) == text
        ids, starts, ends = byte_bpe.encoded([text, "", None], byte_bpe.RANKS, True)[0]
        assert ids.tolist() == expected.encode_ordinary(text) == byte_bpe.encoded([text], byte_bpe.RANKS)[0][0].tolist()
        assert starts[0] == 0 and ends[-1] == len(text)


def test_every_character_splits_alike(expected):
    for mixed in ("a{0}b", "!{0}{0} ", "  {0} {0}  1{0}"):
        texts = [mixed.format(chr(c)) for c in [*range(0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x11000), *range(0x1F000, 0x20000)]]
        for text, ids in zip(texts, byte_bpe.encoded(texts, byte_bpe.RANKS)):
            assert ids[0].tolist() == expected.encode_ordinary(text), ascii(text)


def test_decoding(spark):
    half = byte_bpe.read_ranks(byte_bpe.RANKS)["é".encode()[:1]]
    rows = [(1, None), (2, []), (3, [half])]
    got = {r[0]: tuple(r)[1:] for r in byte_bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>")).collect()}
    assert got == {1: (None, None), 2: (b"", ""), 3: ("é".encode()[:1], "�")}
    with pytest.raises(Exception, match="KeyError"):
        byte_bpe.decode(spark.createDataFrame([(1, [10 ** 6])], "doc_id long, ids array<int>")).collect()


def test_empty_table(spark):
    got = byte_bpe.digests(byte_bpe.round_trip(frame(spark, [])))
    assert got.collect() == [] and got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
