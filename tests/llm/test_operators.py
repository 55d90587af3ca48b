import hashlib
import json
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from lodestar.llm import (chat_records, decontaminate, language_model, packing, page_text, quality_rules,
                          repeated_passages, secrets, token_counts, words)

SCHEMA = "doc_id long, text string"
R = random.Random(7)
WORDS = ["the", "of", "and", "né", "ß", "Long-word", "x1", "42", "it's", "!", "a.b", "…"]


def text(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


ROWS = [(1, None), (2, ""), (3, " \n\t"), (4, text(30)), (5, text(3000)), (5, text(30)), (6, "a b"), (None, text(20)),
        (7, text(40)), (7, text(40)), (8, "word " * 500)]
ROWS += [ROWS[3], (9, ROWS[3][1])]


def frame(spark, rows=None):
    return spark.createDataFrame(ROWS if rows is None else rows, SCHEMA).selectExpr(
        "*", "'x' as n_words", "'y' as input", "1 as w", "2 as tag", "'z' as point")


def test_quality_figures(spark):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                  for r in quality_rules.judge(frame(spark)).collect())

    def figures(i, t):
        t = t or ""
        w = t.encode().split()
        lines = [x for x in t.split("\n") if x.encode().split()]
        grams = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
        rep = {p for k in range(len(w) - 4) if grams[tuple(w[k:k + 5])] > 1 for p in range(k, k + 5)}
        return (i, len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)),
                len(rep), len(w) < 10 or 100 * len(rep) > 20 * len(w))
    assert got == Counter(figures(i, t) for i, t in ROWS)


def test_quality_lines(spark):
    good = "This is a sentence with enough words to be read as prose."
    other = "Another line follows here, and it ends as prose does, with a full stop."
    rows = [(1, good + "\nHome | News | About | Contact | Shop\n" + other), (2, "a | b | c | d | e | f | g | h | i | j | k |"),
            (3, "$$$ %%% &&& *** " * 10 + "\n" + good)]
    got = {r.doc_id: r for r in quality_rules.judge(frame(spark, rows)).collect()}
    assert got[1].kept and got[1].clean_text == good + "\n" + other and not got[2].kept and not got[3].kept
    kept = quality_rules.clean(frame(spark, rows))
    assert [r.doc_id for r in kept.collect()] == [1] and len(kept.columns) == 7
    assert quality_rules.clean(frame(spark, [])).collect() == []


def test_secret_spans(spark):
    key = "AKIA" + "Q7" * 8
    t = f"é password = 'abcd1234' {key} token=short " + "0f" * 16 + " AbC9dEf3GhI7jKl2MnO5pQ"
    base = secrets.base_spans(t)
    assert [(k, t[a:b]) for a, b, k in base] == [("assign", "password = 'abcd1234"), ("access", key), ("hex", "0f" * 16)]
    assert [t[a:b] for a, b, _ in secrets.added_spans(t, base)] == ["AbC9dEf3GhI7jKl2MnO5pQ"]
    assert not secrets.added_spans("see 123e4567-e89b-12d3-a456-426614174000", [])
    assert not secrets.added_spans("sha256: " + hashlib.sha256(b"x").hexdigest().upper(), [])
    out = {r.doc_id: r for r in secrets.scan(frame(spark, [(1, t), (2, None)])).collect()}
    want = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
    assert out[1].base_sha256 == hashlib.sha256(want.encode()).hexdigest() and out[2].spans == []
    assert secrets.redact(frame(spark, [(1, t)])).first().text.startswith("é [ASSIGN]' [ACCESS] ")


def test_entropy_counts_match_direct_sums():
    t = "".join(R.choice("abcdefGHIJ0123") for _ in range(300))
    direct = [i for i in range(281) if -sum(c / 20 * np.log2(c / 20) for c in Counter(t[i:i + 20]).values()) >= 3.3]
    covered = {p for a, b in secrets.entropy_spans(t, 20, 3.3, 0, 0, 0) for p in range(a, b)}
    assert covered == {p for i in direct for p in range(i, i + 20)}


def test_token_counts_match_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, counter = Tokenizer.from_file(path), token_counts.Counter(path)
    parts = ["a", "the", " ", "  ", "\n", "'s", "'re", "'", "1", "!!", "é", "中", " ", "<|endoftext|>", "don't", "\x85", "👍"]
    texts = ["".join(R.choice(parts) for _ in range(R.randint(0, 40))) for _ in range(2000)]
    assert counter(texts).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(frame(spark)).collect())
    assert got == Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in ROWS)


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(i, t) for i, (_, t) in enumerate(ROWS)]
    got = packing.pack_documents(frame(spark, rows)).toPandas()
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        mine = got[got.doc_id == i].sort_values("start")
        assert mine.length.sum() == len(ids) and (mine.doc_tokens == len(ids)).all()
        assert all(zlib.crc32(ids[s:s + n].tobytes()) == c for s, n, c in zip(mine.start, mine.length, mine.ids_crc32))
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 2048
    assert packing.pack_documents(frame(spark, [])).collect() == []


@pytest.mark.parametrize("cache", [40, 1_000_000])
def test_words_encoded_together_match_the_library(monkeypatch, cache):
    monkeypatch.setattr(packing, "CACHE_WORDS", cache)
    monkeypatch.setattr(packing, "_IDS", {})
    library = packing.word_ids("word_bpe_49k.json")[0]
    r = random.Random(5)
    parts = ["a", "É", "e", "\u0301", " ", "\t", "\x01", "<|endoftext|>", "'s", "12", "…", "\u2003", "\xa0", "中", "\x00", "İ", "n't", "."]
    for _ in range(60):
        some = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(9)]
        for t, ids in zip(some, packing.encode([t.encode() for t in some], "word_bpe_49k.json")):
            assert np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() == ids


def test_repeated_passages_match_brute_force(spark):
    words = [f"w{k}" for k in range(25)]
    shared = [R.choice(words) for _ in range(60)]
    rows = [(i, " ".join([R.choice(words) for _ in range(R.randint(0, 30))] + (shared[R.randint(0, 20):] if i % 2 else [])
                         + [R.choice(words) for _ in range(R.randint(0, 30))])) for i in range(60)] + [(100, None), (101, "")]
    rows += [rows[3], (None, rows[5][1])]
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = (t or "").split()
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k:k + 13]), i)

    def want(i, t):
        w = (t or "").split()
        keep = [True] * len(w)
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k:k + 13])] < i:
                keep[k:k + 13] = [False] * 13
        kept = [x for x, y in zip(w, keep) if y]
        return i, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256)
                  for r in repeated_passages.remove_repeats(frame(spark, rows)).collect())
    assert got == Counter(want(i, t) for i, t in rows)


def test_word_hashes_by_eight_bytes():
    r, seen = random.Random(3), {}
    for _ in range(200):
        texts = [None if r.random() < .1 else "".join(r.choice("aAbBé \t\n\x1f\x00") for _ in range(r.choice([0, 1, 5, 80, 300])))
                 + "x" * r.choice([0, 0, 70]) for _ in range(r.randint(1, 8))]
        for kind in (pa.string(), pa.large_string()):
            part = pa.array(texts, kind).slice(r.randint(0, len(texts) - 1))
            hashes, n = words.hashes_of_words(part, lower=True)
            split = words.split_words(part, lower=True)
            assert [len(w) for w in split] == n.tolist()
            for w, h in zip([w for ws in split for w in ws], hashes.tolist()):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert words.hashes_of_words(pa.array([], pa.string()))[1].tolist() == []


def test_language_model(spark):
    base = ["alpha", "beta", "gamma", "delta", "of", "the"]
    rows = [(i, " ".join(R.choice(base) for _ in range(30))) for i in range(60)] + [(100, None), (101, "unknown words here"), (None, "the")]
    rows.append(rows[4])
    got = language_model.score_held_out(frame(spark, rows)).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    tokens = lambda t: [*(t or "").lower().split(), None]
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n,
                    round(sum(np.log10((c[w] + .1) / (n + .1 * (v + 1))) for w in tokens(t)), 6)) for i, t in rows)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_every_context_has_its_restaurant(spark):
    """300 contexts, all as rare as each other: what follows them is known, and each context's probabilities sum to 1."""
    rows = [(i, f"left{i} right{i} left{i} right{i}") for i in range(300)] + [(1000 + k, "the left0 right1") for k in range(40)] + [(2000, None)]
    texts = frame(spark, rows).selectExpr("coalesce(text, '') as text")
    model = language_model.fit(texts)
    pairs = Counter()
    for _, t in rows:
        w = (t or "").split()
        pairs.update(zip([None, *w], [*w, ""]))
    got = model.pairs.toPandas()
    assert sorted(got.c) == sorted(pairs.values()) and got.u.nunique() == len({u for u, _ in pairs})
    backs, roots = ({r[0]: np.array(r[1]) for r in d.collect()} for d in (model.contexts, model.words.select("w", "roots")))
    whole = sum(roots.values())
    assert np.allclose(whole + np.array(model.unknown), 1)
    for u, g in got.groupby("u"):
        other = whole - sum(roots[w] for w in g.w) + np.array(model.unknown)
        assert abs(g.p.sum() + (backs[u] * other).mean() - 1) < 1e-9
    asked = spark.createDataFrame([(i, f"left{i} right{i + d}") for d in (0, 1) for i in range(1, 299)], "doc_id long, text string")
    out = language_model.score(asked.selectExpr("text", "doc_id * 2 + if(text = concat('left', doc_id, ' right', doc_id), 0, 1) as doc_id",
                                                "true as held_out"), model)
    scores = {r.doc_id: r.score for r in out.collect()}
    assert len(scores) == 596 and all(scores[2 * i] > scores[2 * i + 1] + 0.5 for i in range(1, 299))


@pytest.mark.parametrize("listed", [0, 1 << 18])
def test_scores_do_not_depend_on_the_list(spark, monkeypatch, listed):
    """Pairs in the broadcast list, pairs joined, new pairs, new contexts and new words; hot keys and repeated rows."""
    r = random.Random(2)
    rows = [(i, " ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 40)))) for i in range(200)]
    monkeypatch.setattr(language_model, "FREQUENT_PAIRS", listed or 1)
    monkeypatch.setattr(language_model, "HOT_LEAST", 3)
    monkeypatch.setattr(language_model, "HOT_KEYS", 20)
    model = language_model.fit(frame(spark, rows).select("text"))
    h = lambda t: words.hashes_of_words(pa.array([t]))[0].view(np.int64).tolist()
    end, start = (int(np.uint64(x).view(np.int64)) for x in (language_model.END, language_model.START))
    pairs = {(x.u, x.w): x.p for x in model.pairs.collect()}
    backs, roots = ({x[0]: x[1] for x in d.collect()} for d in (model.contexts, model.words.select("w", "roots")))
    asked = [*rows[:20], (500, "a zz b"), (500, "a zz b"), (500, "zz zz"), (None, "q a h"), (501, "")]

    def want(t):
        w = [*h(t), end]
        return sum(np.log10(pairs[p] if p in pairs else np.mean([x * y for x, y in zip(backs.get(p[0], [1, 1]), roots.get(p[1], model.unknown))]))
                   for p in zip([start, *w], w))
    out = language_model.score(frame(spark, asked).selectExpr("text", "doc_id", "false as held_out"), model).collect()
    assert Counter((x.doc_id, x.n_tokens, round(x.score, 8)) for x in out) == \
        Counter((i, len(t.split()) + 1, round(float(want(t)), 8)) for i, t in asked)


def test_page_text():
    tree = page_text.grow(page_text.labelled())
    assert all(page_text.decide(tree, r[:-1]) == r[-1] for r in page_text.labelled())
    page = ("<nav><a href=x>Home</a></nav><div class='cookie-notice'>We use cookies</div><main><h1>Title &amp; more</h1>"
            "<p>Some&nbsp;text <a href=y>here</a>.<p>Second<br>line<aside>side</aside><form>mail</form>"
            "<div id=comments><p>nice</div></main><footer>c</footer><script>var a='<p>no</p>'</script>")
    assert page_text.main_text(page, tree) == "Title & more\nSome text here.\nSecond line"


def test_page_text_in_wrappers_and_broken_elements():
    tree = page_text.grow(page_text.labelled())
    body = [f"This is paragraph {k} of the article, and it has quite a few words to be read by whoever likes them." for k in range(4)]
    paragraphs, want = "".join(f"<p>{t}</p>" for t in body), "\n".join(body)
    menu = "<div class=menu><a href=x>Home</a> <a href=y>News</a></div>"
    foot = "<div class='site-footer'>All rights reserved by somebody or other, who lives in a house by the sea.</div>"
    for name in ("page has-sidebar", "layout no-sidebar", "content-with-nav", "elementor-widget-theme-post-content", "sticky-footer"):
        for inner in (paragraphs, f"<article>{paragraphs}</article>", f"<main>{paragraphs}</main>"):
            assert page_text.main_text(f"<body><div class='{name}'>{menu}{inner}</div>{foot}", tree) == want, (name, inner[:9])
    assert page_text.main_text(f"<form id=aspnet>{menu}<main>{paragraphs}</main></form>", tree) == want
    assert page_text.main_text(f"<article>{paragraphs}<div class=comments>" + "<div class=comment><p>Nice text, I liked it.</p></div>" * 3
                               + "</div></article>", tree) == want
    for broken in ("<svg width=1 />", "<svg><path d='M0'/><title>x</title></svg>", "<object-card></object-card>", "<svg-icon name=a></svg-icon>",
                   "<div><object data=x></div>", "<svg><path>", "<script-loader src=x></script-loader>", "<script>var p = '<p>no</p>'</script>"):
        for page in (f"{broken}{paragraphs}", f"<article>{broken}{paragraphs}</article>"):
            assert page_text.main_text(page, tree) == want, broken
    assert page_text.main_text("<p>One <svg><title>no</title><text>no</text></svg>word.</p>", tree) == "One word."
    talk = ["Where were you?", "I was out.", "Out where?", "By the river, all day."]
    assert page_text.main_text(f"{menu}<h2>A short talk</h2>" + "".join(f"<p>{t}</p>" for t in talk), tree) == "\n".join(["A short talk", *talk])


def test_page_rows(spark):
    df = spark.createDataFrame([(1, "u", None), (1, "u", ""), (None, None, "<article><p>x</p></article>")],
                               "page_id long, url string, html string").selectExpr("*", "'t' as text")
    assert sorted(((r.page_id, r.text, r.n_chars) for r in page_text.extract(df).collect()), key=str) == \
        sorted([(1, "", 0), (1, "", 0), (None, "x", 1)], key=str)


def test_leaks(spark):
    item = "Tom has 12 apples and gives 5 apples to Anna, so how many apples does Tom have left after 3 days?"
    rows = [(1, "Intro words. " + item + " More."), (2, item.replace("12", "40").replace("Tom", "Tim")), (3, "nothing alike " * 30),
            (4, None), (5, item.lower().replace(",", "")), (6, " ".join(item.split()[:6])), (None, item)]
    bench = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.changed_slots > 0 for r in decontaminate.leaks(frame(spark, rows), bench).collect()}
    assert got == {(1, 7): False, (2, 7): True, (5, 7): False, (None, 7): False}
    assert sorted((r.doc_id or 0) for r in decontaminate.without_leaks(frame(spark, rows), bench).collect()) == [0, 3, 4, 6]


def test_leaks_of_items_full_of_numbers(spark):
    items = {1: "What is 12 times 34?", 2: "Add 12, 15, 18, 21 and 24.", 3: "If f(2) = 3, f(3) = 7 and f(5) = 11, find f(9).",
             4: "2 4 8 16 32 64 128 256 512 1024", 5: "Sort 5 3 9 1 7 2 8 6 4 11 13 17 19 and then 23 29 31 37 41 43 47."}
    rows = [(10 * i, "We were asked this before. " + t + " That was all of it.") for i, t in items.items()]
    rows += [(11, "Tell me: what is 56 times 78? Thanks."), (12, "What is 12 divided by 34? Thanks."), (21, "So add 1, 2, 3, 4 and 5."),
             (22, "So add 1, 2, 3, 4 or 5."), (23, "Then add 7, 7, 7, 8 and 9."), (31, "if f(4) = 8, f(8) = 1 and f(6) = 12, find f(10)."),
             (41, "They had 3 5 9 17 33 65 129 257 513 1025 of them."),
             (51, "Sort 50 30 90 10 70 20 80 60 40 110 130 170 190 and then 230 290 310 370 410 430 470."), (60, "1 2 3 " * 30)]
    got = {(r.doc_id, r.item_id): r.changed_slots for r in decontaminate.leaks(
        frame(spark, rows), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    assert {k: n > 0 for k, n in got.items()} == {**{(10 * i, i): False for i in items}, (11, 1): True, (21, 2): True, (31, 3): True, (51, 5): True}


def test_chat_records(spark):
    call = {"tool_calls": [{"id": "b", "name": "f", "arguments": {"x": 1}, "after": ["a"]}, {"id": "a", "name": "f", "arguments": "{\"x\":\"q\"}"},
                           {"id": "c", "name": "g", "after": ["d"]}, {"id": "d", "name": "g", "after": ["c"]}]}
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", json.dumps(call)), (1, 2, "tool", '{"tool_call_id":"a","content":{"z":1,"a":2}}'),
            (None, None, None, None), (2, 0, "assistant", "{bad"), (2, 0, "assistant", "{bad")]
    schemas = spark.createDataFrame([("f", '{"properties":{"x":{"type":"integer"}},"required":["x"]}')], "name string, schema string")
    got = chat_records.link(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), schemas).collect()
    assert len(got) == 6
    one = next(r for r in got if r.conv_id == 1 and r.turn == 1)
    assert (one.n_calls, one.n_linked, one.n_invalid, one.n_cyclic) == (4, 1, 1, 2)
    assert [(c["id"], c["level"], c["valid"]) for c in json.loads(one.record)["tool_calls"]] == \
        [("a", 0, False), ("b", 1, True), ("c", None, True), ("d", None, True)]
    assert next(r.record for r in got if r.turn == 2) == \
        '{"content":{"a":2,"z":1},"conv_id":1,"role":"tool","tool_call_id":"a","turn":2}'


def test_calls_of_repeated_identifiers_are_kept(spark, monkeypatch):
    monkeypatch.setattr(chat_records, "TURNS", 3)
    call = lambda *ids, x=1, after=(): json.dumps({"tool_calls": [
        {"id": i, "name": "f", "arguments": {"x": x}, "after": list(after)} for i in ids]})
    answer = lambda i: json.dumps({"tool_call_id": i, "content": "r"})
    rows = [(1, 0, "assistant", call("call_0")), (1, 1, "tool", answer("call_0")), (1, 2, "tool", answer("call_0")),
            (1, 20, "assistant", call("call_0", x="bad", after=["call_0"])), (1, 27, "tool", answer("call_0")),
            (1, 30, "assistant", call("call_0", after=["call_9"])), (1, 40, "assistant", call("call_9", "call_9", after=["call_0"])),
            (1, 41, "tool", answer("call_9")), (2, 50, "tool", answer("call_0")),
            (None, 3, "assistant", call("call_0", x="bad", after=["call_0"])), (None, 4, "tool", answer("call_0")),
            (3, None, "assistant", call("call_0")), (None, None, "assistant", call("call_0", "call_1"))]
    rows.append(rows[3])
    schemas = spark.createDataFrame([("f", '{"properties":{"x":{"type":"integer"}}}')], "name string, schema string")
    got = chat_records.link(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), schemas).collect()
    assert Counter((r.conv_id, r.turn, r.n_calls, r.n_linked, r.n_invalid, r.n_cyclic) for r in got if r.role == "assistant") == Counter(
        [(1, 0, 1, 1, 0, 0), *[(1, 20, 1, 1, 1, 0)] * 2, (1, 30, 1, 0, 0, 1), (1, 40, 2, 1, 0, 2), (None, 3, 1, 0, 1, 0),
         (3, None, 1, 0, 0, 0), (None, None, 2, 0, 0, 0)])
    found = {(r.conv_id, r.turn): [(c["id"], c["level"], c["result_turn"]) for c in json.loads(r.record).get("tool_calls", [])] for r in got}
    assert len(got) == len(rows) and found[1, 0] == [("call_0", 0, 1)] and found[1, 20] == [("call_0", 1, 27)]
    assert found[1, 30] == [("call_0", None, None)] and found[1, 40] == [("call_9", None, None), ("call_9", None, 41)]


def test_calls_are_held_against_the_schemas_of_their_conversation(spark):
    told = lambda **kinds: json.dumps({"tools": [
        {"name": n, "parameters": {"properties": {"x": {"type": k}}, "required": ["x"]}} for n, k in kinds.items()]})
    call = lambda name, x: json.dumps({"tool_calls": [{"id": "a", "name": name, "arguments": {"x": x}}]})
    rows = [(1, 0, "system", told(f="integer")), (1, 1, "assistant", call("f", 1)), (1, 2, "assistant", call("f", "q")),
            (1, 3, "system", told(f="string")), (1, 3, "assistant", call("f", "q")), (1, 4, "assistant", call("f", 1)),
            (1, 5, "assistant", call("g", [])), (2, 0, "assistant", call("f", [])), (2, 1, "system", told(f="integer")),
            (None, 0, "system", told(f="integer")), (None, 1, "assistant", call("f", "q")), (1, 6, "user", told(f="null")),
            (3, 0, "system", json.dumps({"tools": [{"function": {"name": "f", "parameters": {"properties": 5}}}, {"name": "g"}, 7]})),
            (3, 1, "assistant", call("f", 1)), (3, 2, "assistant", call("g", 1)), (4, 0, "system", "{bad")]
    data = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {(r.conv_id, r.turn): r.n_invalid for r in chat_records.link(data).filter("n_calls > 0").collect()}
    assert got == {(1, 1): 0, (1, 2): 1, (1, 3): 0, (1, 4): 1, (1, 5): 0, (2, 0): 0, (None, 1): 0, (3, 1): 1, (3, 2): 0}
    own = spark.createDataFrame([("f", '{"properties":{"x":{"type":"array"}}}')], "name string, schema string")
    assert {(r.conv_id, r.turn) for r in chat_records.link(data, own).filter("n_invalid > 0").collect()} == \
        {(1, 1), (1, 2), (1, 3), (1, 4), (3, 1), (None, 1)}


@pytest.mark.parametrize("schema, good, bad", [
    ({"anyOf": [{"type": "string"}, {"minimum": 3, "type": "number"}]}, ["a", 3], [2, None]),
    ({"oneOf": [{"multipleOf": 2}, {"multipleOf": 3}]}, [2, 9], [6, 7]), ({"multipleOf": 0.1}, [0.3, 2], [0.35]),
    ({"allOf": [{"exclusiveMinimum": 1}, {"exclusiveMaximum": 2}]}, [1.5], [1, 2]), ({"not": {"type": "null"}}, [0], [None]),
    ({"pattern": "^a+$"}, ["aa", 1], ["ab"]), ({"enum": [1, {"a": [2.0]}]}, [1.0, {"a": [2]}], [True, {"a": [3]}]),
    ({"$ref": "#/$defs/t", "$defs": {"t": {"type": "array", "items": {"$ref": "#/$defs/t"}}}}, [[], [[], [[]]]], [[1], {}]),
    ({"$ref": "http://example.org/s"}, [], [1]), ({"$ref": "#"}, [], [1]), ({"type": "string", "minLength": "x"}, [], ["a"]),
    ({"uniqueItems": True, "prefixItems": [{"type": "string"}], "items": {"type": "integer"}}, [["a", 1], []], [[1], ["a", 1, 1.0], ["a", "b"]]),
    ({"contains": {"const": 1}, "maxContains": 2}, [[1, 2], [1, 1]], [[2], [1, 1, 1]]),
    ({"patternProperties": {"^n_": {"type": "integer"}}, "additionalProperties": False}, [{"n_a": 1}], [{"n_a": "q"}, {"b": 1}]),
    ({"propertyNames": {"maxLength": 2}, "minProperties": 1, "dependentRequired": {"a": ["b"]}}, [{"b": 1}, {"a": 1, "b": 1}], [{}, {"abc": 1}, {"a": 1}]),
    ({"if": {"properties": {"k": {"const": 1}}}, "then": {"required": ["x"]}, "else": {"maxProperties": 1}}, [{"k": 1, "x": 1}, {"k": 2}], [{"k": 1}, {"k": 2, "x": 1}])])
def test_schema_keywords(schema, good, bad):
    assert [v for v in good if not chat_records.fits(v, json.dumps(schema))] == []
    assert [v for v in bad if chat_records.fits(v, json.dumps(schema))] == []


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages_keep_columns(spark, tmp_path, empty):
    word = lambda: "".join(R.choice("abcdefghij") for _ in range(5))
    good = [(i, " ".join(word() for _ in range(30)) + ".", "en", "s", 1) for i in range(20)]
    rows = [] if empty else [*good, (30, good[2][1], "en", "s", 1), (31, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, good[4][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == columns
    out = {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()}
    assert out == (set() if empty else {i for i in range(20) if i != 4})
