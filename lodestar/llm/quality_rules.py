"""Line-first cleaning, in Spark's own functions only.

Every line is judged by itself; lines that fail are removed; a document that
loses more than half of its characters (blanks not counted) is rejected.  The
rules of a line, its length taken in gaps (blanks):

* punctuation: symbols make up over a tenth of its characters; or, in a line of
  three gaps or more, punctuation and symbols make up over a fifth; or it has
  fewer than four gaps and doesn't end with a closing mark;
* navigation: three or more menu separators, more than one for every five gaps;
  or a short line with a menu phrase;
* boilerplate: a line of under 25 gaps with a rights, cookie or privacy phrase.

Lines without a word stay.

Edge cases: a null or empty text has no words and is rejected by the base rule
(``n_words < 10``) with ``clean_text`` empty.  Rows are judged one by one, so
ties, repeated rows and null ids change nothing.  Extra columns are not read;
``judge`` overwrites none, it returns its own columns only.
"""
from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, word_array

# Fixed values of the rules.
SYMBOLS = "#*$%&|<>"
RULE_SYMBOLS = "#*$%&|<>{}\\^~="
MARKS = RULE_SYMBOLS + "!?.,;:'\"()-"
CLOSING = "[.!?:;…。！？؟۔।][\"'”’»)\\]]*[\\x20\\x09-\\x0D]*$"
A_WORD = "[^\\x20\\x09-\\x0D]"
SEPARATORS = "|»›•·"
MENU = ("skip to content", "sign in", "sign up", "log in", "read more", "click here", "share this", "follow us",
        "back to top", "next page", "previous page", "table of contents", "site map")
BOILERPLATE = ("all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy",
               "uses cookies", "accept cookies", "enable javascript", "lorem ipsum", "powered by",
               "subscribe to our", "copyright ©")
MIN_WORDS = 10            # base rule
REPEAT_SHARE = 20         # base rule, percent of words in repeated windows
LOSS_SHARE = 50           # percent of characters that a document may lose
WINDOW = 5


def _count(text: Column, chars: str) -> Column:
    """Code points of ``text`` that are in ``chars``."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{re.escape(chars)}]", ""))


def _has_any(text: Column, phrases) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in phrases])


def _window_hashes(words: Column) -> Column:
    return F.when(F.size(words) >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW),
        lambda i: F.xxhash64(*[words[i + k] for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))


def _covered(h: Column) -> Column:
    """Words inside windows whose hash occurs twice or more, the first included."""
    def starts(s):
        twice = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
        return F.array_sort(F.transform(twice, lambda x: x["i"].cast("long")))

    ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    first = F.struct(F.lit(-WINDOW).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda a, p: F.struct(
        p.alias("last"), (a["n"] + F.least(F.lit(WINDOW).cast("long"), p - a["last"])).alias("n"))
    return F.aggregate(let(ranked, starts), first, step, lambda a: a["n"])


def _line(line: Column) -> Column:
    """A line with its gaps, solid characters, and whether it has a word and fails."""
    solid = F.length(F.replace(line, F.lit(" "), F.lit("")))
    measured = F.struct((F.length(line) - solid).alias("gaps"), solid.alias("c"))

    def judged(m):
        gaps, c = m["gaps"], m["c"]
        marks = _count(line, MARKS)
        symbols = (marks * 10 > c) & (_count(line, RULE_SYMBOLS) * 10 > c)
        dense = (gaps >= 3) & (marks * 5 > c)
        cut = (gaps < 4) & ~line.rlike(CLOSING)
        bars = line.rlike(f"[{SEPARATORS}]") & let(
            _count(line, SEPARATORS), lambda n: (n >= 3) & (n * 5 > gaps))
        menu = (gaps < 8) & _has_any(F.lower(line), MENU)
        boiler = (gaps < 25) & _has_any(F.lower(line), BOILERPLATE)
        word = line.rlike(A_WORD)
        return F.struct(line.alias("line"), c.alias("c"), word.alias("word"),
                        (word & (dense | symbols | cut | bars | menu | boiler)).alias("bad"))

    return let(measured, judged)


def judge(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default ``doc_id``), the base figures, ``kept`` and ``clean_text``."""
    keep = ["doc_id"] if keep is None else keep
    # Each step's columns are read twice or more by the next one, so that
    # Catalyst computes them once instead of inlining them.
    text = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("keep"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    words = text.withColumn("words", word_array(F.col("text")))
    hashed = words.select(
        "keep", "text", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _window_hashes(F.col("words")).alias("h"),
        F.transform(F.split("text", "\n"), _line).alias("lines"))
    worded = F.filter("lines", lambda x: x["word"])
    # ``drawn`` is always true; not being deterministic, it keeps a filter on ``kept`` from
    # being pushed below this step and the arrays from being inlined into it.
    counted = hashed.select(
        (F.monotonically_increasing_id() >= 0).alias("drawn"), "keep", "n_words", "word_chars", _count(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        let(F.transform(worded, lambda x: x["line"]),
            lambda y: F.size(y) - F.size(F.array_distinct(y))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("h")) == F.size("h"), F.lit(0).cast("long"))
        .otherwise(let(F.col("h"), _covered)).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("lines", lambda x: x["bad"])).cast("long").alias("n_bad_lines"),
        F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["c"]).alias("solid_chars"),
        F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + F.when(x["bad"], x["c"]).otherwise(0)).alias("lost_chars"),
        F.array_join(F.transform(F.filter("lines", lambda x: ~x["bad"]), lambda x: x["line"]), "\n").alias("clean_text"))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_SHARE)
    return (counted.withColumn("base_failed", failed)
            .withColumn("kept", F.col("drawn") & ~failed & (F.col("lost_chars") * 100 <= F.col("solid_chars") * LOSS_SHARE))
            .select("keep.*", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    "kept", "n_lines", "n_bad_lines", "lost_chars", "clean_text"))


def clean(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their failing lines removed and
    ``n_chars`` counted anew; the columns of ``docs``."""
    out = judge(docs.select(F.struct("*").alias("row"), "text"), keep=["row"]).filter("kept")
    return out.select(*[
        F.col("clean_text").alias("text") if c == "text"
        else F.length("clean_text").cast("long").alias(c) if c == "n_chars"
        else F.col("row")[c].alias(c) for c in docs.columns])


ORACLE = r"""
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
             string_split(text, chr(10)) as lines from t),
win as (select doc_id, i, array_to_string(words[i:i + 4], ' ') as g
        from (select doc_id, words, unnest(range(1, greatest(len(words) - 3, 1)::bigint)) as i from w)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from win) where n > 1),
rep as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 5)) as p from twice) group by doc_id),
l as (select doc_id, line, lower(line) as low, length(line) - length(replace(line, ' ', '')) as gaps, length(replace(line, ' ', '')) as c,
             regexp_matches(line, '[^\x20\x09-\x0D]') as word,
             length(line) - length(regexp_replace(line, '[#*$%&|<>{}\\^~=!?.,;:''"()-]', '', 'g')) as marks,
             length(line) - length(regexp_replace(line, '[#*$%&|<>{}\\^~=]', '', 'g')) as symbols,
             length(line) - length(regexp_replace(line, '[|»›•·]', '', 'g')) as bars
      from (select doc_id, unnest(lines) as line from w)),
j as (select doc_id, line, c, word, word and (
        (marks * 10 > c and symbols * 10 > c) or (gaps >= 3 and marks * 5 > c)
        or (gaps < 4 and not regexp_matches(line, '[.!?:;…。！？؟۔।]["''”’»)\]]*[\x20\x09-\x0D]*$'))
        or (bars >= 3 and bars * 5 > gaps)
        or (gaps < 8 and regexp_matches(low, '@MENU@'))
        or (gaps < 25 and regexp_matches(low, '@BOILER@'))) as bad from l),
by_line as (select doc_id, (count(*) filter (word)) - (count(distinct line) filter (word)) as n_dup_lines, count(*) as n_lines,
                   count(*) filter (bad) as n_bad_lines, coalesce(sum(c) filter (bad), 0)::bigint as lost_chars, sum(c)::bigint as solid_chars from j group by doc_id),
f as (select w.doc_id, len(words)::bigint as n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
             by_line.n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words, by_line.n_lines, by_line.n_bad_lines, by_line.lost_chars, by_line.solid_chars
      from w left join rep on rep.doc_id = w.doc_id left join by_line on by_line.doc_id = w.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
       not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and 100 * lost_chars <= 50 * solid_chars as kept,
       n_lines, n_bad_lines, lost_chars from f
""".replace("@MENU@", "|".join(MENU)).replace("@BOILER@", "|".join(BOILERPLATE))
