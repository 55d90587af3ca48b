"""Phrase collocations, mined by SON partitioning.

1. Mining.  The scan's partitions are dealt over ``SHARDS`` shards.  A phrase that occurs
   ``least`` times in all occurs ``ceil(least / SHARDS)`` times in one shard at least, so
   that each shard is mined completely at that lower support.  Phrases travel as 64-bit
   hashes, counted in each task before they are shuffled; a clash of hashes can only add a
   candidate.
2. Union.  The phrases frequent in some shard go into a Bloom filter of bounded size
   (``FILTER_BITS`` at most).  Beyond that size it lets more phrases through, never fewer.
3. Counting.  A second scan counts, as words and not as hashes, every phrase that the
   filter lets through, and all single words.  What has ``least`` occurrences is exact.

A shard is a share of the input and not what one task holds: its counts travel by ranges of
hashes, in blocks, and a task counts one range at a time.  So shards stay few (and the lower
support useful) however large the input.  Hot phrases are counted where they are read and
never gathered; the ranges shrink as ``spark.sql.shuffle.partitions`` grows.

Scores: cutting a phrase after its first k words gives floor(10^6 a a / (l r)), computed in
decimals; the lowest cut counts.  A phrase goes if a longer frequent phrase holds it and has
``share`` percent of its occurrences.

Edge cases: null and empty texts have no words; a null language is ``und``.  Repeated rows
count as often as they stand.  A text longer than a slice is cut between pieces, which
changes nothing.  An empty table gives no rows.  Only the named columns are read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .._ship import ship_package
from ..plans.materialize import materialize
from .repeated_passages import release_shuffles
from .words import LONG_WORD, LOW_BYTES, LOWER, MIX, ODD, gram_hashes, mixed

SHARDS = 3
SLICE = 2 << 20               # bytes of text that are cut into words together
HELD = 2 << 20                # hashes that a mining task counts together
BUCKETS = 8                   # ranges of hashes for each shuffle partition; one is counted at a time
FILTER_BITS = 28              # at most 2^28 bits, 32 MB
SALTS = 16                    # parts in which a language is ranked
CHUNK_BITS = 16               # bits of the filter that travel as one row
CHUNK = 1 << CHUNK_BITS >> 3  # their bytes
_BYTES = np.arange(256)
CUT = np.isin(_BYTES, list(b".,;:!?\n\x0b\x0c\r"))
BLANK = np.isin(_BYTES, list(b" \t"))


def joined_texts(batches):
    """(bytes, start of each text, language code of each text, languages) of runs of texts of
    columns ``text`` and ``lang``; a long text in several runs, cut where pieces end."""
    for b in batches:
        texts, langs = pc.fill_null(b.column(0), ""), pc.fill_null(b.column(1), "und").dictionary_encode()
        codes, names = langs.indices.to_numpy(zero_copy_only=False), langs.dictionary.to_pylist()
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        if not len(texts):
            continue
        offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        if offsets[0] == offsets[-1]:
            continue
        raw = LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]]
        offsets -= offsets[0]
        row, at = 0, 0
        while at < len(raw):
            end = min(at + SLICE, len(raw))
            stop = int(np.searchsorted(offsets, end, "right")) - 1     # texts before it end by then
            if offsets[stop] > at:
                end = int(offsets[stop])
            else:                                                      # inside a long text
                row = max(row, stop)
                last = int(offsets[row + 1])
                ends = np.flatnonzero(CUT[raw[end:min(last, end + SLICE)]])
                end = end + int(ends[0]) + 1 if len(ends) else last
                stop = row + 1 if end == last else row
            yield raw[at:end], np.maximum(offsets[row:max(stop, row + 1)] - at, 0), codes[row:max(stop, row + 1)], names
            row, at = stop, end


class Words:
    """The words of joined texts: place, length, hash with the language, piece, text."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray, codes: np.ndarray, langs: list[str]):
        cut = CUT[raw]
        outside = cut | BLANK[raw]
        edge = np.zeros(len(raw) + 1, np.int32)
        np.add.at(edge, starts, 1)
        before = np.r_[True, outside[:-1]] | (edge[:-1] > 0)
        self.at = np.flatnonzero(before & ~outside)
        after = np.r_[outside[1:], True] | (edge[1:] > 0)
        self.length = np.flatnonzero(after & ~outside) + 1 - self.at
        self.piece = np.cumsum(cut + edge[:-1], dtype=np.int64)[self.at]
        self.text = np.searchsorted(starts, self.at, "right") - 1
        self.lang = codes[self.text]
        self.langs = langs
        self.data = np.r_[raw, np.zeros(8, np.uint8)]
        salts = np.array([xxhash.xxh64_intdigest(x.encode(), 11) for x in langs] or [0], np.uint64)
        out = self.length.astype(np.uint64) * MIX + salts[self.lang]
        for todo, part in self._eights():
            out[todo] = mixed(out[todo] * ODD + part + MIX)
        self.long = np.flatnonzero(self.length > LONG_WORD).tolist()
        for i in self.long:
            out[i] ^= np.uint64(xxhash.xxh64_intdigest(self.word(i)))
        self.hashes = out

    def _eights(self, of: np.ndarray | None = None):
        """(words that go on, their next eight bytes), up to ``LONG_WORD`` bytes; the bytes
        are those of the words ``of`` in their place."""
        eight = np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,))
        at = self.at if of is None else self.at[of]
        todo, k = np.arange(len(at)), 0
        while len(todo) and k < LONG_WORD:
            yield todo, eight[at[todo] + k] & LOW_BYTES[np.minimum(self.length[todo] - k, 8)]
            k += 8
            todo = todo[self.length[todo] > k]

    def word(self, i: int) -> bytes:
        return self.data[self.at[i]:self.at[i] + self.length[i]].tobytes()

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """(id of each word, first place of each id); equal ids are equal words of one
        language, compared as bytes."""
        _, first, ids = np.unique(self.hashes, return_index=True, return_inverse=True)
        like = first[ids]
        same = (self.length == self.length[like]) & (self.lang == self.lang[like])
        if same.all():
            for (todo, mine), (_, other) in zip(self._eights(), self._eights(like)):
                same[todo] &= mine == other
            for i in self.long:
                same[i] = same[i] and self.word(i) == self.word(like[i])
        if not same.all():                                # a clash of hashes: compare the words themselves
            words = [(int(g), self.word(i)) for i, g in enumerate(self.lang)]
            known: dict = {}
            ids = np.array([known.setdefault(w, len(known)) for w in words])
            first = np.unique(ids, return_index=True)[1]
        return ids, first

    def phrases(self, n: int) -> np.ndarray:
        """First words of the runs of ``n`` words within a piece."""
        m = len(self.at) - n + 1
        return np.flatnonzero(self.piece[:m] == self.piece[n - 1:]) if m > 0 else np.zeros(0, np.int64)


def phrase_hashes(words: Words, n: int, places: np.ndarray) -> np.ndarray:
    return gram_hashes(words.hashes, n)[places] + np.uint64(n)


def packed(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Keys and their counts, of which most are 1."""
    more = np.flatnonzero(n > 1)
    return b"".join([np.array([len(keys), len(more)], "<i8").tobytes(), keys.tobytes(), more.astype("<u4").tobytes(), n[more].astype("<u4").tobytes()])


def unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    size, more = np.frombuffer(block, "<i8", 2).tolist()
    n = np.ones(size, np.int64)
    at = 16 + 8 * size
    n[np.frombuffer(block, "<u4", more, at)] = np.frombuffer(block, "<u4", more, at + 4 * more)
    return np.frombuffer(block, np.uint64, size, 16), n


def _mined(longest: int, buckets: int):
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)

    def rows(shard: int, held: list[np.ndarray]):
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
        some = [b for b in range(buckets) if cuts[b + 1] > cuts[b]]
        for at in range(0, len(some), 64):
            part = some[at:at + 64]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int64()), pa.array([shard] * len(part), pa.int32()),
                 pa.array([packed(keys[cuts[b]:cuts[b + 1]], n[cuts[b]:cuts[b + 1]]) for b in part], pa.binary())],
                names=["bucket", "shard", "block"])

    def run(batches):
        shard, held, size = TaskContext.get().partitionId() % SHARDS, [], 0
        for texts in joined_texts(batches):
            words = Words(*texts)
            for n in range(2, longest + 1):
                held.append(phrase_hashes(words, n, words.phrases(n)))
                size += len(held[-1])
            if size >= HELD:
                yield from rows(shard, held)
                held, size = [], 0
        if size:
            yield from rows(shard, held)
    return run


def _frequent(support: int):
    """Blocks sorted by bucket to the keys with that support in some shard."""
    def keys_of(shards: dict):
        out = []
        for blocks in shards.values():
            keys, n = (np.concatenate(x) for x in zip(*blocks))
            order = np.argsort(keys)
            keys = keys[order]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            out.append(keys[first[np.add.reduceat(n[order], first) >= support]])
        return pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(out)).view(np.int64))], names=["key"])

    def run(batches):
        bucket, shards = None, {}
        for batch in batches:
            for b, shard, block in zip(*[c.to_pylist() for c in batch.columns]):
                if b != bucket and shards:
                    yield keys_of(shards)
                    shards = {}
                bucket = b
                shards.setdefault(shard, []).append(unpacked(block))
        if shards:
            yield keys_of(shards)
    return run


def locally_frequent(texts: DataFrame, least: int, longest: int) -> DataFrame:
    """``key``: hashes of the phrases frequent in some shard."""
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mined = texts.mapInArrow(_mined(longest, BUCKETS * partitions), "bucket long, shard int, block binary")
    return (mined.repartition(partitions, "bucket").sortWithinPartitions("bucket")
            .mapInArrow(_frequent(-(-least // SHARDS)), "key long"))


class Filter:
    """A Bloom filter of 64-bit hashes: two bits for each, from its high and its low end."""

    def __init__(self, bits: int, data: np.ndarray | None = None):
        self.bits = bits
        self.data = np.zeros(1 << bits >> 3, np.uint8) if data is None else data

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return ((keys >> np.uint64(64 - self.bits)).astype(np.int64),
                (keys & np.uint64((1 << self.bits) - 1)).astype(np.int64))

    def has(self, keys: np.ndarray) -> np.ndarray:
        a, b = self.places(keys)
        out = (self.data[a >> 3] >> (a & 7).astype(np.uint8)) & 1
        return (out & (self.data[b >> 3] >> (b & 7).astype(np.uint8))).astype(bool)


def build_filter(keys: DataFrame) -> Filter:
    """The filter of all keys, 16 bits for each up to ``FILTER_BITS``.  Its chunks are
    filled by Spark; the driver takes the finished chunks, 32 MB at most in all."""
    bits = min(FILTER_BITS, max(CHUNK_BITS, (16 * keys.count()).bit_length()))

    def places(batches):
        shape = Filter(bits, np.zeros(0, np.uint8))
        for b in batches:
            place = np.unique(np.concatenate(shape.places(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))))
            yield pa.RecordBatch.from_arrays([pa.array(place >> CHUNK_BITS), pa.array(place)], names=["chunk", "place"])

    def fill(batches):
        part, seen = Filter(bits), set()
        for b in batches:
            seen.update(np.unique(b.column(0).to_numpy()).tolist())
            place = b.column(1).to_numpy()
            np.bitwise_or.at(part.data, place >> 3, (1 << (place & 7)).astype(np.uint8))
        for c in seen:
            yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([part.data[c * CHUNK:(c + 1) * CHUNK].tobytes()])],
                                             names=["chunk", "data"])

    filled = keys.mapInArrow(places, "chunk long, place long").repartition("chunk").mapInArrow(fill, "chunk long, data binary")
    out = Filter(bits)
    for r in filled.collect():
        out.data[r.chunk * CHUNK:(r.chunk + 1) * CHUNK] = np.frombuffer(r.data, np.uint8)
    return out


def _counted(longest: int, sent):
    def run(batches):
        candidates = Filter(*sent.value)
        for texts in joined_texts(batches):
            words = Words(*texts)
            if not len(words.at):
                continue
            ids, first = words.ids()
            shown = [words.word(i) for i in first.tolist()]
            out = [(1, np.bincount(words.lang, minlength=len(words.langs)), None, np.arange(len(words.langs)))]
            out.append((1, np.bincount(ids, minlength=len(first)), shown, words.lang[first]))
            for n in range(2, longest + 1):
                places = words.phrases(n)
                places = places[candidates.has(phrase_hashes(words, n, places))]
                code = ids[places]
                for k in range(1, n):                     # code: the first k + 1 words, densely numbered
                    code = np.unique(code, return_inverse=True)[1] * len(first) + ids[places + k]
                _, at, count = np.unique(code, return_index=True, return_counts=True)
                at = places[at]
                parts = [ids[at + k].tolist() for k in range(n)]
                out.append((n, count, [b" ".join([shown[i] for i in p]) for p in zip(*parts)], words.lang[at]))
            for n, count, phrase, lang in out:
                some = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([words.langs[i] for i in lang[some].tolist()], pa.string()),
                     pa.array(np.full(len(some), 0 if phrase is None else n, np.int32)),
                     pa.array([""] * len(some) if phrase is None else [phrase[i] for i in some.tolist()], pa.binary()).cast(pa.string()),
                     pa.array(count[some].astype(np.int64))], names=["lang", "words", "phrase", "n"])
    return run


def counted_phrases(texts: DataFrame, candidates: Filter, least: int, longest: int) -> DataFrame:
    """(lang, words, phrase, n): the words and phrases that occur ``least`` times, and with
    ``words`` = 0 all words of the language."""
    sent = texts.sparkSession.sparkContext.broadcast((candidates.bits, candidates.data))
    rows = texts.mapInArrow(_counted(longest, sent), "lang string, words int, phrase string, n long")
    return rows.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).filter((F.col("words") == 0) | (F.col("n") >= least))


def _run(words: Column, start, length) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, words, phrase, a, l, r, score) of the phrases, by their lowest cut."""
    parts = counts.filter("words > 0").select("lang", "phrase", "n")
    word = F.split("phrase", " ")
    cuts = (counts.filter("words > 1").withColumnRenamed("n", "a")
            .withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
            .withColumn("head", _run(word, 1, F.col("cut")))
            .withColumn("tail", _run(word, F.col("cut") + 1, F.col("words"))))
    heads = parts.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    tails = parts.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r"))
    both = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    score = F.expr("(1000000 * cast(a as decimal(15,0)) * cast(a as decimal(15,0)))"
                   " div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))").cast("long")
    lowest = F.min(F.struct(score.alias("score"), "cut", "l", "r"))
    return (both.groupBy("lang", "words", "phrase", "a").agg(lowest.alias("lowest"))
            .select("lang", "words", "phrase", "a", "lowest.l", "lowest.r", "lowest.score"))


def without_contained(found: DataFrame, share: int) -> DataFrame:
    """``found`` without the phrases inside a longer one that has ``share`` percent of their
    occurrences."""
    word = F.split("phrase", " ")
    places = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: _run(word, i, n))))
    inside = (found.filter("words > 2").select("lang", F.explode(F.array_distinct(places)).alias("phrase"), "a")
              .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    return (found.join(inside, ["lang", "phrase"], "left")
            .filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).drop("longer"))


def mine(docs: DataFrame, least: int = 10, longest: int = 3, share: int = 50, top: int = 2000,
         text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    spark: SparkSession = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    keys = materialize(locally_frequent(texts, least, longest), "phrase-keys")
    release_shuffles(spark)
    counts = materialize(counted_phrases(texts, build_filter(keys), least, longest), "phrase-counts")
    release_shuffles(spark)
    all_words = counts.filter("words = 0").select("lang", "n")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = without_contained(scored(counts), share).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = (salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
            .filter(F.col("rank") <= top).drop("rank"))                # a language is ranked in SALTS parts first
    first = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return (first.join(all_words, "lang")
            .select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score"))


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
split AS (SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
words AS (SELECT lang, id, unnest(w) AS w, generate_subscripts(w, 1) AS place FROM split),
ahead AS (
  SELECT lang, w, lead(w) OVER p AS x, lead(w, 2) OVER p AS y FROM words WINDOW p AS (PARTITION BY id ORDER BY place)),
f AS (
  SELECT lang, 1 AS k, w AS phrase, count(*) AS n FROM ahead GROUP BY ALL
  UNION ALL SELECT lang, 2, w || ' ' || x, count(*) FROM ahead WHERE x IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, w || ' ' || x || ' ' || y, count(*) FROM ahead WHERE y IS NOT NULL GROUP BY ALL),
total AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
found AS (SELECT lang, k AS size, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 10),
cuts AS (
  SELECT c.lang, c.size, c.phrase, c.a, x.cut, l.n AS l, r.n AS r,
         ((1000000::HUGEINT * c.a * c.a) // (l.n::HUGEINT * r.n))::BIGINT AS score
  FROM found c
  JOIN (VALUES (1), (2)) AS x(cut) ON x.cut < c.size
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:x.cut], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[x.cut + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM found WHERE size = 3
    UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM found WHERE size = 3) GROUP BY lang, phrase),
kept AS (
  SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase AND b.size = 2
  WHERE i.longer IS NULL OR 100 * i.longer < 50 * b.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY k.score DESC, k.a DESC, k.phrase) AS rank,
       k.phrase, k.a, k.l, k.r, t.n, k.score
FROM kept k JOIN total t ON t.lang = k.lang
QUALIFY rank <= 2000
"""
