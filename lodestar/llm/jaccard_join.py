"""Exact near-duplicate groups of documents by a Jaccard metric-space join.

Sets are the distinct 5-word shingles of the lower-cased words, as 64-bit hashes;
documents with equal sets are one point.  Two points link when their Jaccard
similarity is 0.75 or more, that is, within the radius 0.25 of the Jaccard metric.

1. Anchors.  Nearly all points are at distance 1 from each other, so that document
   pivots alone would put all into every region.  Shingles in a global order
   (those found often last, by hash otherwise) serve as anchors: from the triangle
   inequality on symmetric differences, two points within the radius share an
   anchor among the first n - ceil(0.75 n) + 1 of each.  A point's window of
   anchors is replicated, nothing else.
2. Regions.  An anchor's points, by size, are cut where sizes and places in the
   order rule out any link.  The pivot is the first of them; the points of a
   pivot's anchors are its Voronoi region, so that linked points meet in one.
   Regions inside another pivot's region are left out.  A region with more than a bounded number of set elements is dealt into blocks
   that meet two by two, each meeting bounded.
3. Recursive join.  In a region, the most central live point is the pivot; exact
   distances to it split the region into its ball (linked with it), the shell
   where the triangle inequality allows links to the ball, tested one by one
   within the window |d(x) - d(y)| <= 0.25, and the rest outside, which is joined
   again by itself until nothing is left.  One link from the shell to the ball
   suffices, as the ball is one component.

Only the order depends on which shingles count as frequent (a broadcast list of
bounded size); the result doesn't.  Components are found by joins.

Edge cases: null and empty texts have no shingle and are linked with nothing, not
even with each other.  Texts of fewer than 5 words have one, all their words.
Rows without an id get a null component and link nothing; rows of equal id and
different text are points of their own, joined by their id's component only where
they link.  An empty table gives no rows.  Other columns are not read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .._ship import ship_package
from ..plans.materialize import materialize
from .common import add_columns, slices
from .components import components
from .repeated_passages import release_shuffles
from .words import gram_hashes, split_words, word_hashes

SHINGLE = 5
FREQUENT = 32                  # documents from which a shingle may be ordered last
FREQUENT_MOST = 1 << 20        # length of the broadcast list, at most
COUNTED = 0.45                 # share of the hash range in which frequency is counted
BLOCK_ELEMENTS = 1 << 20       # set elements of a block
BLOCK_POINTS = 4096            # points of a block
RADIUS, EPS = 0.25, 1e-9


def shingle_sets(texts) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    return [np.unique(gram_hashes(h, min(SHINGLE, len(h)))) if len(h) else np.zeros(0, np.uint64)
            for h in word_hashes(split_words(texts, lower=True))]


def point_of(shingles: np.ndarray) -> int:
    """Identity of a set, a signed 64-bit hash."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def window_length(n: int) -> int:
    return n - (3 * n + 3) // 4 + 1


def _points(texts) -> list[pa.Array]:
    sets = shingle_sets(texts)
    return [pa.array([len(s) for s in sets], pa.int64()), pa.array([point_of(s) for s in sets], pa.int64())]


def _counted(batches):
    """(h, n): shingles in the counted part of the hash range, summed by slice."""
    top = np.uint64(int(COUNTED * 2.0**64))
    for b in batches:
        for start, n in slices(b.column(0)):
            sets = shingle_sets(b.column(0).slice(start, n))
            part = [s[:np.searchsorted(s, top)] for s in sets]
            h, counts = np.unique(np.concatenate(part), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(counts.astype(np.int64))], names=["h", "n"])


def ordered(shingles: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The set in the global order."""
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        late = frequent[at] == shingles
        if late.any():
            return np.concatenate([shingles[~late], shingles[late]])
    return shingles


def partner_limit(n: int) -> np.ndarray:
    """For each anchor of a set of ``n``, the largest set that can link by it as
    the first anchor in common: what stands before it is not shared."""
    rank = np.arange(window_length(n))
    return np.minimum(4 * n // 3, (7 * (n - rank)) // 3 - n)


def _anchored(bc):
    def run(batches):
        seen: set[int] = set()
        for b in batches:
            for start, n in slices(b.column(0)):
                out = [], [], [], []
                for s in shingle_sets(b.column(0).slice(start, n)):
                    point, size = point_of(s), len(s)
                    if size and point not in seen:
                        seen.add(point)
                        limit = partner_limit(size)
                        out[0].append(ordered(s, bc.value)[:len(limit)].view(np.int64))
                        out[1].append(np.full(len(limit), size, np.int64))
                        out[2].append(limit)
                        out[3].append(np.full(len(limit), point, np.int64))
                if len(seen) > 1_000_000:
                    seen.clear()
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out],
                                                     names=["anchor", "size", "most", "point"])
    return run


def _met(batches):
    """(region, point) of anchors with two points or more, from rows sorted by
    anchor, size and point.  An anchor's points are cut where no earlier one can
    link with a set as large as the next."""
    span = np.int64(1) << 40
    last_anchor, last_point, pivot, reach = None, None, 0, -1
    for b in batches:
        if not b.num_rows:
            continue
        anchor, size, most, point = (c.to_numpy() for c in b.columns)
        new, other = np.ones(len(anchor), bool), np.ones(len(anchor), bool)
        new[1:], other[1:] = anchor[1:] != anchor[:-1], point[1:] != point[:-1]
        if last_anchor is not None:
            new[0], other[0] = anchor[0] != last_anchor, point[0] != last_point
        run = np.cumsum(new)                    # 0 goes on from the last batch
        top = np.maximum.accumulate(np.concatenate([[-1 if new[0] else reach], run * span + most]))
        cut = new | (top[:-1] - run * span < size)
        pivots = np.concatenate([[pivot], point[cut]])[np.cumsum(cut)]
        last_anchor, last_point, pivot, reach = anchor[-1], point[-1], pivots[-1], top[-1] - run[-1] * span
        hit = ~cut & other & (point != pivots)
        pairs = np.stack([pivots[hit], point[hit]], 1)
        pairs = np.unique(np.concatenate([pairs, np.stack([pairs[:, 0]] * 2, 1)]), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["region", "point"])


def without_contained(members: DataFrame) -> DataFrame:
    """``members`` (region, point, ...) without the regions whose points all lie
    in the region of another pivot.  A pivot comes before the other points of its
    region, so that of two equal regions one stays."""
    own = members.select("region", "point")
    sizes = own.groupBy("region").agg(F.count(F.lit(1)).alias("n"))
    inside = own.filter("region <> point").select(F.col("region").alias("outer"), F.col("point").alias("region"))
    common = inside.join(own, "region").join(own.select(F.col("region").alias("outer"), "point"), ["outer", "point"], "left_semi")
    contained = common.groupBy("region", "outer").agg(F.count(F.lit(1)).alias("n")) \
        .join(sizes, ["region", "n"], "left_semi").select("region").distinct()
    return members.join(contained, "region", "left_anti")


def _sent(batches):
    """A point's set to each of its regions' meetings."""
    for b in batches:
        for start, n in slices(b.column(0)):
            part = b.slice(start, n)
            out = [[], [], [], [], []]
            for s, point, regions in zip(shingle_sets(part.column(0)), *(part.column(i).to_pylist() for i in (1, 2))):
                if point_of(s) != point:          # another row of the same id
                    continue
                raw = s.tobytes()
                for r in regions:
                    for o, v in zip(out, (r["region"], r["i"], r["j"], point, raw)):
                        o.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()),
                 pa.array(out[3], pa.int64()), pa.array(out[4], pa.binary())], names=["region", "i", "j", "point", "shingles"])


def region_links(docs: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that give the region's components: pivot, ball, shell, rest."""
    size = np.array([len(s) for s in sets])
    shared, flat = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(size)])[:-1]
    mark = np.zeros(len(shared), np.int32)
    often = np.bincount(flat)

    def overlap(p: int) -> np.ndarray:
        own = flat[begin[p]:begin[p] + size[p]]
        mark[own] = 1
        out = np.add.reduceat(mark[flat], begin)
        mark[own] = 0
        return out

    central = np.add.reduceat(often[flat], begin) / size
    live, links = np.argsort(-central, kind="stable"), []
    while len(live) > 1:
        p = live[0]
        inter = overlap(p)[live]
        union = size[p] + size[live] - inter
        near = 100 * inter >= 75 * union
        far = 1 - inter / union
        ball, ball_d, rest, rest_d = live[near][1:], far[near][1:], live[~near], far[~near]
        links += [(docs[p], docs[x]) for x in ball]
        if len(ball):
            for y, d in zip(rest, rest_d):
                if d > 2 * RADIUS + EPS:
                    continue
                some = ball[np.abs(ball_d - d) <= RADIUS + EPS]
                if len(some):
                    inter = overlap(y)[some]
                    hit = np.flatnonzero(100 * inter >= 75 * (size[y] + size[some] - inter))
                    if len(hit):
                        links.append((docs[y], docs[some[hit[0]]]))
        live = rest
    return links


def _joined(batches):
    """Links of each meeting, from rows sorted by meeting."""
    at, docs, sets = None, [], []

    def close():
        rows = region_links(docs, sets) if len(docs) > 1 else []
        cols = list(zip(*rows)) or [(), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["u", "v"])

    for b in batches:
        for r, i, j, doc, raw in zip(*(c.to_pylist() for c in b.columns)):
            if (r, i, j) != at:
                if len(docs) > 1:
                    yield close()
                at, docs, sets = (r, i, j), [], []
            if not docs or docs[-1] != doc:
                docs.append(doc)
                sets.append(np.frombuffer(raw, np.uint64))
    yield close()


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id) per row."""
    return _classes(docs, text_col, id_col).drop("tag")


def _tag(text: Column) -> Column:
    """Tells rows of equal id and different text apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _classes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, tag, n_shingles, component_id) per row."""
    spark = docs.sparkSession
    ship_package(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), _tag(F.col(f"`{text_col}`")).alias("tag"))
    points = materialize(add_columns(rows, "text", ["doc_id", "tag"], _points, "n_shingles long, point long"), "points")
    firsts = points.filter("doc_id is not null and n_shingles > 0").groupBy("point").agg(
        F.min(F.struct("doc_id", "n_shingles")).alias("first")).select("point", "first.*")

    texts = rows.filter("doc_id is not null").select("text")
    counts = texts.mapInArrow(_counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    found = counts.filter(F.col("n") > FREQUENT).orderBy(F.desc("n"), "h").limit(FREQUENT_MOST).select("h").toPandas()
    frequent = spark.sparkContext.broadcast(np.sort(found["h"].to_numpy(np.int64).view(np.uint64)))
    del counts
    release_shuffles(spark)

    met = (texts.mapInArrow(_anchored(frequent), "anchor long, size long, most long, point long")
           .repartition(partitions, "anchor").sortWithinPartitions("anchor", "size", "point").mapInArrow(_met, "region long, point long").distinct())
    members = materialize(without_contained(materialize(met.join(firsts, "point"), "met")), "members")
    del met
    release_shuffles(spark)

    blocks = members.groupBy("region").agg(
        F.greatest(F.ceil(F.sum("n_shingles") / BLOCK_ELEMENTS), F.ceil(F.count(F.lit(1)) / BLOCK_POINTS)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("point"), F.col("blocks")).cast("int")
    meetings = (members.join(blocks, "region").withColumn("b", own)
                .select("doc_id", "point", "region", "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
                .groupBy("doc_id", "point").agg(F.collect_list(F.struct(
                    "region", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))).alias("regions")))
    sent = rows.join(meetings, "doc_id").select("text", "point", "regions") \
        .mapInArrow(_sent, "region long, i int, j int, point long, shingles binary")
    links = sent.repartition(partitions, "region", "i", "j").sortWithinPartitions("region", "i", "j", "point") \
        .mapInArrow(_joined, "u long, v long")
    found_components = components(links)
    release_shuffles(spark)

    nodes = materialize(firsts.join(found_components, F.col("point") == F.col("node"), "left")
                        .select("point", "doc_id", F.coalesce("component", "point").alias("component")), "nodes")
    least = nodes.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    joined = nodes.join(least, "component").select("point", "component_id")
    return points.join(joined, "point", "left").select(
        "doc_id", "tag", "n_shingles",
        F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id"))
        .otherwise(F.col("doc_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that belong to another document's group (rows without
    an id stay, as do repeated rows of the group's first document).  Rows of equal id
    are judged by their texts."""
    away = _classes(docs).filter("component_id < doc_id").select(F.col("doc_id").alias("away_id"), F.col("tag").alias("away_tag")).distinct()
    return docs.join(away, (docs["doc_id"] == away["away_id"]) & (_tag(docs["text"]) == away["away_tag"]), "left_anti")
