"""N-gram Jaccard join by T-occurrence search (DivideSkip).

Documents with equal shingle sets are one set. Every set lists its shingles in hash order; two sets with similarity ``SIMILAR`` have
K of their common shingles within the first (size - needed + K) of both, for any K. Each set puts its first
(size - needed + 1 + ``SPARE``) shingles in an inverted index. Lists of up to ``LONG`` sets are short. A set merges its short lists
with a heap and counts how often each partner occurs; the count, its long lists and what follows the last common place must reach
the required overlap. Survivors are binary-probed: every shingle of one is looked up in the other's sorted
shingles, long lists included, and the overlap is exact.

Most near copies never meet as candidates: each list votes for its least set as a hub, each set is probed against the hub of most of its lists, and sets
connected by that are not paired again. Hubs only save work; what they miss is found by the lists.

Sets with more long lists than ``SPARE`` are indexed whole, in a second index of their own, where their rarer shingles tell. Those
that have too many long lists even there (large groups of near copies) meet through the long lists: each is first compared with the
set of the list that has the largest share of long lists, and only sets that are not yet connected are paired after that, by the shortest of their
long lists: what is similar without a short list in common has its whole overlap in long ones, so few of them are read. The same holds for all pairs: those
already connected by verified links need no proof, so copies are never expanded into all pairs. All pairs with the
similarity are either linked or connected, so components are exact.

Shingles are 64-bit hashes of word sequences. Cases: a null or empty text has an empty set and links with nothing; under ``SHINGLE``
words the whole sequence is the one shingle; repeated rows and null or repeated ids get results row by row (a component is named
by its smallest id that isn't null; a row alone by its own); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import KEY, connected, discard, freed, row_key, stage
from shelfmark.llm.tokens import ODD, Reader, mixed, signed

SHINGLE, SIMILAR, LONG, SPARE = 5, 75, 256, 16


def needed(n, per_cent: int = SIMILAR):
    """Least overlap of a set of n shingles with any similar set."""
    return -(-per_cent * n // 100)


def overlap(n, m, per_cent: int = SIMILAR):
    """Least overlap of similar sets of n and m shingles."""
    return -(-per_cent * (n + m) // (100 + per_cent))


def indexed(n, whole: bool = False):
    """How many of a set's n shingles are in the index."""
    return n if whole else np.minimum(n, n - needed(n) + 1 + SPARE)


def shingle_sets(reader: Reader, column, k: int = SHINGLE):
    """(first row, sorted different shingles, row of each, bounds by row) for runs of rows."""
    for at, to, w in reader.slices(column):
        h = reader.hashes(w)
        prefix = reader.words_.prefix(h)
        g = reader.windows(h, k, prefix)
        i = np.flatnonzero(w.row[:len(g)] == w.row[k - 1:]) if len(g) else np.zeros(0, np.int64)
        n = np.diff(w.first)
        short = np.flatnonzero((n > 0) & (n < k))
        whole = mixed(reader.words_.spans(prefix, w.first[short], w.first[short + 1]) + n[short].astype(np.uint64) * np.uint64(ODD))
        # a row has either windows or one whole sequence, so rows stay in order; each is sorted by itself
        own = np.zeros(len(n), np.int64)
        own[short] = 1
        own += np.bincount(w.row[i], minlength=len(n))
        row, ends = np.repeat(np.arange(len(n)), own), np.concatenate([[0], np.cumsum(own)])
        x = np.empty(len(row), np.uint64)
        lone = np.zeros(len(n), bool)
        lone[short] = True
        x[lone[row]], x[~lone[row]] = whole, g[i]
        g = x
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            g[a:b].sort()
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
        g, row = g[new], row[new]
        yield at, g, row, np.searchsorted(row, np.arange(to - at + 1))


def set_ids(g, bounds):
    """A 64-bit id of each set, from its shingles in any order; with the size it names the set."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(g * np.uint64(ODD)))])
    return mixed(total[bounds[1:]] - total[bounds[:-1]])


def _sizes(batches):
    reader = Reader("space", lower=True)
    for batch in batches:
        for at, g, _, bounds in shingle_sets(reader, batch.column("text")):
            n = np.diff(bounds)
            own = {c: batch.column(c).slice(at, len(n)) for c in ("doc_id", *KEY)}
            yield pa.record_batch(own | {"n": pa.array(n.astype(np.int32)), "s": signed(set_ids(g, bounds))})


def _postings(batches):
    reader = Reader("space", lower=True)
    for batch in batches:
        for _, g, row, bounds in shingle_sets(reader, batch.column("text")):
            n = np.diff(bounds)
            rank = np.arange(len(g)) - bounds[row]
            i = np.flatnonzero(rank < indexed(n)[row])
            yield pa.record_batch({"token": signed(g[i]), "s": signed(set_ids(g, bounds)[row[i]]), "at": pa.array(n[row[i]].astype(np.int64) << 32 | rank[i])})


def _all_postings(batches):
    for batch in batches:
        sets = [np.frombuffer(g.as_buffer(), np.uint64) for g in batch.column("grams")]
        n = np.array([len(g) for g in sets], np.int64)
        rank = np.concatenate([np.arange(x) for x in n]) if len(n) else np.zeros(0, np.int64)
        yield pa.record_batch({"token": signed(np.concatenate(sets)) if sets else pa.array([], pa.int64()), "s": pa.array(np.repeat(batch.column("s").to_numpy(), n)),
                               "at": pa.array(np.repeat(n, n) << 32 | rank)})


def _members(batches):
    reader = Reader("space", lower=True)
    for batch in batches:
        s = batch.column("s")
        for at, g, _, bounds in shingle_sets(reader, batch.column("text")):
            yield pa.record_batch({"s": s.slice(at, len(bounds) - 1), "grams": pa.array([g[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())})


def _merged(batches, whole: bool = False):
    """Partners of each set that its short lists leave, by a heap over the sorted lists, and the common long lists they still need."""
    for batch in batches:
        left, right, lack = [], [], []
        for k in range(len(batch)):
            own, n, most, group, ranks, others, places, groups = (batch.column(c)[k].as_py() for c in ("s", "n", "long", "g", "ranks", "others", "places", "groups"))
            # partners connected already have nothing to prove
            lists = [[(x, y, r) for x, y, g in zip(xs, ys, gs) if g != group] for r, xs, ys, gs in zip(ranks, others, places, groups)]
            for other, met in groupby(heapq.merge(*lists), key=lambda x: x[0]):
                met = list(met)
                m = met[0][1] >> 32
                here, there = max(x[2] for x in met), max(x[1] & 0xFFFFFFFF for x in met)
                # what follows the last common place, or the end of the index of the set that ends first
                rest = min(n - 1 - here, m - 1 - there, max(n - indexed(n, whole), m - indexed(m, whole)))
                need = overlap(n, m) - len(met) - rest
                if need <= most:
                    left.append(own)
                    right.append(other)
                    lack.append(need)
        yield pa.record_batch({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64()), "lack": pa.array(lack, pa.int32())})


def _probed(batches):
    for batch in batches:
        ok = []
        for x, y in zip(batch.column("ga"), batch.column("gb")):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            if len(x) > len(y):
                x, y = y, x
            both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            ok.append(100 * both >= SIMILAR * (len(x) + len(y) - both))
        yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b")}).filter(pa.array(ok, pa.bool_()))


def verified(pairs: DataFrame, members: DataFrame) -> DataFrame:
    full = pairs.join(members.select(F.col("s").alias("b"), F.col("grams").alias("gb")), "b").join(members.select(F.col("s").alias("a"), F.col("grams").alias("ga")), "a")
    return stage(full.mapInArrow(_probed, "a long, b long"), "linked")


def _groups(links: list[DataFrame]) -> DataFrame:
    every = links[0]
    for x in links[1:]:
        every = every.unionAll(x)
    return stage(connected(every), "groups")


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs whose ends are not connected yet."""
    side = lambda c: groups.select(F.col("node").alias(c), F.col("component").alias(f"g{c}"))
    p = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return p.where(F.coalesce("ga", "a") != F.coalesce("gb", "b")).select("a", "b")


def unpacked() -> tuple[Column, Column, Column]:
    """Of a posting: size of its set, rank in it, least overlap the set needs."""
    size = F.expr("cast(at >> 32 as int)")
    return size, F.expr("cast(at & 4294967295 as int)"), F.ceil(size * SIMILAR / 100).cast("int")


def shared_lists(posted: DataFrame) -> DataFrame:
    """Postings of shingles in several sets, with the length of their list and its least set, the hub."""
    # dealt out by token once, for the counts and for the join with them
    posted = posted.repartition("token")
    often = posted.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min("s").alias("hub"), F.max("s").alias("y")).where("hub <> y").select("token", "c", "hub")
    out = stage(posted.join(often.hint("shuffle_hash"), "token"), "shared")
    freed(posted.sparkSession)
    return out


def hubs(shared: DataFrame) -> DataFrame:
    """(a, b): each set b with the hub a of most of its lists, where these are half of its index or more."""
    size, _, least = unpacked()
    votes = shared.where("s <> hub").groupBy("s", "hub").agg(F.count_distinct("token").alias("v"), F.min(size - least + 1 + SPARE).alias("places"))
    best = votes.groupBy("s").agg(F.max(F.struct("v", "hub")).alias("v"), F.min("places").alias("places"))
    return best.where("2 * v.v >= places").select(F.col("v.hub").alias("a"), F.col("s").alias("b"))


def long_lists(shared: DataFrame, whole: bool) -> tuple[DataFrame, DataFrame]:
    """Postings of the long lists; of each set in any, their shingles, their share of the set, and whether they are more than its places in the index allow."""
    size, _, least = unpacked()
    long = stage(shared.where(F.col("c") > LONG).select("token", "s", "at", "c").distinct(), "long")
    allowed = least - 1 if whole else F.least(F.lit(SPARE), least - 1)
    mine = long.groupBy("s").agg(F.collect_set("token").alias("tokens"), (F.count(F.lit(1)) > F.min(allowed)).alias("over"), (F.count(F.lit(1)) / F.min(size)).alias("share"), F.count(F.lit(1)).cast("int").alias("many"))
    return long, stage(mine, "mine")


def first_long_places(long: DataFrame, mine: DataFrame) -> DataFrame:
    """(token, s, share, n, many, rank): of sets that may be similar by long lists alone, the first of their ``many`` long lists, shortest first.

    Sets with a short list in common are candidates already, so all of a needed overlap is in long lists, and one of it in the first (many - needed + 1) of both."""
    size, _, least = unpacked()
    own = long.join(mine.where("over").select("s", "share", "many"), "s").withColumn("rank", F.row_number().over(Window.partitionBy("s").orderBy("c", "token")) - 1)
    return own.where(F.col("rank") < F.col("many") - least + 1).select("token", "s", "share", size.alias("n"), "many", "rank")


def candidates(shared: DataFrame, mine: DataFrame, groups: DataFrame, whole: bool) -> DataFrame:
    """Pairs of sets of different ``groups`` that the index can't rule out."""
    known = groups.select(F.col("node").alias("s"), "component")
    short = shared.where(F.col("c") <= LONG).join(known, "s", "left").withColumn("g", F.coalesce("component", "s"))
    lists = short.groupBy("token").agg(F.array_sort(F.collect_set(F.struct("s", "at", "g"))).alias("list"), F.min("g").alias("x"), F.max("g").alias("y")).where("x <> y")
    each = lists.select(F.posexplode("list").alias("k", "e"), "list").where("k < size(list) - 1")
    each = each.select("e.s", "e.g", F.expr("cast(e.at >> 32 as int)").alias("n"), F.expr("cast(e.at & 4294967295 as int)").alias("rank"), F.expr("slice(list, k + 2, size(list))").alias("others"))
    query = each.groupBy("s", "n").agg(F.min("g").alias("g"), F.collect_list(F.struct("rank", F.col("others.s").alias("s"), F.col("others.at").alias("at"), F.col("others.g").alias("g"))).alias("l"))
    query = query.join(mine.select("s", F.size("tokens").alias("long")), "s", "left")
    query = query.select("s", "n", F.coalesce("long", F.lit(0)).alias("long"), "g", F.col("l.rank").alias("ranks"), F.col("l.s").alias("others"), F.col("l.at").alias("places"), F.col("l.g").alias("groups"))
    # written once: what lacks nothing and what has to look at its long lists read the same pairs
    met = stage(query.mapInArrow(lambda batches: _merged(batches, whole), "a long, b long, lack int"), "met")
    freed(shared.sparkSession)
    # the long lists of a pair are probed for those both are in
    side = lambda c: mine.select(F.col("s").alias(c), F.col("tokens").alias(f"t{c}"))
    return met.where("lack <= 0").select("a", "b").unionAll(
        met.where("lack > 0").join(side("a"), "a").join(side("b"), "b").where("size(array_intersect(ta, tb)) >= lack").select("a", "b"))


def similar_sets(keyed: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, component) of sets that link with others; a component is its smallest set id."""
    spark = keyed.sparkSession
    where = sets.where("n > 0").groupBy("s").agg(F.min(F.struct(*KEY)).alias("k"))

    def shingles(wanted: DataFrame) -> DataFrame:
        one = where.join(wanted.distinct(), "s", "left_semi").select("s", "k.*")
        out = stage(keyed.join(one.hint("merge"), KEY).select("s", "text").mapInArrow(_members, "s long, grams binary"), "members")
        freed(spark)
        return out

    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("s"))
    shared = shared_lists(keyed.select("text").mapInArrow(_postings, "token long, s long, at long"))
    first_long, mine = long_lists(shared, False)
    over = mine.where("over").select("s")
    starts = stage(hubs(shared), "hubs")
    members = shingles(ends(starts).unionAll(over))
    links = [verified(starts, members)]
    groups = _groups(links)
    pairs = stage(candidates(shared, mine, groups, False), "pairs")
    discard(shared, first_long)
    # sets with too many long lists are indexed whole, among themselves; near copies of one text have little else even then
    shared = shared_lists(members.join(over, "s", "left_semi").mapInArrow(_all_postings, "token long, s long, at long"))
    long, mine = long_lists(shared, True)
    more = stage(candidates(shared, mine, groups, True), "pairs")
    discard(shared)
    pairs = pairs.unionAll(more)
    full = stage(first_long_places(long, mine), "full")
    # sets of full lists are indexed whole, so they are members already
    members = members.unionAll(shingles(ends(pairs).join(members.select("s"), "s", "left_anti")))
    # first each set with the least of its partners, and of each long list; then what is not connected by that
    first = full.join(full.groupBy("token").agg(F.max_by("s", F.struct("share", "s")).alias("a")), "token").where("a <> s").select("a", F.col("s").alias("b")).distinct()
    least_partner = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links.append(verified(_apart(least_partner.unionAll(first), groups).distinct(), members))
    freed(spark)
    groups = _groups(links)
    own = full.join(groups.select(F.col("node").alias("s"), "component"), "s", "left").withColumn("g", F.coalesce("component", "s")).drop("component")
    several = own.groupBy("token").agg(F.min("g").alias("x"), F.max("g").alias("y")).where("x <> y").select("token")
    own = stage(own.join(several, "token", "left_semi"), "own")
    cross = own.alias("x").join(own.alias("y"), "token").where(
        f"x.g < y.g AND least(x.rank, y.rank) + least(x.many - x.rank, y.many - y.rank) >= ceil({SIMILAR} * (x.n + y.n) / {100 + SIMILAR})")
    rest = _apart(pairs, groups).unionAll(cross.select(F.col("x.s").alias("a"), F.col("y.s").alias("b")))
    rest = stage(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "rest")
    return _groups([*links, verified(rest, members)])


def near_groups(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(F.col("doc_id"), F.col("text")), "text")
    sets = stage(keyed.mapInArrow(_sizes, "doc_id long, key_id long, key_text long, n int, s long"), "sets")
    groups = similar_sets(keyed, sets)
    named = sets.where("n > 0").join(groups.select(F.col("node").alias("s"), "component"), "s", "left").withColumn("g", F.coalesce("component", "s"))
    least = named.groupBy("g").agg(F.min("doc_id").alias("component_id"))
    in_set = named.select("s", "g").distinct().join(least, "g").select("s", F.lit(True).alias("some"), "component_id")
    out = sets.withColumn("some", F.col("n") > 0).join(in_set, ["s", "some"], "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))



def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` of each group of near copies: that with the smallest id; rows with empty sets all stay.

    Rows are told apart by id and text; of repeated rows one stays, and of a group without ids that with the least text hash.
    """
    keyed = docs.select(F.struct(*(F.col(f"`{x}`") for x in docs.columns if x != "text")).alias("row"), *row_key(F.col("doc_id"), F.col("text")), F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = stage(keyed.select("doc_id", *KEY, "text").mapInArrow(_sizes, "doc_id long, key_id long, key_text long, n int, s long"), "sets")
    groups = similar_sets(keyed.select(*KEY, "text"), sets)
    named = sets.where("n > 0").join(groups.select(F.col("node").alias("s"), "component"), "s", "left").withColumn("g", F.coalesce("component", "s"))
    stay = named.groupBy("g").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), *KEY)).alias("k")).select("k.key_id", "k.key_text")
    stay = stage(stay.withColumn("full", F.lit(True)).unionAll(sets.where("n = 0").select(*KEY).distinct().withColumn("full", F.lit(False))), "stay")
    out = keyed.join(stay.hint("merge"), KEY)
    nth = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.lit(0)))
    out = out.withColumn("nth", nth).where(~F.col("full") | (F.col("nth") == 1))
    return out.select(*(F.col("text") if x == "text" else F.col(f"row.`{x}`") for x in docs.columns))


SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
e AS (SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.r <> y.r GROUP BY ALL) JOIN n na ON na.r = a JOIN n nb ON nb.r = b
      WHERE 100 * c >= 75 * (na.n + nb.n - c)),
t AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a),
c AS (SELECT t.a, min(d.doc_id) AS m FROM t JOIN d ON d.r = t.b GROUP BY t.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id FROM d LEFT JOIN n USING (r) LEFT JOIN c ON c.a = d.r
"""
