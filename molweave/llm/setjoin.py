"""Problem 2: all pairs of similar sets by an extended-prefix join.

Tokens are ordered rare first. Two sets with Jaccard similarity >= t share their first common token
within both 1-prefixes, their first two within both 2-prefixes and so on, where the l-prefix of a set
of n tokens has n - ceil(t n) + l tokens. A record is joined on single prefix tokens where these are
rare; where a token's posting list is long, on combinations of two, where these are still long, of three, and
so on up to ``MOST_SHARED``. Lists that are long even then are cut into blocks that meet block by block.
Signatures of 128 bits rule out most candidates before they are sent anywhere; the rest is verified on the
whole sets.

Copies are collapsed first: sets are classes with members, and only different sets are compared. Crowded
classes are expanded in lanes of about ``LANE_ROWS`` members.
Defined results: null and empty arrays match nothing, null tokens are dropped, repeats within an array
count once; rows with a null id are left out; rows delivered again change nothing; a record with two
different sets matches by either, never itself; ties cannot occur as all pairs come out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molweave.session import cut, join_grouped

THRESHOLD = 0.7
LONG_LIST = 128
FREQUENT_ROWS = 100_000
MOST_SHARED = 5
LANE_ROWS = 1_000
MOST_LISTS = 100_000


def _as_set(tokens: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(tokens, lambda t: t.isNotNull())))


def reaction_sets(results: DataFrame, templates: DataFrame) -> DataFrame:
    """``family, src, id, tokens`` of reactions (src r) and templates (src t, family support)."""
    rows = results.where("mode = 'delta'").select("reaction_id", "support", "tokens_r", "tokens_p")
    fields = F.array(*[F.struct(F.lit(c).alias("family"), F.col(c).alias("tokens")) for c in ("support", "tokens_r", "tokens_p")])
    r = rows.select(F.col("reaction_id").alias("id"), F.explode(fields).alias("f")).select("f.family", F.lit("r").alias("src"), "id", _as_set(F.col("f.tokens")).alias("tokens"))
    t = templates.select(F.lit("support").alias("family"), F.lit("t").alias("src"), F.col("template_id").alias("id"), _as_set(F.col("support")).alias("tokens"))
    return r.unionByName(t).where("size(tokens) > 0 and id is not null")


def _need(t: float) -> Column:
    """Shared tokens of a similar pair, at least."""
    return F.ceil((F.col("a.n") + F.col("b.n")) * F.lit(t / (1 + t)) - F.lit(1e-9))


def _may_match(t: float) -> Column:
    """Sizes and signatures that a similar pair can have: each bit that only one of them has is a token that the
    other lacks."""
    sizes = F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * F.lit(t) - F.lit(1e-9)
    lacks = lambda x, y: sum((F.bit_count(F.col(f"{x}.{c}").bitwiseAND(F.bitwise_not(F.col(f"{y}.{c}")))) for c in ("s0", "s1")), F.lit(0)) <= F.col(f"{x}.n") - _need(t)
    return sizes & lacks("a", "b") & lacks("b", "a")


def _met(a: DataFrame, b: DataFrame, keys: list[str], *conds: Column) -> DataFrame:
    """Pairs of records that share a key; at least one side must be a reaction."""
    on = (F.col("a.uid") < F.col("b.uid")) & (F.col("a.has_r") | F.col("b.has_r"))
    for k in ["family", *keys]:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    for c in conds:
        on = on & c
    return a.alias("a").join(b.alias("b"), on).select("a.family", F.col("a.uid").alias("uid_a"), F.col("b.uid").alias("uid_b"))


def _met_in_blocks(posts: DataFrame, *conds: Column) -> DataFrame:
    """The same for long lists, whose first sides are spread over lanes that all second sides visit."""
    lanes = F.ceil(F.col("posted") / F.lit(LANE_ROWS)).cast("int")
    a = posts.withColumn("lane", F.pmod(F.xxhash64("uid"), lanes).cast("int"))
    b = posts.withColumn("lane", F.explode(F.sequence(F.lit(0), lanes - 1)))
    return _met(a, b, ["key", "lane"], *conds)


def _split(posts: DataFrame, long_list: int) -> tuple[DataFrame, DataFrame | None]:
    """Postings of short and of long lists, the latter with their length ``posted``; none if no list is long."""
    lists = cut(posts.groupBy("family", "key").agg(F.count("*").alias("posted")).where(F.col("posted") > long_list))
    count, total = lists.agg(F.count("*"), F.sum("posted")).first()
    if not count:
        return posts, None
    # Few long lists are broadcast, so that only what a join needs is shuffled; many meet their postings by shuffle.
    if count <= MOST_LISTS:
        flagged = posts.join(F.broadcast(lists), ["family", "key"], "left")
    else:
        flagged = join_grouped(posts, lists, ["family", "key"], "posted", total, "left")
    return flagged.where("posted is null").drop("posted"), flagged.where("posted is not null")


def _only_copies(n: int, t: float) -> bool:
    """Whether a set of n tokens can be similar to its copies only."""
    return math.ceil(t * n - 1e-9) == n and math.floor(n / t + 1e-9) == n


def classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``family, uid, tokens, n, has_r, copies`` of the different sets, and ``family, uid, src, id``."""
    named = sets.withColumn("uid", F.unhex(F.md5(F.array_join(F.col("tokens").cast("array<string>"), ","))))
    members = named.select("family", "uid", "src", "id").distinct()
    uniq = named.groupBy("family", "uid").agg(F.first("tokens").alias("tokens"), F.max(F.col("src") == "r").alias("has_r"), F.count("*").alias("copies"))
    return uniq.withColumn("n", F.size("tokens")), members


def _prefixes(frequent: dict[str, tuple[np.ndarray, np.ndarray]], t: float):
    """``family, uid, has_r, tokens`` to what ``_posts`` gives, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(3)
            n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            row, token = np.repeat(np.arange(len(n)), n), np.asarray(lists.flatten(), np.int64)
            df = np.zeros(len(token), np.int64)
            family = np.asarray(batch.column(0).to_pylist(), object)[row]
            for name, (known, times) in frequent.items():
                mine = np.flatnonzero(family == name)
                at = np.minimum(np.searchsorted(known, token[mine]), len(known) - 1)
                df[mine] = np.where(known[at] == token[mine], times[at], 0)
            # Tokens of equal frequency in an order that looks random; no two tokens have the same number.
            h = token.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            order = np.lexsort((h, df, row))
            starts = np.cumsum(n) - n
            p1 = n - np.ceil(n * t - 1e-9).astype(np.int64) + 1
            kept = np.minimum(n, p1 + MOST_SHARED - 1)
            inside = np.arange(len(token)) - np.repeat(starts, n) < np.repeat(kept, n)
            prefix = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(kept)].astype(np.int32)), pa.array(token[order][inside]))
            # Each token sets one of 128 bits.
            place = h >> np.uint64(57)
            bit = np.uint64(1) << (place & np.uint64(63))
            words = [np.bitwise_or.reduceat(np.where((place >> np.uint64(6)) == np.uint64(w), bit, np.uint64(0)), starts).view(np.int64) for w in (0, 1)]
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(n.astype(np.int32)), *map(pa.array, words), pa.array(p1.astype(np.int32)), prefix]
            yield pa.record_batch(columns, ["family", "uid", "has_r", "n", "s0", "s1", "p1", "prefix"])

    return run


def _posts(live: DataFrame, t: float) -> DataFrame:
    """``family, uid, has_r, n, s0, s1, p1, prefix``: signatures, and the first tokens in rare-first order, as
    many as the deepest level needs; ``p1`` of them are the 1-prefix."""
    df = live.select("family", F.explode("tokens").alias("token")).groupBy("family", "token").agg(F.count("*").alias("df")).where("df > 1")
    df = cut(df)
    total = df.agg(F.sum("df")).first()[0] or 0
    # At most FREQUENT_ROWS tokens can reach this frequency; all others count as equally rare.
    rows = df.where(F.col("df") >= max(4, total // FREQUENT_ROWS)).collect()
    frequent = {}
    for name in {r["family"] for r in rows}:
        mine = sorted((r["token"], r["df"]) for r in rows if r["family"] == name)
        frequent[name] = tuple(np.array(x, np.int64) for x in zip(*mine))
    schema = "family string, uid binary, has_r boolean, n int, s0 long, s1 long, p1 int, prefix array<long>"
    return live.select("family", "uid", "has_r", "tokens").mapInArrow(_prefixes(frequent, t), schema)


def similar_classes(uniq: DataFrame, t: float = THRESHOLD, long_list: int = LONG_LIST) -> DataFrame:
    """``family, uid_a, uid_b, similarity, copies_a, copies_b`` of all different sets with Jaccard similarity >= t.

    ``uniq`` is read several times: pass it with its lineage cut.
    """
    if not 0 < t <= 1:
        raise ValueError("the threshold must be in (0, 1]")
    alone = F.array(*[F.lit(n) for n in range(1, 64) if _only_copies(n, t)] or [F.lit(0)])
    live = uniq.where(~F.array_contains(alone, F.col("n"))) if t < 1 else uniq.where(F.lit(False))
    base = ["family", "uid", "has_r", "n", "s0", "s1"]
    start = F.posexplode(F.slice("prefix", F.lit(1), F.col("p1"))).alias("pos", "x")
    posts = cut(_posts(live, t)).select(*base, "p1", "prefix", start).withColumn("held", F.array("x")).withColumn("key", F.xxhash64("x")).drop("x")
    # The tokens behind the first shared one must be enough, as it is the first of both.
    behind = 1 + F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos")) - 1
    conds, found = [_may_match(t), behind >= _need(t)], []
    for level in range(1, MOST_SHARED + 1):
        short, long = _split(posts, long_list)
        slim = [*base, "key", *(["pos"] if level == 1 else [])]
        found.append(_met(short.select(*slim), short.select(*slim), ["key"], *conds))
        if long is None:
            break
        if level == MOST_SHARED:
            found.append(_met_in_blocks(long.select(*slim, "posted"), *conds))
            break
        # Records too small to share more tokens than this meet here.
        n = math.floor(level / t + 1e-9)
        if not all(_only_copies(x, t) for x in range(1, n + 1)):
            small = long.where(F.col("n") <= math.floor(n / t + 1e-9)).select(*slim, "posted")
            found.append(_met_in_blocks(small, *conds, F.least("a.n", "b.n") <= n))
        conds = [_may_match(t)]
        others = F.filter(F.slice("prefix", F.lit(1), F.col("p1") + level), lambda x: ~F.array_contains("held", x))
        more = long.withColumn("x", F.explode(others)).withColumn("held", F.sort_array(F.concat("held", F.array("x"))))
        # A combination can come from each of its tokens whose list is long. Different combinations with the same
        # key only make candidates.
        posts = cut(more.withColumn("key", F.xxhash64("held")).dropDuplicates(["family", "uid", "key"]).select(*base, "p1", "prefix", "held", "key"))

    candidates = found[0]
    for f in found[1:]:
        candidates = candidates.unionByName(f)
    candidates = candidates.distinct()
    a = uniq.select("family", F.col("uid").alias("uid_a"), F.col("tokens").alias("x"), F.col("copies").alias("copies_a"))
    b = uniq.select("family", F.col("uid").alias("uid_b"), F.col("tokens").alias("y"), F.col("copies").alias("copies_b"))
    both = F.size(F.array_intersect("x", "y"))
    pairs = candidates.join(a, ["family", "uid_a"]).join(b, ["family", "uid_b"]).withColumn("both", both)
    pairs = pairs.withColumn("similarity", F.col("both") / (F.size("x") + F.size("y") - F.col("both")))
    return pairs.where(F.col("similarity") >= t).select("family", "uid_a", "uid_b", "similarity", "copies_a", "copies_b")


def _prepared(results: DataFrame, templates: DataFrame, t: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    uniq, members = classes(reaction_sets(results, templates))
    uniq, members = cut(uniq), cut(members)
    return uniq, members, similar_classes(uniq, t)


def _lanes(copies: str) -> Column:
    return F.ceil(F.col(copies) / F.lit(LANE_ROWS)).cast("int")


def similar_pairs(results: DataFrame, templates: DataFrame, t: float = THRESHOLD) -> DataFrame:
    """``field, id_a, id_b, similarity``: every pair of records, copies included, once per field."""
    uniq, members, pairs = _prepared(results, templates, t)
    twins = uniq.where("copies > 1").select("family", F.col("uid").alias("uid_a"), F.col("uid").alias("uid_b"), F.lit(1.0).alias("similarity"), F.col("copies").alias("copies_a"), F.col("copies").alias("copies_b"))
    pairs = pairs.unionByName(twins)
    sizes = uniq.where("copies > 1").select("family", "uid", "copies")
    total = sizes.agg(F.sum("copies")).first()[0] or 0
    lane = F.coalesce(F.pmod(F.xxhash64("id", "src"), _lanes("copies")), F.lit(0)).cast("int").alias("lane")
    members = join_grouped(members, sizes, ["family", "uid"], "copies", total, "left").select("family", "uid", "src", "id", lane)
    for end, name in (("a", "a"), ("b", "b")):
        side = members.select("family", F.col("uid").alias(f"uid_{end}"), F.col("src").alias(f"src_{end}"), F.col("id").alias(name), "lane")
        pairs = pairs.withColumn("lane", F.explode(F.sequence(F.lit(0), _lanes(f"copies_{end}") - 1))).join(side, ["family", f"uid_{end}", "lane"]).drop("lane")
    rows = pairs
    cross = F.col("src_a") != F.col("src_b")
    twin = F.col("uid_a") == F.col("uid_b")
    rows = rows.where((cross & ~(twin & (F.col("src_a") == "r"))) | (~cross & (F.col("src_a") == "r") & ((~twin & (F.col("a") != F.col("b"))) | (F.col("a") < F.col("b")))))
    swap = F.when(cross, F.col("src_a") == "r").otherwise(F.col("a") > F.col("b"))
    out = rows.select(
        F.when(cross, F.lit("template")).otherwise(F.col("family")).alias("field"),
        F.when(swap, F.col("b")).otherwise(F.col("a")).alias("id_a"),
        F.when(swap, F.col("a")).otherwise(F.col("b")).alias("id_b"),
        "similarity",
    )
    return out.groupBy("field", "id_a", "id_b").agg(F.max("similarity").alias("similarity"))


def linked_records(results: DataFrame, templates: DataFrame, t: float = THRESHOLD) -> DataFrame:
    """``field, id, class_id, copies, links``: for each reaction and field the smallest id with the same
    set, the number of reactions with it and the number of other sets similar to it. Copies are not
    expanded into pairs here."""
    _, members, pairs = _prepared(results, templates, t)
    r = members.where("src = 'r'")
    both = pairs.select("family", F.explode(F.array("uid_a", "uid_b")).alias("uid"))
    links = both.groupBy("family", "uid").agg(F.count("*").alias("links"))
    groups = r.groupBy("family", "uid").agg(F.min("id").alias("class_id"), F.count("*").alias("copies")).join(links, ["family", "uid"], "left")
    rows = join_grouped(r, groups, ["family", "uid"], "copies", results.count() * 3)
    return rows.select(F.col("family").alias("field"), "id", "class_id", "copies", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
