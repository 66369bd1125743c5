"""Problem 7: a mix of sources at target shares by min-cost flow over membership patterns.

The sources that hold the same text form its membership pattern. Per pattern and source the sizes are
summed up; a flow network routes tokens from patterns to source quotas, where the r-th use of a text
costs 2r - 1 in its source and over all sources, so repeats are spread as thinly as the quotas allow.
The network has one node per pattern that occurs, at most 2^sources, and is solved on the driver. All patterns are
told apart; a caller can set ``MOST_PATTERNS`` to let texts of the rarer shared patterns count as not shared.
Documents are then drawn by a seeded hash until the routed sizes are reached, with cumulative sums over
hash buckets, so that no source is sorted in one task.

Defined results: null and blank texts are no items; ``source`` is compared without case and
surrounding whitespace, unknown and null sources are left out; a source without documents gets
nothing; equal hashes are ordered by ``doc_id``; rows with the same text are documents of their own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from molweave.llm.sizes import plain_source, sized
from molweave.session import cut, join_grouped

BUCKET_ROWS = 2_000
MOST_PATTERNS: int | None = None
SEED = 17
FAR = 1 << 60
MOST_ARCS = 1 << 30


class FlowNetwork:
    """Min-cost maximum flow with whole capacities: primal-dual, one blocking flow per path cost."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, cap: int, cost: int) -> int:
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def _distances(self, s: int) -> np.ndarray:
        """Cost of the cheapest path to each node, of equals the one with the fewest arcs, so that no path goes in circles.
        All arcs at a time, in as many rounds as the longest such path has arcs."""
        live = np.flatnonzero(np.array(self.cap, np.int64) > 0)
        end, cost = np.array(self.to, np.int64), np.array(self.cost, np.int64)[live] * MOST_ARCS + 1
        a, b = end[live ^ 1], end[live]
        dist = np.full(len(self.out), FAR)
        dist[s] = 0
        while True:
            new = dist.copy()
            reached = dist[a] < FAR
            np.minimum.at(new, b[reached], dist[a[reached]] + cost[reached])
            if (new == dist).all():
                return dist
            dist = new

    def run(self, s: int, t: int) -> None:
        every = self.out
        while True:
            dist = self._distances(s)
            if dist[t] == FAR:
                return
            # Only arcs of cheapest paths, and back along them, in their order.
            end, cost = np.array(self.to, np.int64), np.array(self.cost, np.int64) * MOST_ARCS + 1
            a = end[np.arange(len(end)) ^ 1]
            self.out = [[] for _ in every]
            kept = np.flatnonzero((dist[a] < FAR) & (dist[a] + cost == dist[end]))
            for x, e in zip(a[kept].tolist(), kept.tolist()):
                self.out[x].append(e)
            at = [0] * len(every)
            while self._push(s, t, at):
                pass
            self.out = every

    def _push(self, s: int, t: int, at: list[int]) -> bool:
        """One augmenting path of shortest arcs, depth first."""
        path: list[int] = []
        on, a = {s}, s
        while a != t:
            while at[a] < len(self.out[a]):
                e = self.out[a][at[a]]
                b = self.to[e]
                if self.cap[e] > 0 and b not in on:
                    break
                at[a] += 1
            else:
                if not path:
                    return False
                on.discard(a)
                a = self.to[path.pop() ^ 1]
                at[a] += 1
                continue
            path.append(e)
            on.add(b)
            a = b
        least = min(self.cap[e] for e in path)
        for e in path:
            self.cap[e] -= least
            self.cap[e ^ 1] += least
        return True


def route(amounts: dict[tuple[str, str], int], texts: dict[str, int], quotas: dict[str, int], repeats: dict[str, int]) -> dict[tuple[str, str], int]:
    """Tokens routed from each (pattern, source); ``texts`` has the size of a pattern's different texts."""
    patterns, sources = sorted(texts), sorted(quotas)
    net = FlowNetwork(2 + len(patterns) + len(sources))
    node = {("p", p): 2 + i for i, p in enumerate(patterns)} | {("s", s): 2 + len(patterns) + i for i, s in enumerate(sources)}
    arcs: dict[tuple[str, str], list[tuple[int, int]]] = {}
    for p in patterns:
        most = sum(repeats[s] * amounts.get((p, s), 0) for s in sources)
        r = 1
        while most > 0:
            net.arc(0, node["p", p], min(texts[p], most), 2 * r - 1)
            most -= texts[p]
            r += 1
    for (p, s), a in sorted(amounts.items()):
        arcs[p, s] = [(net.arc(node["p", p], node["s", s], a, 2 * r - 1), a) for r in range(1, repeats[s] + 1)]
    for s in sources:
        net.arc(node["s", s], 1, quotas[s], 0)
    net.run(0, 1)
    return {k: sum(a - net.cap[e] for e, a in es) for k, es in arcs.items()}


def _documents(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """``doc_id, source, size, text_key`` of the documents of the target sources, and ``pattern``."""
    names = targets.where("source is not null").select(F.col("source").alias("target"), plain_source(F.col("source")).alias("plain"))
    docs = sized(documents).withColumn("plain", plain_source(F.col("source"))).drop("source")
    # One row for each target source: the list the caller gives, of the size of a configuration.
    docs = docs.join(F.broadcast(names), "plain").select("doc_id", F.col("target").alias("source"), "size", F.unhex(F.md5("text")).alias("text_key"))
    docs = cut(docs)
    total = docs.count()
    shared = docs.groupBy("text_key").agg(F.array_sort(F.collect_set("source")).alias("all"), F.count("*").alias("copies")).where("size(all) > 1")
    shared = shared.select("text_key", F.array_join("all", "\t").alias("shared"), "copies")
    if MOST_PATTERNS is not None:
        # Asked for by the caller: texts of other patterns count in each of their sources as if no other had them.
        patterns = shared.groupBy("shared").agg(F.sum("copies").alias("n")).orderBy(F.desc("n"), "shared").limit(MOST_PATTERNS)
        shared = shared.join(F.broadcast(patterns.select("shared")), "shared", "left_semi")
    return cut(join_grouped(docs, shared, ["text_key"], "copies", total, "left").withColumn("pattern", F.coalesce("shared", "source")).drop("shared", "copies"))


def _plan(docs: DataFrame, targets: DataFrame) -> tuple[list[dict], dict[tuple[str, str], tuple[int, int]]]:
    want = {r["source"]: (r["target_share"] or 0.0, max(0, r["max_repeats"] or 0)) for r in targets.where("source is not null").collect()}
    amounts = {(r["pattern"], r["source"]): r["n"] for r in docs.groupBy("pattern", "source").agg(F.sum("size").alias("n")).collect()}
    texts = docs.groupBy("pattern", "text_key").agg(F.max("size").alias("n")).groupBy("pattern").agg(F.sum("n").alias("n"))
    texts = {r["pattern"]: r["n"] for r in texts.collect()}
    total = sum(amounts.values())
    quotas = {s: -int(-(share * total) // 1) for s, (share, _) in want.items()}
    flow = route(amounts, texts, quotas, {s: r for s, (_, r) in want.items()})
    rows = []
    for s, (share, repeats) in sorted(want.items()):
        got = sum(f for (_, x), f in flow.items() if x == s)
        size = sum(a for (_, x), a in amounts.items() if x == s)
        rows.append({"source": s, "target_share": share, "max_repeats": repeats, "own": size, "wanted": share * total, "routed": got, "short": got < share * total})
    return rows, {k: (f, amounts[k]) for k, f in flow.items()}


def short_sources(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """``source``: the sources whose quota the flow cannot fill."""
    rows, _ = _plan(_documents(documents, targets), targets)
    return documents.sparkSession.createDataFrame([(r["source"],) for r in rows if r["short"]], "source string")


def mix(documents: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """``doc_id, source, size, uses``: how often each document is used, rows with no use left out."""
    docs = _documents(documents, targets)
    _, flow = _plan(docs, targets)
    return _select(docs, flow, seed)


def _select(docs: DataFrame, flow: dict[tuple[str, str], tuple[int, int]], seed: int) -> DataFrame:
    spark = docs.sparkSession
    rows = [(p, s, f // a, f % a) for (p, s), (f, a) in flow.items() if a]
    # One row for each pattern and source, which the flow on the driver holds anyway.
    table = spark.createDataFrame(rows or [("", "", 0, 0)], "pattern string, source string, rounds long, rest long")
    buckets = max(1, docs.count() // BUCKET_ROWS)
    keyed = docs.drop("text_key").withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("bucket", F.pmod(F.shiftright("h", 20), F.lit(buckets)).cast("int"))
    keys = ["pattern", "source", "bucket"]
    sums = keyed.groupBy(*keys).agg(F.sum("size").alias("n"))
    before = Window.partitionBy("pattern", "source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy(*keys).orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    drawn = keyed.join(sums, keys).withColumn("upto", F.col("base") + F.sum("size").over(inside)).join(F.broadcast(table), ["pattern", "source"])
    extra = (F.col("upto") * 2 - F.col("size") <= F.col("rest") * 2) & (F.col("rest") > 0)
    uses = (F.col("rounds") + F.when(extra, 1).otherwise(0)).cast("long")
    return drawn.select("doc_id", "source", "size", uses.alias("uses")).where("uses > 0")


def shares(documents: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """``source, target_share, actual_share, used, documents, most_uses, short`` of every target source."""
    docs = _documents(documents, targets)
    rows, flow = _plan(docs, targets)
    used = _select(docs, flow, seed).groupBy("source").agg(F.sum(F.col("size") * F.col("uses")).alias("used"), F.count("*").alias("documents"), F.max("uses").alias("most_uses"))
    plan = documents.sparkSession.createDataFrame([(r["source"], float(r["target_share"]), r["short"]) for r in rows], "source string, target_share double, short boolean")
    every = plan.join(used, "source", "left").na.fill(0, ["used", "documents", "most_uses"])
    total = Window.partitionBy(F.lit(1))  # a row for each source
    return every.withColumn("actual_share", F.coalesce(F.try_divide("used", F.sum("used").over(total)), F.lit(0.0)))
