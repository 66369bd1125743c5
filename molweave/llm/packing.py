"""Problem 6: items into containers of fixed capacity by large-item matching over size classes.

Sizes are whole numbers up to the capacity, so the whole packing is decided on the census of sizes
(at most ``capacity`` rows whatever the data) with run-length bins: greedy matching pairs the classes
above a third of the capacity, at most two to a bin; the smaller ones fill the tightest remaining
gaps, largest first. Items then learn their bin from their rank within their size: ranks come from
counts per hash chunk, so that a size that holds a third of all items is never sorted in one task.

Defined results: null and whitespace-only texts are no items; an item above the capacity is cut into
full pieces and one remainder, its pieces numbered from 0; equal sizes are told apart by the rank of
``doc_id`` within chunks; rows that repeat a ``doc_id`` are items of their own; an empty table gives no
containers.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from molweave.llm.sizes import CAPACITY, sized
from molweave.session import cut

CHUNK_ROWS = 100_000


def plan_bins(census: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Slots ``(size, first rank, slots, copies per bin, first bin)`` and the number of bins.

    ``census`` has the number of items of each size. A class of bins is (count, recipe) with one gap.
    """
    left = {s: n for s, n in census.items() if n > 0}
    if any(s < 1 or s > capacity for s in left):
        raise ValueError("sizes must lie between 1 and the capacity")
    gaps: dict[int, list[tuple[int, tuple]]] = {}
    order: list[int] = []  # the gaps that occur, ascending

    def add(gap: int, count: int, recipe: tuple) -> None:
        if gap not in gaps:
            gaps[gap] = []
            bisect.insort(order, gap)
        gaps[gap].append((count, recipe))

    def take(gap: int) -> tuple[int, tuple]:
        found = gaps[gap].pop()
        if not gaps[gap]:
            del gaps[gap]
            order.remove(gap)
        return found

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        s = large[-1]
        at = bisect.bisect_right(large, capacity - s) - 1
        if at < 0:
            add(capacity - s, left[s], ((s, 1),))
            large.pop()
            continue
        p = large[at]
        pairs = left[s] // 2 if p == s else min(left[s], left[p])
        if pairs:
            add(capacity - s - p, pairs, ((s, 2),) if p == s else ((s, 1), (p, 1)))
        for x in (s, p):
            left[x] -= pairs
        if p == s and left[s]:  # an odd one: its partner comes from the next smaller class
            del large[at]
            rest = bisect.bisect_right(large, capacity - s) - 1
            if rest >= 0:
                q = large[rest]
                add(capacity - s - q, 1, ((s, 1), (q, 1)))
                left[q] -= 1
                if not left[q]:
                    del large[rest]
            else:
                add(capacity - s, 1, ((s, 1),))
            left[s] = 0
            continue
        large = [x for x in large if left[x] > 0] if not left[s] or not left[p] else large

    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[s]
        while n:
            at = bisect.bisect_left(order, s)
            gap = order[at] if at < len(order) else capacity
            count, recipe = take(gap) if at < len(order) else (-(-n // (capacity // s)), ())
            each = gap // s
            full = min(count, n // each)
            if full:
                add(gap - each * s, full, (*recipe, (s, each)))
                n -= full * each
            count -= full
            if count and n and n < each:
                add(gap - n * s, 1, (*recipe, (s, n)))
                count, n = count - 1, 0
            if count and recipe:
                add(gap, count, recipe)

    slots, rank, bins = [], {}, 0
    for gap in order:
        for count, recipe in gaps[gap]:
            for s, each in recipe:
                slots.append((s, rank.get(s, 0), each * count, each, bins))
                rank[s] = rank.get(s, 0) + each * count
            bins += count
    assert rank == {s: n for s, n in census.items() if n > 0}
    return slots, bins


def assign(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, size, container`` of every piece of every item."""
    spark = documents.sparkSession
    items = sized(documents).select("doc_id", "size")
    cuts = F.sequence(F.lit(0), F.ceil(F.col("size") / F.lit(capacity)).cast("int") - 1)
    pieces = items.select("doc_id", F.col("size").alias("whole"), F.explode(cuts).alias("piece"))
    pieces = pieces.select("doc_id", "piece", F.least(F.lit(capacity), F.col("whole") - F.col("piece") * F.lit(capacity)).cast("int").alias("size"))
    chunks = max(1, documents.count() // CHUNK_ROWS)
    pieces = cut(pieces.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int")))
    counts = pieces.groupBy("size", "chunk").count()
    before = Window.partitionBy("size").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0)))
    census = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("count").alias("n")).collect()}
    slots, _ = plan_bins(census, capacity)
    table = spark.createDataFrame(slots or [(0, 0, 0, 1, 0)], "slot_size int, first long, n long, each int, bin long")
    inside = Window.partitionBy("size", "chunk").orderBy("doc_id", "piece")
    ranked = pieces.join(counts.drop("count"), ["size", "chunk"]).withColumn("rank", F.col("base") + F.row_number().over(inside) - 1)
    # The table of slots is bounded by the capacity: a few slots for each size that can occur.
    hit = (F.col("size") == F.col("slot_size")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n"))
    placed = ranked.join(F.broadcast(table), hit)
    return placed.select("doc_id", "piece", "size", (F.col("bin") + F.floor((F.col("rank") - F.col("first")) / F.col("each"))).cast("long").alias("container"))


def report(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``containers, items, used, unused_share, least_containers``: one row."""
    bins = placed.groupBy("container").agg(F.sum("size").alias("used"), F.count("*").alias("items"))
    return bins.agg(
        F.count("*").alias("containers"),
        F.coalesce(F.sum("items"), F.lit(0)).alias("items"),
        F.coalesce(F.sum("used"), F.lit(0)).alias("used"),
        F.coalesce(1 - F.try_divide(F.sum("used"), F.count("*") * F.lit(capacity)), F.lit(0.0)).alias("unused_share"),
        F.coalesce(F.ceil(F.sum("used") / F.lit(capacity)), F.lit(0)).alias("least_containers"),
        F.coalesce(F.max("used"), F.lit(0)).alias("fullest"),
    )


def split_documents(placed: DataFrame) -> DataFrame:
    """``doc_id`` of the documents that had to be cut into pieces."""
    return placed.where("piece = 1").select("doc_id")
