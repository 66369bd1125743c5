"""Problem 3: the five most similar others of every vector by learned partitions.

A bounded sample gives a neighbour graph; recursive balanced bisection with swaps cuts it into parts of
equal size with few edges across. A softmax classifier learns a vector's part from sign-flipped copies
of the sample, so that similar vectors are routed alike. A router has at most ``BRANCH`` parts; parts that
hold more than ``SPLIT_ROWS`` vectors get a router of their own, fitted where their vectors are, level by
level, so that parts stay small however many vectors there are. Every vector is indexed in its most probable
part and searched in its most probable ones: those whose ranks at all levels, multiplied, stay within a number
of probes. That number is chosen by recall against brute force for a sample of queries, in small and in large
families by themselves. Candidates are reranked by
their exact cosine. A hit counts for both vectors, which makes up for most misses of one direction.

Parts that are neighbours in the bisection travel together: a query is sent once to each group of parts,
with the parts it asks for, 32 bytes of signs at a time.

Copies are collapsed into classes with their six smallest ids, which is all that a top five can use.
Defined results: sketches that are null, all zero, of another width or hold nulls take no part; cosines
below 0.6 are no neighbours; ties are broken by the smaller ``fp_id``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from molweave.llm.vectors import MIN_COSINE, members, sample, unit, unpack, vectors
from molweave.session import cut, join_grouped

K = 5
PART_ROWS = 256
BRANCH = 256
SPLIT_ROWS = 2_048
GROUP_PARTS = 16
QUERIES = 2_048
RECALL = 0.9995
LEAST_RECALL = 0.95
FREE_PROBES = 32
SAMPLE = 16_384
GRAPH_DEGREE = 10
GRAPH_ROWS = 128
FLIPS = 0.1
BLOCK = 4_096
LANE_ROWS = 65_536
HOT_GROUPS = 10_000
MOST_LEVELS = 6


def neighbour_graph(x: np.ndarray, degree: int = GRAPH_DEGREE) -> np.ndarray:
    out = np.empty((len(x), min(degree, len(x) - 1)), np.int64)
    for i in range(0, len(x), GRAPH_ROWS):
        sims = x[i : i + GRAPH_ROWS] @ x.T
        sims[np.arange(len(sims)), np.arange(i, i + len(sims))] = -np.inf
        out[i : i + GRAPH_ROWS] = np.argpartition(-sims, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, seed: int = 0) -> np.ndarray:
    """Recursive bisection: halves along the main direction, then balanced swaps that save cut edges."""
    rng = np.random.default_rng(seed)
    part, made = np.zeros(len(x), np.int64), 1
    while made < parts:
        new = np.zeros_like(part)
        for p in range(made):
            ix = np.flatnonzero(part == p)
            if len(ix) < 2:
                new[ix] = 2 * p
                continue
            c = x[ix] - x[ix].mean(0)
            v = rng.standard_normal(c.shape[1]).astype(np.float32)
            for _ in range(8):
                v = c.T @ (c @ v)
                v /= np.linalg.norm(v) + 1e-9
            side = np.zeros(len(ix), np.int64)  # holds part numbers of the last level, too
            side[np.argsort(c @ v, kind="stable")[len(ix) // 2 :]] = 1
            where = np.full(len(x), -1)
            where[ix] = np.arange(len(ix))
            near = where[graph[ix]]
            inside = near >= 0
            for _ in range(12):
                pull = (np.where(side[near] == 1, 1, -1) * inside).sum(1)
                gain = np.where(side == 0, pull, -pull)
                a, b = (np.flatnonzero((side == s) & (gain > 0)) for s in (0, 1))
                m = min(len(a), len(b)) // 2
                if not m:
                    break
                side[a[np.argsort(-gain[a], kind="stable")[:m]]] = 1
                side[b[np.argsort(-gain[b], kind="stable")[:m]]] = 0
            new[ix] = 2 * p + side
        part, made = new, made * 2
    return part


def train_router(x: np.ndarray, part: np.ndarray, parts: int, epochs: int = 20, rate: float = 0.02, seed: int = 0) -> np.ndarray:
    """Softmax regression by Adam; the last row of the weights is the bias."""
    rng = np.random.default_rng(seed)
    w = np.zeros((x.shape[1] + 1, parts), np.float32)
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 512):
            ix = order[i : i + 512]
            noisy = unit(x[ix] * np.where(rng.random((len(ix), x.shape[1])) < FLIPS, -1, 1).astype(np.float32))
            z = noisy @ w[:-1] + w[-1]
            e = np.exp(z - z.max(1, keepdims=True))
            e /= e.sum(1, keepdims=True)
            e[np.arange(len(ix)), part[ix]] -= 1
            g = np.vstack([noisy.T @ e, e.sum(0)]) / len(ix) + 1e-4 * w
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def branches(load: int) -> int:
    """Parts of a router over ``load`` vectors: a power of 2."""
    parts = 1
    while parts < BRANCH and parts * PART_ROWS < load:
        parts *= 2
    return parts


def fit_router(x: np.ndarray, load: int) -> np.ndarray:
    """Weights of a router over ``load`` vectors from a sample of them."""
    x = unit(x)
    parts = branches(min(load, PART_ROWS * len(x)))
    return train_router(x, balanced_parts(x, neighbour_graph(x), parts), parts)


def scores(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


# A node is a part of some level: 0 is the root, the children of a node follow from its number. Sixteen
# neighbours of the bisection have numbers in a row and are a group.


def child(node: int, parts: np.ndarray) -> np.ndarray:
    return node * BRANCH + parts + 1


MOVED = pa.schema([("uid", pa.int64()), ("bits", pa.binary()), ("parts", pa.list_(pa.int64())), ("place", pa.int64())])
MOVED_ROWS = "uid long, bits binary, parts array<long>, place long"


def _moved(w: np.ndarray, node: int, uid: np.ndarray, bits: pa.Array, place: np.ndarray, probes: int, grouped: bool) -> pa.RecordBatch:
    """The most probable parts of each row: a row for each part, or for each group of parts. ``place`` is the product
    of the ranks so far, and a part of rank r is taken while ``place * r`` is within the probes."""
    most = np.minimum(probes // place, w.shape[1])
    ranked = np.argsort(-scores(w, vectors(bits)), axis=1, kind="stable")[:, : most.max(initial=0)]
    taken = np.arange(ranked.shape[1]) < most[:, None]
    row, rank = np.nonzero(taken)
    flat, place = child(node, ranked[taken].astype(np.int64)), place[row] * (rank + 1)
    if grouped:
        order = np.lexsort((flat, row))
        row, flat, place = row[order], flat[order], place[order]
    group = (flat - 1) // GROUP_PARTS if grouped else np.arange(len(flat))
    first = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(group) != 0)]) if len(row) else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(flat)].astype(np.int32)), pa.array(flat))
    return pa.record_batch([pa.array(uid[row[first]]), bits.take(pa.array(row[first])), lists, pa.array(place[first])], schema=MOVED)


def _from_root(w: np.ndarray, probes: int, grouped: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                yield _moved(w, 0, part.column(0).to_numpy(), part.column(1), np.ones(part.num_rows, np.int64), probes, grouped)

    return run


def _down(probes: int, grouped: bool):
    def run(rows: pa.Table, models: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and models.num_rows:
            w = np.frombuffer(models.column("w")[0].as_py(), np.float32).reshape(-1, models.column("parts")[0].as_py())
            node, rows = rows.column("node")[0].as_py(), rows.select(["uid", "bits", "place"]).combine_chunks()
            for at in range(0, rows.num_rows, BLOCK):
                part = rows.slice(at, BLOCK)
                out.append(_moved(w, node, part.column("uid").to_numpy(), part.column("bits").combine_chunks(), part.column("place").to_numpy(), probes, grouped))
        return pa.Table.from_batches(out, MOVED)

    return run


def descend(rows: DataFrame, models: DataFrame, probes: int, grouped: bool = False) -> DataFrame:
    """``uid, bits, parts, place`` with the rows at nodes that have a router moved to parts within the probes.

    Crowded nodes are cut into slices, each with its copy of the router. The list of nodes is broadcast: one
    row for each of at most ``BRANCH`` to the power of the level, and of the rows over ``SPLIT_ROWS``."""
    single = rows.select("uid", "bits", "place", F.explode("parts").alias("node"))
    flagged = single.join(F.broadcast(models.select("node", "slices")), "node", "left")
    stay = flagged.where("slices is null").select("uid", "bits", F.array("node").alias("parts"), "place")
    go = flagged.where("slices is not null").select("uid", "bits", "place", "node", F.pmod(F.xxhash64("uid"), "slices").alias("slice"))
    each = models.select("node", "w", "parts", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"))
    moved = go.groupBy("node", "slice").cogroup(each.groupBy("node", "slice")).applyInArrow(_down(probes, grouped), MOVED_ROWS)
    return stay.unionByName(moved)


def _fit_node(table: pa.Table) -> pa.Table:
    order = np.argsort(table.column("h").to_numpy(), kind="stable")[:SAMPLE]
    n = table.column("n")[0].as_py()
    w = fit_router(unpack(table.column("bits").take(pa.array(order)).to_pylist()), n)
    return pa.table({"node": table.column("node")[:1], "w": pa.array([w.tobytes()], pa.binary()), "parts": pa.array([w.shape[1]], pa.int32()), "slices": pa.array([-(-n // LANE_ROWS)], pa.int64())})


class Tree:
    """Routers of all levels: the weights of the root and a table of ``node, w, parts, slices`` for each level
    below; ``index`` holds ``uid, bits, node`` of every vector at its most probable part."""

    def __init__(self, uniq: DataFrame, total: int):
        self.root: np.ndarray | None = None
        self.levels: list[DataFrame] = []
        if branches(total) > 1:
            self.root = fit_router(sample(uniq, total, SAMPLE), total)
        self.index = cut(self._start(uniq, 1, False).select("uid", "bits", F.col("parts")[0].alias("node")))
        while self.root is not None and len(self.levels) < MOST_LEVELS:
            # Nodes that were split hold no row any more, so that all crowded ones are new.
            crowded = cut(self.index.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > SPLIT_ROWS))
            if crowded.isEmpty():
                break
            picked = self.index.join(F.broadcast(crowded), "node").withColumn("h", F.xxhash64(F.lit("fit"), "uid"))
            picked = picked.where(F.pmod("h", F.lit(1_000_000)) < F.lit(1_200_000 * SAMPLE) / F.col("n"))
            models = cut(picked.groupBy("node").applyInArrow(_fit_node, "node long, w binary, parts int, slices long"))
            self.levels.append(models)
            held = self.index.select("uid", "bits", F.array("node").alias("parts"), F.lit(1).cast("long").alias("place"))
            self.index = cut(descend(held, models, 1).select("uid", "bits", F.col("parts")[0].alias("node")))

    def _start(self, uniq: DataFrame, probes: int, grouped: bool) -> DataFrame:
        rows = uniq.select("uid", "bits")
        if self.root is None:
            return rows.withColumn("parts", F.array(F.lit(1).cast("long"))).withColumn("place", F.lit(1).cast("long"))
        return rows.mapInArrow(_from_root(self.root, probes, grouped), MOVED_ROWS)

    def asked(self, uniq: DataFrame, probes: int) -> DataFrame:
        """``uid, bits, parts``: each vector at all parts it is to be searched in; the parts of a row are of one group."""
        rows = self._start(uniq, probes, not self.levels)
        for i, models in enumerate(self.levels, 1):
            rows = descend(rows, models, probes, i == len(self.levels))
        return rows.drop("place")


def _best(rows: np.ndarray, cols: np.ndarray, sims: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Positions of the K best hits of each row: higher cosine first, then the smaller id."""
    order = np.lexsort((other[cols], -sims, rows))
    r = rows[order]
    start = np.r_[0, np.flatnonzero(np.diff(r)) + 1] if len(r) else np.zeros(0, int)
    rank = np.arange(len(r)) - np.repeat(start, np.diff(np.r_[start, len(r)]))
    return order[rank < K]


def _top(sims: np.ndarray, low: float, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, col, cosine`` of at least the K best hits of each row of a block. ``cols`` must be ascending ids.

    Rows with few hits give all; of a row with many the K best are chosen by whole numbers that hold the
    rounded cosine and the column, so that a dense block costs no list of all its pairs."""
    hit = sims >= low - 1e-5
    n = hit.sum(1)
    few = (n > 0) & (n <= 2 * K)
    r, c = np.nonzero(hit & few[:, None])
    out = [(r, c)]
    dense = np.flatnonzero(n > 2 * K)
    for at in range(0, len(dense), 256):
        d = dense[at : at + 256]
        key = np.round(sims[d].astype(np.float64), 7) * 1e7
        # A row never is its own neighbour.
        key = np.where(hit[d] & (rows[d][:, None] != cols), key, -1).astype(np.int64) * len(cols) - np.arange(len(cols))
        c = np.argpartition(-key, K - 1, axis=1)[:, :K]
        kept = np.take_along_axis(key, c, 1) >= 0
        out.append((np.repeat(d, K)[kept.ravel()], c[kept]))
    r, c = (np.concatenate(x) for x in zip(*out))
    apart = rows[r] != cols[c]
    r, c = r[apart], c[apart]
    return r, c, np.round(sims[r, c].astype(np.float64), 7)


HITS = pa.schema([("uid", pa.int64()), ("other", pa.int64()), ("cosine", pa.float64())])


def _search(low: float):
    """The K best hits of a group of parts: ``home`` rows are searched by those that ask for their part."""

    def run(table: pa.Table) -> pa.Table:
        uid = table.column("uid").to_numpy()
        home = np.asarray(table.column("home").to_numpy(zero_copy_only=False), bool)
        parts = table.column("parts").combine_chunks()
        count = np.diff(parts.offsets.to_numpy())
        row, part = np.repeat(np.arange(len(uid)), count), parts.flatten().to_numpy()
        order = np.lexsort((uid[row], part))
        row, part = row[order], part[order]
        # A task can hold far more rows than its memory has room for vectors: those of two blocks at a time.
        packed = table.column("bits").combine_chunks()
        x = lambda ix: vectors(packed.take(pa.array(ix)))
        a, b, s = [], [], []
        for p in np.unique(part[home[row]]):
            mine = row[np.searchsorted(part, p, "left") : np.searchsorted(part, p, "right")]
            held, ask = mine[home[mine]], mine[~home[mine]]
            for j in range(0, len(held), BLOCK):
                h = held[j : j + BLOCK]
                xh = x(h)
                for i in range(0, len(ask), BLOCK):
                    q = ask[i : i + BLOCK]
                    sims = x(q) @ xh.T
                    for mine_, other, m in ((q, h, sims), (h, q, sims.T)):
                        r, c, v = _top(m, low, uid[mine_], uid[other])
                        a.append(uid[mine_[r]])
                        b.append(uid[other[c]])
                        s.append(v)
        if not a:
            return HITS.empty_table()
        a, b, s = (np.concatenate(v) for v in (a, b, s))
        # A hit of both directions, or of two parts, once.
        once = np.unique(np.stack([a, b]), axis=1, return_index=True)[1] if len(a) else np.zeros(0, int)
        a, b, s = a[once], b[once], s[once]
        best = _best(a, np.arange(len(a)), s, b)
        return pa.table([a[best], b[best], s[best]], schema=HITS)

    return run


def _exact(uids: np.ndarray, packed: list[bytes], low: float):
    """``uid, other, cosine, bits, hits``: for each query its K best vectors of a task and the number of all in reach,
    which comes with the first of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = unit(unpack(packed))
        hits = np.zeros(len(q), np.int64)
        row, other, cosine, bits = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), []
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                batch = batch.take(pa.array(np.argsort(batch.column(0).to_numpy(), kind="stable")))
                ids = batch.column(0).to_numpy()
                sims = q @ vectors(batch.column(1)).T
                hits += (sims >= low - 1e-5).sum(1) - np.isin(uids, ids)
                r, c, v = _top(sims, low, uids, ids)
                if not len(r):
                    continue
                bits += batch.column(1).take(pa.array(c)).to_pylist()
                row, other, cosine = np.r_[row, r], np.r_[other, ids[c]], np.r_[cosine, v]
                best = _best(row, np.arange(len(row)), cosine, other)
                row, other, cosine, bits = row[best], other[best], cosine[best], [bits[i] for i in best]
        n = np.where(np.diff(row, prepend=-1) != 0, hits[row], 0)
        yield pa.record_batch([pa.array(uids[row]), pa.array(other), pa.array(cosine), pa.array(bits, pa.binary()), pa.array(n)], ["uid", "other", "cosine", "bits", "hits"])

    return run


def least_probes(need: np.ndarray, hits: np.ndarray) -> int:
    """Probes that find ``LEAST_RECALL`` of the pairs, in small families and in large ones by themselves, or up to
    ``FREE_PROBES`` if these find more, as far as ``RECALL``. ``need`` holds the probes that find each pair."""
    least = 1
    for group in (hits <= 2 * K, hits > 2 * K):
        n = np.sort(need[group])
        if len(n):
            sure, wish = (int(n[int(np.ceil(r * len(n))) - 1]) for r in (LEAST_RECALL, RECALL))
            least = max(least, sure, min(wish, FREE_PROBES))
    return least


def _needs(rows: pa.Table, models: pa.Table) -> pa.Table:
    """The probes by which ``bits`` finds the part of ``other_bits`` below the node, and that part."""
    shape = pa.schema([("pair", pa.int64()), ("way", pa.int32()), ("bits", pa.binary()), ("other_bits", pa.binary()), ("node", pa.int64()), ("need", pa.int64())])
    if not rows.num_rows or not models.num_rows:
        return shape.empty_table()
    w = np.frombuffer(models.column("w")[0].as_py(), np.float32).reshape(-1, models.column("parts")[0].as_py())
    home = scores(w, vectors(rows.column("other_bits"))).argmax(1)
    need = _place_of(scores(w, vectors(rows.column("bits"))), home)
    node = child(rows.column("node")[0].as_py(), home)
    return pa.table([rows.column("pair"), rows.column("way"), rows.column("bits"), rows.column("other_bits"), pa.array(node), pa.array(need)], schema=shape)


def _place_of(z: np.ndarray, home: np.ndarray) -> np.ndarray:
    return ((z > np.take_along_axis(z, home[:, None], 1)).sum(1) + 1).astype(np.int64)


def choose_probes(uniq: DataFrame, tree: Tree, low: float) -> int:
    """Probes by recall against brute force for at most ``QUERIES`` vectors, chosen by the hash of their id."""
    spark = uniq.sparkSession
    picked = uniq.select("uid", "bits").orderBy(F.xxhash64(F.lit("queries"), "uid"), "uid").limit(QUERIES).collect()
    asked = {r["uid"]: bytes(r["bits"]) for r in picked}
    found = uniq.select("uid", "bits").mapInArrow(_exact(np.array(list(asked), np.int64), list(asked.values()), low), "uid long, other long, cosine double, bits binary, hits long")
    best = Window.partitionBy("uid").orderBy(F.desc("cosine"), "other")
    # At most K rows for each of the queries.
    found = found.withColumn("rank", F.row_number().over(best)).withColumn("hits", F.sum("hits").over(Window.partitionBy("uid"))).where(F.col("rank") <= K).collect()
    if not found:
        return 1
    ends = [asked[r["uid"]] for r in found], [bytes(r["bits"]) for r in found]
    z = [scores(tree.root, unit(unpack(e))) for e in ends]
    need = np.ones((len(found), 2), np.int64)
    rows = []
    for way in (0, 1):
        home = z[1 - way].argmax(1)
        need[:, way] = _place_of(z[way], home)
        rows += [(i, way, ends[way][i], ends[1 - way][i], n) for i, n in enumerate(child(0, home.astype(np.int64)).tolist())]
    if tree.levels:
        shape = "pair long, way int, bits binary, other_bits binary, node long"
        pairs = spark.createDataFrame(rows, shape)
        for models in tree.levels:
            pairs = pairs.groupBy("node").cogroup(models.groupBy("node")).applyInArrow(_needs, f"{shape}, need long")
            pairs = cut(pairs)
            for r in pairs.select("pair", "way", "need").collect():
                need[r["pair"], r["way"]] *= r["need"]
            pairs = pairs.drop("need")
    # A pair is found from either side.
    return least_probes(need.min(1), np.array([r["hits"] for r in found]))


def near_classes(uniq: DataFrame, total: int, low: float = MIN_COSINE) -> DataFrame:
    """``uid, other, cosine``: the best K others of each different vector found by routed search."""
    tree = Tree(uniq, total)
    probes = choose_probes(uniq, tree, low) if tree.root is not None else 1
    group = F.floor((F.col("parts")[0] - 1) / F.lit(GROUP_PARTS)).cast("long").alias("group")
    index = tree.index.select("uid", "bits", F.array("node").alias("parts")).select("*", group)
    asked = tree.asked(uniq, probes).select("*", group)
    # A group is searched by about so many queries a vector it holds; they are spread over lanes. Groups that
    # hold far more than the average have more lanes; beyond HOT_GROUPS of them the rest have larger tasks.
    loads = cut(index.groupBy("group").agg(F.count("*").alias("n")))
    usual = loads.agg(F.avg("n")).first()[0] or 1.0
    each = max(1, min(probes, GROUP_PARTS))
    base = max(1, int(np.ceil(usual * each / LANE_ROWS)))
    hot = loads.where(F.col("n") > 4 * max(usual, LANE_ROWS / each)).orderBy(F.desc("n"), "group").limit(HOT_GROUPS)
    hot = F.broadcast(hot.select("group", F.ceil(F.col("n") * F.lit(each / LANE_ROWS)).cast("int").alias("lanes")))
    lanes = lambda rows: rows.join(hot, "group", "left").withColumn("lanes", F.coalesce("lanes", F.lit(base)))
    lane = F.pmod(F.xxhash64("uid"), F.col("lanes")).cast("int").alias("lane")
    query = lanes(asked).select("uid", "bits", "parts", "group", lane, F.lit(False).alias("home"))
    held = lanes(index).select("uid", "bits", "parts", "group", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"), F.lit(True).alias("home"))
    hits = query.unionByName(held).groupBy("group", "lane").applyInArrow(_search(low), "uid long, other long, cosine double")
    best = Window.partitionBy("uid").orderBy(F.desc("cosine"), "other")
    return hits.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= K).drop("rank")


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``bits, copies, heads`` of each batch: its smallest ids are all that a top five can use."""
    for batch in batches:
        held: dict[bytes, list[int]] = {}
        for fp, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.setdefault(bits, []).append(fp)
        columns = [pa.array(list(held), pa.binary()), pa.array([len(v) for v in held.values()], pa.int64()), pa.array([sorted(v)[: K + 1] for v in held.values()], pa.list_(pa.int64()))]
        yield pa.record_batch(columns, ["bits", "copies", "heads"])


def classes(rows: DataFrame) -> DataFrame:
    """``bits, uid, copies, heads``: the copies of a vector, their number and the K + 1 smallest ids. A group
    receives one row from each batch, at most."""
    each = rows.mapInArrow(_heads, "bits binary, copies long, heads array<long>")
    merged = each.groupBy("bits").agg(F.sum("copies").alias("copies"), F.slice(F.sort_array(F.flatten(F.collect_list("heads"))), 1, K + 1).alias("heads"))
    return merged.select("bits", F.col("heads")[0].alias("uid"), "copies", "heads")


def neighbours(fingerprints: DataFrame, low: float = MIN_COSINE) -> DataFrame:
    """``fp_id, other, cosine, rank``: up to five most similar others of every row."""
    rows = cut(members(fingerprints))
    uniq = cut(classes(rows))
    total = uniq.count()
    near = near_classes(uniq, total, low)
    # Candidates of a class: its own heads with cosine 1 and the heads of its near classes.
    own = uniq.where("copies > 1").select("uid", F.explode("heads").alias("other"), F.lit(1.0).alias("cosine"))
    heads = uniq.select(F.col("uid").alias("other_uid"), F.explode(F.slice("heads", 1, K)).alias("other"))
    far = near.withColumnRenamed("other", "other_uid").join(heads, "other_uid").select("uid", "other", "cosine")
    best = Window.partitionBy("uid").orderBy(F.desc("cosine"), "other")
    lists = own.unionByName(far).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= K + 1)
    lists = lists.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("rank", "other", "cosine"))).alias("list"))
    lists = lists.join(uniq.select("uid", "bits", "copies"), "uid").select("bits", "copies", "list")
    asked = join_grouped(rows, lists, ["bits"], "copies", rows.count())
    kept = F.slice(F.filter("list", lambda x: x["other"] != F.col("fp_id")), 1, K)
    out = asked.select("fp_id", F.posexplode(kept).alias("pos", "x"))
    return out.select("fp_id", F.col("x.other").alias("other"), F.col("x.cosine").alias("cosine"), (F.col("pos") + 1).cast("int").alias("rank"))


def pairs(found: DataFrame) -> DataFrame:
    """``fp_a, fp_b``: each pair of a row and one of its neighbours once."""
    return found.select(F.least("fp_id", "other").alias("fp_a"), F.greatest("fp_id", "other").alias("fp_b")).distinct()
