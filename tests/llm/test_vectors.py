"""Neighbours and clusters against brute force, with the awkward cases."""

import numpy as np
import pyarrow as pa
import pytest

from molweave.llm import clusters, neighbours, vectors

PRINTS = "fp_id long, reaction_id long, sketch array<tinyint>"


def made(seed=0, groups=30, lone=60):
    rng = np.random.default_rng(seed)
    rows, fp = [], 1
    for _ in range(groups):
        centre = rng.choice([-1, 1], 256)
        for _ in range(rng.integers(2, 9)):
            x = centre * np.where(rng.random(256) < rng.uniform(0, 0.12), -1, 1)
            rows += [(int(fp + k), 0, x.tolist()) for k in range(int(rng.integers(1, 3)))]
            fp += 2
    for _ in range(lone):
        rows.append((int(fp), 0, rng.choice([-1, 1], 256).tolist()))
        fp += 1
    rows += [(fp + 1, 0, None), (fp + 2, 0, [0] * 256), (fp + 3, 0, [1] * 128), (fp + 4, 0, [None] + [1] * 255), (None, 0, [1] * 256)]
    rows += [(fp + 10 + k, 0, [1] * 256) for k in range(12)]  # more copies than a top five can hold
    return rows


def brute(rows):
    good = [(i, np.array(x, float)) for i, _, x in rows if i is not None and x and len(x) == 256 and None not in x and any(x)]
    ids, m = [i for i, _ in good], np.stack([x / np.linalg.norm(x) for _, x in good])
    sims = np.round(m @ m.T, 7)
    lists, near = {}, {i: set() for i in ids}
    for a, i in enumerate(ids):
        hits = sorted(((-sims[a, b], j) for b, j in enumerate(ids) if j != i and sims[a, b] >= 0.6))
        near[i] = {j for _, j in hits}
        lists[i] = [j for _, j in hits[:5]]
    label = {}
    for i in sorted(ids):
        if i not in label:
            stack = [i]
            while stack:
                x = stack.pop()
                if x not in label:
                    label[x] = i
                    stack += near[x]
    return lists, label


def found_lists(df):
    got = {}
    for r in sorted(neighbours.neighbours(df).collect(), key=lambda r: (r.fp_id, r["rank"])):
        got.setdefault(r.fp_id, []).append(r.other)
    return got


def wanted_pairs(lists):
    return {(i, j) for i, js in lists.items() for j in js}


@pytest.mark.parametrize("part_rows", [2000, 40, 8])
def test_neighbours(spark, monkeypatch, part_rows):
    monkeypatch.setattr(neighbours, "PART_ROWS", part_rows)
    rows = made()
    lists, _ = brute(rows)
    # Every vector is among the queries that choose the probes, so that nothing is missed.
    assert found_lists(spark.createDataFrame(rows, PRINTS)) == {i: js for i, js in lists.items() if js}


def families(seed, n, size, flips):
    rng = np.random.default_rng(seed)
    centres = np.repeat(rng.choice([-1, 1], (n, 256)), size, axis=0)
    x = centres * np.where(rng.random(centres.shape) < flips, -1, 1)
    return [(fp, 0, v.tolist()) for fp, v in enumerate(x)]


def test_routers_below_routers(spark, monkeypatch):
    """Three levels of small routers, groups of two parts and several lanes, queries from a sample."""
    for name, value in (("PART_ROWS", 8), ("BRANCH", 8), ("SPLIT_ROWS", 32), ("GROUP_PARTS", 2), ("LANE_ROWS", 100), ("QUERIES", 300), ("SAMPLE", 500)):
        monkeypatch.setattr(neighbours, name, value)
    rows = families(11, 300, 5, 0.09)
    depth = []
    make = neighbours.Tree.__init__

    def noted(self, *args):
        make(self, *args)
        depth.append(len(self.levels))
        # Every vector is indexed once, in a part that is small or could not be split again.
        held = self.index.collect()
        assert len({r.uid for r in held}) == len(held) == 1500

    monkeypatch.setattr(neighbours.Tree, "__init__", noted)
    want = wanted_pairs(brute(rows)[0])
    have = wanted_pairs(found_lists(spark.createDataFrame(rows, PRINTS)))
    assert depth[0] >= 2 and len(have & want) >= 0.97 * len(want)


def test_crowded_part_is_cut_into_blocks_and_lanes(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "LANE_ROWS", 50)
    rows = made(3)
    assert found_lists(spark.createDataFrame(rows, PRINTS)) == {i: js for i, js in brute(rows)[0].items() if js}


def test_dense_blocks_keep_the_smallest_ids():
    rng = np.random.default_rng(1)
    sims = rng.integers(0, 4, (40, 90)).astype(np.float32) / 4
    rows, cols = np.arange(100, 140), np.sort(rng.choice(300, 90, replace=False))
    r, c, v = neighbours._top(sims, 0.2, rows, cols)
    best = neighbours._best(r, c, v, cols)
    for i in range(40):
        want = sorted((-sims[i, j], cols[j]) for j in range(90) if sims[i, j] >= 0.2 and cols[j] != rows[i])[:5]
        assert [(-x, cols[j]) for k, j, x in zip(r[best], c[best], v[best]) if k == i] == want


def test_least_probes():
    need, hits = np.array([1] * 990 + [30] * 10 + [2] * 50 + [40] * 50), np.array([50] * 1000 + [3] * 100)
    assert neighbours.least_probes(need, hits) == 40  # the few pairs of small families count by themselves
    assert neighbours.least_probes(need[:990], hits[:990]) == 1


def test_ranks_multiply_within_the_probes():
    x = np.random.default_rng(3).choice([-1, 1], (5, 256)).astype(np.float32)
    w = np.random.default_rng(4).standard_normal((257, 8)).astype(np.float32)
    moved = neighbours._moved(w, 0, np.arange(5), pa.array(vectors.pack(x), pa.binary()), np.array([1, 2, 3, 6, 7]), 6, False)
    assert np.bincount(moved.column("uid").to_numpy(), minlength=5).tolist() == [6, 3, 2, 1, 0]
    assert moved.column("place").to_pylist() == [1, 2, 3, 4, 5, 6, 2, 4, 6, 3, 6, 6]


def test_most_parts_are_balanced():
    x = np.random.default_rng(5).choice([-1, 1], (1024, 256)).astype(np.float32) / 16
    part = neighbours.balanced_parts(x, neighbours.neighbour_graph(x), neighbours.BRANCH)
    assert np.bincount(part, minlength=neighbours.BRANCH).tolist() == [4] * neighbours.BRANCH


def test_packed_bits():
    x = np.random.default_rng(2).choice([-1, 1], (5, 256)).astype(np.float32)
    x[3, :7] = 0
    packed = vectors.pack(x)
    assert [len(b) for b in packed] == [32, 32, 32, 64, 32] and (vectors.unpack(packed) == x).all()


def test_pairs_come_once(spark):
    found = neighbours.pairs(neighbours.neighbours(spark.createDataFrame(made(1, 5, 5), PRINTS))).collect()
    assert len(found) == len(set(found)) and all(a < b for a, b in found)


def crowd(monkeypatch, root, block):
    monkeypatch.setattr(clusters, "CELLS_ROOT", root)
    monkeypatch.setattr(clusters, "BLOCK", block)
    if block < 2048:
        monkeypatch.setattr(clusters, "ASK_ROWS", 8 * block)
        monkeypatch.setattr(clusters, "HELD_ROWS", 12 * block)


@pytest.mark.parametrize(("root", "block"), [(0.2, 2048), (1.5, 2048), (0.01, 8), (1.0, 8)])
def test_clusters(spark, monkeypatch, root, block):
    crowd(monkeypatch, root, block)
    rows = made(2)
    _, label = brute(rows)
    sizes = {}
    for c in label.values():
        sizes[c] = sizes.get(c, 0) + 1
    got = {(r.cluster_id, r.fp_id) for r in clusters.cluster_members(spark.createDataFrame(rows, PRINTS)).collect()}
    assert got == {(c, i) for i, c in label.items() if sizes[c] > 1}


def members_of(label):
    sizes = {}
    for c in label.values():
        sizes[c] = sizes.get(c, 0) + 1
    return {(c, i) for i, c in label.items() if sizes[c] > 1}


@pytest.mark.parametrize("block", [2048, 8])
def test_families_that_touch_become_one_cluster(spark, monkeypatch, block):
    """Centres that differ in the same 46 places: links of cosine 0.6 cross the boundary from far away."""
    crowd(monkeypatch, 1.2, block)
    rng = np.random.default_rng(7)
    centre = rng.choice([-1, 1], 256)
    other = np.where(np.arange(256) < 46, -centre, centre)
    rows = [(fp, 0, ((centre, other)[fp % 2] * np.where(rng.random(256) < 0.01, -1, 1)).tolist()) for fp in range(1, 301)]
    rows += [(fp, 0, rng.choice([-1, 0, 1], 256).tolist()) for fp in range(301, 361)]
    _, label = brute(rows)
    assert len({c for c, _ in members_of(label)}) == 1
    got = {(r.cluster_id, r.fp_id) for r in clusters.cluster_members(spark.createDataFrame(rows, PRINTS)).collect()}
    assert got == members_of(label)


@pytest.mark.parametrize("seed", range(3))
def test_clusters_over_many_cells(spark, monkeypatch, seed):
    crowd(monkeypatch, 2.0, 4)
    rows = made(20 + seed)
    for margin in (None, clusters.widest(0.6)):
        got = {(r.cluster_id, r.fp_id) for r in clusters.cluster_members(spark.createDataFrame(rows, PRINTS), margin=margin).collect()}
        assert got == members_of(brute(rows)[1])


def test_margin_spares_comparisons(spark):
    """Families whose links need little: the measured margin is far below the one that no data can defeat."""
    rows = [(fp, x) for fp, _, x in families(3, 200, 6, 0.05)]
    uniq = spark.createDataFrame([(fp, vectors.pack(np.array([x]))[0]) for fp, x in rows], "uid long, bits binary")
    x = vectors.unit(np.array([v for _, v in rows], np.float32))
    model = clusters.fit_cells(x, 24)
    margin = clusters.measured_margin(uniq, model, 0.6)
    near, far = clusters.boundaries(model, x)
    assert margin < 0.6 * clusters.widest(0.6) and (far <= margin).sum() < 0.7 * (far <= clusters.widest(0.6)).sum()
    sims = x @ x.T >= 0.6
    a, b = np.nonzero(sims)
    assert (np.minimum(far[a, near[b]], far[b, near[a]]) <= margin).all()


def test_medoids(spark):
    rows = made(4, 6, 3)
    _, label = brute(rows)
    vec = {i: np.array(x, float) / 16 for i, _, x in rows if i in label}
    top = {}
    for r in clusters.describe(spark.createDataFrame(rows, PRINTS)).collect():
        mates = [j for j in label if label[j] == r.cluster_id]
        assert r["size"] == len(mates)
        assert abs(r.mean_cosine - (sum(vec[r.fp_id] @ vec[j] for j in mates) - 1) / (len(mates) - 1)) < 1e-6
        if r["rank"] == 1:
            top[r.cluster_id] = r
    for c, r in top.items():
        mates = [j for j in label if label[j] == c]
        assert all((sum(vec[i] @ vec[j] for j in mates) - 1) / (len(mates) - 1) <= r.mean_cosine + 1e-6 for i in mates)


def test_chains_become_one_component(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = {r.node: r.root for r in clusters.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_empty(spark):
    none = spark.createDataFrame([], PRINTS)
    assert neighbours.neighbours(none).count() == 0 and clusters.cluster_members(none).count() == 0 and clusters.describe(none).count() == 0
    bad = spark.createDataFrame([(1, 0, None), (2, 0, [0] * 256)], PRINTS).withColumnRenamed("reaction_id", "bits")
    assert neighbours.neighbours(bad).count() == 0 and clusters.cluster_members(bad).count() == 0


def test_search_unpacks_two_blocks_at_a_time(monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rows, unpacked = families(3, 40, 5, 0.05), []
    make = neighbours.vectors
    monkeypatch.setattr(neighbours, "vectors", lambda column: unpacked.append(len(column)) or make(column))
    x = np.array([r[2] for r in rows])
    uid = pa.array([r[0] for r in rows] * 2)
    table = pa.table({"uid": uid, "bits": pa.array(vectors.pack(x) * 2, pa.binary()), "parts": pa.array([[1]] * 400, pa.list_(pa.int64())), "home": pa.array([True] * 200 + [False] * 200)})
    found = neighbours._search(0.6)(table).to_pydict()
    assert max(unpacked) <= 16
    got = {}
    for a, b in zip(found["uid"], found["other"]):
        got.setdefault(a, []).append(b)
    assert {a: sorted(b) for a, b in got.items()} == {i: sorted(js) for i, js in brute(rows)[0].items() if js}


@pytest.mark.parametrize("alike", [False, True])
def test_pairs_in_reach_by_their_first_values(alike):
    rng = np.random.default_rng(3)
    x = rng.choice([-1, 1], (300, 256)) * (rng.random((300, 256)) < rng.choice([1, 0.9], (300, 1)))
    y = np.vstack([x[:150] * np.where(rng.random((150, 256)) < rng.uniform(0, 0.25, (150, 1)), -1, 1), rng.choice([-1, 0, 1], (200, 256))])
    if alike:  # only the last values differ
        x[:, : clusters.HEAD], y[:, : clusters.HEAD] = 1, 1
    x, y = vectors.unit(x.astype(np.float32)), vectors.unit(y.astype(np.float32))
    want = set(zip(*np.nonzero(x.astype(float) @ y.T.astype(float) >= 0.6 - 1e-5)))
    assert want and set(zip(*clusters.in_reach(x, y, 0.6))) == want
    packed = pa.chunked_array([pa.array(vectors.pack(np.sign(x)), pa.binary())])
    assert np.array_equal(vectors.vectors(packed), x) and np.array_equal(vectors.vectors(packed.slice(11, 50)), x[11:61])
    assert vectors.vectors(packed.slice(0, 0)).shape == (0, 256)


def test_vectors_of_many_cells_are_compared_together(monkeypatch):
    rng = np.random.default_rng(4)
    calls, real = [], clusters.in_reach
    monkeypatch.setattr(clusters, "in_reach", lambda x, y, low: calls.append((len(x), len(y))) or real(x, y, low))
    x = rng.choice([-1, 1], (400, 256))
    x[100:200] = x[:100] * np.where(rng.random((100, 256)) < 0.08, -1, 1)
    home = np.r_[np.zeros(100, int), 1 + np.arange(300) % 60]
    near = [sorted({0, *rng.integers(1, 61, 9).tolist()}) for _ in range(100)]
    rows = [*((i, True) for i in range(100)), *((i, False) for i in range(400))]
    at = [i for i, _ in rows]
    table = pa.table({"uid": pa.array(at, pa.int64()), "bits": pa.array(vectors.pack(x[at]), pa.binary()), "home": pa.array(home[at], pa.int32()), "near": pa.array([near[i] if a else None for i, a in rows], pa.list_(pa.int32())), "cell": pa.array([0] * 500, pa.int32()), "asks": pa.array([a for _, a in rows])})
    links = clusters._local(0.6)(table)
    got = {frozenset(p) for p in zip(links.column("a").to_pylist(), links.column("b").to_pylist())}
    owed = {i for i in range(100) if clusters.first_of(home[i + 100], 0) == 0 or home[i + 100] not in near[i]}
    assert {frozenset((i, i + 100)) for i in owed} <= got <= {frozenset((i, i + 100)) for i in range(100)}
    assert len(calls) <= 2
