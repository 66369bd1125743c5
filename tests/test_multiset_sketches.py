import math
import random

import pytest

from molweave.functions.hashing import exchange_hash, exchange_hashes, token_hash
from molweave import session
from molweave.operators import multiset, similarity, sketches
from molweave.plans.queries import queries

from pyspark.sql import functions as F  # isort: skip


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def toks(spark):
    return spark.createDataFrame([(1, "R", 0, 1), (1, "R", 1, 1), (1, "P", 1, 1), (1, "P", 2, 1), (2, "R", 5, 2), (2, "P", 5, 2), (3, "P", None, 1), (3, None, 4, 1)], "reaction_id long, side string, token long, cnt long")


def test_delta_union_support(toks):
    d = multiset.delta(toks)
    assert rows(d) == [(1, 0, -1), (1, 2, 1)]
    assert rows(multiset.signed_support(d)) == [(1, 1), (1, 4)]
    assert rows(multiset.union(toks)) == [(1, 0, 1), (1, 1, 2), (1, 2, 1), (2, 5, 4)]
    assert rows(multiset.pos_neg(d)) == [(1, 0, 0, 1), (1, 2, 1, 0)]
    assert rows(multiset.l1_weights(d)) == [(1, 0, -0.5), (1, 2, 0.5)]
    assert rows(multiset.l1_weights(d, False)) == [(1, 0, -1.0), (1, 2, 1.0)]
    assert rows(multiset.vocab_rank(toks.where("reaction_id = 1"))) == [(1, 0, 0), (1, 1, 1), (1, 2, 2)]
    assert [r.vector for r in multiset.dense(d, 2).collect()] == [[0.0, 1.0, 1.0, 0.0]]
    assert [r.vector for r in multiset.dense(d).collect()] == [[-1.0, 1.0]]
    assert rows(multiset.odd_tokens(toks)) == [(1, 0), (1, 2)]
    with pytest.raises(ValueError):
        multiset.combine(toks, "other")


def test_swapped_sides_negate(toks):
    swapped = toks.withColumn("side", F.translate("side", "RP", "PR"))
    assert rows(multiset.delta(swapped)) == [(r, t, -d) for r, t, d in rows(multiset.delta(toks))]


def test_clean_tokens_repeats_and_chunks(spark):
    t = spark.createDataFrame([(1, "R", 7, 2, 0), (1, "R", 7, 2, 0), (1, "R", 7, 1, 1), (1, "X", 7, 1, 1)], "reaction_id long, side string, token long, cnt long, chunk int")
    assert rows(multiset.clean_tokens(t)) == [(1, "R", 7, 3)]


def test_weights_are_checked(spark):
    good = spark.createDataFrame([(1, 5, 2, 0)], "reaction_id long, token long, pos long, neg long")
    assert multiset.check_pos_neg(good).count() == 1
    bad = spark.createDataFrame([(1, 5, -2, 0)], "reaction_id long, token long, pos long, neg long")
    with pytest.raises(Exception, match="at least 0"):
        multiset.check_pos_neg(bad).collect()


def test_parity_cancels_collisions(spark):
    s = spark.createDataFrame([(1, 1), (1, 2), (2, 9)], "reaction_id long, enc long")
    got = rows(sketches.parity_bits(s, 1024, 1))
    assert len(got) == 3 and all(0 <= b < 1024 for _, b in got)
    assert rows(sketches.parity_bits(s, 1, 1)) == [(2, 0)]
    assert rows(sketches.parity_bits(s, 1024, 2)) != got
    for bits in (0, -128):
        with pytest.raises(ValueError):
            sketches.parity_bits(s, bits)
    with pytest.raises(ValueError):
        sketches.parity_bits(s, 8, -1)


def test_minhash_estimates_jaccard(spark):
    a, b = range(0, 300), range(100, 400)
    s = spark.createDataFrame([(1, x) for x in a] + [(2, x) for x in b], "reaction_id long, enc long")
    sig = {r[0]: r[1] for r in sketches.minhash(s, 256).collect()}
    assert abs(sum(x == y for x, y in zip(sig[1], sig[2])) / 256 - 0.5) < 0.1
    assert sig == {r[0]: r[1] for r in sketches.minhash(s.union(s), 256).collect()}
    assert sig != {r[0]: r[1] for r in sketches.minhash(s, 256, 42).collect()}


def test_weighted_minhash_estimates_weighted_jaccard(spark):
    w = spark.createDataFrame([(1, t, 4, 0) for t in range(60)] + [(2, t, 2, 0) for t in range(60)] + [(3, t, 0, 4) for t in range(60)], "reaction_id long, token long, pos long, neg long")
    sig = {r[0]: r[1] for r in sketches.weighted_minhash(w, 256, normalize=False).collect()}
    assert abs(sum(x == y for x, y in zip(sig[1], sig[2])) / 256 - 0.5) < 0.1
    assert sum(x == y for x, y in zip(sig[1], sig[3])) / 256 < 0.1


def test_srp_signs_and_cosine(spark):
    w = spark.createDataFrame([(1, 1, 2, 0), (1, 3, 1, 0), (1, 7, 1, 0), (2, 10, 1, 0), (3, 1, 0, 2), (3, 3, 0, 1), (3, 7, 0, 1)], "reaction_id long, token long, pos long, neg long")
    sk = {r[0]: r[1] for r in sketches.srp(w, 256, 42).collect()}
    assert set(sk[1]) == {1, -1} and len(sk[1]) == 256
    df = spark.createDataFrame([(sk[1], sk[1], sk[2], sk[3])], "a array<tinyint>, b array<tinyint>, c array<tinyint>, d array<tinyint>")
    same, other, against = df.select(similarity.srp_cosine(F.col("a"), F.col("b")), similarity.srp_cosine(F.col("a"), F.col("c")), similarity.srp_angle_cosine(F.col("a"), F.col("d"))).first()
    assert same == 1.0 and other < 0.9 and against < -0.5


def test_local_sketches(spark):
    w = spark.createDataFrame([(1, 1, 2, 0), (1, 3, 1, 0), (1, 5, 4, 0), (1, 2, 0, 1)], "reaction_id long, token long, pos long, neg long")
    a = sketches.local_srp(w, 128, 1).first().sketch
    assert set(a) <= {1, -1} and len(a) == 128 and a == sketches.local_srp(w, 128, 1).first().sketch
    i = sketches.local_icws(w, 64, 1).first().signature
    assert len(i) == 64 and set(i) <= {0, 2, 3, 5}  # places with a weight: pos of 1, 3, 5 and neg of 2


def test_vectors_and_bits(spark):
    sig = spark.createDataFrame([(1, [-1, 1, 1]), (2, [10, 3, 18])], "reaction_id long, signature array<long>")
    assert rows(sketches.signature_bits(sig, 8)) == [(1, 1), (1, 7), (2, 2), (2, 3)]
    every = spark.createDataFrame([(1,), (4,)], "reaction_id long")
    assert rows(sketches.to_vector(every, sketches.signature_bits(sig, 8), 8)) == [(1, [0, 1, 0, 0, 0, 0, 0, 1]), (4, [0] * 8)]
    ok = spark.createDataFrame([([0, 1],)], "x array<int>")
    assert ok.select(sketches.as_binary(F.col("x"))).first()[0] == [0, 1]
    with pytest.raises(Exception, match="binary"):
        spark.createDataFrame([([0, 2],)], "x array<int>").select(sketches.as_binary(F.col("x"))).collect()


def test_similarities(spark):
    df = spark.createDataFrame([([1, 0, 1, 0], [1, 1, 0, 0], [0, 0, 0, 0], [1, 2, 3], [1, 2, 4])], "a array<int>, b array<int>, z array<int>, m array<int>, n array<int>")
    c = F.col
    t, z, j = df.select(similarity.tanimoto(c("a"), c("b")), similarity.tanimoto(c("z"), c("z")), similarity.equal_share(c("m"), c("n"))).first()
    assert math.isclose(t, 1 / 3) and z == 0.0 and math.isclose(j, 2 / 3)
    with pytest.raises(Exception, match="lengths differ"):
        df.select(similarity.tanimoto(c("a"), c("m"))).collect()


def test_weighted_search(spark):
    d = spark.createDataFrame([(100, 1, 2), (100, 3, 1), (100, 2, -1), (7, 1, 1), (7, 3, 1), (7, 5, 2)], "reaction_id long, token long, delta long")
    (q, r, wj, cos), = similarity.weighted_search(d).collect()
    assert (q, r) == (100, 7) and math.isclose(wj, 2 / 6) and math.isclose(cos, 3 / 6)


@pytest.mark.parametrize("lanes", [False, True])
def test_weighted_search_with_a_token_in_every_row(spark, monkeypatch, lanes):
    if lanes:
        monkeypatch.setattr(session.join_lanes, "__defaults__", (20,))
    rnd = random.Random(4)
    rows = [(r, t, rnd.choice([-3, -1, 1, 2])) for r in range(0, 900, 3) for t in {0, *rnd.sample(range(1, 40), 3)}]
    held = {}
    for r, t, d in rows:
        held.setdefault(r, {})[t] = d
    df = similarity.weighted_search(spark.createDataFrame([*rows, (5, None, 2), (6, 1, 0)], "reaction_id long, token long, delta long"))
    got = {(r.query_id, r.reaction_id): (r.weighted_jaccard, r.cosine) for r in df.collect()}
    assert set(got) == {(q, r) for q in held if q % 100 == 0 for r in held if r != q}
    for (q, r), (wj, cos) in got.items():
        a, b = held[q], held[r]
        low = sum(min(abs(a[t]), abs(b[t])) for t in a if t in b and a[t] * b[t] > 0)
        high = sum(map(abs, a.values())) + sum(map(abs, b.values())) - low
        dot = sum(a[t] * b[t] for t in a if t in b)
        assert math.isclose(wj, low / high) and math.isclose(cos, dot / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())))


@pytest.mark.parametrize("rows", [50_000, 40])
def test_grid_searches_equal_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(similarity, "GRID_ROWS", rows)
    monkeypatch.setattr(similarity, "GRID_QUERIES", rows)
    rnd = random.Random(2)
    sig = {r: [rnd.randrange(3) for _ in range(8)] for r in range(0, 1500, 5)}
    df = spark.createDataFrame([*sig.items(), (None, [1] * 8), (7, None)], "reaction_id long, v array<long>")
    share = lambda a, b: sum(x == y for x, y in zip(a, b)) / len(a)
    got = [tuple(r) for r in similarity.grid_search(df, "v", similarity.equal_scores, "jaccard").collect()]
    want = []
    for q in (r for r in sig if r % 100 == 0):
        want += [(q, r, s, k) for k, (s, r) in enumerate([(-s, r) for s, r in sorted((-share(sig[q], sig[r]), r) for r in sig if r != q)[:5]], 1)]
    assert sorted(got) == sorted((q, r, s, k) for q, r, s, k in want)
    bits = spark.createDataFrame([(r, b) for r, v in sig.items() for b in {i * 3 + x for i, x in enumerate(v[:2])}], "reaction_id long, bit int")
    sets = {r: {i * 3 + x for i, x in enumerate(v[:2])} for r, v in sig.items()}
    got = sorted((r.query_id, r.reaction_id, r.tanimoto) for r in similarity.bit_search(bits).collect())
    want = []
    for q in (r for r in sets if r % 100 == 0):
        want += [(q, r, -s) for s, r in sorted((-len(sets[q] & sets[r]) / len(sets[q] | sets[r]), r) for r in sets if r != q and sets[q] & sets[r])[:5]]
    assert got == sorted(want)
    signs = spark.createDataFrame([(r, [1 if x else -1 for x in v]) for r, v in sig.items()], "reaction_id long, v array<int>")
    assert all(math.isclose(r.cosine, 2 * share([bool(x) for x in sig[r.query_id]], [bool(x) for x in sig[r.reaction_id]]) - 1) for r in similarity.grid_search(signs, "v", similarity.sign_scores, "cosine").collect())


def test_searches_empty(spark):
    none = spark.createDataFrame([], "reaction_id long, token long, delta long")
    assert similarity.weighted_search(none).count() == 0 and similarity.bit_search(spark.createDataFrame([], "reaction_id long, bit int")).count() == 0


def test_weights_do_not_make_rows(spark):
    w = spark.createDataFrame([(1, 7, 1e6, 0.0), (1, 8, 1e6, 0.0), (2, 7, 0.5, 0.0), (2, 8, 0.5, 0.0), (3, 7, 0.0, 2.5), (4, 9, 0.0, 0.0)], "reaction_id long, token long, pos double, neg double")
    sig = {r[0]: r[1] for r in sketches.weighted_minhash(w, 64).collect()}
    assert sig[1] == sig[2] and set(sig) == {1, 2, 3} and all(len(x) == 64 for x in sig.values())
    assert sig[1] != {r[0]: r[1] for r in sketches.weighted_minhash(w, 64, normalize=False).collect()}[1]


def test_dense_over_given_places(spark):
    d = spark.createDataFrame([(1, 10, 2), (1, 30, -6), (2, 20, 1)], "reaction_id long, token long, delta long")
    places = spark.createDataFrame([(10, 0), (20, 1), (30, 2)], "token long, place int")
    assert rows(multiset.dense_over(d, places, 3)) == [(1, [2.0, 0.0, -6.0]), (2, [0.0, 1.0, 0.0])]
    assert rows(multiset.dense_over(d, places, 3, 2, True)) == [(1, [0.25, 0.0, 0.0, 0.0, 0.0, 0.75]), (2, [0.0, 1.0, 0.0, 0.0, 0.0, 0.0])]
    with pytest.raises(Exception, match="no place for token 30"):
        multiset.dense_over(d, places.where("token < 30"), 3).collect()


def test_flat(spark):
    assert spark.createDataFrame([([[1, 2], [3]],)], "x array<array<int>>").select(sketches.flat(F.col("x"))).first()[0] == [1, 2, 3]


def test_exchange_hash():
    assert exchange_hash("('a', 1)") != exchange_hash("('a', 1.0)") and exchange_hash("x", 1) != exchange_hash("x") and exchange_hash("x", person=b"other") != exchange_hash("x")
    assert 0 <= exchange_hash("x") < 2**64


def test_hash_columns(spark):
    assert spark.createDataFrame([("abc",)], "s string").select(token_hash(F.col("s"))).first()[0] == 648541476951500027


def test_exchange_hashes_by_batch(spark):
    df = spark.createDataFrame([("('a', 1)",), (None,)], "s string")
    assert [r[0] if r[0] is None else int(r[0]) for r in df.select(exchange_hashes(F.col("s"), 3)).collect()] == [exchange_hash("('a', 1)", 3), None]


@pytest.mark.parametrize("normalize", [False, True])
def test_pairs_of_weighted_search_are_not_shuffled(spark, monkeypatch, normalize):
    for name, value in (("GRID_ROWS", 40), ("GRID_QUERIES", 1), ("SLICE_ROWS", 7)):
        monkeypatch.setattr(similarity, name, value)
    rnd = random.Random(6)
    held = {r: {t: rnd.choice([-3, -1, 1, 2]) * (1 + 10**9 * (t == 9 and not normalize)) for t in rnd.sample(range(12), 3)} for r in range(0, 800, 4)}
    rows = [(r, t, d) for r, w in held.items() for t, d in w.items()]
    found = similarity.weighted_search(spark.createDataFrame(rows, "reaction_id long, token long, delta long").where("abs(delta) < 100 or reaction_id < 150"), normalize=normalize)
    # Only reactions are exchanged, a row for each and each block it meets.
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 1
    held = {r: {t: d for t, d in w.items() if abs(d) < 100 or r < 150} for r, w in held.items()}
    got = {(r.query_id, r.reaction_id): (r.weighted_jaccard, r.cosine) for r in found.collect()}
    assert set(got) == {(q, r) for q in held if q % 100 == 0 for r in held if r != q and set(held[q]) & set(held[r])}
    for (q, r), (wj, cos) in got.items():
        a, b = held[q], held[r]
        la, lb = (sum(map(abs, w.values())) if normalize else 1 for w in (a, b))
        low = sum(min(abs(a[t]) * lb, abs(b[t]) * la) for t in a if t in b and a[t] * b[t] > 0)
        both = 2 * la * lb if normalize else sum(map(abs, a.values())) + sum(map(abs, b.values()))
        assert wj == low / (both - low)
        assert math.isclose(cos, sum(a[t] * b[t] for t in a if t in b) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())))


@pytest.mark.parametrize("name", ["weighted_search", "weighted_search_normalized"])
def test_weighted_search_packs_behind_one_shuffle(spark, monkeypatch, tmp_path, name):
    rows = [(r, s, t, 1 + (t + r) % 3, 0, 1) for r in range(0, 300, 20) for s in "RP" for t in range(r % 7, 12)]
    rows = spark.createDataFrame([*rows, rows[0], (None, "R", 1, 1, 0, 1)], "reaction_id long, side string, token long, cnt long, chunk int, loaded_at long")
    rows.write.parquet(f"{tmp_path}/tokens.parquet")
    plans = []
    monkeypatch.setattr(similarity, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    queries()[name](spark, str(tmp_path))
    assert plans[0].count("Exchange hashpartitioning") == 1


def test_rows_of_weighted_search_are_copied_for_as_few_queries_as_a_task_can_hold(spark, monkeypatch):
    copies = []
    monkeypatch.setattr(similarity, "_blocks", lambda rows, total, *a, f=similarity._blocks: copies.append([x.count() for x in f(rows, 800_000, *a)]) or f(rows, total, *a))
    deltas = spark.createDataFrame([(r, 1, 1) for r in range(0, 500, 50)], "reaction_id long, token long, delta long")
    assert similarity.weighted_search(deltas, normalize=True).count() == 5 * 9
    # Five queries for each of 16 blocks of rows at least; each row once.
    assert copies[0][0] >= 5 * 16 and copies[0][1] == 10


def test_queries_of_a_block_are_taken_in_slices(spark, monkeypatch):
    rows = spark.createDataFrame([(r, t, 1 + (r + t) % 4) for r in range(0, 900, 25) for t in range(r % 4, 6)], "reaction_id long, token long, delta long")
    whole = sorted(similarity.weighted_search(rows, normalize=True).collect())
    monkeypatch.setattr(similarity, "GRID_QUERIES", 2)
    assert whole and sorted(similarity.weighted_search(rows, normalize=True).collect()) == whole
