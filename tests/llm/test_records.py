"""Copies, similar sets and term counts against brute force, with the awkward cases."""

import itertools
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from molweave.llm import copies, setjoin, terms

REACTIONS = "record_id long, reaction_id long, rsmi string"
RESULTS = "reaction_id long, mode string, tokens_r array<long>, tokens_p array<long>, support array<long>"
TEMPLATES = "template_id long, support array<long>"
DELTAS = "reaction_id long, token long, delta long"


def test_copies_of_all_spellings(spark):
    same = ["CCl.O>>CO.Cl", "  O + CcL -> cl ; CO​", '"CCL.O.>>>Cl..CO",', "CCl,O→CO,CL", "O.CCl => Cl.CO", "CCl.O»CO.Cl"]
    other = ["CCl.O.O>>CO.Cl", "CO.Cl>>CCl.O", "C(Cl).O>>CO.Cl", "C1CCOC1>>C1CCOC1", "c1ccoc1>>C1CCOC1", "[Na+].C>>C", "[Na].C>>C", "C[C@H](F)O>>C", "C[C@@H](F)O>>C", "[nH]1cccc1>>C", "[NH]1CCCC1>>C"]
    none = [None, "", "   ", "CCO", "CCO>>", ">>C", "CC>>"]
    texts = same + other + none
    df = spark.createDataFrame([(i + 1, 0, t) for i, t in enumerate(texts)], REACTIONS).withColumnRenamed("reaction_id", "copies")
    assert sorted(map(tuple, copies.copy_pairs(df).collect())) == [(1, i) for i in range(2, len(same) + 1)]
    got = {r.record_id: r.copies for r in copies.collapse(df).collect()}
    assert got == {1: len(same)} | {len(same) + i + 1: 1 for i in range(len(other))}


def test_case_of_bracket_atoms(spark):
    pairs = [("[NA+].C>>C", "[na+].C>>C", True), ("[BH4-]>>C", "[bH4-]>>C", False), ("[Pd]>>C", "[pD]>>C", True), ("[si](C)C>>C", "[SI](C)C>>C", True), ("c1cc(Br)cs1>>C", "c1cc(bR)cs1>>C", True), ("[n+]>>C", "[N+]>>C", False)]
    for a, b, equal in pairs:
        df = spark.createDataFrame([(1, 0, a), (2, 0, b)], REACTIONS)
        assert copies.copy_pairs(df).count() == int(equal), (a, b)


def test_bonds_and_long_brackets_count(spark):
    long = "[" + "H" * 60 + "+"
    pairs = [("C~C>>O", "CC>>O", False), ("C~C>>O", "Cc>>O", False), (f"{long}{'C' * 50}].N>>O", f"N.{long}{'C' * 50}]>>O", True), (f"{long}C]>>O", f"{long[:-1]}.C]>>O", False)]
    pairs += [("[NH3+]+[Cl-]>>O", "[Cl-].[NH3+]>>O", True), ("[Fe++]+C>>O", "C.[Fe++]>>O", True), ("[Fe++].C>>O", "[Fe].C>>O", False), ("[N+C>>O", "C.[N>>O", True), ("C]+O>>N", "O.C]>>N", True)]
    for a, b, equal in pairs:
        df = spark.createDataFrame([(1, 0, a), (2, 0, b)], REACTIONS)
        assert copies.copy_pairs(df).count() == int(equal), (a, b)


def test_strings_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(copies, "BROADCAST_LIMIT", 0)
    rows = copies.digests(spark.createDataFrame([(i, 0, f"C{i % 60}>>O") for i in range(100)], REACTIONS))
    assert rows.columns == ["record_id", "key"] and {len(r.key) for r in rows.collect()} == {16}
    plan = copies.possible_repeats(rows, "key", 100)[0]._jdf.queryExecution().executedPlan().toString()
    assert "canon" not in plan and "rsmi" not in plan


def test_copies_empty_hot_and_long(spark):
    assert copies.copy_pairs(spark.createDataFrame([], REACTIONS)).count() == 0
    assert copies.collapse(spark.createDataFrame([], REACTIONS)).count() == 0
    long = ".".join(["C" * 2000] * 40)
    rows = [(i, 0, f"{long}>>O") for i in range(3)] + [(10 + i, 0, "C>>O") for i in range(500)] + [(1000 + i, 0, f"{'C' * (i % 40 + 2)}>>N{i}") for i in range(1000)]
    df = spark.createDataFrame(rows, REACTIONS).repartition(7)
    got = Counter(r.record_a for r in copies.copy_pairs(df).collect())
    assert got == {0: 2, 10: 499}
    assert copies.collapse(df).count() == 1002


def test_shuffled_filter_gives_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(i, 0, f"C{i % 60}>>O") for i in range(100)], REACTIONS)
    whole = sorted(map(tuple, copies.copy_pairs(df).collect()))
    monkeypatch.setattr(copies, "BROADCAST_LIMIT", 0)
    assert sorted(map(tuple, copies.copy_pairs(df).collect())) == whole and len(whole) == 40


def brute_pairs(results, templates, t):
    out = set()
    for field, at in (("tokens_r", 2), ("tokens_p", 3), ("support", 4)):
        sets = {(r[0], frozenset(x for x in r[at] if x is not None)) for r in results if r[1] == "delta" and r[at] and r[0] is not None}
        for (a, x), (b, y) in itertools.product(sets, sets):
            if a < b and x and y and len(x & y) / len(x | y) >= t:
                out.add((field, a, b))
        if field == "support":
            for (a, x), (b, y) in itertools.product([(i, frozenset(s or [])) for i, s in templates], sets):
                if x and y and len(x & y) / len(x | y) >= t:
                    out.add(("template", a, b))
    return out


@pytest.mark.parametrize(("t", "long_list"), [(0.7, 64), (0.7, 1), (0.5, 1), (0.34, 2), (1.0, 1)])
def test_similar_sets_equal_brute_force(spark, t, long_list, monkeypatch):
    rnd = random.Random(int(t * 100))
    base = [rnd.sample(range(40), rnd.randint(1, 12)) for _ in range(12)]
    rows = []
    for i in range(70):
        x = list(rnd.choice(base))
        if rnd.random() < 0.7:
            x = [v for v in x if rnd.random() > 0.15] + rnd.sample(range(60), rnd.randint(0, 2))
        rows.append((i, "delta", x + x[:1], x if i % 3 else None, [None, *x] if i % 5 else []))
    rows += [rows[0], (200, "union", base[0], base[0], base[0]), (None, "delta", base[0], base[0], base[0]), (201, "delta", None, None, None)]
    templates = [(1, base[0]), (2, base[1]), (3, None), (4, [])]
    monkeypatch.setattr(setjoin.similar_classes, "__defaults__", (t, long_list))
    got = setjoin.similar_pairs(spark.createDataFrame(rows, RESULTS), spark.createDataFrame(templates, TEMPLATES), t)
    found = [(r.field, r.id_a, r.id_b) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == brute_pairs(rows, templates, t)


@pytest.mark.parametrize("small", [True, False])
def test_boilerplate_in_all_sets(spark, monkeypatch, small):
    """Six tokens in every set, so that lists stay long at all levels; classes with many copies."""
    monkeypatch.setattr(setjoin, "LANE_ROWS", 7)
    monkeypatch.setattr(setjoin, "MOST_LISTS", 100_000 if small else 0)
    rnd = random.Random(9)
    rows = []
    for i in range(90):
        x = [*range(6), *rnd.sample(range(100, 112), rnd.randint(0, 2) if small else rnd.randint(1, 5))]
        rows.append((i, "delta", x, [1] if i % 2 else [2, 3, 4], list(range(i % 3, 9))))
    templates = [(1, list(range(9))), (2, [*range(6), 100])]
    monkeypatch.setattr(setjoin.similar_classes, "__defaults__", (0.7, 2))
    found = [(r.field, r.id_a, r.id_b) for r in setjoin.similar_pairs(spark.createDataFrame(rows, RESULTS), spark.createDataFrame(templates, TEMPLATES)).collect()]
    assert len(found) == len(set(found)) and set(found) == brute_pairs(rows, templates, 0.7)


def test_links_count_other_sets_once(spark):
    x = list(range(10))
    rows = [(1, "delta", x, x, x), (2, "delta", x, x, x), (3, "delta", [*x, 11], [50], []), (4, "delta", [99], None, None)]
    got = {(r.field, r.id): (r.class_id, r.copies, r.links) for r in setjoin.linked_records(spark.createDataFrame(rows, RESULTS), spark.createDataFrame([], TEMPLATES)).collect()}
    assert got["tokens_r", 1] == got["tokens_r", 2] == (1, 2, 1) and got["tokens_r", 3] == (3, 1, 1) and got["tokens_r", 4] == (4, 1, 0)
    assert ("support", 3) not in got


def test_sets_empty(spark):
    assert setjoin.similar_pairs(spark.createDataFrame([], RESULTS), spark.createDataFrame([], TEMPLATES)).count() == 0


def test_threshold_is_checked(spark):
    with pytest.raises(ValueError):
        setjoin.similar_classes(spark.createDataFrame([], "family string"), 0.0)


def test_term_counts_equal_brute_force(spark, monkeypatch):
    for name, value in (("ADD_ROWS", 300), ("FLUSH_TERMS", 100), ("CONTAINER", 8)):  # several tries a worker, deep ones
        monkeypatch.setattr(terms, name, value)
    rnd = random.Random(1)
    big = [rnd.randrange(1 << 60) for _ in range(300)] + [-5, -(1 << 62), (1 << 63) - 1]
    results = [(i, "delta" if i % 7 else "union", [rnd.choice(big) if rnd.random() < 0.5 else 5 for _ in range(rnd.randint(1, 30))], [1], [1]) for i in range(200)]
    results += results[:20] + [(500, "delta", None, None, None), (501, "delta", [], [], []), (None, "delta", [7], [7], [7]), (502, "delta", [None, 9], [], [])]
    deltas = [(i % 50, rnd.choice(big[:40]), rnd.randint(-2, 2)) for i in range(300)]
    deltas = list({(r, t): (r, t, d) for r, t, d in deltas}.values())
    deltas += deltas[:30] + [(None, 1, 1), (1, None, 1), (1, 1, None)]
    occurrences, held = defaultdict(int), defaultdict(set)
    for r, _, xs, *_ in {(r[0], tuple(r[2] or [])): r for r in results}.values():
        for t, n in Counter(x for x in xs or [] if x is not None and r is not None).items():
            occurrences["tokens_r", t] += n
            held["tokens_r", t].add(r)
    for r, t, d in set(deltas):
        if r is not None and t is not None and d:
            occurrences["delta", t] += abs(d)
            held["delta", t].add(r)
    of = {f: len(set().union(*[v for (g, _), v in held.items() if g == f])) for f in ("tokens_r", "delta")}
    got = {(r.field, r.token): (r.occurrences, r.records, r.mark) for r in terms.term_counts(spark.createDataFrame(results, RESULTS), spark.createDataFrame(deltas, DELTAS)).collect()}
    mark = lambda f, n: "rare" if n == 1 else "common" if n > 0.1 * of[f] else None
    assert got == {k: (occurrences[k], len(held[k]), mark(k[0], len(held[k]))) for k in held}


def test_terms_empty(spark):
    assert terms.term_counts(spark.createDataFrame([], RESULTS), spark.createDataFrame([], DELTAS)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.integers(0, (1 << 60) - 1), st.integers(0, 40), st.integers(-(1 << 63), (1 << 63) - 1)), min_size=1, max_size=200), st.sampled_from([1, 3, 4096]))
def test_tries_count_every_token(tokens, container):
    import numpy as np
    import pyarrow as pa

    old, terms.CONTAINER = terms.CONTAINER, container
    try:
        batch = pa.record_batch([pa.array(["f"] * len(tokens)), pa.array(tokens, pa.int64()), pa.array([1 << 55] * len(tokens), pa.int64())], ["field", "token", "n"])
        counted = Counter()
        for out in terms._subtries({"f": np.array([0, 1 << 55, 1 << 58])})(iter([batch])):
            merged = terms._merge(pa.Table.from_batches([out]))
            counted.update(dict(zip(merged.column("token").to_pylist(), merged.column("records").to_pylist())))
            assert all(n == r << 55 for n, r in zip(merged.column("occurrences").to_pylist(), merged.column("records").to_pylist()) if r < 100)
        assert counted == Counter(tokens)
    finally:
        terms.CONTAINER = old


def test_containers_burst(monkeypatch):
    import numpy as np

    monkeypatch.setattr(terms, "CONTAINER", 50)
    trie, rnd = terms.BurstTrie(), random.Random(3)
    want = Counter()
    for _ in range(20):
        new = sorted({rnd.choice([rnd.randrange(300), rnd.randrange(1 << 60), rnd.randrange(1 << 20)]) for _ in range(100)})
        trie.add(np.array(new), np.full(len(new), 2), np.ones(len(new), np.int64))
        want.update(new)
    parts = list(trie.containers())
    tokens = np.concatenate([p[0] for p in parts])
    assert (np.diff(tokens) > 0).all() and dict(zip(tokens.tolist(), np.concatenate([p[2] for p in parts]).tolist())) == want
    assert max(len(p[0]) for p in parts) <= 50 and trie.terms == len(want) and max(d for d, _ in trie.inner) >= 12


def test_long_awkward_strings(spark):
    texts = ["-" * 200_000, ">" * 100_000, "C" * 50_000 + ">" * 50_000 + "O", "[" * 100_000, "=>" * 50_000, "+" * 100_000 + "C>>O" + "." * 100_000, "c" * 100_000 + ">>O", "C>>O"]
    got = copies.copy_pairs(spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], REACTIONS)).collect()
    assert [tuple(r) for r in got] == [(5, 7)]


def test_routes_burst_below_the_census(spark):
    tokens = [*range(3000), *(k << 50 for k in range(1, 100))]
    rows = spark.createDataFrame([("delta", t) for t in tokens], "field string, token long")
    starts = terms.routes(rows, 4)["delta"].tolist()
    assert starts == sorted(set(starts)) and starts[0] == 0
    held = [sum(a <= t < b for t in tokens) for a, b in zip(starts, [*starts[1:], 1 << 60])]
    assert sum(held) == len(tokens) and max(held) <= 300
