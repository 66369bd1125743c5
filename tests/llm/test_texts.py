"""Packing, mixing and subjects: invariants, brute force on small cases, held-out labels."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from molweave.llm import mixing, packing, subjects
from molweave.llm.sizes import CAPACITY

DOCS = "doc_id long, text string, lang string, source string"
TARGETS = "source string, target_share double, max_repeats int"


def spread(slots):
    bins = {}
    for s, first, n, each, start in slots:
        for k in range(n):
            bins.setdefault(start + k // each, []).append(s)
    return bins


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=80))
def test_plan_holds_every_item_once(sizes):
    census = {s: sizes.count(s) for s in set(sizes)}
    slots, n = packing.plan_bins(census, 60)
    bins = spread(slots)
    assert sorted(itertools.chain(*bins.values())) == sorted(sizes) and set(bins) == set(range(n))
    assert all(sum(b) <= 60 and sum(3 * s > 60 for s in b) <= 2 for b in bins.values())
    # no worse than first-fit decreasing by more than its known distance to the optimum
    assert n <= 11 / 9 * -(-sum(sizes) // 60) + 0.5 * sum(2 * s > 60 for s in sizes) + 2


def test_plan_rejects_bad_sizes():
    with pytest.raises(ValueError):
        packing.plan_bins({61: 1}, 60)


def test_assign(spark):
    rnd = random.Random(2)
    rows = [(i, "ä" * rnd.randint(1, 1500), None, "s") for i in range(300)]
    rows += [(1000, "x" * 10_000, None, None), (1001, "x" * (CAPACITY - 1), None, None), (1002, "x" * CAPACITY, None, None), (1003, None, None, None), (1004, " \t ", None, None), (1005, "", None, None)]
    rows += [(2000 + i, "same", None, "s") for i in range(400)]
    df = spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "container")
    got = packing.assign(df).collect()
    want = sum(len(t.encode()) + 1 for _, t, *_ in rows if t and t.strip())
    assert sum(r["size"] for r in got) == want and len({(r.doc_id, r.piece) for r in got}) == len(got)
    load = {}
    for r in got:
        load[r.container] = load.get(r.container, 0) + r["size"]
    assert max(load.values()) <= CAPACITY and sorted(load) == list(range(len(load)))
    assert [r.doc_id for r in packing.split_documents(packing.assign(df)).orderBy("doc_id").collect()] == [1000, 1002]
    report = packing.report(packing.assign(df)).first()
    assert report.containers == len(load) and report.used == want and report.unused_share < 0.03 and report.containers <= report.least_containers + 1


def test_ranks_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK_ROWS", 20)
    df = spark.createDataFrame([(i, "abc", None, None) for i in range(500)], DOCS)
    load = {}
    for r in packing.assign(df, 40).collect():
        load[r.container] = load.get(r.container, 0) + r["size"]
    assert len(load) == 50 and set(load.values()) == {40}


def test_packing_empty(spark):
    none = spark.createDataFrame([], DOCS)
    assert packing.assign(none).count() == 0 and packing.report(packing.assign(none)).first().containers == 0


def test_flow_fills_quotas_and_spreads_repeats():
    # a shared pattern can serve both sources; only what is missing comes from repeats
    amounts = {("a", "a"): 100, ("b", "b"): 100, ("a\tb", "a"): 50, ("a\tb", "b"): 50}
    flow = mixing.route(amounts, {"a": 100, "b": 100, "a\tb": 50}, {"a": 120, "b": 260}, {"a": 3, "b": 2})
    assert flow["a", "a"] + flow["a\tb", "a"] == 120 and flow["b", "b"] + flow["a\tb", "b"] == 260
    assert flow["b", "b"] <= 200 and flow["a\tb", "b"] <= 100
    short = mixing.route({("a", "a"): 10}, {"a": 10}, {"a": 100, "z": 5}, {"a": 2, "z": 4})
    assert short == {("a", "a"): 20}


def brute_cost(amounts, texts, quotas, repeats):
    """Least cost of a full flow by trying all whole splits of small networks."""
    keys = sorted(amounts)
    best = None
    for split in itertools.product(*[range(amounts[k] * repeats[k[1]] + 1) for k in keys]):
        if any(sum(f for k, f in zip(keys, split) if k[1] == s) != q for s, q in quotas.items()):
            continue
        cost = 0
        for k, f in zip(keys, split):
            cost += sum(min(amounts[k], f - r * amounts[k]) * (2 * r + 1) for r in range(repeats[k[1]]) if f > r * amounts[k])
        for p, size in texts.items():
            f = sum(x for k, x in zip(keys, split) if k[0] == p)
            r = 0
            while f > 0:
                cost += min(size, f) * (2 * r + 1)
                f, r = f - size, r + 1
        best = cost if best is None else min(best, cost)
    return best


def test_flow_cost_is_least():
    rnd = random.Random(5)
    for _ in range(12):
        amounts = {("a", "a"): rnd.randint(1, 4), ("b", "b"): rnd.randint(1, 4), ("a\tb", "a"): 2, ("a\tb", "b"): 2}
        texts, repeats = {"a": amounts["a", "a"], "b": amounts["b", "b"], "a\tb": 2}, {"a": 2, "b": 2}
        quotas = {"a": rnd.randint(1, 2 * amounts["a", "a"] + 2), "b": rnd.randint(1, 2 * amounts["b", "b"] + 2)}
        flow = mixing.route(amounts, texts, quotas, repeats)
        exact = {k: {k2: f for k2, f in flow.items()} for k in ("x",)}["x"]
        cost = 0
        for k, f in exact.items():
            cost += sum(min(amounts[k], f - r * amounts[k]) * (2 * r + 1) for r in range(2) if f > r * amounts[k])
        for p, size in texts.items():
            f, r = sum(x for k, x in exact.items() if k[0] == p), 0
            while f > 0:
                cost += min(size, f) * (2 * r + 1)
                f, r = f - size, r + 1
        assert cost == brute_cost(amounts, texts, quotas, repeats)


def test_mix(spark):
    rnd = random.Random(3)
    rows = [(i, "x" * rnd.randint(20, 300) + str(i), None, rnd.choice([" Big", "BIG\t", "big"])) for i in range(400)]
    rows += [(1000 + i, f"small {i}" * 5, None, "small") for i in range(10)] + [(2000, "shared text", None, "big"), (2001, "shared text", None, "small")]
    rows += [(3000, "lost", None, "unknown"), (3001, "lost", None, None), (3002, None, None, "big"), (3003, "  ", None, "big")]
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.2, 2), ("absent", 0.1, 5)], TARGETS)
    docs = spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "uses")
    got = {r.doc_id: r for r in mixing.mix(docs, targets).collect()}
    assert all(r.uses <= {"big": 1, "small": 2}[r.source] for r in got.values())
    assert {3000, 3001, 3002, 3003}.isdisjoint(got) and all(got[1000 + i].uses == 2 for i in range(10))
    assert sorted(r.source for r in mixing.short_sources(docs, targets).collect()) == ["absent", "small"]
    shares = {r.source: r for r in mixing.shares(docs, targets).collect()}
    total = sum(len(t.encode()) + 1 for _, t, _, s in rows if t and t.strip() and s and s.strip().lower() in ("big", "small"))
    assert abs(shares["big"].used - 0.7 * total) < 400 and shares["absent"].used == 0
    assert abs(sum(s.actual_share for s in shares.values()) - 1) < 1e-9
    again = {r.doc_id: r.uses for r in mixing.mix(docs, targets).collect()}
    assert again == {k: r.uses for k, r in got.items()}


def test_rare_patterns_count_as_not_shared(spark, monkeypatch):
    rows = [(i, f"text {i // 3}", None, "abc"[i % 3]) for i in range(60)] + [(100 + i, f"pair {i // 2}", None, "ab"[i % 2]) for i in range(80)]
    targets = spark.createDataFrame([("a", 0.4, 2), ("b", 0.4, 2), ("c", 0.2, 2)], TARGETS)
    docs = spark.createDataFrame(rows, DOCS)
    monkeypatch.setattr(mixing, "MOST_PATTERNS", 1)
    made = mixing._documents(docs, targets)
    assert {r.pattern for r in made.select("pattern").distinct().collect()} == {"a\tb", "a", "b", "c"} and made.count() == 140
    total = made.agg({"size": "sum"}).first()[0]
    used = {r.source: r.used for r in mixing.shares(docs, targets).collect()}
    assert all(abs(used[s] - x * total) < 20 for s, x in (("a", 0.4), ("b", 0.4), ("c", 0.2)))


def test_all_patterns_are_told_apart(spark):
    names = "abcdefghijkl"
    patterns = [p for n in range(2, 7) for p in itertools.combinations(names, n)]
    rows = [(i * 12 + k, f"text {i}", None, s) for i, p in enumerate(patterns) for k, s in enumerate(p)]
    targets = spark.createDataFrame([(s, 1 / 12, 2) for s in names], TARGETS)
    docs = mixing._documents(spark.createDataFrame(rows, DOCS), targets)
    assert len(patterns) > 2_000 and {r.pattern for r in docs.select("pattern").distinct().collect()} == {"\t".join(p) for p in patterns}
    plan, flow = mixing._plan(docs, targets)
    assert not any(r["short"] for r in plan) and len(flow) == len(rows)


def test_mix_empty(spark):
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    none = spark.createDataFrame([], DOCS)
    assert mixing.mix(none, targets).count() == 0 and mixing.short_sources(none, targets).count() == 0
    assert mixing.shares(none, targets).first().actual_share == 0.0


STARTS = frozenset(["the", "am", "both"])


def test_sentences():
    got = subjects.split_sentences("<p>Run 7 differed only in reflux.</p><p>- the ester was isolated The table on sheet 3 is new.</p>\n- das Diol fiel aus Am Tag 3 ging es um X.", STARTS)
    assert got == ["run differed only in reflux", "the ester was isolated", "the table on sheet is new", "das diol fiel aus", "am tag ging es um x"]
    assert subjects.split_sentences("String: CC(C)O&gt;&gt;CC=O. Next one!") == ["string rxnstring", "next one"] and subjects.split_sentences("12 34.") == []
    assert subjects.split_sentences("As recorded: CC(C) → C[C@H]O Both the cells failed.")[-1] == "both the cells failed"
    assert subjects.split_sentences(f"<img alt='{'x' * 500}' src=a>One.<br/>Two <b>three</b>. If a <b c or d> e") == ["one", "two", "three", "if a", "e"]
    assert subjects.split_sentences(f"<p class='{'x' * 500}' id=a hidden>One.<br/>Two") == ["one", "two"]
    for text in ("x" * 1_000_000, " " * 1_000_000, "<" * 300_000, "<a " * 300_000, "<a b=" * 100_000, "- a " * 200_000, "a. " * 200_000, "=" * 1_000_000):
        subjects.split_sentences(text, STARTS)


def test_openers(spark):
    texts = ["Das Diol fiel aus. Das Salz blieb. Ein Diol ging.", "Am Tag 3 fiel das Diol aus. Am Ende war das Salz da.", "- das Salz Am Tag 4", "SHOUTED TEXT. SHOUTED AGAIN."] * 5
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert subjects.openers(df) == {"das", "am", "ein"}


def test_languages_are_found(rng=7):
    rnd = random.Random(rng)
    frequent = {lang: [f"{lang}{i}" for i in range(12)] for lang in "uvwxy"}
    words = sorted(w for v in frequent.values() for w in v) + [f"topic{i}" for i in range(200)]
    number = {w: i for i, w in enumerate(words)}
    said = [rnd.choice("uuuuvvwxy") for _ in range(600)]
    docs = [sorted({number[w] for w in rnd.sample(frequent[lang], 9)} | {number[f"topic{rnd.randrange(200)}"] for _ in range(12)}) for lang in said]
    marks = subjects.Space.frequent(docs)
    centres = subjects.languages(marks)
    spoken = (marks @ centres.T).argmax(1)
    assert len(centres) == 5 and len({(a, b) for a, b in zip(said, spoken)}) == 5


def test_centres_are_those_of_all_documents(spark, monkeypatch):
    """A collection far larger than the draw; one document in 30 is written in a rare language, of several leaves."""
    monkeypatch.setattr(subjects, "SAMPLE", 200)
    rnd = random.Random(4)
    said = ["rare" if i % 30 == 7 else "often" for i in range(3000)]
    parts = {lang: [[f"{lang}{part}x{i}" for i in range(15)] for part in range(2)] for lang in ("rare", "often")}
    docs = [sorted({*rnd.sample([f"{lang}{i}" for i in range(12)], 9), *rnd.sample(rnd.choice(parts[lang]), 8)}) for lang in said]
    words = [w for w, _ in subjects.Counter(w for d in docs for w in d).most_common()]
    number = {w: i for i, w in enumerate(words)}
    packs = [(list(range(a, a + 100)), subjects.zlib.compress(subjects.APART_SIGN.join(" ".join(d) for d in docs[a : a + 100]).encode())) for a in range(0, 3000, 100)]
    coded = spark.createDataFrame(packs, subjects.PACKS).mapInArrow(subjects._coded(number), subjects.CODED)
    space = subjects.Space(words, subjects.np.array([sum(w in d for d in docs) for w in words]), 3000)
    for bound in (subjects.HELD_SUMS, 0):
        monkeypatch.setattr(subjects, "HELD_SUMS", bound)
        leaves = subjects.fitted(coded, space, 3000, 1)
        leaf, x, _ = leaves.by_leaf([[number[w] for w in d] for d in docs])
        spoken = subjects.np.array(leaves.language_of)[leaf]
        assert len(set(zip(said, spoken))) == 2
        # The rare language has 100 documents, fewer than LEAF_ROWS of them in the first draw: too few to be a language there.
        assert [len(c) for c in leaves.centres] == [8, 8]
        near = [float(c @ subjects.unit(x[leaf == i].sum(0)[None])[0]) for i, c in enumerate(subjects.np.concatenate(leaves.centres))]
        assert min(near) > 0.995
        got = {r.group: r.n for r in coded.mapInArrow(subjects._group_sums(leaves.by_leaf, 16, subjects.DIMENSIONS), subjects.SUMS).groupBy("group").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
        assert got == dict(subjects.Counter(leaf.tolist()))


def test_subjects(spark):
    """Three languages, three subjects, labels of a tenth of the documents, some of them wrong."""
    rnd = random.Random(7)
    words = {
        1: (["ester", "amide", "lactam", "enone"], ["distilled", "washed", "isolated"]),
        2: (["parser", "compiler", "cache", "module"], ["crashed", "merged", "profiled"]),
        3: (["goalkeeper", "sprinter", "relay", "coach"], ["scored", "won", "equalised"]),
    }
    german = {s: ([w[::-1] for w in a], [w[::-1] for w in b]) for s, (a, b) in words.items()}
    invented = {s: ([f"za{w[::-1]}" for w in b], [f"qu{w[::-1]}" for w in a]) for s, (a, b) in words.items()}
    filler = ["This note replaces number {}.", "See entry {} for details."]
    rows, truth, labels = [], {}, []
    for i in range(1200):
        # The third language is invented: none of its words can be known.
        table, say = [(german, "Das {} wurde am Tag {} und der Rest ging um {}."), (words, "Once the {} was {}, it came up again in run {}."), (words, "Once the {} was {}, and this came up again in run {}."), (invented, "Ku {} vel {} ra omi nat shu {} el.")][i % 4]
        mine = rnd.choice([[1], [2], [3], [1, 2], [2, 3]])
        said = [rnd.choice(mine) for _ in range(rnd.randint(3, 9))]
        body = [say.format(rnd.choice(table[s][0]), rnd.choice(table[s][1]), rnd.randint(1, 99)) for s in said]
        if i % 4 in (1, 2):
            body.insert(rnd.randint(0, len(body)), rnd.choice(filler).format(rnd.randint(1, 99)))
        rows.append((i, " ".join(body), None, None))
        truth[i] = {s for s in set(said) if 4 * said.count(s) >= len(said)}
        if rnd.random() < 0.17:
            labels.append((i, rnd.choice(sorted(truth[i])) if rnd.random() > 0.1 else rnd.randint(1, 3), "r"))
    rows += [(9000, None, None, None), (9001, "   ", None, None), (9002, "This note replaces number 5.", None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "leaf")
    names = spark.createDataFrame([(1, "synthesis", "making molecules"), (2, "software", "programs"), (3, "sport", None)], "subject_id long, subject string, scope string")
    found = {}
    marks = spark.createDataFrame([*labels, *labels[:3], (77777, 1, "r"), (1, 99, "r"), (None, None, None)], "doc_id long, subject_id long, rater string")
    for r in subjects.assigned_subjects(docs, marks, names).collect():
        found.setdefault(r.doc_id, set()).add(r.subject_id)
    want, have = ({(d, s) for d, v in x.items() for s in v} for x in (truth, found))
    both = len(want & have)
    assert both / len(want) > 0.95 and both / len(have) > 0.95
    assert {9000, 9001}.isdisjoint(found)


def test_subjects_empty(spark):
    labels = spark.createDataFrame([], "doc_id long, subject_id long, rater string")
    names = spark.createDataFrame([(1, "a", "b")], "subject_id long, subject string, scope string")
    assert subjects.assigned_subjects(spark.createDataFrame([], DOCS), labels, names).count() == 0
    assert subjects.makeup(spark.createDataFrame([], DOCS), labels, names).first().documents == 0
    one = spark.createDataFrame([(1, "x y z. " * 5, None, None), (2, None, None, None)], DOCS)
    assert subjects.assigned_subjects(one, labels, names.limit(0)).count() == 0


def test_term_mixtures(spark, monkeypatch):
    rows = [("1der", 0, 500), ("1ofen", 0, 3), ("1ofen", 1, 1), ("1selten", 0, 3), ("1rot", -1, 7), ("1rot", 1, 1)]
    counts = spark.createDataFrame(rows, "key string, leaf int, n long")
    mix = np.array([[0.75, 0.25], [0.0, 1.0]])
    terms, by = subjects.term_mixtures(counts, mix)
    assert terms == ["1der", "1ofen", "1rot"] and by.tolist() == [[375, 125, 0], [2.25, 1.75, 0], [0, 1, 7]]
    monkeypatch.setattr(subjects, "FREQUENT_TERMS", 2)
    assert subjects.term_mixtures(counts, mix)[0] == ["1der", "1rot"]


def test_mixed_leaves_are_unmixed():
    """Terms of three subjects in leaves of one or two subjects; the first guess knows half of the pure leaves."""
    rng = np.random.default_rng(4)
    rates = np.kron(np.eye(3), np.full((10, 1), 0.1))
    true = np.array([[1, 0, 0], [0, 1, 0], [0, 0, 1], [0.5, 0.5, 0], [0.3, 0, 0.7], [0, 0.6, 0.4], [1, 0, 0], [0, 1, 0]])
    held = rng.poisson(rates @ true.T * 2000).astype(float)
    first = np.where(np.arange(8)[:, None] < 3, true * 0.9 + 0.033, 1 / 3)
    mix, counts = subjects.unmixed(held, held @ first, first)
    assert np.abs(mix - true).max() < 0.15 and (counts.argmax(1) == np.repeat(np.arange(3), 10)).all()


def packs_of(spark, docs):
    rows = [([d], subjects.zlib.compress("\n".join(said).encode()), [leaf]) for d, (leaf, said) in enumerate(docs)]
    return spark.createDataFrame(rows, subjects.PACKS + ", leaves array<int>")


def test_long_and_rarer_wordings_can_be_fillers(spark, monkeypatch):
    monkeypatch.setattr(subjects, "FREQUENT_WORDINGS", 30)
    long, rare, own = ("wir danken " * 40).strip(), "ohne gewähr", "nur hier"
    docs = [(leaf, [long] * 30 + [rare] * 5 + [own] * 200 * (leaf == 3) + [f"satz {leaf}"] * 300) for leaf in range(8)]
    packs = packs_of(spark, docs)
    found = subjects.filler_wordings(subjects._summed(packs, subjects._wordings, "long"), [0] * 8, 4)
    assert found == {subjects.wording(long), subjects.wording(rare)}
    terms = {(r.key, r.leaf): r.n for r in subjects._summed(packs, subjects._leaf_terms([0] * 8, found)).collect()}
    assert terms["0gewähr", -1] == 40 and terms["0satz 3" if ("0satz 3", 3) in terms else "0satz", 3] == 300 and ("0gewähr", 3) not in terms


def test_packs_keep_every_document(spark, monkeypatch):
    monkeypatch.setattr(subjects, "PACK_DOCUMENTS", 3)
    monkeypatch.setattr(subjects, "PACK_LETTERS", 50)
    texts = [(i, "Ab cd. " * i) for i in range(40)] + [(90, "12."), (91, "x" * 500)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {}
    for r in df.mapInArrow(subjects._packed(frozenset()), subjects.PACKS).collect():
        got |= dict(zip(r.ids, next(subjects.unpacked([pa.scalar(bytes(r.pack), pa.binary())]))))
    assert got == {i: ["ab cd"] * i for i in range(40)} | {90: [], 91: ["x" * 500]}


def test_single_document(spark):
    docs = spark.createDataFrame([(1, "The flask was heated gently. " * 6), (2, " ")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 7, 1), (1, 7, 2)], "doc_id long, subject_id long, rater long")
    names = spark.createDataFrame([(7, "Heating", "flasks"), (8, "Cooling", "ice")], "subject_id long, subject string, scope string")
    got = [(r.doc_id, r.subject_id, r.share) for r in subjects.assigned_subjects(docs, labels, names).collect()]
    assert got == [(1, 7, 1.0)]
