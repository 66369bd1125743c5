import itertools

from hypothesis import given, settings
from hypothesis import strategies as st

from molweave.operators import canonical
from molweave.operators.canonical import canonical_form, orbits, whole_form


@st.composite
def graphs(draw):
    n = draw(st.integers(1, 6))
    labels = {i: draw(st.sampled_from("CO")) for i in range(n)}
    pairs = [p for p in itertools.combinations(range(n), 2)]
    links = {p: draw(st.sampled_from("12")) for p in pairs if draw(st.booleans())}
    return labels, links


def renamed(labels, links, order):
    return {order[n]: x for n, x in labels.items()}, {tuple(sorted((order[u], order[v]))): x for (u, v), x in links.items()}


@settings(max_examples=80, deadline=None)
@given(graphs(), st.randoms())
def test_form_does_not_depend_on_numbers(g, rnd):
    order = list(range(10, 10 + len(g[0])))
    rnd.shuffle(order)
    assert canonical_form(*g)[0] == canonical_form(*renamed(*g, order))[0]


@settings(max_examples=60, deadline=None)
@given(graphs(), graphs())
def test_equal_forms_mean_isomorphic(a, b):
    isomorphic = len(a[0]) == len(b[0]) and any(renamed(*a, p) == b for p in itertools.permutations(range(len(a[0]))))
    assert (canonical_form(*a)[0] == canonical_form(*b)[0]) == isomorphic


def test_orbits_and_depth():
    star = {i: "C" for i in range(4)}, {(0, i): "1" for i in (1, 2, 3)}
    assert orbits(*star) == [[0], [1, 2, 3]]
    assert canonical_form(*star, max_depth=0)[1][0] in star[0] and canonical_form({}, {})[0] == "||"


def test_many_equal_parts_are_fast():
    labels = {i: "C" for i in range(60)}
    links = {(i, i + 1): "1" for i in range(60) if i % 3 < 2}
    other = {i: "C" for i in range(100, 160)}
    assert whole_form(labels, links) == whole_form(other, {(u + 100, v + 100): x for (u, v), x in links.items()})
    assert whole_form(labels, links) != whole_form(labels, links | {(2, 3): "1"})


def cage(n):
    """A prism over a ring of n nodes: every node is like every other."""
    return {i: "" for i in range(2 * n)}, {tuple(sorted(e)): "" for i in range(n) for e in ((i, (i + 1) % n), (n + i, n + (i + 1) % n), (i, n + i))}


def test_symmetric_graphs_end_soon():
    import time

    labels, links = cage(15)
    began = time.time()
    form = canonical.canonical_search(labels, links)
    assert time.time() - began < 20 and form.complete and form.automorphisms
    for a in form.automorphisms:
        moved = {tuple(sorted((a.get(u, u), a.get(v, v)))) for u, v in links}
        assert moved == set(links)
    mixed = {i: (7 * i + 3) % 30 for i in range(30)}
    other = {tuple(sorted((mixed[u], mixed[v]))): x for (u, v), x in links.items()}
    assert canonical.canonical_form(labels, other)[0] == form.text


def test_relabelled_and_early_stop():
    labels, links = cage(4)
    form = canonical.canonical_search(labels, links)
    again = canonical.canonical_search(*form.relabelled(labels, links))
    assert again.text == form.text and sorted(form.relabelled(labels, links)[0]) == list(range(1, 9))
    assert not canonical.canonical_search(labels, links, max_depth=0).complete
