import pytest

from molweave.model import EDGES, NODES
from molweave.functions.hashing import exchange_hash
from molweave.operators import exchange, graph, tokens
from molweave.sources.tables import from_dicts, from_networkx, from_printout, pair_tables, to_dicts, to_networkx


@pytest.fixture(scope="module")
def named(spark):
    graphs = {
        "two": ({0: {"element": "C", "aromatic": False}, 1: {"element": "O", "aromatic": True}}, {(0, 1): {"order": 2.0}}),
        "loop": ({0: {"element": "X"}}, {(0, 0): {"order": 1.0}}),
        "triangle": ({0: {}, 1: {}, 2: {}}, {(0, 1): {"order": 1}, (1, 2): {"order": 1}, (2, 0): {"order": 1}}),
        "path3": ({0: {}, 1: {}, 2: {}}, {(0, 1): {}, (2, 1): {"foo": "bar"}}),
        "pair": ({0: {}, 1: {}}, {(0, 1): {}}),
    }
    nodes, edges = from_dicts(spark, graphs)
    return nodes.cache(), edges.cache()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_adjacency_and_degree(named):
    nodes, edges = named
    adj = {(r.graph_id, r.node_id): r.neighbours for r in graph.adjacency(edges).collect()}
    assert adj["loop", 0] == [0, 0] and adj["path3", 1] == [0, 2]
    deg = {(r.graph_id, r.node_id): r.degree for r in graph.degrees(nodes, edges).collect()}
    assert deg["loop", 0] == 2 and [deg["path3", i] for i in range(3)] == [1, 2, 1]


def test_edges_are_normalised_and_looked_up(spark, named):
    _, edges = named
    clean = graph.clean_edges(edges)
    assert rows(clean.where("graph_id = 'path3'").select("u", "v")) == [(0, 1), (1, 2)]
    asked = spark.createDataFrame([("two", 1, 0), ("two", 0, 5)], "graph_id string, a long, b long")
    assert rows(graph.edge_between(edges, asked).select("a", "b", "bond_order")) == [(1, 0, 2.0)]


@pytest.mark.parametrize(("kind", "expected"), [("wl", [3, 6]), ("morgan", [3, 6]), ("ego", [3, 6])])
def test_token_totals_on_a_triangle(named, kind, expected):
    nodes, edges = (d.where("graph_id = 'triangle'") for d in named)
    make = {"wl": tokens.wl_tokens, "morgan": tokens.morgan_tokens, "ego": tokens.ego_tokens}[kind]
    assert [sum(r.cnt for r in make(nodes, edges, k).collect()) for k in (0, 1)] == expected


def test_paths_come_from_both_ends(named):
    nodes, edges = (d.where("graph_id = 'triangle'") for d in named)
    assert [sum(r.cnt for r in tokens.path_tokens(nodes, edges, k).collect()) for k in (0, 1, 2)] == [6, 6, 12]
    assert sum(r.cnt for r in tokens.path_tokens(nodes, edges, 2, min_path=2).collect()) == 6


def test_bad_parameters(named):
    with pytest.raises(ValueError):
        tokens.wl_tokens(*named, -1)
    with pytest.raises(ValueError):
        tokens.path_tokens(*named, 2, min_path=0)
    with pytest.raises(KeyError):
        graph.sides(named[0], "middle")


def test_tokens_do_not_depend_on_node_numbers(spark):
    nodes = {0: {"element": "C"}, 1: {"element": "O"}, 2: {"element": "N"}, 3: {"element": "C"}}
    edges = {(0, 1): {"order": 1}, (1, 2): {"order": 2}, (2, 3): {"order": 1}, (0, 3): {"order": 1}}
    swap = {0: 7, 1: 3, 2: 9, 3: 1}
    other = {swap[n]: a for n, a in nodes.items()}, {(swap[u], swap[v]): a for (u, v), a in edges.items()}
    n, e = from_dicts(spark, {"a": (nodes, edges), "b": other})
    for make in (tokens.wl_tokens, tokens.morgan_tokens, tokens.path_tokens, tokens.ego_tokens):
        got = {}
        for r in make(n, e, 2).collect():
            got.setdefault(r.graph_id, {})[r.token] = r.cnt
        assert got["a"] == got["b"]


def test_labels_count_unless_blind(spark):
    n, e = from_dicts(spark, {"a": ({0: {"element": "C"}, 1: {"element": "O"}}, {(0, 1): {}}), "b": ({0: {"element": "C"}, 1: {"element": "N"}}, {(0, 1): {}})})
    seen = lambda blind: len({r.token for r in tokens.ego_tokens(n, e, 1, blind=blind).collect()})
    assert seen(False) == 5 and seen(True) == 2


def test_missing_nodes_nulls_repeats_and_extra_columns(spark):
    nodes = spark.createDataFrame([("g:R", 0, None, None, None, None, None, "x"), ("g:R", 0, None, None, None, None, None, "x"), (None, 1, "C", None, None, None, None, "x")], NODES + ", token string")
    edges = spark.createDataFrame([("g:R", 0, 5, 1.0, None, 1), ("g:R", None, 5, 1.0, None, 1)], EDGES + ", node_id int")
    assert rows(graph.degrees(nodes, edges)) == [("g:R", 0, 1)]
    assert sum(r.cnt for r in tokens.wl_tokens(nodes, edges, 1).collect()) == 2
    assert sum(r.cnt for r in tokens.path_tokens(nodes, edges, 1).collect()) == 0


def test_empty_tables(spark):
    nodes, edges = spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES)
    for make in (tokens.wl_tokens, tokens.path_tokens, tokens.ego_tokens):
        assert make(nodes, edges, 1).count() == 0
    assert graph.summary(nodes, edges).count() == 0 and graph.ego_nodes(nodes, edges, 2).count() == 0


def test_summary_counts_empty_sides(spark):
    n, e = pair_tables(spark, {5: (({0: {}, 1: {}}, {(0, 1): {}}), ({}, {})), 6: (({0: {}}, {}), ({0: {}}, {}))})
    assert rows(graph.summary(n, e)) == [(5, "P", 0, 0), (5, "R", 2, 1), (6, "P", 1, 0), (6, "R", 1, 0)]
    assert rows(graph.sides(graph.summary(n, e), 1).select("reaction_id")) == [(5,), (6,)]


def test_ego_subgraphs(named):
    nodes, edges = (d.where("graph_id = 'path3'") for d in named)
    assert rows(graph.ego_nodes(nodes, edges, 1).where("center = 0").select("node_id", "hop")) == [(0, 0), (1, 1)]
    assert graph.ego_nodes(nodes, edges, 2).where("center = 0").count() == 3
    assert rows(graph.ego_edges(nodes, edges, 1).where("center = 0").select("u", "v")) == [(0, 1)]


def test_round_trip_and_duck_typed_graphs(spark):
    class Like:
        def nodes(self, data):
            return [(0, {"element": "C"}), (1, {"element": "O", "mark": 3})]

        def edges(self, data):
            return [(1, 0, {"order": 2.0})]

    n, e = from_networkx(spark, {"g": Like()})
    ns, es = to_dicts(n, e, "g")
    assert ns[1]["element"] == "O" and ns[1]["attrs"] == {"mark": "3"} and es[0, 1]["bond_order"] == 2.0
    labels = {r.node_id: r.label for r in graph.atom_labels(n, e, ("mark",)).collect()}
    assert labels == {0: "~|1", 1: "3|1"}


@pytest.mark.parametrize("attrs", [{}, {"node_attrs": ("element", "mark"), "edge_attrs": ()}, {"node_attrs": (), "edge_attrs": ("bond_order", "foo")}])
def test_packed_and_joined_refinement_agree(named, attrs):
    nodes, edges = named
    loose = edges.union(edges.sparkSession.createDataFrame([("two", 1, 77, 1.0, None)], EDGES))
    got = [rows(tokens.wl_tokens(nodes, loose, 2, packed=p, **attrs)) for p in (True, False)]
    assert got[0] == got[1] and got[0]
    assert rows(tokens.wl_tokens(nodes, loose, 2, **attrs)) == got[0]


def test_label_variant_and_signatures(named):
    nodes, edges = named
    assert sum(r.cnt for r in tokens.wl_label_tokens(nodes, edges, 1).where("graph_id = 'triangle'").collect()) == 6
    bare = tokens.wl_label_tokens(nodes, edges, 1, edge_attrs=()).where("graph_id = 'path3'")
    assert sorted(r.cnt for r in bare.collect()) == [1, 1, 2, 2]
    assert len({r.signature for r in tokens.graph_signatures(nodes, edges).collect()}) == 5
    assert tokens.graph_signatures(nodes.where("false"), edges).count() == 0


def test_rings_keep_the_smallest_hop(spark):
    n, links = 9, [(i, i + 1) for i in range(8)] + [(0, 8), (2, 6), (4, 4)]
    nodes, edges = from_dicts(spark, {"g": ({i: {} for i in range(n)}, {e: {} for e in links})})
    near = {i: {b for a, b in [*links, *[(v, u) for u, v in links]] if a == i and b != i} for i in range(n)}
    want = []
    for c in range(n):
        seen, ring = {c: 0}, {c}
        for k in range(1, 5):
            ring = {m for x in ring for m in near[x]} - set(seen)
            seen |= dict.fromkeys(ring, k)
        want += [("g", c, m, k) for m, k in seen.items()]
    assert rows(graph.ego_nodes(nodes, edges, 4)) == sorted(want, key=repr)
    size = lambda r: len(graph.ego_nodes(nodes, edges, r)._jdf.queryExecution().optimizedPlan().toString())
    assert size(6) < 1.6 * size(5)  # not doubled by each hop


def test_only_large_graphs_take_the_joins(spark, monkeypatch, named):
    nodes, edges = named
    want = rows(tokens.wl_tokens(nodes, edges, 2, packed=True))
    monkeypatch.setattr(tokens, "PACKED_NODES", 4)
    large = {r.graph_id for r in tokens.large_graphs(nodes, edges).collect()}
    assert large == {"triangle", "path3"} and rows(tokens.wl_tokens(nodes, edges, 2)) == want


@pytest.mark.parametrize("kind", ["wl", "morgan", "path"])
def test_exchange_tokens(spark, named, kind):
    nodes, edges = named
    got = {}
    for r in exchange.exchange_tokens(nodes, edges, kind, 2, person=b"other").collect():
        got.setdefault(r.graph_id, {})[int(r.token)] = r.cnt
    h = lambda *x: exchange_hash(repr(x), person=b"other")
    if kind == "path":
        atom, bond = (None, None, None, None, 2), (1.0,)
        assert got["triangle"] == {h("path", 1, (atom, bond, atom)): 6, h("path", 2, (atom, bond, atom, bond, atom)): 6}
        c, o = ("C", False, None, None, 1), ("O", True, None, None, 1)
        assert got["two"] == {h("path", 1, (c, (2.0,), o)): 2}
        return
    first, b, step = exchange.REFINED[kind]
    t0, bond = h(first, None, None, None, None, 2), h(b, 1.0)
    t1 = h(step, 1, t0, ((bond, t0), (bond, t0)))
    assert got["triangle"] == {t0: 3, t1: 3, h(step, 2, t1, ((bond, t1), (bond, t1))): 3}
    assert 0 <= exchange.exchange_bit(t0, 16, 1) < 16
    with pytest.raises(ValueError):
        exchange.exchange_tokens(nodes, edges, "other")


def test_attribute_order_does_not_matter(spark):
    a, b = (from_dicts(spark, {"g": ({0: {"x": v}}, {})})[0].first().attrs["x"] for v in ({"p": 1, "q": [2]}, {"q": [2], "p": 1}))
    assert a == b == '{"p": 1, "q": [2]}'


def test_printout_and_networkx_sink(spark):
    nodes, edges = from_printout(spark, "g", [(0, {"element": "C"}), (1, {})], [(1, 0, {"order": 2.0, "foo": "bar"})])
    assert rows(edges.select("u", "v", "bond_order")) == [(0, 1, 2.0)]
    try:
        import networkx  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError, match="to_dicts"):
            to_networkx(nodes, edges, "g")
    else:
        assert to_networkx(nodes, edges, "g").edges[0, 1] == {"bond_order": 2.0, "foo": "bar"}


def broadcasts(spark, folder, name):
    """Broadcasts in the plan of a query over tables that look small by their files."""
    from molweave.plans.queries import queries

    atoms = [(f"{i}:{s}", a, "C", False, 0, 1, None) for i in range(4) for s in "RP" for a in range(3)]
    spark.createDataFrame(atoms, NODES).write.parquet(f"{folder}/nodes.parquet")
    spark.createDataFrame([(f"{i}:{s}", a, a + 1, 1.0, None) for i in range(4) for s in "RP" for a in range(2)], EDGES).write.parquet(f"{folder}/edges.parquet")
    return queries()[name](spark, str(folder))._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_minpath2_is_not_broadcast(spark, tmp_path):
    assert broadcasts(spark, tmp_path, "path_tokens_minpath2") == 0


def test_ego_edges_are_not_broadcast(spark, tmp_path):
    assert broadcasts(spark, tmp_path, "ego_edges_r2") == 0


def test_paths_l1_3_are_not_broadcast(spark, tmp_path):
    assert broadcasts(spark, tmp_path, "path_tokens_l1_3") == 0


def test_path_minhash_are_not_broadcast(spark, tmp_path):
    assert broadcasts(spark, tmp_path, "fingerprint_path_minhash") == 0


def test_joined_rounds_are_not_broadcast(spark, tmp_path):
    assert broadcasts(spark, tmp_path, "wl_tokens_joined") == 0
