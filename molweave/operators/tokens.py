"""Token extraction: refinement (WL and circular), simple paths and canonical ego subgraphs.

Every extractor returns ``graph_id, token, cnt``. All joins and groups are keyed by ``graph_id``, so a graph
is shuffled once and later rounds stay in its partition. Rows follow the cleaning rules of
``operators.graph``; a graph without nodes has no tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molweave.functions.hashing import token_hash
from molweave.model import EDGE_ATTRS, NODE_ATTRS, label
from molweave.operators import canonical, graph
from molweave.session import by_key, cut, join_merged

# Tags that keep the tokens of the extractors apart.
WL = ("a0", "b", "wl")
MORGAN = ("m0", "mb", "morgan")
WL_LABELS = ("n0", "nb", "nw")


def check_radius(radius: int) -> None:
    if isinstance(radius, bool) or not isinstance(radius, int) or radius < 0:
        raise ValueError("radius must be a whole number of at least 0")


def sortable(token: Column) -> Column:
    """Fixed-width text of a token: text order is number order."""
    return F.lpad(token.cast("string"), 19, "0")


PACKED_NODES = 1_000


def large_graphs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``graph_id`` of the graphs that are too large for one row."""
    rows = nodes.select("graph_id").unionByName(edges.select("graph_id")).where("graph_id is not null")
    return rows.groupBy("graph_id").agg(F.count("*").alias("n")).where(F.col("n") > PACKED_NODES).select("graph_id")


def refine(nodes: DataFrame, edges: DataFrame, radius: int, tags: tuple[str, str, str] = WL, node_attrs: tuple[str, ...] = NODE_ATTRS, edge_attrs: tuple[str, ...] = EDGE_ATTRS, packed: bool | None = None) -> DataFrame:
    """Labels of every round: ``graph_id, node_id, k, token``.

    Round 0 hashes the atom label; round k hashes the last label and the sorted pairs of bond hash and
    neighbour label. Graphs of the size of molecules are packed into a row each and refined inside the
    row, after one shuffle of nodes and of bonds. Labels and bonds of graphs with more than ``PACKED_NODES`` rows
    stay in tables and meet by joins, so that no graph has to fit into one task. One small job, run when the plan
    is made, looks for such graphs; only they take the second way. ``packed`` chooses one way for all."""
    check_radius(radius)
    if packed is not None:
        return (_refine_rows if packed else _refine_tables)(nodes, edges, radius, tags, node_attrs, edge_attrs)
    large = cut(large_graphs(nodes, edges))
    if large.isEmpty():
        return _refine_rows(nodes, edges, radius, tags, node_attrs, edge_attrs)
    small, big = ([join_merged(t, large, ["graph_id"], how) for t in (nodes, edges)] for how in ("left_anti", "left_semi"))
    return _refine_rows(*small, radius, tags, node_attrs, edge_attrs).unionByName(_refine_tables(*big, radius, tags, node_attrs, edge_attrs))


def _refine_rows(nodes: DataFrame, edges: DataFrame, radius: int, tags: tuple[str, str, str], node_attrs: tuple[str, ...], edge_attrs: tuple[str, ...]) -> DataFrame:
    first, bond, step = tags
    # One shuffle of each table: cleaning, packing and the join all keep this partitioning.
    atoms = graph.clean_nodes(by_key(_without_map(nodes, node_attrs), "graph_id"))
    bonds = graph.clean_edges(by_key(_without_map(edges, edge_attrs), "graph_id"))
    text = label(node_attrs, atoms.columns) if node_attrs else F.lit(None).cast("string")
    link = sortable(token_hash(F.concat(F.lit(f"{bond}|"), label(edge_attrs, bonds.columns))))
    own = atoms.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct(F.col("node_id").alias("id"), text.alias("label")))).alias("nodes"))
    ends = F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b"), link.alias("bond")), F.struct(F.col("v").alias("a"), F.col("u").alias("b"), link.alias("bond")))
    ways = bonds.groupBy("graph_id").agg(F.flatten(F.collect_list(ends)).alias("ways"))
    g = join_merged(own, ways, ["graph_id"], "left").withColumn("ways", F.coalesce("ways", F.array().cast("array<struct<a:bigint,b:bigint,bond:string>>")))
    g = g.withColumn("ids", F.transform("nodes", lambda n: n["id"]))
    # For each node its degree, over all its bonds, and the places and hashes of its existing neighbours.
    place = lambda w: F.struct(F.array_position("ids", w["b"]).cast("int").alias("at"), w["bond"].alias("bond"))
    mine = F.transform("ids", lambda i: F.filter("ways", lambda w: w["a"] == i))
    g = g.withColumn("mine", mine).withColumn("near", F.transform("mine", lambda ws: F.filter(F.transform(ws, place), lambda x: x["at"] > 0)))
    whole = F.zip_with("nodes", "mine", lambda n, ws: F.concat_ws("|", n["label"], F.size(ws).cast("string")))
    g = g.select("graph_id", "ids", "near", F.transform(whole, lambda x: token_hash(F.concat(F.lit(f"{first}|"), x))).alias("t0"))
    for k in range(1, radius + 1):
        g = g.withColumn(f"t{k}", _next_round(f"t{k - 1}", f"{step}|{k}|"))
    rounds = F.array(*[F.struct(F.lit(k).alias("k"), F.arrays_zip(F.col("ids").alias("node_id"), F.col(f"t{k}").alias("token")).alias("x")) for k in range(radius + 1)])
    flat = g.select("graph_id", F.explode(rounds).alias("r")).select("graph_id", F.col("r.k").alias("k"), F.explode("r.x").alias("x"))
    return flat.select("graph_id", F.col("x.node_id").alias("node_id"), "k", F.col("x.token").alias("token"))


def _without_map(table: DataFrame, attrs: tuple[str, ...]) -> DataFrame:
    """The table without the map of extra attributes where no attribute comes from it."""
    return table.drop("attrs") if all(a in table.columns for a in attrs) else table


def _next_round(last: str, tag: str) -> Column:
    """Labels of the next round from the column ``last`` and the places of the neighbours in ``near``."""

    def around(xs: Column) -> Column:
        pairs = F.transform(xs, lambda x: F.concat_ws(":", x["bond"], sortable(F.element_at(F.col(last), x["at"]))))
        return F.array_join(F.array_sort(pairs), ",")

    return F.zip_with(last, "near", lambda t, xs: token_hash(F.concat(F.lit(tag), t.cast("string"), F.lit("|"), around(xs))))


def _refine_tables(nodes: DataFrame, edges: DataFrame, radius: int, tags: tuple[str, str, str], node_attrs: tuple[str, ...], edge_attrs: tuple[str, ...]) -> DataFrame:
    first, bond, step = tags
    labels = graph.atom_labels(nodes, edges, node_attrs)
    now = labels.select("graph_id", "node_id", token_hash(F.concat(F.lit(f"{first}|"), F.col("label"))).alias("token"))
    out = now.select("graph_id", "node_id", F.lit(0).alias("k"), "token")
    if radius:
        bonds = graph.inner_edges(nodes, edges)
        bonds = bonds.select("graph_id", "u", "v", sortable(token_hash(F.concat(F.lit(f"{bond}|"), label(edge_attrs, bonds.columns)))).alias("bond"))
        ways = graph.directed(bonds).select("graph_id", F.col("src").alias("node_id"), "dst", "bond")
        if radius > 1:  # read once in every round
            ways = cut(ways)
    for k in range(1, radius + 1):
        if k > 1:  # a round reads the last one twice: without a cut the plan would double each time
            now = cut(now)
        near = now.select("graph_id", F.col("node_id").alias("dst"), sortable(F.col("token")).alias("near"))
        around = join_merged(ways, near, ["graph_id", "dst"]).groupBy("graph_id", "node_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "bond", "near"))), ",").alias("around"))
        text = F.concat(F.lit(f"{step}|{k}|"), F.col("token").cast("string"), F.lit("|"), F.coalesce("around", F.lit("")))
        now = join_merged(now, around, ["graph_id", "node_id"], "left").select("graph_id", "node_id", token_hash(text).alias("token"))
        out = out.unionByName(now.select("graph_id", "node_id", F.lit(k).alias("k"), "token"))
    return out


def _counted(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("graph_id", "token").agg(F.count("*").alias("cnt"))


def wl_tokens(nodes: DataFrame, edges: DataFrame, radius: int = 2, **attrs: object) -> DataFrame:
    """Refinement tokens of every round up to ``radius``."""
    return _counted(refine(nodes, edges, radius, WL, **attrs))


def morgan_tokens(nodes: DataFrame, edges: DataFrame, radius: int = 2, **attrs: object) -> DataFrame:
    """The same rounds under tags of their own, as circular environments."""
    return _counted(refine(nodes, edges, radius, MORGAN, **attrs))


def path_tokens(nodes: DataFrame, edges: DataFrame, radius: int = 2, min_path: int = 1, node_attrs: tuple[str, ...] = NODE_ATTRS, edge_attrs: tuple[str, ...] = EDGE_ATTRS) -> DataFrame:
    """Simple paths of ``min_path`` to ``max(min_path, radius)`` bonds, each emitted from both of its ends.

    The token hashes the smaller of the two readings, which are compared as texts of their labels."""
    check_radius(radius)
    if min_path < 1:
        raise ValueError("min_path must be at least 1")
    longest = max(min_path, radius or min_path)
    atoms = graph.atom_labels(nodes, edges, node_attrs)
    bonds = graph.inner_edges(nodes, edges)
    bonds = bonds.where("u <> v").select("graph_id", "u", "v", label(edge_attrs, bonds.columns).alias("bond"))
    ends = atoms.select("graph_id", F.col("node_id").alias("dst"), F.col("label").alias("next"))
    ways = join_merged(graph.directed(bonds), ends, ["graph_id", "dst"])
    paths = atoms.select("graph_id", F.col("node_id").alias("end"), F.array("node_id").alias("seen"), F.array("label").alias("labels"))
    found = None
    for hop in range(1, longest + 1):
        grown = join_merged(paths, ways.withColumnRenamed("src", "end"), ["graph_id", "end"]).where(~F.array_contains("seen", F.col("dst")))
        paths = grown.select("graph_id", F.col("dst").alias("end"), F.array_append("seen", F.col("dst")).alias("seen"), F.concat("labels", F.array("bond", "next")).alias("labels"))
        if hop >= min_path:
            text = F.least(F.array_join("labels", ">"), F.array_join(F.reverse("labels"), ">"))
            done = paths.select("graph_id", token_hash(F.concat(F.lit(f"path|{hop}|"), text)).alias("token"))
            found = done if found is None else found.unionByName(done)
    return _counted(found)


def wl_label_tokens(nodes: DataFrame, edges: DataFrame, radius: int = 2, node_attrs: tuple[str, ...] = NODE_ATTRS, edge_attrs: tuple[str, ...] = EDGE_ATTRS) -> DataFrame:
    """The variant that hashes every round's label once more, with its depth; without bond attributes
    neighbours are not looked at, only the degree in the atom label tells of bonds."""
    if edge_attrs:
        rounds = refine(nodes, edges, radius, WL_LABELS, node_attrs, edge_attrs)
    else:
        first = refine(nodes, edges, 0, WL_LABELS, node_attrs, edge_attrs)
        labels = [F.col("token")]
        for k in range(1, radius + 1):
            labels.append(token_hash(F.concat(F.lit(f"{WL_LABELS[2]}|{k}|"), labels[-1].cast("string"), F.lit("|"))))
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), x.alias("token")) for k, x in enumerate(labels)]))
        rounds = first.select("graph_id", "node_id", each.alias("x")).select("graph_id", "node_id", "x.k", "x.token")
    return _counted(rounds.select("graph_id", token_hash(F.concat_ws("|", F.lit("nxwl"), F.col("k").cast("string"), F.col("token").cast("string"))).alias("token")))


def _packed_graphs(nodes: DataFrame, edges: DataFrame, node_attrs: tuple[str, ...], edge_attrs: tuple[str, ...], blind: bool) -> DataFrame:
    """``graph_id, nodes, edges`` with label texts, a row for each graph."""
    atoms = graph.clean_nodes(nodes)
    bonds = graph.inner_edges(nodes, edges)
    a = label(node_attrs, atoms.columns) if not blind else F.lit("")
    b = label(edge_attrs, bonds.columns) if not blind else F.lit("")
    own = atoms.groupBy("graph_id").agg(F.collect_list(F.struct("node_id", a.alias("label"))).alias("nodes"))
    return join_merged(own, bonds.groupBy("graph_id").agg(F.collect_list(F.struct("u", "v", b.alias("label"))).alias("edges")), ["graph_id"], "left")


def graph_signatures(nodes: DataFrame, edges: DataFrame, node_attrs: tuple[str, ...] = NODE_ATTRS, edge_attrs: tuple[str, ...] = EDGE_ATTRS, blind: bool = False) -> DataFrame:
    """``graph_id, signature``: SHA-256 of the canonical form, equal for isomorphic graphs only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [canonical.whole_form({n["node_id"]: n["label"] for n in ns}, {(e["u"], e["v"]): e["label"] for e in es or []}) for ns, es in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.record_batch([batch.column(0), pa.array(forms, pa.string())], ["graph_id", "form"])

    forms = _packed_graphs(nodes, edges, node_attrs, edge_attrs, blind).mapInArrow(run, "graph_id string, form string")
    return forms.select("graph_id", F.sha2("form", 256).alias("signature"))


def ego_tokens(nodes: DataFrame, edges: DataFrame, radius: int = 1, node_attrs: tuple[str, ...] = NODE_ATTRS, edge_attrs: tuple[str, ...] = EDGE_ATTRS, blind: bool = False) -> DataFrame:
    """Tokens of the canonical form of the ego subgraph of every node for every k up to ``radius``.

    ``blind`` leaves all labels out, so that only the shape counts. Canonical search needs Python; it runs
    on Arrow batches of whole graphs and remembers equal subgraphs within a batch."""
    check_radius(radius)
    graphs = _packed_graphs(nodes, edges, node_attrs, edge_attrs, blind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict = {}
        for batch in batches:
            ids, forms = [], []
            for gid, ns, es in zip(*[c.to_pylist() for c in batch.columns]):
                labels = {n["node_id"]: n["label"] for n in ns}
                links = {(e["u"], e["v"]): e["label"] for e in es or []}
                for form in canonical.ego_forms(labels, links, radius, memory):
                    ids.append(gid)
                    forms.append(form)
            yield pa.record_batch([pa.array(ids, pa.string()), pa.array(forms, pa.string())], ["graph_id", "form"])

    forms = graphs.mapInArrow(run, "graph_id string, form string")
    return _counted(forms.select("graph_id", token_hash(F.concat(F.lit("ego|"), F.col("form"))).alias("token")))


def side_tokens(tokens: DataFrame) -> DataFrame:
    """``reaction_id, side, token, cnt``: the graphs of a side added up."""
    rid, side = graph.reaction_of(F.col("graph_id"))
    return tokens.groupBy(rid.alias("reaction_id"), side.alias("side"), "token").agg(F.sum("cnt").alias("cnt"))
