"""Graph tables: cleaning, adjacency, degrees, labels, summaries and ego subgraphs.

Nulls: rows without a graph or node id are left out; missing attributes are ``~`` in labels. Repeated
rows count once; of rows that give a node or bond twice with other attributes the greatest comes out,
or the last by an ordinal column. Bonds that name a missing node are kept by the edge operators and left
out by everything that needs the node. Extra columns of the inputs are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molweave.model import EDGE_ATTRS, NODE_ATTRS, label
from molweave.session import join_merged


def _known(df: DataFrame, names: list[str]) -> list[str]:
    return [n for n in names if n in df.columns]


def _one(df: DataFrame, keys: list[str], values: list[str], ordinal: str | None) -> DataFrame:
    plain = [v for v in values if v != "attrs"]
    extra = ["attrs"] if "attrs" in values else []
    order = F.struct(*[F.col(c) for c in ([ordinal] if ordinal else []) + plain] or [F.lit(0)])
    whole = F.struct(*[F.col(c) for c in plain + extra] or [F.lit(0).alias("none")])
    picked = df.groupBy(*keys).agg(F.max_by(whole, order).alias("x"))
    return picked.select(*keys, *[F.col(f"x.{c}").alias(c) for c in plain + extra])


def clean_nodes(nodes: DataFrame, ordinal: str | None = None) -> DataFrame:
    """One row for each ``graph_id, node_id``."""
    rows = nodes.where("graph_id is not null and node_id is not null")
    return _one(rows, ["graph_id", "node_id"], _known(nodes, [*NODE_ATTRS, "attrs"]), ordinal)


def clean_edges(edges: DataFrame, ordinal: str | None = None) -> DataFrame:
    """One row for each bond with ``u <= v``."""
    rows = edges.where("graph_id is not null and u is not null and v is not null")
    rows = rows.withColumn("__u", F.least("u", "v")).withColumn("v", F.greatest("u", "v")).withColumn("u", F.col("__u"))
    return _one(rows, ["graph_id", "u", "v"], _known(edges, [*EDGE_ATTRS, "attrs"]), ordinal)


def directed(edges: DataFrame) -> DataFrame:
    """``graph_id, src, dst`` and the bond's other columns, both ways; a self-loop comes twice."""
    other = [c for c in edges.columns if c not in ("u", "v")]
    ends = F.explode(F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst"))))
    return edges.select(*other, ends.alias("e")).select(*other, "e.src", "e.dst")


def adjacency(edges: DataFrame) -> DataFrame:
    """``graph_id, node_id, neighbours`` in ascending order; isolated nodes are absent."""
    ways = directed(clean_edges(edges).select("graph_id", "u", "v"))
    return ways.groupBy("graph_id", F.col("src").alias("node_id")).agg(F.array_sort(F.collect_list("dst")).alias("neighbours"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``graph_id, node_id, degree`` of every node; a self-loop adds 2."""
    ways = directed(clean_edges(edges).select("graph_id", "u", "v"))
    counted = ways.groupBy("graph_id", F.col("src").alias("node_id")).agg(F.count("*").alias("degree"))
    every = clean_nodes(nodes).select("graph_id", "node_id")
    return join_merged(every, counted, ["graph_id", "node_id"], "left").na.fill(0, ["degree"])


def atom_labels(nodes: DataFrame, edges: DataFrame, attrs: tuple[str, ...] = NODE_ATTRS) -> DataFrame:
    """``graph_id, node_id, label``: the attributes, then the degree."""
    rows = clean_nodes(nodes)
    rows = join_merged(rows, degrees(nodes, edges), ["graph_id", "node_id"])
    return rows.select("graph_id", "node_id", label(attrs, rows.columns, F.col("degree").cast("string")).alias("label"))


def bond_labels(edges: DataFrame, attrs: tuple[str, ...] = EDGE_ATTRS) -> DataFrame:
    """``graph_id, u, v, label``: the attributes, without a degree."""
    rows = clean_edges(edges)
    return rows.select("graph_id", "u", "v", label(attrs, rows.columns).alias("label"))


def edge_between(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """The bonds of ``graph_id, a, b`` pairs, whichever way round; no row where there is no bond."""
    asked = pairs.select("graph_id", "a", "b", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    return join_merged(asked, clean_edges(edges), ["graph_id", "u", "v"]).drop("u", "v")


def reaction_of(graph_id: Column) -> tuple[Column, Column]:
    """Reaction number and side of a ``<reaction>:R`` or ``<reaction>:P`` graph id."""
    return F.split_part(graph_id, F.lit(":"), F.lit(1)).try_cast("bigint"), F.split_part(graph_id, F.lit(":"), F.lit(2))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``reaction_id, side, n_nodes, n_edges`` of both sides of every reaction, 0 for an empty side."""
    n = clean_nodes(nodes).groupBy("graph_id").agg(F.count("*").alias("n_nodes"))
    e = clean_edges(edges).groupBy("graph_id").agg(F.count("*").alias("n_edges"))
    both = join_merged(n, e, ["graph_id"], "full")
    rid, side = reaction_of(F.col("graph_id"))
    both = both.withColumn("reaction_id", rid).withColumn("side", side)
    sides = both.groupBy("reaction_id").agg(
        *[F.sum(F.when(F.col("side") == s, F.col(c))).alias(f"{s}{c}") for s in "RP" for c in ("n_nodes", "n_edges")]
    )
    row = [F.struct(F.lit(s).alias("side"), *[F.coalesce(F.col(f"{s}{c}"), F.lit(0)).alias(c) for c in ("n_nodes", "n_edges")]) for s in "RP"]
    return sides.select("reaction_id", F.explode(F.array(*row)).alias("x")).select("reaction_id", "x.side", "x.n_nodes", "x.n_edges")


def sides(reactions: DataFrame, side: str | int) -> DataFrame:
    """The graphs of one side: 0, ``reactant`` or R, and 1, ``product`` or P."""
    named = {0: "R", "0": "R", "reactant": "R", "R": "R", 1: "P", "1": "P", "product": "P", "P": "P"}
    if side not in named:
        raise KeyError(side)
    return reactions.where(F.col("side") == named[side])


def inner_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Clean bonds of which both ends exist."""
    ids = clean_nodes(nodes).select("graph_id", "node_id")
    ok = join_merged(clean_edges(edges), ids.withColumnRenamed("node_id", "u"), ["graph_id", "u"], "left_semi")
    return join_merged(ok, ids.withColumnRenamed("node_id", "v"), ["graph_id", "v"], "left_semi")


def ego_nodes(nodes: DataFrame, edges: DataFrame, radius: int) -> DataFrame:
    """``graph_id, center, node_id, hop``: the nodes within ``radius`` bonds of each node.

    Each hop extends the last ring only, so that the plan grows by one join a hop; a ring may hold nodes of
    earlier ones, which keep their smaller hop in the one aggregation at the end."""
    ways = directed(inner_edges(nodes, edges).where("u <> v").select("graph_id", "u", "v"))
    ring = clean_nodes(nodes).select("graph_id", F.col("node_id").alias("center"), "node_id")
    rings = ring.withColumn("hop", F.lit(0))
    for k in range(1, radius + 1):
        step = join_merged(ring.withColumnRenamed("node_id", "src"), ways, ["graph_id", "src"])
        ring = step.select("graph_id", "center", F.col("dst").alias("node_id")).where("node_id <> center").distinct()
        rings = rings.unionByName(ring.withColumn("hop", F.lit(k)))
    return rings.groupBy("graph_id", "center", "node_id").agg(F.min("hop").alias("hop"))


def ego_edges(nodes: DataFrame, edges: DataFrame, radius: int) -> DataFrame:
    """``graph_id, center, u, v`` and the bond's columns: all bonds inside each ego subgraph."""
    ego = ego_nodes(nodes, edges, radius).select("graph_id", "center", "node_id")
    bonds = inner_edges(nodes, edges)
    at_u = join_merged(ego.withColumnRenamed("node_id", "u"), bonds, ["graph_id", "u"])
    return join_merged(at_u, ego.withColumnRenamed("node_id", "v"), ["graph_id", "center", "v"], "left_semi")
