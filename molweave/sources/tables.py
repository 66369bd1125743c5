"""Graphs from Python objects and files, and fingerprints to files and arrays."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molweave.model import EDGES, NODES

Attrs = Mapping[str, object]
Graph = tuple[Mapping[int, Attrs], Mapping[tuple[int, int], Attrs]]


def frozen(value: object) -> str:
    """An attribute as text; lists, sets and dictionaries as JSON in which the order of keys does not matter."""
    if isinstance(value, (set, frozenset)):
        value = sorted(value, key=repr)
    return json.dumps(value, sort_keys=True, default=str) if isinstance(value, (dict, list, tuple)) else str(value)


def from_dicts(spark: SparkSession, graphs: Mapping[str, Graph]) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables of ``graph_id -> (nodes, edges)``; of a bond given both ways the last counts."""
    nodes, edges = [], []
    known = {"element", "aromatic", "charge", "hcount"}
    for gid, (ns, es) in graphs.items():
        for n, a in ns.items():
            extra = {k: frozen(v) for k, v in a.items() if k not in known and v is not None}
            nodes.append((gid, n, a.get("element"), a.get("aromatic"), a.get("charge"), a.get("hcount"), extra or None))
        last: dict[tuple[int, int], Attrs] = {}
        for (u, v), a in es.items():
            last[min(u, v), max(u, v)] = a
        for (u, v), a in last.items():
            # Either name of the bond order is understood.
            order = a.get("bond_order", a.get("order"))
            extra = {k: frozen(x) for k, x in a.items() if k not in ("bond_order", "order") and x is not None}
            edges.append((gid, u, v, None if order is None else float(order), extra or None))
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def from_networkx(spark: SparkSession, graphs: Mapping[str, object]) -> tuple[DataFrame, DataFrame]:
    """The same from NetworkX-like graphs: anything with ``nodes(data=True)`` and ``edges(data=True)``."""
    plain = {k: (dict(g.nodes(data=True)), {(u, v): a for u, v, a in g.edges(data=True)}) for k, g in graphs.items()}
    return from_dicts(spark, plain)


def to_dicts(nodes: DataFrame, edges: DataFrame, graph_id: str) -> Graph:
    """One graph as dictionaries, for inspection."""
    ns = {r["node_id"]: {k: v for k, v in r.asDict().items() if k not in ("graph_id", "node_id")} for r in nodes.where(F.col("graph_id") == graph_id).collect()}
    es = {(r["u"], r["v"]): {k: v for k, v in r.asDict().items() if k not in ("graph_id", "u", "v")} for r in edges.where(F.col("graph_id") == graph_id).collect()}
    return ns, es


def to_networkx(nodes: DataFrame, edges: DataFrame, graph_id: str) -> object:
    """One graph for NetworkX, if that is installed; missing attributes are left out."""
    try:
        import networkx
    except ImportError as e:
        raise ImportError("NetworkX is needed for this sink; to_dicts gives the same graph as dictionaries") from e
    ns, es = to_dicts(nodes, edges, graph_id)
    known = lambda a: {k: v for k, v in a.items() if v is not None and k != "attrs"} | (a.get("attrs") or {})
    g = networkx.Graph()
    g.add_nodes_from((n, known(a)) for n, a in ns.items())
    g.add_edges_from((u, v, known(a)) for (u, v), a in es.items())
    return g


def from_printout(spark: SparkSession, graph_id: str, nodes: Iterable[tuple[int, Attrs]], edges: Iterable[tuple[int, int, Attrs]]) -> tuple[DataFrame, DataFrame]:
    """Tables of one graph given as its printed lists ``[(node, attributes)]`` and ``[(u, v, attributes)]``."""
    return from_dicts(spark, {graph_id: (dict(nodes), {(u, v): a for u, v, a in edges})})


def pair_tables(spark: SparkSession, reactions: Mapping[int, tuple[Graph, Graph]]) -> tuple[DataFrame, DataFrame]:
    """Tables of graph pairs ``reaction_id -> (reactant, product)``."""
    return from_dicts(spark, {f"{rid}:{s}": g for rid, pair in reactions.items() for s, g in zip("RP", pair)})


def read_any(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None) -> DataFrame:
    """A table in Parquet, ORC, JSON lines or CSV with a header."""
    reader = spark.read.format(kind)
    if schema:
        reader = reader.schema(schema)
    if kind == "csv":
        reader = reader.option("header", True)
    return reader.load(path)


def write_fingerprints(df: DataFrame, path: str, bits: int, wide: bool = False, partition_by: Iterable[str] = ()) -> None:
    """Parquet with one array column, or with columns ``b_0`` to ``b_<bits-1>``."""
    if wide:
        df = wide_matrix(df, bits)
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def wide_matrix(df: DataFrame, bits: int) -> DataFrame:
    other = [c for c in df.columns if c != "fingerprint"]
    return df.select(*other, *[F.get("fingerprint", F.lit(i)).alias(f"b_{i}") for i in range(bits)])


def to_matrix(df: DataFrame, key: str = "reaction_id") -> tuple[np.ndarray, np.ndarray]:
    """Ids and the matrix of fingerprints on the driver, for small results."""
    rows = df.select(key, "fingerprint").orderBy(key).collect()
    if not rows:
        return np.zeros(0, np.int64), np.zeros((0, 0), int)
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], int)
