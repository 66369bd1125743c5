"""Tokens as Python systems compute them that hash the ``repr`` of nested tuples with BLAKE2b.

The JVM has no BLAKE2b, and 64 bits unsigned need a DECIMAL(20, 0); so graphs are packed into a row each and
labelled on Arrow batches. An atom's tuple are its attributes and its degree, a bond's its attributes; attributes
are bool, int, float or text, None where missing. The cleaning rules are those of ``operators.graph``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molweave.functions.hashing import exchange_hash
from molweave.model import EDGE_ATTRS, NODE_ATTRS
from molweave.operators import graph

# First entries of the hashed tuples.
REFINED = {"wl": ("a0", "b", "wl"), "morgan": ("m0", "mb", "morgan")}

Atoms = dict[int, tuple]
Ways = dict[int, list[tuple[int, tuple]]]


def refined(atoms: Atoms, ways: Ways, kind: str, radius: int, person: bytes) -> Counter:
    """Tokens of all rounds of edge-aware refinement."""
    first, bond, step = REFINED[kind]
    token = lambda *x: exchange_hash(repr(x), person=person)
    near = {n: [(token(bond, *b), m) for m, b in out] for n, out in ways.items()}
    now = {n: token(first, *label) for n, label in atoms.items()}
    found = Counter(now.values())
    for k in range(1, radius + 1):
        now = {n: token(step, k, t, tuple(sorted((b, now[m]) for b, m in near[n]))) for n, t in now.items()}
        found.update(now.values())
    return found


def paths(atoms: Atoms, ways: Ways, radius: int, least: int, person: bytes) -> Counter:
    """Tokens of the simple paths of ``least`` to ``radius`` bonds, from both ends."""
    found: Counter = Counter()
    grown = [((n,), (label,)) for n, label in atoms.items()]
    for length in range(1, max(radius, least) + 1):
        grown = [((*seen, m), (*labels, b, atoms[m])) for seen, labels in grown for m, b in ways[seen[-1]] if m not in seen]
        if length >= least:
            for _, labels in grown:
                found[exchange_hash(repr(("path", length, min(labels, labels[::-1], key=_order))), person=person)] += 1
    return found


def _order(labels: tuple) -> tuple:
    """Tuples of labels in their natural order; a missing value sorts before any other."""
    return tuple(tuple((x is not None, 0 if x is None else x) for x in label) for label in labels)


def exchange_tokens(nodes: DataFrame, edges: DataFrame, kind: str = "wl", radius: int = 2, least: int = 1, person: bytes = b"", node_attrs: tuple[str, ...] = NODE_ATTRS, edge_attrs: tuple[str, ...] = EDGE_ATTRS) -> DataFrame:
    """``graph_id, token, cnt`` with tokens as DECIMAL(20, 0), for kind ``wl``, ``morgan`` or ``path``."""
    if kind not in (*REFINED, "path"):
        raise ValueError(f"unknown kind {kind!r}")
    atoms, bonds = graph.clean_nodes(nodes), graph.inner_edges(nodes, edges)
    pick = lambda attrs, table: F.struct(*[(F.col(a) if a in table.columns else F.col("attrs")[a]).alias(a) for a in attrs] or [F.lit(None).cast("string").alias("none")])
    labelled = atoms.join(graph.degrees(nodes, edges), ["graph_id", "node_id"])
    own = labelled.groupBy("graph_id").agg(F.collect_list(F.struct("node_id", pick(node_attrs, atoms).alias("a"), "degree")).alias("nodes"))
    links = bonds.groupBy("graph_id").agg(F.collect_list(F.struct("u", "v", pick(edge_attrs, bonds).alias("a"))).alias("edges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for gid, ns, es in zip(*[c.to_pylist() for c in batch.columns]):
                labels = {n["node_id"]: (*[n["a"][a] for a in node_attrs], n["degree"]) for n in ns}
                ways: Ways = {n: [] for n in labels}
                for e in es or []:
                    bond = tuple(e["a"][a] for a in edge_attrs)
                    ways[e["u"]].append((e["v"], bond))
                    ways[e["v"]].append((e["u"], bond))
                found = paths(labels, ways, radius, least, person) if kind == "path" else refined(labels, ways, kind, radius, person)
                rows += [(gid, Decimal(t), n) for t, n in found.items()]
            columns = list(zip(*rows)) or [[], [], []]
            yield pa.record_batch([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.decimal128(20, 0)), pa.array(columns[2], pa.int64())], ["graph_id", "token", "cnt"])

    return own.join(links, "graph_id", "left").select("graph_id", "nodes", "edges").mapInArrow(run, "graph_id string, token decimal(20,0), cnt long")


def exchange_bit(token: int, bits: int, seed: int, person: bytes = b"") -> int:
    """The place of a token in a parity sketch."""
    return exchange_hash(repr(("pf", token)), seed, person) % bits
