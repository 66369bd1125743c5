"""Reaction strings as graphs: a parser for molecules written as SMILES, run on Arrow batches.

Covers the organic subset, brackets (isotope, stereo mark, hydrogens, charge, atom number), branches, ring
closures with ``%nn``, bond symbols and dots. Stereo marks are read and not kept. Hydrogens of atoms
outside brackets fill the lowest usual valence. A string that cannot be read gives a row with its error
and null graphs; it never fails the query. Null strings give the error ``missing``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from molweave.session import spread

# Usual valences of the atoms that may stand outside brackets, and bond orders.
VALENCES = {"B": (3,), "C": (4,), "N": (3, 5), "O": (2,), "P": (3, 5), "S": (2, 4, 6), "F": (1,), "Cl": (1,), "Br": (1,), "I": (1,)}
ORDERS = {"-": 1.0, "=": 2.0, "#": 3.0, "$": 4.0, ":": 1.5, "/": 1.0, "\\": 1.0}
ATOM = re.compile(r"Cl|Br|[BCNOPSFI]|[bcnops]|\*")
BRACKET = re.compile(r"\[(?P<isotope>\d+)?(?P<symbol>[A-Z][a-z]?|[bcnops]|se|as|te|\*)(?P<chiral>@{0,2}(?:TH|AL|SP|TB|OH)?\d*)(?P<h>H\d*)?(?P<charge>\+\+|--|[+-]\d*)?(?::(?P<number>\d+))?\]")

GRAPH = "struct<nodes:array<struct<node_id:bigint,element:string,aromatic:boolean,charge:int,hcount:int>>,edges:array<struct<u:bigint,v:bigint,bond_order:double>>>"


def parse_smiles(text: str) -> tuple[list[dict], list[dict]]:
    """Nodes and edges of a dot-separated list of molecules; ValueError with the place of a mistake."""
    nodes: list[dict] = []
    edges: list[dict] = []
    joined: set[tuple[int, int]] = set()
    rings: dict[int, tuple[int, float | None]] = {}
    stack: list[int | None] = []
    last: int | None = None
    bond: float | None = None
    plain: list[int] = []

    def connect(u: int, v: int, order: float | None) -> None:
        key = min(u, v), max(u, v)
        if u == v or key in joined:
            raise ValueError("a bond joins an atom to itself or twice to another")
        joined.add(key)
        if order is None:
            order = 1.5 if nodes[u]["aromatic"] and nodes[v]["aromatic"] else 1.0
        edges.append({"u": key[0], "v": key[1], "bond_order": order})

    def add(symbol: str, charge: int, hcount: int) -> None:
        nonlocal last, bond
        nodes.append({"node_id": len(nodes), "element": symbol.capitalize(), "aromatic": symbol[0].islower(), "charge": charge, "hcount": hcount})
        if last is not None:
            connect(last, len(nodes) - 1, bond)
        last, bond = len(nodes) - 1, None

    i = 0
    while i < len(text):
        c = text[i]
        if c == "[":
            m = BRACKET.match(text, i)
            if not m:
                raise ValueError(f"bad bracket atom at {i}")
            sign = m["charge"] or ""
            charge = 0 if not sign else len(sign) * (1 if sign[0] == "+" else -1) if sign in ("++", "--", "+", "-") else int(sign)
            h = m["h"]
            add(m["symbol"], charge, 0 if not h else int(h[1:] or 1))
            i = m.end()
        elif m := ATOM.match(text, i):
            add(m[0], 0, 0)
            plain.append(len(nodes) - 1)
            i = m.end()
        elif c in ORDERS:
            if bond is not None:
                raise ValueError(f"two bonds at {i}")
            bond, i = ORDERS[c], i + 1
        elif c.isdigit() or c == "%":
            number, step = (text[i + 1 : i + 3], 3) if c == "%" else (c, 1)
            if last is None or not number.isdigit() or len(number) != step - (step > 1):
                raise ValueError(f"bad ring closure at {i}")
            if int(number) in rings:
                other, order = rings.pop(int(number))
                connect(other, last, bond if bond is not None else order)
            else:
                rings[int(number)] = last, bond
            bond, i = None, i + step
        elif c == "(":
            stack.append(last)
            i += 1
        elif c == ")":
            if not stack:
                raise ValueError(f"unopened branch at {i}")
            last, i = stack.pop(), i + 1
        elif c == ".":
            if bond is not None:
                raise ValueError(f"bond before a dot at {i}")
            last, i = None, i + 1
        else:
            raise ValueError(f"unknown symbol {c!r} at {i}")
    if rings or stack or bond is not None:
        raise ValueError("open ring, branch or bond at the end")
    used = [0.0] * len(nodes)
    for e in edges:
        used[e["u"]] += e["bond_order"]
        used[e["v"]] += e["bond_order"]
    for n in plain:
        # Two aromatic bonds take three places of a carbon; a third one takes the fourth.
        usual, need = VALENCES.get(nodes[n]["element"], (0,)), int(used[n])
        if nodes[n]["aromatic"]:
            usual = usual[:1]
        nodes[n]["hcount"] = max(0, next((v for v in usual if v >= need), need) - need)
    return nodes, edges


def parse_reaction(text: str | None) -> tuple[dict, dict]:
    """The reactant and the product graph of ``left>>right``."""
    if text is None:
        raise ValueError("missing")
    sides = text.strip().split(">>")
    if len(sides) != 2:
        raise ValueError("not of the form left>>right")
    graphs = [parse_smiles(s.strip()) for s in sides]
    return tuple({"nodes": n, "edges": e} for n, e in graphs)  # type: ignore[return-value]


def read_rsmi(reactions: DataFrame, key: str = "reaction_id", text: str = "rsmi") -> DataFrame:
    """``<key>, reactant, product, error``: one row for each input row; works on streams, too."""
    kind = reactions.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, reactant {GRAPH}, product {GRAPH}, error string"
    shape = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    r, p = parse_reaction(s)
                    rows.append({key: k, "reactant": r, "product": p, "error": None})
                except ValueError as e:
                    rows.append({key: k, "reactant": None, "product": None, "error": str(e)})
            yield pa.RecordBatch.from_pylist(rows, schema=shape)

    return spread(reactions.select(key, text)).mapInArrow(run, schema)


def graph_tables(parsed: DataFrame, key: str = "reaction_id") -> tuple[DataFrame, DataFrame]:
    """Node and edge tables with graph ids ``<key>:R`` and ``<key>:P``."""
    sides = F.array(*[F.struct(F.concat(F.col(key).cast("string"), F.lit(f":{s}")).alias("graph_id"), F.col(c).alias("g")) for s, c in (("R", "reactant"), ("P", "product"))])
    each = parsed.where("error is null").select(F.explode(sides).alias("x")).select("x.graph_id", "x.g")
    nodes = each.select("graph_id", F.explode("g.nodes").alias("n")).select("graph_id", "n.*")
    edges = each.select("graph_id", F.explode("g.edges").alias("e")).select("graph_id", "e.*")
    return nodes, edges
