"""Schemas and label texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NODES = "graph_id string, node_id bigint, element string, aromatic boolean, charge int, hcount int, attrs map<string,string>"
EDGES = "graph_id string, u bigint, v bigint, bond_order double, attrs map<string,string>"
NODE_ATTRS = ("element", "aromatic", "charge", "hcount")
EDGE_ATTRS = ("bond_order",)
MISSING = "~"


def attr(name: str, columns: list[str]) -> Column:
    """An attribute as text, from its column or from the map of extra attributes; ``~`` where missing.

    Bond orders are written as whole tenths, so that no engine's way to print doubles matters."""
    if name == "bond_order":
        value = F.round(F.col(name) * 10).cast("bigint").cast("string")
    elif name in columns:
        value = F.col(name).cast("string")
    elif "attrs" in columns:
        value = F.col("attrs")[name]
    else:
        value = F.lit(None).cast("string")
    return F.coalesce(value, F.lit(MISSING))


def label(attrs: tuple[str, ...], columns: list[str], *more: Column) -> Column:
    return F.concat_ws("|", *[attr(a, columns) for a in attrs], *more)
