"""Streams: row-local fingerprints without state, and windowed token counts with a watermark."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molweave.model import MISSING
from molweave.operators.tokens import MORGAN, WL
from molweave.session import spread
from molweave.sources.rsmi import parse_reaction


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def _text(value: object) -> str:
    return MISSING if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def graph_tokens(nodes: list[dict], edges: list[dict], radius: int, tags: tuple[str, str, str] = WL) -> Counter:
    """Refinement tokens of one graph; the same numbers as the relational plan."""
    degree: Counter = Counter()
    near: dict[int, list[tuple[str, int]]] = {n["node_id"]: [] for n in nodes}
    for e in edges:
        bond = f"{_hash(f'{tags[1]}|' + (MISSING if e['bond_order'] is None else str(round(e['bond_order'] * 10)))):019d}"
        for a, b in ((e["u"], e["v"]), (e["v"], e["u"])):
            degree[a] += 1
            near[a].append((bond, b))
    now = {n["node_id"]: _hash(f"{tags[0]}|" + "|".join([*[_text(n[c]) for c in ("element", "aromatic", "charge", "hcount")], str(degree[n["node_id"]])])) for n in nodes}
    out = Counter(now.values())
    for k in range(1, radius + 1):
        now = {n: _hash(f"{tags[2]}|{k}|{t}|" + ",".join(sorted(f"{bond}:{now[m]:019d}" for bond, m in near[n]))) for n, t in now.items()}
        out.update(now.values())
    return out


def row_local_bits(reactions: DataFrame, radius: int = 2, bits: int = 1024, seed: int = 1, morgan: bool = False) -> DataFrame:
    """``reaction_id, bits, error`` of delta-mode parity fingerprints, each row by itself: no shuffle and no
    state, for batch and streaming DataFrames alike."""
    tags = MORGAN if morgan else WL

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, errors = [], []
            for text in batch.column(1).to_pylist():
                try:
                    r, p = (graph_tokens(g["nodes"], g["edges"], radius, tags) for g in parse_reaction(text))
                except ValueError as e:
                    found.append(None)
                    errors.append(str(e))
                    continue
                odd: set[int] = set()
                for t in r.keys() | p.keys():
                    if d := p[t] - r[t]:
                        odd ^= {_hash(f"pf|{seed}|{2 * t + (d < 0)}") % bits}
                found.append(sorted(odd))
                errors.append(None)
            yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(pa.int32())), pa.array(errors, pa.string())], ["reaction_id", "bits", "error"])

    return spread(reactions.select("reaction_id", "rsmi")).mapInArrow(run, "reaction_id long, bits array<int>, error string")


def windowed_counts(stream: DataFrame, time_col: str, key: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """``start, key, n`` by tumbling window; rows later than the watermark are dropped by definition."""
    stream = stream.withColumn(time_col, F.col(time_col).cast("timestamp"))
    counted = stream.withWatermark(time_col, late).groupBy(F.window(time_col, window), F.col(key)).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), key, "n")
