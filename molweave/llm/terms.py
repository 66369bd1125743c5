"""Problem 5: occurrences and records of every token by burst-trie counting.

Tokens are 60-bit numbers; their 15 hexadecimal digits are the letters of the trie. A census of prefixes
decides how deep the routing goes where: a prefix that holds much is burst into its 16 children, below three
digits by a further census of what is still too much. Behind the one shuffle that cleans the rows, each worker
counts its rows in a burst trie: containers of sorted tokens with their occurrence and record counters, which
burst into 16 children when they overflow. A worker sends the subtries of each route once, with tokens as
differences and counters in as few bytes as they need; the matching subtries of a route meet in one task,
where they are merged into one trie. A token that holds a third of all rows is one entry of each worker's trie.

Defined results: tokens outside the 60 bits have a container and a route of their own; null arrays, null tokens
and null ids are left out; a record that holds a token in several rows counts once, with the largest of its
occurrence counts, so that rows delivered again change nothing; rows with net change 0 are no occurrence; the
occurrences of ``delta`` are the sum of absolute changes; an empty field gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molweave.session import shuffle_parts

DIGITS = 15
CENSUS_DIGITS = 3
COMMON_SHARE = 0.1
CONTAINER = 4_096
ADD_ROWS = 500_000
FLUSH_TERMS = 2_000_000

Counts = tuple[np.ndarray, np.ndarray, np.ndarray]  # tokens in order, occurrences, records


def _count_in_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``record, tokens`` to ``record, token, n``: occurrences within each array."""
    for batch in batches:
        column = batch.column(1)
        tokens = column.flatten()
        known = np.asarray(tokens.is_valid())
        row = np.repeat(np.arange(batch.num_rows), np.diff(column.offsets.to_numpy()))[known]
        tokens = np.asarray(tokens.drop_null(), np.int64)
        order = np.lexsort((tokens, row))
        row, tokens = row[order], tokens[order]
        first = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(tokens) != 0)]) if len(row) else np.zeros(0, np.int64)
        n = np.diff(np.r_[first, len(row)])
        yield pa.record_batch([batch.column(0).take(pa.array(row[first])), pa.array(tokens[first]), pa.array(n)], ["record", "token", "n"])


def held_rows(results: DataFrame, deltas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of the two tables that hold a token."""
    runs = results.where("reaction_id is not null").where(F.exists("tokens_r", lambda t: t.isNotNull())).select(F.col("reaction_id").alias("record"), "tokens_r")
    net = deltas.where("delta <> 0 and reaction_id is not null and token is not null").select(F.col("reaction_id").alias("record"), "token", F.abs("delta").cast("long").alias("n"))
    return runs, net


def term_rows(runs: DataFrame, net: DataFrame) -> DataFrame:
    """``field, record, token, n``: one row for each token of each record. One shuffle, after partial maxima."""
    runs = runs.mapInArrow(_count_in_rows, "record long, token long, n long").select(F.lit("tokens_r").alias("field"), "record", "token", "n")
    rows = runs.unionByName(net.select(F.lit("delta").alias("field"), "record", "token", "n"))
    return rows.groupBy("field", "record", "token").agg(F.max("n").alias("n"))


def routes(rows: DataFrame, parts: int) -> dict[str, np.ndarray]:
    """First tokens of the routing prefixes of each field: at most 4,096 of three digits, and below those
    at most 16 children a digit for each of the few that hold too much.

    A prefix is burst while more than a 4 ``parts``-th of the field's different tokens lie under it.
    """
    shift = 4 * (DIGITS - CENSUS_DIGITS)
    census = rows.groupBy("field", F.shiftrightunsigned("token", shift).alias("p")).agg(F.approx_count_distinct("token").alias("n")).collect()
    out, limits, crowded = {}, {}, {}
    for field in {r["field"] for r in census}:
        load = np.zeros(16**CENSUS_DIGITS, np.int64)
        for r in census:
            if r["field"] == field:
                load[min(r["p"], len(load) - 1)] += r["n"]
        limit = max(1, load.sum() // (4 * parts))
        starts: list[int] = []

        def burst(lo: int, width: int) -> None:
            if width > 1 and load[lo : lo + width].sum() > limit:
                for i in range(16):
                    burst(lo + i * (width // 16), width // 16)
            else:
                starts.append(lo << shift)
                if width == 1 and load[lo] > limit:
                    crowded.setdefault(field, []).append(lo)

        burst(0, len(load))
        out[field], limits[field] = np.array(starts, np.int64), limit
    digits = CENSUS_DIGITS
    while crowded and digits < DIGITS:
        at = F.shiftrightunsigned("token", 4 * (DIGITS - digits))
        below = rows.where(reduce(or_, [(F.col("field") == field) & at.isin(p) for field, p in crowded.items()]))
        digits += 1
        shift = 4 * (DIGITS - digits)
        census = below.groupBy("field", F.shiftrightunsigned("token", shift).alias("p")).agg(F.approx_count_distinct("token").alias("n")).collect()
        for field, parents in crowded.items():
            children = [(16 * p + i) << shift for p in parents for i in range(16)]
            out[field] = np.union1d(out[field], np.array(children, np.int64))
        crowded = {}
        for r in census:
            if r["n"] > limits[r["field"]]:
                crowded.setdefault(r["field"], []).append(r["p"])
    return out


def _merged(parts: list[Counts]) -> Counts:
    tokens, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    sums = []
    for k in (1, 2):  # whole numbers: sums of doubles would be inexact beyond 2^53
        s = np.zeros(len(tokens), np.int64)
        np.add.at(s, at, np.concatenate([p[k] for p in parts]))
        sums.append(s)
    return tokens, *sums


class BurstTrie:
    """Counters of tokens. A node is the number of digits of its prefix and the prefix; inner nodes have children
    only, leaves a container. A container of more than ``CONTAINER`` tokens bursts by its next digit."""

    OUTSIDE = (0, -1)

    def __init__(self) -> None:
        self.inner: set[tuple[int, int]] = set()
        self.leaves: dict[tuple[int, int], Counts] = {}
        self.terms = 0

    def add(self, tokens: np.ndarray, n: np.ndarray, records: np.ndarray) -> None:
        """Different tokens in ascending order with what is to be added to their counters."""
        lo, hi = np.searchsorted(tokens, [0, 1 << 60])
        for part in (slice(0, lo), slice(hi, None)):
            if len(tokens[part]):
                self._put(self.OUTSIDE, (tokens[part], n[part], records[part]))
        if hi > lo:
            self._add((0, 0), (tokens[lo:hi], n[lo:hi], records[lo:hi]))

    def _put(self, node: tuple[int, int], new: Counts) -> Counts:
        old = self.leaves.get(node)
        held = _merged([old, new]) if old else new
        self.leaves[node] = held
        self.terms += len(held[0]) - (len(old[0]) if old else 0)
        return held

    def _add(self, node: tuple[int, int], new: Counts) -> None:
        depth, prefix = node
        if node not in self.inner:
            held = self._put(node, new)
            if len(held[0]) <= CONTAINER or depth == DIGITS:
                return
            self.inner.add(node)
            self.terms -= len(held[0])
            new = self.leaves.pop(node)
        shift = 4 * (DIGITS - depth - 1)
        cuts = np.searchsorted(new[0], [(16 * prefix + i) << shift for i in range(1, 16)])
        for i, (s, e) in enumerate(zip([0, *cuts], [*cuts, len(new[0])])):
            if e > s:
                self._add((depth + 1, 16 * prefix + i), tuple(x[s:e] for x in new))

    def containers(self) -> Iterator[Counts]:
        """All containers in the order of their tokens; those outside the 60 bits first."""
        outside = self.leaves.get(self.OUTSIDE)
        if outside:
            yield outside
        for depth, prefix in sorted((k for k in self.leaves if k != self.OUTSIDE), key=lambda k: k[1] << 4 * (DIGITS - k[0])):
            yield self.leaves[depth, prefix]


def _short(x: np.ndarray) -> bytes:
    """Whole numbers of at least 0 in as few bytes as the largest needs, behind their width."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or x.max(initial=0) < 1 << 8 * w)
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _long(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<u{packed[0]}", offset=1).astype(np.int64)


SUBTRIES = "field string, route int, first long, steps binary, n binary, records binary"


def _subtries(table: dict[str, np.ndarray]):
    """Rows to the subtries of each route."""

    def emit(tries: dict[str, BurstTrie]) -> Iterator[pa.RecordBatch]:
        for field, trie in tries.items():
            rows: list[tuple] = []
            for tokens, n, records in trie.containers():
                route = np.searchsorted(table[field], tokens, "right") - 1
                first = np.flatnonzero(np.r_[True, np.diff(route) != 0])
                for s, e in zip(first, [*first[1:], len(tokens)]):
                    # Differences of tokens outside the 60 bits can exceed 63 bits: those travel one by one.
                    for i, j in [(s, e)] if 0 <= tokens[s] and tokens[e - 1] < 1 << 60 else [(k, k + 1) for k in range(s, e)]:
                        rows.append((route[i], tokens[i], _short(np.diff(tokens[i:j])), _short(n[i:j]), _short(records[i:j])))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()
            yield pa.record_batch([pa.array([field] * len(rows), pa.string()), *[pa.array(c, t) for c, t in zip(columns, kinds)]], ["field", "route", "first", "steps", "n", "records"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, BurstTrie] = {}
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        rows = 0

        def add() -> None:
            nonlocal rows
            for field, parts in held.items():
                tokens, n = (np.concatenate(x) for x in zip(*parts))
                tries.setdefault(field, BurstTrie()).add(*_merged([(tokens, n, np.ones(len(tokens), np.int64))]))
            held.clear()
            rows = 0

        for batch in batches:
            fields = np.asarray(batch.column(0).to_pylist(), object)
            tokens, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for field in set(fields):
                mine = fields == field
                held.setdefault(field, []).append((tokens[mine], n[mine]))
            rows += batch.num_rows
            if rows >= ADD_ROWS:
                add()
                if sum(t.terms for t in tries.values()) >= FLUSH_TERMS:
                    yield from emit(tries)
                    tries.clear()
        add()
        yield from emit(tries)

    return run


def _merge(table: pa.Table) -> pa.Table:
    """Merge the matching subtries of one route into one trie, some at a time."""
    trie, pending, held = BurstTrie(), [], 0
    for first, steps, n, records in zip(*[table.column(c).to_pylist() for c in ("first", "steps", "n", "records")]):
        pending.append((np.cumsum(np.r_[first, _long(steps)]), _long(n), _long(records)))
        held += len(pending[-1][0])
        if held >= ADD_ROWS:
            trie.add(*_merged(pending))
            pending, held = [], 0
    if pending:
        trie.add(*_merged(pending))
    tokens, n, records = (np.concatenate(x) for x in zip(*trie.containers()))
    return pa.table({"field": pa.array([table.column("field")[0].as_py()] * len(tokens), pa.string()), "token": tokens, "occurrences": n, "records": records})


def term_counts(results: DataFrame, deltas: DataFrame) -> DataFrame:
    """``field, token, occurrences, records, mark``: every token; mark is rare, common or null."""
    runs, net = held_rows(results, deltas)
    everything = runs.select(F.lit("tokens_r").alias("field"), F.explode("tokens_r").alias("token")).where("token is not null").unionByName(net.select(F.lit("delta").alias("field"), "token"))
    table = routes(everything, shuffle_parts(results.sparkSession))
    ids = runs.select(F.lit("tokens_r").alias("field"), "record").unionByName(net.select(F.lit("delta").alias("field"), "record"))
    totals = {r["field"]: r["n"] for r in ids.distinct().groupBy("field").agg(F.count("*").alias("n")).collect()}
    subtries = term_rows(runs, net).select("field", "token", "n").mapInArrow(_subtries(table), SUBTRIES)
    counted = subtries.groupBy("field", "route").applyInArrow(_merge, "field string, token long, occurrences long, records long")
    held = F.lit(None).cast("long")
    for field, n in totals.items():
        held = F.when(F.col("field") == field, F.lit(n)).otherwise(held)
    mark = F.when(F.col("records") == 1, "rare").when(F.col("records") > held * COMMON_SHARE, "common")
    return counted.withColumn("mark", mark)
