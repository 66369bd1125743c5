"""Similarities of sketches and token sets, as column expressions and as searches.

A search takes the queries of a stated set (every reaction whose id is divisible by 100) against all
rows. Blocks of queries are compared with blocks of rows. Ties are broken by the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from molweave.session import cut, shuffle_parts

QUERY_STEP = 100
GRID_ROWS = 50_000
GRID_QUERIES = 2_000
SLICE_ROWS = 256


def tanimoto(a: Column, b: Column) -> Column:
    """Of the low bits of two arrays; 0 for an empty union; the query fails on unequal lengths."""
    both = F.aggregate(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y).bitwiseAND(F.lit(1))), F.lit(0), lambda acc, x: acc + x.cast("int"))
    any_ = F.aggregate(F.zip_with(a, b, lambda x, y: x.bitwiseOR(y).bitwiseAND(F.lit(1))), F.lit(0), lambda acc, x: acc + x.cast("int"))
    return _same_length(a, b, F.when(any_ == 0, F.lit(0.0)).otherwise(both / any_))


def equal_share(a: Column, b: Column) -> Column:
    """Share of equal places: the estimate of the Jaccard similarity from MinHash signatures."""
    hits = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda acc, x: acc + x)
    return _same_length(a, b, F.when(F.size(a) == 0, F.lit(None).cast("double")).otherwise(hits / F.size(a)))


def _same_length(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("the lengths differ")).cast("double"))


def srp_cosine(a: Column, b: Column) -> Column:
    """``2 p - 1`` for the share p of equal signs."""
    return equal_share(a, b) * 2 - 1


def srp_angle_cosine(a: Column, b: Column) -> Column:
    """``cos(pi (1 - p))``, the estimate by the angle."""
    return F.cos(F.lit(3.141592653589793) * (1 - equal_share(a, b)))


def queries_of(rows: DataFrame, step: int = QUERY_STEP) -> DataFrame:
    return rows.where(F.col("reaction_id") % step == 0)


def _packed_weights(deltas: DataFrame) -> DataFrame:
    """``reaction_id, tokens, weights, l1, l2``: a row for each reaction."""
    w = deltas.where("delta <> 0 and token is not null and reaction_id is not null")
    own = F.collect_list(F.struct("token", "delta"))
    packed = w.groupBy("reaction_id").agg(own.alias("own"), F.sum(F.abs("delta")).alias("l1"), F.sum(F.col("delta") * F.col("delta")).alias("l2"))
    return packed.select("reaction_id", F.col("own.token").alias("tokens"), F.col("own.delta").alias("weights"), "l1", "l2")


def _flat_lists(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and values of a column of lists."""
    n = np.diff(lists.offsets.to_numpy())
    return np.repeat(np.arange(len(lists)), n), lists.flatten().to_numpy()


def _asked(part: pa.Table, column: Callable) -> tuple[np.ndarray, ...]:
    """Ids and sums of some queries; their tokens in order, with query and weight."""
    row, token = _flat_lists(part.column("tokens").combine_chunks())
    weight = _flat_lists(part.column("weights").combine_chunks())[1]
    order = np.argsort(token, kind="stable")
    return *(column(part, c) for c in ("reaction_id", "l1", "l2")), row[order], token[order], weight[order]


def _weighted_block(normalize: bool, queries: int):
    """``query_id, reaction_id, weighted_jaccard, cosine`` of one block of queries and one of rows, in slices of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        asks = np.asarray(table.column("asks").to_numpy(zero_copy_only=False), bool)
        side = lambda mark: table.take(pa.array(np.flatnonzero(mark))).combine_chunks()
        ask, held = side(asks), side(~asks)
        column = lambda t, name: t.column(name).combine_chunks().to_numpy() if len(t) else np.zeros(0, np.int64)
        if not len(ask) or not len(held):
            return
        asked = [_asked(ask.slice(at, queries).combine_chunks(), column) for at in range(0, len(ask), queries)]
        for at in range(0, len(held), SLICE_ROWS):
            part = held.slice(at, SLICE_ROWS).combine_chunks()
            n, other = len(part), column(part, "reaction_id")
            m1, m2 = column(part, "l1"), column(part, "l2")
            r, t = _flat_lists(part.column("tokens").combine_chunks())
            d = _flat_lists(part.column("weights").combine_chunks())[1]
            for ids, l1, l2, row, token, weight in asked:
                first = np.searchsorted(token, t, "left")
                met = np.searchsorted(token, t, "right") - first
                # A row for each token that a query and a row share.
                x = np.repeat(np.arange(len(t)), met)
                y = np.repeat(first - np.r_[0, np.cumsum(met)[:-1]], met) + np.arange(len(x))
                a, b, qr, rr = weight[y], d[x], row[y], r[x]
                left, right = (np.abs(a), np.abs(b)) if not normalize else (np.abs(a) * m1[rr], np.abs(b) * l1[qr])
                cell = qr * n + rr
                low, dot, seen = np.zeros(len(ids) * n, np.int64), np.zeros(len(ids) * n, np.int64), np.zeros(len(ids) * n, bool)
                np.add.at(low, cell, np.where((a > 0) == (b > 0), np.minimum(left, right), 0))
                np.add.at(dot, cell, a * b)
                seen[cell] = True
                i, j = np.nonzero(seen.reshape(-1, n) & (ids[:, None] != other))
                low, dot = low[i * n + j], dot[i * n + j]
                both = l1[i] * m1[j] * 2 if normalize else l1[i] + m1[j]
                # Python's whole numbers where a product can need more than 64 bits.
                own = l2 if int(l2.max()) * int(m2.max()) < 1 << 63 else l2.astype(object)
                columns = ids[i], other[j], low / (both - low), dot / np.sqrt((own[i] * m2[j]).astype(np.float64))
                yield pa.record_batch([pa.array(c) for c in columns], ["query_id", "reaction_id", "weighted_jaccard", "cosine"])

    return run


def weighted_search(deltas: DataFrame, step: int = QUERY_STEP, normalize: bool = False) -> DataFrame:
    """``query_id, reaction_id, weighted_jaccard, cosine`` of signed weights for all pairs that share a token.

    Sum of minima over sum of maxima of both channels, and cosine, in whole numbers up to one division.
    With ``normalize`` each side is first divided by the sum of its absolute weights. Blocks of queries meet blocks of
    rows, each reaction in one row, so that a pair comes out where it is met and is never shuffled. A task holds as many
    queries as rows and takes them ``GRID_QUERIES`` at a time: each block of queries takes another copy of all rows."""
    rows = cut(_packed_weights(deltas))
    total, largest = rows.agg(F.count("*"), F.coalesce(F.max("l1"), F.lit(0))).first()
    if normalize and 2 * largest * largest >= 1 << 63:
        raise ArithmeticError("the weights are too large for whole numbers of 64 bits")
    asks, held = _blocks(rows, total, step, GRID_ROWS, 4 * rows.sparkSession.sparkContext.defaultParallelism)
    return asks.unionByName(held).groupBy("qb", "rb").applyInArrow(_weighted_block(normalize, GRID_QUERIES), "query_id long, reaction_id long, weighted_jaccard double, cosine double")


def top(pairs: DataFrame, score: str, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc(score), "reaction_id")
    return pairs.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)


# Kernels: scores of blocks of sketches, one row a query and one column a row; NaN for pairs that do not count.

Kernel = Callable[[list, list], np.ndarray]


def tanimoto_scores(a: list, b: list) -> np.ndarray:
    """Of lists of set bits; pairs without a common bit do not count."""
    bits = 1 + max((max(x, default=0) for x in [*a, *b]), default=0)
    marks = []
    for lists in (a, b):
        m = np.zeros((len(lists), bits), np.float32)
        m[np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([v for x in lists for v in x], np.int64)] = 1
        marks.append(m)
    both = (marks[0] @ marks[1].T).astype(np.float64)  # whole numbers, exact in float32
    either = marks[0].sum(1, dtype=np.float64)[:, None] + marks[1].sum(1, dtype=np.float64) - both
    return np.where(both > 0, both / np.maximum(either, 1), np.nan)


def equal_scores(a: list, b: list) -> np.ndarray:
    x, y = np.array(a, np.int64), np.array(b, np.int64)
    hits = np.zeros((len(x), len(y)), np.int32)
    for j in range(x.shape[1]):
        hits += x[:, j, None] == y[:, j]
    return hits / x.shape[1]


def sign_scores(a: list, b: list) -> np.ndarray:
    x, y = np.array(a, np.float32), np.array(b, np.float32)
    equal = (x.shape[1] + (x @ y.T).astype(np.float64)) / 2
    return equal / x.shape[1] * 2 - 1


def best_of_block(scores: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Query and column of the k best of each query; ``ids`` ascend, so that the first of equals is the smallest."""
    scores = np.where(np.isnan(scores) | (query_ids[:, None] == ids), -np.inf, scores)
    rows, cols = [], []
    for i, s in enumerate(scores):
        limit = np.partition(s, -k)[-k] if len(s) > k else -np.inf
        above = np.flatnonzero(s > limit)
        level = np.flatnonzero(s == limit)[: max(0, k - len(above))] if limit > -np.inf else []
        cols += [above, np.asarray(level, np.int64)]
        rows += [i] * (len(above) + len(level))
    return np.array(rows, np.int64), np.concatenate(cols) if cols else np.zeros(0, np.int64)


def _blocks(rows: DataFrame, total: int, step: int, queries: int = 0, most: int = 1 << 30) -> tuple[DataFrame, DataFrame]:
    """Queries and rows with their blocks ``qb, rb``: each block of queries meets each block of rows once."""
    row_blocks, query_blocks = max(1, -(-total // GRID_ROWS)), max(1, -(-total // (step * (queries or GRID_QUERIES))))
    # Small collections use all cores, too; no more than ``most`` blocks for that, as each takes a copy of the queries.
    row_blocks = max(row_blocks, -(-min(most, shuffle_parts(rows.sparkSession)) // query_blocks)) if total > 1_000 else row_blocks
    block = lambda n, salt: F.pmod(F.xxhash64("reaction_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries_of(rows, step).select("*", block(query_blocks, 1).alias("qb"), every(row_blocks).alias("rb"), F.lit(True).alias("asks"))
    held = rows.select("*", every(query_blocks).alias("qb"), block(row_blocks, 2).alias("rb"), F.lit(False).alias("asks"))
    return asked, held


def grid_search(sketches: DataFrame, column: str, kernel: Kernel, name: str, step: int = QUERY_STEP, k: int = 5) -> DataFrame:
    """``query_id, reaction_id, <name>, rank``: the k best rows for each stated query, all rows compared.

    Queries and rows are cut into blocks by hash, and each task compares one block of queries with one of rows; it
    sends k rows a query. Rows with a null sketch take no part."""
    rows = cut(sketches.where(F.col("reaction_id").isNotNull() & F.col(column).isNotNull()).select("reaction_id", F.col(column).alias("v")))
    total = rows.count()
    asked, held = _blocks(rows, total, step)

    def run(table: pa.Table) -> pa.Table:
        ids, asks = table.column("reaction_id").to_numpy(), np.asarray(table.column("asks").to_numpy(zero_copy_only=False), bool)
        v = table.column("v").to_pylist()
        q, r = np.flatnonzero(asks), np.flatnonzero(~asks)
        r = r[np.argsort(ids[r], kind="stable")]
        out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        held_v = [v[i] for i in r]
        for at in range(0, len(q) if len(r) else 0, 128):
            part = q[at : at + 128]
            scores = kernel([v[i] for i in part], held_v)
            i, j = best_of_block(scores, ids[part], ids[r], k)
            for o, x in zip(out, (ids[part[i]], ids[r[j]], scores[i, j])):
                o.append(x)
        return pa.table({n: np.concatenate(o) for n, o in zip(("query_id", "reaction_id", name), out)})

    met = asked.unionByName(held).groupBy("qb", "rb").applyInArrow(run, f"query_id long, reaction_id long, {name} double")
    return top(met, name, k)


def bit_search(bit_rows: DataFrame, step: int = QUERY_STEP, k: int = 5) -> DataFrame:
    """``query_id, reaction_id, tanimoto, rank``: the k most similar fingerprints that share a set bit."""
    packed = bit_rows.groupBy("reaction_id").agg(F.collect_set("bit").alias("bits"))
    return grid_search(packed, "bits", tanimoto_scores, "tanimoto", step, k)
