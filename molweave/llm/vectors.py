"""Sketch vectors as classes of exact copies, packed into bits for shuffles and Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 256
MIN_COSINE = 0.6
#: The eight values of each byte of a unit vector without zeros.
_SIGNS = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(WIDTH))


def pack(x: np.ndarray) -> list[bytes]:
    """Bits of the +1 of each row; where a row holds zeros, the bits of its -1 follow."""
    plus, minus = np.packbits(x > 0, axis=1), np.packbits(x < 0, axis=1)
    zeros = (x == 0).any(1)
    return [p.tobytes() + m.tobytes() if z else p.tobytes() for p, m, z in zip(plus, minus, zeros)]


def unpack(packed: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Rows of -1, 0, +1 as float32."""
    size = -(-width // 8)
    short = np.array([len(b) == size for b in packed], bool)
    out = np.empty((len(packed), width), np.float32)
    if short.any():
        raw = np.frombuffer(b"".join(b for b in packed if len(b) == size), np.uint8).reshape(-1, size)
        out[short] = np.unpackbits(raw, axis=1)[:, :width].astype(np.float32) * 2 - 1
    if not short.all():
        raw = np.frombuffer(b"".join(b for b in packed if len(b) != size), np.uint8).reshape(-1, 2 * size)
        both = np.unpackbits(raw, axis=1).astype(np.float32)
        out[~short] = both[:, :width] - both[:, size * 8 : size * 8 + width]
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit vectors of a column of packed bits, by bytes where a vector holds no zeros."""
    column = pa.chunked_array(column.chunks if isinstance(column, pa.ChunkedArray) else [column], column.type).combine_chunks().cast(pa.large_binary())
    short = np.asarray(pc.binary_length(column)) == WIDTH // 8
    plain, rest = column.filter(pa.array(short)), column.filter(pa.array(~short))
    start = int(np.frombuffer(plain.buffers()[1], np.int64)[plain.offset]) if len(plain) else 0
    raw = np.frombuffer(plain.buffers()[2], np.uint8, len(plain) * WIDTH // 8, start) if len(plain) else np.zeros(0, np.uint8)
    signs = _SIGNS[raw].reshape(-1, WIDTH)
    if not len(rest):
        return signs
    out = np.empty((len(column), WIDTH), np.float32)
    out[short], out[~short] = signs, unit(unpack(rest.to_pylist()))
    return out


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, col = batch.column(0), batch.column(1)
        full = pc.and_(ids.is_valid(), pc.fill_null(pc.equal(pc.list_value_length(col), WIDTH), False))
        ids, values = ids.filter(full), col.filter(full).flatten()
        if not len(ids):
            continue
        known = np.asarray(values.is_valid()).reshape(-1, WIDTH)
        x = np.asarray(pc.fill_null(values, 0)).reshape(-1, WIDTH)
        ok = known.all(1) & ((x >= -1) & (x <= 1)).all(1) & (x != 0).any(1)
        yield pa.record_batch([ids.filter(pa.array(ok)), pa.array(pack(x[ok]), pa.binary())], ["fp_id", "bits"])


def members(fingerprints: DataFrame) -> DataFrame:
    """``fp_id, bits`` of the rows that take part: of full width, without nulls, values +1, -1 or 0 and not
    all of them 0. Equal sketches have equal bits."""
    return fingerprints.select("fp_id", "sketch").mapInArrow(_members, "fp_id long, bits binary")


def sample(uniq: DataFrame, total: int, bound: int) -> np.ndarray:
    """At most ``bound`` different vectors, chosen by the hash of their id; a documented bound."""
    share = min(1.0, 1.2 * bound / max(total, 1))
    picked = uniq.where(F.pmod(F.xxhash64(F.lit("sample"), "uid"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = picked.select("uid", "bits").orderBy(F.xxhash64(F.lit("order"), "uid"), "uid").limit(bound).collect()
    rows.sort(key=lambda r: r["uid"])
    return unpack([bytes(r["bits"]) for r in rows]) if rows else np.zeros((0, WIDTH), np.float32)
