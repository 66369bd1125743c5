"""Problem 1: duplicates hidden by formatting differences, found through merged Bloom filters.

The canonical form is computed once a row inside the JVM and kept as its 128-bit digest: from there on a row
is 24 bytes, however long its string. Each input partition builds, per filter block, the bit positions it saw
once and more than once; merging two partitions puts a bit seen by both into the repeat filter. Only rows
whose bits all lie in the repeat filter can have a copy: only these are shuffled and grouped by their
digest, all others are singletons at once. Beyond the broadcast limit the filter does not go to the rows;
digests (never strings) meet their block by shuffle. Two unlike strings share a digest with a probability below
1e-18 among ten billion rows, so that groups are exact for all that can be stored.

Defined results: null, blank or one-sided strings have no canonical form and are left out; a molecule
list that is empty after cleaning counts as a missing side; ties do not occur as ``record_id`` is
unique, and of repeated ``record_id``s the smallest stands for the group; extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molweave.session import cut, join_grouped

BLOCK_BITS = 1 << 16
WORDS = BLOCK_BITS // 64
BITS_PER_ROW = 16
BROADCAST_LIMIT = 32 << 20
FLUSH_ROWS = 4_000_000

# Characters without meaning, arrow spellings, separators between molecules.
INVISIBLE = r"[\s\p{Z}\p{Cc}\p{Cf}\"'`´‘’‚“”„‹›«]+"
ARROWS = r"(?<![-=~–—])(?:[-=~–—]*+[>→⇒⟶➔»])++"
SEPARATOR = r"[.;,|·•+]+"
# Marks that no cleaned text can hold, as control characters are removed first.
OPEN, PLUS, AROMATIC = "\u0004", "\u0001", "\u0002"


def sides(text: Column) -> Column:
    """The sorted molecules of each side between arrows, joined by dots; two texts for a whole reaction.

    Brackets that are closed before the next bracket or arrow protect their ``+``. Aromatic one-letter atoms
    are marked before letter case is dropped. All patterns are linear in the length of the text."""
    s = F.regexp_replace(text, INVISIBLE, "")
    s = F.regexp_replace(s, "^»|»$", "")
    s = F.regexp_replace(s, ARROWS, ">")
    s = F.regexp_replace(s, r"\[(?=[^\[\]>]*+\])", OPEN)
    s = F.regexp_replace(s, rf"(\G(?!^)|{OPEN})([^\]+]*+)\+", f"$1$2{PLUS}")
    s = F.regexp_replace(s, rf"({OPEN}[^\]]*+\])|(c(?![lL])|b(?![rR])|[nops])", f"$1{AROMATIC}$2")
    s = F.regexp_replace(s, rf"{OPEN}(\d*+)([bcnops])(?=[hH]?[^a-zA-Z])", f"{OPEN}$1{AROMATIC}$2")
    return F.transform(F.split(F.upper(s), ">"), lambda side: F.array_join(F.sort_array(F.filter(F.split(side, SEPARATOR), lambda m: m != "")), "."))


def canonical_rows(reactions: DataFrame) -> DataFrame:
    """``record_id, canon``: the one spelling shared by all copies; null without two sides. Two projections,
    so that the sides are computed once."""
    parts = reactions.where("record_id is not null").select("record_id", sides(F.col("rsmi")).alias("x"))
    whole = (F.size("x") == 2) & (F.col("x")[0] != "") & (F.col("x")[1] != "")
    return parts.select("record_id", F.when(whole, F.array_join("x", ">")).alias("canon"))


def _positions(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Global bit numbers (block * BLOCK_BITS + bit) of each hash; two bits in one block."""
    u = h.view(np.uint64)
    base = ((u >> np.uint64(32)) % np.uint64(blocks)) * np.uint64(BLOCK_BITS)
    return base + (u & np.uint64(0xFFFF)), base + ((u >> np.uint64(16)) & np.uint64(0xFFFF))


def _pieces(h: np.ndarray, blocks: int) -> pa.RecordBatch:
    a, b = _positions(h, blocks)
    seen, times = np.unique(np.concatenate([a, b[a != b]]), return_counts=True)
    block = (seen // np.uint64(BLOCK_BITS)).astype(np.int64)
    low = (seen % np.uint64(BLOCK_BITS)).astype(np.uint16)
    starts = np.unique(block, return_index=True)
    ends = np.append(starts[1][1:], len(seen))
    once, more = [], []
    for s, e in zip(starts[1], ends):
        once.append(low[s:e].tobytes())
        more.append(low[s:e][times[s:e] > 1].tobytes())
    return pa.record_batch([pa.array(starts[0], pa.int64()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], ["block", "once", "more"])


def _build(blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            n += len(held[-1])
            if n >= FLUSH_ROWS:
                yield _pieces(np.concatenate(held), blocks)
                held, n = [], 0
        if n:
            yield _pieces(np.concatenate(held), blocks)

    return run


def _merge(table: pa.Table) -> pa.Table:
    once, more = np.zeros(BLOCK_BITS, bool), np.zeros(BLOCK_BITS, bool)
    for o, m in zip(table.column("once"), table.column("more")):
        p = np.frombuffer(o.as_py(), np.uint16)
        more[p[once[p]]] = True
        once[p] = True
        more[np.frombuffer(m.as_py(), np.uint16)] = True
    if not more.any():
        return pa.table({"block": pa.array([], pa.int64()), "words": pa.array([], pa.list_(pa.int64()))})
    words = np.packbits(more, bitorder="little").view(np.int64)
    return pa.table({"block": table.column("block")[:1], "words": pa.array([words], pa.list_(pa.int64()))})


def repeat_filter(hashes: DataFrame, blocks: int) -> DataFrame:
    """``block, words`` of the repeat filter over one BIGINT hash column."""
    pieces = hashes.mapInArrow(_build(blocks), "block long, once binary, more binary")
    return pieces.groupBy("block").applyInArrow(_merge, "block long, words array<long>")


def _bit(shift: int) -> Column:
    """Bit ``(__h >> shift) & 0xFFFF`` of the block's words."""
    at = F.shiftright("__h", shift).bitwiseAND(F.lit(0xFFFF))
    word = F.get("words", F.shiftright(at, 6).cast("int"))
    return F.call_function("shiftright", word, at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1))


def possible_repeats(rows: DataFrame, key: str, total: int) -> tuple[DataFrame, DataFrame]:
    """Split ``rows`` into those that may share ``key`` with another row and sure singletons."""
    blocks = 1
    while blocks * BLOCK_BITS < total * BITS_PER_ROW:
        blocks *= 2
    hashed = rows.withColumn("__h", F.xxhash64(key))
    filters = cut(repeat_filter(hashed.select("__h"), blocks))
    probe = hashed.withColumn("block", F.pmod(F.shiftrightunsigned("__h", 32), F.lit(blocks)).cast("long"))
    # The filter has blocks * 8 KB; beyond the limit rows meet their block by shuffle instead.
    side = F.broadcast(filters) if blocks * BLOCK_BITS // 8 <= BROADCAST_LIMIT else filters
    probed = probe.join(side, "block", "left")
    maybe = F.coalesce((_bit(0) == 1) & (_bit(16) == 1), F.lit(False))
    probed = probed.withColumn("__maybe", maybe).drop("block", "words", "__h")
    return probed.where("__maybe").drop("__maybe"), probed.where("not __maybe").drop("__maybe")


def digests(reactions: DataFrame) -> DataFrame:
    """``record_id, key`` of every row with two sides, 24 bytes a row, with its lineage cut: the one time the
    strings are read. Rows without two sides are dropped behind the cut, lest the filter compute them again."""
    keyed = canonical_rows(reactions).select("record_id", F.unhex(F.md5("canon")).alias("key"))
    return cut(keyed).where("key is not null")


def collapse(reactions: DataFrame) -> DataFrame:
    """``record_id, copies``: one row per group of copies, its smallest ``record_id`` and its size."""
    rows = digests(reactions)
    maybe, single = possible_repeats(rows, "key", rows.count())
    groups = maybe.groupBy("key").agg(F.min("record_id").alias("record_id"), F.count("*").alias("copies"))
    return groups.drop("key").unionByName(single.select("record_id", F.lit(1).cast("long").alias("copies")))


def copy_pairs(reactions: DataFrame) -> DataFrame:
    """``record_a, record_b``: each copy with the smallest ``record_id`` of its group."""
    rows = digests(reactions)
    total = rows.count()
    maybe = cut(possible_repeats(rows, "key", total)[0])
    groups = maybe.groupBy("key").agg(F.min("record_id").alias("record_a"), F.count("*").alias("copies")).where("copies > 1")
    pairs = join_grouped(maybe, groups, ["key"], "copies", total)
    return pairs.where("record_id <> record_a").select("record_a", F.col("record_id").alias("record_b"))
