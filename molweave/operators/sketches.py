"""Sketches of token sets and weighted token sets.

Randomness is keyed by the token, never by its place in one reaction, so sketches of different reactions
can be compared. A set that spans many rows is folded by partial aggregation; sketches over arrays are
computed row by row inside the JVM. Reactions with an empty set have no row here: join from the list of
reactions to get their zero vectors. Null tokens are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molweave.functions.hashing import seeded_hash, token_hash
from molweave.session import by_key

PRIME = (1 << 31) - 1


def check_size(value: int, name: str) -> None:
    if isinstance(value, bool) or not isinstance(value, int) or value < 1:
        raise ValueError(f"{name} must be a whole number of at least 1")


def check_seed(seed: int) -> None:
    if isinstance(seed, bool) or not isinstance(seed, int) or seed < 0:
        raise ValueError("seed must be a whole number of at least 0")


def parity_bits(support: DataFrame, bits: int = 1024, seed: int = 1) -> DataFrame:
    """``reaction_id, bit`` of the set bits: those that an odd number of tokens falls on."""
    check_size(bits, "bits")
    check_seed(seed)
    bit = (seeded_hash("pf", seed, F.col("enc")) % bits).cast("int")
    counted = support.where("enc is not null").groupBy("reaction_id", bit.alias("bit")).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") % 2 == 1).select("reaction_id", "bit")


def permutations(m: int, seed: int) -> list[tuple[int, int]]:
    """Affine maps modulo a 31-bit prime; every product stays below 2^62."""
    state = (seed * 2654435761 + 12345) % PRIME
    out = []
    for _ in range(m):
        state = (state * 48271 + 11) % PRIME
        a = state % (PRIME - 1) + 1
        state = (state * 48271 + 11) % PRIME
        out.append((a, state))
    return out


def _maps(m: int, seed: int) -> Column:
    return F.array(*[F.struct(F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for a, b in permutations(m, seed)])


def minhash(support: DataFrame, m: int = 64, seed: int = 1) -> DataFrame:
    """``reaction_id, signature``: m minima over the set of tokens; one hash a token, then affine maps."""
    check_size(m, "m")
    check_seed(seed)
    hashed = support.where("enc is not null").select("reaction_id", (token_hash(F.concat(F.lit("mh|"), F.col("enc").cast("string"))) % PRIME).alias("h"))
    sets = by_key(hashed, "reaction_id").groupBy("reaction_id").agg(F.collect_set("h").alias("hs"))
    signature = F.transform(_maps(m, seed), lambda p: F.array_min(F.transform("hs", lambda h: (p["a"] * h + p["b"]) % PRIME)))
    return sets.select("reaction_id", signature.alias("signature"))


def weighted_minhash(weights: DataFrame, m: int = 64, seed: int = 1, normalize: bool = True) -> DataFrame:
    """``reaction_id, signature`` of weights ``token, pos, neg``, whole or real, by consistent weighted sampling.

    For every place, each token and sign draws r and c from Gamma(2, 1) and a shift from its own hash; the weight
    decides on which step of r it stands, and the token with the least c over the next step is sampled. The value
    holds token, sign and step, so that two signatures agree in a place with the probability of their weighted
    Jaccard similarity. Neither rows nor time depend on how large the weights are. With ``normalize`` the weights
    of a reaction are divided by their sum first. Nulls and weights of 0 or less are left out."""
    check_size(m, "m")
    check_seed(seed)
    signs = F.explode(F.array(F.struct(F.lit("+").alias("s"), F.col("pos").alias("w")), F.struct(F.lit("-").alias("s"), F.col("neg").alias("w"))))
    rows = weights.where("token is not null").select("reaction_id", "token", signs.alias("x")).where("x.w > 0")
    # One shuffle by reaction: the draws and the two aggregations behind it keep its partitioning.
    sets = by_key(rows, "reaction_id").groupBy("reaction_id").agg(F.collect_list(F.struct("token", "x.s", F.col("x.w").cast("double").alias("w"))).alias("ts"), F.sum("x.w").cast("double").alias("whole"))
    each = sets.select("reaction_id", "whole", F.explode("ts").alias("e")).select("reaction_id", "whole", "e.token", "e.s", "e.w", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("i"))
    # 30 digits of the hash are five numbers of 24 bits: two for r, two for c, one for the shift.
    text = F.concat_ws("|", F.lit("cws"), F.lit(str(seed)), F.col("i").cast("string"), "s", F.col("token").cast("string"))
    lw = F.ln(F.col("w") / F.col("whole") if normalize else F.col("w"))
    drawn = each.select("reaction_id", "i", "token", "s", lw.alias("lw"), F.md5(text).alias("h"))
    part = lambda at, n: F.conv(F.substring("h", at, n), 16, 10).cast("bigint")
    drawn = drawn.select("reaction_id", "i", "token", "s", "lw", part(1, 12).alias("x"), part(13, 12).alias("y"), part(25, 6).alias("z"))
    uniform = lambda v: (v + 0.5) / 16777216.0
    gamma = lambda c: -(F.ln(uniform(F.shiftright(c, 24))) + F.ln(uniform(F.col(c).bitwiseAND(F.lit(16777215)))))
    shaped = drawn.select("reaction_id", "i", "token", "s", "lw", gamma("x").alias("r"), gamma("y").alias("c"), uniform(F.col("z")).alias("b"))
    stepped = shaped.withColumn("step", F.floor(F.col("lw") / F.col("r") + F.col("b")))
    score = F.ln("c") - F.col("r") * (F.col("step") - F.col("b")) - F.col("r")
    picked = stepped.select("reaction_id", "i", "token", "s", F.col("step").cast("bigint").alias("step"), score.alias("score"))
    best = picked.groupBy("reaction_id", "i").agg(*[F.min_by(c, "score").alias(c) for c in ("token", "s", "step")])
    value = token_hash(F.concat_ws("|", F.lit("cwv"), "s", F.col("token").cast("string"), F.col("step").cast("string")))
    whole = best.groupBy("reaction_id").agg(F.sort_array(F.collect_list(F.struct("i", value.alias("v")))).alias("p"))
    return whole.select("reaction_id", F.transform("p", lambda x: x["v"]).alias("signature"))


def srp(weights: DataFrame, m: int = 256, seed: int = 0) -> DataFrame:
    """``reaction_id, sketch``: signs (+1 for 0 and more) of m projections of signed whole weights.

    The coordinate of a token is +1 or -1 by one bit of its hash; a hash gives 60 of them. Sums are whole
    numbers, so any order of summation gives the same sketch."""
    check_size(m, "m")
    check_seed(seed)
    blocks = -(-m // 60)
    hashes = F.array(*[seeded_hash(f"srp{b}", seed, F.col("token")) for b in range(blocks)])
    rows = weights.where("token is not null").select("reaction_id", (F.col("pos") - F.col("neg")).cast("bigint").alias("w"), hashes.alias("hs"))
    packed = by_key(rows, "reaction_id").groupBy("reaction_id").agg(F.collect_list(F.struct("w", "hs")).alias("x"))

    def sign(i: Column) -> Column:
        bit = lambda x: F.call_function("shiftright", F.get(x["hs"], (i / 60).cast("int")), (i % 60).cast("int")).bitwiseAND(F.lit(1))
        total = F.aggregate("x", F.lit(0).cast("bigint"), lambda acc, x: acc + x["w"] * (F.lit(1) - bit(x) * 2))
        return F.when(total >= 0, F.lit(1)).otherwise(F.lit(-1)).cast("tinyint")

    return packed.select("reaction_id", F.transform(F.sequence(F.lit(0), F.lit(m - 1)), sign).alias("sketch"))


def signature_bits(signatures: DataFrame, bits: int, column: str = "signature") -> DataFrame:
    """``reaction_id, bit``: the bit of each value modulo ``bits``, once."""
    check_size(bits, "bits")
    return signatures.select("reaction_id", F.explode(column).alias("x")).select("reaction_id", F.pmod(F.col("x").cast("bigint"), F.lit(bits)).cast("int").alias("bit")).distinct()


def sign_bits(sketches: DataFrame, column: str = "sketch") -> DataFrame:
    """``reaction_id, bit``: the places of +1."""
    return sketches.select("reaction_id", F.posexplode(column).alias("bit", "x")).where("x > 0").select("reaction_id", "bit")


def to_vector(reactions: DataFrame, bit_rows: DataFrame, bits: int) -> DataFrame:
    """``reaction_id, fingerprint``: 0/1 arrays of every listed reaction, zeros where it has no bit."""
    own = bit_rows.groupBy("reaction_id").agg(F.collect_set("bit").alias("on"))
    every = reactions.select("reaction_id").distinct().join(own, "reaction_id", "left")
    values = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.coalesce(F.array_contains("on", i), F.lit(False)).cast("int"))
    return every.select("reaction_id", values.alias("fingerprint"))


def as_binary(values: Column) -> Column:
    """The array itself; the query fails on a value other than 0 and 1."""
    return F.transform(values, lambda x: F.when(x.isin(0, 1), x.cast("int")).otherwise(F.raise_error(F.lit("not a binary sketch")).cast("int")))


def flat(values: Column) -> Column:
    """A two-dimensional signature as one array of whole numbers."""
    return F.flatten(values).cast("array<bigint>")


# Random numbers by local rank: sketches that are comparable within one reaction's vocabulary only.


def _local(weights: DataFrame, build, out: str) -> DataFrame:
    packed = weights.groupBy("reaction_id").agg(F.array_sort(F.collect_list(F.struct("token", "pos", "neg"))).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [build(np.array([float(t["pos"]) for t in x]), np.array([float(t["neg"]) for t in x])) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([list(map(int, v)) for v in made], pa.list_(pa.int64()))], ["reaction_id", out])

    return packed.mapInArrow(run, f"reaction_id long, {out} array<long>")


def local_srp(weights: DataFrame, m: int = 256, seed: int = 0) -> DataFrame:
    """``reaction_id, sketch`` by Gaussian rows drawn for the ranks of the reaction's own tokens."""
    check_size(m, "m")
    check_seed(seed)

    def build(pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
        w = pos - neg
        scale = np.abs(w).sum()
        rng = np.random.default_rng(seed)
        # Row after row of the matrix: never more than one row of it is held.
        sums = np.array([rng.standard_normal(len(w)) @ (w / scale if scale else w) for _ in range(m)])
        return np.where(sums >= 0, 1, -1)

    return _local(weights, build, "sketch")


def local_icws(weights: DataFrame, m: int = 256, seed: int = 0, normalize: bool = True) -> DataFrame:
    """``reaction_id, signature``: improved consistent weighted sampling over the positive, then the
    negative channel; the sampled place of each of m draws, 0 without weights."""
    check_size(m, "m")
    check_seed(seed)

    def build(pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
        w = np.concatenate([pos, neg])
        if not w.any():
            return np.zeros(m, np.int64)
        w = w / w.sum() if normalize else w
        # Draw by draw: two uniforms for r, two for c, one for the shift.
        u = np.random.default_rng(seed).random((m, 5, len(w)))
        r, c = -np.log(u[:, 0]) - np.log(u[:, 1]), -np.log(u[:, 2]) - np.log(u[:, 3])
        with np.errstate(divide="ignore", invalid="ignore"):
            level = np.floor(np.log(w) / r + u[:, 4])
            score = np.log(c) - r * (level - u[:, 4]) - r
        return np.where(w > 0, score, np.inf).argmin(1)

    return _local(weights, build, "signature")
