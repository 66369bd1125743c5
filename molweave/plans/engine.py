"""From graphs or reaction strings to fingerprints in one lazy plan."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molweave.model import EDGE_ATTRS, NODE_ATTRS
from molweave.operators import multiset, sketches, tokens
from molweave.session import cut
from molweave.sources import rsmi, tables

Tokenizer = Callable[..., DataFrame]

TOKENIZERS: dict[str, Tokenizer] = {"wl": tokens.wl_tokens, "morgan": tokens.morgan_tokens, "path": tokens.path_tokens, "nauty": tokens.ego_tokens}
SKETCHES: dict[str, Callable[[DataFrame, "FingerprintConfig"], DataFrame]] = {
    "parity": lambda d, c: sketches.parity_bits(c.support(d), c.bits, c.seed),
    "minhash": lambda d, c: sketches.signature_bits(sketches.minhash(c.support(d), c.m, c.seed), c.bits),
    "cw": lambda d, c: sketches.signature_bits(sketches.weighted_minhash(c.weights(d), c.m, c.seed), c.bits),
    "srp": lambda d, c: sketches.sign_bits(sketches.srp(c.weights(d), c.bits, c.seed)),
}


def register_tokenizer(name: str, make: Tokenizer) -> None:
    """Add ``make(nodes, edges, radius, node_attrs=, edge_attrs=) -> graph_id, token, cnt``."""
    TOKENIZERS[name.lower()] = make


def register_sketch(name: str, make: Callable[[DataFrame, FingerprintConfig], DataFrame]) -> None:
    """Add ``make(deltas, config) -> reaction_id, bit``."""
    SKETCHES[name.lower()] = make


@dataclass(frozen=True)
class FingerprintConfig:
    """What to extract, combine and sketch. All values are checked before anything runs."""

    tokenizer: str = "wl"
    radius: int = 2
    sketch: str = "parity"
    bits: int = 1024
    m: int = 256
    seed: int = 1
    mode: str = "delta"
    node_attrs: tuple[str, ...] = NODE_ATTRS
    edge_attrs: tuple[str, ...] = EDGE_ATTRS
    options: dict[str, object] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.tokenizer.lower() not in TOKENIZERS:
            raise ValueError(f"unknown tokenizer {self.tokenizer!r}: {', '.join(TOKENIZERS)}")
        if self.sketch.lower() not in SKETCHES:
            raise ValueError(f"unknown sketch {self.sketch!r}: {', '.join(SKETCHES)}")
        if self.mode not in ("delta", "union"):
            raise ValueError(f"unknown mode {self.mode!r}: delta or union")
        tokens.check_radius(self.radius)
        sketches.check_size(self.bits, "bits")
        sketches.check_size(self.m, "m")
        sketches.check_seed(self.seed)

    def support(self, combined: DataFrame) -> DataFrame:
        return multiset.signed_support(combined) if self.mode == "delta" else multiset.plain_support(combined)

    def weights(self, combined: DataFrame) -> DataFrame:
        return multiset.pos_neg(combined)


def reaction_tokens(nodes: DataFrame, edges: DataFrame, config: FingerprintConfig) -> DataFrame:
    """``reaction_id, side, token, cnt``."""
    make = TOKENIZERS[config.tokenizer.lower()]
    return tokens.side_tokens(make(nodes, edges, config.radius, node_attrs=config.node_attrs, edge_attrs=config.edge_attrs, **config.options))


def fingerprint_bits(nodes: DataFrame, edges: DataFrame, config: FingerprintConfig | None = None) -> DataFrame:
    """``reaction_id, bit`` of the set bits."""
    config = config or FingerprintConfig()
    return SKETCHES[config.sketch.lower()](multiset.combine(reaction_tokens(nodes, edges, config), config.mode), config)


def fingerprint_graphs(nodes: DataFrame, edges: DataFrame, config: FingerprintConfig | None = None) -> DataFrame:
    """``reaction_id, fingerprint`` of every reaction that has a node: a 0/1 array, zeros for no change."""
    config = config or FingerprintConfig()
    rid, _ = _reaction(nodes)
    return sketches.to_vector(nodes.select(rid.alias("reaction_id")), fingerprint_bits(nodes, edges, config), config.bits)


def _reaction(nodes: DataFrame):
    from molweave.operators.graph import reaction_of

    return reaction_of(F.col("graph_id"))


def results(nodes: DataFrame, edges: DataFrame, config: FingerprintConfig | None = None) -> DataFrame:
    """``reaction_id, mode, tokens_r, tokens_p, delta, support``: all stages side by side.

    The first three are arrays of ``token, count``."""
    config = config or FingerprintConfig()
    toks = reaction_tokens(nodes, edges, config)
    entry = F.struct("token", "cnt")
    per_side = toks.groupBy("reaction_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("side") == "R", entry))).alias("tokens_r"), F.array_sort(F.collect_list(F.when(F.col("side") == "P", entry))).alias("tokens_p")
    )
    combined = multiset.combine(toks, config.mode)
    net = combined.groupBy("reaction_id").agg(F.array_sort(F.collect_list(F.struct("token", F.col("delta").alias("cnt")))).alias("delta"))
    support = config.support(combined).groupBy("reaction_id").agg(F.array_sort(F.collect_list("enc")).alias("support"))
    return per_side.join(net, "reaction_id", "left").join(support, "reaction_id", "left").withColumn("mode", F.lit(config.mode))


def fingerprint_strings(reactions: DataFrame, config: FingerprintConfig | None = None, key: str = "reaction_id", text: str = "rsmi") -> DataFrame:
    """``reaction_id, fingerprint, error`` of every row; null with an error where a string cannot be read."""
    config = config or FingerprintConfig()
    # Nodes, bonds and the list of rows all come from the parsed strings: parse once.
    parsed = cut(rsmi.read_rsmi(reactions.select(F.col(key).alias("reaction_id"), F.col(text).alias("rsmi"))))
    nodes, edges = rsmi.graph_tables(parsed)
    made = fingerprint_bits(nodes, edges, config)
    good = sketches.to_vector(parsed.where("error is null"), made, config.bits)
    return parsed.select("reaction_id", "error").join(good, "reaction_id", "left").select("reaction_id", "fingerprint", "error")


@dataclass(frozen=True)
class Result:
    """All stages of one reaction: tokens of both sides and net change as ``{token: count}``, the encoded support and
    the 0/1 sketch."""

    tokens_r: dict[int, int]
    tokens_p: dict[int, int]
    delta: dict[int, int]
    support: list[int]
    sketch: list[int]
    mode: str

    def to_binary(self) -> list[int]:
        """The sketch, if it holds nothing but 0 and 1."""
        if any(x not in (0, 1) for x in self.sketch):
            raise TypeError("the sketch is not binary")
        return list(self.sketch)

    def as_array(self) -> np.ndarray:
        return np.asarray(self.sketch, int)

    def __repr__(self) -> str:
        return f"Result({sum(self.tokens_r.values())} tokens to {sum(self.tokens_p.values())}, support of {len(self.support)}, mode {self.mode})"


class Encoder:
    """Reaction strings in Python lists to a matrix, in their order. ``batch_size`` rows go to one task."""

    def __init__(self, spark: SparkSession, config: FingerprintConfig | None = None, batch_size: int | None = None):
        if batch_size is not None:
            sketches.check_size(batch_size, "batch_size")
        self.spark, self.config, self.batch_size = spark, config or FingerprintConfig(), batch_size

    @classmethod
    def encode(cls, spark: SparkSession, strings: Iterable[str], batch_size: int | None = None, **options: object) -> np.ndarray:
        """The matrix of some strings in one call; ``options`` are those of ``FingerprintConfig``."""
        return cls(spark, FingerprintConfig(**options), batch_size).encode_many(strings)  # type: ignore[arg-type]

    def _table(self, rows: list[tuple[int, str]]) -> DataFrame:
        df = self.spark.createDataFrame(rows, "reaction_id long, rsmi string")
        return df.repartition(-(-len(rows) // self.batch_size)) if self.batch_size else df

    def encode_many(self, strings: Iterable[str], on_error: str = "raise") -> np.ndarray:
        rows = list(enumerate(strings))
        if not rows:
            return np.zeros((0, 0), int)
        found = {r["reaction_id"]: r for r in fingerprint_strings(self._table(rows), self.config).collect()}
        bad = [f"{i}: {r['error']}" for i, r in sorted(found.items()) if r["error"]]
        if bad and on_error == "raise":
            raise ValueError("; ".join(bad[:5]))
        zero = [0] * self.config.bits
        return np.array([found[i]["fingerprint"] or zero for i, _ in rows], int)

    def encode_one(self, string: str) -> np.ndarray:
        return self.encode_many([string])[0]

    def result(self, string: str) -> Result:
        """All stages of one reaction string."""
        sketch = self.encode_one(string).tolist()
        nodes, edges = rsmi.graph_tables(cut(rsmi.read_rsmi(self._table([(0, string)]))))
        r = results(nodes, edges, self.config).first()
        counts = lambda x: {e["token"]: e["cnt"] for e in x or []}
        if r is None:
            return Result({}, {}, {}, [], sketch, self.config.mode)
        return Result(counts(r["tokens_r"]), counts(r["tokens_p"]), counts(r["delta"]), list(r["support"] or []), sketch, self.config.mode)

    @staticmethod
    def describe() -> str:
        """Usage in brief."""
        return 'Encoder(spark, FingerprintConfig(tokenizer="wl", radius=2, sketch="parity", bits=1024)).encode_many(["CCO>>CC=O"])'

    def __repr__(self) -> str:
        return f"Encoder({self.config})"


def describe(name: str | None = None) -> str:
    """What a tokenizer or sketch does, or the list of all of them."""
    if name is None:
        return f"tokenizers: {', '.join(TOKENIZERS)}; sketches: {', '.join(SKETCHES)}"
    about = {"wl": tokens.wl_tokens, "morgan": tokens.morgan_tokens, "path": tokens.path_tokens, "nauty": tokens.ego_tokens, "parity": sketches.parity_bits, "minhash": sketches.minhash, "cw": sketches.weighted_minhash, "srp": sketches.srp}
    if name.lower() not in {**TOKENIZERS, **SKETCHES}:
        raise ValueError(f"unknown name {name!r}: {describe()}")
    return (about.get(name.lower(), {**TOKENIZERS, **SKETCHES}[name.lower()]).__doc__ or "").strip()


def fingerprint(spark: SparkSession, rsmi_text: str, **options: object) -> list[int]:
    """One reaction string to its 0/1 list."""
    return Encoder(spark, FingerprintConfig(**options)).encode_one(rsmi_text).tolist()  # type: ignore[arg-type]


__all__ = ["Encoder", "FingerprintConfig", "Result", "describe", "fingerprint", "fingerprint_bits", "fingerprint_graphs", "fingerprint_strings", "register_sketch", "register_tokenizer", "results", "tables"]
