"""Multiset algebra over token tables: counts, net change, union, support, weights and ranks.

Null tokens, ids and sides are left out. Counts are sums, so that split rows add up; use ``clean_tokens``
first where whole rows are repeated. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def clean_tokens(tokens: DataFrame) -> DataFrame:
    """``reaction_id, side, token, cnt`` of a long table in which rows are repeated and counts split.

    Rows equal in every column count once; the chunks of a count add up."""
    rows = tokens.where("reaction_id is not null and side in ('R', 'P') and token is not null and cnt > 0")
    whole = [c for c in ("reaction_id", "side", "token", "chunk", "cnt", "loaded_at") if c in tokens.columns]
    return rows.select(*whole).distinct().groupBy("reaction_id", "side", "token").agg(F.sum("cnt").alias("cnt"))


def delta(tokens: DataFrame) -> DataFrame:
    """``reaction_id, token, delta``: product minus reactant, zeros left out. One shuffle."""
    signed = F.when(F.col("side") == "P", F.col("cnt")).otherwise(-F.col("cnt"))
    rows = tokens.where("side in ('R', 'P') and token is not null")
    return rows.groupBy("reaction_id", "token").agg(F.sum(signed).alias("delta")).where("delta <> 0")


def union(tokens: DataFrame) -> DataFrame:
    """``reaction_id, token, cnt``: both sides added up."""
    rows = tokens.where("side in ('R', 'P') and token is not null")
    return rows.groupBy("reaction_id", "token").agg(F.sum("cnt").alias("cnt"))


def combine(tokens: DataFrame, mode: str) -> DataFrame:
    """``reaction_id, token, delta`` of mode delta or union."""
    if mode == "delta":
        return delta(tokens)
    if mode == "union":
        return union(tokens).withColumnRenamed("cnt", "delta")
    raise ValueError(f"unknown mode {mode!r}: use delta or union")


def signed_support(deltas: DataFrame) -> DataFrame:
    """``reaction_id, enc``: ``2 t`` for created and ``2 t + 1`` for consumed tokens."""
    return deltas.where("delta <> 0").select("reaction_id", (F.col("token") * 2 + (F.col("delta") < 0).cast("bigint")).alias("enc"))


def plain_support(counts: DataFrame) -> DataFrame:
    """``reaction_id, enc`` of a union: the tokens themselves, once each."""
    return counts.select("reaction_id", F.col("token").alias("enc")).distinct()


def pos_neg(deltas: DataFrame) -> DataFrame:
    """``reaction_id, token, pos, neg``: both at least 0."""
    return deltas.where("delta <> 0").select("reaction_id", "token", F.greatest("delta", F.lit(0)).alias("pos"), F.greatest(-F.col("delta"), F.lit(0)).alias("neg"))


def check_pos_neg(weights: DataFrame) -> DataFrame:
    """The same rows; the query fails on a null token or a missing or negative weight."""
    ok = F.coalesce(F.col("token").isNotNull() & (F.col("pos") >= 0) & (F.col("neg") >= 0), F.lit(False))
    return weights.where(F.when(ok, True).otherwise(F.raise_error(F.lit("weights must be numbers of at least 0")).cast("boolean")))


def l1_weights(deltas: DataFrame, normalize: bool = True) -> DataFrame:
    """``reaction_id, token, w``: signed weights whose absolute values add up to 1 a reaction."""
    rows = deltas.where("delta <> 0")
    if not normalize:
        return rows.select("reaction_id", "token", F.col("delta").cast("double").alias("w"))
    whole = F.sum(F.abs("delta")).over(Window.partitionBy("reaction_id"))
    return rows.select("reaction_id", "token", (F.col("delta") / whole).alias("w"))


def vocab_rank(tokens: DataFrame) -> DataFrame:
    """``reaction_id, token, rank``: place of a token among its reaction's tokens, from 0."""
    rows = tokens.where("token is not null").select("reaction_id", "token").distinct()
    return rows.withColumn("rank", (F.row_number().over(Window.partitionBy("reaction_id").orderBy("token")) - 1).cast("int"))


def dense(deltas: DataFrame, channels: int = 1) -> DataFrame:
    """``reaction_id, vector``: weights in the order of the reaction's own ranks; for inspection only.

    One signed channel, or the positive channel followed by the negative one."""
    packed = deltas.where("delta <> 0").groupBy("reaction_id").agg(F.array_sort(F.collect_list(F.struct("token", "delta"))).alias("x"))
    if channels == 1:
        return packed.select("reaction_id", F.transform("x", lambda x: x["delta"].cast("double")).alias("vector"))
    up = F.transform("x", lambda x: F.greatest(x["delta"], F.lit(0)).cast("double"))
    down = F.transform("x", lambda x: F.greatest(-x["delta"], F.lit(0)).cast("double"))
    return packed.select("reaction_id", F.concat(up, down).alias("vector"))


def dense_over(deltas: DataFrame, places: DataFrame, size: int, channels: int = 1, normalize: bool = False) -> DataFrame:
    """``reaction_id, vector`` of weights at the ``token, place`` of a given list of places from 0 to ``size - 1``.

    One signed channel, or the positive channel followed by the negative one; with ``normalize`` the absolute
    values of a vector add up to 1. The query fails on a token without a place."""
    known = l1_weights(deltas, normalize).join(places.select("token", "place"), "token", "left")
    lost = F.raise_error(F.concat(F.lit("no place for token "), F.col("token").cast("string"))).cast("int")
    at = F.coalesce(F.col("place"), lost)
    if channels == 2:
        at = F.when(F.col("w") < 0, at + size).otherwise(at)
    rows = known.select("reaction_id", F.struct(at.cast("int").alias("at"), (F.col("w") if channels == 1 else F.abs("w")).alias("w")).alias("x"))
    held = rows.groupBy("reaction_id").agg(F.map_from_entries(F.collect_list("x")).alias("m"))
    return held.select("reaction_id", F.transform(F.sequence(F.lit(0), F.lit(size * channels - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("vector"))


def odd_tokens(tokens: DataFrame) -> DataFrame:
    """``reaction_id, token`` of tokens with an odd count over both sides."""
    return union(tokens).where(F.col("cnt") % 2 == 1).select("reaction_id", "token")
