"""The driver's queries of the graph, token, sketch and similarity operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from molweave.operators import graph, multiset, similarity, sketches, tokens
from molweave.plans.engine import FingerprintConfig, fingerprint_bits, fingerprint_graphs, fingerprint_strings, reaction_tokens, results
from molweave.session import by_key, read, shared_folder
from molweave.sources import rsmi, tables
from molweave.streaming import fingerprints as stream

Query = Callable[[SparkSession, str], DataFrame]

BITS, MINHASHES, SIGNS, SAMPLES = 1024, 16, 64, 16


def _graphs(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(read(spark, d, "nodes"), read(spark, d, "edges"))


def _tokens(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(multiset.clean_tokens(read(spark, d, "tokens")))


def _deltas(f: Callable[[DataFrame], DataFrame]) -> Query:
    return _tokens(lambda t: f(multiset.delta(t)))


def _deltas_packed(f: Callable[[DataFrame], DataFrame]) -> Query:
    """Cleaned and counted where all rows of a reaction are: one shuffle, which grouping by reaction does not repeat."""
    return lambda spark, d: f(multiset.delta(multiset.clean_tokens(by_key(read(spark, d, "tokens"), "reaction_id"))))


def _signature(df: DataFrame, column: str = "signature") -> DataFrame:
    return df.select("reaction_id", F.posexplode(column).alias("i", "value"))


def _joined(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.array_join(F.col(column).cast("array<string>"), ","))


def _wide(n: DataFrame, e: DataFrame) -> DataFrame:
    return tables.wide_matrix(fingerprint_graphs(n, e, FingerprintConfig(bits=16, radius=1)), 16)


def _results(n: DataFrame, e: DataFrame) -> DataFrame:
    """All stages, one row for each token of each."""
    r = results(n, e, FingerprintConfig(radius=1))
    entry = lambda c, x: F.transform(F.coalesce(c, F.array().cast("array<struct<token:bigint,cnt:bigint>>")), lambda v: F.struct(F.lit(x).alias("stage"), v["token"].alias("token"), v["cnt"].alias("cnt")))
    support = F.transform(F.coalesce("support", F.array().cast("array<bigint>")), lambda v: F.struct(F.lit("support").alias("stage"), v.alias("token"), F.lit(1).cast("bigint").alias("cnt")))
    stages = F.concat(entry(F.col("tokens_r"), "r"), entry(F.col("tokens_p"), "p"), entry(F.col("delta"), "delta"), support)
    return r.select("reaction_id", "mode", F.explode(stages).alias("x")).select("reaction_id", "mode", "x.stage", "x.token", "x.cnt")


def _alike(df: DataFrame, key: str) -> DataFrame:
    """Whatever names the classes, the number of graphs in each graph's class."""
    return df.select("graph_id", F.count("*").over(Window.partitionBy(key)).alias("alike"))


def _ego_classes(n: DataFrame, e: DataFrame) -> DataFrame:
    """For each ego class of each graph its number there, everywhere and of graphs that have it."""
    same = Window.partitionBy("token")
    return tokens.ego_tokens(n, e, 1).select("graph_id", "cnt", F.sum("cnt").over(same).alias("everywhere"), F.count("*").over(same).alias("graphs"))


# What a plainly written reaction string consists of.
PLAIN = r"(Cl|Br|[BCNOPSFI]|[bcnops]|\[[0-9]*[A-Z][a-z]?@{0,2}(H[0-9]?)?([+-][0-9]?)?\]|[-=#/().1-9])+"


def _counts(r: DataFrame) -> DataFrame:
    """Atoms and bonds of both sides of the plainly written strings."""
    parsed = rsmi.read_rsmi(r.where(F.col("rsmi").rlike(rf"^{PLAIN}>>{PLAIN}\z")).select(F.col("record_id").alias("reaction_id"), "rsmi"))
    return parsed.select("reaction_id", *[F.size(f"{side}.{what}").alias(f"{what}_{short}") for side, short in (("reactant", "r"), ("product", "p")) for what in ("nodes", "edges")])


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by day and event type over a stream of the events folder, run until all input is read.

    Each batch writes the windows it changed to a table in the shared folder, one folder a batch, so that a batch
    that runs again replaces itself; the last count of a window is its result. Rows later than the watermark are
    dropped, and nothing comes to the driver."""
    schema = read(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    counts = stream.windowed_counts(source, "ts", "event_type", "1 day", "400 days")
    where = f"{shared_folder(spark)}/windowed_counts_{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/counts/batch={number}")

    query = counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    kept = spark.read.schema("start timestamp, event_type string, n long, batch long").parquet(f"{where}/counts")
    last = kept.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"))
    return last.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def queries() -> dict[str, Query]:
    reads = lambda f: lambda spark, d: f(read(spark, d, "reactions"))
    keyed = lambda r: r.select(F.col("record_id").alias("reaction_id"), "rsmi")
    return {
        "fingerprint_wl_parity": _graphs(lambda n, e: fingerprint_bits(n, e)),
        "graph_nodes": _graphs(lambda n, e: graph.clean_nodes(n).drop("attrs")),
        "graph_edges_norm": _graphs(lambda n, e: graph.clean_edges(e).drop("attrs")),
        "graph_adjacency": _graphs(lambda n, e: _joined(graph.adjacency(e), "neighbours")),
        "graph_degree": _graphs(graph.degrees),
        "edge_lookup": _graphs(lambda n, e: graph.edge_between(e, e.select("graph_id", F.col("v").alias("a"), F.col("u").alias("b")).distinct()).drop("attrs")),
        "reaction_summary": _graphs(graph.summary),
        "product_side": _graphs(lambda n, e: graph.sides(graph.summary(n, e), "product")),
        "atom_labels": _graphs(graph.atom_labels),
        "bond_labels": _graphs(lambda n, e: graph.bond_labels(e)),
        "wl_tokens_r0": _graphs(lambda n, e: tokens.wl_tokens(n, e, 0)),
        "wl_tokens_r1": _graphs(lambda n, e: tokens.wl_tokens(n, e, 1)),
        "wl_tokens_r2": _graphs(lambda n, e: tokens.wl_tokens(n, e, 2)),
        "wl_tokens_element": _graphs(lambda n, e: tokens.wl_tokens(n, e, 1, node_attrs=("element",), edge_attrs=())),
        "morgan_tokens_r2": _graphs(lambda n, e: tokens.morgan_tokens(n, e, 2)),
        "wl_label_tokens_r1": _graphs(lambda n, e: tokens.wl_label_tokens(n, e, 1)),
        "wl_label_tokens_unbonded": _graphs(lambda n, e: tokens.wl_label_tokens(n, e, 1, edge_attrs=())),
        "wl_tokens_joined": _graphs(lambda n, e: tokens.wl_tokens(n, e, 2, packed=False)),
        "graph_signatures": _graphs(tokens.graph_signatures),
        "tokens_side": _graphs(lambda n, e: reaction_tokens(n, e, FingerprintConfig(radius=1))),
        "path_tokens_l1_3": _graphs(lambda n, e: tokens.path_tokens(n, e, 3)),
        "path_tokens_minpath2": _graphs(lambda n, e: tokens.path_tokens(n, e, 2, min_path=2)),
        "ego_nodes_r2": _graphs(lambda n, e: graph.ego_nodes(n, e, 2)),
        "ego_edges_r2": _graphs(lambda n, e: graph.ego_edges(n, e, 2).select("graph_id", "center", "u", "v")),
        "ego_tokens_r1": _graphs(lambda n, e: tokens.ego_tokens(n, e, 1)),
        "ego_tokens_blind_r0": _graphs(lambda n, e: tokens.ego_tokens(n, e, 0, blind=True)),
        "clean_tokens": _tokens(lambda t: t),
        "delta_tokens": _deltas(lambda d: d),
        "union_tokens": _tokens(multiset.union),
        "signed_support": _deltas(multiset.signed_support),
        "pos_neg_maps": _deltas(multiset.pos_neg),
        "l1_weights": _deltas(multiset.l1_weights),
        "vocab_rank": _deltas(multiset.vocab_rank),
        "dense_vectors": _deltas(lambda d: _signature(multiset.dense(d, 2), "vector")),
        "odd_tokens": _tokens(multiset.odd_tokens),
        "parity_bits_delta": _deltas(lambda d: sketches.parity_bits(multiset.signed_support(d), BITS, 1)),
        "parity_bits_union": _tokens(lambda t: sketches.parity_bits(multiset.plain_support(multiset.union(t)), BITS, 1)),
        "minhash_signature": _deltas(lambda d: _signature(sketches.minhash(multiset.signed_support(d), MINHASHES))),
        "minhash_bits": _deltas(lambda d: sketches.signature_bits(sketches.minhash(multiset.signed_support(d), MINHASHES), BITS)),
        "cws_samples": _deltas(lambda d: _signature(sketches.weighted_minhash(multiset.pos_neg(d), SAMPLES))),
        "srp_signs": _deltas(lambda d: _signature(sketches.srp(multiset.pos_neg(d), SIGNS), "sketch")),
        "srp_bits": _deltas(lambda d: sketches.sign_bits(sketches.srp(multiset.pos_neg(d), SIGNS))),
        "local_srp": _deltas(lambda d: _signature(sketches.local_srp(multiset.pos_neg(d), 32), "sketch")),
        "local_icws": _deltas(lambda d: _signature(sketches.local_icws(multiset.pos_neg(d), 32))),
        "tanimoto_search": _deltas(lambda d: similarity.bit_search(sketches.parity_bits(multiset.signed_support(d), BITS, 1))),
        "weighted_search": _deltas_packed(similarity.weighted_search),
        "weighted_search_normalized": _deltas_packed(lambda d: similarity.weighted_search(d, normalize=True)),
        "minhash_search": _deltas(lambda d: similarity.grid_search(sketches.minhash(multiset.signed_support(d), MINHASHES), "signature", similarity.equal_scores, "jaccard")),
        "srp_cosine_search": _deltas(lambda d: similarity.grid_search(sketches.srp(multiset.pos_neg(d), SIGNS), "sketch", similarity.sign_scores, "cosine")),
        "fingerprint_morgan_union": _graphs(lambda n, e: fingerprint_bits(n, e, FingerprintConfig(tokenizer="morgan", mode="union", radius=1))),
        "fingerprint_path_minhash": _graphs(lambda n, e: fingerprint_bits(n, e, FingerprintConfig(tokenizer="path", sketch="minhash", m=16))),
        "fingerprint_nauty_cw": _graphs(lambda n, e: fingerprint_bits(n, e, FingerprintConfig(tokenizer="nauty", sketch="cw", radius=1, m=16))),
        "fingerprint_wl_srp": _graphs(lambda n, e: fingerprint_bits(n, e, FingerprintConfig(sketch="srp", radius=1, bits=64))),
        "fingerprint_matrix_wide": _graphs(_wide),
        "fingerprint_results": _graphs(_results),
        "signature_classes": _graphs(lambda n, e: _alike(tokens.graph_signatures(n, e), "signature")),
        "ego_classes_r1": _graphs(_ego_classes),
        "rsmi_counts": reads(_counts),
        "rsmi_graphs": reads(lambda r: rsmi.read_rsmi(keyed(r)).select("reaction_id", F.size("reactant.nodes").alias("atoms_r"), F.size("product.nodes").alias("atoms_p"), F.size("reactant.edges").alias("bonds_r"), "error")),
        "rsmi_fingerprints": reads(lambda r: fingerprint_strings(keyed(r), FingerprintConfig(radius=1, bits=256)).select("reaction_id", F.aggregate("fingerprint", F.lit(0), lambda a, x: a + x).alias("on"), "error")),
        "rsmi_row_local": reads(lambda r: stream.row_local_bits(keyed(r), 1, 256).select("reaction_id", F.size("bits").alias("on"), "error")),
        "stream_windows": _streamed,
    }
