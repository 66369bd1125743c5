"""Reading tables, cutting lineage and joining on skewed keys."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a scale folder, a Parquet file or a folder of them."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; only a local session without one (tests) gets a
    temporary folder, which goes when Python ends. ``local-cluster`` counts as a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="molweave-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(path)
    return path


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """A checkpoint folder for the session: the shared one, else as in ``shared_folder``."""
    if not spark.sparkContext.getCheckpointDir():
        folder = shared_folder(spark)
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage. Survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` shuffled by ``keys`` into as many partitions as the session asks for. Small rows can be much work:
    without the number, adaptive execution would merge a few MB of them into one task."""
    return df.repartition(shuffle_parts(df.sparkSession), *keys)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least one partition a core, for CPU-heavy row-local work. A scan that already has as many
    partitions, as any large one, is left alone: no shuffle. Streams are left alone, too."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def join_merged(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join two tables that both grow with the data, always by shuffle. Graph tables take a byte or two a row in
    Parquet; by that size Spark takes millions of rows for a small table and broadcasts them through the driver."""
    return left.join(right.hint("merge"), keys, how)


def join_grouped(rows: DataFrame, groups: DataFrame, keys: list[str], size_col: str, total: int, how: str = "inner", least: int = 10_000) -> DataFrame:
    """Join ``rows`` with one row per group although some groups are huge.

    ``size_col`` holds the number of rows of each group. At most 1,000 groups can hold more than a
    thousandth of all rows; these are broadcast (size bound: 1,000 rows), so that their members never
    meet in one task. All others join by shuffle, with at most ``total / 1000`` rows (or ``least``) a group.
    """
    limit = max(total // 1000, least)
    hot = groups.where(F.col(size_col) > limit)
    if total <= limit:
        return rows.join(groups, keys, how)
    cold = groups.where(F.col(size_col) <= limit)
    flagged = rows.join(F.broadcast(hot.select(*keys, F.lit(True).alias("__hot"))), keys, "left")
    near = flagged.where(F.col("__hot")).drop("__hot").join(F.broadcast(hot), keys, "inner")
    far = flagged.where(F.col("__hot").isNull()).drop("__hot").join(cold, keys, how)
    return near.unionByName(far)


def join_lanes(rows: DataFrame, queries: DataFrame, key: str, spread_by: str, total: int, least: int = 10_000) -> DataFrame:
    """Join two tables on a key that some groups of ``rows`` share very often.

    At most 1,000 keys can hold more than a thousandth of all rows; these are broadcast (size bound: 1,000 rows).
    Their rows are spread over lanes by the hash of ``spread_by``, and their queries visit every lane."""
    limit = max(total // 1000, least)
    if total <= limit:
        return queries.join(rows, key)
    hot = rows.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > limit)
    hot = F.broadcast(hot.select(key, F.ceil(F.col("__n") / F.lit(limit)).cast("int").alias("__lanes")))
    lanes = F.coalesce("__lanes", F.lit(1))
    spread_rows = rows.join(hot, key, "left").withColumn("__lane", F.pmod(F.xxhash64(spread_by), lanes).cast("int")).drop("__lanes")
    visits = queries.join(hot, key, "left").withColumn("__lane", F.explode(F.sequence(F.lit(0), lanes - 1))).drop("__lanes")
    return visits.join(spread_rows, [key, "__lane"]).drop("__lane")
