"""Session helpers shared by every module: tables, checkpoints, hot keys."""

from __future__ import annotations

import math
import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it holds more than this share of the rows, so that there are fewer than 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.002


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's shared checkpoint folder; only a local master (tests) may do without one."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one where none is set and the master is local, else an error."""
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="storyloom-")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable (shared, executor-loss-proof) checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE, least: int = 1000) -> dict:
    """``{key: salts}`` of the keys with more than ``share`` of all rows: at most ``1 / share`` keys, so the driver may
    hold them. A key gets as many salts as it holds shares of that size."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).count()
    total, most = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    size = max(total * share, least)
    if most <= size:
        return {}
    return {r[0]: math.ceil(r[1] / size) for r in counts.where(F.col("count") > F.lit(size)).collect()}


def salted_lookup(df: DataFrame, lookup: DataFrame, key: str, hot: dict, how: str = "inner") -> DataFrame:
    """Join ``df`` with ``lookup`` (one row a key) on ``key``; rows of hot keys are spread over their salts.

    The lookup row of a hot key is repeated for every salt, so no task gets all rows of one key.
    Null keys match nothing (kept by ``how="left"``).
    """
    if not hot:
        return df.join(lookup, key, how)
    of_key = F.create_map(*[F.lit(x) for kv in hot.items() for x in kv])
    salts: Column = F.when(F.col(key).isNotNull(), F.coalesce(F.try_element_at(of_key, F.col(key)), F.lit(1))).otherwise(1)
    left = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), salts).cast("int"))
    right = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def driver_share(spark: SparkSession) -> int:
    """Bytes of a table that may be broadcast: a sixteenth of the driver's memory."""
    return spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.sparkContext.getConf().get("spark.driver.memory", "1g")) // 16


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows over all cores, for work that is heavy for its bytes: an explicit number is not coalesced by AQE."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
