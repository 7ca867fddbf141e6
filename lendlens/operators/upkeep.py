"""Keeping a table of latest rows up to date: a new extract is merged into the partitions it touches, the rest is not read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendlens.operators.dedupe import latest_by
from lendlens.session import settle

BUCKETS = 64  # partitions of a snapshot; fixed when it is first written


def bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write_snapshot(rows: DataFrame, path: str, keys: str | Sequence[str], ts: str | Sequence[str] = "source_extract_ts", buckets: int = BUCKETS) -> None:
    """The latest row per key of an extract, as a Parquet table partitioned by ``__bucket``, a hash of the key."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    latest = latest_by(rows, keys, ts).withColumn("__bucket", bucket(keys, buckets))
    latest.repartition(buckets, "__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(path)


def read_snapshot(like: DataFrame, path: str) -> DataFrame:
    return like.sparkSession.read.schema(like.withColumn("__bucket", F.lit(0)).schema).parquet(path)


def merge_extract(delta: DataFrame, path: str, keys: str | Sequence[str], ts: str | Sequence[str] = "source_extract_ts", buckets: int = BUCKETS) -> DataFrame:
    """Merges a new extract into a snapshot and returns the whole snapshot.

    The row with the latest time stays, ties as in ``latest_by``, whether it lies in the snapshot or in the extract: the
    outcome is that of one pass over all extracts ever merged, in any order. Only partitions with a key of the extract
    are read and written again; which ones is one number per partition on the driver. The new partitions are settled before the
    old ones are replaced, so a lost executor never sees a half-written table; frames that were read from
    the snapshot before have to be read again.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    delta = settle(delta.withColumn("__bucket", bucket(keys, buckets)))
    touched = [r[0] for r in delta.select("__bucket").distinct().collect()]
    own = delta.drop("__bucket")
    if touched:
        old = read_snapshot(own, path).where(F.col("__bucket").isin(touched))
        merged = settle(latest_by(old.select(*delta.columns).unionByName(delta).drop("__bucket"), keys, ts).withColumn("__bucket", bucket(keys, buckets)))
        dealt = merged.repartition(len(touched), "__bucket")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__bucket").parquet(path)
    return read_snapshot(own, path).select(*own.columns)
