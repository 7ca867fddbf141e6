"""Session defaults and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every plan here is written for. ``tune`` sets a value only
# where the session still has Spark's own default, so a cluster's choices win.
RUNTIME_DEFAULTS = {
    # facility_id already determines the deal: let a join on (deal_id,
    # facility_id) reuse a partitioning on facility_id instead of reshuffling.
    "spark.sql.requireAllClusterKeysForCoPartition": ("true", "false"),
    # Split a hot join key even where that costs one more exchange above it.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": ("false", "true"),
    # Where every partition of the build side is known at run time to be small, join by hash
    # and skip both sorts; a skewed build side keeps the sort-merge join.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": ("0b", "64m"),
    # mode() aggregates per deal: keep more groups in memory before sorting.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": ("128", "16384"),
}


def tune(spark: SparkSession) -> SparkSession:
    for key, (spark_default, ours) in RUNTIME_DEFAULTS.items():
        if spark.conf.get(key, spark_default) == spark_default:
            spark.conf.set(key, ours)
    return spark


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "lendlens") -> SparkSession:
    """A single-machine session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def _checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lendlens-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")


_scopes: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes, on leaving, the intermediate tables that were written inside; results must be
    written or collected before. Tables of other runs in the folder are not touched."""
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.remove(paths)
        jvm = spark.sparkContext._jvm
        for path in paths:
            location = jvm.org.apache.hadoop.fs.Path(path)
            location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(location, True)


def scratch_folder(spark: SparkSession) -> str:
    """A fresh path in the folder that holds intermediate tables."""
    _checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/lendlens-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


# Spark deletes the shuffle files of an execution when the driver's garbage collector meets its plan, which a long run may not
# live to see; with this setting it does so when the execution ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes that run inside are deleted when each ends; the session's own setting comes back on leaving.

    For writes alone: their plan is run once, while a frame that is collected again would have to compute its shuffles again.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into a table of the shared checkpoint folder and read it back.

    Used where a plan is read several times or must not be re-sampled. The files outlive any
    executor, so later stages never see a second, different result; being columnar they are
    read back pruned to the columns each consumer needs, with their true size in the statistics.
    The shuffle files that the table was made from are deleted with the write.
    """
    spark, path = df.sparkSession, scratch_folder(df.sparkSession)
    with released_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
