import time

import pytest
from pyspark.sql import functions as F

from lendlens.plans.pipeline import run_pipeline
from lendlens.sources import tables

from .conftest import SMALL


def test_listing_and_loading(spark):
    names = tables.list_tables(spark, SMALL)
    assert {"orders", "lineitem", "nation"} <= set(names)
    assert set(tables.load_tables(spark, SMALL)) == set(names)
    assert tables.load_table(spark, SMALL, "nation").count() == 25
    with pytest.raises(ValueError, match="nation"):
        tables.load_table(spark, SMALL, "no_such_table")


def test_path_checks(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.list_tables(spark, str(tmp_path / "missing"))
    with pytest.raises(ValueError):
        tables.list_tables(spark, f"{SMALL}/nation.parquet")
    with pytest.raises(ValueError):
        tables.check_file(spark, SMALL)
    assert tables.check_file(spark, f"{SMALL}/nation.parquet").endswith("nation.parquet")


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_write_and_read_back(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, "a,b", 0.5), (2, None, 1.5)], "i int, s string, d double")
    for _ in range(2):  # the second write replaces the first
        tables.write_tables({"t": df, "u": df.limit(1)}, str(tmp_path), fmt)
    assert tables.list_tables(spark, str(tmp_path)) == ["t", "u"]
    assert {tuple(r) for r in tables.load_table(spark, str(tmp_path), "t", schema=df.schema).collect()} == {(1, "a,b", 0.5), (2, None, 1.5)}
    if fmt == "csv":  # without a schema every column is text, and the data is read once
        assert {t for _, t in tables.load_tables(spark, str(tmp_path))["t"].dtypes} == {"string"}


def test_unknown_format_fails_before_any_job(spark, tmp_path):
    broken = {"t": spark.range(1).selectExpr("raise_error('must not run') AS x")}
    with pytest.raises(ValueError, match="xlsx"):
        tables.write_tables(broken, str(tmp_path / "o"), "xlsx")
    with pytest.raises(ValueError, match="xlsx"):
        run_pipeline(spark, broken, str(tmp_path / "o"), "xlsx")
    assert not (tmp_path / "o").exists()


def test_head(spark):
    df = spark.createDataFrame([(3,), (1,), (2,), (5,)], "i int")
    assert [r.i for r in tables.head(df, ["i"]).collect()] == [1, 2, 3]


def test_scope_removes_its_own_tables_only(spark):
    from lendlens.session import scratch_scope, settle

    kept = settle(spark.range(3))
    with scratch_scope(spark):
        inner = settle(spark.range(5))
        assert inner.count() == 5
        path = inner.inputFiles()[0]
    assert kept.count() == 3
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert not location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(location)


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").splitlines()
    return {f for f in files if "/shuffle_" in f}


def _new_shuffle_files(spark, before, seconds=20):
    """What stays beyond ``before``; files are deleted in the background."""
    end = time.time() + seconds
    while _shuffle_files(spark) - before and time.time() < end:
        time.sleep(0.1)
    return _shuffle_files(spark) - before


def test_shuffle_files_go_with_the_write_that_made_them(spark, tmp_path):
    """A long run holds the shuffles of one step on disk, not those of all its steps."""
    from lendlens.session import SHUFFLE_CLEANUP, settle

    counted = spark.range(5000).repartition(4, "id").groupBy((F.col("id") % 700).alias("k")).count()
    setting, before = spark.conf.get(SHUFFLE_CLEANUP, None), _shuffle_files(spark)
    kept = settle(counted)
    assert not _new_shuffle_files(spark, before)
    for fmt in ("csv", "parquet"):
        tables.write_tables({"t": counted}, str(tmp_path), fmt)
    assert not _new_shuffle_files(spark, before)
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == setting  # frames of the caller keep their files
    assert {tuple(r) for r in kept.collect()} == {tuple(r) for r in counted.collect()} and kept.count() == 700
