from collections import Counter

import pytest
from pyspark.sql import functions as F

from lendlens.operators.dedupe import latest_by
from lendlens.operators.upkeep import bucket, merge_extract, read_snapshot, write_snapshot

SCHEMA = "k int, source_extract_ts int, v string"


def rows(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("late", [False, True])
def test_merging_equals_one_pass(spark, tmp_path, late):
    first = spark.createDataFrame([(i % 50, i, f"a{i}") for i in range(200)] + [(None, 1, "n"), (7, None, "no time")], SCHEMA)
    second = spark.createDataFrame([(3, 500, "new"), (4, 1, "too old"), (99, 5, "other key"), (3, 500, "tie"), (None, 2, "n2")], SCHEMA)
    if late:
        first, second = second, first  # the older extract comes last
    path = str(tmp_path / "snapshot.parquet")
    write_snapshot(first, path, "k", buckets=16)
    got = merge_extract(second, path, "k", buckets=16)
    assert got.columns == first.columns
    want = rows(latest_by(first.union(second), "k"))
    assert rows(got) == want
    assert rows(merge_extract(second, path, "k", buckets=16)) == want  # merging again changes nothing
    assert rows(merge_extract(second.limit(0), path, "k", buckets=16)) == want


def test_only_touched_partitions_are_read_and_written(spark, tmp_path):
    first = spark.createDataFrame([(i, 1, "a") for i in range(300)], SCHEMA)
    path = str(tmp_path / "snapshot.parquet")
    write_snapshot(first, path, ["k"], buckets=8)
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "snapshot.parquet").rglob("*.parquet")}
    delta = spark.createDataFrame([(5, 2, "b")], SCHEMA)
    place = delta.select(bucket(["k"], 8)).first()[0]
    merge_extract(delta, path, ["k"], buckets=8)
    after = {f: f.stat().st_mtime_ns for f in (tmp_path / "snapshot.parquet").rglob("*.parquet")}
    changed = {f.parent.name for f in before.keys() ^ after.keys()} | {f.parent.name for f in before.keys() & after.keys() if before[f] != after[f]}
    assert changed == {f"__bucket={place}"}
    plan = read_snapshot(first, path).where(F.col("__bucket").isin([place]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(__bucket" in plan or "PartitionFilters: [__bucket" in plan or "isnotnull(__bucket" in plan
