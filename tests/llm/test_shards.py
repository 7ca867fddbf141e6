from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendlens.llm.queries import QUERIES
from lendlens.llm.shards import permute, row_at, shard_rows


@pytest.mark.parametrize("n", [1, 2, 3, 40, 1000, 65537])
def test_permutation_and_its_inverse(n):
    p = permute(np.arange(n), n, 17)
    assert sorted(p.tolist()) == list(range(n))
    assert permute(p, n, 17, backwards=True).tolist() == list(range(n))
    if n >= 1000:
        assert permute(np.arange(n), n, 18).tolist() != p.tolist()
        assert abs(np.corrcoef(np.arange(n), p)[0, 1]) < 0.1


def test_rows_law_and_places(spark):
    rows = [(i if i % 7 else None, i % 3) for i in range(500)] + [(5, 1)] * 3
    df = spark.createDataFrame(rows, "doc_id long, shard int")
    out = shard_rows(df.withColumn("x", F.col("shard")), [F.col("doc_id"), F.col("x")], 40).collect()
    assert len(out) == 503
    counts = Counter(r["shard"] for r in out)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(40))
    for shard in counts:
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(counts[shard]))
    assert all(row_at(r["shard"], r["slot"], 503, 40, 17) == r["row_number"] for r in out[:50])
    again = shard_rows(df.withColumn("x", F.col("shard")).repartition(7), [F.col("doc_id"), F.col("x")], 40).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, out))
    assert shard_rows(df.limit(0), [F.col("doc_id")], 40).count() == 0


def test_internal_names_do_not_clash(spark):
    names = ["_n", "_block", "_pos", "_off", "_p", "_total", "_id", "slot", "row_number"]
    df = spark.createDataFrame([(i, *[i * 2] * len(names)) for i in range(50)], ", ".join(f"{n} long" for n in ["doc_id", *names]))
    out = shard_rows(df, [F.col("doc_id")], 7)
    assert out.columns == ["doc_id", *names[:-2], "row_number", "shard", "slot"]
    rows = out.collect()
    assert sorted(r["row_number"] for r in rows) == list(range(50)) and all(r["_pos"] == 2 * r["doc_id"] for r in rows)


def test_query_columns(spark, small, documents):
    """The query's columns against a plain version."""
    import zlib

    got = {r["doc_id"]: r for r in QUERIES["op4_shards"](spark, small).collect()}
    rows = documents.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    slots = Counter()
    for r in rows:
        data, mine = (r["text"] or "").encode(), got[r["doc_id"]]
        assert (mine["size"], mine["text_crc32"], mine["law"], mine["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "rows", None)
        slots[mine["shard"], mine["slot"]] += 1
    counts = Counter(s for s, _ in slots)
    assert max(slots.values()) == 1 and all(sorted(t for s, t in slots if s == shard) == list(range(n)) for shard, n in counts.items())
    place = permute(np.arange(len(rows)), len(rows), 17)
    for number, r in enumerate(sorted(rows, key=lambda r: r["doc_id"])):
        assert got[r["doc_id"]]["shard"] == place[number] % 40 and got[r["doc_id"]]["slot"] == place[number] // 40
