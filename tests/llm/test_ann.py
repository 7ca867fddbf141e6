import numpy as np
import pytest

from lendlens.llm.ann import nearest
from lendlens.llm.common import table


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        s = (x * x[list(ids).index(q)]).sum(axis=1)
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(s[i])) for i in order]
    return out


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_recall(spark, folder):
    from pyspark.sql import functions as F

    vectors = table(spark, f"/root/testdata/{folder}", "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    got: dict = {}
    for r in nearest(vectors, vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    rows = vectors.orderBy("vec_id").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    want = brute(ids, x, [i for i in ids.tolist() if i % 20 == 0], 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    scores = {(q, i): s for q, own in want.items() for i, s in own}
    assert all(s == scores[q, i] for q, own in got.items() for i, s in own if (q, i) in scores)


def test_odd_vectors_ties_and_a_common_vector(spark, monkeypatch):
    from lendlens.llm import ann

    monkeypatch.setattr(ann, "PART", 50)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[100:300] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [1.0, None] * 4), (1004, [float("inf")] * 8), (1005, [1.0]), (None, [1.0] * 8), (0, x[0].tolist())]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, vector array<float>")
    got: dict = {}
    asked = vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    for r in nearest(vectors, asked).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["rank"]))
    assert set(got) == set(range(0, 400, 20))
    assert [i for i, _ in got[120]] == [i for i in range(100, 121) if i != 120]
    assert all([n for _, n in own] == list(range(1, 21)) for own in got.values())


def test_few_and_no_rows(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 2.0])], "vec_id long, vector array<double>")
    asked = vectors.where("vec_id = 0").withColumnRenamed("vec_id", "query_id")
    assert [tuple(r) for r in nearest(vectors, asked).orderBy("rank").collect()] == [(0, 1, 1, 0.5), (0, 2, 2, 0.0)]
    assert nearest(vectors.limit(0), asked).count() == 0 and nearest(vectors, asked.limit(0)).count() == 0


def test_all_lists_within_the_ratio_are_read(monkeypatch):
    from lendlens.llm import ann

    monkeypatch.setattr(ann, "BEAM", 16)
    x = np.random.default_rng(4).normal(size=(3200, 64))
    index = ann.Index.fit(x, float(np.sqrt((x**2).sum(1).max())), 240)
    k = len(index.centroids)
    r, lists = index.readings(x[:50], np.full(k, 1000), 63)
    points = index.lifted(x[:50] * (index.norm / np.sqrt((x[:50] ** 2).sum(1)))[:, None], index.norm)
    dist = np.sqrt(((points[:, None] - index.centroids[None]) ** 2).sum(-1))
    want = np.argwhere(dist <= ann.PRUNE * np.maximum(dist.min(1, keepdims=True), index.radius))
    found = {tuple(p) for p in want.tolist()} & set(zip(r.tolist(), lists.tolist()))
    assert len(want) > 50 * 16 and len(found) >= 0.99 * len(want)  # the graph search itself is approximate


def test_the_ratio_follows_the_measured_recall(spark, monkeypatch):
    from lendlens.llm import ann

    monkeypatch.setattr(ann, "PRUNE", 1.0)
    monkeypatch.setattr(ann, "EDGE", 1.0)
    x = np.random.default_rng(6).normal(size=(3000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vector array<double>")
    got: dict = {}
    for r in nearest(vectors, vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute(np.arange(3000), x, range(0, 3000, 20), 20)
    assert sum(len({i for i, _ in own} & got[q]) for q, own in want.items()) >= 0.9 * 20 * len(want)
