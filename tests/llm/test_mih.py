import numpy as np
import pytest

from lendlens.llm.mih import SegmentIndex, sign_code, top_k


def brute(rows, queries, k):
    out = set()
    for q, c in queries:
        if q is None or c is None:
            continue
        best = sorted({(((c ^ code) & (2**64 - 1)).bit_count(), i) for i, code in rows if i is not None and code is not None})[:k]
        out |= {(q, n + 1, i, d) for n, (d, i) in enumerate(best)}
    return out


def random_rows(n, seed):
    rng = np.random.default_rng(seed)
    codes = rng.integers(-(2**63), 2**63 - 1, n, dtype=np.int64)
    codes[n // 2 :] = codes[rng.integers(0, n // 2, n - n // 2)] ^ (1 << rng.integers(0, 62, n - n // 2))
    codes[: n // 5] = codes[0]  # a very common code
    return list(enumerate(codes.tolist()))


@pytest.mark.parametrize("k", [1, 10])
def test_equals_brute_force(spark, k, monkeypatch):
    from lendlens.llm import mih

    monkeypatch.setattr(mih, "BLOCK", 100)
    rows = [*random_rows(600, 1), (None, 5), (601, None), (3, random_rows(600, 1)[3][1])]
    queries = [(i, c) for i, c in rows if i is not None and i % 50 == 0] + [(None, 1), (9, None)]
    got = top_k(
        spark.createDataFrame([(i, c, 0) for i, c in rows], "id long, code long, rank int"),
        spark.createDataFrame([(q, c) for q, c in queries], "query_id long, code long"), k,
    )
    assert {tuple(r) for r in got.collect()} == brute(rows, queries, k)


def test_few_rows_and_none(spark):
    rows = spark.createDataFrame([(1, 0), (2, -1)], "id long, code long")
    asked = spark.createDataFrame([(1, 0)], "query_id long, code long")
    assert {tuple(r) for r in top_k(rows, asked, 10).collect()} == {(1, 1, 1, 0), (1, 2, 2, 64)}
    assert top_k(rows.limit(0), asked, 10).count() == 0 and top_k(rows, asked.limit(0), 10).count() == 0


def test_search_stops_once_covered():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    index = SegmentIndex(codes)
    for q in codes[:30]:
        at, d = index.nearest(q ^ np.uint64(5), 3, np.ones(len(codes), np.int64))
        exact = np.sort(np.bitwise_count(codes ^ (q ^ np.uint64(5))))[:3]
        assert sorted(d.tolist())[:3] == exact.tolist()


def test_sign_code(spark):
    rows = [([1.0, -1.0, 2.0],), ([0.0, float("nan"), float("inf"), 1.0],), ([None, 3.0],), ([],), ([1.0] * 70,)]
    df = spark.createDataFrame(rows, "v array<double>")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(sign_code(F.col("v"))).collect()] == [[5], [8], [2], [], [-1, 63]]


def test_wide_vectors_count_with_all_components(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 80)))]
    vectors[1] = (1, [*vectors[0][1][:64], *(-x for x in vectors[0][1][64:])])  # differs in the last 16 components alone
    vectors[2] = (2, vectors[0][1][:64])  # shorter: what it has not is not positive
    from pyspark.sql import functions as F

    codes = spark.createDataFrame(vectors, "id long, v array<double>").select("id", sign_code(F.col("v")).alias("code"))
    asked = codes.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    got = {(r["query_id"], r["id"]): r["distance"] for r in top_k(codes, asked, 300).collect()}
    assert len(got) == 6 * 300
    for (q, i), d in got.items():
        a, b = ([x > 0 for x in vectors[j][1]] + [False] * (80 - len(vectors[j][1])) for j in (q, i))
        assert d == sum(x != y for x, y in zip(a, b))
    assert got[0, 1] == 16


def test_only_queries_are_copied(spark, monkeypatch):
    from lendlens.llm import mih

    monkeypatch.setattr(mih, "BLOCK", 50)
    rows = random_rows(500, 4)
    codes = spark.createDataFrame(rows, "id long, code long")
    seen = spark.sparkContext.accumulator(0)
    plain = mih._search

    def counting(k, words):
        run = plain(k, words)

        def counted(batches):
            def each():
                for batch in batches:
                    seen.add(batch.num_rows)
                    yield batch

            yield from run(each())

        return counted

    monkeypatch.setattr(mih, "_search", counting)
    asked = codes.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    assert top_k(codes, asked, 3).count() == 30
    distinct = len({c for _, c in rows})
    assert seen.value == distinct + 10 * -(-distinct // 50)
