from collections import Counter

import pytest
import xxhash

from lendlens.llm.components import components
from lendlens.llm.simhash import fingerprint, keep_one, near_duplicates


def brute_fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows, radius=2):
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[find(i)] = min(low.get(find(i), k), k)
    return Counter((k, f"{fps[i]:016x}", low.get(find(i))) for i, (k, _) in enumerate(rows))


def rows_of(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    for i, (k, t) in enumerate(rows[:40]):
        words = t.split()
        words[len(words) // 2 : len(words) // 2] = ["extra"]
        rows.append((1000 + i, " ".join(words)))
    return rows + [(None, rows[0][1]), (2000, None), (2001, ""), (2002, " \t"), (5, rows[5][1]), (2003, "One two"), (2004, "one  TWO"), (2005, "w " * 150_000)]


def test_equals_brute_force(spark, documents):
    rows = rows_of(documents)
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, fingerprint string")
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in near_duplicates(df).collect())
    assert got == brute_groups(rows)
    assert near_duplicates(df.limit(0)).count() == 0
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({g for _, _, g in brute_groups(rows)})


def test_small_tiles(spark, documents, monkeypatch):
    from lendlens.llm import simhash

    monkeypatch.setattr(simhash, "TILE", 2)
    rows = rows_of(documents)[:120]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in near_duplicates(df, radius=8).collect())
    assert got == brute_groups(rows, 8)


@pytest.mark.parametrize("text", ["", "a", "A b", "a b c", "É é  X\x0by z \x1c q", "a " * 70_000])
def test_fingerprint(text):
    assert fingerprint(text.encode(), 3) == brute_fingerprint(text)


def test_components_of_a_path_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (200, 200), (301, 300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(50)}, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one_with_null_and_repeated_ids(spark):
    base = [" ".join(f"{w}{i}" for i in range(40)) for w in "abcdefgh"]
    rows = [
        (None, base[0], "x"), (None, base[1], "x"), (None, base[1], "x"),  # two groups without any id
        (1, base[2], "x"), (7, base[2], "x"), (7, base[3], "x"),  # 7 repeats: one row is a copy of 1, the other is not
        (8, base[4], "x"), (8, base[5], "x"), (None, base[5], "x"),  # 8 stands for two texts
        (9, base[6], "b"), (9, base[6], "a"), (10, None, "x"), (11, "", "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = keep_one(df)
    assert kept.columns == df.columns
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    empty = next((k, t) for k, t in got if not t)
    assert empty == (10, None)
    assert got == Counter([(None, base[0]), (None, base[1]), (1, base[2]), (7, base[3]), (8, base[4]), (8, base[5]), (9, base[6]), (10, None)])
    assert keep_one(df.limit(0)).count() == 0
