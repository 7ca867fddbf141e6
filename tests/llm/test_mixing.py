from collections import Counter

from pyspark.sql import functions as F

from lendlens.llm.mixing import mix, take_copies, word_count


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        total = sum(w[s] for s in open_)
        above = {s for s in open_ if left * w[s] / total > most * sizes[s]}
        if not above:
            target |= {s: left * w[s] / total for s in open_}
            break
        for s in above:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= above
    return target


def frame(spark):
    rows = [(i, "w " * (i % 13), ["a", "a", "a", "b", None, "é"][i % 6], "extra") for i in range(900)]
    rows += [(None, "one two", "c", "x"), (7, None, "a", "x"), (7, None, "a", "x"), (1000, "", "zero", "x"), (1001, "long " * 20000, "c", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string")


def test_targets_and_copies(spark):
    df = frame(spark)
    out = mix(df).collect()
    sizes, taken = Counter(), Counter()
    for r in out:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
    assert len(out) == df.count() and sizes["zero"] == 0
    want = brute_targets(sizes)
    for r in out:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert 0 <= r["copies"] <= 2 and r["source_size"] == sizes[r["source"]]
    for s in ("a", "b", None, "é"):
        assert abs(taken[s] - want[s]) <= 13 * 2
    again = mix(df.repartition(9)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, out))


def test_crossings_of_integers(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("source"))
    by = Counter((r["source"], r["copies"]) for r in mix(df).collect())
    # 2000 words for two sources with weights 3 and 1: 3000 shared, x stops at 2000, y gets 1000
    assert by == {("x", 2): 500, ("y", 1): 500}


def test_rows_are_taken_as_often_as_chosen(spark):
    df = frame(spark)
    chosen = Counter()
    for r in mix(df).collect():
        chosen[r["doc_id"], r["source"], r["size"]] += r["copies"]
    taken = take_copies(df)
    assert taken.columns == df.columns
    got = Counter((r["doc_id"], r["source"], r["n"]) for r in taken.withColumn("n", word_count(F.col("text"))).collect())
    assert got == +chosen
    assert take_copies(df.limit(0)).count() == mix(df.limit(0)).count() == 0


def test_clashing_names_pass_through(spark):
    df = frame(spark).selectExpr("*", "doc_id AS _size", "'t' AS _twin", "1 AS copies", "2 AS target")
    rows = take_copies(df).collect()
    assert all(r["_size"] == r["doc_id"] and r["_twin"] == "t" and r["copies"] == 1 and r["target"] == 2 for r in rows) and rows


def test_word_count(spark):
    texts = [None, "", " \t\n", "a", " a\x0bb\x0cc ", "a\u00a0b c\x1fd"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(word_count(F.col("t"))).collect()] == [0, 0, 0, 1, 3, 2]
