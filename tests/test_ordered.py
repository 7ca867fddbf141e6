"""Global order statistics against pandas and NumPy, under any partitioning."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lendlens.operators import ordered


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    n = 3000
    hot = np.where(rng.random(n) < 0.4, 7.0, rng.normal(0, 50, n).round(1))  # one value holds 40 % of the rows
    few = rng.integers(0, 4, n).astype(float)
    hot[rng.random(n) < 0.05] = np.nan
    return pd.DataFrame({"id": np.arange(n), "hot": hot, "few": few, "grp": rng.choice(["a", "b", "c"], n, p=[0.8, 0.15, 0.05])})


def to_spark(spark, pdf, parts):
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).to_records(index=False).tolist(), "id int, hot double, few double, grp string")
    return df.repartition(parts)


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_percent_rank(spark, frame, parts):
    got = ordered.percent_rank_columns(to_spark(spark, frame, parts), {"r1": "hot", "r2": "few"}).toPandas().sort_values("id")
    np.testing.assert_allclose(got["r1"].to_numpy(), frame["hot"].rank(pct=True).to_numpy(), rtol=0, atol=1e-15)
    np.testing.assert_allclose(got["r2"].to_numpy(), frame["few"].rank(pct=True).to_numpy(), rtol=0, atol=1e-15)


def test_percent_rank_by_keys_writes_narrow_rows(spark, frame):
    df = to_spark(spark, frame, 5).withColumn("wide", F.lit("x" * 50))
    keyed = ordered.percent_rank_columns(df, {"r1": "hot", "r2": "few", "r3": "id"}, keys=["id"])
    assert keyed.columns == [*df.columns, "r1", "r2", "r3"]
    got = keyed.toPandas().sort_values("id")
    for output, column in (("r1", "hot"), ("r2", "few"), ("r3", "id")):
        np.testing.assert_allclose(got[output].to_numpy(), frame[column].rank(pct=True).to_numpy(), rtol=0, atol=1e-15)
    some = df.where("id % 10 = 0")
    part = ordered.percent_rank_columns(some, {"r1": "hot"}, among=df, keys=["id"]).toPandas().sort_values("id")
    np.testing.assert_allclose(part["r1"].to_numpy(), frame["hot"].rank(pct=True).to_numpy()[::10], rtol=0, atol=1e-15)


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_row_numbers(spark, frame, parts):
    order = [F.col("hot").desc_nulls_last(), F.col("few").desc_nulls_last(), F.col("id").asc()]
    got = ordered.row_numbers(to_spark(spark, frame, parts), order, "rn", total="n").toPandas().sort_values("id")
    want = frame.sort_values(["hot", "few", "id"], ascending=[False, False, True], na_position="last").reset_index(drop=True)
    rank = pd.Series(np.arange(1, len(want) + 1), index=want["id"]).sort_index()
    assert got["rn"].tolist() == rank.tolist() and set(got["n"]) == {len(frame)}


def test_quantiles(spark, frame):
    probs = [0.0, 0.025, 0.5, 0.7, 0.975, 1.0]
    df = to_spark(spark, frame, 5)
    whole = ordered.quantiles(df, "hot", probs).first()
    np.testing.assert_allclose([whole[f"q{i}"] for i in range(len(probs))], frame["hot"].quantile(probs).to_numpy(), atol=1e-12)
    for row in ordered.quantiles(df, "hot", probs, "grp").collect():
        want = frame.loc[frame["grp"] == row["grp"], "hot"].quantile(probs).to_numpy()
        np.testing.assert_allclose([row[f"q{i}"] for i in range(len(probs))], want, atol=1e-12)
    medians = {r["series"]: r["q0"] for r in ordered.column_quantiles(df, ["hot", "few"], [0.5]).collect()}
    assert medians == {"hot": frame["hot"].median(), "few": frame["few"].median()}


def test_ordered_bits_are_the_doubles_order(spark):
    rng = np.random.default_rng(8)
    patterns = rng.integers(0, 1 << 64, 4000, dtype=np.uint64).view(np.float64)
    powers = np.ldexp(1.0, np.arange(-1074, 1024))
    edges = np.array([0.0, -0.0, np.inf, -np.inf, np.nan, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, 0.1, 3.0])
    values = np.concatenate([patterns[~np.isnan(patterns)], powers, -powers, np.nextafter(powers, 0), np.nextafter(powers, np.inf), edges])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)] + [(-1, None)], "i int, v double")
    rows = df.select("i", "v", ordered.ordered_bits(F.col("v")).alias("b")).withColumn("back", ordered.double_of(F.col("b"))).collect()
    for r in rows:
        if r.v is None:
            assert r.b is None
        elif r.v == r.v:
            want = int(np.array([abs(r.v)]).view(np.int64)[0]) * (-1 if r.v < 0 else 1)
            assert r.b == want and r.back == r.v, r.v
        else:
            assert r.b > max(x.b for x in rows if x.v is not None and x.v == x.v) and r.back != r.back


def test_quantiles_of_continuous_values_without_a_sort(spark):
    rng = np.random.default_rng(9)
    values = np.concatenate([rng.normal(0, 1, 4000) * 10.0 ** rng.integers(-300, 300, 4000), rng.normal(1e9, 1e-3, 4000)])
    df = spark.createDataFrame([(float(v), int(i % 3)) for i, v in enumerate(values)], "v double, w int")
    probs = [0.0, 0.001, 0.25, 0.5, 0.999, 1.0]
    found = ordered.quantiles(df, "v", probs)
    np.testing.assert_allclose(list(found.first()[2:]), np.quantile(values, probs), rtol=1e-12)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    weighted = ordered.quantiles(df, "v", probs, weight="w").first()
    want = np.quantile(np.repeat(values, np.arange(len(values)) % 3), probs)
    assert weighted["n_values"] == sum(i % 3 for i in range(len(values)))
    np.testing.assert_allclose(list(weighted[2:]), want, rtol=1e-12)


def test_prefix_counts_by_series(spark, frame):
    df = to_spark(spark, frame, 3).withColumn("y", (F.col("id") % 2).cast("int"))
    got = ordered.prefix_counts(df, "few", "grp", {"pos": F.col("y")}).toPandas()
    odd = frame.assign(y=frame["id"] % 2)
    for r in got.itertuples():
        rest = odd[odd["grp"] == r.grp]
        below, same = rest[rest["few"] < r.few], rest[rest["few"] == r.few]
        assert (r.n, r.pos, r.n_before, r.pos_before, r.n_total, r.pos_total) == (len(same), same.y.sum(), len(below), below.y.sum(), len(rest), rest.y.sum())


def test_the_bits_of_a_value_are_computed_once(spark, frame, monkeypatch):
    """Copies of the logarithm in a plan are work per value: the expression must not be repeated in itself or in a filter."""
    plans, settle = [], ordered.settle

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString().lower())
        return settle(df)

    monkeypatch.setattr(ordered, "settle", seen)
    df = to_spark(spark, frame, 3)
    ordered.column_quantiles(df, ["hot", "few"], [0.25, 0.5]).collect()
    assert [p.count("log2(") for p in plans if "log2(" in p] == [1]


def test_empty_input(spark):
    empty = spark.createDataFrame([], "id int, hot double")
    assert ordered.percent_rank_columns(empty, {"r": "hot"}).count() == 0
    assert ordered.row_numbers(empty, [F.col("id").asc()]).count() == 0
    assert ordered.quantiles(empty, "hot", [0.5]).count() == 0


def test_all_null_column(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id int, hot double")
    assert [r.r for r in ordered.percent_rank_columns(df, {"r": "hot"}).collect()] == [None, None]


def test_deciles_follow_quantile_cuts(spark):
    for n in (2, 9, 10, 11, 12, 57, 91, 100, 171, 361):
        df = spark.range(1, n + 1).select(F.col("id"), ordered.decile(F.col("id"), n).alias("d"))
        got = [r.d for r in df.orderBy("id").collect()]
        want = pd.qcut(np.arange(1, n + 1), q=10, labels=False, duplicates="drop") + 1
        assert got == want.tolist(), n


def test_single_row_is_first_decile(spark):
    assert spark.range(1, 2).select(ordered.decile(F.col("id"), 1)).first()[0] == 1


@pytest.mark.parametrize("build", [
    lambda df: ordered.percent_rank_columns(df, {"r": "hot"}),
    lambda df: ordered.row_numbers(df, [F.col("hot").desc_nulls_last(), F.col("id").asc()]),
    lambda df: ordered.prefix_counts(df, "hot"),
])
def test_no_single_partition(spark, frame, build):
    plan = build(to_spark(spark, frame, 4))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "BatchEvalPython" not in plan and "NestedLoop" not in plan


def test_wide_rows_are_shuffled_once_for_any_number_of_ranks(spark, frame):
    df = to_spark(spark, frame, 4).withColumn("payload", F.repeat(F.lit("x"), 5))
    out = ordered.percent_rank_columns(df, {"r1": "hot", "r2": "few", "r3": "id"})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        physical = out.drop("r1")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    wide = [line for line in plan.splitlines() if "Join" in line]
    assert sum("_row" in line for line in wide) == 1 and "payload" in physical


def test_any_number_of_labels_is_a_series(spark):
    df = spark.range(100_000).select(F.concat(F.lit("s"), F.col("id")).alias("label"), (F.col("id") % 7).cast("double").alias("x"))
    got = ordered.prefix_counts(df, "x", "label")
    assert got.where("n_total <> 1 OR n_before <> 0").count() == 0 and got.count() == 100_000


def test_modes_take_the_smallest_on_ties(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "x"), ("b", "y"), ("a", None), (None, None)], "s string, t string")
    assert {r.series: r.mode_value for r in ordered.column_modes(df, ["s", "t"]).collect()} == {"s": "a", "t": "x"}


def test_column_quantiles_read_brackets_only(spark, monkeypatch):
    """Large columns never become one row per value: only what lies around the wanted ranks is counted and selected from."""
    rng = np.random.default_rng(5)
    n, probs = 30_000, [0.0, 0.25, 0.5, 0.995]
    pdf = pd.DataFrame({"plain": rng.normal(0, 10, n), "hot": np.where(rng.random(n) < 0.6, 0.0, rng.normal(0, 1, n)), "flag": rng.random(n) < 0.3, "none": np.nan})
    rows = [tuple(None if v != v else v for v in r) for r in pdf.itertuples(index=False, name=None)]
    df = spark.createDataFrame(rows, "plain double, hot double, flag boolean, none double").repartition(6)
    monkeypatch.setattr(ordered, "_long", None)
    got = {r["series"]: r for r in ordered.column_quantiles(df, ["plain", "hot", "flag", "none"], probs).collect()}
    assert set(got) == {"plain", "hot", "flag"} and all(r["n_values"] == n for r in got.values())
    for c, r in got.items():
        np.testing.assert_allclose([r[f"q{i}"] for i in range(len(probs))], pdf[c].astype(float).quantile(probs).to_numpy(), rtol=0, atol=1e-12)


def test_column_quantiles_survive_a_bad_bracket(spark, monkeypatch):
    """A bracket that misses its rank is noticed by the counts and all values are read."""
    df = spark.range(5000).select((F.col("id") % 4999).cast("double").alias("v"), F.lit(float("nan")).alias("w"))
    monkeypatch.setattr(ordered, "_MARGIN", 0.0)
    got = {r["series"]: r["q0"] for r in ordered.column_quantiles(df, ["v", "w"], [0.5]).collect()}
    assert got["v"] == np.median(np.arange(5000) % 4999) and np.isnan(got["w"])
