import itertools

import pytest

from lendlens.operators import dedupe


def test_latest_resolves_ties_and_null_times(spark):
    rows = [("a", "2024-01-01", 1), ("a", "2024-01-02", 2), ("a", "2024-01-02", 3), ("b", None, 4), ("b", "2024-05-01", 5)]
    for order in itertools.islice(itertools.permutations(rows), 0, 120, 17):
        df = spark.createDataFrame(list(order), "k string, ts string, v int").selectExpr("k", "CAST(ts AS TIMESTAMP_NTZ) AS ts", "v").repartition(3)
        assert {(r.k, r.v) for r in dedupe.latest_by(df, "k", "ts").collect()} == {("a", 3), ("b", 4)}
        assert {(r.k, r.v) for r in dedupe.latest_by(df, "k", "ts", null_ts="loses").collect()} == {("a", 3), ("b", 5)}
    with pytest.raises(ValueError):
        dedupe.latest_by(df, "k", "ts", null_ts="maybe")


def test_latest_keeps_one_row_per_map_task(spark):
    df = spark.range(1000).selectExpr("id % 3 AS k", "id AS ts", "id AS v")
    plan = dedupe.latest_by(df, "k", "ts")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # before and after the exchange


def test_final_quote(spark):
    rows = [("F1", "q1", 1, "approved"), ("F1", "q2", 2, "draft"), ("F2", "q3", 1, "draft"), ("F2", "q4", 2, "rejected"), ("F3", "q5", 1, None),
            ("F4", "q6", 1, "submitted"), ("F4", "q7", 3, "approved"), ("F4", "q8", 4, "draft")]
    df = spark.createDataFrame(rows, "facility_id string, quote_id string, quote_version int, quote_status string")
    assert {tuple(r) for r in dedupe.final_quote_ids(df).collect()} == {("F1", "q1"), ("F2", "q4"), ("F3", "q5"), ("F4", "q7")}
    flagged = {r.quote_id for r in dedupe.flag_final_quotes(df).where("is_final_quote").collect()}
    assert flagged == {"q1", "q4", "q5", "q7"}


def test_final_quote_across_raw_ids_of_one_facility(spark):
    quotes = spark.createDataFrame(
        [("FS1", "q1", 1, "Approved"), ("X-1", "q2", 2, "Submitted"), ("X-2", "q3", 9, "Approved")],
        "facility_source_id string, quote_id string, quote_version int, quote_status_raw string")
    keys = spark.createDataFrame([("FS1", "FAC00000001", "D1"), ("X-1", "FAC00000001", "D2")], "facility_source_id string, facility_id string, deal_id string")
    got = {(r.facility_source_id, r.final_quote_id) for r in dedupe.facility_final_quotes(quotes, keys).collect()}
    assert got == {("FS1", "q2"), ("X-1", "q2")}


def test_latest_curve(spark):
    rows = [("EUR", "Trade", 12, "2024-01-01", 1.0), ("EUR", "Trade", 12, "2024-04-01", 2.0), (None, "Trade", 12, "2024-04-01", 3.0)]
    df = spark.createDataFrame(rows, "currency string, product_group string, tenor_bucket_months int, ftp_curve_date string, ftp_bps double").selectExpr("*", "ftp_bps AS liquidity_cost_bps")
    curve = dedupe.latest_curve(df)
    assert [tuple(r) for r in curve.collect()] == [("EUR", "Trade", 12, 2.0, 2.0)]


def test_ties_are_settled_up_to_the_last_wanted_column(spark):
    rows = [("a", 1, "x", 5.0, "p"), ("a", 1, "x", None, "q"), ("a", 1, None, 9.0, "z"), ("b", 2, None, 1.0, "r"), ("b", None, "y", 2.0, "s")]
    df = spark.createDataFrame(rows, "k string, ts int, c string, v double, tail string").repartition(3)
    few = dedupe.latest_by(df, "k", "ts", tie=dedupe.tie_break(df, ["k", "ts"], ["v"])).select("k", "v")
    assert {tuple(r) for r in few.collect()} == {tuple(r) for r in dedupe.latest_by(df, "k", "ts").select("k", "v").collect()} == {("a", 5.0), ("b", 2.0)}
    exchanges = [line for line in few._jdf.queryExecution().optimizedPlan().toString().splitlines() if "tail" in line and "Window" in line]
    assert not exchanges  # what is behind the last wanted column orders nothing
    assert len(dedupe.tie_break(df, ["k", "ts"])) == 3 and dedupe.tie_break(df, ["k", "ts"], ["k"]) == []
