import pytest
from pyspark.sql import functions as F

from lendlens.operators import features, quality
from lendlens.sources import catalog

COLUMNS = "deal_id string, product_type string, commitment_amount double, expected_utilization double, offered_margin_bps double, floor_margin_bps double, upfront_fee_bps double"
ROWS = [("D1", "RCF", 100.0, 0.5, 150.0, 100.0, 10.0), ("D1", "Term Loan", 200.0, 1.0, 160.0, 120.0, 20.0), ("D2", "Guarantee", 300.0, 0.2, 170.0, 130.0, 30.0)]


def test_facility_features(spark):
    df = spark.createDataFrame([(150.0, 120.0, 24, 1e6, 0.5)], "offered_margin_bps double, floor_margin_bps double, tenor_months int, commitment_amount double, expected_utilization double")
    row = features.add_expected_volume(features.add_tenor_years(features.add_margin_above_floor(df))).first()
    assert (row.margin_above_floor_bps, row.tenor_years, row.expected_utilized_volume) == (30.0, 2.0, 500_000.0)
    bare = spark.range(1)
    assert features.add_expected_volume(features.add_tenor_years(features.add_margin_above_floor(bare))).columns == ["id"]


def test_deal_features(spark):
    got = {r.deal_id: r for r in features.deal_level_features(spark.createDataFrame(ROWS, COLUMNS)).collect()}
    d1 = got["D1"]
    assert (d1.number_of_facilities, d1.total_commitment, d1.total_expected_utilized_volume, d1.min_margin_above_floor_bps) == (2, 300.0, 250.0, 40.0)
    assert (d1.has_rcf, d1.has_term_loan, d1.has_guarantee) == (True, True, False)
    assert d1.weighted_avg_margin_above_floor_bps == pytest.approx((50 * 50 + 40 * 200) / 250)
    assert d1.fee_share == pytest.approx(30 / 340) and got["D2"].has_guarantee


def test_deal_features_edges(spark):
    rows = [(None, "RCF", 10.0, 0.5, 150.0, 100.0, 10.0), ("Z", "RCF", 0.0, 0.5, 0.0, 100.0, 10.0), ("N", None, 10.0, 0.5, None, 100.0, 10.0)]
    got = {r.deal_id: r for r in features.deal_level_features(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got[None].number_of_facilities == 1 and got[None].has_rcf is None
    assert got["Z"].weighted_avg_margin_above_floor_bps is None and got["Z"].fee_share == 0.0
    assert got["N"].weighted_avg_margin_above_floor_bps is None and got["N"].has_rcf is False
    slim = features.deal_level_features(spark.createDataFrame([("D",)], "deal_id string")).first()
    assert (slim.fee_share, slim.total_commitment, slim.min_margin_above_floor_bps) == (0.0, 0.0, None)
    with pytest.raises(ValueError):
        features.deal_level_features(spark.range(1))


def test_validation(spark):
    result = quality.validate_deals(spark.createDataFrame([("D1",)], "deal_id string"))
    assert not result.is_valid and "customer_id" in result.missing_columns
    df = spark.createDataFrame([("D1", "C1", "closed_won", "won", True), ("D1", "C1", "active", "pending", None)],
                               "deal_id string, customer_id string, deal_status string, deal_outcome string, commercial_relevance_flag boolean")
    result = quality.validate_deals(df)
    assert result.is_valid
    warnings = list(result.warnings())
    assert any("unexpected_outcome: pending" in w for w in warnings) and any("duplicate_deal_id" in w for w in warnings)
    assert any("missing_relevance_flag" in w for w in warnings)


def test_every_unexpected_outcome_is_listed(spark):
    df = spark.range(1500).selectExpr("CAST(id AS STRING) AS deal_id", "'c' AS customer_id", "'active' AS deal_status", "concat('odd ', id) AS deal_outcome", "true AS commercial_relevance_flag")
    warnings = list(quality.validate_deals(df).warnings())
    assert sum(w.startswith("unexpected_outcome") for w in warnings) == 1500


def test_required_columns_and_value_difference(spark):
    with pytest.raises(ValueError, match="b"):
        quality.require_columns(spark.createDataFrame([(1,)], "a int"), ["a", "b"])
    df = spark.createDataFrame([("Won",), ("odd",), (None,)], "x string")
    assert [r.value for r in quality.unexpected_values(df, "x", ["won"]).collect()] == ["odd"]


def test_profile_matches_sketch_on_small_data(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", 1.5), (3, None, 1.5)], "i int, s string, d double")
    exact = {r.column_name: (r.dtype, r.row_count, r.missing, r.unique_values, r.column_count) for r in quality.profile(df).collect()}
    assert exact == {"i": ("int", 3, 0, 3, 3), "s": ("string", 3, 1, 1, 3), "d": ("double", 3, 1, 1, 3)}
    sketch = {r.column_name: (r.dtype, r.row_count, r.missing, r.unique_values, r.column_count) for r in quality.profile(df, approximate=True).collect()}
    assert sketch == exact


def test_surplus_counts_missing_key_once(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (None,), ("b",)], "k string")
    assert quality.surplus_rows(df, "k").first()[0] == 2


def test_policy_guard(spark):
    bad = {"t": spark.createDataFrame([(1,)], "Competitor_Rate int")}
    assert catalog.forbidden_columns(bad) == ["t.Competitor_Rate"]
    with pytest.raises(ValueError):
        catalog.assert_no_forbidden_columns(bad)


def test_catalog(spark):
    assert len(catalog.tables_by_layer("bronze")) == 9 and len(catalog.tables_by_layer("silver")) == 7 and len(catalog.tables_by_layer("gold")) == 5
    assert {e.layer for e in catalog.ENTRIES} == {"bronze", "silver", "gold", "model", "application"}
    deals = catalog.REGISTRY["silver_deals"]
    assert deals.primary_key == "deal_id" and deals.foreign_keys == {"customer_id": "silver_customers.customer_id"}
    assert all(e.source_system for e in catalog.tables_by_layer("bronze").values())
    edges = {tuple(r) for r in catalog.lineage_edges(spark).select("from_table", "to_table").collect()}
    assert ("bronze_treasury_ftp_rates", "silver_ftp_rates") in edges and ("gold_deal_economics", "gold_rm_deal_dashboard") in edges
    assert catalog.source_edges(spark).count() == 9


def test_field_lineage_names_real_columns(layers, spark):
    bronze, silver, gold = layers
    tables = {**bronze, **silver, **gold}
    for r in catalog.field_edges(spark).collect():
        for table, column in ((r.from_table, r.from_column), (r.to_table, r.to_column)):
            if table in tables and column:
                assert column in tables[table].columns, (table, column)
    registry = {r["name"]: r for r in catalog.registry_table(spark, tables).collect()}
    for e in catalog.ENTRIES:
        if e.name in tables:
            assert registry[e.name]["columns"] == tables[e.name].columns
            assert set((e.primary_key or "").split(",")) - {""} | set(e.foreign_keys) <= set(tables[e.name].columns), e.name


def test_summaries(layers):
    bronze, silver, gold = layers
    summary = {(r.layer, r.metric): r.value for r in quality.quality_summary(bronze, silver, gold).collect()}
    assert summary[("bronze", "duplicate_crm_account_rows")] > 0 and summary[("bronze", "missing_region_rows")] > 0
    assert summary[("silver", "active_deals_with_outcome")] == 0 and summary[("all", "warning_count")] == 0
    assert summary[("gold", "training_outcome_values")] == 2
    share = [r.value for r in quality.run_summary(bronze, silver, gold).where("item = 'warning_share'").collect()]
    assert share == [0.0]


def test_warning_is_counted(layers):
    bronze, silver, gold = layers
    poor = silver["silver_deals"].withColumn("deal_outcome", F.lit("won"))
    summary = quality.quality_summary(bronze, {**silver, "silver_deals": poor}, gold).where("metric = 'warning_count'").first()
    assert summary.value == 1
    found = quality.quality_warnings(bronze, {**silver, "silver_deals": poor}, gold).collect()
    assert [(r.layer, r.warning) for r in found] == [("silver", "active_deals_with_outcome")] and found[0].value > 0
