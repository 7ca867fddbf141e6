"""Entry points, plan shapes, and agreement of a set of quick queries with their SQL.

``LENDLENS_ALL_CHECKS=1`` compares every query (several minutes)."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from lendlens.checks import CHECKS
from lendlens.plans.gold import facility_economics
from lendlens.session import settle

from .conftest import SMALL

QUICK = [
    "f1_customer_id", "f4_segment", "f8_lost_reason", "f10_parse_utilization", "f23_tenor_bucket", "f32_pricing_zone", "p6_quantile_trim", "j1_opportunity_applications",
    "j3_quote_facilities", "a13_mean_rate_two_keys", "a15_fixed_histogram", "a17_auto_histograms", "w1_latest_by", "w1_latest_by_null_time", "w8_percent_rank",
    "w12_priority_rank", "w13_decile", "q1_profile", "q4_bronze_summary", "m11_roc_auc", "m12_average_precision", "m15_roc_curve", "o3_posterior_summary", "o6_acceptance_curve",
    "o12_profit_price", "g5_application_status", "g7_modelled_ftp", "l3_facility_economics", "s6_parquet_sink", "s9_schema_registry",
    "f15_case_folds", "m4_one_hot", "m5_split", "t3_seeded_sample", "o4_prior_predictive", "o8_profit_curves", "o13_split", "q2_profile_tables",
    "j11_deal_relationship_as_of", "w1_merged_extract", "o2_posterior_draws", "o3_weighted_summary", "s7_format_checks", "u3_missing_columns", "q8_forbidden_columns",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{name}'")
    return con


def rows(frame):
    def plain(v):
        if v is None or v != v:
            return None
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else (v.item() if hasattr(v, "item") else v)

    ordered = frame[sorted(frame.columns)]
    return sorted(([plain(v) for v in r] for r in ordered.itertuples(index=False, name=None)), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("key", sorted(CHECKS) if os.environ.get("LENDLENS_ALL_CHECKS") else QUICK)
def test_query_agrees_with_sql(spark, duck, key):
    got = entry.queries()[key](spark, SMALL).toPandas()
    sql = entry.oracle_sql().get(key)
    if sql is None:
        assert len(got) > 0
        return
    want = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_entry(spark):
    df = entry.entry(spark)
    ranks = [r.priority_rank for r in df.orderBy("priority_rank").collect()]
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) > 100


def test_every_inventory_family_is_registered():
    have = {re.match(r"[a-z]\d+", k).group() for k in CHECKS}
    need = {f"{p}{i}" for p, n in {"f": 43, "j": 19, "a": 23, "w": 14, "t": 3, "m": 17, "o": 13, "g": 9, "l": 6, "s": 12, "q": 11}.items() for i in range(1, n + 1)}
    need |= {f"p{i}" for i in range(1, 10)} | {f"u{i}" for i in range(1, 5)}
    assert need - have == set()


@pytest.mark.parametrize("build", [
    lambda c: facility_economics({**c.economics_inputs, "silver_ftp_rates": settle(c.ftp)}),
    lambda c: c.pricing, lambda c: c.risk, lambda c: c.deals, lambda c: c.customers, lambda c: c.lazy_features,
])
def test_core_plans(context, build):
    plan = build(context)._jdf.queryExecution().executedPlan().toString()
    for banned in ("SinglePartition", "PythonEval", "BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "NestedLoopJoin"):
        assert banned not in plan, banned


def test_dashboard_of_active_deals_drops_others_first(context):
    from lendlens.plans import gold, silver

    raw = silver.touched_facilities(context.bronze, context.kept_deals.where("deal_status = 'active'"))
    for name in ("bronze_los_facilities", "bronze_pricing_quotes", "bronze_risk_assessments"):
        assert "LeftSemi" in raw[name]._jdf.queryExecution().optimizedPlan().toString()
        assert 0 < raw[name].count() < context[name].count()
    few = gold.rm_dashboard(gold.active_features(context.bronze)).toPandas()
    assert rows(few) == rows(gold.rm_dashboard(context.lazy_features).toPandas()) and len(few) > 100


def test_scans_read_only_needed_columns(context):
    plan = context["bronze_los_facilities"].select("facility_source_id", "currency")._jdf.queryExecution().executedPlan().toString()
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert {c.partition(":")[0] for c in schema.split(",")} == {"l_orderkey", "l_linenumber", "l_suppkey"}


def test_tier_filter_reaches_the_scan(context):
    plan = context.offers.where("amount > 50000").select("amount")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_extendedprice,50000.0)" in plan


def test_facility_economics_write_no_rank_and_no_deal_table(context, monkeypatch):
    """A mart is built from what it reads alone."""
    from lendlens.checks import Context
    from lendlens.operators import ordered
    from lendlens.plans import gold

    def refuse(*_args, **_kwargs):
        raise AssertionError("not needed here")

    monkeypatch.setattr(ordered, "rank_table", refuse)
    monkeypatch.setattr(gold, "deal_totals", refuse)
    assert "pricing_zone" in Context(context.spark, SMALL).gold["gold_facility_economics"].columns


def test_deal_features_read_neither_risk_nor_curves(context):
    plan = CHECKS["a7_deal_features"].build(context)._jdf.queryExecution().executedPlan().toString()
    assert "rating_raw" not in plan and "ftp_bps" not in plan


def test_run_summary_scans_each_table_once(context):
    from lendlens.operators.quality import _bronze, _measure

    plan = _measure(_bronze(context.bronze), with_rows=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("c_custkey") and plan.count("Relation [l_orderkey") == 1
