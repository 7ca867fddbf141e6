"""Joins J1–J19, aggregates A1–A23, windows W1–W14, sorts and set operations, layer plans L1–L6."""

from pyspark.sql import functions as F

from lendlens.functions import economics as E
from lendlens.functions import standardize as S
from lendlens.operators import dedupe, drivers, explore, features, model, ordered, quality, upkeep
from lendlens.plans import gold, silver
from lendlens.session import scratch_folder, settle
from lendlens.sources.catalog import LAYERS

from . import tables_sql as Q
from .registry import check, key_hash_sql

DEALS = "deal_id opportunity_id application_id customer_id deal_type financing_purpose deal_status offer_date:t expected_close_date:t decision_date:t deal_outcome lost_reason commercial_relevance_flag rm_id current_stage"
FACILITIES = "facility_id facility_source_id deal_id application_id product_type commitment_amount:f4 drawn_amount_initial:f4 expected_utilization:f expected_utilized_volume:f4 currency tenor_months:f maturity_date:t repayment_type interest_type collateral_type covenant_package"
PRICING = "pricing_case_id deal_id facility_id quote_id quote_version:i is_final_quote quote_status quote_created_at:t offered_margin_bps:f upfront_fee_bps:f commitment_fee_bps:f utilisation_fee_bps:f arrangement_fee_bps:f floor_margin_bps:f target_margin_bps:f stretch_margin_bps:f margin_above_floor_bps:f rm_override_flag override_reason approval_status final_quote_warning"
RISK = "risk_assessment_id deal_id facility_id rating pd:f8 lgd:f8 ead:f4 rwa:f4 expected_loss:f4 risk_model_version assessment_date:t watchlist_flag"
CUSTOMERS = "customer_id crm_account_id customer_segment industry region country group_id rm_id onboarding_date:t relationship_status annual_revenue_bucket employee_count_bucket is_active_customer"
RELATIONSHIPS = "customer_id snapshot_month:t total_existing_exposure:f4 total_drawn_amount:f4 deposit_balance_avg:f4 existing_product_count:i relationship_revenue_ltm:f4 relationship_cost_ltm:f4 relationship_margin_ltm:f4 days_since_last_contact:i relationship_strength_score:f"
FTP = "ftp_curve_date:t currency product_group tenor_bucket_months:i ftp_bps:f liquidity_cost_bps:f"
ECONOMICS = "deal_id facility_id product_type commitment_amount:f4 expected_utilization:f expected_utilized_volume:f4 tenor_months:f tenor_years:f offered_margin_bps:f annualized_fee_bps:f ftp_bps:f liquidity_cost_bps:f risk_cost_bps:f admin_cost_bps:f capital_cost_bps:f floor_margin_bps:f target_margin_bps:f stretch_margin_bps:f margin_above_floor_bps:f risk_adjusted_margin_bps:f expected_facility_profit_annual:f4 expected_facility_profit_lifetime:f4 pricing_zone"
DEAL_TOTALS = "deal_id anchor_product number_of_facilities:i total_commitment:f4 total_expected_utilized_volume:f4 total_expected_profit_annual:f4 total_expected_profit_lifetime:f4 weighted_avg_margin_above_floor_bps:f min_margin_above_floor_bps:f worst_facility_pricing_zone fee_income_share:f has_rcf has_term_loan has_guarantee has_trade_finance"
DEAL_ECONOMICS = DEAL_TOTALS + " customer_id rm_id deal_complexity_score:f deal_pricing_zone"
FEATURES = "deal_id customer_id rm_id customer_segment industry region rating_at_offer pd_at_offer:f8 lgd_weighted:f8 relationship_strength_score:f existing_product_count:f days_since_last_contact:f anchor_product number_of_facilities:i total_commitment:f4 total_expected_utilized_volume:f4 weighted_avg_margin_above_floor_bps:f min_margin_above_floor_bps:f total_expected_profit_annual:f4 total_expected_profit_lifetime:f4 fee_income_share:f deal_complexity_score:f has_rcf has_term_loan has_guarantee has_trade_finance"
DASHBOARD = "deal_id customer_id rm_id customer_segment industry anchor_product total_commitment:f4 number_of_facilities:i current_stage expected_close_date:t relationship_strength_score:f pricing_zone min_margin_above_floor_bps:f total_expected_profit_annual:f4 total_expected_profit_lifetime:f4 recommended_action_placeholder data_quality_warning_flag"


def names(columns: str) -> str:
    return ", ".join(c.partition(":")[0] for c in columns.split())


def _table(key, columns, sql_table, build):
    @check(key, columns, f"SELECT {names(columns)} FROM {sql_table}")
    def _(ctx):
        return build(ctx)


RUN_SUMMARY_SQL = " UNION ALL ".join(
    f"SELECT '{t.partition('_')[0]}' AS section, '{t}' AS item, count(*) AS value FROM {t}" for layer in LAYERS.values() for t in layer.values()
) + " UNION ALL SELECT 'summary', 'warning_share', 0.0"


# --- layer plans -----------------------------------------------------------------------------

_table("l1_silver_customers", CUSTOMERS, "silver_customers", lambda c: c.customers)
_table("l1_silver_deals", DEALS, "silver_deals", lambda c: c.deals)
_table("l1_silver_facilities", FACILITIES, "silver_facilities", lambda c: c.facilities)
_table("l1_silver_pricing_cases", PRICING, "silver_pricing_cases", lambda c: c.pricing)
_table("l1_silver_risk_assessments", RISK, "silver_risk_assessments", lambda c: c.risk)
_table("l1_silver_relationship_snapshots", RELATIONSHIPS, "silver_relationship_snapshots", lambda c: c.relationships)
_table("l1_silver_ftp_rates", FTP, "silver_ftp_rates", lambda c: c.ftp)
_table("l2_gold_facility_economics", ECONOMICS, "gold_facility_economics", lambda c: c.gold["gold_facility_economics"])
_table("l2_gold_deal_economics", DEAL_ECONOMICS, "gold_deal_economics", lambda c: c.gold["gold_deal_economics"])
_table("l2_gold_deal_training_dataset", FEATURES + " deal_outcome", "gold_deal_training_dataset", lambda c: c.gold["gold_deal_training_dataset"])
_table("l2_gold_active_deal_scoring_dataset", FEATURES + " expected_close_date:t current_stage pricing_zone", "gold_active_deal_scoring_dataset",
       lambda c: c.gold["gold_active_deal_scoring_dataset"])
_table("l2_gold_rm_deal_dashboard", DASHBOARD, "gold_rm_deal_dashboard", lambda c: c.gold["gold_rm_deal_dashboard"])
_table("l3_facility_economics", ECONOMICS, "gold_facility_economics", lambda c: c.economics)
_table("l4_training_features", FEATURES + " deal_status deal_outcome commercial_relevance_flag", "deal_feature_rows", lambda c: c.features)
_table("l4_training_features_as_of", FEATURES + " deal_status deal_outcome commercial_relevance_flag", "deal_feature_rows_as_of", lambda c: c.features_as_of)
_table("l5_rm_dashboard", DASHBOARD, "gold_rm_deal_dashboard", lambda c: gold.rm_dashboard(gold.active_features(c.bronze)))


@check("l6_pipeline_run", "section item value:f", RUN_SUMMARY_SQL)
def _(ctx):
    from lendlens.plans.pipeline import run_pipeline

    return run_pipeline(ctx.spark, ctx.bronze, scratch_folder(ctx.spark)).summary


# --- joins -----------------------------------------------------------------------------------

@check("j1_opportunity_applications", "deal_id application_id financing_purpose", "SELECT deal_id, application_id, financing_purpose FROM silver_deals")
def _(ctx):
    return ctx.deals


@check("j2_facility_deals", "facility_id deal_id application_id", "SELECT facility_id, deal_id, application_id FROM silver_facilities")
def _(ctx):
    return ctx.facilities


@check("j3_quote_facilities", "quote_id facility_id deal_id",
       "SELECT q.quote_id, f.facility_id, f.deal_id FROM bronze_pricing_quotes q JOIN silver_facilities f ON q.facility_source_id = f.facility_source_id")
def _(ctx):
    return ctx["bronze_pricing_quotes"].select("quote_id", "facility_source_id").join(
        ctx.facilities.select("facility_source_id", "facility_id", "deal_id"), "facility_source_id"
    )


@check("j4_risk_facilities", "risk_assessment_id facility_id deal_id",
       "SELECT r.risk_assessment_id, f.facility_id, f.deal_id FROM bronze_risk_assessments r JOIN silver_facilities f ON r.facility_source_id = f.facility_source_id")
def _(ctx):
    return ctx["bronze_risk_assessments"].select("risk_assessment_id", "facility_source_id").join(
        ctx.facilities.select("facility_source_id", "facility_id", "deal_id"), "facility_source_id"
    )


@check("j5_facility_final_pricing", "deal_id facility_id offered_margin_bps:f",
       "SELECT f.deal_id, f.facility_id, p.offered_margin_bps FROM silver_facilities f JOIN silver_pricing_cases p ON f.deal_id = p.deal_id AND f.facility_id = p.facility_id WHERE p.is_final_quote")
def _(ctx):
    final = ctx.pricing.where("is_final_quote").select("deal_id", "facility_id", "offered_margin_bps")
    return ctx.facilities.select("deal_id", "facility_id").join(final, ["deal_id", "facility_id"])


@check("j6_facility_risk", "deal_id facility_id rating pd:f8",
       "SELECT f.deal_id, f.facility_id, r.rating, r.pd FROM silver_facilities f LEFT JOIN silver_risk_assessments r ON f.deal_id = r.deal_id AND f.facility_id = r.facility_id")
def _(ctx):
    keys = ["deal_id", "facility_id"]
    return ctx.facilities.select(*keys).join(ctx.risk.select(*keys, "rating", "pd"), keys, "left")


@check("j7_facility_ftp", "facility_id ftp_bps:f liquidity_cost_bps:f",
       """SELECT f.facility_id, c.ftp_bps, c.liquidity_cost_bps FROM (SELECT facility_id, currency, product_group, tenor_bucket_months FROM facility_costs) f
       LEFT JOIN latest_ftp c ON f.currency = c.currency AND f.product_group = c.product_group AND f.tenor_bucket_months = c.tenor_bucket_months""")
def _(ctx):
    return gold.facility_inputs(ctx.economics_inputs)


@check("j7_facility_ftp_as_of", "facility_id ftp_bps:f liquidity_cost_bps:f", "SELECT facility_id, ftp_bps, liquidity_cost_bps FROM facility_costs_as_of")
def _(ctx):
    return gold.facility_economics(ctx.past_silver, as_of=True)


@check("j11_deal_relationship_as_of", "deal_id application_id existing_product_count:f days_since_last_contact:f relationship_strength_score:f",
       """SELECT d.deal_id, d.application_id, existing_product_count, days_since_last_contact, relationship_strength_score FROM silver_deals d
       JOIN known_deals k ON d.deal_id = k.deal_id ASOF LEFT JOIN silver_relationship_history l ON d.customer_id = l.customer_id AND k.known_until >= l.snapshot_month""")
def _(ctx):
    deals = ctx.kept_deals
    return gold.with_relationship(deals, ctx.past_silver["silver_relationship_snapshots"], gold.known_until(deals))


@check("j8_deal_reference", "deal_id customer_id rm_id number_of_facilities:i",
       "SELECT s.deal_id, o.customer_id, o.rm_id, s.number_of_facilities FROM deal_sums s JOIN deal_owner o ON s.deal_id = o.deal_id")
def _(ctx):
    return gold.deal_economics(ctx.economics, ctx.deals, with_complexity=False)


@check("j9_risk_weights", "deal_id facility_id pd:f8 expected_utilized_volume:f4",
       "SELECT r.deal_id, r.facility_id, r.pd, e.expected_utilized_volume FROM silver_risk_assessments r LEFT JOIN gold_facility_economics e ON r.deal_id = e.deal_id AND r.facility_id = e.facility_id")
def _(ctx):
    keys = ["deal_id", "facility_id"]
    return ctx.economics_inputs["silver_risk_assessments"].select(*keys, "pd").join(ctx.economics.select(*keys, "expected_utilized_volume"), keys, "left")


@check("j10_deal_customers", "deal_id application_id customer_segment region",
       "SELECT d.deal_id, d.application_id, c.customer_segment, c.region FROM silver_deals d LEFT JOIN silver_customers c ON d.customer_id = c.customer_id")
def _(ctx):
    return ctx.deals.join(ctx.customers.select("customer_id", "customer_segment", "region"), "customer_id", "left")


@check("j11_deal_relationship", "deal_id application_id existing_product_count:f days_since_last_contact:f",
       """SELECT d.deal_id, d.application_id, l.existing_product_count, l.days_since_last_contact FROM silver_deals d
       LEFT JOIN latest_relationship l ON d.customer_id = l.customer_id""")
def _(ctx):
    snapshots = ctx["bronze_core_relationship_snapshot"].select(
        S.customer_id("crm_account_id").alias("customer_id"), "snapshot_month", "existing_product_count", "days_since_last_contact"
    )
    return ctx.deals.join(gold.latest_relationship(snapshots), "customer_id", "left")


@check("j12_deals_economics", "deal_id customer_id rm_id anchor_product",
       "SELECT deal_id, customer_id, rm_id, anchor_product FROM deal_feature_rows")
def _(ctx):
    return ctx.lazy_features


@check("j13_deal_risk", "deal_id rating_at_offer pd_at_offer:f8",
       "SELECT s.deal_id, r.rating_at_offer, r.pd_at_offer FROM deal_sums s LEFT JOIN deal_risk r ON s.deal_id = r.deal_id")
def _(ctx):
    return gold.deal_totals(ctx.economics).join(gold.risk_by_deal(ctx.economics_inputs["silver_risk_assessments"], ctx.economics), "deal_id", "left")


@check("j14_aggregate_with_flags", "deal_id number_of_facilities:i has_rcf has_term_loan has_guarantee",
       """SELECT a.deal_id, a.n AS number_of_facilities, b.has_rcf, b.has_term_loan, b.has_guarantee
       FROM (SELECT deal_id, count(*) AS n FROM silver_facilities GROUP BY deal_id) a
       LEFT JOIN (SELECT deal_id, bool_or(product_type LIKE '%RCF%') AS has_rcf, bool_or(product_type LIKE '%Term%') AS has_term_loan,
         bool_or(product_type LIKE '%Guarant%') AS has_guarantee FROM silver_facilities GROUP BY deal_id) b ON a.deal_id = b.deal_id""")
def _(ctx):
    return features.deal_level_features(ctx.facilities)


@check("j15_anti_join_counts", "metric value:i",
       """SELECT 'deals_without_customer' AS metric, count(*) AS value FROM silver_deals WHERE customer_id NOT IN (SELECT customer_id FROM silver_customers)
       UNION ALL SELECT 'raw_facilities_without_application', count(*) FROM latest_facilities f WHERE NOT EXISTS (SELECT 1 FROM latest_applications a WHERE a.application_id = f.application_id)""")
def _(ctx):
    count = F.count(F.lit(1)).alias("value")
    deals = quality.orphans(ctx.deals.select("customer_id"), ctx.customers, "customer_id").agg(count)
    latest = dedupe.latest_by(ctx["bronze_los_facilities"], "facility_source_id").select("application_id")
    loose = quality.orphans(latest, ctx["bronze_los_applications"], "application_id").agg(count)
    return deals.withColumn("metric", F.lit("deals_without_customer")).unionByName(
        loose.withColumn("metric", F.lit("raw_facilities_without_application"))
    )


@check("j16_membership_map", "quote_id facility_id is_final_quote", "SELECT quote_id, facility_id, is_final_quote FROM silver_pricing_cases")
def _(ctx):
    quotes = ctx["bronze_pricing_quotes"].withColumn("quote_status", F.lower("quote_status_raw")).join(
        ctx.facilities.select("facility_source_id", "facility_id"), "facility_source_id"
    )
    return dedupe.flag_final_quotes(quotes.select("facility_id", "quote_id", "quote_version", "quote_status"))


@check("j19_tier_baseline_lookup", "offer_no:i offer_ref:i baseline_probability:f",
       """SELECT o.offer_no, o.offer_ref, b.rate AS baseline_probability FROM loan_offers o
       JOIN (SELECT tier, avg(outcome) AS rate FROM loan_offers WHERE offer_no % 5 <> 0 GROUP BY tier) b ON o.tier = b.tier WHERE o.offer_no % 5 = 0""")
def _(ctx):
    from lendlens.operators.evaluate import tier_rate_baseline

    return tier_rate_baseline(ctx.offers.where("offer_no % 5 <> 0"), ctx.offers.where("offer_no % 5 = 0"))


# --- aggregates ------------------------------------------------------------------------------

@check("a1_deal_economics", DEAL_TOTALS.replace("anchor_product ", "").replace("worst_facility_pricing_zone ", ""),
       "SELECT * FROM deal_sums")
def _(ctx):
    return gold.deal_totals(ctx.economics)


@check("a2_mode_smallest_tie", "deal_id anchor_product", "SELECT deal_id, anchor_product FROM deal_anchor")
def _(ctx):
    return gold.deal_totals(ctx.economics).select("deal_id", "anchor_product")


@check("a3_worst_zone", "facility_id worst_zone",
       """SELECT facility_id, arg_min(zone, CASE zone WHEN 'Red' THEN 0 WHEN 'Guardrail' THEN 1 WHEN 'Recommended' THEN 2 ELSE 3 END) AS worst_zone
       FROM (SELECT facility_id, CASE WHEN offered_margin_bps < floor_margin_bps THEN 'Red' WHEN offered_margin_bps <= floor_margin_bps + 10 THEN 'Guardrail'
         WHEN offered_margin_bps >= stretch_margin_bps THEN 'Stretch' WHEN offered_margin_bps >= target_margin_bps THEN 'Recommended' ELSE 'Guardrail' END AS zone
         FROM silver_pricing_cases) z GROUP BY facility_id""")
def _(ctx):
    zone = E.pricing_zone("offered_margin_bps", "floor_margin_bps", "target_margin_bps", "stretch_margin_bps")
    return ctx.pricing.select("facility_id", zone.alias("zone")).groupBy("facility_id").agg(E.worst_zone("zone").alias("worst_zone"))


@check("a4_fee_income_share", "deal_id fee_income_share:f", "SELECT deal_id, fee_income_share FROM deal_sums")
def _(ctx):
    return ctx.economics.groupBy("deal_id").agg(E.fee_income_share("annualized_fee_bps", "offered_margin_bps").alias("fee_income_share"))


@check("a5_product_flags", "deal_id has_rcf has_term_loan has_guarantee has_trade_finance",
       "SELECT deal_id, has_rcf, has_term_loan, has_guarantee, has_trade_finance FROM deal_sums")
def _(ctx):
    return gold.deal_totals(ctx.economics)


@check("a6_deal_risk", "deal_id rating_at_offer pd_at_offer:f8 lgd_weighted:f8", "SELECT deal_id, rating_at_offer, pd_at_offer, lgd_weighted FROM deal_risk")
def _(ctx):
    return gold.risk_by_deal(ctx.economics_inputs["silver_risk_assessments"], ctx.economics)


_LEVEL_ROWS = """SELECT CASE WHEN CAST(substring(e.deal_id, 5) AS BIGINT) % 10 = 0 THEN NULL ELSE e.deal_id END AS deal_id, e.product_type, e.commitment_amount,
  e.expected_utilized_volume AS v, e.margin_above_floor_bps AS m, e.upfront_fee_bps AS u, e.offered_margin_bps AS o FROM facility_costs e"""


def _level_features(ctx):
    rows = gold.quoted_facilities(ctx.economics_inputs)
    keyed = F.when(F.substring("deal_id", 5, 20).cast("bigint") % 10 != 0, F.col("deal_id"))
    return features.deal_level_features(rows.withColumn("deal_id", keyed).drop("expected_utilized_volume", "margin_above_floor_bps"))


@check("a7_deal_features", "deal_id number_of_facilities:i total_commitment:f4 total_expected_utilized_volume:f4 min_margin_above_floor_bps:f",
       f"SELECT deal_id, count(*) AS number_of_facilities, sum(commitment_amount) AS total_commitment, sum(v) AS total_expected_utilized_volume, min(m) AS min_margin_above_floor_bps FROM ({_LEVEL_ROWS}) r GROUP BY deal_id")
def _(ctx):
    return _level_features(ctx)


@check("a8_weighted_margin", "deal_id weighted_avg_margin_above_floor_bps:f",
       f"SELECT deal_id, sum(m * v) / nullif(sum(v) FILTER (m IS NOT NULL), 0) AS weighted_avg_margin_above_floor_bps FROM ({_LEVEL_ROWS}) r GROUP BY deal_id")
def _(ctx):
    return _level_features(ctx)


@check("a9_fee_share", "deal_id fee_share:f",
       f"SELECT deal_id, CASE WHEN coalesce(sum(o), 0) = 0 THEN 0 ELSE sum(u) / (sum(u) + sum(o)) END AS fee_share FROM ({_LEVEL_ROWS}) r GROUP BY deal_id")
def _(ctx):
    return _level_features(ctx)


@check("a10_regex_flags", "deal_id has_rcf has_term_loan has_guarantee",
       f"""SELECT deal_id, CASE WHEN deal_id IS NOT NULL THEN bool_or(regexp_matches(lower(product_type), 'rcf|revolving|revolver')) END AS has_rcf,
       CASE WHEN deal_id IS NOT NULL THEN bool_or(lower(product_type) LIKE '%term%') END AS has_term_loan,
       CASE WHEN deal_id IS NOT NULL THEN bool_or(lower(product_type) LIKE '%guarant%') END AS has_guarantee FROM ({_LEVEL_ROWS}) r GROUP BY deal_id""")
def _(ctx):
    return _level_features(ctx)


@check("a11_total_profit", "deal_id total_expected_profit:f4",
       "SELECT deal_id, total_expected_profit_lifetime AS total_expected_profit FROM deal_sums")
def _(ctx):
    return ctx.economics.groupBy("deal_id").agg(F.coalesce(F.sum("expected_facility_profit_lifetime"), F.lit(0.0)).alias("total_expected_profit"))


def _closed(ctx):
    rows = gold.quoted_facilities(ctx.economics_inputs).select("deal_id", "facility_id", "product_type", "tenor_months", "margin_above_floor_bps")
    outcomes = ctx.deals.where("deal_outcome IS NOT NULL").select("deal_id", "application_id", "deal_outcome")
    ratings = ctx.economics_inputs["silver_risk_assessments"].select("facility_id", "rating")
    return rows.join(outcomes, "deal_id").join(ratings, "facility_id", "left")


_CLOSED_SQL = """SELECT f.product_type, r.rating, f.tenor_months, f.margin_above_floor_bps, CASE d.deal_outcome WHEN 'won' THEN 1 ELSE 0 END AS won
  FROM facility_costs f JOIN silver_deals d ON f.deal_id = d.deal_id LEFT JOIN silver_risk_assessments r ON f.facility_id = r.facility_id WHERE d.deal_outcome IS NOT NULL"""


@check("a12_win_rate_cuts", "cut_name cut_value n_deals:i win_rate:f",
       " UNION ALL ".join(
           f"SELECT '{c}' AS cut_name, v AS cut_value, count(*) AS n_deals, avg(won) AS win_rate FROM (SELECT {x} AS v, won FROM ({_CLOSED_SQL}) c) t WHERE v IS NOT NULL GROUP BY v"
           for c, x in (
               ("product_type", "product_type"),
               ("rating", "rating"),
               ("tenor_bucket", "CASE WHEN tenor_months BETWEEN 1 AND 12 THEN 'short' WHEN tenor_months BETWEEN 13 AND 36 THEN 'medium' WHEN tenor_months BETWEEN 37 AND 120 THEN 'long' END"),
               ("margin_bucket", "CASE WHEN margin_above_floor_bps <= 0 THEN 'below_floor' WHEN margin_above_floor_bps <= 30 THEN 'guardrail' WHEN margin_above_floor_bps <= 70 THEN 'recommended' WHEN margin_above_floor_bps <= 999 THEN 'stretch' END"),
           )
       ))
def _(ctx):
    return explore.win_rate_by_cuts(explore.add_cuts(_closed(ctx)), ["product_type", "rating", "tenor_bucket", "margin_bucket"])


@check("a13_mean_rate_two_keys", "keys tier:i label mean_rate:f n_loans:i",
       """SELECT 'term' AS keys, tier, CAST(term AS VARCHAR) AS label, avg(rate) AS mean_rate, count(*) AS n_loans FROM loan_offers GROUP BY tier, term
       UNION ALL SELECT 'loan_type', tier, loan_type, avg(rate), count(*) FROM loan_offers GROUP BY tier, loan_type""")
def _(ctx):
    parts = [
        explore.mean_and_count(ctx.offers, ["tier", c], "rate").select(F.lit(c).alias("keys"), "tier", F.col(c).cast("string").alias("label"), "mean_rate", "n_loans")
        for c in ("term", "loan_type")
    ]
    return parts[0].unionByName(parts[1])


@check("a14_trimmed_correlation", "measure series n_rows:i correlation:f",
       " UNION ALL ".join(
           f"""SELECT '{m}' AS measure, series, count(*) AS n_rows, corr(x, outcome) AS correlation FROM (
             SELECT *, quantile_cont(x, 0.025) OVER (PARTITION BY series) AS lo, quantile_cont(x, 0.975) OVER (PARTITION BY series) AS hi
             FROM (SELECT {x} AS x, outcome, unnest(['all', CAST(tier AS VARCHAR)]) AS series FROM loan_offers) l) t WHERE x > lo AND x < hi GROUP BY series"""
           for m, x in (("rate", "rate"), ("spread", "round(rate - reference_rate, 6)"))
       ))
def _(ctx):
    offers = ctx.offers.withColumn("spread", F.round(explore.spread("rate", "reference_rate"), 6))
    parts = [explore.trimmed_correlation(offers, m, "outcome", "tier").withColumn("measure", F.lit(m)) for m in ("rate", "spread")]
    return parts[0].unionByName(parts[1])


_EDGES = ", ".join(f"({i}, CAST('{e!r}' AS DOUBLE), CAST('{f!r}' AS DOUBLE))" for i, (e, f) in enumerate(zip(explore.RATE_EDGES, explore.RATE_EDGES[1:])))
_BINS_SQL = f"""SELECT t.tier, e.b AS bin, count(o.rate) AS n_total, count(o.rate) FILTER (o.outcome = 1) AS n_accepted
  FROM (SELECT DISTINCT tier FROM loan_offers) t CROSS JOIN (VALUES {_EDGES}) e(b, lo, hi)
  LEFT JOIN loan_offers o ON o.tier = t.tier AND o.rate >= e.lo AND (o.rate < e.hi OR (e.b = {len(explore.RATE_EDGES) - 2} AND o.rate = e.hi)) GROUP BY t.tier, e.b"""


@check("a15_fixed_histogram", "tier:i bin:i n_total:i n_accepted:i", _BINS_SQL)
def _(ctx):
    return explore.rate_histogram(ctx.offers, "rate", "outcome", "tier")


@check("a16_acceptance_by_rate", "tier:i bin:i acceptance_rate:f", f"SELECT tier, bin, n_accepted / nullif(n_total, 0) AS acceptance_rate FROM ({_BINS_SQL}) b")
def _(ctx):
    return explore.rate_histogram(ctx.offers, "rate", "outcome", "tier")


_MEASURES = ["rate", "spread", "amount", "term", "fico"]


@check("a17_auto_histograms", "measure tier:i outcome:i lo:f hi:f bin:i n:i",
       " UNION ALL ".join(
           f"""SELECT '{m}' AS measure, tier, outcome, lo, hi, least(floor((x - lo) / (hi - lo) * 10), 9) AS bin, count(*) AS n FROM (
             SELECT tier, outcome, x, min(x) OVER w AS lo, max(x) OVER w AS hi FROM (SELECT tier, outcome, CAST({x} AS DOUBLE) AS x FROM loan_offers) v WINDOW w AS (PARTITION BY tier, outcome)) t GROUP BY ALL"""
           for m, x in zip(_MEASURES, ["rate", "rate - reference_rate", "amount", "term", "fico"])
       ))
def _(ctx):
    offers = ctx.offers.withColumn("spread", explore.spread("rate", "reference_rate"))
    return explore.auto_histograms(offers, _MEASURES, ["tier", "outcome"])


@check("a18_acceptance_percent", "acceptance_percent:f", "SELECT avg(outcome) * 100 AS acceptance_percent FROM loan_offers WHERE tier = 2")
def _(ctx):
    return explore.acceptance_percent(explore.tier_filter(ctx.offers, 2))


@check("a19_acceptance_by_tier", "tier:i acceptance_rate:f", "SELECT tier, avg(outcome) AS acceptance_rate FROM loan_offers GROUP BY tier")
def _(ctx):
    return explore.acceptance_by_tier(ctx.offers)


@check("a20_standardise", "offer_no:i offer_ref:i rate_std:f amount_std:f",
       """SELECT offer_no, offer_ref, (rate - rm) / rs AS rate_std, (amount - am) / s AS amount_std FROM loan_offers,
       (SELECT avg(rate) AS rm, stddev_samp(rate) AS rs, avg(amount) AS am, stddev_samp(amount) AS s FROM loan_offers WHERE tier = 2) q WHERE tier = 2""")
def _(ctx):
    tier = explore.tier_filter(ctx.offers, 2)
    return explore.standardize(tier, explore.standard_stats(tier, ["rate", "amount"]))


@check("a23_row_counts", "table_name n_rows:i",
       " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in Q.EXTRACTS if t.startswith("bronze_")))
def _(ctx):
    return quality.row_counts(ctx.bronze)


# --- windows ---------------------------------------------------------------------------------

_W1 = "facility_source_id application_id product_type_raw commitment_amount:f4 expected_utilisation_raw source_extract_ts:t"


@check("w1_latest_by", _W1, f"SELECT {names(_W1)} FROM latest_facilities")
def _(ctx):
    return dedupe.latest_by(ctx["bronze_los_facilities"], "facility_source_id")


@check("w1_latest_by_null_time", "policy crm_account_id region_raw source_record_status",
       """SELECT 'wins' AS policy, crm_account_id, region_raw, source_record_status FROM bronze_crm_accounts QUALIFY row_number() OVER (PARTITION BY crm_account_id ORDER BY source_extract_ts DESC NULLS FIRST) = 1
       UNION ALL SELECT 'loses', crm_account_id, region_raw, source_record_status FROM bronze_crm_accounts QUALIFY row_number() OVER (PARTITION BY crm_account_id ORDER BY source_extract_ts DESC NULLS LAST) = 1""")
def _(ctx):
    accounts = ctx["bronze_crm_accounts"]
    wins, loses = (dedupe.latest_by(accounts, "crm_account_id", null_ts=p).withColumn("policy", F.lit(p)) for p in ("wins", "loses"))
    return wins.unionByName(loses)


@check("w1_merged_extract", "crm_account_id region_raw source_record_status source_extract_ts:t",
       "SELECT crm_account_id, region_raw, source_record_status, source_extract_ts FROM latest_accounts")
def _(ctx):
    """The later extract merged into a snapshot of the first."""
    raw, folder = ctx["bronze_crm_accounts"], scratch_folder(ctx.spark)
    upkeep.write_snapshot(raw.where("source_record_status = 'current'"), folder, "crm_account_id")
    return upkeep.merge_extract(raw.where("source_record_status = 'updated'"), folder, "crm_account_id")


@check("w2_final_quote", "facility_id final_quote_id", "SELECT facility_id, quote_id AS final_quote_id FROM silver_pricing_cases WHERE is_final_quote")
def _(ctx):
    return dedupe.final_quote_ids(ctx.pricing)


_table("w3_latest_risk", "facility_id risk_assessment_id assessment_date:t", "silver_risk_assessments", lambda c: c.risk)


@check("w4_latest_relationship", "crm_account_id snapshot_month:t existing_product_count:i",
       "SELECT * FROM bronze_core_relationship_snapshot QUALIFY row_number() OVER (PARTITION BY crm_account_id ORDER BY snapshot_month DESC) = 1")
def _(ctx):
    return dedupe.latest_by(ctx["bronze_core_relationship_snapshot"], "crm_account_id", "snapshot_month")


_table("w5_latest_ftp", "currency product_group tenor_bucket_months:i ftp_bps:f liquidity_cost_bps:f", "latest_ftp", lambda c: dedupe.latest_curve(c.ftp))


@check("w6_latest_quote_any_status", "facility_source_id quote_id quote_version:i",
       "SELECT * FROM bronze_pricing_quotes QUALIFY row_number() OVER (PARTITION BY facility_source_id ORDER BY quote_version DESC, quote_id DESC) = 1")
def _(ctx):
    return dedupe.latest_quotes(ctx["bronze_pricing_quotes"])


_RATING_SQL = """SELECT a.opportunity_id, arg_min(upper(coalesce(r.rating_raw, '?')), r.facility_source_id) AS rating_or_gap FROM (
  SELECT * FROM bronze_risk_assessments QUALIFY row_number() OVER (PARTITION BY facility_source_id ORDER BY assessment_date DESC, risk_assessment_id DESC) = 1) r
  JOIN latest_applications a ON r.application_id = a.application_id GROUP BY a.opportunity_id"""


@check("w7_opportunity_rating", "opportunity_id rating_raw", f"SELECT opportunity_id, nullif(rating_or_gap, '?') AS rating_raw FROM ({_RATING_SQL}) x")
def _(ctx):
    return drivers.opportunity_ratings(ctx["bronze_risk_assessments"], ctx["bronze_los_applications"])


@check("w8_percent_rank", "o_orderkey:i price_rank:f priority_rank:f",
       f"SELECT o_orderkey, {Q.pct_rank('o_totalprice')} AS price_rank, {Q.pct_rank('gap')} AS priority_rank FROM (SELECT *, CASE WHEN o_orderkey % 13 <> 0 THEN o_custkey % 7 END AS gap FROM orders) o")
def _(ctx):
    orders = ctx.star("orders").withColumn("gap", F.when(F.col("o_orderkey") % 13 != 0, F.col("o_custkey") % 7))
    return ordered.percent_rank_columns(orders, {"price_rank": "o_totalprice", "priority_rank": "gap"}, keys=["o_orderkey"])


@check("w9_relationship_strength", "customer_id snapshot_month:t relationship_strength_score:f",
       "SELECT customer_id, snapshot_month, relationship_strength_score FROM silver_relationship_snapshots")
def _(ctx):
    return ctx.relationships


_STRENGTH_SQL = f"""SELECT crm_account_id, {Q.clip('s')} AS relationship_strength_score FROM (
  SELECT crm_account_id, ({Q.pct_rank('existing_product_count')}) * 0.35 + ({Q.pct_rank('relationship_revenue_ltm')}) * 0.35 + (1 - ({Q.pct_rank('days_since_last_contact')})) * 0.30 AS s
  FROM (SELECT * FROM bronze_core_relationship_snapshot QUALIFY row_number() OVER (PARTITION BY crm_account_id ORDER BY snapshot_month DESC) = 1) l) x"""


@check("w10_latest_month_strength", "crm_account_id relationship_strength_score:f", _STRENGTH_SQL)
def _(ctx):
    return drivers.latest_strength(ctx["bronze_core_relationship_snapshot"])


@check("w11_deal_complexity", "deal_id deal_complexity_score:f", "SELECT deal_id, deal_complexity_score FROM gold_deal_economics")
def _(ctx):
    return gold.deal_complexity(settle(gold.deal_totals(ctx.economics).select("deal_id", "number_of_facilities", "total_commitment")))


_PRIORITY = "(SELECT o_orderkey AS deal_no, (o_orderkey * 37 % 101) / 100e0 AS win_probability, CASE WHEN o_custkey % 3 = 0 THEN 0.0e0 WHEN o_custkey % 17 = 1 THEN NULL ELSE o_totalprice END AS total_expected_profit FROM orders)"


def _priority(ctx):
    return ctx.star("orders").selectExpr(
        "o_orderkey AS deal_no", "(o_orderkey * 37 % 101) / 100e0 AS win_probability",
        "CASE WHEN o_custkey % 3 = 0 THEN 0.0e0 WHEN o_custkey % 17 = 1 THEN NULL ELSE o_totalprice END AS total_expected_profit",
    )


@check("w12_priority_rank", "deal_no:i expected_deal_value:f4 priority_rank:i",
       f"SELECT deal_no, expected_deal_value, row_number() OVER (ORDER BY expected_deal_value DESC NULLS LAST, win_probability DESC NULLS LAST, deal_no) AS priority_rank FROM (SELECT *, win_probability * total_expected_profit AS expected_deal_value FROM {_PRIORITY} o) p")
def _(ctx):
    return model.prioritise(_priority(ctx), ["deal_no"])


@check("w13_decile", "deal_no:i decile:i",
       "SELECT deal_no, greatest(1, ceil((row_number() OVER (ORDER BY p DESC, deal_no) - 1) * 10 / (count(*) OVER () - 1))) AS decile FROM scored_deals")
def _(ctx):
    ranked = ordered.row_numbers(ctx.scored, [F.col("p").desc(), F.col("deal_no").asc()], "_r", total="_n")
    return ranked.select("deal_no", ordered.decile(F.col("_r"), F.col("_n")).alias("decile"))


@check("w14_first_row", "facility_source_id source_extract_ts:t commitment_amount:f4",
       f"SELECT * FROM bronze_los_facilities QUALIFY row_number() OVER (PARTITION BY facility_source_id ORDER BY source_extract_ts NULLS LAST, {', '.join(c + ' NULLS LAST' for c in Q.FACILITY_TIE.split(', '))}) = 1")
def _(ctx):
    return drivers.first_facilities(ctx["bronze_los_facilities"])


# --- sorts, limits, set operations -------------------------------------------------------------

@check("t1_priority_top", "deal_no:i expected_deal_value:f4",
       f"SELECT deal_no, expected_deal_value FROM (SELECT *, win_probability * total_expected_profit AS expected_deal_value FROM {_PRIORITY} o) p ORDER BY expected_deal_value DESC NULLS LAST, win_probability DESC NULLS LAST, deal_no LIMIT 25")
def _(ctx):
    valued = _priority(ctx).withColumn("expected_deal_value", E.expected_deal_value("win_probability", "total_expected_profit"))
    return model.top_deals(valued, 25, ["deal_no"])


@check("t2_top_one_per_group", "o_custkey:i o_orderkey:i o_totalprice:f",
       "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def _(ctx):
    return dedupe.top_row(ctx.star("orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()])


@check("t3_seeded_sample", "opportunity_id deal_status",
       f"SELECT DISTINCT opportunity_id, deal_status, {key_hash_sql('1', 'opportunity_id')} AS place FROM silver_deals WHERE deal_status = 'active' ORDER BY place, opportunity_id LIMIT 8")
def _(ctx):
    return model.seeded_sample(ctx.deals.where("deal_status = 'active'").select("opportunity_id", "deal_status").distinct(), 8, ["opportunity_id"], 1)


@check("u1_union_all", "source_record_status n:i",
       "SELECT source_record_status, count(*) AS n FROM (SELECT source_record_status FROM bronze_crm_accounts WHERE source_record_status <> 'updated' UNION ALL SELECT source_record_status FROM bronze_crm_accounts WHERE source_record_status = 'updated') u GROUP BY 1")
def _(ctx):
    accounts = ctx["bronze_crm_accounts"]
    base, late = accounts.where("source_record_status <> 'updated'"), accounts.where("source_record_status = 'updated'")
    return base.unionByName(late).groupBy("source_record_status").agg(F.count(F.lit(1)).alias("n"))


@check("u2_union_of_layers", "table_name n_rows:i",
       " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for layer in LAYERS.values() for t in layer.values()))
def _(ctx):
    return quality.row_counts({**ctx.bronze, **ctx.key_silver, **ctx.key_gold}, one_by_one=True)


@check("u4_value_difference", "value", "SELECT DISTINCT lower(stage_raw) AS value FROM bronze_crm_opportunities EXCEPT SELECT * FROM (VALUES ('closed won'), ('closed lost')) v")
def _(ctx):
    return quality.unexpected_values(ctx["bronze_crm_opportunities"], "stage_raw", ["closed won", "closed lost"])
