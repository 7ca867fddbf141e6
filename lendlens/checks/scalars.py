"""Column rules F1–F43 and predicates P1–P9 over whole tables."""

from pyspark.sql import functions as F

from lendlens.functions import economics as E
from lendlens.functions import standardize as S
from lendlens.functions import text as X
from lendlens.operators import explore, features
from lendlens.operators.drivers import facility_drivers
from lendlens.plans import gold

from . import tables_sql as Q
from .registry import check


def _ids(key, rule, prefix, width):
    @check(
        key,
        "c_custkey:i from_name from_segment from_long",
        f"""SELECT c_custkey, {Q.sid('c_name', prefix, width)} AS from_name, {Q.sid('c_mktsegment', prefix, width)} AS from_segment,
        {Q.sid('long_key', prefix, width)} AS from_long FROM (SELECT *, CASE WHEN c_custkey % 9 <> 0 THEN concat('x-', CAST(c_custkey AS STRING), '/123456789') END AS long_key FROM customer) c""",
    )
    def _(ctx):
        long_key = F.when(F.col("c_custkey") % 9 != 0, F.concat(F.lit("x-"), F.col("c_custkey").cast("string"), F.lit("/123456789")))
        return ctx.star("customer").select(
            "c_custkey", rule("c_name").alias("from_name"), rule("c_mktsegment").alias("from_segment"), rule(long_key).alias("from_long")
        )


_ids("f1_customer_id", S.customer_id, "CUST", 6)
_ids("f2_deal_id", S.deal_id, "DEAL", 7)
_ids("f3_facility_id", S.facility_id, "FAC", 8)


def _raw(key, table, row_key, columns, values, sql):
    """A rule applied to every row of one extract."""

    @check(key, f"{row_key} {columns}", f"SELECT {row_key}, {sql} FROM {table}")
    def _(ctx):
        return ctx[table].select(row_key, *values())


_raw("f4_segment", "bronze_crm_accounts", "crm_account_id", "source_record_status customer_segment",
     lambda: ["source_record_status", S.segment("customer_segment_raw").alias("customer_segment")],
     f"source_record_status, {Q.segment('customer_segment_raw')} AS customer_segment")
_raw("f5_currency", "bronze_crm_opportunities", "opportunity_id", "currency",
     lambda: [S.currency("currency_raw").alias("currency")], f"{Q.currency('currency_raw')} AS currency")
_raw("f6_deal_status", "bronze_crm_opportunities", "opportunity_id", "deal_status unknown_stage",
     lambda: [S.deal_status("stage_raw").alias("deal_status"), S.unknown_stage("stage_raw").alias("unknown_stage")],
     f"""{Q.status('stage_raw')} AS deal_status, coalesce({Q.norm('stage_raw')} NOT IN
     ('prospecting', 'origination', 'credit review', 'negotiation', 'closed won', 'closed lost', 'withdrawn'), true) AS unknown_stage""")
_raw("f7_deal_outcome", "bronze_crm_opportunities", "opportunity_id", "deal_outcome",
     lambda: [S.deal_outcome("stage_raw").alias("deal_outcome")], f"{Q.outcome('stage_raw')} AS deal_outcome")
_raw("f8_lost_reason", "bronze_crm_opportunities", "opportunity_id", "lost_reason",
     lambda: [S.lost_reason("lost_reason_raw").alias("lost_reason")], f"{Q.lost_reason('lost_reason_raw')} AS lost_reason")


@check("f9_commercial_relevance", "opportunity_id commercial_relevance_flag",
       f"SELECT opportunity_id, {Q.relevance('reason', 'result', 'state')} AS commercial_relevance_flag FROM (SELECT opportunity_id, {Q.lost_reason('lost_reason_raw')} AS reason, {Q.outcome('stage_raw')} AS result, {Q.status('stage_raw')} AS state FROM bronze_crm_opportunities) o")
def _(ctx):
    rows = ctx["bronze_crm_opportunities"].select(
        "opportunity_id", S.lost_reason("lost_reason_raw").alias("r"), S.deal_outcome("stage_raw").alias("o"), S.deal_status("stage_raw").alias("s")
    )
    return rows.select("opportunity_id", S.commercial_relevance("r", "o", "s").alias("commercial_relevance_flag"))


_FAC = "facility_source_id"


@check("f10_parse_utilization", "facility_source_id product_type expected_utilization:f",
       f"SELECT facility_source_id, product_type, {Q.utilisation('expected_utilisation_raw', 'product_type')} AS expected_utilization FROM (SELECT *, {Q.product('product_type_raw')} AS product_type FROM bronze_los_facilities) f")
def _(ctx):
    rows = ctx["bronze_los_facilities"].withColumn("product_type", S.product("product_type_raw"))
    return rows.select(_FAC, "product_type", S.utilisation("expected_utilisation_raw", "product_type").alias("expected_utilization"))


_raw("f11_product", "bronze_los_facilities", _FAC, "product_type", lambda: [S.product("product_type_raw").alias("product_type")],
     f"{Q.product('product_type_raw')} AS product_type")
_raw("f12_number_or_percent", "bronze_risk_assessments", "risk_assessment_id", "pd:f8 lgd:f8",
     lambda: [X.number_or_percent("pd_raw").alias("pd"), X.number_or_percent("lgd_raw").alias("lgd")],
     f"{Q.number('pd_raw')} AS pd, {Q.number('lgd_raw')} AS lgd")
_raw("f13_rating", "bronze_risk_assessments", "risk_assessment_id", "rating", lambda: [S.rating("rating_raw").alias("rating")],
     f"{Q.rating('rating_raw')} AS rating")
_raw("f14_exact_replace", "bronze_los_facilities", _FAC, "interest_type", lambda: [S.replace_value("interest_type_raw", "floater", "Floating").alias("interest_type")],
     "CASE interest_type_raw WHEN 'floater' THEN 'Floating' ELSE interest_type_raw END AS interest_type")
_raw("f15_case_folds", "bronze_los_facilities", _FAC, "repayment_type upper_text lower_text",
     lambda: [X.title_case("repayment_type_raw").alias("repayment_type"), F.upper("repayment_type_raw").alias("upper_text"), F.lower("collateral_type_raw").alias("lower_text")],
     f"{Q.title('repayment_type_raw')} AS repayment_type, upper(repayment_type_raw) AS upper_text, lower(collateral_type_raw) AS lower_text")
_raw("f16_active_customer", "bronze_crm_accounts", "crm_account_id", "is_active_customer",
     lambda: [S.is_active_customer("relationship_status_raw").alias("is_active_customer")],
     "coalesce(lower(relationship_status_raw), '') = 'active' AS is_active_customer")
_raw("f17_tolerant_number", "bronze_los_facilities", _FAC, "value:f", lambda: [X.clean_double("expected_utilisation_raw").alias("value")],
     "TRY_CAST(expected_utilisation_raw AS DOUBLE) AS value")

_DATE_TEXT = "CASE WHEN o_orderkey % 7 = 0 THEN 'not a date' WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END"


@check("f18_tolerant_date", "o_orderkey:i order_date:t",
       f"SELECT o_orderkey, TRY_CAST({_DATE_TEXT} AS TIMESTAMP) AS order_date FROM orders")
def _(ctx):
    return ctx.star("orders").select("o_orderkey", X.clean_timestamp(F.expr(_DATE_TEXT)).alias("order_date"))


@check("f19_offer_date", "deal_id application_id offer_date:t",
       "SELECT o_deal.deal_id, o_deal.application_id, o_deal.offer_date FROM silver_deals o_deal")
def _(ctx):
    return ctx.deals.select("deal_id", "application_id", "offer_date")


_raw("f20_default_fill", "bronze_pricing_quotes", "quote_id", "commitment_fee_bps:f arrangement_fee_bps:f",
     lambda: [F.coalesce(X.clean_double(c), F.lit(0.0)).alias(c) for c in ("commitment_fee_bps", "arrangement_fee_bps")],
     "coalesce(commitment_fee_bps, 0) AS commitment_fee_bps, coalesce(arrangement_fee_bps, 0) AS arrangement_fee_bps")
_raw("f21_concat_id", "bronze_pricing_quotes", "quote_id", "pricing_case_id",
     lambda: [F.concat(F.lit("PC-"), "quote_id").alias("pricing_case_id")], "'PC-' || quote_id AS pricing_case_id")
_raw("f22_product_group", "bronze_los_facilities", _FAC, "product_group", lambda: [E.product_group(S.product("product_type_raw")).alias("product_group")],
     f"CASE {Q.product('product_type_raw')} WHEN 'RCF' THEN 'Committed Lines' WHEN 'Overdraft' THEN 'Committed Lines' WHEN 'Term Loan' THEN 'Term Lending' WHEN 'Guarantee' THEN 'Guarantee' ELSE 'Trade' END AS product_group")
_raw("f23_tenor_bucket", "bronze_los_facilities", _FAC, "tenor_months:f tenor_bucket_months:i",
     lambda: ["tenor_months", E.tenor_bucket("tenor_months").alias("tenor_bucket_months")],
     f"tenor_months, {Q.TENOR_BUCKET} AS tenor_bucket_months")
_raw("f24_tenor_years", "bronze_los_facilities", _FAC, "tenor_years:f", lambda: [E.tenor_years("tenor_months").alias("tenor_years")],
     "tenor_months / 12.0 AS tenor_years")


def _economics(key, columns):
    names = ", ".join(c.partition(":")[0] for c in columns.split())

    @check(key, f"deal_id facility_id {columns}", f"SELECT deal_id, facility_id, {names} FROM gold_facility_economics")
    def _(ctx):
        return ctx.economics


_economics("f25_annualized_fee", "annualized_fee_bps:f")
_economics("f26_risk_cost", "risk_cost_bps:f")
_economics("f27_admin_cost", "admin_cost_bps:f")
_economics("f28_capital_cost", "capital_cost_bps:f")
_economics("f29_risk_adjusted_margin", "risk_adjusted_margin_bps:f")
_economics("f30_facility_profit", "expected_facility_profit_annual:f4 expected_facility_profit_lifetime:f4")


@check("f31_expected_deal_value", "deal_no:i expected_value:f4 tolerant_value:f4",
       """SELECT deal_no, p * amount AS expected_value, CASE WHEN q BETWEEN 0 AND 1 THEN q * amount END AS tolerant_value
       FROM (SELECT o_orderkey AS deal_no, (o_orderkey % 101) / 100e0 AS p, (o_orderkey % 121) / 100e0 AS q, o_totalprice AS amount FROM orders) o""")
def _(ctx):
    rows = ctx.star("orders").select(
        F.col("o_orderkey").alias("deal_no"), (F.col("o_orderkey") % 101 / 100.0).alias("p"), (F.col("o_orderkey") % 121 / 100.0).alias("q"), "o_totalprice"
    )
    return rows.select(
        "deal_no",
        E.expected_deal_value("p", "o_totalprice").alias("expected_value"),
        E.expected_deal_value("q", "o_totalprice", strict=False).alias("tolerant_value"),
    )


@check("f32_pricing_zone", "quote_id zone zone_wide_buffer zone_with_cost",
       """SELECT quote_id,
         CASE WHEN o < f THEN 'Red' WHEN o <= f + 10 THEN 'Guardrail' WHEN o >= s THEN 'Stretch' WHEN o >= t THEN 'Recommended' ELSE 'Guardrail' END AS zone,
         CASE WHEN o < f THEN 'Red' WHEN o <= f + 25 THEN 'Guardrail' WHEN o >= s THEN 'Stretch' WHEN o >= t THEN 'Recommended' ELSE 'Guardrail' END AS zone_wide_buffer,
         CASE WHEN o < f THEN 'Red' WHEN o - 120 < 0 THEN 'Red' WHEN o <= f + 10 THEN 'Guardrail' WHEN o >= s THEN 'Stretch' WHEN o >= t THEN 'Recommended' ELSE 'Guardrail' END AS zone_with_cost
       FROM (SELECT quote_id, offered_margin_bps AS o, floor_margin_bps AS f, target_margin_bps AS t, stretch_margin_bps AS s FROM bronze_pricing_quotes) q""")
def _(ctx):
    args = ("offered_margin_bps", "floor_margin_bps", "target_margin_bps", "stretch_margin_bps")
    return ctx["bronze_pricing_quotes"].select(
        "quote_id",
        E.pricing_zone(*args).alias("zone"),
        E.pricing_zone(*args, buffer=25.0).alias("zone_wide_buffer"),
        E.pricing_zone(*args, F.col("offered_margin_bps") - 120).alias("zone_with_cost"),
    )


@check("f33_deal_zone", "deal_id deal_pricing_zone",
       "SELECT deal_id, CASE WHEN total_expected_profit_lifetime < 0 OR severity = 0 THEN 'Red' WHEN severity = 1 THEN 'Guardrail' WHEN severity = 2 THEN 'Recommended' ELSE 'Stretch' END AS deal_pricing_zone FROM deal_sums")
def _(ctx):
    totals = gold.deal_totals(ctx.economics)
    return totals.select("deal_id", E.deal_zone("total_expected_profit_lifetime", "worst_facility_pricing_zone").alias("deal_pricing_zone"))


@check("f34_margin_above_floor", "quote_id margin_above_floor_bps:f",
       "SELECT quote_id, offered_margin_bps - floor_margin_bps AS margin_above_floor_bps FROM bronze_pricing_quotes")
def _(ctx):
    return features.add_margin_above_floor(ctx["bronze_pricing_quotes"])


@check("f35_expected_volume", "facility_id expected_utilized_volume:f",
       "SELECT facility_id, commitment_amount * expected_utilization AS expected_utilized_volume FROM silver_facilities")
def _(ctx):
    return features.add_expected_volume(ctx.facilities.drop("expected_utilized_volume"))


@check("f36_recommended_action", "deal_id recommended_action_placeholder",
       "SELECT deal_id, recommended_action_placeholder FROM gold_rm_deal_dashboard")
def _(ctx):
    return gold.rm_dashboard(ctx.lazy_features)


@check("f37_missing_flag", "quote_id flag",
       "SELECT quote_id, arrangement_fee_bps IS NULL OR offered_margin_bps IS NULL AS flag FROM bronze_pricing_quotes")
def _(ctx):
    return ctx["bronze_pricing_quotes"].select("quote_id", E.any_missing("arrangement_fee_bps", "offered_margin_bps").alias("flag"))


@check("f38_final_quote_warning", "quote_id is_final_quote final_quote_warning",
       "SELECT quote_id, is_final_quote, final_quote_warning FROM silver_pricing_cases")
def _(ctx):
    return ctx.pricing


@check("f39_clip", "quote_id clipped:f",
       "SELECT quote_id, CASE WHEN x < 0 THEN 0 WHEN x > 1 THEN 1 ELSE x END AS clipped FROM (SELECT quote_id, (offered_margin_bps - 100) / 100 AS x FROM bronze_pricing_quotes) q")
def _(ctx):
    return ctx["bronze_pricing_quotes"].select("quote_id", X.clamp01((F.col("offered_margin_bps") - 100) / 100).alias("clipped"))


@check("f40_sigmoid", "quote_id value:f",
       "SELECT quote_id, 1 / (1 + exp(-(offered_margin_bps - floor_margin_bps) / 40)) AS value FROM bronze_pricing_quotes")
def _(ctx):
    return ctx["bronze_pricing_quotes"].select("quote_id", E.sigmoid((F.col("offered_margin_bps") - F.col("floor_margin_bps")) / 40).alias("value"))


_CUT_SQL = """CASE WHEN tenor_months > 0 AND tenor_months <= 12 THEN 'short' WHEN tenor_months > 12 AND tenor_months <= 36 THEN 'medium'
    WHEN tenor_months > 36 AND tenor_months <= 120 THEN 'long' END AS tenor_bucket,
  CASE WHEN margin_above_floor_bps > -999 AND margin_above_floor_bps <= 0 THEN 'below_floor' WHEN margin_above_floor_bps > 0 AND margin_above_floor_bps <= 30 THEN 'guardrail'
    WHEN margin_above_floor_bps > 30 AND margin_above_floor_bps <= 70 THEN 'recommended' WHEN margin_above_floor_bps > 70 AND margin_above_floor_bps <= 999 THEN 'stretch' END AS margin_bucket"""


@check("f41_fixed_bins", "facility_id tenor_bucket margin_bucket", f"SELECT facility_id, {_CUT_SQL} FROM facility_costs")
def _(ctx):
    return gold.quoted_facilities(ctx.economics_inputs).select(
        "facility_id",
        E.cut("tenor_months", *explore.TENOR_CUT).alias("tenor_bucket"),
        E.cut("margin_above_floor_bps", *explore.MARGIN_CUT).alias("margin_bucket"),
    )


@check("f42_label", "deal_id won_flag:f", "SELECT deal_id, CASE deal_outcome WHEN 'won' THEN 1 WHEN 'lost' THEN 0 END AS won_flag FROM silver_deals")
def _(ctx):
    return ctx.deals.select("deal_id", E.win_label("deal_outcome").alias("won_flag"))


@check("f43_rate_spread", "offer_no:i offer_ref:i spread:f", "SELECT offer_no, offer_ref, rate - reference_rate AS spread FROM loan_offers")
def _(ctx):
    return ctx.offers.select("offer_no", "offer_ref", explore.spread("rate", "reference_rate").alias("spread"))


@check("p1_final_quotes", "facility_id quote_id", "SELECT facility_id, quote_id FROM silver_pricing_cases WHERE is_final_quote")
def _(ctx):
    return ctx.pricing.where("is_final_quote")


@check("p2_eligible_quotes", "quote_id", "SELECT quote_id FROM bronze_pricing_quotes WHERE lower(quote_status_raw) IN ('approved', 'submitted')")
def _(ctx):
    return ctx["bronze_pricing_quotes"].where(S.final_quote_eligible(F.lower("quote_status_raw")))


@check("p3_training_filter", "deal_id deal_outcome", "SELECT deal_id, deal_outcome FROM gold_deal_training_dataset")
def _(ctx):
    return ctx.gold["gold_deal_training_dataset"]


@check("p4_active_filter", "deal_id current_stage", "SELECT deal_id, current_stage FROM silver_deals WHERE deal_status = 'active'")
def _(ctx):
    return ctx.deals.where("deal_status = 'active'")


@check("p5_tier_filter", "offer_no:i offer_ref:i rate:f", "SELECT offer_no, offer_ref, rate FROM loan_offers WHERE tier = 2")
def _(ctx):
    return explore.tier_filter(ctx.offers, 2)


@check("p6_quantile_trim", "scope offer_no:i offer_ref:i amount:f",
       """SELECT 'all' AS scope, offer_no, offer_ref, amount FROM loan_offers, (SELECT quantile_cont(amount, 0.025) AS a, quantile_cont(amount, 0.975) AS b FROM loan_offers) q WHERE amount > a AND amount < b
       UNION ALL SELECT 'tier', offer_no, offer_ref, amount FROM loan_offers o JOIN (SELECT tier, quantile_cont(amount, 0.025) AS a, quantile_cont(amount, 0.975) AS b FROM loan_offers GROUP BY tier) q ON o.tier = q.tier WHERE amount > a AND amount < b""")
def _(ctx):
    whole = explore.quantile_trim(ctx.offers, "amount").withColumn("scope", F.lit("all"))
    return whole.unionByName(explore.quantile_trim(ctx.offers, "amount", by="tier").withColumn("scope", F.lit("tier")))


@check("p7_drop_missing_label", "deal_id deal_outcome", "SELECT deal_id, deal_outcome FROM silver_deals WHERE deal_outcome IS NOT NULL")
def _(ctx):
    return ctx.deals.dropna(subset=["deal_outcome"])


@check("p9_projection_rename", "deal_id pricing_zone total_expected_profit_annual:f4",
       "SELECT deal_id, pricing_zone, total_expected_profit_annual FROM gold_active_deal_scoring_dataset")
def _(ctx):
    return ctx.gold["gold_active_deal_scoring_dataset"]
