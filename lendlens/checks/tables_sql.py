"""SQL definitions of the extracts, the Silver and the Gold tables, written independently of the
Spark plans. The extracts share their text with the Spark side (they are the input)."""

from __future__ import annotations

import re

from lendlens.checks.star import EXTRACTS, extract_sql

TABLES: dict[str, str] = {name: extract_sql(name) for name in EXTRACTS}


def sid(x: str, prefix: str, width: int) -> str:
    digits = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    return f"CASE WHEN {digits} = '' THEN '{prefix}-' || {x} ELSE '{prefix}' || printf('%0{width}d', CAST({digits} AS BIGINT)) END"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def norm(x: str) -> str:
    return f"lower({strip(x)})"


def title(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all(lower({x}), '[\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}]+|[^\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}]+'), lambda w: upper(w[1:1]) || w[2:]), '')"


def segment(x: str) -> str:
    return f"""CASE WHEN {norm(x)} IN ('large corp', 'large corporate', 'lc') THEN 'Large Corporate'
      WHEN {norm(x)} IN ('mid market', 'mm') THEN 'Mid Market' WHEN {norm(x)} LIKE '%sponsor%' THEN 'Financial Sponsor'
      ELSE {title(strip(x))} END"""


def currency(x: str) -> str:
    return f"CASE WHEN upper({strip(x)}) IN ('€', 'EUR') THEN 'EUR' ELSE upper({strip(x)}) END"


def status(x: str) -> str:
    return f"CASE {norm(x)} WHEN 'closed won' THEN 'closed_won' WHEN 'closed lost' THEN 'closed_lost' WHEN 'withdrawn' THEN 'withdrawn' ELSE 'active' END"


def outcome(x: str) -> str:
    return f"CASE {norm(x)} WHEN 'closed won' THEN 'won' WHEN 'closed lost' THEN 'lost' END"


def lost_reason(x: str) -> str:
    n = norm(x)
    return f"""CASE WHEN {n} LIKE '%price%' OR {n} LIKE '%expensive%' THEN 'price' WHEN {n} LIKE '%alternative%' THEN 'alternative_funding'
      WHEN {n} LIKE '%cancel%' THEN 'project_cancelled' WHEN {n} LIKE '%credit%' THEN 'credit_declined'
      WHEN {n} LIKE '%structure%' THEN 'structure' WHEN {n} LIKE '%no longer%' THEN 'no_longer_needed' ELSE replace({n}, ' ', '_') END"""


def relevance(reason: str, result: str, state: str) -> str:
    return f"""CASE WHEN {state} = 'active' OR {result} = 'won' THEN true
      WHEN {reason} IN ('credit_declined', 'project_cancelled', 'no_longer_needed') THEN false ELSE true END"""


def product(x: str) -> str:
    n = norm(x)
    return f"""CASE WHEN {n} LIKE '%term%' THEN 'Term Loan' WHEN {n} LIKE '%guarant%' THEN 'Guarantee' WHEN {n} LIKE '%trade%' THEN 'Trade Finance'
      WHEN {n} LIKE '%overdraft%' THEN 'Overdraft' WHEN {n} LIKE '%rcf%' OR {n} LIKE '%revolving%' THEN 'RCF' ELSE {strip(x)} END"""


def number(x: str) -> str:
    n = norm(x)
    return f"CASE WHEN {n} LIKE '%\\%' ESCAPE '\\' THEN TRY_CAST(rtrim({n}, '%') AS DOUBLE) / 100 ELSE TRY_CAST({n} AS DOUBLE) END"


def utilisation(x: str, p: str) -> str:
    return f"""coalesce(CASE WHEN {number(x)} < 0 THEN 0.0 WHEN {number(x)} > 1 THEN 1.0 ELSE {number(x)} END,
      CASE {p} WHEN 'RCF' THEN 0.45 WHEN 'Term Loan' THEN 1.0 WHEN 'Guarantee' THEN 0.20 WHEN 'Trade Finance' THEN 0.25 WHEN 'Overdraft' THEN 0.35 ELSE 0.50 END)"""


def rating(x: str) -> str:
    return f"""CASE WHEN {norm(x)} IN ('a', 'a2') THEN 'A' WHEN {norm(x)} IN ('bbb', 'baa2') THEN 'BBB' WHEN {norm(x)} IN ('bb', 'ba2') THEN 'BB'
      WHEN {norm(x)} IN ('b', 'b2') THEN 'B' ELSE upper({strip(x)}) END"""


def pct_rank(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0) / count({x}) OVER () END"


def clip(x: str) -> str:
    return f"CASE WHEN {x} < 0 THEN 0.0 WHEN {x} > 1 THEN 1.0 ELSE {x} END"


def latest(table: str, keys: str, ts: str, tie: str = "") -> str:
    order = ", ".join(f"{c} DESC NULLS FIRST" for c in ts.split(", "))
    rest = "".join(f", {c} DESC NULLS LAST" for c in tie.split(", ") if c)
    return f"SELECT * FROM {table} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {order}{rest}) = 1"


FACILITY_TIE = (
    "application_id, facility_sequence_no, product_type_raw, commitment_amount, drawn_amount_initial, "
    "expected_utilisation_raw, currency, tenor_months, maturity_date, repayment_type_raw, interest_type_raw, "
    "collateral_type_raw, covenant_package_raw"
)

TABLES["latest_accounts"] = latest("bronze_crm_accounts", "crm_account_id", "source_extract_ts", "region_raw")
TABLES["latest_applications"] = latest("bronze_los_applications", "application_id", "source_extract_ts", "opportunity_id")
TABLES["latest_facilities"] = latest("bronze_los_facilities", "facility_source_id", "source_extract_ts", FACILITY_TIE)

TABLES["silver_customers"] = f"""
  SELECT {sid('crm_account_id', 'CUST', 6)} AS customer_id, crm_account_id, {segment('customer_segment_raw')} AS customer_segment,
    industry_raw AS industry, CASE region_raw WHEN 'West Europe' THEN 'Western Europe' ELSE region_raw END AS region,
    upper(country_raw) AS country, group_ref AS group_id, rm_owner_code AS rm_id, onboarding_date,
    lower(relationship_status_raw) AS relationship_status, annual_revenue_bucket_raw AS annual_revenue_bucket,
    employee_count_bucket_raw AS employee_count_bucket, coalesce(lower(relationship_status_raw) = 'active', false) AS is_active_customer
  FROM latest_accounts"""

TABLES["silver_deals"] = f"""
  SELECT *, {relevance('lost_reason', 'deal_outcome', 'deal_status')} AS commercial_relevance_flag FROM (
    SELECT {sid('o.opportunity_id', 'DEAL', 7)} AS deal_id, o.opportunity_id, a.application_id,
      {sid('o.crm_account_id', 'CUST', 6)} AS customer_id, opportunity_type_raw AS deal_type, financing_purpose_raw AS financing_purpose,
      {status('stage_raw')} AS deal_status, coalesce(submission_date, created_date) AS offer_date, expected_close_date,
      actual_close_date AS decision_date, {outcome('stage_raw')} AS deal_outcome, {lost_reason('lost_reason_raw')} AS lost_reason,
      owner_rm_code AS rm_id, stage_raw AS current_stage
    FROM bronze_crm_opportunities o LEFT JOIN latest_applications a ON o.opportunity_id = a.opportunity_id) s"""

TABLES["silver_facilities"] = f"""
  SELECT *, commitment_amount * expected_utilization AS expected_utilized_volume FROM (
    SELECT *, {utilisation('expected_utilisation_raw', 'product_type')} AS expected_utilization FROM (
      SELECT {sid('facility_source_id', 'FAC', 8)} AS facility_id, facility_source_id, d.deal_id, f.application_id,
        {product('product_type_raw')} AS product_type, commitment_amount, drawn_amount_initial, expected_utilisation_raw,
        {currency('currency')} AS currency, tenor_months, maturity_date, {title('repayment_type_raw')} AS repayment_type,
        CASE interest_type_raw WHEN 'floater' THEN 'Floating' ELSE interest_type_raw END AS interest_type,
        collateral_type_raw AS collateral_type, covenant_package_raw AS covenant_package
      FROM latest_facilities f JOIN silver_deals d ON f.application_id = d.application_id) a) b"""

TABLES["silver_pricing_cases"] = """
  SELECT 'PC-' || quote_id AS pricing_case_id, *, offered_margin_bps - floor_margin_bps AS margin_above_floor_bps,
    is_final_quote AND coalesce(quote_status, '') NOT IN ('approved', 'submitted') AS final_quote_warning
  FROM (
    SELECT f.deal_id, f.facility_id, quote_id, quote_version, lower(quote_status_raw) AS quote_status, quote_created_at, offered_margin_bps,
      coalesce(upfront_fee_bps, 0) AS upfront_fee_bps, coalesce(commitment_fee_bps, 0) AS commitment_fee_bps,
      coalesce(utilisation_fee_bps, 0) AS utilisation_fee_bps, coalesce(arrangement_fee_bps, 0) AS arrangement_fee_bps,
      floor_margin_bps, target_margin_bps, stretch_margin_bps, coalesce(rm_override_flag, false) AS rm_override_flag,
      override_reason_raw AS override_reason, lower(approval_status_raw) AS approval_status,
      first_value(quote_id) OVER (PARTITION BY f.facility_id
        ORDER BY CASE WHEN lower(quote_status_raw) IN ('approved', 'submitted') THEN 0 ELSE 1 END, quote_version DESC, quote_id DESC) = quote_id AS is_final_quote
    FROM bronze_pricing_quotes q JOIN silver_facilities f ON q.facility_source_id = f.facility_source_id) p"""

TABLES["silver_risk_assessments"] = f"""
  SELECT risk_assessment_id, deal_id, facility_id, {rating('rating_raw')} AS rating, {number('pd_raw')} AS pd, {number('lgd_raw')} AS lgd,
    ead_amount AS ead, rwa_amount AS rwa, expected_loss_amount AS expected_loss, risk_model_version, assessment_date,
    coalesce(watchlist_flag, false) AS watchlist_flag
  FROM (SELECT r.*, f.facility_id, f.deal_id FROM bronze_risk_assessments r JOIN silver_facilities f ON r.facility_source_id = f.facility_source_id
    QUALIFY row_number() OVER (PARTITION BY f.facility_id ORDER BY assessment_date DESC, source_extract_ts DESC, risk_assessment_id DESC) = 1) x"""

TABLES["silver_relationship_snapshots"] = f"""
  SELECT {sid('crm_account_id', 'CUST', 6)} AS customer_id, *, {clip('raw_strength')} AS relationship_strength_score FROM (
    SELECT *, 0.40 * ({pct_rank('relationship_revenue_ltm')}) + 0.35 * ({pct_rank('existing_product_count')})
      + 0.25 * (1 - ({pct_rank('days_since_last_contact')})) AS raw_strength
    FROM bronze_core_relationship_snapshot) s"""

TABLES["silver_ftp_rates"] = f"""
  SELECT ftp_curve_date, {currency('currency')} AS currency, product_group_raw AS product_group, tenor_bucket_months, ftp_bps, liquidity_cost_bps
  FROM bronze_treasury_ftp_rates"""

TABLES["latest_ftp"] = "SELECT * FROM silver_ftp_rates QUALIFY row_number() OVER (PARTITION BY currency, product_group, tenor_bucket_months ORDER BY ftp_curve_date DESC) = 1"

TENOR_BUCKET = """CASE WHEN tenor_months IS NULL THEN 36 ELSE
  (SELECT arg_min(b, abs(b - tenor_months) * 1000 + b) FROM (VALUES (12), (24), (36), (60), (84)) t(b)) END"""

TABLES["facility_costs"] = f"""
  SELECT f.*, p.offered_margin_bps, p.upfront_fee_bps, p.commitment_fee_bps, p.utilisation_fee_bps, p.arrangement_fee_bps,
    p.floor_margin_bps, p.target_margin_bps, p.stretch_margin_bps, p.margin_above_floor_bps, r.expected_loss, r.rwa, r.ead,
    coalesce(c.ftp_bps, 110) AS ftp_bps, coalesce(c.liquidity_cost_bps, 20) AS liquidity_cost_bps
  FROM (SELECT *, tenor_months / 12.0 AS tenor_years, {TENOR_BUCKET} AS tenor_bucket_months,
      CASE WHEN product_type IN ('RCF', 'Overdraft') THEN 'Committed Lines' WHEN product_type = 'Term Loan' THEN 'Term Lending'
           WHEN product_type = 'Guarantee' THEN 'Guarantee' ELSE 'Trade' END AS product_group FROM silver_facilities) f
  JOIN silver_pricing_cases p ON f.deal_id = p.deal_id AND f.facility_id = p.facility_id AND p.is_final_quote
  LEFT JOIN silver_risk_assessments r ON f.deal_id = r.deal_id AND f.facility_id = r.facility_id
  LEFT JOIN latest_ftp c ON f.currency = c.currency AND f.product_group = c.product_group AND f.tenor_bucket_months = c.tenor_bucket_months"""

TABLES["facility_margins"] = """
  SELECT *, offered_margin_bps + annualized_fee_bps - ftp_bps - liquidity_cost_bps - risk_cost_bps - admin_cost_bps - capital_cost_bps AS risk_adjusted_margin_bps
  FROM (SELECT *,
      CASE WHEN tenor_years IS NULL THEN NULL ELSE
        (upfront_fee_bps + arrangement_fee_bps) / CASE WHEN tenor_years = 0 THEN 1 WHEN tenor_years < 0.25 THEN 0.25 ELSE tenor_years END
        + CASE WHEN product_type IN ('RCF', 'Overdraft') THEN commitment_fee_bps * (1 - expected_utilization) + utilisation_fee_bps * expected_utilization
               WHEN product_type IN ('Guarantee', 'Trade Finance') THEN utilisation_fee_bps ELSE 0 END END AS annualized_fee_bps,
      10000 * coalesce(expected_loss, 0) / greatest(coalesce(expected_utilized_volume, 0) * greatest(coalesce(tenor_years, 1), 0.25), 1) AS risk_cost_bps,
      CASE WHEN product_type IN ('Guarantee', 'Trade Finance') THEN 12.0 ELSE 8.0 END AS admin_cost_bps,
      least(greatest(18 * coalesce(coalesce(rwa, 0) / nullif(coalesce(nullif(ead, 0), expected_utilized_volume), 0), 0.75), 8), 35) AS capital_cost_bps
    FROM facility_costs) c"""

TABLES["gold_facility_economics"] = """
  SELECT *, risk_adjusted_margin_bps * expected_utilized_volume / 10000 AS expected_facility_profit_annual,
    risk_adjusted_margin_bps * expected_utilized_volume * tenor_years / 10000 AS expected_facility_profit_lifetime,
    CASE WHEN offered_margin_bps < floor_margin_bps OR risk_adjusted_margin_bps < 0 THEN 'Red'
         WHEN offered_margin_bps <= floor_margin_bps + 10 THEN 'Guardrail' WHEN offered_margin_bps >= stretch_margin_bps THEN 'Stretch'
         WHEN offered_margin_bps >= target_margin_bps THEN 'Recommended' ELSE 'Guardrail' END AS pricing_zone
  FROM facility_margins"""

TABLES["deal_anchor"] = """
  SELECT deal_id, product_type AS anchor_product FROM (SELECT deal_id, product_type, count(*) AS n FROM gold_facility_economics WHERE product_type IS NOT NULL GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY deal_id ORDER BY n DESC, product_type) = 1"""

TABLES["deal_sums"] = """
  SELECT deal_id, count(DISTINCT facility_id) AS number_of_facilities, sum(commitment_amount) AS total_commitment,
    sum(expected_utilized_volume) AS total_expected_utilized_volume,
    coalesce(sum(expected_facility_profit_annual), 0) AS total_expected_profit_annual,
    coalesce(sum(expected_facility_profit_lifetime), 0) AS total_expected_profit_lifetime,
    avg(margin_above_floor_bps) AS weighted_avg_margin_above_floor_bps, min(margin_above_floor_bps) AS min_margin_above_floor_bps,
    min(CASE pricing_zone WHEN 'Red' THEN 0 WHEN 'Guardrail' THEN 1 WHEN 'Recommended' THEN 2 ELSE 3 END) AS severity,
    CASE WHEN coalesce(sum(annualized_fee_bps), 0) + coalesce(sum(offered_margin_bps), 0) = 0 THEN 0
         ELSE coalesce(sum(annualized_fee_bps), 0) / (coalesce(sum(annualized_fee_bps), 0) + coalesce(sum(offered_margin_bps), 0)) END AS fee_income_share,
    count(*) FILTER (product_type = 'RCF') > 0 AS has_rcf, count(*) FILTER (product_type = 'Term Loan') > 0 AS has_term_loan,
    count(*) FILTER (product_type = 'Guarantee') > 0 AS has_guarantee, count(*) FILTER (product_type = 'Trade Finance') > 0 AS has_trade_finance
  FROM gold_facility_economics GROUP BY deal_id"""

TABLES["deal_owner"] = "SELECT deal_id, customer_id, rm_id FROM silver_deals QUALIFY row_number() OVER (PARTITION BY deal_id ORDER BY customer_id, rm_id) = 1"

TABLES["gold_deal_economics"] = f"""
  SELECT *, {clip('raw_complexity')} AS deal_complexity_score,
    CASE WHEN total_expected_profit_lifetime < 0 THEN 'Red' ELSE worst_facility_pricing_zone END AS deal_pricing_zone
  FROM (SELECT o.customer_id, o.rm_id, a.anchor_product, s.*,
      CASE severity WHEN 0 THEN 'Red' WHEN 1 THEN 'Guardrail' WHEN 2 THEN 'Recommended' ELSE 'Stretch' END AS worst_facility_pricing_zone,
      0.65 * ({pct_rank('number_of_facilities')}) + 0.35 * ({pct_rank('ranked_commitment')}) AS raw_complexity
    FROM (SELECT *, round(total_commitment, 4) AS ranked_commitment FROM deal_sums) s JOIN deal_owner o ON s.deal_id = o.deal_id LEFT JOIN deal_anchor a ON s.deal_id = a.deal_id) d"""

TABLES["risk_weighted"] = """
  SELECT r.deal_id, r.facility_id, r.rating, r.pd, r.lgd, coalesce(e.expected_utilized_volume, 0) AS w,
    avg(r.pd) OVER (PARTITION BY r.deal_id) AS pd_mean, avg(r.lgd) OVER (PARTITION BY r.deal_id) AS lgd_mean
  FROM silver_risk_assessments r LEFT JOIN gold_facility_economics e ON r.deal_id = e.deal_id AND r.facility_id = e.facility_id"""

TABLES["deal_rating"] = """
  SELECT deal_id, rating AS rating_at_offer FROM (SELECT deal_id, rating, count(*) AS n FROM risk_weighted WHERE rating IS NOT NULL GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY deal_id ORDER BY n DESC, rating) = 1"""

TABLES["deal_risk"] = """
  SELECT s.deal_id, d.rating_at_offer, s.pd_at_offer, s.lgd_weighted FROM (
    SELECT deal_id,
      CASE WHEN sum(w) = 0 THEN avg(pd) ELSE sum(w * coalesce(pd, pd_mean)) / sum(w) END AS pd_at_offer,
      CASE WHEN sum(w) = 0 THEN avg(lgd) ELSE sum(w * coalesce(lgd, lgd_mean)) / sum(w) END AS lgd_weighted
    FROM risk_weighted GROUP BY deal_id) s LEFT JOIN deal_rating d ON s.deal_id = d.deal_id"""

TABLES["latest_relationship"] = "SELECT * FROM silver_relationship_snapshots QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY snapshot_month DESC) = 1"

TABLES["deal_feature_rows"] = """
  SELECT d.deal_status, d.deal_outcome, d.commercial_relevance_flag, d.expected_close_date, d.current_stage, e.*,
    c.customer_segment, c.industry, c.region, l.relationship_strength_score, l.existing_product_count, l.days_since_last_contact,
    r.rating_at_offer, r.pd_at_offer, r.lgd_weighted
  FROM silver_deals d
  JOIN gold_deal_economics e ON d.deal_id = e.deal_id AND d.customer_id = e.customer_id AND d.rm_id IS NOT DISTINCT FROM e.rm_id
  LEFT JOIN silver_customers c ON d.customer_id = c.customer_id
  LEFT JOIN latest_relationship l ON d.customer_id = l.customer_id
  LEFT JOIN deal_risk r ON d.deal_id = r.deal_id"""

TABLES["gold_deal_training_dataset"] = """
  SELECT * FROM deal_feature_rows WHERE deal_status IN ('closed_won', 'closed_lost') AND commercial_relevance_flag AND deal_outcome IN ('won', 'lost')"""

TABLES["gold_active_deal_scoring_dataset"] = "SELECT *, deal_pricing_zone AS pricing_zone FROM deal_feature_rows WHERE deal_status = 'active'"

TABLES["gold_rm_deal_dashboard"] = """
  SELECT *, CASE WHEN pricing_zone = 'Red' THEN 'Review economics and guardrail exception' WHEN pricing_zone = 'Guardrail' THEN 'Prepare pricing justification'
      WHEN relationship_strength_score > 0.7 THEN 'Prioritize RM follow-up' ELSE 'Monitor pipeline' END AS recommended_action_placeholder,
    relationship_strength_score IS NULL OR min_margin_above_floor_bps IS NULL AS data_quality_warning_flag
  FROM gold_active_deal_scoring_dataset"""

TABLES["scored_deals"] = """
  SELECT deal_no, CASE WHEN stage_raw = 'Closed Won' THEN 1 ELSE 0 END AS y, (deal_no * 7919 % 99991) / 99991e0 AS p
  FROM (SELECT CAST(substring(opportunity_id, 4) AS BIGINT) AS deal_no, stage_raw FROM bronze_crm_opportunities) o
  WHERE lower(stage_raw) LIKE '%closed%'"""

# What was known at a deal's decision: the same tables on the curve and the snapshot of that time.
TABLES["known_deals"] = "SELECT deal_id, coalesce(max(decision_date), TIMESTAMP '9999-12-31') AS known_until FROM silver_deals GROUP BY deal_id"

TABLES["silver_relationship_history"] = TABLES["silver_relationship_snapshots"].replace("bronze_core_relationship_snapshot", "relationship_history")

TABLES["facility_costs_as_of"] = TABLES["facility_costs"].replace("SELECT f.*, p.", "SELECT f.* EXCLUDE (known_until), p.").replace(
    "THEN 'Guarantee' ELSE 'Trade' END AS product_group FROM silver_facilities)",
    "THEN 'Guarantee' ELSE 'Trade' END AS product_group FROM silver_facilities JOIN known_deals USING (deal_id))",
).replace(
    "LEFT JOIN latest_ftp c ON", "ASOF LEFT JOIN silver_ftp_rates c ON"
) + " AND f.known_until >= c.ftp_curve_date"

_CHAIN = [
    "facility_costs", "facility_margins", "gold_facility_economics", "deal_anchor", "deal_sums", "gold_deal_economics", "risk_weighted",
    "deal_rating", "deal_risk",
]


def _as_of(sql: str) -> str:
    return re.sub(r"\b(" + "|".join(_CHAIN) + r")\b", r"\1_as_of", sql)


for _name in _CHAIN[1:]:
    TABLES[f"{_name}_as_of"] = _as_of(TABLES[_name])

TABLES["deal_feature_rows_as_of"] = _as_of(TABLES["deal_feature_rows"]).replace("FROM silver_deals d", "FROM silver_deals d JOIN known_deals k ON d.deal_id = k.deal_id").replace(
    "LEFT JOIN latest_relationship l ON d.customer_id = l.customer_id", "ASOF LEFT JOIN silver_relationship_history l ON d.customer_id = l.customer_id AND k.known_until >= l.snapshot_month"
)
