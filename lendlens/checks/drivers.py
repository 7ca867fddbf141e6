"""Opportunity drivers G1–G9 and the joins and aggregates they consist of (J17, J18, A21, A22)."""

from pyspark.sql import functions as F

from lendlens.functions import standardize as S
from lendlens.functions.economics import tenor_bucket  # noqa: F401
from lendlens.operators import drivers
from lendlens.plans import gold

from .layers import _RATING_SQL, _STRENGTH_SQL
from .registry import check
from .tables_sql import FACILITY_TIE, TABLES, rating

TABLES["first_facilities"] = f"""SELECT * FROM bronze_los_facilities QUALIFY row_number() OVER (PARTITION BY facility_source_id
  ORDER BY source_extract_ts NULLS LAST, {', '.join(c + ' NULLS LAST' for c in FACILITY_TIE.split(', '))}) = 1"""
TABLES["last_quotes"] = "SELECT *, offered_margin_bps - floor_margin_bps AS margin FROM bronze_pricing_quotes QUALIFY row_number() OVER (PARTITION BY facility_source_id ORDER BY quote_version DESC, quote_id DESC) = 1"
TABLES["facility_driver_rows"] = """SELECT a.opportunity_id, f.facility_source_id, f.product_type_raw, q.margin FROM first_facilities f
  LEFT JOIN last_quotes q ON f.facility_source_id = q.facility_source_id JOIN latest_applications a ON f.application_id = a.application_id"""
TABLES["facility_drivers"] = """SELECT g.opportunity_id, g.number_of_facilities, g.weighted_avg_margin_above_floor_bps, m.product_type_raw AS anchor_product
  FROM (SELECT opportunity_id, count(DISTINCT facility_source_id) AS number_of_facilities, avg(margin) AS weighted_avg_margin_above_floor_bps FROM facility_driver_rows GROUP BY 1) g
  JOIN (SELECT opportunity_id, product_type_raw FROM facility_driver_rows GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY opportunity_id ORDER BY count(*) DESC, product_type_raw) = 1) m ON g.opportunity_id = m.opportunity_id"""
TABLES["driver_rows"] = f"""SELECT o.opportunity_id, o.crm_account_id, o.stage_raw, coalesce(s.relationship_strength_score, 0.45) AS relationship_strength_score,
    coalesce(a.n, 0) AS activity_count, coalesce(f.number_of_facilities, 0) AS number_of_facilities,
    coalesce(f.weighted_avg_margin_above_floor_bps, 55) AS weighted_avg_margin_above_floor_bps, coalesce(f.anchor_product, 'Term Loan') AS anchor_product,
    nullif(r.rating_or_gap, '?') AS rating_raw
  FROM bronze_crm_opportunities o
  LEFT JOIN (SELECT opportunity_id, count(*) AS n FROM bronze_rm_activities GROUP BY 1) a ON o.opportunity_id = a.opportunity_id
  LEFT JOIN facility_drivers f ON o.opportunity_id = f.opportunity_id
  LEFT JOIN ({_RATING_SQL}) r ON o.opportunity_id = r.opportunity_id
  LEFT JOIN ({_STRENGTH_SQL}) s ON o.crm_account_id = s.crm_account_id"""
TABLES["win_scores"] = """SELECT *, 1 / (1 + exp(-(0.25 - 0.014 * weighted_avg_margin_above_floor_bps + 1.15 * relationship_strength_score
    + CASE lower(rating_raw) WHEN 'a' THEN 0.15 WHEN 'a2' THEN 0.12 WHEN 'bb' THEN -0.22 WHEN 'ba2' THEN -0.22 WHEN 'b' THEN -0.45 WHEN 'b2' THEN -0.45 ELSE 0 END
    + 0.055 * ln(1 + activity_count) - 0.12 * number_of_facilities
    + CASE anchor_product WHEN 'RCF' THEN 0.10 WHEN 'Term Loan' THEN 0.03 WHEN 'Guarantee' THEN -0.02 WHEN 'Trade Finance' THEN 0.05 WHEN 'Overdraft' THEN -0.06 ELSE 0 END))) AS win_score
  FROM driver_rows"""
TABLES["lost_driver_rows"] = """SELECT *, weighted_avg_margin_above_floor_bps > lim AS high_margin, number_of_facilities >= 3 AS high_complexity,
    relationship_strength_score < 0.35 AS weak_relationship, coalesce(lower(rating_raw) IN ('bb', 'ba2', 'b', 'b2'), false) AS weak_rating
  FROM driver_rows, (SELECT quantile_cont(weighted_avg_margin_above_floor_bps, 0.70) AS lim FROM driver_rows) q"""

_G1 = "opportunity_id relationship_strength_score:f activity_count:i number_of_facilities:i weighted_avg_margin_above_floor_bps:f anchor_product rating_raw"


@check("g1_driver_table", _G1, "SELECT * FROM driver_rows")
def _(ctx):
    return drivers.driver_table(ctx.bronze)


@check("g2_win_score", "opportunity_id win_score:f", "SELECT opportunity_id, win_score FROM win_scores")
def _(ctx):
    return drivers.win_score(drivers.driver_table(ctx.bronze))


@check("g3_lost_drivers", "opportunity_id high_margin high_complexity weak_relationship weak_rating", "SELECT * FROM lost_driver_rows")
def _(ctx):
    return drivers.lost_drivers(drivers.driver_table(ctx.bronze))


@check("g4_likely_lost_reason", "opportunity_id likely_lost_reason",
       """SELECT opportunity_id, CASE WHEN lower(trim(stage_raw)) <> 'closed lost' THEN NULL WHEN high_margin THEN 'price' WHEN high_complexity THEN 'structure'
       WHEN weak_relationship THEN 'relationship' WHEN weak_rating THEN 'credit' ELSE 'other' END AS likely_lost_reason FROM lost_driver_rows""")
def _(ctx):
    return drivers.likely_lost_reason(drivers.lost_drivers(drivers.driver_table(ctx.bronze)))


_STATUS_SQL = """SELECT a.application_id, a.financing_purpose_raw, s.application_status_raw,
    CASE WHEN s.application_status_raw = 'Approved' THEN o.actual_close_date ELSE a.approval_date END AS approval_date,
    CASE WHEN s.application_status_raw = 'Declined' THEN o.actual_close_date ELSE a.decline_date END AS decline_date
  FROM bronze_los_applications a LEFT JOIN bronze_crm_opportunities o ON a.opportunity_id = o.opportunity_id
  CROSS JOIN LATERAL (SELECT CASE o.stage_raw WHEN 'Closed Won' THEN 'Approved' WHEN 'Closed Lost' THEN 'Declined' WHEN 'Withdrawn' THEN 'Withdrawn'
    WHEN 'Credit Review' THEN 'In Review' WHEN 'Negotiation' THEN 'In Review' ELSE 'Submitted' END AS application_status_raw) s"""
_STATUS = "application_id financing_purpose_raw application_status_raw approval_date:t decline_date:t"


@check("g5_application_status", _STATUS, _STATUS_SQL)
def _(ctx):
    return drivers.application_status(ctx["bronze_los_applications"], ctx["bronze_crm_opportunities"])


@check("j18_status_back_propagation", "application_id application_status_raw", _STATUS_SQL)
def _(ctx):
    return drivers.application_status(ctx["bronze_los_applications"], ctx["bronze_crm_opportunities"])


@check("j17_driver_joins", _G1, "SELECT * FROM driver_rows")
def _(ctx):
    return drivers.driver_table(ctx.bronze)


@check("a21_activity_counts", "opportunity_id activity_count:i",
       "SELECT o.opportunity_id, count(a.activity_id) AS activity_count FROM bronze_crm_opportunities o LEFT JOIN bronze_rm_activities a ON o.opportunity_id = a.opportunity_id GROUP BY 1")
def _(ctx):
    return drivers.activity_counts(ctx["bronze_crm_opportunities"], ctx["bronze_rm_activities"])


@check("a22_facility_drivers", "opportunity_id number_of_facilities:i weighted_avg_margin_above_floor_bps:f anchor_product", "SELECT * FROM facility_drivers")
def _(ctx):
    return drivers.facility_drivers(ctx["bronze_los_facilities"], ctx["bronze_pricing_quotes"], ctx["bronze_los_applications"])


@check("g6_rate_card", "facility_source_id floor_margin_bps:f",
       "SELECT facility_source_id, CASE product_type_raw WHEN 'RCF' THEN 115 WHEN 'Term Loan' THEN 130 WHEN 'Guarantee' THEN 80 WHEN 'Trade Finance' THEN 70 WHEN 'Overdraft' THEN 150 ELSE 120 END AS floor_margin_bps FROM latest_facilities")
def _(ctx):
    from lendlens.operators.dedupe import latest_by

    latest = latest_by(ctx["bronze_los_facilities"], "facility_source_id")
    return latest.select("facility_source_id", drivers.rate_card_floor("product_type_raw").alias("floor_margin_bps"))


@check("g7_modelled_ftp", "deal_id facility_id modelled_ftp_bps:f modelled_liquidity_bps:f",
       """SELECT deal_id, facility_id, 60 + 0.8 * tenor_bucket_months + c.a + g.a AS modelled_ftp_bps,
         8 + 0.25 * tenor_bucket_months + CASE f.product_group WHEN 'Committed Lines' THEN 10 ELSE 0 END AS modelled_liquidity_bps
       FROM facility_costs f LEFT JOIN (VALUES ('EUR', 0), ('USD', 25), ('GBP', 18)) c(c, a) ON f.currency = c.c
         LEFT JOIN (VALUES ('Committed Lines', 20), ('Term Lending', 8), ('Trade', 5), ('Guarantee', 3)) g(g, a) ON f.product_group = g.g""")
def _(ctx):
    """The funding cost formula for every facility with a final quote."""
    facilities = gold.quoted_facilities(ctx.economics_inputs)
    ftp, liquidity = drivers.modelled_ftp("currency", "product_group", "tenor_bucket_months")
    return facilities.select("deal_id", "facility_id", ftp.alias("modelled_ftp_bps"), liquidity.alias("modelled_liquidity_bps"))


@check("g8_expected_loss", "risk_assessment_id pd:f8 lgd:f8 expected_loss:f4",
       f"""SELECT risk_assessment_id, pd, lgd, ead_amount * pd * lgd AS expected_loss FROM (
         SELECT risk_assessment_id, ead_amount, CASE {rating('rating_raw')} WHEN 'A' THEN 0.003 WHEN 'BBB' THEN 0.008 WHEN 'BB' THEN 0.025 WHEN 'B' THEN 0.055 END AS pd,
           CASE collateral_type_raw WHEN 'Cash' THEN 0.18 WHEN 'Real Estate' THEN 0.28 WHEN 'Receivables' THEN 0.38 WHEN 'Inventory' THEN 0.45 WHEN 'Unsecured' THEN 0.55 ELSE 0.50 END AS lgd
         FROM bronze_risk_assessments r LEFT JOIN latest_facilities f ON r.facility_source_id = f.facility_source_id) x""")
def _(ctx):
    from lendlens.operators.dedupe import latest_by

    collateral = latest_by(ctx["bronze_los_facilities"], "facility_source_id").select("facility_source_id", "collateral_type_raw")
    rows = ctx["bronze_risk_assessments"].select("risk_assessment_id", "facility_source_id", "ead_amount", S.rating("rating_raw").alias("rating"))
    pd_, lgd, loss = drivers.modelled_expected_loss("ead_amount", "rating", "collateral_type_raw")
    return rows.join(collateral, "facility_source_id", "left").select("risk_assessment_id", pd_.alias("pd"), lgd.alias("lgd"), loss.alias("expected_loss"))


@check("g9_maturity_date", "application_id maturity:t",
       "SELECT application_id, submission_date + requested_tenor_months * INTERVAL 1 MONTH AS maturity FROM bronze_los_applications")
def _(ctx):
    return ctx["bronze_los_applications"].select("application_id", drivers.maturity_date("submission_date", "requested_tenor_months").alias("maturity"))
