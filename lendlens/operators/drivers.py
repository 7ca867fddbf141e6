"""Outcome drivers per opportunity and the deterministic rules around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendlens.functions.economics import sigmoid
from lendlens.functions.text import clamp01
from lendlens.operators.dedupe import first_by, latest_by, latest_quotes, top_row
from lendlens.operators.ordered import percent_rank_columns, quantiles

# Defaults of a missing driver.
DEFAULTS = {
    "relationship_strength_score": 0.45,
    "activity_count": 0,
    "number_of_facilities": 0,
    "weighted_avg_margin_above_floor_bps": 55.0,
    "anchor_product": "Term Loan",
}
# Score terms.
RATING_EFFECT = {"a": 0.15, "a2": 0.12, "bbb": 0.0, "baa2": 0.0, "bb": -0.22, "ba2": -0.22, "b": -0.45, "b2": -0.45}
PRODUCT_EFFECT = {"RCF": 0.10, "Term Loan": 0.03, "Guarantee": -0.02, "Trade Finance": 0.05, "Overdraft": -0.06}
WEAK_RATINGS = ["bb", "ba2", "b", "b2"]
# Floor margin by product in bps, 120 otherwise.
RATE_CARD = {"RCF": 115.0, "Term Loan": 130.0, "Guarantee": 80.0, "Trade Finance": 70.0, "Overdraft": 150.0}
OTHER_FLOOR = 120.0
# Funding curve add-ons in bps.
CURVE_CURRENCIES = {"EUR": 0, "USD": 25, "GBP": 18}
CURVE_GROUPS = {"Committed Lines": 20, "Term Lending": 8, "Trade": 5, "Guarantee": 3}
# Default rate by rating and loss share by collateral, with bounds.
RATING_PD = {"A": 0.003, "BBB": 0.008, "BB": 0.025, "B": 0.055}
COLLATERAL_LGD = {"Cash": 0.18, "Real Estate": 0.28, "Receivables": 0.38, "Inventory": 0.45, "Unsecured": 0.55}
OTHER_LGD, MIN_PD, MIN_LGD, MAX_LGD = 0.50, 0.0005, 0.05, 0.85


def lookup(key: Column, table: dict, otherwise) -> Column:
    chain = None
    for k, v in table.items():
        chain = F.when(key == k, F.lit(v)) if chain is None else chain.when(key == k, F.lit(v))
    return chain.otherwise(otherwise)


def latest_strength(snapshots: DataFrame) -> DataFrame:
    """(crm_account_id, relationship_strength_score) from the latest month, ranked over accounts."""
    latest = latest_by(snapshots, "crm_account_id", "snapshot_month")
    ranked = percent_rank_columns(
        latest.select("crm_account_id", "existing_product_count", "relationship_revenue_ltm", "days_since_last_contact"),
        {"_p": "existing_product_count", "_r": "relationship_revenue_ltm", "_d": "days_since_last_contact"},
    )
    score = F.col("_p") * 0.35 + F.col("_r") * 0.35 + (1 - F.col("_d")) * 0.30
    return ranked.select("crm_account_id", clamp01(score).alias("relationship_strength_score"))


def _activities(activities: DataFrame) -> DataFrame:
    return activities.groupBy("opportunity_id").agg(F.count(F.lit(1)).alias("activity_count"))


def activity_counts(opportunities: DataFrame, activities: DataFrame) -> DataFrame:
    """(opportunity_id, activity_count), opportunities without activity count 0."""
    joined = opportunities.select("opportunity_id").join(_activities(activities), "opportunity_id", "left")
    return joined.select("opportunity_id", F.coalesce("activity_count", F.lit(0)).alias("activity_count"))


def first_facilities(facilities: DataFrame) -> DataFrame:
    """Earliest extract per facility."""
    rest = [c for c in facilities.columns if c not in ("facility_source_id", "source_extract_ts")]
    order = [F.col("source_extract_ts").asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in rest]]
    return first_by(facilities, "facility_source_id", order)


def _owners(applications: DataFrame) -> DataFrame:
    return latest_by(applications, "application_id").select("application_id", "opportunity_id")


def facility_drivers(facilities: DataFrame, quotes: DataFrame, applications: DataFrame) -> DataFrame:
    """Per opportunity: number of facilities, mean margin above floor of the latest quotes, modal product."""
    margins = latest_quotes(quotes.select("facility_source_id", "quote_version", "quote_id", "offered_margin_bps", "floor_margin_bps"))
    margins = margins.select("facility_source_id", (F.col("offered_margin_bps") - F.col("floor_margin_bps")).alias("_margin"))
    rows = (
        first_facilities(facilities)
        .select("facility_source_id", "application_id", "product_type_raw")
        .join(margins, "facility_source_id", "left")
        .join(_owners(applications), "application_id")
    )
    return rows.groupBy("opportunity_id").agg(
        F.countDistinct("facility_source_id").alias("number_of_facilities"),
        F.avg("_margin").alias("weighted_avg_margin_above_floor_bps"),
        F.coalesce(F.mode("product_type_raw", True), F.lit(DEFAULTS["anchor_product"])).alias("anchor_product"),
    )


def opportunity_ratings(risk: DataFrame, applications: DataFrame) -> DataFrame:
    """(opportunity_id, rating_raw): latest assessment of the opportunity's first facility, upper case."""
    slim = risk.select("facility_source_id", "application_id", "assessment_date", "risk_assessment_id", "rating_raw")
    order = [F.col("assessment_date").desc_nulls_first(), F.col("risk_assessment_id").desc()]
    owned = top_row(slim, ["facility_source_id"], order).join(_owners(applications), "application_id")
    return owned.groupBy("opportunity_id").agg(F.min_by(F.upper("rating_raw"), "facility_source_id").alias("rating_raw"))


def driver_table(bronze: dict[str, DataFrame]) -> DataFrame:
    """One row per opportunity with all drivers; missing ones take their default."""
    opportunities = bronze["bronze_crm_opportunities"].select("opportunity_id", "crm_account_id", "stage_raw")
    applications = bronze["bronze_los_applications"]
    joined = (
        opportunities.join(_activities(bronze["bronze_rm_activities"]), "opportunity_id", "left")
        .join(facility_drivers(bronze["bronze_los_facilities"], bronze["bronze_pricing_quotes"], applications), "opportunity_id", "left")
        .join(opportunity_ratings(bronze["bronze_risk_assessments"], applications), "opportunity_id", "left")
        .join(latest_strength(bronze["bronze_core_relationship_snapshot"]), "crm_account_id", "left")
    )
    filled = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULTS.items()}
    return joined.withColumns(filled).select("opportunity_id", "crm_account_id", "stage_raw", *DEFAULTS, "rating_raw")


def win_score(drivers: DataFrame) -> DataFrame:
    """Adds the structural win score of the drivers."""
    latent = (
        F.lit(0.25)
        - 0.014 * F.col("weighted_avg_margin_above_floor_bps")
        + 1.15 * F.col("relationship_strength_score")
        + lookup(F.lower("rating_raw"), RATING_EFFECT, 0.0)
        + 0.055 * F.log1p(F.col("activity_count").cast("double"))
        - 0.12 * F.col("number_of_facilities")
        + lookup(F.col("anchor_product"), PRODUCT_EFFECT, 0.0)
    )
    return drivers.withColumn("win_score", sigmoid(latent))


def lost_drivers(drivers: DataFrame) -> DataFrame:
    """Adds the four flags that explain a loss; the margin limit is the exact 70 % quantile."""
    limit = quantiles(drivers, "weighted_avg_margin_above_floor_bps", [0.70]).first()
    high = F.col("weighted_avg_margin_above_floor_bps") > F.lit(limit["q0"] if limit else None).cast("double")
    return drivers.withColumns({
        "high_margin": F.coalesce(high, F.lit(False)),
        "high_complexity": F.col("number_of_facilities") >= 3,
        "weak_relationship": F.col("relationship_strength_score") < 0.35,
        "weak_rating": F.coalesce(F.lower("rating_raw").isin(WEAK_RATINGS), F.lit(False)),
    })


def likely_lost_reason(flagged: DataFrame) -> DataFrame:
    """Adds the first matching reason of a lost opportunity: price, structure, relationship, credit."""
    reason = (
        F.when(F.col("high_margin"), "price")
        .when(F.col("high_complexity"), "structure")
        .when(F.col("weak_relationship"), "relationship")
        .when(F.col("weak_rating"), "credit")
        .otherwise("other")
    )
    lost = F.lower(F.trim("stage_raw")) == "closed lost"
    return flagged.withColumn("likely_lost_reason", F.when(lost, reason))


def application_status(applications: DataFrame, opportunities: DataFrame) -> DataFrame:
    """Applications with status and decision dates carried back from the stage of their opportunity."""
    stages = opportunities.select("opportunity_id", "stage_raw", "actual_close_date")
    status = (
        F.when(F.col("stage_raw") == "Closed Won", "Approved")
        .when(F.col("stage_raw") == "Closed Lost", "Declined")
        .when(F.col("stage_raw") == "Withdrawn", "Withdrawn")
        .when(F.col("stage_raw").isin("Credit Review", "Negotiation"), "In Review")
        .otherwise("Submitted")
    )
    joined = applications.join(stages, "opportunity_id", "left").withColumn("application_status_raw", status)

    def decided(name: str, label: str) -> Column:
        return F.when(F.col("application_status_raw") == label, F.col("actual_close_date")).otherwise(F.col(name))

    dated = joined.withColumns({"approval_date": decided("approval_date", "Approved"), "decline_date": decided("decline_date", "Declined")})
    return dated.select(*applications.columns)


def rate_card_floor(product: str) -> Column:
    return lookup(F.col(product), RATE_CARD, OTHER_FLOOR)


def modelled_ftp(currency: str, product_group: str, tenor_months: str) -> tuple[Column, Column]:
    """(funding cost, liquidity cost) in bps from currency, product group and tenor; null for an unknown currency or group."""
    tenor = F.col(tenor_months)
    add = lookup(F.col(currency), CURVE_CURRENCIES, F.lit(None).cast("int")) + lookup(F.col(product_group), CURVE_GROUPS, F.lit(None).cast("int"))
    committed = F.when(F.col(product_group) == "Committed Lines", 10).otherwise(0)
    return 60 + tenor * F.lit(0.8) + add, 8 + tenor * F.lit(0.25) + committed


def modelled_expected_loss(ead: str, rating: str, collateral: str, pd_scale: float = 1.0, lgd_scale: float = 1.0) -> tuple[Column, Column, Column]:
    """(pd, lgd, expected loss) from the rating and collateral tables, within their bounds."""
    p = F.greatest(lookup(F.col(rating), RATING_PD, F.lit(None).cast("double")) * pd_scale, F.lit(MIN_PD))
    p = F.when(F.col(rating).isin(list(RATING_PD)), p)
    loss = F.greatest(F.least(lookup(F.col(collateral), COLLATERAL_LGD, OTHER_LGD) * lgd_scale, F.lit(MAX_LGD)), F.lit(MIN_LGD))
    return p, loss, F.col(ead) * p * loss


def maturity_date(start: str, tenor_months: str) -> Column:
    """Start plus whole months, clipped to the month end."""
    return (F.col(start) + F.make_ym_interval(F.lit(0), F.col(tenor_months))).cast("timestamp_ntz")
