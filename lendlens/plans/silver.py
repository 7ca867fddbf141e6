"""Bronze extracts -> canonical Silver entities. Every function is lazy except where the
relationship ranks need their counts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendlens.functions import standardize as S
from lendlens.functions.text import clamp01, clean_double, clean_timestamp, number_or_percent, title_case
from lendlens.operators.dedupe import facility_final_quotes, final_first, latest_by, tie_break
from lendlens.operators.ordered import percent_rank_columns
from lendlens.plans.lazy import LazyTables
from lendlens.session import settle
from lendlens.sources.catalog import BRONZE, SILVER, assert_no_forbidden_columns


def customers(accounts: DataFrame) -> DataFrame:
    latest = latest_by(accounts, "crm_account_id")
    return latest.select(
        S.customer_id("crm_account_id").alias("customer_id"),
        "crm_account_id",
        S.segment("customer_segment_raw").alias("customer_segment"),
        F.col("industry_raw").alias("industry"),
        S.replace_value("region_raw", "West Europe", "Western Europe").alias("region"),
        F.upper("country_raw").alias("country"),
        F.col("group_ref").alias("group_id"),
        F.col("rm_owner_code").alias("rm_id"),
        clean_timestamp("onboarding_date").alias("onboarding_date"),
        F.lower("relationship_status_raw").alias("relationship_status"),
        F.col("annual_revenue_bucket_raw").alias("annual_revenue_bucket"),
        F.col("employee_count_bucket_raw").alias("employee_count_bucket"),
        S.is_active_customer("relationship_status_raw").alias("is_active_customer"),
    )


def deals(opportunities: DataFrame, applications: DataFrame) -> DataFrame:
    """Opportunities with their latest applications; several applications repeat the deal."""
    read = ["opportunity_id", "financing_purpose_raw", "submission_date"]
    tie = tie_break(applications, ["application_id", "source_extract_ts"], read)
    latest = latest_by(applications, "application_id", tie=tie).select("application_id", *read)
    joined = opportunities.join(latest, "opportunity_id", "left").select(
        "*",
        S.deal_status("stage_raw").alias("deal_status"),
        S.deal_outcome("stage_raw").alias("deal_outcome"),
        S.lost_reason("lost_reason_raw").alias("lost_reason"),
    )
    return joined.select(
        S.deal_id("opportunity_id").alias("deal_id"),
        "opportunity_id",
        "application_id",
        S.customer_id("crm_account_id").alias("customer_id"),
        F.col("opportunity_type_raw").alias("deal_type"),
        F.col("financing_purpose_raw").alias("financing_purpose"),
        "deal_status",
        F.coalesce(clean_timestamp("submission_date"), clean_timestamp("created_date")).alias("offer_date"),
        clean_timestamp("expected_close_date").alias("expected_close_date"),
        clean_timestamp("actual_close_date").alias("decision_date"),
        F.when(F.col("deal_status") != "active", F.col("deal_outcome")).alias("deal_outcome"),
        "lost_reason",
        S.commercial_relevance("lost_reason", "deal_outcome", "deal_status").alias("commercial_relevance_flag"),
        F.col("owner_rm_code").alias("rm_id"),
        F.col("stage_raw").alias("current_stage"),
    )


# the raw columns that facilities are made of, beside their source id and application
FACILITY_SOURCES = {
    "product_type": ["product_type_raw"],
    "commitment_amount": ["commitment_amount"],
    "drawn_amount_initial": ["drawn_amount_initial"],
    "expected_utilization": ["expected_utilisation_raw", "product_type_raw"],
    "expected_utilized_volume": ["commitment_amount", "expected_utilisation_raw", "product_type_raw"],
    "currency": ["currency"],
    "tenor_months": ["tenor_months"],
    "maturity_date": ["maturity_date"],
    "repayment_type": ["repayment_type_raw"],
    "interest_type": ["interest_type_raw"],
    "collateral_type": ["collateral_type_raw"],
    "covenant_package": ["covenant_package_raw"],
}

# what quotes and risk read from facilities, and what facility economics read beside it
FACILITY_KEYS = ["facility_id", "facility_source_id", "deal_id"]
FACILITY_MEASURES = ["product_type", "commitment_amount", "expected_utilization", "expected_utilized_volume", "currency", "tenor_months"]


def facilities(raw: DataFrame, silver_deals: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Latest facility extracts that belong to a known application; all columns, or the named ones, for which no more of the wide
    extracts is shuffled than they and the choice of the latest need."""
    wanted = None if columns is None else ["application_id", *(c for name in columns for c in FACILITY_SOURCES.get(name, []))]
    latest = latest_by(raw, "facility_source_id", tie=tie_break(raw, ["facility_source_id", "source_extract_ts"], wanted))
    owners = silver_deals.where("application_id IS NOT NULL").select("deal_id", "application_id")
    joined = latest.join(owners, "application_id")
    joined = joined.withColumns({"product_type": S.product("product_type_raw"), "_share": number_or_percent("expected_utilisation_raw")})
    commitment = clean_double("commitment_amount")
    util = S.utilisation_share("_share", "product_type")
    known = joined.select(
        S.facility_id("facility_source_id").alias("facility_id"),
        "facility_source_id",
        "deal_id",
        "application_id",
        "product_type",
        commitment.alias("commitment_amount"),
        clean_double("drawn_amount_initial").alias("drawn_amount_initial"),
        util.alias("expected_utilization"),
        (commitment * util).alias("expected_utilized_volume"),
        S.currency("currency").alias("currency"),
        F.col("tenor_months").try_cast("int").alias("tenor_months"),
        clean_timestamp("maturity_date").alias("maturity_date"),
        title_case("repayment_type_raw").alias("repayment_type"),
        S.replace_value("interest_type_raw", "floater", "Floating").alias("interest_type"),
        F.col("collateral_type_raw").alias("collateral_type"),
        F.col("covenant_package_raw").alias("covenant_package"),
    )
    return known if columns is None else known.select(*columns)


def _facility_keys(silver_facilities: DataFrame) -> DataFrame:
    return silver_facilities.select("facility_source_id", "facility_id", "deal_id")


def _by_facility(raw: DataFrame, silver_facilities: DataFrame) -> DataFrame:
    """Raw rows of known facilities with ``facility_id`` and ``deal_id``, dealt out by facility once: what is then sought per raw id
    or per facility, and joins on the facility, need no further exchange."""
    # never null, so that no filter computes the id once more; a row without source id meets no key. The id is made again behind
    # the exchange, which then carries one of the two texts
    facility = F.coalesce(S.facility_id("facility_source_id"), F.lit(""))
    dealt = raw.repartition(facility).withColumn("__facility", facility)
    keys = _facility_keys(silver_facilities).withColumnRenamed("facility_source_id", "__source").repartition("facility_id")
    met = dealt.join(keys, (F.col("__facility") == F.col("facility_id")) & (F.col("facility_source_id") == F.col("__source")))
    return met.drop("__facility", "__source")


def pricing_cases(quotes: DataFrame, silver_facilities: DataFrame) -> DataFrame:
    """Quotes of known facilities with the final one flagged; the wide quote rows are shuffled once."""
    keys = facility_final_quotes(quotes, _facility_keys(silver_facilities))
    return _cases(quotes.join(keys, "facility_source_id"))


def _with_final_quote(quotes: DataFrame, silver_facilities: DataFrame) -> DataFrame:
    """Quotes of known facilities with ``final_quote_id``; quotes and facility keys are each shuffled once, by facility.
    All quotes of a facility meet in one task."""
    eligible = S.final_quote_eligible(F.lower("quote_status_raw"))  # for the order; the text is shuffled only where it is read
    known = _by_facility(quotes.withColumn("__eligible", eligible), silver_facilities)
    best = Window.partitionBy("facility_id").orderBy(*final_first(F.col("__eligible"))).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return known.withColumn("final_quote_id", F.first("quote_id").over(best))


def dealt_pricing_cases(quotes: DataFrame, silver_facilities: DataFrame) -> DataFrame:
    """The rows of ``pricing_cases`` for readers of many layers: wide quotes are shuffled and sorted by facility, once, and the
    keys of quotes are not shuffled beside them."""
    return _cases(_with_final_quote(quotes, silver_facilities))


def final_pricing_cases(quotes: DataFrame, silver_facilities: DataFrame) -> DataFrame:
    """The final quotes among ``pricing_cases``, for readers of these alone."""
    return _cases(_with_final_quote(quotes, silver_facilities).where("quote_id = final_quote_id"))


def _cases(known: DataFrame) -> DataFrame:
    """Pricing cases from quotes with ``facility_id``, ``deal_id`` and ``final_quote_id`` of their facility."""
    known = known.withColumn("quote_status", F.lower("quote_status_raw"))
    known = known.select(
        "deal_id",
        "facility_id",
        "quote_id",
        F.col("quote_version").try_cast("int").alias("quote_version"),
        "quote_status",
        clean_timestamp("quote_created_at").alias("quote_created_at"),
        clean_double("offered_margin_bps").alias("offered_margin_bps"),
        *[
            F.coalesce(clean_double(c), F.lit(0.0)).alias(c)
            for c in ("upfront_fee_bps", "commitment_fee_bps", "utilisation_fee_bps", "arrangement_fee_bps")
        ],
        *[clean_double(c).alias(c) for c in ("floor_margin_bps", "target_margin_bps", "stretch_margin_bps")],
        S.flag("rm_override_flag").alias("rm_override_flag"),
        F.col("override_reason_raw").alias("override_reason"),
        F.lower("approval_status_raw").alias("approval_status"),
        F.coalesce(F.col("quote_id") == F.col("final_quote_id"), F.lit(False)).alias("is_final_quote"),
    )
    return known.select(
        F.concat(F.lit("PC-"), "quote_id").alias("pricing_case_id"),
        "deal_id",
        "facility_id",
        "quote_id",
        "quote_version",
        "is_final_quote",
        "quote_status",
        "quote_created_at",
        "offered_margin_bps",
        "upfront_fee_bps",
        "commitment_fee_bps",
        "utilisation_fee_bps",
        "arrangement_fee_bps",
        "floor_margin_bps",
        "target_margin_bps",
        "stretch_margin_bps",
        (F.col("offered_margin_bps") - F.col("floor_margin_bps")).alias("margin_above_floor_bps"),
        "rm_override_flag",
        "override_reason",
        "approval_status",
        S.final_quote_warning("is_final_quote", "quote_status").alias("final_quote_warning"),
    )


def risk_assessments(raw: DataFrame, silver_facilities: DataFrame) -> DataFrame:
    """Latest assessment per facility, by assessment date and then extract time. Raw texts become numbers before the rows are dealt out."""
    read = raw.select(
        "risk_assessment_id",
        "facility_source_id",
        S.rating("rating_raw").alias("rating"),
        number_or_percent("pd_raw").alias("pd"),
        number_or_percent("lgd_raw").alias("lgd"),
        clean_double("ead_amount").alias("ead"),
        clean_double("rwa_amount").alias("rwa"),
        clean_double("expected_loss_amount").alias("expected_loss"),
        "risk_model_version",
        clean_timestamp("assessment_date").alias("assessment_date"),
        S.flag("watchlist_flag").alias("watchlist_flag"),
        "source_extract_ts",
    )
    times, tie = ["assessment_date", "source_extract_ts"], [F.col("risk_assessment_id").desc()]
    latest = latest_by(_by_facility(read, silver_facilities), "facility_id", times, tie=tie)
    return latest.select(
        "risk_assessment_id", "deal_id", "facility_id", "rating", "pd", "lgd", "ead", "rwa", "expected_loss", "risk_model_version", "assessment_date", "watchlist_flag"
    )


def touched_facilities(bronze: Mapping[str, DataFrame], chosen_deals: DataFrame) -> dict[str, DataFrame]:
    """The extracts with facilities, quotes and risk reduced to the facilities that the chosen deals have any extract of.

    The keys are small and found first; wide rows are filtered by the key that the next step needs them dealt by, before
    any of them is shuffled or, where the keys are few, without. All raw ids of such a facility stay, so its
    latest extract, final quote and risk are the same as without the reduction.
    """
    raw = bronze[BRONZE["los_facilities"]]
    applications = chosen_deals.where("application_id IS NOT NULL").select("application_id").distinct()
    keys = raw.select("application_id", "facility_source_id", S.facility_id("facility_source_id").alias("__facility"))
    facilities = keys.join(applications, "application_id", "left_semi").select("__facility").distinct()
    sources = settle(keys.join(facilities, "__facility", "left_semi").select("facility_source_id").distinct())
    tables = [BRONZE[t] for t in ("los_facilities", "pricing_quotes", "risk_assessments")]
    return {**bronze, **{t: bronze[t].join(sources, "facility_source_id", "left_semi") for t in tables}}


def newest_snapshots(raw: DataFrame) -> DataFrame:
    """The raw snapshots of each customer's latest month (a missing month counts as latest), all of them if several share it."""
    customer = S.customer_id("crm_account_id")
    place = F.rank().over(Window.partitionBy(customer).orderBy(clean_timestamp("snapshot_month").desc_nulls_first()))
    return raw.withColumn("__place", place).where("__place = 1").drop("__place")


def snapshot_strength(snapshots: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """Adds the relationship strength, ranked over all customer-months (of ``among``, if the snapshots are only some of them)."""
    ranked = percent_rank_columns(
        snapshots,
        {
            "_revenue_rank": "relationship_revenue_ltm",
            "_products_rank": "existing_product_count",
            "_days_rank": "days_since_last_contact",
        },
        among,
    )
    score = (
        0.40 * F.col("_revenue_rank") + 0.35 * F.col("_products_rank") + 0.25 * (1 - F.col("_days_rank"))
    )
    return ranked.withColumn("relationship_strength_score", clamp01(score)).drop(
        "_revenue_rank", "_products_rank", "_days_rank"
    )


def relationship_snapshots(raw: DataFrame, newest_only: bool = False) -> DataFrame:
    """All snapshots, or only those of each customer's latest month, with the same scores."""
    return snapshot_strength(newest_snapshots(raw) if newest_only else raw, raw if newest_only else None).select(
        S.customer_id("crm_account_id").alias("customer_id"),
        clean_timestamp("snapshot_month").alias("snapshot_month"),
        "total_existing_exposure",
        "total_drawn_amount",
        "deposit_balance_avg",
        "existing_product_count",
        "relationship_revenue_ltm",
        "relationship_cost_ltm",
        "relationship_margin_ltm",
        "days_since_last_contact",
        "relationship_strength_score",
    )


def ftp_rates(raw: DataFrame) -> DataFrame:
    return raw.select(
        "ftp_curve_date",
        S.currency("currency").alias("currency"),
        F.col("product_group_raw").alias("product_group"),
        "tenor_bucket_months",
        "ftp_bps",
        "liquidity_cost_bps",
    )


def build_silver(bronze: Mapping[str, DataFrame], keep: Callable[[str, DataFrame], DataFrame] | None = None) -> Mapping[str, DataFrame]:
    """The seven Silver tables, each built when it is first asked for.

    ``keep(name, df)`` is applied to a table before others are built on it: the pipeline writes the
    table and reads it back. Without it the tables with several consumers in Silver and Gold are settled and the
    others stay lazy.
    """
    shared = (SILVER["deals"], SILVER["facilities"], SILVER["risk_assessments"])
    keep = keep or (lambda name, df: settle(df) if name in shared else df)

    def raw(name: str) -> DataFrame:
        return bronze[BRONZE[name]]

    builders = {
        "customers": lambda: customers(raw("crm_accounts")),
        "deals": lambda: deals(raw("crm_opportunities"), raw("los_applications")),
        "facilities": lambda: facilities(raw("los_facilities"), tables[SILVER["deals"]]),
        "pricing_cases": lambda: pricing_cases(raw("pricing_quotes"), tables[SILVER["facilities"]]),
        "risk_assessments": lambda: risk_assessments(raw("risk_assessments"), tables[SILVER["facilities"]]),
        "relationship_snapshots": lambda: relationship_snapshots(raw("core_relationship_snapshot")),
        "ftp_rates": lambda: ftp_rates(raw("treasury_ftp_rates")),
    }

    def build(name: str) -> DataFrame:
        df = builders[name]()
        assert_no_forbidden_columns({SILVER[name]: df})
        return keep(SILVER[name], df)

    tables = LazyTables({full: partial(build, name) for name, full in SILVER.items()})
    return tables
