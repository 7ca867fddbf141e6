"""Silver entities -> Gold marts: facility and deal economics, training, scoring, dashboard."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendlens.functions import economics as E
from lendlens.functions.text import clamp01
from lendlens.operators.asof import as_of_join
from lendlens.operators.dedupe import first_by, latest_by, latest_curve
from lendlens.operators.ordered import percent_rank_columns
from lendlens.plans import silver as silver_plan
from lendlens.plans.lazy import LazyTables
from lendlens.session import settle
from lendlens.sources.catalog import BRONZE, GOLD, SILVER, assert_no_forbidden_columns

# The features of a deal, in the order of the result.
FEATURES = [
    "deal_id", "customer_id", "rm_id", "customer_segment", "industry", "region",
    "rating_at_offer", "pd_at_offer", "lgd_weighted",
    "relationship_strength_score", "existing_product_count", "days_since_last_contact",
    "anchor_product", "number_of_facilities", "total_commitment", "total_expected_utilized_volume",
    "weighted_avg_margin_above_floor_bps", "min_margin_above_floor_bps",
    "total_expected_profit_annual", "total_expected_profit_lifetime",
    "fee_income_share", "deal_complexity_score",
    "has_rcf", "has_term_loan", "has_guarantee", "has_trade_finance",
]

# what deal totals and deal risk read from facility economics
DEAL_INPUTS = [
    "deal_id", "facility_id", "product_type", "commitment_amount", "expected_utilized_volume",
    "expected_facility_profit_annual", "expected_facility_profit_lifetime", "margin_above_floor_bps",
    "annualized_fee_bps", "offered_margin_bps", "pricing_zone",
]

# what facility inputs read from final quotes
QUOTE_INPUTS = [
    "deal_id", "facility_id", "offered_margin_bps", "upfront_fee_bps", "commitment_fee_bps",
    "utilisation_fee_bps", "arrangement_fee_bps", "floor_margin_bps", "target_margin_bps",
    "stretch_margin_bps", "margin_above_floor_bps",
]

# what facility inputs and deal risk read from risk assessments
RISK_INPUTS = ["deal_id", "facility_id", "rating", "pd", "lgd", "ead", "rwa", "expected_loss"]

# Product flags.
PRODUCT_FLAGS = {
    "has_rcf": "RCF",
    "has_term_loan": "Term Loan",
    "has_guarantee": "Guarantee",
    "has_trade_finance": "Trade Finance",
}


def _priced_parts(silver: Mapping[str, DataFrame]) -> DataFrame:
    """What facility economics read of facilities."""
    return silver[SILVER["facilities"]].select(
        "deal_id", "facility_id", "product_type", "commitment_amount", "expected_utilization",
        "expected_utilized_volume", "currency", "tenor_months",
    )


def _with_quotes(facilities: DataFrame, silver: Mapping[str, DataFrame]) -> DataFrame:
    quotes = silver[SILVER["pricing_cases"]].where("is_final_quote").select(*QUOTE_INPUTS)
    return facilities.join(quotes, ["deal_id", "facility_id"])


def _with_curve_keys(facilities: DataFrame) -> DataFrame:
    return facilities.withColumns(
        {
            "tenor_years": E.tenor_years("tenor_months"),
            "product_group": E.product_group("product_type"),
            "tenor_bucket_months": E.tenor_bucket("tenor_months"),
        }
    )


def quoted_facilities(silver: Mapping[str, DataFrame]) -> DataFrame:
    """Facilities with their final quote."""
    return _with_curve_keys(_with_quotes(_priced_parts(silver), silver))


def known_until(deals: DataFrame) -> DataFrame:
    """(deal_id, known_until): what was known at a deal's decision may explain it; an undecided deal knows all."""
    dated = deals.select("deal_id", "decision_date").groupBy("deal_id").agg(F.max("decision_date").alias("known_until"))
    forever = F.lit("9999-12-31 00:00:00").cast(dated.schema["known_until"].dataType)
    return dated.withColumn("known_until", F.coalesce("known_until", forever))


def facility_inputs(silver: Mapping[str, DataFrame], as_of: bool = False) -> DataFrame:
    """Facilities with their final quote, their risk row and the latest funding curve, or with ``as_of`` the one
    that was the latest when the deal was decided."""
    risk = silver[SILVER["risk_assessments"]].select("deal_id", "facility_id", "expected_loss", "rwa", "ead")
    keys, rates = ["currency", "product_group", "tenor_bucket_months"], ["ftp_bps", "liquidity_cost_bps"]
    if as_of:
        # facilities find their curve while they are narrow, before they meet quotes and risk
        parts = _priced_parts(silver)
        dated = settle(_with_curve_keys(parts).join(known_until(silver[SILVER["deals"]]), "deal_id", "left"))
        priced = as_of_join(dated, silver[SILVER["ftp_rates"]], keys, "known_until", "ftp_curve_date", rates).select(*parts.columns, *rates)
        return _with_curve_keys(_with_quotes(priced, silver)).join(risk, ["deal_id", "facility_id"], "left")
    df = quoted_facilities(silver).join(risk, ["deal_id", "facility_id"], "left")
    curve = settle(latest_curve(silver[SILVER["ftp_rates"]]))
    return df.join(curve, keys, "left")


def facility_economics(silver: Mapping[str, DataFrame], as_of: bool = False) -> DataFrame:
    df = facility_inputs(silver, as_of)
    costs = df.withColumns(
        {
            "ftp_bps": F.coalesce("ftp_bps", F.lit(E.DEFAULT_FTP_BPS)),
            "liquidity_cost_bps": F.coalesce("liquidity_cost_bps", F.lit(E.DEFAULT_LIQUIDITY_BPS)),
            "annualized_fee_bps": E.annualized_fee_bps(
                "product_type", "tenor_years", "upfront_fee_bps", "arrangement_fee_bps",
                "commitment_fee_bps", "utilisation_fee_bps", "expected_utilization",
            ),
            "risk_cost_bps": E.risk_cost_bps("expected_loss", "expected_utilized_volume", "tenor_years"),
            "admin_cost_bps": E.admin_cost_bps("product_type"),
            "capital_cost_bps": E.capital_cost_bps("rwa", "ead", "expected_utilized_volume"),
        }
    )
    margin = costs.withColumn(
        "risk_adjusted_margin_bps",
        E.risk_adjusted_margin_bps(
            "offered_margin_bps", "annualized_fee_bps", "ftp_bps", "liquidity_cost_bps",
            "risk_cost_bps", "admin_cost_bps", "capital_cost_bps",
        ),
    )
    return margin.select(
        "deal_id", "facility_id", "product_type", "commitment_amount", "expected_utilization",
        "expected_utilized_volume", "tenor_months", "tenor_years", "offered_margin_bps",
        "annualized_fee_bps", "ftp_bps", "liquidity_cost_bps", "risk_cost_bps", "admin_cost_bps",
        "capital_cost_bps", "floor_margin_bps", "target_margin_bps", "stretch_margin_bps",
        "margin_above_floor_bps", "risk_adjusted_margin_bps",
        E.facility_profit("risk_adjusted_margin_bps", "expected_utilized_volume").alias("expected_facility_profit_annual"),
        E.facility_profit("risk_adjusted_margin_bps", "expected_utilized_volume", "tenor_years").alias(
            "expected_facility_profit_lifetime"
        ),
        E.pricing_zone(
            "offered_margin_bps", "floor_margin_bps", "target_margin_bps", "stretch_margin_bps", "risk_adjusted_margin_bps"
        ).alias("pricing_zone"),
    )


def _total(c: str):
    return F.coalesce(F.sum(c), F.lit(0.0))


def deal_totals(economics: DataFrame) -> DataFrame:
    """One aggregate per deal over all facility measures.

    The narrow rows are dealt out by deal once. Left to the planner, the distinct count has them shuffled twice, each time as the
    buffers of all measures, which are larger than the rows.
    """
    measures = [c for c in DEAL_INPUTS if c in economics.columns]
    return economics.where("deal_id IS NOT NULL").select(*measures).repartition("deal_id").groupBy("deal_id").agg(
        F.mode("product_type", True).alias("anchor_product"),
        F.countDistinct("facility_id").alias("number_of_facilities"),
        _total("commitment_amount").alias("total_commitment"),
        _total("expected_utilized_volume").alias("total_expected_utilized_volume"),
        _total("expected_facility_profit_annual").alias("total_expected_profit_annual"),
        _total("expected_facility_profit_lifetime").alias("total_expected_profit_lifetime"),
        F.avg("margin_above_floor_bps").alias("weighted_avg_margin_above_floor_bps"),
        F.min("margin_above_floor_bps").alias("min_margin_above_floor_bps"),
        E.worst_known_zone("pricing_zone").alias("worst_facility_pricing_zone"),
        E.fee_income_share("annualized_fee_bps", "offered_margin_bps").alias("fee_income_share"),
        *[F.coalesce(F.bool_or(F.col("product_type") == p), F.lit(False)).alias(name) for name, p in PRODUCT_FLAGS.items()],
    )


def deal_complexity(totals: DataFrame) -> DataFrame:
    """Adds the complexity score, ranked over all deals, of which there is one row each. Amounts are ranked at four decimals: equal
    totals must tie whatever order their parts were added in."""
    rounded = totals.withColumn("_commitment", F.round("total_commitment", 4))
    ranked = percent_rank_columns(rounded, {"_n_rank": "number_of_facilities", "_c_rank": "_commitment"}, keys=["deal_id"])
    score = F.col("_n_rank") * 0.65 + F.col("_c_rank") * 0.35
    return ranked.withColumn("deal_complexity_score", clamp01(score)).drop("_n_rank", "_c_rank", "_commitment")


def deal_economics(economics: DataFrame, deals: DataFrame, with_complexity: bool = True) -> DataFrame:
    """Deal totals with customer and manager of the deal. The complexity score reads the totals
    twice, so they are settled first; leave it out where it is not needed to stay lazy."""
    reference = first_by(deals.select("deal_id", "customer_id", "rm_id"), "deal_id")
    totals = deal_totals(economics)
    if with_complexity:
        totals = deal_complexity(settle(totals))
    return reference.join(totals, "deal_id").withColumn(
        "deal_pricing_zone", E.deal_zone("total_expected_profit_lifetime", "worst_facility_pricing_zone")
    )


def weighted_with_mean_fill(value: str, weight: str):
    """Aggregate: weighted mean in which a missing value counts as the group mean; with no
    weight at all the plain mean."""
    v, w = F.col(value), F.coalesce(F.col(weight), F.lit(0.0))
    mean, total = F.avg(v), F.sum(w)
    known = F.coalesce(F.sum(F.when(v.isNotNull(), v * w)), F.lit(0.0))
    unknown = F.coalesce(F.sum(F.when(v.isNull(), w)), F.lit(0.0))
    return F.when(total == 0, mean).otherwise((known + mean * unknown) / total)


def risk_by_deal(risk: DataFrame, economics: DataFrame) -> DataFrame:
    """Rating and weighted risk per deal.

    Risk rows and weights are dealt out by deal before they meet on deal and facility, so the join and the aggregate read
    narrow rows once and the larger buffers of the aggregate are not shuffled.
    """
    keys = ["deal_id", "facility_id"]
    weights = economics.select(*keys, "expected_utilized_volume").repartition("deal_id")
    return (
        risk.where("deal_id IS NOT NULL")
        .select(*keys, "rating", "pd", "lgd")
        .repartition("deal_id")
        .join(weights, keys, "left")
        .groupBy("deal_id")
        .agg(
            F.mode("rating", True).alias("rating_at_offer"),
            weighted_with_mean_fill("pd", "expected_utilized_volume").alias("pd_at_offer"),
            weighted_with_mean_fill("lgd", "expected_utilized_volume").alias("lgd_weighted"),
        )
    )


def latest_relationship(snapshots: DataFrame) -> DataFrame:
    return latest_by(snapshots, "customer_id", "snapshot_month")


def with_relationship(deals: DataFrame, snapshots: DataFrame, as_of: DataFrame | None = None) -> DataFrame:
    """Deals with the latest snapshot of their customer, or the latest one not after ``as_of`` (deal_id, known_until)."""
    measures = ["relationship_strength_score", "existing_product_count", "days_since_last_contact"]
    slim = snapshots.select("customer_id", "snapshot_month", *measures)
    if as_of is None:
        return deals.join(latest_relationship(slim).drop("snapshot_month"), "customer_id", "left")
    dated = settle(deals.join(as_of, "deal_id", "left"))  # read for the questions and for the rows
    return as_of_join(dated, slim, "customer_id", "known_until", "snapshot_month", measures).drop("known_until")


def deal_features(silver: Mapping[str, DataFrame], economics: DataFrame, deal_econ: DataFrame, as_of: bool = False) -> DataFrame:
    """Deals with customer, relationship, economics and risk attributes. With ``as_of`` the relationship is the one
    known at the decision; ``economics`` should be built the same way."""
    customers = silver[SILVER["customers"]].select("customer_id", "customer_segment", "industry", "region")
    risk = risk_by_deal(silver[SILVER["risk_assessments"]], economics)
    deals = silver[SILVER["deals"]].select(
        "deal_id", "customer_id", "rm_id", "deal_status", "deal_outcome", "commercial_relevance_flag",
        "expected_close_date", "current_stage",
    )
    snapshots = silver[SILVER["relationship_snapshots"]]
    if as_of:  # deals find their relationship while they are narrow
        deals = with_relationship(deals, snapshots, known_until(silver[SILVER["deals"]]))
    econ = deal_econ.withColumnsRenamed({"deal_id": "_deal", "customer_id": "_customer", "rm_id": "_rm"})
    matched = deals.join(
        econ,
        (F.col("deal_id") == F.col("_deal"))
        & (F.col("customer_id") == F.col("_customer"))
        & F.col("rm_id").eqNullSafe(F.col("_rm")),
    ).drop("_deal", "_customer", "_rm")
    described = matched.join(risk, "deal_id", "left").join(customers, "customer_id", "left")
    return described if as_of else with_relationship(described, snapshots)


def active_features(bronze: Mapping[str, DataFrame]) -> DataFrame:
    """The features of active deals alone, without the complexity score, which ranks over all deals.

    Active deals are found first, from two narrow extracts; facilities, quotes and risk of others are dropped before they
    are joined, and of the snapshots only those that are the latest meet their ranks.
    """
    deals = settle(silver_plan.deals(bronze[BRONZE["crm_opportunities"]], bronze[BRONZE["los_applications"]]))
    active = deals.where("deal_status = 'active'")
    raw = silver_plan.touched_facilities(bronze, active)
    columns = [*silver_plan.FACILITY_KEYS, *silver_plan.FACILITY_MEASURES]
    facilities = settle(silver_plan.facilities(raw[BRONZE["los_facilities"]], deals, columns))
    silver = {
        SILVER["customers"]: silver_plan.customers(raw[BRONZE["crm_accounts"]]),
        SILVER["deals"]: active,
        SILVER["facilities"]: facilities.join(active.select("deal_id").distinct(), "deal_id", "left_semi"),
        SILVER["pricing_cases"]: silver_plan.final_pricing_cases(raw[BRONZE["pricing_quotes"]], facilities),
        SILVER["risk_assessments"]: settle(silver_plan.risk_assessments(raw[BRONZE["risk_assessments"]], facilities).select(*RISK_INPUTS)),
        SILVER["relationship_snapshots"]: silver_plan.relationship_snapshots(raw[BRONZE["core_relationship_snapshot"]], newest_only=True),
        SILVER["ftp_rates"]: silver_plan.ftp_rates(raw[BRONZE["treasury_ftp_rates"]]),
    }
    economics = settle(facility_economics(silver).select(*DEAL_INPUTS))
    return deal_features(silver, economics, deal_economics(economics, deals, with_complexity=False))


def training_set(features: DataFrame) -> DataFrame:
    """Closed, commercially relevant deals with a won or lost label."""
    closed = (
        F.col("deal_status").isin("closed_won", "closed_lost")
        & F.col("commercial_relevance_flag")
        & F.col("deal_outcome").isin("won", "lost")
    )
    return features.where(closed).select(*FEATURES, "deal_outcome")


def active_set(features: DataFrame) -> DataFrame:
    return features.where("deal_status = 'active'").select(
        *FEATURES, "expected_close_date", "current_stage", F.col("deal_pricing_zone").alias("pricing_zone")
    )


def rm_dashboard(features: DataFrame) -> DataFrame:
    active = features.where("deal_status = 'active'")
    return active.select(
        "deal_id", "customer_id", "rm_id", "customer_segment", "industry", "anchor_product", "total_commitment",
        "number_of_facilities", "current_stage", "expected_close_date", "relationship_strength_score",
        F.col("deal_pricing_zone").alias("pricing_zone"), "min_margin_above_floor_bps",
        "total_expected_profit_annual", "total_expected_profit_lifetime",
        E.recommended_action("deal_pricing_zone", "relationship_strength_score").alias("recommended_action_placeholder"),
        E.any_missing("relationship_strength_score", "min_margin_above_floor_bps").alias("data_quality_warning_flag"),
    )


def build_gold(
    silver: Mapping[str, DataFrame], keep: Callable[[str, DataFrame], DataFrame] | None = None, as_of: bool = False
) -> Mapping[str, DataFrame]:
    """The five Gold tables, each built when it is first asked for. With ``as_of`` funding curve and relationship of a decided deal
    are those known at its decision, so that no later knowledge leaks into the training set.

    What several marts are built on is written once, and only if one of them is asked for: facility
    measures and deal economics. ``keep(name, df)`` is applied to every mart (the pipeline writes it and reads it back);
    then marts are built on the kept ones, and the features that three marts are cut from are written once, too. Without
    it a mart's filter reaches the tables below.
    """

    def mart(name: str, df: DataFrame) -> DataFrame:
        assert_no_forbidden_columns({name: df})
        return keep(name, df) if keep else df

    def same(df: DataFrame) -> DataFrame:
        return df

    def economics() -> DataFrame:
        """Facility measures for the other marts."""
        return tables[GOLD["facility_economics"]] if keep else shared["measures"]

    def econ() -> DataFrame:
        return tables[GOLD["deal_economics"]] if keep else shared["deals"]

    shared = LazyTables({
        "measures": lambda: settle(facility_economics(silver, as_of).select(*DEAL_INPUTS)),
        "deals": lambda: settle(deal_economics(economics(), silver[SILVER["deals"]])),
        "features": lambda: (settle if keep else same)(deal_features(silver, economics(), econ(), as_of)),
    })
    tables = LazyTables({
        GOLD["facility_economics"]: lambda: mart(GOLD["facility_economics"], facility_economics(silver, as_of)),
        GOLD["deal_economics"]: lambda: mart(GOLD["deal_economics"], deal_economics(economics(), silver[SILVER["deals"]])),
        GOLD["deal_training_dataset"]: lambda: mart(GOLD["deal_training_dataset"], training_set(shared["features"])),
        GOLD["active_deal_scoring_dataset"]: lambda: mart(GOLD["active_deal_scoring_dataset"], active_set(shared["features"])),
        GOLD["rm_deal_dashboard"]: lambda: mart(GOLD["rm_deal_dashboard"], rm_dashboard(shared["features"])),
    })
    return tables
