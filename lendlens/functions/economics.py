"""Facility and deal economics as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# Tenor buckets of the funding curve, cost add-ons and bounds in bps.
TENOR_BUCKETS = [12, 24, 36, 60, 84]
NO_TENOR_BUCKET = 36
DEFAULT_FTP_BPS = 110.0
DEFAULT_LIQUIDITY_BPS = 20.0
ADMIN_COST_CONTINGENT = 12.0
ADMIN_COST_LENDING = 8.0
CAPITAL_RATE = 18.0
DEFAULT_RWA_DENSITY = 0.75
CAPITAL_BOUNDS = (8.0, 35.0)
MIN_TENOR_YEARS = 0.25
GUARDRAIL_BUFFER_BPS = 10.0

# Zones from worst to best.
ZONES = ["Red", "Guardrail", "Recommended", "Stretch"]

COMMITTED_LINES = ["RCF", "Overdraft"]
CONTINGENT = ["Guarantee", "Trade Finance"]

ACTION_RED = "Review economics and guardrail exception"
ACTION_GUARDRAIL = "Prepare pricing justification"
ACTION_STRONG = "Prioritize RM follow-up"
ACTION_OTHER = "Monitor pipeline"


def product_group(product_type) -> Column:
    p = col(product_type)
    return (
        F.when(p.isin(COMMITTED_LINES), "Committed Lines")
        .when(p == "Term Loan", "Term Lending")
        .when(p == "Guarantee", "Guarantee")
        .otherwise("Trade")
    )


def tenor_bucket(tenor_months) -> Column:
    """Nearest bucket; a tie takes the shorter one.

    Between two neighbours the switch lies at their midpoint, so the nearest
    bucket is one comparison per gap.
    """
    m = col(tenor_months)
    chain = F.when(m.isNull(), NO_TENOR_BUCKET)
    for low, high in zip(TENOR_BUCKETS, TENOR_BUCKETS[1:]):
        chain = chain.when(m <= (low + high) / 2, low)
    return chain.otherwise(TENOR_BUCKETS[-1])


def tenor_years(tenor_months) -> Column:
    return col(tenor_months) / 12.0


def _at_least_quarter(years: Column) -> Column:
    return F.when(years.isNotNull(), F.greatest(years, F.lit(MIN_TENOR_YEARS)))


def annualized_fee_bps(product_type, years, upfront, arrangement, commitment, usage, utilisation) -> Column:
    """One-off fees spread over the tenor plus the running fees of the product.

    A tenor of 0 counts as one year, a missing tenor gives a missing fee.
    """
    p, y, util = col(product_type), col(years), F.coalesce(col(utilisation), F.lit(0.0))
    span = _at_least_quarter(F.when(y == 0, 1.0).otherwise(y))
    zero = F.lit(0.0)
    one_off = F.coalesce(col(upfront), zero) / span + F.coalesce(col(arrangement), zero) / span
    line_fee, use_fee = F.coalesce(col(commitment), zero), F.coalesce(col(usage), zero)
    return (
        F.when(p.isin(COMMITTED_LINES), one_off + line_fee * (1 - util) + use_fee * util)
        .when(p.isin(CONTINGENT), one_off + use_fee)
        .otherwise(one_off)
    )


def risk_cost_bps(expected_loss, volume, years) -> Column:
    exposure = F.coalesce(col(volume), F.lit(0.0)) * F.greatest(
        F.coalesce(col(years), F.lit(1.0)), F.lit(MIN_TENOR_YEARS)
    )
    return F.coalesce(col(expected_loss), F.lit(0.0)) / F.greatest(exposure, F.lit(1.0)) * 10000


def admin_cost_bps(product_type) -> Column:
    return F.when(col(product_type).isin(CONTINGENT), ADMIN_COST_CONTINGENT).otherwise(ADMIN_COST_LENDING)


def capital_cost_bps(rwa, ead, volume) -> Column:
    base = F.coalesce(F.nullif(col(ead), F.lit(0.0)), F.nullif(col(volume), F.lit(0.0)))
    density = F.coalesce(F.coalesce(col(rwa), F.lit(0.0)) / base, F.lit(DEFAULT_RWA_DENSITY))
    low, high = CAPITAL_BOUNDS
    return F.least(F.greatest(density * CAPITAL_RATE, F.lit(low)), F.lit(high))


def risk_adjusted_margin_bps(offered, fee=0.0, ftp=0.0, liquidity=0.0, risk=0.0, admin=0.0, capital=0.0) -> Column:
    margin = col(offered) + (F.lit(fee) if isinstance(fee, float) else col(fee))
    for cost in (ftp, liquidity, risk, admin, capital):
        margin = margin - (F.lit(cost) if isinstance(cost, float) else col(cost))
    return margin


def facility_profit(margin_bps, volume, years=1.0) -> Column:
    return col(margin_bps) / 10000 * col(volume) * (F.lit(years) if isinstance(years, float) else col(years))


def expected_deal_value(probability, profit, strict: bool = True) -> Column:
    """Probability-weighted profit. Out-of-range probabilities raise, or give null when not strict."""
    p = col(probability)
    ok = p.isNull() | p.between(0, 1)
    value = F.when(ok, p * col(profit))
    if not strict:
        return value
    return value.when(~ok, F.raise_error(F.lit("win_probability must be between 0 and 1")).cast("double"))


def pricing_zone(offered, floor, target, stretch, risk_adjusted=None, buffer=GUARDRAIL_BUFFER_BPS) -> Column:
    o, f = col(offered), col(floor)
    chain = F.when(o < f, "Red")
    if risk_adjusted is not None:
        chain = chain.when(col(risk_adjusted) < 0, "Red")
    return (
        chain.when(o <= f + buffer, "Guardrail")
        .when(o >= col(stretch), "Stretch")
        .when(o >= col(target), "Recommended")
        .otherwise("Guardrail")
    )


def zone_severity(zone) -> Column:
    chain = None
    for rank, name in enumerate(ZONES):
        hit = col(zone) == name
        chain = F.when(hit, rank) if chain is None else chain.when(hit, rank)
    return chain.otherwise(99)


def worst_zone(zone) -> Column:
    """Aggregate: the most severe zone of a group (a zone outside the list ranks last)."""
    return F.min(F.struct(zone_severity(zone).alias("s"), col(zone).alias("z")))["z"]


def worst_known_zone(zone) -> Column:
    """Aggregate for zones made by ``pricing_zone``: an integer minimum, so hash aggregation applies."""
    worst = F.min(zone_severity(zone))
    chain = None
    for rank, name in enumerate(ZONES):
        chain = F.when(worst == rank, name) if chain is None else chain.when(worst == rank, name)
    return chain


def deal_zone(lifetime_profit, worst) -> Column:
    return F.when(col(lifetime_profit) < 0, "Red").otherwise(col(worst))


def fee_income_share(fee, margin) -> Column:
    """Aggregate: share of fees in fees plus margin; 0 when both sum to 0."""
    fees = F.coalesce(F.sum(col(fee)), F.lit(0.0))
    total = fees + F.coalesce(F.sum(col(margin)), F.lit(0.0))
    return F.when(total != 0, fees / total).otherwise(0.0)


def recommended_action(zone, strength) -> Column:
    z = col(zone)
    return (
        F.when(z == "Red", ACTION_RED)
        .when(z == "Guardrail", ACTION_GUARDRAIL)
        .when(F.coalesce(col(strength), F.lit(0.0)) > 0.7, ACTION_STRONG)
        .otherwise(ACTION_OTHER)
    )


def any_missing(*columns) -> Column:
    flag = F.lit(False)
    for c in columns:
        flag = flag | col(c).isNull()
    return flag


def sigmoid(c) -> Column:
    return 1 / (1 + F.exp(-col(c)))


def win_label(c) -> Column:
    """won -> 1, lost -> 0, missing stays missing, anything else fails the job."""
    clean = F.lower(col(c))
    return (
        F.when(clean == "won", 1)
        .when(clean == "lost", 0)
        .when(clean.isNotNull(), F.raise_error(F.concat(F.lit("unexpected deal outcome: "), clean)).cast("int"))
    )


def cut(c, edges: list[float], labels: list[str]) -> Column:
    """Right-closed bins; outside the edges the label is missing."""
    v = col(c)
    chain = None
    for low, high, label in zip(edges, edges[1:], labels):
        hit = (v > low) & (v <= high)
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return chain
