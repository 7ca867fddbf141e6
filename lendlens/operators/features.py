"""Facility features and their deal-level aggregate; columns are added only where inputs exist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendlens.functions.economics import tenor_years

# Product name patterns of the deal flags.
FLAG_PATTERNS = {"has_rcf": "rcf|revolving|revolver", "has_term_loan": "term", "has_guarantee": "guarant"}


def has(df: DataFrame, *columns: str) -> bool:
    return set(columns) <= set(df.columns)


def add_margin_above_floor(df: DataFrame) -> DataFrame:
    if not has(df, "offered_margin_bps", "floor_margin_bps"):
        return df
    return df.withColumn("margin_above_floor_bps", F.col("offered_margin_bps") - F.col("floor_margin_bps"))


def add_tenor_years(df: DataFrame) -> DataFrame:
    return df.withColumn("tenor_years", tenor_years("tenor_months")) if has(df, "tenor_months") else df


def add_expected_volume(df: DataFrame) -> DataFrame:
    if not has(df, "commitment_amount", "expected_utilization"):
        return df
    return df.withColumn("expected_utilized_volume", F.col("commitment_amount") * F.col("expected_utilization"))


def weighted_mean(value: str, weight: str):
    """Aggregate: mean of known values weighted by ``weight`` (missing counts 0); no weight gives null."""
    w = F.coalesce(F.col(weight), F.lit(0.0))
    return F.try_divide(F.sum(F.col(value) * w), F.sum(F.when(F.col(value).isNotNull(), w)))


def fee_share(fee: str, margin: str):
    """Aggregate: fees in fees plus margin; 0 whenever the margins sum to 0."""
    fees = F.coalesce(F.sum(fee), F.lit(0.0))
    margins = F.nullif(F.coalesce(F.sum(margin), F.lit(0.0)), F.lit(0.0))
    return F.coalesce(F.try_divide(fees, fees + margins), F.lit(0.0))


def product_flag(product: str, pattern: str):
    """Aggregate: any product of the group matches the pattern."""
    return F.coalesce(F.bool_or(F.lower(product).rlike(pattern)), F.lit(False))


def deal_level_features(facilities: DataFrame) -> DataFrame:
    """One aggregate per deal; facilities without a deal form a group of their own, without flags."""
    if "deal_id" not in facilities.columns:
        raise ValueError("facilities must contain deal_id")
    df = add_expected_volume(add_margin_above_floor(facilities))
    for column, default in (
        ("expected_utilized_volume", F.lit(0.0)),
        ("commitment_amount", F.lit(0.0)),
        ("margin_above_floor_bps", F.lit(None).cast("double")),
        ("product_type", F.lit("")),
    ):
        if column not in df.columns:
            df = df.withColumn(column, default)
    share = fee_share("upfront_fee_bps", "offered_margin_bps") if has(df, "upfront_fee_bps", "offered_margin_bps") else F.lit(0.0)
    grouped = df.groupBy("deal_id").agg(
        F.count(F.lit(1)).alias("number_of_facilities"),
        F.coalesce(F.sum("commitment_amount"), F.lit(0.0)).alias("total_commitment"),
        F.coalesce(F.sum("expected_utilized_volume"), F.lit(0.0)).alias("total_expected_utilized_volume"),
        F.min("margin_above_floor_bps").alias("min_margin_above_floor_bps"),
        weighted_mean("margin_above_floor_bps", "expected_utilized_volume").alias("weighted_avg_margin_above_floor_bps"),
        share.alias("fee_share"),
        *[product_flag("product_type", pattern).alias(name) for name, pattern in FLAG_PATTERNS.items()],
    )
    return grouped.select(
        *[c for c in grouped.columns if c not in FLAG_PATTERNS],
        *[F.when(F.col("deal_id").isNotNull(), F.col(name)).alias(name) for name in FLAG_PATTERNS],
    )
