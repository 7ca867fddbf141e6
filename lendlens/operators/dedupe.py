"""One row per key: latest extract, first row, final quote."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendlens.functions.standardize import final_quote_eligible


def top_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key. Spark keeps one row per key and input partition before
    the exchange (window group limit), so a hot key never lands whole in one task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def tie_break(df: DataFrame, used: Sequence[str], wanted: Sequence[str] | None = None) -> list[Column]:
    """The columns beside the ``used`` ones in declared order, largest first.

    Who reads only the ``wanted`` columns of the chosen row needs no column behind the last of them: rows that are equal
    that far are equal in all that is read. Columns in no order are not shuffled.
    """
    columns = [c for c in df.columns if c not in used]
    last = len(columns) if wanted is None else max((i + 1 for i, c in enumerate(columns) if c in wanted), default=0)
    return [F.col(f"`{c}`").desc_nulls_last() for c in columns[:last]]


def latest_by(
    df: DataFrame,
    keys: str | Sequence[str],
    ts: str | Sequence[str] = "source_extract_ts",
    null_ts: str = "wins",
    tie: Sequence[Column] | None = None,
) -> DataFrame:
    """Latest row per key. A missing time sorts last and therefore wins unless ``null_ts="loses"``;
    equal times are resolved by the remaining columns in declared order, largest first."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    ts = [ts] if isinstance(ts, str) else list(ts)
    if null_ts not in ("wins", "loses"):
        raise ValueError("null_ts must be 'wins' or 'loses'")
    by_time = [F.col(t).desc_nulls_first() if null_ts == "wins" else F.col(t).desc_nulls_last() for t in ts]
    return top_row(df, keys, by_time + list(tie if tie is not None else tie_break(df, keys + ts)))


def first_by(df: DataFrame, keys: str | Sequence[str], order: Sequence[Column] | None = None) -> DataFrame:
    """First row per key in an explicit order (all other columns ascending by default)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = order or [F.col(f"`{c}`").asc_nulls_last() for c in df.columns if c not in keys]
    return top_row(df, keys, order)


def final_first(eligible: Column | None = None) -> list[Column]:
    """The order in which a facility's quotes are considered as the final one; ``eligible`` stands for a status that is not at hand."""
    return [
        (final_quote_eligible("quote_status") if eligible is None else eligible).desc(),
        F.col("quote_version").desc_nulls_first(),
        F.col("quote_id").desc(),
    ]


def final_quote_ids(quotes: DataFrame) -> DataFrame:
    """(facility_id, final_quote_id): latest approved or submitted version, else the latest of any status."""
    slim = quotes.select("facility_id", "quote_id", "quote_version", "quote_status")
    return top_row(slim, ["facility_id"], final_first()).select("facility_id", F.col("quote_id").alias("final_quote_id"))


def facility_final_quotes(quotes: DataFrame, keys: DataFrame) -> DataFrame:
    """``keys`` (facility_source_id, facility_id, deal_id) with the final quote of each facility.

    The best quote of a raw facility is picked before any join, so only one narrow row per
    facility is shuffled; raw ids that stand for the same facility are settled afterwards.
    """
    slim = quotes.select("facility_source_id", "quote_id", "quote_version", F.lower("quote_status_raw").alias("quote_status"))
    best = top_row(slim, ["facility_source_id"], final_first()).join(keys.select("facility_source_id", "facility_id"), "facility_source_id")
    return keys.join(final_quote_ids(best), "facility_id", "left")


def flag_final_quotes(quotes: DataFrame) -> DataFrame:
    """Adds ``is_final_quote`` to quote versions that already carry their facility id."""
    flag = F.coalesce(F.col("quote_id") == F.col("final_quote_id"), F.lit(False))
    return quotes.join(final_quote_ids(quotes), "facility_id", "left").withColumn("is_final_quote", flag).drop("final_quote_id")


def latest_quotes(quotes: DataFrame) -> DataFrame:
    """Latest quote version per raw facility, any status."""
    return top_row(quotes, ["facility_source_id"], [F.col("quote_version").desc_nulls_first(), F.col("quote_id").desc()])


def latest_curve(ftp: DataFrame) -> DataFrame:
    """Latest funding rate per (currency, product group, tenor bucket); rows with a missing key are dropped."""
    keys = ["currency", "product_group", "tenor_bucket_months"]
    return latest_by(ftp.dropna(subset=keys), keys, "ftp_curve_date").select(*keys, "ftp_bps", "liquidity_cost_bps")
