"""Descriptive cuts: grouped rates, trimmed correlations, histograms, standardisation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendlens.functions.economics import cut, win_label
from lendlens.operators.ordered import quantiles
from lendlens.session import settle

# Bins of the win/loss cuts.
TENOR_CUT = ([0, 12, 36, 120], ["short", "medium", "long"])
MARGIN_CUT = ([-999, 0, 30, 70, 999], ["below_floor", "guardrail", "recommended", "stretch"])
RATE_EDGES = [0.01 * i for i in range(15)]


def add_cuts(df: DataFrame) -> DataFrame:
    """Tenor and margin buckets and the 0/1 label of the win/loss analysis."""
    return df.withColumns({
        "tenor_bucket": cut("tenor_months", *TENOR_CUT),
        "margin_bucket": cut("margin_above_floor_bps", *MARGIN_CUT),
        "won_flag": win_label("deal_outcome"),
    })


def win_rate_by_cuts(df: DataFrame, cuts: Sequence[str], label: str = "won_flag") -> DataFrame:
    """(cut_name, cut_value, n_deals, win_rate) for every cut from one scan. Rows are counted by all cuts
    together first; the grouping sets multiply those few counted rows only."""
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in cuts], label)
    counted = texts.groupBy(*cuts).agg(F.count(label).alias("_n"), F.sum(label).alias("_s"))
    grouped = counted.groupingSets([[F.col(c)] for c in cuts], *[F.col(c) for c in cuts]).agg(
        F.sum("_n").alias("n_deals"),
        F.try_divide(F.sum("_s"), F.sum("_n")).alias("win_rate"),
        *[F.grouping(c).alias(f"_g_{c}") for c in cuts],
    )
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c in cuts:
        name = F.when(F.col(f"_g_{c}") == 0, c).otherwise(name)
        value = F.when(F.col(f"_g_{c}") == 0, F.col(c)).otherwise(value)
    return grouped.select(name.alias("cut_name"), value.alias("cut_value"), "n_deals", "win_rate").where("cut_value IS NOT NULL")


def mean_and_count(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean_rate"), F.count(F.lit(1)).alias("n_loans"))


def quantile_trim(df: DataFrame, value: str, low: float = 0.025, high: float = 0.975, by: str | None = None, weight: str | None = None) -> DataFrame:
    """Rows strictly between two exact quantiles, of the whole frame or of each ``by`` label; ``weight`` says how
    many rows a row stands for."""
    if by is None:
        bounds = quantiles(df, value, [low, high], weight=weight).first()
        if bounds is None:
            return df.where(F.lit(False))
        return df.where((F.col(value) > bounds["q0"]) & (F.col(value) < bounds["q1"]))
    bounds = quantiles(df, value, [low, high], by, weight).select(F.col(by).alias("_by"), "q0", "q1")
    inside = (F.col(by) == F.col("_by")) & (F.col(value) > F.col("q0")) & (F.col(value) < F.col("q1"))
    return df.join(settle(bounds), inside, "left_semi")


def trimmed_correlation(df: DataFrame, value: str, label: str, by: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(series, n_rows, correlation) on trimmed rows, for the whole frame ('all') and per ``by`` label.

    The rows are read once and counted by value; bounds and sums are taken from the counted values."""
    known = F.col(value).isNotNull() & F.col(label).isNotNull()
    counted = settle(df.where(F.col(value).isNotNull()).groupBy(F.col(by).cast("string").alias("_by"), F.col(value).cast("double").alias("x")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(known).alias("m"), F.sum(label).cast("double").alias("s"), F.sum(F.col(label) * F.col(label)).cast("double").alias("q")
    ))
    both = counted.select(F.explode(F.array(F.lit("all"), F.col("_by"))).alias("series"), "x", "n", "m", "s", "q").where("series IS NOT NULL")
    kept = quantile_trim(both, "x", low, high, "series", "n").groupBy("series").agg(
        F.sum("n").alias("n_rows"), F.sum("m").alias("m"), F.sum("s").alias("sy"), F.sum("q").alias("syy"),
        F.sum(F.col("m") * F.col("x")).alias("sx"), F.sum(F.col("m") * F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("s") * F.col("x")).alias("sxy"),
    )
    spread_x, spread_y = (F.col(f"s{c}{c}") - F.col(f"s{c}") * F.col(f"s{c}") / F.col("m") for c in "xy")
    common = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("m")
    return kept.select("series", "n_rows", F.try_divide(common, F.sqrt(spread_x * spread_y)).alias("correlation"))


def edge_bin(value: Column, edges: Sequence[float]) -> Column:
    """0-based bin of fixed edges: left-closed, the last one closed on both sides, null outside."""
    position = reduce(lambda a, b: a + b, [(value >= F.lit(float(e))).cast("int") for e in edges]) - 1
    last = len(edges) - 2
    return F.when(value == float(edges[-1]), last).when((position >= 0) & (position <= last), position)


def rate_histogram(df: DataFrame, value: str, label: str, by: str, edges: Sequence[float] = RATE_EDGES) -> DataFrame:
    """(by, bin, bin_left, n_total, n_accepted, acceptance_rate): every bin of every label, empty ones too."""
    binned = df.select(F.col(by), edge_bin(F.col(value), edges).alias("bin"), (F.col(label) == 1).alias("_hit"))
    counts = binned.groupBy(by, "bin").agg(F.count(F.lit(1)).alias("n"), F.count_if("_hit").alias("hits"))
    # the label's own bins: one array per label, so empty bins come back as zero without a second scan
    lists = counts.groupBy(by).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", F.struct("n", "hits"))))).alias("seen")
    )
    bins = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(float(e)).alias("bin_left")) for i, e in enumerate(edges[:-1])])
    rows = lists.select(by, "seen", F.explode(bins).alias("b")).select(
        by,
        "b.bin",
        "b.bin_left",
        F.coalesce(F.try_element_at("seen", F.col("b.bin"))["n"], F.lit(0)).alias("n_total"),
        F.coalesce(F.try_element_at("seen", F.col("b.bin"))["hits"], F.lit(0)).alias("n_accepted"),
    )
    return rows.withColumn("acceptance_rate", F.try_divide("n_accepted", "n_total"))


def auto_histograms(df: DataFrame, measures: Sequence[str], keys: Sequence[str], bins: int = 10) -> DataFrame:
    """(measure, keys…, lo, hi, bin, n): equal bins between the extremes of each measure and group. The rows are
    read once and counted by value."""
    cells = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("x")) for m in measures])
    group = ["measure", *keys]
    values = df.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.measure", "c.x").where("x IS NOT NULL")
    long = settle(values.groupBy(*group, "x").agg(F.count(F.lit(1)).alias("n")))
    spans = long.groupBy(*group).agg(F.min("x").alias("_lo"), F.max("x").alias("_hi")).select(
        *group,
        F.when(F.col("_lo") == F.col("_hi"), F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("lo"),
        F.when(F.col("_lo") == F.col("_hi"), F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("hi"),
    )
    place = F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    return (
        long.join(settle(spans), group)
        .groupBy(*group, "lo", "hi", F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.sum("n").alias("n"))
    )


def acceptance_percent(df: DataFrame, label: str = "outcome") -> DataFrame:
    return df.agg((F.avg(label) * 100).alias("acceptance_percent"))


def acceptance_by_tier(df: DataFrame, tier: str = "tier", label: str = "outcome") -> DataFrame:
    return df.groupBy(tier).agg(F.avg(label).alias("acceptance_rate"))


def tier_filter(df: DataFrame, tier: int, column: str = "tier") -> DataFrame:
    return df.where(F.col(column) == tier)


def spread(left: str, right: str) -> Column:
    return F.col(left) - F.col(right)


def standard_stats(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """{column: (mean, sample standard deviation)} from one aggregate (one row reaches the driver)."""
    row = df.agg(*[f(c).alias(f"{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in columns}


def standardize(df: DataFrame, stats: dict[str, tuple[float, float]], suffix: str = "_std") -> DataFrame:
    return df.withColumns({f"{c}{suffix}": (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in stats.items()})
