"""Exact global order statistics without a single-partition window.

Every operator here first collapses its input to one row per distinct value (hash
aggregation combines on the map side, so a value that holds a third of all rows
becomes one counted row), sorts those rows with a range exchange, and turns running
totals inside each sorted block into global ones by adding the totals of the blocks
before it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendlens.operators.dedupe import top_row
from lendlens.session import settle

_BLOCK_BITS = 33  # monotonically_increasing_id keeps the partition above, the row below


def sorted_blocks(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Globally sorted rows, settled, with the number of their block (``__block``) and their position in it (``__pos``, from 0)."""
    ids = settle(df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()))
    return ids.select(
        *df.columns,
        F.shiftright("__id", _BLOCK_BITS).cast("int").alias("__block"),
        F.col("__id").bitwiseAND(F.lit((1 << _BLOCK_BITS) - 1)).alias("__pos"),
    )


def prefix_counts(df: DataFrame, value: str, series: str | None = None, sums: dict[str, Column] | None = None, weight: str | None = None) -> DataFrame:
    """Per distinct value: ``n`` rows and the requested sums, plus each of them summed over all
    smaller values of the same series (``n_before``, ``<name>_before``) and over the whole series
    (``n_total``, ``<name>_total``). Null values are left out.

    ``series`` may have any number of labels; ``sums`` must be integer expressions. ``weight`` names a column that
    says how many rows a row stands for.
    """
    sums = sums or {}
    keys = ([series] if series else []) + [value]
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys)
        .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"), *[F.sum(c).cast("bigint").alias(k) for k, c in sums.items()])
    )
    measures = ["n", *sums]
    blocks = sorted_blocks(counted, [F.col(k) for k in keys])
    block_keys = ([series] if series else []) + ["__block"]
    totals = blocks.groupBy(*block_keys).agg(*[F.sum(m).cast("bigint").alias(m) for m in measures])
    # one row per sorted block of a series, so a window task holds as many rows as there are sort partitions
    of_series = Window.partitionBy(F.col(series) if series else F.col("__block") * 0)
    earlier = of_series.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    table = totals.select(
        *[F.col(k).alias(f"__t{k}") for k in block_keys],
        *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"__off_{m}") for m in measures],
        *[F.sum(m).over(of_series).alias(f"{m}_total") for m in measures],
    )
    w = Window.partitionBy(*block_keys).orderBy("__pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = blocks.select("*", *[(F.sum(m).over(w) - F.col(m)).alias(f"__in_{m}") for m in measures])
    same_block = running["__block"] == table["__t__block"]
    if series:
        same_block = same_block & running[series].eqNullSafe(table[f"__t{series}"])
    return running.join(table, same_block).select(
        *[running[k] for k in keys],
        *measures,
        *[(F.col(f"__in_{m}") + F.col(f"__off_{m}")).alias(f"{m}_before") for m in measures],
        *[f"{m}_total" for m in measures],
    )


def as_doubles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns}) if columns else df


def _long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(series, value) rows of several numeric columns in one pass over ``df``."""
    pairs = F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).select("p.series", "p.value").where("value IS NOT NULL")


def rank_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(series, value, pct): average rank of each distinct value divided by the non-null count."""
    counts = prefix_counts(_long(df, columns), "value", "series")
    average_rank = (2 * F.col("n_before") + F.col("n") + 1) / 2
    return counts.select("series", "value", (average_rank / F.col("n_total")).alias("pct"))


def percent_rank_columns(
    df: DataFrame, ranks: dict[str, str], among: DataFrame | None = None, keys: Sequence[str] | None = None
) -> DataFrame:
    """Adds ``output`` = percent rank (average ties, null for null) of ``column`` for each
    ``{output: column}``, among the rows of ``df`` or of a larger frame that holds them.

    Only narrow (row, series, value) rows meet the rank table, all columns in one join; the ranks of a row are
    gathered by one aggregate and joined back, so the wide rows are shuffled once for any number of
    ranks. A hot value is split at run time. ``keys`` that name a row tell rows apart, and only they and the ranked columns are
    written; without them all columns are written once to give each row a number.
    """
    columns = list(dict.fromkeys(ranks.values()))
    names = {f"__key{i}": k for i, k in enumerate(keys or [])} or {"__row": "__row"}
    rows = settle(df.select(*keys, *[c for c in columns if c not in keys])) if keys else settle(df.withColumn("__row", F.monotonically_increasing_id()))
    cells = F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).cast("double").alias("value")) for c in columns])
    narrow = rows.select(*[F.col(k).alias(n) for n, k in names.items()], F.explode(cells).alias("c")).select(*names, "c.series", "c.value").where("value IS NOT NULL")
    found = narrow.join(rank_table(rows if among is None else among, columns), ["series", "value"]).groupBy(*names).agg(
        *[F.max(F.when(F.col("series") == column, F.col("pct"))).alias(output) for output, column in ranks.items()]
    )
    wide = df if keys else rows
    same = reduce(lambda a, b: a & b, [wide[k].eqNullSafe(found[n]) for n, k in names.items()])
    return wide.join(found, same, "left").select(*[wide[c] for c in df.columns], *ranks)


def column_modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(series, mode_value): most frequent value of each column as text, the smallest on ties.

    Values are counted by hash aggregation before one row per column is picked, so no task
    holds the distinct values of a column.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).cast("string").alias("mode_value")) for c in columns])
    counts = (
        df.select(F.explode(cells).alias("c"))
        .select("c.*")
        .where("mode_value IS NOT NULL")
        .groupBy("series", "mode_value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return top_row(counts, ["series"], [F.col("n").desc(), F.col("mode_value").asc()]).select("series", "mode_value")


def row_numbers(df: DataFrame, order: Sequence[Column], output: str = "row_number", total: str | None = None) -> DataFrame:
    """Adds the global position 1..n in ``order``, which must end in a unique key, and on request n itself.

    The range exchange cuts inside ties of the leading column, so equal leading values spread out.
    """
    blocks = sorted_blocks(df, order)
    before, offsets = 0, []
    # one row per sort partition
    for row in blocks.groupBy("__block").agg(F.count(F.lit(1)).alias("n")).orderBy("__block").collect():
        offsets.append((row["__block"], before))
        before += row["n"]
    n = before
    table = df.sparkSession.createDataFrame(offsets, "__block int, __off bigint")
    return blocks.join(F.broadcast(table), "__block").select(
        *df.columns,
        (F.col("__off") + F.col("__pos") + 1).alias(output),
        *([F.lit(n).cast("bigint").alias(total)] if total else []),
    )


_DIGIT = 16  # bits of an ordered number that one round of the selection settles


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used: a plain expression is copied at each use."""
    return F.element_at(F.transform(F.array(value), use), 1)


def ordered_bits(value: Column) -> Column:
    """A bigint that orders as the double does, infinities and, above them, NaN included; 0.0 and -0.0 are 0.

    The magnitude is the bit pattern of the IEEE double: its exponent, found by a logarithm and put right by exact powers of two, and the
    52 bits behind it. All steps are exact, so ``double_of`` gives the value back.
    """
    power, infinite = F.lit(2.0), F.lit(2047 << 52)

    def of_finite(size: Column) -> Column:
        def put_right(near: Column) -> Column:
            return F.greatest(near + F.when(size >= F.pow(power, near + 1), 1).when(size < F.pow(power, near), -1).otherwise(0), F.lit(-1022))

        def pattern(exponent: Column) -> Column:
            # two halves, because the inverse of the largest power is no normal number
            share = size * F.pow(power, -F.floor(exponent / 2)) * F.pow(power, F.floor(exponent / 2) - exponent)
            return (exponent + 1022).cast("bigint") * F.lit(1 << 52) + (share * F.lit(float(1 << 52))).cast("bigint")

        near = F.greatest(F.floor(F.log2(size)), F.lit(-1022)).cast("int")
        return _let(near, lambda n: _let(put_right(n), pattern))

    def of_size(size: Column) -> Column:
        # NaN is larger than infinity
        return F.when(F.isnan(size), infinite + 1).when(size == F.lit(float("inf")), infinite).when(size == 0, 0).otherwise(of_finite(size))

    return _let(value, lambda v: _let(_let(F.abs(v), of_size), lambda bits: F.when(v < 0, -bits).otherwise(bits).cast("bigint")))


def double_of(bits: Column) -> Column:
    """The double whose ``ordered_bits`` these are."""
    size = F.abs(bits)
    exponent = F.greatest(F.shiftright(size, 52), F.lit(1))
    share = (size - (exponent - 1) * F.lit(1 << 52)) / F.lit(float(1 << 52))
    value = share * F.pow(F.lit(2.0), (exponent - 1023).cast("double"))
    value = F.when(size > F.lit(2047 << 52), F.lit(float("nan"))).when(size == F.lit(2047 << 52), F.lit(float("inf"))).otherwise(value)
    return F.when(bits < 0, -value).otherwise(value)


def _selected(data: DataFrame, series: str, ranks: DataFrame) -> DataFrame:
    """(series, rank, value): the order statistics of (series, bits, weight) rows at the 0-based ranks (series, rank).

    Radix selection. Each round counts the next ``_DIGIT`` bits of the rows that still share their leading bits with a wanted rank: at
    most 2^16 counted rows per series and rank, combined on the map side. Running counts name the
    digit of every rank, and only its rows are read on. No row is sorted, and no task holds the rows of a series.
    """
    rounds = 64 // _DIGIT
    wanted = ranks.withColumns({"lead": F.lit(0).cast("bigint"), "rest": F.col("rank")})
    for r in range(rounds):
        wanted = settle(wanted)
        shift = 64 - _DIGIT * (r + 1)
        digit = F.shiftright("bits", shift) if r == 0 else F.shiftright("bits", shift).bitwiseAND(F.lit((1 << _DIGIT) - 1))
        lead = F.lit(0).cast("bigint") if r == 0 else F.shiftright("bits", shift + _DIGIT)
        rows = data.select("series", lead.alias("lead"), digit.alias("digit"), "weight")
        if r:
            rows = rows.join(wanted.select("series", "lead").distinct(), ["series", "lead"], "left_semi")
        counted = rows.groupBy("series", "lead", "digit").agg(F.sum("weight").alias("n"))
        order = Window.partitionBy("series", "lead").orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        bands = counted.withColumn("until", F.sum("n").over(order)).withColumn("before", F.col("until") - F.col("n"))
        found = bands.join(wanted, ["series", "lead"]).where("before <= rest AND rest < until")
        step = F.col("digit") if r == 0 else F.col("lead") * F.lit(1 << _DIGIT) + F.col("digit")
        wanted = found.select("series", "rank", step.alias("lead"), (F.col("rest") - F.col("before")).alias("rest"))
    return wanted.select("series", "rank", double_of(F.col("lead")).alias("value"))


def quantiles(df: DataFrame, value: str, probs: Sequence[float], series: str | None = None, weight: str | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles: one row per series with columns ``q0``, ``q1``, …

    The two order statistics around each quantile are found by radix selection: the values are written once as narrow
    rows and counted in four rounds, all series and quantiles together. Rows without series are left out.
    """
    known = df.where(F.col(value).isNotNull() & F.col(series).isNotNull()) if series else df.where(F.col(value).isNotNull())
    data = settle(known.select(
        (F.col(series) if series else F.lit(0)).alias("series"), ordered_bits(F.col(value).cast("double")).alias("bits"),
        (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("weight"),
    ))
    totals = settle(data.groupBy("series").agg(F.sum("weight").alias("n_values")))
    places = [(F.col("n_values") - 1) * F.lit(float(p)) for p in probs]
    ends = F.array_distinct(F.array(*[f(p) for p in places for f in (F.floor, F.ceil)]))
    stats = _selected(data, "series", totals.select("series", F.explode(ends).alias("rank")))
    held = stats.groupBy("series").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))
    out = []
    for i, p in enumerate(places):
        low, high = F.try_element_at("at", F.floor(p)), F.try_element_at("at", F.ceil(p))
        out.append((low + (high - low) * (p - F.floor(p))).alias(f"q{i}"))
    return totals.join(held, "series").select(F.col("series").alias(series or "series"), "n_values", *out)


_MARGIN = 0.005  # share of the rows on either side of a quantile that its bracket is to hold


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Exact quantiles of several columns: one row per column name.

    Sketches of all columns, from one aggregate, bracket each quantile, a second aggregate counts the values below and inside each
    bracket, and the order statistics are selected among the values inside, one counted row per distinct value. Counts that do not hold
    the wanted rank, as in tables of few rows, show that a bracket is off; then all values are read on. Per column and quantile
    a few numbers reach the driver.
    """
    columns = list(dict.fromkeys(columns))
    rows = settle(as_doubles(df.select(*columns), columns))
    cells = [(c, float(p)) for c in columns for p in probs]
    if not cells:
        return quantiles(_long(rows, columns), "value", probs, "series")
    edges = [F.percentile_approx(c, [max(p - _MARGIN, 0.0), min(p + _MARGIN, 1.0)], 10_000) for c, p in cells]
    ends = rows.agg(*[e.alias(f"e{i}") for i, e in enumerate(edges)], *[F.count(c).alias(f"n{j}") for j, c in enumerate(columns)]).first()
    n_values = {c: ends[f"n{j}"] for j, c in enumerate(columns)}
    brackets = {i: ends[f"e{i}"] for i, (c, _) in enumerate(cells) if n_values[c]}
    if not brackets:
        return quantiles(_long(rows, columns), "value", probs, "series")
    inside = {i: F.col(cells[i][0]).between(F.lit(low), F.lit(high)) for i, (low, high) in brackets.items()}
    below = {i: F.col(cells[i][0]) < F.lit(low) for i, (low, _) in brackets.items()}
    counts = rows.agg(*[F.count_if(x).alias(f"{side}{i}") for side, found in (("b", below), ("i", inside)) for i, x in found.items()]).first()
    places = {i: (n_values[cells[i][0]] - 1) * cells[i][1] for i in brackets}
    wanted = [(i, rank - counts[f"b{i}"]) for i, x in places.items() for rank in sorted({math.floor(x), math.ceil(x)})]
    if not all(0 <= rank < counts[f"i{i}"] for i, rank in wanted):
        return quantiles(_long(rows, columns), "value", probs, "series")
    held = F.array(*[F.when(x, F.struct(F.lit(i).alias("series"), F.col(cells[i][0]).alias("value"))) for i, x in inside.items()])
    kept = rows.select(F.explode(F.filter(held, lambda x: x.isNotNull())).alias("c")).groupBy("c.series", "c.value").agg(F.count(F.lit(1)).alias("weight"))
    data = settle(kept.select("series", ordered_bits(F.col("value")).alias("bits"), "weight"))
    spark = df.sparkSession
    stats = {(r["series"], r["rank"]): r["value"] for r in _selected(data, "series", spark.createDataFrame(wanted, "series int, rank bigint")).collect()}

    def at(i: int) -> float:
        x = places[i]
        low, high = (stats[i, f(x) - counts[f"b{i}"]] for f in (math.floor, math.ceil))
        return low + (high - low) * (x - math.floor(x))

    of_cell = {cell: i for i, cell in enumerate(cells)}
    table = [(c, n_values[c], *[at(of_cell[c, float(p)]) for p in probs]) for c in columns if n_values[c]]
    return spark.createDataFrame(table, "series string, n_values bigint, " + ", ".join(f"q{i} double" for i in range(len(probs))))


def decile(row_number: Column, n: Column | int, parts: int = 10) -> Column:
    """Linear-quantile part of position ``row_number`` in 1..n (part 1 = first positions).

    A part ends at the interpolated quantile of the positions; the edges are computed the way
    NumPy interpolates them, so positions that meet an edge exactly fall to the same part.
    """
    last = (F.lit(n) if isinstance(n, int) else n) - 1
    part = F.lit(1)
    for q in (np.linspace(0.0, 1.0, parts + 1) * 100 / 100)[1:-1]:
        place = last * F.lit(float(q))
        low = F.floor(place)
        rest = place - low
        edge = F.when(rest < 0.5, low + 1 + rest).otherwise(low + 2 - (1 - rest))
        part = part + (row_number > edge).cast("int")
    return part
