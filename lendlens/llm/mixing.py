"""Mixing sources to target weights by systematic sampling, on DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendlens.llm.common import same
from lendlens.operators.ordered import prefix_counts, row_numbers
from lendlens.session import settle

WORD = r"[^\x20\x09-\x0D]+"
_BITS = 33  # monotonically_increasing_id keeps the partition above, the row below


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """Adds ``target`` to (source, source_size, n) rows.

    Sources in code point order, null last, take the weights in turn and share ``share`` times all
    sizes. A target stops at ``most`` times its source's size; the excess is shared again by
    weight. That is one level L with target = min(weight * L, cap): with sources ordered by cap / weight,
    L follows from the running caps and weights at the first source that stays below its cap.
    """
    ranked = settle(
        row_numbers(totals, [F.col("source").asc_nulls_last()], "_rank")
        .withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), F.pmod(F.col("_rank") - 1, F.lit(len(weights))).cast("int") + 1))
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("_ratio", F.col("cap") / F.col("weight"))
    )
    steps = prefix_counts(ranked, "_ratio", sums={"sizes": F.col("source_size"), "weights": F.col("weight")})
    level = (F.col("sizes_total") * F.lit(float(share)) - F.col("sizes_before") * F.lit(float(most))) / (F.col("weights_total") - F.col("weights_before"))
    found = steps.withColumn("level", level).where("level <= _ratio").agg(F.min_by("level", "_ratio").alias("level")).collect()[0]["level"]
    target = F.col("cap") if found is None else F.least(F.col("weight") * F.lit(found), F.col("cap"))
    return ranked.select("source", "source_size", "n", target.cast("double").alias("target"))


def offset(source: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the source and the seed."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("")))), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)


def mix(
    df: DataFrame, size: Column | None = None, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17,
) -> DataFrame:
    """One narrow row per row of ``df`` (doc_id, text, source): ``doc_id``, ``source``, ``size``,
    ``source_size``, ``target`` and ``copies``, how often the mix takes it.

    Within a source every row expects target / source_size copies. Rows are ordered by size and id,
    expectations summed up from a random start, and a row is taken once for every integer that its
    part of the sum crosses: as neighbours have like sizes, the taken words come near the target.

    The running sums don't need a source in one task: narrow rows are sorted by a range exchange
    on (source, size, id), written once, and numbered by their place in the sorted block plus the
    source's rows in the blocks before. The decision depends on the rows and the seed alone.
    Null texts are empty and null sources one source, last in order; a source without words has
    target 0 and is never taken. Rows equal in id, source and size may swap decisions. An empty
    table gives an empty result; other columns are not read.
    """
    narrow = df.select("doc_id", "source", (word_count(F.col("text")) if size is None else size).alias("size"))
    narrow = settle(narrow)  # the sort reads its input twice
    ids = settle(narrow.orderBy(F.col("source").asc_nulls_last(), "size", "doc_id").withColumn("_id", F.monotonically_increasing_id()))
    rows = ids.withColumn("_block", F.shiftright("_id", _BITS))
    blocks = settle(rows.groupBy("source", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"), F.sum("size").alias("_sizes")))
    totals = blocks.groupBy("source").agg(F.sum("_sizes").alias("source_size"), F.sum("_rows").alias("n"))
    targets = source_targets(totals, weights, share, most)
    earlier = Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # one row per source and sorted block
    starts = blocks.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    starts = starts.join(targets, same(starts, targets, "source")).select(
        starts["source"].alias("_source"), starts["_block"].alias("_b"), "_first", "_before", "source_size", "target"
    )
    placed = rows.join(starts, (rows["_block"] == starts["_b"]) & rows["source"].eqNullSafe(starts["_source"]))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    place = F.col("_before") + F.col("_id") - F.col("_first")
    start = offset(F.col("source"), seed)
    copies = F.floor((place + 1) * rate + start) - F.floor(place * rate + start)
    return placed.select("doc_id", "source", "size", "source_size", "target", copies.cast("int").alias("copies"))


def take_copies(df: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``df`` as often as ``mix`` takes it, with its columns unchanged.

    Decisions meet the rows by (doc_id, source, size); rows equal in all three are told apart by a
    number, so that repeated ids multiply nothing.
    """
    wide = df.withColumn("__size", word_count(F.col("text")))
    chosen = mix(df, **options)
    key = ["doc_id", "source", "__size"]
    chosen = chosen.withColumnRenamed("size", "__size").select(*key, "copies")
    chosen = chosen.withColumn("__twin", F.row_number().over(Window.partitionBy(*key).orderBy("copies"))).where("copies > 0")
    wide = wide.withColumn("__twin", F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("text"))))
    taken = wide.join(chosen, same(wide, chosen, *key, "__twin"))
    return taken.select(*[wide[c] for c in df.columns], F.explode(F.array_repeat(F.lit(1), chosen["copies"]))).select(*df.columns)
