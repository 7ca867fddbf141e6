"""As-of joins: the last value known at a time, without a range join."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendlens.operators.ordered import sorted_blocks


def _all_known(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def last_known(questions: DataFrame, facts: DataFrame, on: Sequence[str], time: str, values: Sequence[str]) -> DataFrame:
    """(on…, time, __value) for every distinct question (on…, time): the values of the latest fact of its key at or before it,
    as a struct, null where there is none.

    Questions and facts form one stream, sorted by key and time over the whole table and carried forward inside each sorted block.
    A key of any size is cut into blocks of time; what a block hands on to the next is one row, so there
    are at most as many such rows as blocks. Of facts at the same time the one with the largest values wins, nulls last.
    """
    on = list(on)
    asked = questions.select(*on, time).where(_all_known([*on, time])).distinct()
    stream = asked.select(*on, time, F.lit(1).alias("__asks")).unionByName(
        facts.where(_all_known([*on, time])).select(*on, time, F.lit(0).alias("__asks"), F.struct(*values).alias("__fact")),
        allowMissingColumns=True,
    )
    blocks = sorted_blocks(stream, [F.col(c) for c in (*on, time, "__asks", "__fact")])
    run = Window.partitionBy(*on, "__block").orderBy("__pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = blocks.withColumn("__inner", F.last("__fact", ignorenulls=True).over(run))

    ends = blocks.groupBy(*on, "__block").agg(
        F.min("__pos").alias("__first"), F.max_by("__fact", F.when(F.col("__fact").isNotNull(), F.col("__pos"))).alias("__final")
    )
    goes_on = ends.where("__first = 0").select(*on).distinct()  # the first key of each block
    earlier = Window.partitionBy(*on).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.join(F.broadcast(goes_on), on).withColumn("__before", F.last("__final", ignorenulls=True).over(earlier))
    handed = handed.where("__first = 0 AND __before IS NOT NULL").select(*on, "__block", "__before")  # at most one row per block
    met = carried.where("__asks = 1").join(F.broadcast(handed), [*on, "__block"], "left")
    return met.select(*on, time, F.coalesce("__inner", "__before").alias("__value"))


def as_of_join(left: DataFrame, right: DataFrame, on: str | Sequence[str], left_time: str, right_time: str, values: Sequence[str]) -> DataFrame:
    """Every row of ``left`` with the ``values`` of the latest row of ``right`` of the same key whose ``right_time`` is not after
    ``left_time``; null values where there is none.

    Only distinct keys and times of the left side and the named values of the right side are sorted; the left rows meet
    the answers by an equi-join. A left row without key or time finds nothing, a right row without them is never known.
    """
    on = [on] if isinstance(on, str) else list(on)
    clash = [v for v in values if v in left.columns]
    if clash:
        raise ValueError(f"columns on both sides: {clash}")
    questions = left.select(*on, F.col(left_time).alias("__time"))
    facts = right.select(*on, F.col(right_time).cast(questions.schema["__time"].dataType).alias("__time"), *values)
    keys = {f"__k{i}": F.col(c) for i, c in enumerate(on)}
    answers = last_known(questions, facts, on, "__time", values).withColumns(keys).drop(*on)
    same = reduce(lambda a, b: a & b, [left[c] == answers[f"__k{i}"] for i, c in enumerate(on)]) & (left[left_time] == answers["__time"])
    return left.join(answers, same, "left").select(left["*"], *[answers["__value"][v].alias(v) for v in values])
