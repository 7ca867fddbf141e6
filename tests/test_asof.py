"""As-of joins against a plain search, with hot keys, ties and missing keys or times."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lendlens.operators.asof import as_of_join, last_known
from lendlens.plans import gold


def brute(left, right):
    out = Counter()
    for key, t, tag in left:
        known = [r for r in right if None not in (key, t, r[0], r[1]) and r[0] == key and r[1] <= t]
        best = max(known, key=lambda r: (r[1], r[2] is not None, r[2] or 0, r[3] is not None, r[3] or ""), default=(None,) * 4)
        out[(key, t, tag, best[2], best[3])] += 1
    return out


def frames(spark, left, right, parts=6):
    a = spark.createDataFrame(left, "key string, at int, tag int").repartition(parts)
    b = spark.createDataFrame(right, "key string, seen int, v int, w string").repartition(parts)
    return a, b


@pytest.mark.parametrize("seed", range(3))
def test_random(spark, seed):
    rng = random.Random(seed)
    keys = ["a", "b", "c", None]
    left = [(rng.choice(keys), rng.choice([None, *range(30)]), i % 7) for i in range(200)]
    right = [(rng.choice(keys), rng.choice([None, *range(30)]), rng.choice([None, 1, 2, 3]), rng.choice([None, "x", "y"])) for _ in range(120)]
    a, b = frames(spark, left, right)
    got = as_of_join(a, b, "key", "at", "seen", ["v", "w"])
    assert got.columns == ["key", "at", "tag", "v", "w"]
    assert Counter(map(tuple, got.collect())) == brute(left, right)


@pytest.fixture
def uncoalesced(spark):
    """Small sort partitions stay apart, as large ones would."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_hot_key_spreads_and_hands_on(spark, uncoalesced):
    # one fact at the very start, far more questions than a block holds, and keys before and behind it
    left = [("hot", t, 0) for t in range(4000)] + [("a", 5, 0), ("z", 5, 0)]
    right = [("hot", -1, 7, "first"), ("hot", 3990, 8, "late"), ("a", 9, 1, "too late")]
    a, b = frames(spark, left, right)
    got = as_of_join(a, b, ["key"], "at", "seen", ["v", "w"])
    assert Counter(map(tuple, got.collect())) == brute(left, right)
    answers = last_known(a.withColumnRenamed("at", "t"), b.withColumnRenamed("seen", "t"), ["key"], "t", ["v", "w"])
    plan = answers._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoop" not in plan and "Cartesian" not in plan
    # the windows run inside blocks: the hot key's questions lie in several of them
    blocks = last_known_blocks(a, b)
    assert blocks.where("key = 'hot'").select("__block").distinct().count() > 2


def last_known_blocks(a, b):
    from lendlens.operators.ordered import sorted_blocks

    stream = a.select("key", F.col("at").alias("t")).union(b.select("key", F.col("seen")))
    return sorted_blocks(stream, [F.col("key"), F.col("t")])


def test_empty_sides_several_keys_and_clashes(spark):
    a, b = frames(spark, [("a", 1, 0)], [("a", 1, 5, "x")])
    assert [tuple(r) for r in as_of_join(a, b.limit(0), "key", "at", "seen", ["v"]).collect()] == [("a", 1, 0, None)]
    assert as_of_join(a.limit(0), b, "key", "at", "seen", ["v"]).count() == 0
    a2, b2 = a.withColumn("k2", F.lit(1)), b.withColumn("k2", F.lit(2))
    assert as_of_join(a2, b2, ["key", "k2"], "at", "seen", ["v"]).first()["v"] is None
    assert as_of_join(a2, b2.withColumn("k2", F.lit(1)), ["key", "k2"], "at", "seen", ["v"]).first()["v"] == 5
    with pytest.raises(ValueError):
        as_of_join(a.withColumn("v", F.lit(1)), b, "key", "at", "seen", ["v"])


def test_gold_as_of_uses_nothing_later(spark, layers):
    """A later curve and a later snapshot change the latest features, but not those known at the decision."""
    _, silver, _ = layers
    later = "TIMESTAMP_NTZ '2190-01-01 00:00:00'"
    curves = silver["silver_ftp_rates"]
    moved = curves.unionByName(curves.withColumns({"ftp_curve_date": F.expr(later), "ftp_bps": F.col("ftp_bps") + 500}))
    closed = silver["silver_deals"].where("decision_date IS NOT NULL").select("deal_id").distinct()

    def rates(ftp, as_of):
        return gold.facility_economics({**silver, "silver_ftp_rates": ftp}, as_of).join(closed, "deal_id").agg(F.sum("ftp_bps"), F.count("*")).first()

    assert rates(moved, True) == rates(curves, True)
    assert rates(moved, False)[0] > rates(curves, False)[0]


def test_as_of_lookups_read_narrow_rows(layers, monkeypatch):
    """Facilities and deals find what was known at the decision before quotes, risk and totals are joined to them."""
    seen, own = [], gold.as_of_join
    monkeypatch.setattr(gold, "as_of_join", lambda left, *rest: seen.append(set(left.columns)) or own(left, *rest))
    _, silver, marts = layers
    economics = gold.facility_economics(silver, as_of=True)
    features = gold.deal_features(silver, economics, marts["gold_deal_economics"], as_of=True)
    assert len(seen) == 2 and not seen[0] & {"offered_margin_bps", "expected_loss"} and not seen[1] & {"total_commitment", "rating_at_offer", "industry"}
    assert economics.count() == marts["gold_facility_economics"].count()
    assert features.count() == gold.deal_features(silver, economics, marts["gold_deal_economics"]).count() > 0
