"""Column rules: literal fixtures and every dirty spelling."""

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lendlens.functions import economics as E
from lendlens.functions import standardize as S
from lendlens.functions import text as X


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def apply(spark, values, rule, kind="string"):
    rows = column(spark, values, kind).select("i", rule(F.col("v")).alias("out")).orderBy("i").collect()
    return [r.out for r in rows]


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()[0]


def test_ids(spark):
    raw = ["CRM000001", "CRM1234567", "abc", None, "000", "a1b2"]
    assert apply(spark, raw, S.customer_id) == ["CUST000001", "CUST1234567", "CUST-abc", None, "CUST000000", "CUST000012"]
    assert apply(spark, ["OPP12"], S.deal_id) == ["DEAL0000012"]
    assert apply(spark, ["FS123456789"], S.facility_id) == ["FAC123456789"]


def test_labels(spark):
    assert apply(spark, [" LC", "mm\t", "Big Sponsor", "mid-cap o'neil", None], S.segment) == [
        "Large Corporate", "Mid Market", "Financial Sponsor", "Mid-Cap O'Neil", None]
    assert apply(spark, ["€", " eur ", "usd", None], S.currency) == ["EUR", "EUR", "USD", None]
    assert apply(spark, ["closed WON", " Withdrawn ", "Closed", None], S.deal_status) == ["closed_won", "withdrawn", "active", "active"]
    assert apply(spark, ["closed WON", "Closed Lost ", "Withdrawn", None], S.deal_outcome) == ["won", "lost", None, None]
    assert apply(spark, ["Baa2", " a2", "ccc", None], S.rating) == ["BBB", "A", "CCC", None]
    assert apply(spark, ["Revolving line", "Term loan guarantee", "Guarantor", "Trade", " Leasing ", None], S.product) == [
        "RCF", "Term Loan", "Guarantee", "Trade Finance", "Leasing", None]


def test_lost_reasons_keep_first_match(spark):
    raw = ["Too expensive", "Pricing", "Price alternative", "Client chose alternative funding", "Credit declined", "Structure not accepted",
           "Project cancelled", "No longer needed", "Bad luck", None]
    assert apply(spark, raw, S.lost_reason) == ["price", "pricing", "price", "alternative_funding", "credit_declined", "structure",
                                                "project_cancelled", "no_longer_needed", "bad_luck", None]


@pytest.mark.parametrize("reason,outcome,status,expected", [
    ("credit_declined", None, "active", True), ("credit_declined", "won", "closed_won", True), ("price", "lost", "closed_lost", True),
    ("credit_declined", "lost", "closed_lost", False), ("pricing", "lost", "closed_lost", True), (None, "lost", "closed_lost", True),
    ("no_longer_needed", None, "withdrawn", False), (None, None, "withdrawn", True)])
def test_commercial_relevance(spark, reason, outcome, status, expected):
    df = spark.createDataFrame([(reason, outcome, status)], "r string, o string, s string")
    assert df.select(S.commercial_relevance("r", "o", "s")).first()[0] is expected


def test_utilisation_texts(spark):
    raw = ["45%", "150%", " 0.45 ", "-0.2", "n/a", "NA", "", "none", "nan", "abc", "abc%", None, "1.5d", "inf"]
    got = apply(spark, raw, lambda c: S.utilisation(c, F.lit("RCF")))
    assert got == [0.45, 1.0, 0.45, 0.0, 0.45, 0.45, 0.45, 0.45, 0.45, 0.45, 0.45, 0.45, 0.45, 1.0]
    products = ["RCF", "Term Loan", "Guarantee", "Trade Finance", "Overdraft", "Leasing", None]
    assert apply(spark, products, lambda c: S.utilisation(F.lit("n/a"), c)) == [0.45, 1.0, 0.20, 0.25, 0.35, 0.50, 0.50]


def test_numbers_and_dates(spark):
    assert apply(spark, ["0.81%", "38%", "1e-3", "x", "nan", None], X.number_or_percent) == [pytest.approx(0.0081), 0.38, 0.001, None, None, None]
    assert apply(spark, [float("nan"), 1.5, None], X.clean_double, "double") == [None, 1.5, None]
    got = apply(spark, ["2024-01-31", "no date", None], X.clean_timestamp)
    assert [str(v) if v else None for v in got] == ["2024-01-31 00:00:00", None, None]
    assert apply(spark, [-1.0, 0.4, 2.0, None], X.clamp01, "double") == [0.0, 0.4, 1.0, None]
    assert apply(spark, ["active", "ACTIVE ", None], S.is_active_customer) == [True, False, False]


def test_flags_read_missing_as_false(spark):
    assert apply(spark, [True, False, None], S.flag, "boolean") == [True, False, False]


def test_tenor_buckets(spark):
    raw = [0, 6, 18, 30, 48, 72, 100, None]
    assert apply(spark, raw, E.tenor_bucket, "int") == [12, 12, 12, 24, 36, 60, 84, 36]


def test_margin_and_profit_literals(spark):
    assert one(spark, E.risk_adjusted_margin_bps(*[F.lit(float(v)) for v in (200, 20, 50, 10, 25, 5, 30)])) == 100
    assert one(spark, E.facility_profit(F.lit(100.0), F.lit(1e6), F.lit(2.0))) == pytest.approx(20_000)
    assert one(spark, E.expected_deal_value(F.lit(0.4), F.lit(25_000.0))) == pytest.approx(10_000)


def test_probability_outside_range(spark):
    df = spark.createDataFrame([(1.5, 10.0)], "p double, v double")
    with pytest.raises(PySparkException):
        df.select(E.expected_deal_value("p", "v")).collect()
    assert df.select(E.expected_deal_value("p", "v", strict=False)).first()[0] is None


@pytest.mark.parametrize("above_floor,zone", [(-0.5, "Red"), (0, "Guardrail"), (10, "Guardrail"), (10.5, "Guardrail"), (59.5, "Guardrail"), (60, "Recommended"), (74.5, "Recommended"), (75, "Stretch")])
def test_zone_edges(spark, above_floor, zone):
    """Floor 80 with the usual buffer of 10, target 140, stretch 155; a negative margin after cost is red wherever it lies."""
    offered, edges = F.lit(80.0 + above_floor), [F.lit(v) for v in (80.0, 140.0, 155.0)]
    assert one(spark, E.pricing_zone(offered, *edges, F.lit(0.0))) == zone
    assert one(spark, E.pricing_zone(offered, *edges, F.lit(-0.01))) == "Red"


def test_zone_with_missing_margin_is_guardrail(spark):
    missing = F.lit(None).cast("double")
    assert one(spark, E.pricing_zone(missing, F.lit(100.0), F.lit(140.0), F.lit(220.0), missing)) == "Guardrail"


def test_fees_per_product(spark):
    rows = [("RCF", 2.0), ("Guarantee", 2.0), ("Term Loan", 0.0), ("Term Loan", 0.1), ("Term Loan", None)]
    df = spark.createDataFrame(rows, "p string, y double")
    fee = E.annualized_fee_bps("p", "y", F.lit(20.0), F.lit(10.0), F.lit(40.0), F.lit(8.0), F.lit(0.5))
    assert [r[0] for r in df.select(fee).collect()] == [15 + 20 + 4, 15 + 8, 30, 120, None]


def test_capital_cost_fallbacks(spark):
    rows = [(50.0, 100.0, 10.0), (None, None, 10.0), (None, None, None), (500.0, 0.0, 100.0), (50.0, None, None)]
    df = spark.createDataFrame(rows, "r double, e double, v double")
    assert [r[0] for r in df.select(E.capital_cost_bps("r", "e", "v")).collect()] == [9.0, 8.0, 13.5, 35.0, 13.5]


def test_worst_zone_orders_by_severity(spark):
    df = spark.createDataFrame([(1, "Stretch"), (1, "Recommended"), (2, "Red"), (2, "Stretch"), (3, "Odd")], "k int, z string")
    got = dict(df.groupBy("k").agg(E.worst_zone("z").alias("z")).collect())
    assert got == {1: "Recommended", 2: "Red", 3: "Odd"}
    known = df.where("k < 3").groupBy("k").agg(E.worst_known_zone("z").alias("z")).collect()
    assert dict(known) == {1: "Recommended", 2: "Red"}


def test_fixed_bins_are_right_closed(spark):
    got = apply(spark, [0.0, 12.0, 12.5, 36.0, 120.0, 121.0, None], lambda c: E.cut(c, [0, 12, 36, 120], ["short", "medium", "long"]), "double")
    assert got == [None, "short", "medium", "medium", "long", None, None]


def test_unknown_label_fails(spark):
    assert apply(spark, ["Won", "lost", None], E.win_label) == [1, 0, None]
    with pytest.raises(PySparkException):
        apply(spark, ["pending"], E.win_label)


def test_action(spark):
    rows = [("Red", 0.9), ("Guardrail", 0.9), ("Stretch", 0.71), ("Stretch", 0.7), ("Recommended", None)]
    df = spark.createDataFrame(rows, "z string, s double")
    got = [r[0] for r in df.select(E.recommended_action("z", "s")).collect()]
    assert got == [E.ACTION_RED, E.ACTION_GUARDRAIL, E.ACTION_STRONG, E.ACTION_OTHER, E.ACTION_OTHER]


def test_titles_match_python(spark):
    words = ["mid-cap o'neil", "REAL estate", "x9y z", "a_b.c"]
    assert apply(spark, words, X.title_case) == [w.title() for w in words]
    assert pd.Series(words).str.title().tolist() == [w.title() for w in words]


@pytest.mark.parametrize("text", ["société générale", "ÉCHÉANCES égales", "öl und gas", "o'neil & söhne", "3rd party 2go", "a-b c_d", "ÀÉÎ õü", "x1y2z", "", " zwei  worte "])
def test_title_case_is_that_of_plain_text(spark, text):
    assert one(spark, X.title_case(F.lit(text))) == text.title()
