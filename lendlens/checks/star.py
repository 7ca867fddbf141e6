"""The extracts that the checks run on: projections of a sales star schema onto the columns that the Silver
rules, the drivers and the loan analysis read.

Values come from the star's own columns where it has a fitting one. Raw labels, which it has not, are dealt
from lists chosen here so that every branch of a rule is met, accents, blanks and odd cases included. Each extract is
one SQL text that Spark and the comparison engine both run.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Dialect:
    """The few spellings in which the engines differ."""

    timestamp: str
    repeat: str

    def date(self, text: str) -> str:
        return f"CAST('{text} 00:00:00' AS {self.timestamp})"

    def times(self, last: str, name: str) -> str:
        """Repeats a row for name = 1 .. last."""
        return self.repeat.format(last=last, name=name)


SPARK = Dialect("TIMESTAMP_NTZ", "LATERAL VIEW explode(sequence(1, {last})) counted AS {name}")
ANSI = Dialect("TIMESTAMP", "CROSS JOIN LATERAL (SELECT unnest(range(1, {last} + 1)) AS {name}) counted")


def label(number: str, *values: str | None) -> str:
    """One of the values by ``number`` modulo their count."""
    arms = (f"WHEN {i} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'") for i, v in enumerate(values))
    return f"CASE ({number}) % {len(values)} {' '.join(arms)} END"


def text(x: str) -> str:
    return f"CAST({x} AS STRING)"


def two(x: str) -> str:
    """A number below 100 with two digits."""
    return f"lpad({text(x)}, 2, '0')"


def real(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def day(x: str) -> str:
    return f"({x}) * INTERVAL '1' DAY"


def whole(x: str) -> str:
    return f"CAST(round({x}) AS INT)"


def _accounts(d: Dialect) -> str:
    def version(region: str, extracted: str, status: str, where: str) -> str:
        return f"""
    SELECT concat('AC-', {text('c_custkey')}) AS crm_account_id,
      {label('c_custkey', 'LC', ' large corp', 'Large Corporate', 'mm ', 'Mid Market', 'sponsor-backed', 'société générale', "o'neil & söhne", 'öl und gas 2go', None)} AS customer_segment_raw,
      c_mktsegment AS industry_raw, {region} AS region_raw, lower(n_name) AS country_raw,
      concat('group ', {text('c_nationkey')}) AS group_ref, concat('RM', {text('n_nationkey')}) AS rm_owner_code,
      {d.date('2016-02-29')} + {day('c_custkey % 1500')} AS onboarding_date,
      {label('c_custkey', 'active', 'ACTIVE', 'dormant', 'Active', None)} AS relationship_status_raw,
      CASE WHEN c_acctbal < 2500 THEN 'low' WHEN c_acctbal < 6000 THEN 'middle' ELSE 'high' END AS annual_revenue_bucket_raw,
      CASE WHEN c_nationkey % 3 > 0 THEN concat('band ', {text('n_regionkey')}) END AS employee_count_bucket_raw,
      {extracted} AS source_extract_ts, '{status}' AS source_record_status
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE {where}"""

    first = f"{d.date('2025-03-01')} + {day('c_nationkey')}"
    later = f"CASE WHEN c_custkey % 90 > 0 THEN {d.date('2025-05-01')} END"
    return version("CASE WHEN c_custkey % 21 <> 8 THEN r_name END", first, "current", "c_custkey >= 0") + " UNION ALL " + version("'West Europe'", later, "updated", "c_custkey % 45 = 0")


def _opportunities(d: Dialect) -> str:
    return f"""
    SELECT opportunity_id, crm_account_id, opportunity_type_raw, stage_raw, expected_close_date,
      CASE WHEN lower(stage_raw) LIKE '%closed%' OR stage_raw = 'Withdrawn' THEN closing END AS actual_close_date, created_date, owner_rm_code,
      CASE WHEN lower(stage_raw) LIKE '%lost%' OR stage_raw = 'Withdrawn' THEN {label('number', 'Price too high', 'expensive terms', 'took an alternative', 'Cancelled', 'credit said no', 'wrong structure', 'no longer wanted', 'Bad Timing', None)} END AS lost_reason_raw,
      pipeline_amount_raw, currency_raw, source_last_updated_at
    FROM (
      SELECT o_orderkey AS number, concat('OP-', {text('o_orderkey')}) AS opportunity_id,
        concat('AC-', {text('CASE WHEN o_orderkey % 83 = 11 THEN o_custkey + 90000000 ELSE o_custkey END')}) AS crm_account_id,
        o_orderpriority AS opportunity_type_raw,
        CASE WHEN o_orderstatus = 'O' THEN {label('o_orderkey', 'Negotiation', 'prospecting', ' Credit Review', 'Origination', 'Unclear', 'Negotiation')}
             WHEN o_orderstatus = 'P' THEN {label('o_orderkey', 'Withdrawn', 'Closed Won', 'Closed Lost')}
             WHEN o_totalprice < 90000 THEN 'Closed Won' ELSE {label('o_custkey', 'Closed Lost', 'CLOSED lost ', 'Closed Lost')} END AS stage_raw,
        o_orderdate + {day('100')} AS expected_close_date, o_orderdate + {day('60 + o_custkey % 70')} AS closing, o_orderdate AS created_date,
        CASE WHEN o_orderkey % 31 > 0 THEN concat('RM', {text('o_custkey % 25')}) END AS owner_rm_code,
        o_totalprice AS pipeline_amount_raw, {label('o_custkey', 'EUR', ' eur', '€', 'USD', 'Gbp')} AS currency_raw, o_orderdate AS source_last_updated_at
      FROM orders) o"""


def _applications(d: Dialect) -> str:
    def version(prefix: str, purpose: str, later: int, where: str) -> str:
        return f"""
    SELECT concat('{prefix}', {text('o_orderkey')}) AS application_id, concat('OP-', {text('o_orderkey')}) AS opportunity_id,
      concat('AC-', {text('o_custkey')}) AS applicant_account_ref, 'Submitted' AS application_status_raw, {purpose} AS financing_purpose_raw,
      o_totalprice AS requested_amount, {label('o_custkey', 'EUR', 'USD')} AS requested_currency, CAST(6 + o_custkey % 90 AS INT) AS requested_tenor_months,
      CASE WHEN o_orderkey % 29 > 0 THEN o_orderdate + {day('o_custkey % 30')} END AS submission_date,
      CAST(NULL AS {d.timestamp}) AS approval_date, CAST(NULL AS {d.timestamp}) AS decline_date,
      {label('o_orderkey', 'branch', 'head office', None)} AS credit_committee_level_raw, o_orderdate + {day(str(later))} AS source_extract_ts
    FROM orders WHERE {where}"""

    return " UNION ALL ".join([
        version("AP-", "lower(o_orderpriority)", 5, "o_orderkey % 9 <> 4"),
        version("AP-", "'second version'", 9, "o_orderkey % 70 = 6"),
        version("AQ-1", "lower(o_orderpriority)", 5, "o_orderkey % 400 = 9"),
    ])


#: one row per facility key, aggregated before anything is shuffled
_FACILITY = """
  SELECT l_orderkey AS o, l_linenumber AS n, max(l_partkey) AS p, max(l_suppkey) AS s, max(l_shipdate) AS shipped, max(l_extendedprice) AS price,
         max(CAST(round(l_quantity) AS INT)) AS quantity, max(CAST(round(l_discount * 100) AS INT)) AS discount, max(CAST(round(l_tax * 100) AS INT)) AS tax
  FROM lineitem GROUP BY l_orderkey, l_linenumber
"""
_SOURCE_ID = "concat('FS-', {o}, '0', {n})"


def _source_id(order: str, line: str) -> str:
    return _SOURCE_ID.format(o=text(order), n=text(line))


def _facilities(d: Dialect) -> str:
    share = f"({whole('l_discount * 1000')} + {whole('l_tax * 100')}) % 100"
    tenor = f"CASE WHEN l_partkey % 67 = 2 THEN NULL WHEN l_partkey % 71 = 3 THEN 0 ELSE 3 * {whole('l_quantity')} END"
    return f"""
    SELECT {_source_id('l_orderkey', 'l_linenumber')} AS facility_source_id,
      CASE WHEN l_orderkey % 59 <> 7 THEN concat('AP-', {text('l_orderkey')}) END AS application_id, CAST(l_linenumber AS INT) AS facility_sequence_no,
      {label('l_partkey', 'RCF', 'Term Loan', 'Guarantee', 'Trade Finance', 'Overdraft', 'revolving line', 'TERM facility', 'bank guarantees', 'asset lease')} AS product_type_raw,
      l_extendedprice * 20 AS commitment_amount, l_extendedprice * l_tax * 100 AS drawn_amount_initial,
      CASE l_suppkey % 11 WHEN 0 THEN 'n/a' WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN ' 0.5 ' WHEN 4 THEN '150%' WHEN 5 THEN '-0.1' WHEN 6 THEN 'abc%'
        WHEN 7 THEN concat('0.', {two(share)}) ELSE concat({text(share)}, '%') END AS expected_utilisation_raw,
      {label('l_suppkey', 'EUR', 'usd', '€', 'GBP ', 'CHF')} AS currency, CAST({tenor} AS INT) AS tenor_months,
      l_shipdate + (CAST({tenor} AS INT)) * INTERVAL '1' MONTH AS maturity_date,
      CASE l_returnflag WHEN 'A' THEN 'bullet at end' WHEN 'R' THEN 'ÉCHÉANCES égales' ELSE {label('l_partkey', "debtor's choice", None)} END AS repayment_type_raw,
      {label('l_partkey', 'floater', 'Fixed', 'Floating')} AS interest_type_raw,
      {label('l_suppkey + l_linenumber', 'Cash', 'Unsecured', 'Real Estate', 'Receivables', 'Inventory', 'Vessel')} AS collateral_type_raw,
      {label('l_linenumber', None, 'light', 'strict')} AS covenant_package_raw, l_shipdate AS source_extract_ts
    FROM lineitem"""


def _quotes(d: Dialect) -> str:
    floor = "(60 + 10 * tax)"
    target = f"({floor} + 15 + quantity)"
    return f"""
    SELECT concat('Q', {text('o')}, '0', {text('n')}, '0', {text('version')}) AS quote_id, concat('AP-', {text('o')}) AS application_id,
      {_source_id('o', 'n')} AS facility_source_id, CAST(version AS INT) AS quote_version,
      {label('p + s + version', 'draft', 'Submitted', 'Approved', 'rejected', 'Expired', 'SUBMITTED')} AS quote_status_raw,
      shipped + {day('version')} AS quote_created_at,
      CASE WHEN (p + s) % 211 <> 5 THEN {real(f'{floor} - 10 + 14 * discount + 5 * version')} END AS offered_margin_bps,
      {real('quantity')} AS upfront_fee_bps, CASE WHEN p % 3 > 0 THEN {real('12 + discount')} END AS commitment_fee_bps,
      CASE WHEN s % 2 > 0 THEN {real('4 + tax')} END AS utilisation_fee_bps, CASE WHEN p % 14 <> 1 THEN {real('3 * tax')} END AS arrangement_fee_bps,
      {real(floor)} AS floor_margin_bps, {real(target)} AS target_margin_bps, {real(target + ' + 40')} AS stretch_margin_bps,
      CASE WHEN p % 17 <> 4 THEN discount > 8 END AS rm_override_flag, {label('p', 'key client', None)} AS override_reason_raw,
      {label('s', 'Approved', 'OPEN', None)} AS approval_status_raw, shipped + {day('version')} AS source_extract_ts
    FROM ({_FACILITY}) f {d.times('1 + s % 3', 'version')}"""


def _risk(d: Dialect) -> str:
    # default rate in hundredths of a percent, loss share in percent
    rate, loss = "(5 + 3 * quantity)", "(15 + 6 * tax)"
    return f"""
    SELECT concat('RA', {text('o')}, '0', {text('n')}, '0', {text('snapshot')}) AS risk_assessment_id, concat('AP-', {text('o')}) AS application_id,
      {_source_id('o', 'n')} AS facility_source_id, {label('p', 'A', 'a2', 'Bbb', 'BAA2', 'bb', 'Ba2', 'B', 'b2', 'ccc', None)} AS rating_raw,
      CASE WHEN p % 26 = 7 THEN NULL WHEN s % 3 = 0 THEN concat({text(f'{rate} / 100e0')}, '%') ELSE {text(f'{rate} / 10000e0')} END AS pd_raw,
      CASE WHEN p % 33 = 6 THEN 'n/a' WHEN s % 3 = 1 THEN concat({text(loss)}, '%') ELSE concat('0.', {two(loss)}) END AS lgd_raw,
      CASE WHEN p % 44 = 9 THEN {real('0')} ELSE price * 8 END AS ead_amount, CASE WHEN p % 35 <> 8 THEN price * (3 + discount) END AS rwa_amount,
      CASE WHEN p % 52 <> 3 THEN price * 8 * {rate} / 10000 * {loss} / 100 END AS expected_loss_amount,
      concat('model ', {text('snapshot')}) AS risk_model_version, shipped + {day('3 * snapshot')} AS assessment_date,
      {label('s', 'desk', 'committee')} AS approval_level_raw, CASE WHEN p % 38 <> 5 THEN tax = 8 END AS watchlist_flag,
      shipped + {day('3 * snapshot')} AS source_extract_ts
    FROM ({_FACILITY}) f {d.times('1 + p % 2', 'snapshot')} WHERE p % 28 <> 13"""


def _curves(d: Dialect) -> str:
    """A curve for every quarter with orders; its level follows their number."""
    cells = ", ".join(
        f"('{currency}', '{group}', {tenor}, {40 + 9 * i + 4 * j})"
        for i, currency in enumerate(("eur ", "USD", "GBP")) for j, group in enumerate(("Trade", "Term Lending", "Committed Lines", "Guarantee"))
        for tenor in (12, 24, 36, 60, 84) if (currency, tenor) != ("GBP", 60)
    )
    return f"""
    SELECT quarter AS ftp_curve_date, currency, product_group_raw, CAST(tenor AS INT) AS tenor_bucket_months,
      level + tenor / 2e0 + orders_then % 20 AS ftp_bps, 6 + tenor / 8e0 + orders_then % 4 AS liquidity_cost_bps
    FROM (SELECT CAST(date_trunc('quarter', o_orderdate) AS {d.timestamp}) AS quarter, count(*) AS orders_then FROM orders GROUP BY 1) q
      JOIN (VALUES {cells}) AS g(currency, product_group_raw, tenor, level) ON orders_then > 0"""


def _snapshots(d: Dialect) -> str:
    return f"""
    SELECT concat('AC-', {text('c_custkey')}) AS crm_account_id, {d.date('2024-12-01')} + month * INTERVAL '1' MONTH AS snapshot_month,
      c_acctbal * 90 AS total_existing_exposure, c_acctbal * month AS total_drawn_amount,
      CASE WHEN (c_custkey + month) % 25 <> 3 THEN c_acctbal / month END AS deposit_balance_avg, CAST(1 + (c_custkey + month) % 7 AS INT) AS existing_product_count,
      CASE WHEN (c_custkey + month) % 30 <> 4 THEN c_acctbal + 100 * month END AS relationship_revenue_ltm,
      c_acctbal / 4 AS relationship_cost_ltm, c_acctbal / 2 AS relationship_margin_ltm, CAST((c_nationkey * 5 + month * 11 + c_custkey) % 140 AS INT) AS days_since_last_contact,
      {d.date('2026-01-15')} AS source_extract_ts
    FROM customer {d.times('12', 'month')} WHERE c_custkey % 47 <> 12"""


def _history(d: Dialect) -> str:
    """Snapshots that reach back as far as the orders: one for every month in which a customer ordered."""
    return f"""
    SELECT concat('AC-', {text('o_custkey')}) AS crm_account_id, CAST(date_trunc('month', o_orderdate) AS {d.timestamp}) AS snapshot_month,
      max(o_totalprice) AS total_existing_exposure, min(o_totalprice) AS total_drawn_amount, max(o_totalprice) / 5 AS deposit_balance_avg,
      CAST(1 + count(*) AS INT) AS existing_product_count, max(o_totalprice) / 9 AS relationship_revenue_ltm, min(o_totalprice) / 30 AS relationship_cost_ltm,
      max(o_totalprice) / 20 AS relationship_margin_ltm, CAST(max(o_orderkey % 140) AS INT) AS days_since_last_contact, max(o_orderdate) AS source_extract_ts
    FROM orders WHERE o_custkey % 47 <> 12 GROUP BY o_custkey, date_trunc('month', o_orderdate)"""


def _activities(d: Dialect) -> str:
    return f"""
    SELECT concat('EV', {text('event_id')}) AS activity_id, concat('AC-', {text('user_id')}) AS crm_account_id,
      concat('OP-', {text('event_id % 5000 + user_id % 7')}) AS opportunity_id, concat('RM', {text('user_id % 25')}) AS rm_owner_code, ts AS activity_date,
      event_type AS activity_type_raw, CASE WHEN value > 100 THEN 'good' WHEN value > 20 THEN 'open' END AS activity_outcome_raw, ts AS source_extract_ts
    FROM events"""


def _offers(d: Dialect) -> str:
    rate = "(1e-2 + l_tax + l_discount / 2 + l_partkey % 40 / 10000e0)"
    return f"""
    SELECT l_orderkey * 10 + l_linenumber AS offer_no, l_partkey AS offer_ref, CAST(1 + l_suppkey % 4 AS INT) AS tier, {rate} AS rate,
      1e-2 + l_tax AS reference_rate, l_extendedprice AS amount, CAST(560 + 5 * {whole('l_quantity')} AS INT) AS fico, CAST(12 * l_linenumber AS INT) AS term,
      concat('type ', l_returnflag) AS loan_type, 4e-3 + l_tax / 5 AS cost_of_funds,
      CAST(CASE WHEN (l_orderkey * 13 + l_partkey * 7) % 97 < 78 - 500 * {rate} - l_extendedprice / 4500 THEN 1 ELSE 0 END AS INT) AS outcome
    FROM lineitem"""


EXTRACTS: dict[str, tuple[Callable[[Dialect], str], list[str]]] = {
    "bronze_crm_accounts": (_accounts, ["customer", "nation", "region"]),
    "bronze_crm_opportunities": (_opportunities, ["orders"]),
    "bronze_los_applications": (_applications, ["orders"]),
    "bronze_los_facilities": (_facilities, ["lineitem"]),
    "bronze_pricing_quotes": (_quotes, ["lineitem"]),
    "bronze_risk_assessments": (_risk, ["lineitem"]),
    "bronze_treasury_ftp_rates": (_curves, ["orders"]),
    "bronze_core_relationship_snapshot": (_snapshots, ["customer"]),
    "bronze_rm_activities": (_activities, ["events"]),
    "loan_offers": (_offers, ["lineitem"]),
    "relationship_history": (_history, ["orders"]),
}


def extract_sql(name: str, dialect: Dialect = ANSI) -> str:
    return EXTRACTS[name][0](dialect)


# Extracts that begin with an aggregate, whose exchange deals out their rows anyway.
AGGREGATED = {"bronze_pricing_quotes", "bronze_risk_assessments", "bronze_treasury_ftp_rates", "relationship_history"}

# Extracts that make many rows of each row of a small table, which a file may offer as one split.
EXPANDED = {"bronze_core_relationship_snapshot"}


class StarSource:
    """The extracts of one star-schema folder as lazy DataFrames.

    ``spread`` is for files that offer a single split, as one large row group does: the caller names the number of
    partitions that the columns in use are dealt to. By default tables are read as they are split, except below an expansion: its rows
    are dealt to all cores first.
    """

    def __init__(self, spark: SparkSession, folder: str, spread: int | None = None):
        self.spark, self.folder, self.spread = spark, folder, spread

    def star(self, table: str, dealt: bool = True, spread: int | None = None) -> DataFrame:
        df, spread = self.spark.read.parquet(f"{self.folder}/{table}.parquet"), self.spread or spread
        return df.repartition(spread) if spread and dealt else df

    def extract(self, name: str) -> DataFrame:
        build, needs = EXTRACTS[name]
        query = build(SPARK)
        for t in needs:
            query = query.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
        spread = self.spark.sparkContext.defaultParallelism if name in EXPANDED else None
        return self.spark.sql(query, **{t: self.star(t, name not in AGGREGATED, spread) for t in needs})

    def bronze(self) -> dict[str, DataFrame]:
        return {name: self.extract(name) for name in EXTRACTS if name.startswith("bronze_")}
