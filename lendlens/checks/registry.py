"""Registers checks: a key, the result columns, the Spark side and the SQL side.

Result columns are given as ``name`` or ``name:code``. The code fixes how both sides
are brought to a comparable value: ``f``/``f4``/``f2`` rounded double, ``i`` bigint,
``t`` date as text. Before rounding both sides are shifted by a small part of the
last digit, so that a value that lies exactly on a rounding tie cannot fall to
different sides because of summation order.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property, partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendlens.checks.tables_sql import TABLES
from lendlens.plans import gold, silver
from lendlens.plans.lazy import LazyTables
from lendlens.session import settle, tune
from lendlens.checks.star import StarSource


class Context:
    """Lazy access to extracts, Silver and Gold of one folder; nothing is built before it is asked for."""

    def __init__(self, spark: SparkSession, folder: str, spread: int | None = None):
        self.spark, self.folder = tune(spark), folder
        self.source = StarSource(spark, folder, spread)
        self._extracts: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._extracts:
            self._extracts[name] = self.source.extract(name)
        return self._extracts[name]

    def star(self, table: str) -> DataFrame:
        return self.source.star(table)

    @property
    def bronze(self) -> dict[str, DataFrame]:
        return self.source.bronze()

    @cached_property
    def offers(self) -> DataFrame:
        return self["loan_offers"]

    @cached_property
    def customers(self) -> DataFrame:
        return silver.customers(self["bronze_crm_accounts"])

    @cached_property
    def deals(self) -> DataFrame:
        return silver.deals(self["bronze_crm_opportunities"], self["bronze_los_applications"])

    @cached_property
    def facilities(self) -> DataFrame:
        return silver.facilities(self["bronze_los_facilities"], self.deals)

    @cached_property
    def kept_deals(self) -> DataFrame:
        """Deals computed once: facilities, deal economics and features are built on them."""
        return settle(self.deals)

    @cached_property
    def facility_keys(self) -> DataFrame:
        """The keys of known facilities, all that quotes and risk read of them."""
        return settle(silver.facilities(self["bronze_los_facilities"], self.deals, silver.FACILITY_KEYS))

    @cached_property
    def pricing(self) -> DataFrame:
        return silver.pricing_cases(self["bronze_pricing_quotes"], self.facility_keys)

    @cached_property
    def risk(self) -> DataFrame:
        return silver.risk_assessments(self["bronze_risk_assessments"], self.facility_keys)

    @cached_property
    def kept_facilities(self) -> DataFrame:
        """The columns of facilities that the marts read, computed once: three tables are built on them."""
        return settle(silver.facilities(self["bronze_los_facilities"], self.kept_deals, [*silver.FACILITY_KEYS, *silver.FACILITY_MEASURES]))

    @cached_property
    def kept_risk(self) -> DataFrame:
        """The columns of risk rows that the marts read, computed once: facility economics and deal risk read them."""
        return settle(self.economics_inputs["silver_risk_assessments"].select(*gold.RISK_INPUTS))

    @cached_property
    def relationships(self) -> DataFrame:
        return silver.relationship_snapshots(self["bronze_core_relationship_snapshot"])

    @cached_property
    def ftp(self) -> DataFrame:
        return silver.ftp_rates(self["bronze_treasury_ftp_rates"])

    @cached_property
    def economics_inputs(self) -> dict[str, DataFrame]:
        """What facility economics read of the Silver tables (no ranks involved); of the quotes, the final ones."""
        return {
            "silver_facilities": self.kept_facilities,
            "silver_pricing_cases": silver.final_pricing_cases(self["bronze_pricing_quotes"], self.kept_facilities),
            "silver_risk_assessments": silver.risk_assessments(self["bronze_risk_assessments"], self.kept_facilities),
            "silver_ftp_rates": self.ftp,
        }

    @cached_property
    def silver(self) -> Mapping[str, DataFrame]:
        """What the marts read of the Silver tables."""
        return LazyTables({
            "silver_customers": lambda: self.customers,
            "silver_deals": lambda: self.kept_deals,
            "silver_facilities": lambda: self.kept_facilities,
            "silver_pricing_cases": lambda: self.economics_inputs["silver_pricing_cases"],
            "silver_risk_assessments": lambda: self.kept_risk,
            "silver_relationship_snapshots": lambda: self.relationships,
            "silver_ftp_rates": lambda: self.ftp,
        })

    @cached_property
    def mart_silver(self) -> Mapping[str, DataFrame]:
        """Silver cut to the rows that the marts read: the newest snapshots of each customer, scored among all."""
        newest = {"silver_relationship_snapshots": lambda: silver.relationship_snapshots(self["bronze_core_relationship_snapshot"], newest_only=True)}
        return LazyTables({name: newest.get(name, partial(self.silver.__getitem__, name)) for name in self.silver})

    @cached_property
    def economics(self) -> DataFrame:
        return gold.facility_economics(self.economics_inputs)

    @cached_property
    def kept_economics(self) -> DataFrame:
        """The facility measures that deals are aggregated from, computed once for their two consumers."""
        return settle(gold.facility_economics(self.silver).select(*gold.DEAL_INPUTS))

    @cached_property
    def gold(self) -> Mapping[str, DataFrame]:
        return gold.build_gold(self.mart_silver)

    def _shared_silver(self, facilities: Callable[[], DataFrame], pricing: Callable[[DataFrame], DataFrame], risk: Callable[[DataFrame], DataFrame]) -> Mapping[str, DataFrame]:
        """Silver in which facilities, quotes and risk are computed once; ``pricing`` and ``risk`` cut their tables."""
        raw = {"silver_pricing_cases": "bronze_pricing_quotes", "silver_risk_assessments": "bronze_risk_assessments"}
        shared = {
            "silver_facilities": facilities,
            "silver_pricing_cases": lambda: settle(pricing(silver.dealt_pricing_cases(self[raw["silver_pricing_cases"]], tables["silver_facilities"]))),
            "silver_risk_assessments": lambda: settle(risk(silver.risk_assessments(self[raw["silver_risk_assessments"]], tables["silver_facilities"]))),
        }
        tables = LazyTables({name: shared.get(name, partial(self.silver.__getitem__, name)) for name in self.silver})
        return tables

    def _shared_gold(self, tables: Mapping[str, DataFrame], economics: Sequence[str] | None = None) -> Mapping[str, DataFrame]:
        """Gold for queries that read several marts: what marts share is computed once, facility economics with the named columns (none: all)."""

        def keep(name: str, df: DataFrame) -> DataFrame:
            if name == "gold_facility_economics":
                return settle(df.select(*economics) if economics else df)
            return settle(df) if name == "gold_deal_economics" else df

        newest = {"silver_relationship_snapshots": partial(self.mart_silver.__getitem__, "silver_relationship_snapshots")}
        return gold.build_gold(LazyTables({name: newest.get(name, partial(tables.__getitem__, name)) for name in tables}), keep)

    @cached_property
    def whole_silver(self) -> Mapping[str, DataFrame]:
        """Silver with all columns for queries that read all layers and look at their columns."""
        return self._shared_silver(lambda: settle(silver.facilities(self["bronze_los_facilities"], self.kept_deals)), lambda df: df, lambda df: df)

    @cached_property
    def whole_gold(self) -> Mapping[str, DataFrame]:
        return self._shared_gold(self.whole_silver)

    @cached_property
    def key_silver(self) -> Mapping[str, DataFrame]:
        """The same rows with the keys, the fields of the lineage and what the marts read, for queries that read no other columns."""
        return self._shared_silver(
            lambda: self.kept_facilities,
            lambda df: df.select("pricing_case_id", "is_final_quote", *gold.QUOTE_INPUTS),
            lambda df: df.select("risk_assessment_id", *gold.RISK_INPUTS),
        )

    @cached_property
    def key_gold(self) -> Mapping[str, DataFrame]:
        return self._shared_gold(self.key_silver, [*gold.DEAL_INPUTS, "risk_adjusted_margin_bps"])

    @cached_property
    def shared_gold(self) -> Mapping[str, DataFrame]:
        """Gold for queries that read several marts and of Silver no more than these do."""
        return self._shared_gold(self.silver, gold.DEAL_INPUTS)

    @cached_property
    def lazy_features(self) -> DataFrame:
        """Deal features without the complexity score (no rank over all deals)."""
        econ = gold.deal_economics(self.kept_economics, self.kept_deals, with_complexity=False)
        return gold.deal_features(self.mart_silver, self.kept_economics, econ)

    @cached_property
    def features(self) -> DataFrame:
        """Deal features with all scores."""
        return gold.deal_features(self.mart_silver, self.kept_economics, gold.deal_economics(self.kept_economics, self.kept_deals))

    @cached_property
    def past_silver(self) -> Mapping[str, DataFrame]:
        """Silver with a relationship history that reaches back to the first deals."""
        return {**self.silver_parts, "silver_relationship_snapshots": silver.relationship_snapshots(self["relationship_history"])}

    @cached_property
    def features_as_of(self) -> DataFrame:
        """Deal features from the curve and the relationship known at each decision."""
        economics = settle(gold.facility_economics(self.past_silver, as_of=True).select(*gold.DEAL_INPUTS))
        return gold.deal_features(self.past_silver, economics, gold.deal_economics(economics, self.kept_deals), as_of=True)

    @property
    def silver_parts(self) -> dict[str, DataFrame]:
        return {name: self.silver[name] for name in self.silver if name != "silver_relationship_snapshots"}

    @cached_property
    def scored(self) -> DataFrame:
        """(deal_id, y, p): every deal with a label and a score computed from its attributes."""
        totals = self["bronze_crm_opportunities"].select(
            F.substring("opportunity_id", 4, 20).cast("bigint").alias("deal_no"), "stage_raw", "pipeline_amount_raw"
        )
        return totals.where("lower(stage_raw) LIKE '%closed%'").select(
            "deal_no",
            F.when(F.col("stage_raw") == "Closed Won", 1).otherwise(0).alias("y"),
            ((F.col("deal_no") * 7919 % 99991) / 99991.0).alias("p"),
        )


@dataclass(frozen=True)
class Check:
    key: str
    columns: list[tuple[str, str]]
    build: Callable[[Context], DataFrame]
    sql: str | None


CHECKS: dict[str, Check] = {}


def check(key: str, columns: str, sql: str | None = None):
    parts = [(c.partition(":")[0], c.partition(":")[2]) for c in columns.split()]

    def register(build):
        if key in CHECKS:
            raise ValueError(f"duplicate check {key}")
        CHECKS[key] = Check(key, parts, build, sql)
        return build

    return register


def key_hash_sql(seed: str, *columns: str) -> str:
    """The SQL of ``lendlens.operators.model.key_hash``."""
    texts = ", ".join(f"CAST({c} AS VARCHAR)" for c in columns)
    return f"CAST('0x' || substr(md5(concat_ws('|', '{seed}', {texts})), 1, 15) AS BIGINT)"


def _digits(code: str) -> int:
    return int(code[1:] or 6)


def _shift(code: str) -> float:
    return 0.013729034117 * 10.0 ** -_digits(code)


def _spark_value(name: str, code: str):
    c = F.col(name)
    if code.startswith("f"):
        return (F.round(c.cast("double") + F.lit(_shift(code)), _digits(code)) + F.lit(0.0)).alias(name)
    if code == "i":
        return c.cast("bigint").alias(name)
    if code == "t":
        return c.cast("date").cast("string").alias(name)
    return c


def _sql_value(name: str, code: str) -> str:
    if code.startswith("f"):
        return f"round(CAST({name} AS DOUBLE) + CAST('{_shift(code)!r}' AS DOUBLE), {_digits(code)}) + 0.0 AS {name}"
    if code == "i":
        return f"CAST({name} AS BIGINT) AS {name}"
    if code == "t":
        return f"CAST(CAST({name} AS DATE) AS VARCHAR) AS {name}"
    return name


def run_check(key: str, spark: SparkSession, folder: str, spread: int | None = None) -> DataFrame:
    c = CHECKS[key]
    return c.build(Context(spark, folder, spread)).select(*[_spark_value(n, code) for n, code in c.columns])


def _referenced(text: str) -> list[str]:
    words = set(re.findall(r"[a-z_][a-z_0-9]*", text))
    return [t for t in TABLES if t in words]


def with_tables(query: str) -> str:
    """The query with the definitions of all derived tables it reads, in dependency order."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for t in _referenced(text):
            if t not in ordered:
                visit(TABLES[t])
                ordered.append(t)

    visit(query)
    if not ordered:
        return query
    return "WITH " + ",\n".join(f"{t} AS ({TABLES[t]})" for t in ordered) + "\n" + query


def compared_sql(key: str) -> str | None:
    c = CHECKS[key]
    if c.sql is None:
        return None
    columns = ", ".join(_sql_value(n, code) for n, code in c.columns)
    return with_tables(f"SELECT {columns} FROM ({c.sql}) result_rows")
