"""Profiles, validation reports, layer summaries and key checks, all as small result tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendlens.functions.standardize import unknown_stage
from lendlens.functions.text import number_or_percent
from lendlens.session import settle
from lendlens.sources.catalog import BRONZE, ENTRIES, GOLD, SILVER, forbidden_columns

# Columns a deal table must have, and columns it should have.
REQUIRED_DEAL_COLUMNS = ["commercial_relevance_flag", "customer_id", "deal_id", "deal_outcome", "deal_status"]
RECOMMENDED_DEAL_COLUMNS = ["deal_type", "decision_date", "expected_close_date", "lost_reason", "offer_date"]
KNOWN_OUTCOMES = ["won", "lost"]
MISSING_UTILISATION = ["n/a", "nan", "none"]


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def in_turn(frames: Iterable[DataFrame]) -> DataFrame:
    """The union of small results that are computed one after the other: the shuffle files of one are gone before the next
    begins, so disk holds those of the largest and not of all together."""
    return union_all([settle(df) for df in frames])


def _row_count(table: str, df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(table).alias("table_name"), "n_rows")


def row_counts(tables: Mapping[str, DataFrame], one_by_one: bool = False) -> DataFrame:
    """(table_name, n_rows); ``one_by_one`` for tables that take shuffles to compute."""
    counts = (_row_count(t, df) for t, df in tables.items())
    return in_turn(counts) if one_by_one else union_all([*counts])


def _digests(value: Column) -> list[Column]:
    """Two hashes of a value, 128 bits in all, that stand for it in exchanges; null for null."""
    return [F.when(value.isNotNull(), F.xxhash64(value)).alias("d1"), F.when(value.isNotNull(), F.xxhash64(F.lit(1), value)).alias("d2")]


def _comparable(df: DataFrame, column: str) -> Column:
    """A column as a value that can be hashed: maps become texts of their sorted entries."""
    c = F.col(f"`{column}`")
    return F.to_json(F.array_sort(F.map_entries(c))) if isinstance(df.schema[column].dataType, T.MapType) else c


def _approximate_profile(table: str, df: DataFrame) -> DataFrame:
    parts = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.count(F.lit(1)).alias("row_count"),
            F.count_if(F.col(f"`{c}`").isNull()).alias("missing"),
            F.approx_count_distinct(_comparable(df, c)).alias("unique_values"),
        )
        for c in df.columns
    ]
    return df.agg(F.array(*parts).alias("p")).select(F.lit(table).alias("table_name"), F.explode("p").alias("p")).select("table_name", "p.*")


def _exact_profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Every table is read once: each row gives one cell per column, its digests in place of the value. Cells are counted by
    one aggregate for all columns and tables, which combines on the map side, so neither texts nor vectors are shuffled."""
    cells = []
    for table, df in tables.items():
        rows = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("place"), *_digests(_comparable(df, c))) for i, c in enumerate(df.columns)])).alias("c"))
        cells.append(rows.select(F.lit(table).alias("table_name"), "c.*"))
    counted = union_all(cells).groupBy("table_name", "place", "d1", "d2").agg(F.count(F.lit(1)).alias("n"))
    found = counted.groupBy("table_name", "place").agg(
        F.sum("n").alias("row_count"), F.sum(F.when(F.col("d1").isNull(), F.col("n"))).alias("missing"), F.count("d1").alias("unique_values")
    )
    spark = next(iter(tables.values())).sparkSession
    names = spark.createDataFrame([(t, i, c) for t, df in tables.items() for i, c in enumerate(df.columns)], "table_name string, place int, column_name string")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("row_count", "missing", "unique_values")]
    return names.join(found, ["table_name", "place"], "left").select("table_name", "column_name", *counts)


def profile_tables(tables: Mapping[str, DataFrame], approximate: bool = False) -> DataFrame:
    """(table_name, column_name, dtype, row_count, column_count, missing, unique_values), one row per column of every table.

    Exact counts compare values by 128-bit digests. ``approximate`` takes sketches of all columns from one scan without a shuffle of values.
    """
    rows = union_all([_approximate_profile(t, df) for t, df in tables.items()]) if approximate else _exact_profile(tables)
    described = {(t, c): (kind, len(df.columns)) for t, df in tables.items() for c, kind in df.dtypes}
    kinds = rows.sparkSession.createDataFrame([(*k, *v) for k, v in described.items()], "table_name string, column_name string, dtype string, column_count int")
    names = ["table_name", "column_name", "dtype", "row_count", "column_count", "missing", "unique_values"]
    return rows.join(kinds, ["table_name", "column_name"]).select(*names)


def profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """The same for one table, without its name."""
    return profile_tables({"": df}, approximate).drop("table_name")


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: list[str]) -> None:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing columns: {missing}")


def unexpected_values(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Distinct lower-case values outside the allowed list."""
    seen = df.select(F.lower(F.col(column).cast("string")).alias("value")).where("value IS NOT NULL").distinct()
    return seen.where(~F.col("value").isin(allowed))


def surplus_rows(df: DataFrame, *keys: str) -> DataFrame:
    """(n_surplus): rows beyond the first of each key; a missing key counts as one key."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_surplus"))


def _surplus(*keys: str) -> Column:
    """The same as an aggregate next to others."""
    return F.count(F.lit(1)) - F.count_distinct(F.struct(*keys))


@dataclass(frozen=True)
class Measured:
    """A table and the metrics that one aggregate over it yields; ``frame`` has the table's rows."""

    table: str
    frame: DataFrame
    metrics: dict[str, Column]


def _measurements(parts: list[Measured], with_rows: bool) -> Iterator[DataFrame]:
    for part in parts:
        metrics = ({"rows": F.count(F.lit(1))} if with_rows else {}) | part.metrics
        if metrics:
            row = part.frame.agg(*[c.cast("bigint").alias(m) for m, c in metrics.items()])
            cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
            yield row.select(F.lit(part.table).alias("table_name"), F.explode(cells).alias("c")).select("table_name", "c.*")


def _measure(parts: list[Measured], with_rows: bool = False) -> DataFrame:
    """(table_name, metric, value): every table is aggregated once."""
    return union_all([*_measurements(parts, with_rows)])


def validation_report(df: DataFrame) -> DataFrame:
    """(check_name, severity, detail, n_rows) of a deal table; only findings are listed."""
    spark, columns = df.sparkSession, set(df.columns)
    static = [("missing_required", "error", c, 0) for c in missing_columns(df, REQUIRED_DEAL_COLUMNS)]
    static += [("missing_recommended", "warning", c, 0) for c in missing_columns(df, RECOMMENDED_DEAL_COLUMNS)]
    parts = [spark.createDataFrame(static, "check_name string, severity string, detail string, n_rows bigint")]

    def finding(frame: DataFrame, check: str, detail) -> DataFrame:
        return frame.where("n_rows > 0").select(
            F.lit(check).alias("check_name"), F.lit("warning").alias("severity"), detail.alias("detail"), "n_rows"
        )

    if "deal_outcome" in columns:
        seen = df.groupBy(F.lower(F.col("deal_outcome").cast("string")).alias("v")).agg(F.count(F.lit(1)).alias("n_rows"))
        parts.append(finding(seen.where(~F.col("v").isin(KNOWN_OUTCOMES)), "unexpected_outcome", F.col("v")))
    if "commercial_relevance_flag" in columns:
        gaps = df.agg(F.count_if(F.col("commercial_relevance_flag").isNull()).alias("n_rows"))
        parts.append(finding(gaps, "missing_relevance_flag", F.lit("commercial_relevance_flag")))
    if "deal_id" in columns:
        repeats = surplus_rows(df, "deal_id").withColumnRenamed("n_surplus", "n_rows")
        parts.append(finding(repeats, "duplicate_deal_id", F.lit("deal_id")))
    return union_all(parts)


@dataclass(frozen=True)
class ValidationResult:
    """Whether the required columns are there, and the whole report as a table."""

    is_valid: bool
    missing_columns: list[str]
    report: DataFrame

    def warnings(self) -> Iterator[str]:
        """All warnings as texts, fetched a partition at a time."""
        for r in self.report.where("severity = 'warning'").orderBy("check_name", "detail").toLocalIterator():
            yield f"{r.check_name}: {r.detail} ({r.n_rows} rows)" if r.n_rows else f"{r.check_name}: {r.detail}"


def validate_deals(df: DataFrame) -> ValidationResult:
    missing = missing_columns(df, REQUIRED_DEAL_COLUMNS)
    return ValidationResult(not missing, missing, validation_report(df))


def _bronze(bronze: Mapping[str, DataFrame]) -> list[Measured]:
    accounts, facilities = BRONZE["crm_accounts"], BRONZE["los_facilities"]
    use = F.lower(F.col("expected_utilisation_raw").cast("string"))
    return [
        Measured(accounts, bronze[accounts], {
            "duplicate_crm_account_rows": _surplus("crm_account_id"),
            "missing_region_rows": F.count_if(F.col("region_raw").isNull()),
        }),
        Measured(facilities, bronze[facilities], {
            "duplicate_facility_rows": _surplus("facility_source_id"),
            "missing_expected_utilisation_rows": F.count_if(use.isNull() | use.isin(MISSING_UTILISATION)),
        }),
    ]


def bronze_summary(bronze: Mapping[str, DataFrame]) -> DataFrame:
    """(metric, value) of known source defects."""
    return _measure(_bronze(bronze)).select("metric", "value")


def dirty_value_summary(bronze: Mapping[str, DataFrame]) -> DataFrame:
    """(metric, value): rows whose raw values were read by a fallback rule."""

    def unreadable(c: str) -> Column:
        return F.count_if(F.col(c).isNotNull() & number_or_percent(c).isNull())

    def of(name: str, **metrics: Column) -> Measured:
        return Measured(BRONZE[name], bronze[BRONZE[name]], metrics)

    return _measure([
        of("crm_opportunities", unrecognised_stage_rows=F.count_if(unknown_stage("stage_raw"))),
        of("los_facilities", unreadable_utilisation_rows=unreadable("expected_utilisation_raw")),
        of("risk_assessments", unreadable_pd_rows=unreadable("pd_raw"), unreadable_lgd_rows=unreadable("lgd_raw"),
           missing_watchlist_flag_rows=F.count_if(F.col("watchlist_flag").isNull())),
        of("pricing_quotes", missing_override_flag_rows=F.count_if(F.col("rm_override_flag").isNull())),
        of("crm_accounts", missing_account_id_rows=F.count_if(F.col("crm_account_id").isNull())),
    ]).select("metric", "value")


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Child rows without a parent (a missing key has no parent)."""
    keys = parent.select(F.col(parent_key or key).alias(key)).distinct()
    return child.join(keys, key, "left_anti")


def _with_parent(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows with ``_known``: whether the parent table has the key."""
    keys = parent.select(F.col(key).alias("_key")).where("_key IS NOT NULL").distinct()
    return child.join(keys, child[key] == keys["_key"], "left").withColumn("_known", F.col("_key").isNotNull()).drop("_key")


def _silver(silver: Mapping[str, DataFrame]) -> list[Measured]:
    customers, deals, facilities = (SILVER[t] for t in ("customers", "deals", "facilities"))
    missing = F.count_if(~F.col("_known"))
    return [
        Measured(customers, silver[customers], {"duplicate_customer_ids": _surplus("customer_id")}),
        Measured(deals, _with_parent(silver[deals], silver[customers], "customer_id"), {
            "deals_missing_customer_reference": missing,
            "active_deals_with_outcome": F.count_if((F.col("deal_status") == "active") & F.col("deal_outcome").isNotNull()),
        }),
        Measured(facilities, _with_parent(silver[facilities], silver[deals], "deal_id"), {"facilities_missing_deal_reference": missing}),
    ]


def silver_summary(silver: Mapping[str, DataFrame]) -> DataFrame:
    return _measure(_silver(silver)).select("metric", "value")


def _gold(gold: Mapping[str, DataFrame]) -> list[Measured]:
    training, active, facilities = (GOLD[t] for t in ("deal_training_dataset", "active_deal_scoring_dataset", "facility_economics"))
    rows = F.count(F.lit(1))
    return [
        Measured(training, gold[training], {"training_deals": rows, "training_outcome_values": F.countDistinct("deal_outcome")}),
        Measured(active, gold[active], {
            "active_scoring_deals": rows,
            "active_contains_outcome_column": F.max(F.lit(int("deal_outcome" in gold[active].columns))),
        }),
        Measured(facilities, gold[facilities], {"facility_economics_rows": rows}),
    ]


def gold_summary(gold: Mapping[str, DataFrame]) -> DataFrame:
    found = _measure(_gold(gold)).select("metric", "value")
    return found.select("metric", F.coalesce("value", F.lit(0)).alias("value"))


def training_outcomes(training: DataFrame) -> DataFrame:
    """Distinct labels of the training set."""
    return training.select("deal_outcome").where("deal_outcome IS NOT NULL").distinct()


# Metrics that warn when they are above zero.
WARNINGS = ["active_deals_with_outcome", "active_contains_outcome_column", "forbidden_columns"]


def _measured_layers(bronze, silver, gold, with_rows: bool) -> DataFrame:
    """(layer, table_name, metric, value) of all layers, computed once, one table after the other."""
    parts = []
    for layer, tables, known in (("bronze", bronze, _bronze(bronze)), ("silver", silver, _silver(silver)), ("gold", gold, _gold(gold))):
        rest = [Measured(t, df, {}) for t, df in tables.items() if with_rows and t not in {m.table for m in known}]
        parts.append(in_turn(_measurements(known + rest, with_rows)).select(F.lit(layer).alias("layer"), "table_name", "metric", F.coalesce("value", F.lit(0)).alias("value")))
    policy = len(forbidden_columns({**bronze, **silver, **gold}))
    static = parts[0].sparkSession.createDataFrame([("all", None, "forbidden_columns", policy)], "layer string, table_name string, metric string, value bigint")
    return union_all([*parts, static])


def quality_summary(bronze, silver, gold) -> DataFrame:
    """(layer, metric, value) of all layers plus the number of warnings raised by them."""
    metrics = _measured_layers(bronze, silver, gold, with_rows=False).select("layer", "metric", "value")
    warnings = metrics.agg(F.count_if(F.col("metric").isin(WARNINGS) & (F.col("value") > 0)).alias("value"))
    return metrics.unionByName(warnings.select(F.lit("all").alias("layer"), F.lit("warning_count").alias("metric"), "value"))


def quality_warnings(bronze, silver, gold) -> DataFrame:
    """(layer, warning, value): the warnings themselves."""
    metrics = _measured_layers(bronze, silver, gold, with_rows=False)
    return metrics.where(F.col("metric").isin(WARNINGS) & (F.col("value") > 0)).select("layer", F.col("metric").alias("warning"), "value")


def run_summary(bronze, silver, gold) -> DataFrame:
    """(section, item, value): row counts per table and the share of tables with warnings. Every table is
    aggregated once, for its rows and its metrics together."""
    metrics = _measured_layers(bronze, silver, gold, with_rows=True)
    n_tables = max(1, len(bronze) + len(silver) + len(gold))
    counts = metrics.where("metric = 'rows'").select(F.col("layer").alias("section"), F.col("table_name").alias("item"), F.col("value").cast("double").alias("value"))
    raised = F.count_if(F.col("metric").isin(WARNINGS) & (F.col("value") > 0))
    share = metrics.agg((raised / n_tables).alias("value")).select(F.lit("summary").alias("section"), F.lit("warning_share").alias("item"), "value")
    return counts.unionByName(share)


def _repeated_keys(table: str, df: DataFrame, primary_key: str) -> DataFrame:
    repeated = df.groupBy(*primary_key.split(",")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = repeated.agg(F.count(F.lit(1)).alias("duplicate_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus_rows"))
    return found.select(F.lit(table).alias("table_name"), F.lit(primary_key).alias("primary_key"), "duplicate_keys", "surplus_rows")


def key_violations(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, primary_key, duplicate_keys, surplus_rows) for every table with a declared key, one table after the other."""
    return in_turn(_repeated_keys(e.name, tables[e.name], e.primary_key) for e in ENTRIES if e.primary_key and e.name in tables)


# Keys up to this many bytes are shuffled as they are, which takes fewer bytes than a digest; longer ones as 64 hex digits.
SHORT_KEY = 32


def _key_text(key: Column) -> Column:
    """A key as a text of bounded length that stands for it in exchanges; no digest is as short as the keys that stay."""
    text = key.cast("string")
    return F.when(F.octet_length(text) <= SHORT_KEY, text).otherwise(F.sha2(text, 256))


def _orphan_rows(tables: Mapping[str, DataFrame], target: str, references: list[tuple[int, str, str]]) -> DataFrame:
    """(place, orphan_rows) of the references (place, table, column) to one target column.

    Every table is read once. The target gives each of its keys once for all references, a table that refers gives the key and
    the place of each of its references. One aggregate over the keys combines on the map side; a key that no target row has counts its rows as orphans.
    """
    parent, _, key = target.partition(".")
    roles: dict[str, list[tuple[int | None, str]]] = {parent: [(None, key)]}
    for place, table, column in references:
        roles.setdefault(table, []).append((place, column))
    counts = {place: f"n{place}" for place, _, _ in references}
    cells = []
    for table, own in roles.items():
        parts = [
            F.struct(
                _key_text(F.col(c)).alias("key"), F.lit(at is None).alias("known"),
                *[F.lit(int(at == place)).cast("bigint").alias(n) for place, n in counts.items()],
            )
            for at, c in own
        ]
        rows = tables[table].select(F.explode(F.array(*parts)).alias("c")).select("c.*") if len(parts) > 1 else tables[table].select(parts[0].alias("c")).select("c.*")
        cells.append(rows.where("key IS NOT NULL"))
    keys = union_all(cells).groupBy("key").agg(F.max("known").alias("known"), *[F.sum(n).alias(n) for n in counts.values()])
    lost = keys.where("NOT known").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in counts.values()])
    pairs = F.array(*[F.struct(F.lit(place).alias("place"), F.col(n).alias("orphan_rows")) for place, n in counts.items()])
    return lost.select(F.explode(pairs).alias("c")).select("c.*")


def reference_violations(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, foreign_key, target, orphan_rows) for every declared reference between given tables.

    The references to one target column are checked together, one target after the other, so that the keys of one of them are
    on disk at a time. Missing keys refer to nothing.
    """
    named = [
        (e.name, column, target) for e in ENTRIES for column, target in e.foreign_keys.items() if e.name in tables and target.split(".")[0] in tables
    ]
    targets: dict[str, list[tuple[int, str, str]]] = {}
    for place, (table, column, target) in enumerate(named):
        targets.setdefault(target, []).append((place, table, column))
    lost = in_turn(_orphan_rows(tables, target, references) for target, references in targets.items())
    spark = next(iter(tables.values())).sparkSession
    names = spark.createDataFrame([(i, *n) for i, n in enumerate(named)], "place int, table_name string, foreign_key string, target string")
    return names.join(lost, "place", "left").select("table_name", "foreign_key", "target", F.coalesce("orphan_rows", F.lit(0)).alias("orphan_rows"))


def counted_registry(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The catalogue with the current row count of every table that is given."""
    from lendlens.sources.catalog import registry_table

    counts = row_counts(tables).select(F.col("table_name").alias("name"), "n_rows")
    return registry_table(spark, tables).join(counts, "name", "left")
