"""Sources and sinks S1–S12."""

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendlens.operators.model import split_features
from lendlens.operators.quality import counted_registry, in_turn, missing_columns, require_columns, row_counts, union_all
from lendlens.plans.gold import FEATURES
from lendlens.session import scratch_folder
from lendlens.sources import catalog, tables

from .registry import check

STAR = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


LEVEL_FEATURES = ("customer_segment", "industry", "region", "rating_at_offer", "anchor_product")


def training_features() -> list[str]:
    return [c for c in FEATURES if c not in ("deal_id", "customer_id", "rm_id")]


def _rows(values: list[tuple]) -> str:
    def literal(v):
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(literal(v) for v in r) + ")" for r in values)


@check("s1_load_tables", "table_name n_rows:i", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in STAR))
def _(ctx):
    return row_counts(tables.load_tables(ctx.spark, ctx.folder))


@check("s2_list_tables", "table_name has_rows", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) > 0 AS has_rows FROM {t}" for t in STAR))
def _(ctx):
    parts = []
    for t in tables.list_tables(ctx.spark, ctx.folder):
        one = tables.load_table(ctx.spark, ctx.folder, t).limit(1).agg(F.count(F.lit(1)).alias("n"))
        parts.append(one.select(F.lit(t).alias("table_name"), (F.col("n") > 0).alias("has_rows")))
    return union_all(parts)


@check("s3_load_table", "o_orderstatus n:i total:f2", "SELECT o_orderstatus, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1")
def _(ctx):
    orders = tables.load_table(ctx.spark, ctx.folder, "orders", mergeSchema="false")
    return orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))


def _round_trip(ctx, df: DataFrame, fmt: str) -> DataFrame:
    folder = scratch_folder(ctx.spark)
    tables.write_tables({"offers": df}, folder, fmt)
    return tables.load_table(ctx.spark, folder, "offers", schema=df.schema)


_OFFERS = "offer_no:i offer_ref:i tier:i rate:f amount:f loan_type outcome:i"
_OFFERS_SQL = "SELECT offer_no, offer_ref, tier, rate, amount, loan_type, outcome FROM loan_offers"


@check("s5_csv_sink", _OFFERS, _OFFERS_SQL)
def _(ctx):
    return _round_trip(ctx, ctx.offers, "csv")


@check("s6_parquet_sink", _OFFERS, _OFFERS_SQL)
def _(ctx):
    return _round_trip(ctx, ctx.offers, "parquet")


@check("s8_head", "l_orderkey:i l_linenumber:i l_partkey:i l_extendedprice:f",
       "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT 3")
def _(ctx):
    return tables.head(ctx.star("lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])


_BRONZE = [t for t in catalog.BRONZE.values()]
_COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n_rows FROM {t}" for t in _BRONZE)


@check("s9_schema_registry", "name layer grain primary_key n_rows:f",
       f"SELECT r.name, r.layer, r.grain, r.primary_key, c.n_rows FROM (VALUES {_rows([(e.name, e.layer, e.grain, e.primary_key) for e in catalog.ENTRIES])}) r(name, layer, grain, primary_key) LEFT JOIN ({_COUNTS}) c ON r.name = c.name")
def _(ctx):
    """The whole catalogue with the current size of the extracts."""
    return counted_registry(ctx.spark, ctx.bronze)


_EDGES = [(e.name, d) for e in catalog.ENTRIES for d in e.downstream]


@check("s10_lineage_edges", "from_table to_table n_rows:f",
       f"SELECT e.a AS from_table, e.b AS to_table, c.n_rows FROM (VALUES {_rows(_EDGES)}) e(a, b) LEFT JOIN ({_COUNTS}) c ON e.a = c.name")
def _(ctx):
    counts = row_counts(ctx.bronze).withColumnRenamed("table_name", "from_table")
    return catalog.lineage_edges(ctx.spark).join(counts, "from_table", "left")


@check("s11_source_system_edges", "source_system bronze_table n_rows:i",
       f"SELECT e.s AS source_system, e.t AS bronze_table, c.n_rows FROM (VALUES {_rows([(e.source_system, e.name) for e in catalog.ENTRIES if e.source_system])}) e(s, t) JOIN ({_COUNTS}) c ON e.t = c.name")
def _(ctx):
    counts = row_counts(ctx.bronze).withColumnRenamed("table_name", "bronze_table")
    return catalog.source_edges(ctx.spark).join(counts, "bronze_table")


def value_counts(known: Mapping[str, DataFrame], fields: Iterable[tuple[str, str]], one_by_one: bool = False) -> DataFrame:
    """(from_table, from_column, n_values) of the fields of known tables; every table is read once, ``one_by_one`` if it takes shuffles."""
    columns: dict[str, list[str]] = {}
    for t, c in dict.fromkeys(fields):
        if t in known:
            columns.setdefault(t, []).append(c)
    parts = []
    for t, names in columns.items():
        cells = F.array(*[F.struct(F.lit(c).alias("from_column"), F.count(c).alias("n_values")) for c in names])
        parts.append(known[t].agg(cells.alias("cells")).select(F.lit(t).alias("from_table"), F.explode("cells").alias("c")).select("from_table", "c.*"))
    return in_turn(parts) if one_by_one else union_all(parts)


_FIELDS = [(*a.split("."), *(b.split(".") + [None])[:2]) for a, b in catalog.FIELD_EDGES]
_KNOWN = " UNION ALL ".join(
    f"SELECT '{t}' AS t, '{c}' AS c, count({c}) AS n FROM {t}" for t, c in dict.fromkeys((r[0], r[1]) for r in _FIELDS) if t.startswith(("bronze_", "silver_", "gold_"))
)


@check("s12_field_lineage", "from_table from_column to_table to_column n_values:f",
       f"SELECT e.a AS from_table, e.b AS from_column, e.c AS to_table, e.d AS to_column, k.n AS n_values FROM (VALUES {_rows(_FIELDS)}) e(a, b, c, d) LEFT JOIN ({_KNOWN}) k ON e.a = k.t AND e.b = k.c")
def _(ctx):
    """All edges with the number of values their source column holds now."""
    known = value_counts({**ctx.bronze, **ctx.key_silver, **ctx.key_gold}, [tuple(a.split(".")) for a, _ in catalog.FIELD_EDGES], one_by_one=True)
    return catalog.field_edges(ctx.spark).join(known, ["from_table", "from_column"], "left")


# --- outcomes of the checks that run before any job, each next to the rows of the table it was made for ------------------

def _outcome(call) -> str:
    try:
        call()
    except Exception as error:  # noqa: BLE001 - the kind of refusal is the result
        return type(error).__name__
    return "accepted"


def _with_counts(ctx, rows: list[tuple], schema: str) -> DataFrame:
    """Rows (table_name, …) with the table's number of rows."""
    counts = row_counts(tables.load_tables(ctx.spark, ctx.folder))
    return ctx.spark.createDataFrame(rows, schema).join(counts, "table_name")


@check("s4_path_checks", "table_name path outcome n_rows:i",
       " UNION ALL ".join(
           f"SELECT '{t}' AS table_name, p AS path, o AS outcome, (SELECT count(*) FROM {t}) AS n_rows FROM (VALUES ('its own', 'accepted'), ('of another name', 'FileNotFoundError'), ('its folder', 'ValueError')) v(p, o)"
           for t in STAR))
def _(ctx):
    """A data file has to exist and to be a file."""
    rows = []
    for t in tables.list_tables(ctx.spark, ctx.folder):
        own = tables.data_file(ctx.spark, f"{ctx.folder}/{t}.parquet")
        paths = {"its own": own, "of another name": f"{ctx.folder}/{t}.missing", "its folder": own.rpartition("/")[0]}
        rows += [(t, name, _outcome(lambda p=p: tables.check_file(ctx.spark, p))) for name, p in paths.items()]
    return _with_counts(ctx, rows, "table_name string, path string, outcome string")


@check("s7_format_checks", "table_name format outcome n_rows:i",
       " UNION ALL ".join(
           f"SELECT '{t}' AS table_name, f AS format, o AS outcome, (SELECT count(*) FROM {t}) AS n_rows FROM (VALUES ('csv', 'accepted'), ('parquet', 'accepted'), ('xlsx', 'ValueError'), ('PARQUET', 'ValueError')) v(f, o)"
           for t in ("region", "orders")))
def _(ctx):
    """An unknown format is refused before anything is written."""
    folder, rows = scratch_folder(ctx.spark), []
    for t in ("region", "orders"):
        own = {t: tables.load_table(ctx.spark, ctx.folder, t).limit(0)}
        rows += [(t, f, _outcome(lambda f=f: tables.write_tables(own, folder, f))) for f in ("csv", "parquet", "xlsx", "PARQUET")]
    return _with_counts(ctx, rows, "table_name string, format string, outcome string")


_NEEDED = {"orders": ["o_orderkey", "o_custkey", "o_margin", "o_totalprice"], "customer": ["c_custkey", "c_name"], "documents": ["doc_id", "text", "quality", "author"]}


@check("p8_required_columns", "table_name outcome n_rows:i",
       " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{o}' AS outcome, count(*) AS n_rows FROM {t}" for t, o in (("orders", "ValueError"), ("customer", "accepted"), ("documents", "ValueError"))))
def _(ctx):
    loaded = tables.load_tables(ctx.spark, ctx.folder)
    rows = [(t, _outcome(lambda t=t: require_columns(loaded[t], _NEEDED[t]))) for t in _NEEDED]
    return _with_counts(ctx, rows, "table_name string, outcome string")


@check("u3_missing_columns", "table_name column_name n_rows:i",
       "SELECT 'orders' AS table_name, 'o_margin' AS column_name, (SELECT count(*) FROM orders) AS n_rows UNION ALL SELECT 'documents', c, (SELECT count(*) FROM documents) FROM (VALUES ('author'), ('quality')) v(c)")
def _(ctx):
    loaded = tables.load_tables(ctx.spark, ctx.folder)
    rows = [(t, c) for t, needed in _NEEDED.items() for c in missing_columns(loaded[t], needed)]
    return _with_counts(ctx, rows, "table_name string, column_name string")


@check("q8_forbidden_columns", "table_name found outcome n_rows:i",
       """SELECT 'orders' AS table_name, 'orders.best_Competitor_rate,orders.competing_bank_id' AS found, 'ValueError' AS outcome, count(*) AS n_rows FROM orders
       UNION ALL SELECT 'customer', '', 'accepted', count(*) FROM customer""")
def _(ctx):
    """Two columns that policy forbids, added to a table, and a table without any."""
    loaded = tables.load_tables(ctx.spark, ctx.folder)
    poor = loaded["orders"].withColumns({"best_Competitor_rate": F.col("o_totalprice"), "competing_bank_id": F.col("o_custkey")})
    given = {"orders": poor, "customer": loaded["customer"]}
    rows = [(t, ",".join(catalog.forbidden_columns({t: df})), _outcome(lambda t=t, df=df: catalog.assert_no_forbidden_columns({t: df}))) for t, df in given.items()]
    return _with_counts(ctx, rows, "table_name string, found string, outcome string")


@check("q12_leakage", "mart column_name n_rows:i",
       """SELECT 'silver_deals' AS mart, c AS column_name, (SELECT count(*) FROM silver_deals) AS n_rows FROM (VALUES ('lost_reason'), ('decision_date'), ('expected_close_date'), ('current_stage')) v(c)
       UNION ALL SELECT 'gold_deal_training_dataset', 'none', count(*) FROM gold_deal_training_dataset""")
def _(ctx):
    """Columns that would give the outcome away: the deal table has them, the training set must not."""
    given = {"silver_deals": ctx.kept_deals, "gold_deal_training_dataset": ctx.gold["gold_deal_training_dataset"]}
    rows = [(t, c) for t, df in given.items() for c in catalog.leakage_columns(df) or ["none"]]
    counts = row_counts(given).withColumnRenamed("table_name", "mart")
    return ctx.spark.createDataFrame(rows, "mart string, column_name string").join(counts, "mart")


@check("m1_feature_split", "feature kind n_known:i",
       "SELECT * FROM (UNPIVOT (SELECT " + ", ".join(f"count({c}) AS {c}" for c in training_features()) + " FROM gold_deal_training_dataset) ON COLUMNS(*) INTO NAME feature VALUE n_known) u JOIN (VALUES "
       + ", ".join(f"('{c}', '{'categorical' if c in LEVEL_FEATURES else 'numeric'}')" for c in training_features()) + ") k(feature, kind) USING (feature)")
def _(ctx):
    """How the features of the training set are treated (flags count as numbers), and how many rows know each."""
    mart = ctx.gold["gold_deal_training_dataset"]
    numeric, _ = split_features(mart, training_features())
    known = mart.agg(*[F.count(c).alias(c) for c in training_features()])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit("numeric" if c in numeric else "categorical").alias("kind"), F.col(c).alias("n_known")) for c in training_features()])
    return known.select(F.explode(cells).alias("c")).select("c.*")
