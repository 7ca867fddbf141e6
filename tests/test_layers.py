"""Invariants of the layers on the small folder."""

from pyspark.sql import functions as F

from lendlens.checks.sources import value_counts
from lendlens.operators import quality
from lendlens.operators.quality import key_violations, orphans, reference_violations
from lendlens.plans import gold as G
from lendlens.plans import silver as V
from lendlens.plans.pipeline import read_run, run_pipeline
from lendlens.session import settle
from lendlens.sources.catalog import BRONZE, GOLD, SILVER, leakage_columns


def test_all_tables_exist(layers):
    bronze, silver, gold = layers
    assert set(bronze) == set(BRONZE.values()) and set(silver) == set(SILVER.values()) and set(gold) == set(GOLD.values())


def test_silver_keys(layers):
    _, silver, _ = layers
    customers, deals, facilities = (silver[SILVER[t]] for t in ("customers", "deals", "facilities"))
    assert customers.count() == customers.select("customer_id").distinct().count()
    assert orphans(facilities, deals, "deal_id").count() == 0
    assert orphans(silver[SILVER["pricing_cases"]], facilities, "facility_id").count() == 0


def test_outcomes(layers):
    deals = layers[1][SILVER["deals"]]
    assert deals.where("deal_status = 'active' AND deal_outcome IS NOT NULL").count() == 0
    closed = deals.where("deal_status IN ('closed_won', 'closed_lost') AND commercial_relevance_flag")
    assert closed.where("deal_outcome IS NULL OR deal_outcome NOT IN ('won', 'lost')").count() == 0


def test_one_final_quote_per_facility(layers):
    pricing = layers[1][SILVER["pricing_cases"]]
    finals = pricing.where("is_final_quote").groupBy("facility_id").count()
    assert finals.where("count <> 1").count() == 0
    assert finals.count() == pricing.select("facility_id").distinct().count()


def test_gold(layers):
    _, silver, gold = layers
    training, active = gold[GOLD["deal_training_dataset"]], gold[GOLD["active_deal_scoring_dataset"]]
    assert training.count() > 0 and {r[0] for r in training.select("deal_outcome").distinct().collect()} == {"won", "lost"}
    assert "deal_outcome" not in active.columns and leakage_columns(training) == []
    assert leakage_columns(active) == ["expected_close_date", "current_stage"]
    econ = gold[GOLD["deal_economics"]]
    assert econ.count() == econ.select("deal_id").distinct().count()
    assert econ.where("deal_complexity_score NOT BETWEEN 0 AND 1").count() == 0
    assert {"expected_facility_profit_annual", "expected_facility_profit_lifetime"} <= set(gold[GOLD["facility_economics"]].columns)
    assert len(G.FEATURES) == 26 and training.columns == [*G.FEATURES, "deal_outcome"]


def test_repeated_deals_are_reported(layers):
    bronze, silver, gold = layers
    found = {r.table_name: r.surplus_rows for r in key_violations({**bronze, **silver}).collect()}
    assert found["silver_customers"] == 0 and found["silver_deals"] > 0 and found["bronze_los_facilities"] > 0
    lost = {(r.table_name, r.foreign_key): r.orphan_rows for r in reference_violations({**bronze, **silver, **gold}).collect()}
    assert lost[("silver_facilities", "deal_id")] == 0 and lost[("silver_deals", "customer_id")] > 0


def test_missing_manager_still_matches(layers):
    _, silver, gold = layers
    without = silver[SILVER["deals"]].where("rm_id IS NULL AND deal_status = 'active'").select("deal_id")
    priced = gold[GOLD["deal_economics"]].join(without, "deal_id", "left_semi").count()
    shown = gold[GOLD["rm_deal_dashboard"]].where("rm_id IS NULL").select("deal_id").distinct().count()
    assert priced > 0 and shown == priced


def test_row_order_does_not_matter(spark, context):
    raw = context["bronze_los_facilities"]
    deals = context.deals
    results = []
    for parts in (1, 7, 64):
        shuffled = raw.repartition(parts, F.rand(parts))
        rows = V.facilities(shuffled, deals).select("facility_id", "commitment_amount", "expected_utilization", "product_type")
        results.append(rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64("*").cast("decimal(38,0)"))).first())
    assert results[0] == results[1] == results[2]


def test_pipeline_round_trip(spark, context, tmp_path):
    bronze = {name: df.limit(200) if name == BRONZE["rm_activities"] else df for name, df in context.bronze.items()}
    run = run_pipeline(spark, bronze, str(tmp_path / "out"))
    counts = {r.item: r.value for r in run.summary.collect()}
    assert counts["gold_deal_training_dataset"] > 0 and counts["warning_share"] == 0.0 and len(counts) == 22
    again = read_run(spark, str(tmp_path / "out"), "gold")
    assert set(again) == set(GOLD.values())
    assert again[GOLD["rm_deal_dashboard"]].count() == counts["gold_rm_deal_dashboard"]


def test_kept_marts_are_cut_from_features_written_once(layers, monkeypatch):
    written = []

    def settled(df):
        written.append(set(df.columns))
        return df

    monkeypatch.setattr(G, "settle", settled)
    gold = G.build_gold(layers[1], keep=lambda name, df: layers[2][name])
    for mart in ("deal_training_dataset", "active_deal_scoring_dataset", "rm_deal_dashboard"):
        assert gold[GOLD[mart]] is layers[2][GOLD[mart]]
    assert sum({*G.FEATURES, "deal_outcome", "current_stage"} <= columns for columns in written) == 1


def test_queries_over_all_layers_share_what_marts_have_in_common(context):
    plans = [context.whole_gold[GOLD[mart]]._jdf.queryExecution().optimizedPlan().toString() for mart in ("deal_training_dataset", "rm_deal_dashboard")]
    plans.append(context.whole_silver[SILVER["pricing_cases"]]._jdf.queryExecution().optimizedPlan().toString())
    assert all("Join" not in p and p.count("Relation") == 1 for p in plans)


def test_values_of_a_table_are_counted_in_one_pass(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, 5, None), (None, None, "y")], "a int, b int, c string").repartition(2)
    found = value_counts({"t": df}, [("t", "a"), ("t", "b"), ("t", "c"), ("t", "a"), ("unknown", "a")])
    assert sorted(map(tuple, found.collect())) == [("t", "a", 2), ("t", "b", 1), ("t", "c", 2)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_facilities_for_the_marts_shuffle_only_what_is_read(spark, context):
    raw = context["bronze_los_facilities"]
    changed = raw.where("facility_sequence_no = 1").withColumns({"tenor_months": F.lit(7), "repayment_type_raw": F.lit("zz"), "covenant_package_raw": F.lit("a")})
    raw = raw.unionByName(raw).unionByName(changed)  # equal extract times that differ in wanted and in other columns
    for columns in (V.FACILITY_KEYS, [*V.FACILITY_KEYS, *V.FACILITY_MEASURES]):
        few, whole = V.facilities(raw, context.deals, columns), V.facilities(raw, context.deals).select(*columns)
        assert few.exceptAll(whole).count() == whole.exceptAll(few).count() == 0 and few.count() > 100
        plan = few._jdf.queryExecution().optimizedPlan().toString()
        assert "covenant_package_raw" not in plan and "repayment_type_raw" not in plan
        assert ("product_type_raw" in plan) == ("product_type" in columns)


def test_deal_totals_deal_out_rows_once(spark):
    rows = [("D1", "F1", "RCF", 10.0), ("D1", "F2", "Guarantee", 5.0), ("D1", "F2", "Guarantee", 1.0), ("D2", "F3", "Term Loan", None), (None, "F4", "RCF", 3.0)]
    table = spark.createDataFrame(rows, "deal_id string, facility_id string, product_type string, commitment_amount double").repartition(3).withColumns(
        {c: F.lit(2.0) for c in G.DEAL_INPUTS if c not in ("deal_id", "facility_id", "product_type", "commitment_amount", "pricing_zone")}
    ).withColumns({"pricing_zone": F.when(F.col("product_type") == "RCF", "Stretch").otherwise("Red"), "unread": F.lit("wide")})
    totals = G.deal_totals(table)
    got = {r.deal_id: (r.anchor_product, r.number_of_facilities, r.total_commitment, r.worst_facility_pricing_zone, r.has_rcf) for r in totals.collect()}
    assert got == {"D1": ("Guarantee", 2, 16.0, "Red", True), "D2": ("Term Loan", 1, 0.0, "Red", False)}
    plan = totals._jdf.queryExecution().executedPlan().toString()
    by_deal = [line for line in plan.split("== Initial Plan ==")[-1].splitlines() if "Exchange hashpartitioning(deal_id" in line]
    assert len(by_deal) == 1 and "REPARTITION" in by_deal[0]


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    return [line for line in plan.splitlines() if "Exchange" in line]


def test_final_quotes_for_the_marts_are_dealt_out_once(spark, context):
    """The same rows as the flagged quotes, for raw ids that stand for one facility, repeated quotes and deals and missing ids, too."""
    keys = context.kept_facilities.select(*V.FACILITY_KEYS)
    other = keys.withColumn("facility_source_id", F.concat(F.lit("X-"), "facility_source_id"))  # a second raw id of each facility
    keys = keys.unionByName(other).unionByName(keys.limit(20))
    raw = context["bronze_pricing_quotes"]
    late = raw.where("quote_version = 1").withColumns({
        "facility_source_id": F.concat(F.lit("X-"), "facility_source_id"), "quote_version": F.lit(7), "quote_id": F.concat("quote_id", F.lit("x"))})
    none = raw.limit(30).withColumn("facility_source_id", F.lit(None).cast("string"))
    quotes = raw.unionByName(late).unionByName(late.limit(10)).unionByName(none)
    finals = V.final_pricing_cases(quotes, keys)
    want = V.pricing_cases(quotes, keys).where("is_final_quote")
    assert finals.exceptAll(want).count() == want.exceptAll(finals).count() == 0 and finals.where("quote_version = 7").count() > 100
    dealt = [line for line in _exchanges(V.final_pricing_cases(context["bronze_pricing_quotes"], settle(keys))) if "facility" in line]
    assert len(dealt) <= 2 and all("REPARTITION" in line or "Broadcast" in line for line in dealt)


def test_risk_by_deal_shuffles_no_buffers(spark):
    risk = spark.createDataFrame([("D1", "F1", "A", 0.1, 0.4), ("D1", "F2", "B", None, 0.2), ("D2", "F3", "B", 0.3, None), (None, "F4", "A", 0.5, 0.5)],
                                 "deal_id string, facility_id string, rating string, pd double, lgd double").repartition(3)
    economics = spark.createDataFrame([("D1", "F1", 30.0), ("D1", "F2", 10.0), ("D2", "F9", 5.0)], "deal_id string, facility_id string, expected_utilized_volume double").repartition(2)
    found = G.risk_by_deal(risk, economics)
    got = {r.deal_id: (r.rating_at_offer, round(r.pd_at_offer, 9), r.lgd_weighted) for r in found.collect()}
    assert got == {"D1": ("A", 0.1, 0.35), "D2": ("B", 0.3, None)}
    assert all("REPARTITION" in line for line in _exchanges(found) if "hashpartitioning(deal_id" in line)


def test_marts_score_the_newest_snapshots_alone(context):
    few, whole = (s[SILVER["relationship_snapshots"]] for s in (context.mart_silver, context.silver))
    assert 0 < few.count() * 6 < whole.count()
    score = ["customer_id", "relationship_strength_score", "existing_product_count", "days_since_last_contact"]
    a, b = (G.latest_relationship(s).select(*score) for s in (few, whole))
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def _recorded(monkeypatch):
    """The frames that quality reports settle, in order."""
    frames, own = [], quality.settle
    monkeypatch.setattr(quality, "settle", lambda df: frames.append(df) or own(df))
    return frames


def test_references_are_checked_one_target_after_the_other(spark, monkeypatch):
    long = "AP-" + "0" * 60  # longer than the keys that are shuffled as they are
    texts = [F.sha2(F.lit(long), 256), F.lit(long)]
    applications = spark.createDataFrame([("A1", "O1", "C1"), ("A1", "O2", None), (long, "O9", "C2"), (None, None, "C9")], "application_id string, opportunity_id string, applicant_account_ref string")
    facilities = spark.createDataFrame([("F1", "A1"), ("F1", "A2"), ("F2", long), (None, long + "1"), ("F3", None)], "facility_source_id string, application_id string")
    quotes = spark.range(3).select(F.lit("F1").alias("facility_source_id"), texts[0].alias("application_id")).unionByName(
        spark.range(2).select(F.lit("F9").alias("facility_source_id"), texts[1].alias("application_id"))
    )
    tables = {
        "bronze_crm_accounts": spark.createDataFrame([("C1",), ("C1",), (None,)], "crm_account_id string"),
        "bronze_crm_opportunities": spark.createDataFrame([("O1", "C1"), ("O2", "C7"), ("O3", "C7")], "opportunity_id string, crm_account_id string"),
        "bronze_los_applications": applications, "bronze_los_facilities": facilities, "bronze_pricing_quotes": quotes,
    }
    frames = _recorded(monkeypatch)
    found = {(r.table_name, r.foreign_key): (r.target, r.orphan_rows) for r in reference_violations(tables).collect()}
    assert found == {
        ("bronze_crm_opportunities", "crm_account_id"): ("bronze_crm_accounts.crm_account_id", 2),
        ("bronze_los_applications", "opportunity_id"): ("bronze_crm_opportunities.opportunity_id", 1),
        ("bronze_los_applications", "applicant_account_ref"): ("bronze_crm_accounts.crm_account_id", 2),
        ("bronze_los_facilities", "application_id"): ("bronze_los_applications.application_id", 2),
        ("bronze_pricing_quotes", "application_id"): ("bronze_los_applications.application_id", 3),
        ("bronze_pricing_quotes", "facility_source_id"): ("bronze_los_facilities.facility_source_id", 2),
    }
    assert len(frames) == len({target for target, _ in found.values()}) == 4
    empty = {t: df.limit(0) for t, df in tables.items()}
    assert {r.orphan_rows for r in reference_violations(empty).collect()} == {0}


def test_layer_reports_compute_one_table_after_the_other(spark, monkeypatch):
    accounts = spark.createDataFrame([("C1", "x"), ("C1", None), (None, None), (None, "y"), ("C2", "z")], "crm_account_id string, region_raw string")
    deals = spark.createDataFrame([("D1",), ("D2",)], "deal_id string")
    frames = _recorded(monkeypatch)
    found = {tuple(r) for r in key_violations({"bronze_crm_accounts": accounts, "silver_deals": deals}).collect()}
    assert found == {("bronze_crm_accounts", "crm_account_id", 2, 2), ("silver_deals", "deal_id", 0, 0)} and len(frames) == 2
    counts = quality.row_counts({"a": accounts, "d": deals}, one_by_one=True)
    assert {tuple(r) for r in counts.collect()} == {("a", 5), ("d", 2)} and len(frames) == 4
    assert {tuple(r) for r in quality.row_counts({"a": accounts, "d": deals}).collect()} == {("a", 5), ("d", 2)} and len(frames) == 4


def _dealt(df):
    """What the frame deals out by facility: the columns of the rows behind each exchange that it asks for."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return [b for a, b in zip(lines, lines[1:]) if "RepartitionByExpression" in a]


def test_quotes_and_risk_are_dealt_out_as_narrow_rows(context):
    facilities = context.facility_keys
    final = V.final_pricing_cases(context["bronze_pricing_quotes"], facilities).where("is_final_quote").select(*G.QUOTE_INPUTS)
    risk = V.risk_assessments(context["bronze_risk_assessments"], facilities).select(*G.RISK_INPUTS)
    for df, gone in ((final, ["quote_status_raw AS", "__facility"]), (risk, ["pd_raw#", "lgd_raw#", "rating_raw#", "__facility"])):
        rows = _dealt(df)
        assert len(rows) == 2  # the raw rows and the keys
        outputs = [part.rpartition(" AS ")[2] for line in rows for part in line.split(", ")]
        assert not [c for c in outputs if c.startswith(tuple(g.removesuffix(" AS") for g in gone))], rows


def test_pricing_cases_for_many_layers_are_the_same_rows(spark, context):
    quotes = context["bronze_pricing_quotes"]
    odd = quotes.where("quote_version = 1").limit(300)
    more = odd.withColumns({"quote_version": F.lit(None).cast("int"), "quote_status_raw": F.lit(None).cast("string")}).unionByName(
        odd.withColumns({"quote_id": F.lit(None).cast("string"), "quote_status_raw": F.lit("APPROVED")})
    ).unionByName(odd.withColumn("facility_source_id", F.lit(None).cast("string")))
    quotes = quotes.unionByName(odd).unionByName(more)  # equal rows, missing versions, ids and statuses
    facilities = context.facility_keys
    other = facilities.limit(200).withColumn("facility_source_id", F.concat(F.lit("x"), "facility_source_id"))  # a second raw id of a facility
    quotes = quotes.unionByName(quotes.limit(500).withColumn("facility_source_id", F.concat(F.lit("x"), "facility_source_id")))
    facilities = facilities.unionByName(other)
    plain, dealt = V.pricing_cases(quotes, facilities), V.dealt_pricing_cases(quotes, facilities)
    assert plain.exceptAll(dealt).count() == dealt.exceptAll(plain).count() == 0 and dealt.count() > 5000
    final = V.final_pricing_cases(quotes, facilities)
    assert final.exceptAll(plain.where("is_final_quote")).count() == plain.where("is_final_quote").exceptAll(final).count() == 0


def test_narrow_layers_have_the_rows_of_whole_ones(context):
    for table in ("silver_facilities", "silver_pricing_cases", "silver_risk_assessments"):
        narrow, whole = context.key_silver[table], context.whole_silver[table]
        assert set(narrow.columns) < set(whole.columns)
        assert narrow.exceptAll(whole.select(*narrow.columns)).count() == whole.select(*narrow.columns).exceptAll(narrow).count() == 0
    for table in GOLD.values():
        narrow, whole = context.key_gold[table], context.whole_gold[table]
        rounded = [[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in narrow.dtypes]] * 2
        a, b = (df.select(*cols) for df, cols in zip((narrow, whole), rounded))
        assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0, table
        assert context.shared_gold[table].count() == whole.count()
