"""Model preparation, training, scoring and evaluation M2–M17."""

from pyspark.sql import functions as F

from lendlens.functions.economics import win_label
from lendlens.operators import evaluate, explore, model
from lendlens.operators.dedupe import first_by
from lendlens.operators.ordered import column_modes, column_quantiles
from lendlens.plans import gold
from lendlens.session import settle

from .registry import check, key_hash_sql

FEATURES = [c for c in gold.FEATURES if c not in ("deal_id", "customer_id", "rm_id")]


def _labelled(ctx, marts=None):
    """The training mart, settled because training reads it many times; one row per deal."""
    return settle(first_by((marts or ctx.gold)["gold_deal_training_dataset"].select("deal_id", "deal_outcome", *FEATURES), "deal_id"))


_IMPUTE = ["relationship_revenue_ltm", "deposit_balance_avg", "existing_product_count"]


@check("m2_impute_medians", "column_name median:f",
       " UNION ALL ".join(f"SELECT '{c}' AS column_name, quantile_cont({c}, 0.5) AS median FROM bronze_core_relationship_snapshot" for c in _IMPUTE))
def _(ctx):
    found = column_quantiles(ctx["bronze_core_relationship_snapshot"], _IMPUTE, [0.5])
    return found.select(F.col("series").alias("column_name"), F.col("q0").alias("median"))


@check("m2_impute_modes", "column_name mode_value",
       " UNION ALL ".join(
           f"SELECT * FROM (SELECT '{c}' AS column_name, {c} AS mode_value FROM bronze_risk_assessments WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) {c}_t"
           for c in ("rating_raw", "risk_model_version", "approval_level_raw")))
def _(ctx):
    modes = column_modes(ctx["bronze_risk_assessments"], ["rating_raw", "risk_model_version", "approval_level_raw"])
    return modes.withColumnRenamed("series", "column_name")


@check("m3_standard_scale", "crm_account_id snapshot_month:t z:f",
       """SELECT crm_account_id, snapshot_month, (coalesce(relationship_revenue_ltm, med) - m) / CASE WHEN s = 0 THEN 1 ELSE s END AS z FROM bronze_core_relationship_snapshot,
       (SELECT med, avg(coalesce(relationship_revenue_ltm, med)) AS m, stddev_pop(coalesce(relationship_revenue_ltm, med)) AS s FROM bronze_core_relationship_snapshot,
         (SELECT quantile_cont(relationship_revenue_ltm, 0.5) AS med FROM bronze_core_relationship_snapshot) a GROUP BY med) b""")
def _(ctx):
    snapshots = ctx["bronze_core_relationship_snapshot"]
    fitted = model.fit_imputation(snapshots, ["relationship_revenue_ltm"], [])
    return model.preparation_stage(fitted).transform(snapshots).withColumnRenamed("_num_relationship_revenue_ltm", "z")


@check("m4_one_hot", "deal_id slots:i", "SELECT deal_id, CASE WHEN current_stage = 'Negotiation' THEN 0 ELSE 1 END AS slots FROM silver_deals")
def _(ctx):
    """Encode levels learned on one part of the deals; a level unseen there gets no slot."""
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    deals = ctx.deals.select("deal_id", F.coalesce("current_stage", F.lit("")).alias("_cat_stage"))
    fitted = Pipeline(stages=model.one_hot_stages(["stage"])).fit(deals.where("_cat_stage <> 'Negotiation'"))
    slots = F.aggregate(vector_to_array("_hot_stage"), F.lit(0.0), lambda a, x: a + x)
    return fitted.transform(deals).select("deal_id", slots.alias("slots"))


@check("m5_split", "part label:i n:i",
       f"""SELECT CASE WHEN r <= round(n * 0.25) THEN 'test' ELSE 'train' END AS part, label, count(*) AS n FROM (
         SELECT label, rank() OVER (PARTITION BY label ORDER BY h) AS r, count(*) OVER (PARTITION BY label) AS n FROM (
           SELECT CASE deal_outcome WHEN 'won' THEN 1 ELSE 0 END AS label, {key_hash_sql('42', 'deal_id')} AS h FROM silver_deals WHERE deal_outcome IS NOT NULL) d) x GROUP BY 1, 2""")
def _(ctx):
    data = settle(ctx.deals.where("deal_outcome IS NOT NULL").select("deal_id", win_label("deal_outcome").alias("label")))
    return model.split_shares(*model.stratified_split(data, "label", ["deal_id"], 0.25, 42), "label")


@check("m6_logistic_regression", "coefficient value:f2")
def _(ctx):
    """The intercept and every coefficient by the name of its feature and level."""
    data = _labelled(ctx).withColumn("_label", win_label("deal_outcome"))
    return ctx.spark.createDataFrame(model.coefficients(model.fit_logistic(data, "_label", FEATURES)), "coefficient string, value double")


_LEVELS = ["customer_segment", "industry", "region", "rating_at_offer", "anchor_product"]


@check("m6_optimum", "coefficient at_optimum",
       "SELECT coefficient, true AS at_optimum FROM (VALUES ('intercept'), " + ", ".join(f"('{c}')" for c in FEATURES if c not in _LEVELS) + ") v(coefficient)"
       + "".join(f" UNION ALL SELECT DISTINCT '{c}=' || {c}, true FROM gold_deal_training_dataset WHERE {c} IS NOT NULL" for c in _LEVELS))
def _(ctx):
    """Whether the fitted coefficients are the optimum: no slope of the penalised mean loss reaches a millionth."""
    data = settle(_labelled(ctx).withColumn("_label", win_label("deal_outcome")))
    slopes = model.optimum_certificate(model.fit_logistic(data, "_label", FEATURES), data, "_label")
    return slopes.select("coefficient", (F.abs("gradient") < 1e-6).alias("at_optimum"))


@check("m7_train_pipeline", "metric value:f4")
def _(ctx):
    _, metrics = model.train_win_model(_labelled(ctx), "deal_outcome", FEATURES, ["deal_id"])
    return ctx.spark.createDataFrame(list(model.flat_metrics(metrics)), "metric string, value double")


@check("m8_score_active", "deal_id win_probability:f expected_deal_value:f4 priority_rank:i")
def _(ctx):
    fitted, _ = model.train_win_model(_labelled(ctx, ctx.shared_gold), "deal_outcome", FEATURES, ["deal_id"])
    active = first_by(ctx.shared_gold["gold_active_deal_scoring_dataset"].select("deal_id", *FEATURES), "deal_id")
    slim = active.withColumn("total_expected_profit", F.col("total_expected_profit_lifetime"))
    return model.score_active_deals(fitted, slim, ["deal_id"])


@check("m8_score_fixed_coefficients", "deal_id win_probability:f expected_deal_value:f4 priority_rank:i",
       """SELECT deal_id, win_probability, expected_deal_value, row_number() OVER (ORDER BY expected_deal_value DESC NULLS LAST, win_probability DESC NULLS LAST, deal_id) AS priority_rank
       FROM (SELECT deal_id, p AS win_probability, p * total_expected_profit_lifetime AS expected_deal_value
         FROM (SELECT DISTINCT deal_id, total_expected_profit_lifetime, 1 / (1 + exp(-(0.25 - 0.014 * coalesce(min_margin_above_floor_bps, 55) - 0.12 * number_of_facilities))) AS p FROM gold_active_deal_scoring_dataset) s) t""")
def _(ctx):
    slim = ctx.lazy_features.where("deal_status = 'active'").select("deal_id", "min_margin_above_floor_bps", "number_of_facilities", "total_expected_profit_lifetime")
    active = first_by(slim, "deal_id")
    logit = F.lit(0.25) - 0.014 * F.coalesce("min_margin_above_floor_bps", F.lit(55.0)) - 0.12 * F.col("number_of_facilities")
    scored = active.select("deal_id", F.col("total_expected_profit_lifetime").alias("total_expected_profit"), (1 / (1 + F.exp(-logit))).alias("win_probability"))
    return model.prioritise(scored, ["deal_id"])


@check("m9_brier_score", "brier_score:f", "SELECT avg((p - y) * (p - y)) AS brier_score FROM scored_deals")
def _(ctx):
    return evaluate.brier_score(ctx.scored, "y", "p")


@check("m10_confusion_matrix", "tn:i fp:i fn:i tp:i",
       "SELECT count(*) FILTER (y = 0 AND p < 0.5) AS tn, count(*) FILTER (y = 0 AND p >= 0.5) AS fp, count(*) FILTER (y = 1 AND p < 0.5) AS fn, count(*) FILTER (y = 1 AND p >= 0.5) AS tp FROM scored_deals")
def _(ctx):
    return evaluate.confusion_matrix(ctx.scored, "y", "p")


@check("m11_roc_auc", "roc_auc:f",
       """SELECT (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS roc_auc
       FROM (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM scored_deals) x""")
def _(ctx):
    return evaluate.roc_auc(ctx.scored, "y", "p")


@check("m12_average_precision", "pr_auc:f",
       """SELECT sum((tp - coalesce(prev, 0)) / total * tp / n) AS pr_auc FROM (
         SELECT *, lag(tp) OVER (ORDER BY p DESC) AS prev FROM (
           SELECT p, sum(sum(y)) OVER (ORDER BY p DESC) AS tp, sum(count(*)) OVER (ORDER BY p DESC) AS n, sum(sum(y)) OVER () AS total FROM scored_deals GROUP BY p) a) b""")
def _(ctx):
    return evaluate.average_precision(ctx.scored, "y", "p")


@check("m13_decile_lift", "decile:i n_deals:i observed_rate:f avg_probability:f lift:f",
       """SELECT decile, count(*) AS n_deals, avg(y) AS observed_rate, avg(p) AS avg_probability, avg(y) / max(base) AS lift FROM (
         SELECT y, p, avg(y) OVER () AS base, greatest(1, ceil((row_number() OVER (ORDER BY p DESC, deal_no) - 1) * 10 / (count(*) OVER () - 1))) AS decile FROM scored_deals) x GROUP BY decile""")
def _(ctx):
    return evaluate.decile_lift(ctx.scored, "y", "p", ["deal_no"])


@check("m14_calibration", "bin:i n_deals:i mean_predicted_probability:f observed_win_rate:f",
       """SELECT bin, count(*) AS n_deals, avg(p) AS mean_predicted_probability, avg(y) AS observed_win_rate FROM (
         SELECT y, p, greatest(CAST(ceil(round(p * 10, 9)) AS INT) - 1, 0) AS bin FROM scored_deals) x GROUP BY bin""")
def _(ctx):
    return evaluate.calibration_table(ctx.scored, "y", "p")


@check("m15_roc_curve", "threshold:f fpr:f tpr:f",
       """SELECT p AS threshold, sum(sum(1 - y)) OVER (ORDER BY p DESC) / sum(sum(1 - y)) OVER () AS fpr, sum(sum(y)) OVER (ORDER BY p DESC) / sum(sum(y)) OVER () AS tpr FROM scored_deals GROUP BY p
       UNION ALL SELECT NULL, 0, 0""")
def _(ctx):
    curve = evaluate.roc_curve(ctx.scored, "y", "p")
    return curve.withColumn("threshold", F.when(F.col("threshold") < float("inf"), F.col("threshold")))


@check("m16_rmse", "rmse:f", "SELECT sqrt(avg((p - y) * (p - y))) AS rmse FROM scored_deals")
def _(ctx):
    return evaluate.rmse(ctx.scored, "y", "p")


_BASELINE = """(SELECT o.outcome AS y, b.rate AS p FROM loan_offers o JOIN (SELECT tier, avg(outcome) AS rate FROM loan_offers WHERE offer_no % 5 <> 0 GROUP BY tier) b
  ON o.tier = b.tier WHERE o.offer_no % 5 = 0)"""


@check("m17_tier_baseline", "rmse:f roc_auc:f",
       f"""SELECT sqrt(avg((p - y) * (p - y))) AS rmse,
         (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS roc_auc
       FROM (SELECT y, p, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM {_BASELINE} q) x""")
def _(ctx):
    scored = evaluate.tier_rate_baseline(ctx.offers.where("offer_no % 5 <> 0"), ctx.offers.where("offer_no % 5 = 0"))
    auc = evaluate.roc_auc(scored, "outcome", "baseline_probability").first()[0]
    return evaluate.rmse(scored, "outcome", "baseline_probability").withColumn("roc_auc", F.lit(auc).cast("double"))
