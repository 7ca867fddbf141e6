import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from lendlens.operators import model


@pytest.fixture(scope="module")
def deals():
    rng = np.random.default_rng(7)
    n = 600
    df = pd.DataFrame({
        "deal_id": [f"D{i:04d}" for i in range(n)],
        "product_type": rng.choice(["RCF", "Term Loan", "Guarantee"], n),
        "rating": rng.choice(["A", "BBB", "BB"], n),
        "tenor_months": rng.choice([12, 24, 36, 60], n).astype(float),
        "margin_above_floor_bps": rng.normal(40, 22, n),
        "watch": rng.random(n) < 0.2,
        "total_expected_profit": rng.normal(50_000, 15_000, n).clip(5_000),
    })
    z = -0.2 + 0.03 * df.margin_above_floor_bps - 0.8 * (df.rating == "BB") + 0.5 * (df["product_type"] == "RCF")
    df["deal_outcome"] = np.where(rng.random(n) < 1 / (1 + np.exp(-z + 1)), "won", "lost")
    df.loc[rng.random(n) < 0.05, "tenor_months"] = np.nan
    df.loc[rng.random(n) < 0.05, "rating"] = None
    return df


@pytest.fixture(scope="module")
def frame(spark, deals):
    rows = deals.astype(object).where(deals.notna(), None).to_records(index=False).tolist()
    return spark.createDataFrame(rows, "deal_id string, product_type string, rating string, tenor_months double, margin_above_floor_bps double, watch boolean, total_expected_profit double, deal_outcome string")


FEATURES = ["product_type", "rating", "tenor_months", "margin_above_floor_bps", "watch"]


def test_feature_split(frame):
    assert model.split_features(frame, FEATURES) == (["tenor_months", "margin_above_floor_bps", "watch"], ["product_type", "rating"])


def test_imputation_is_exact(frame, deals):
    fitted = model.fit_imputation(frame, ["tenor_months", "margin_above_floor_bps"], ["rating"])
    assert fitted.medians["tenor_months"] == deals["tenor_months"].median()
    assert fitted.medians["margin_above_floor_bps"] == pytest.approx(deals["margin_above_floor_bps"].median(), abs=1e-12)
    assert fitted.modes["rating"] == deals["rating"].mode().iloc[0]
    filled = deals["tenor_months"].fillna(deals["tenor_months"].median())
    np.testing.assert_allclose(fitted.scale["tenor_months"], [filled.mean(), filled.std(ddof=0)])


def test_constant_column_scales_by_one(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    assert model.fit_imputation(df, ["x"], []).scale["x"] == (5.0, 1.0)


def test_hash_split_is_stable(frame):
    train, test = model.hash_split(frame, ["deal_id"], 0.25, 42)
    again = model.hash_split(frame.repartition(13), ["deal_id"], 0.25, 42)[1]
    assert {r.deal_id for r in test.collect()} == {r.deal_id for r in again.collect()}
    assert train.count() + test.count() == frame.count() and train.join(test, "deal_id").count() == 0


def test_split_gives_every_class_its_share(frame):
    rare = frame.withColumn("cls", F.when(F.col("deal_id") < "D0021", "rare").otherwise(F.col("deal_outcome")))
    train, test = model.stratified_split(rare, "cls", ["deal_id"], 0.25, 42)
    again = model.stratified_split(rare.repartition(13), "cls", ["deal_id"], 0.25, 42)[1]
    assert {r.deal_id for r in test.collect()} == {r.deal_id for r in again.collect()}
    assert train.count() + test.count() == frame.count() and train.join(test, "deal_id").count() == 0
    shares = {(r.part, r.label): r.n for r in model.split_shares(train, test, "cls").collect()}
    for label in ("won", "lost", "rare"):
        n = shares[("test", label)] + shares[("train", label)]
        assert abs(shares[("test", label)] - 0.25 * n) <= 1


def test_feature_without_values_is_left_out(frame):
    data = frame.withColumn("empty", F.lit(None).cast("double")).withColumn("_label", F.when(F.col("deal_outcome") == "won", 1).otherwise(0))
    with pytest.warns(UserWarning, match="empty"):
        fitted = model.fit_logistic(data, "_label", [*FEATURES, "empty"])
    assert model.add_win_probability(fitted, data).where("win_probability IS NULL").count() == 0
    names = [n for n, _ in model.coefficients(fitted)]
    assert names[0] == "intercept" and "rating=BB" in names and "watch" in names and "empty" not in names


def test_coefficients_match_newton(spark, frame, deals):
    """The same penalised likelihood solved independently with NumPy."""
    data = frame.withColumn("_label", F.when(F.col("deal_outcome") == "won", 1).otherwise(0))
    fitted = model.fit_logistic(data, "_label", FEATURES)
    scored = model.add_win_probability(fitted, data).toPandas().set_index("deal_id").loc[deals["deal_id"]]
    numeric = []
    for c in ("tenor_months", "margin_above_floor_bps", "watch"):
        v = deals[c].astype(float)
        v = v.fillna(v.median())
        numeric.append((v - v.mean()) / v.std(ddof=0))
    dummies = pd.get_dummies(deals[["product_type", "rating"]].fillna({"rating": deals["rating"].mode().iloc[0]})).astype(float)
    x = np.column_stack([np.ones(len(deals)), *numeric, dummies])
    y = (deals["deal_outcome"] == "won").to_numpy(float)
    beta = np.zeros(x.shape[1])
    penalty = np.eye(len(beta))
    penalty[0, 0] = 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + penalty
        beta += np.linalg.lstsq(hessian, x.T @ (y - p) - penalty @ beta, rcond=None)[0]
    np.testing.assert_allclose(scored["win_probability"], 1 / (1 + np.exp(-x @ beta)), atol=2e-4)


def test_training_scoring_and_unseen_level(spark, frame, tmp_path):
    fitted, metrics = model.train_win_model(frame, "deal_outcome", FEATURES, ["deal_id"])
    assert 0.5 < metrics["roc_auc"] <= 1 and 0 < metrics["brier_score"] < 0.3
    flat = dict(model.flat_metrics(metrics))
    assert sum(flat[f"confusion_matrix.{i}.{j}"] for i in (0, 1) for j in (0, 1)) == pytest.approx(frame.count() / 4, abs=2)
    active = frame.limit(50).withColumn("rating", F.lit("CCC")).drop("deal_outcome")
    ranked = model.score_active_deals(fitted, active, ["deal_id"]).orderBy("priority_rank").toPandas()
    assert ranked["priority_rank"].tolist() == list(range(1, 51))
    assert ranked["expected_deal_value"].is_monotonic_decreasing and ranked["win_probability"].between(0, 1).all()
    fitted.write().overwrite().save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    again = model.add_win_probability(loaded, active).agg(F.sum("win_probability")).first()[0]
    assert again == pytest.approx(ranked["win_probability"].sum())


def test_missing_columns_and_bad_labels(spark, frame):
    with pytest.raises(ValueError, match="no_such"):
        model.train_win_model(frame, "deal_outcome", ["no_such"], ["deal_id"])
    with pytest.raises(Exception, match="unexpected deal outcome"):
        model.train_win_model(frame.withColumn("deal_outcome", F.lit("pending")), "deal_outcome", FEATURES, ["deal_id"])


def test_ranking_without_profit_and_top_k(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", None), ("c", 0.9), ("d", 0.5)], "deal_id string, win_probability double")
    got = {r.deal_id: r.priority_rank for r in model.prioritise(df, ["deal_id"]).collect()}
    assert got == {"c": 1, "a": 2, "d": 3, "b": 4}
    assert [r.deal_id for r in model.top_deals(df, 2, ["deal_id"]).collect()] == ["c", "a"]


def test_seeded_sample(frame):
    first = {r.deal_id for r in model.seeded_sample(frame, 8, ["deal_id"], 1).collect()}
    assert first == {r.deal_id for r in model.seeded_sample(frame.repartition(9), 8, ["deal_id"], 1).collect()} and len(first) == 8
    assert first != {r.deal_id for r in model.seeded_sample(frame, 8, ["deal_id"], 2).collect()}


def test_coefficients_are_the_optimum(frame, deals):
    """Against plain Newton steps on the same inputs, and by the certificate of the slopes."""
    data = frame.withColumn("y", (F.col("deal_outcome") == "won").cast("int"))
    fitted = model.fit_logistic(data, "y", FEATURES)
    found = dict(model.coefficients(fitted))
    columns = {"intercept": np.ones(len(deals))}
    for c in ("tenor_months", "margin_above_floor_bps", "watch"):
        x = deals[c].astype(float)
        x = x.fillna(x.median())
        columns[c] = ((x - x.mean()) / x.std(ddof=0)).to_numpy()
    for c in ("product_type", "rating"):
        x = deals[c].fillna(deals[c].mode().iloc[0])
        columns |= {f"{c}={level}": (x == level).to_numpy(float) for level in sorted(x.unique())}
    names = list(columns)
    x, y, beta = np.column_stack(list(columns.values())), (deals.deal_outcome == "won").to_numpy(float), np.zeros(len(names))
    penalty = np.diag([0.0] + [1.0] * (len(names) - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ beta)
    assert set(found) == set(names)
    np.testing.assert_allclose([found[n] for n in names], beta, atol=1e-4)
    slopes = {r.coefficient: r.gradient for r in model.optimum_certificate(fitted, data, "y").collect()}
    assert set(slopes) == set(names) and max(map(abs, slopes.values())) < 1e-6
    moved = model.optimum_certificate(fitted, data.where("margin_above_floor_bps < 40"), "y").collect()
    assert max(abs(r.gradient) for r in moved) > 1e-3  # other rows have another optimum
