import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lendlens.operators import acceptance, explore


@pytest.fixture(scope="module")
def offers():
    rng = np.random.default_rng(11)
    n = 2000
    df = pd.DataFrame({"id": np.arange(n), "tier": rng.integers(1, 5, n), "rate": rng.uniform(0.01, 0.12, n), "amount": rng.uniform(2_000, 60_000, n),
                       "cost_of_funds": rng.uniform(0.005, 0.03, n)})
    z = -0.5 - 12 * (df.rate - 0.06) - (df.amount - 30_000) / 20_000
    df["outcome"] = (rng.random(n) < 1 / (1 + np.exp(-z))).astype(int)
    return df


@pytest.fixture(scope="module")
def frame(spark, offers):
    return spark.createDataFrame(offers)


def test_posterior_mode_matches_numpy(spark, frame, offers):
    stats = explore.standard_stats(frame, ["rate", "amount"])
    assert stats["rate"] == (pytest.approx(offers.rate.mean()), pytest.approx(offers.rate.std()))
    fitted = acceptance.fit_posterior(explore.standardize(frame, stats), ["rate_std", "amount_std"], "outcome", 1.0)
    x = np.column_stack([np.ones(len(offers)), (offers.rate - offers.rate.mean()) / offers.rate.std(), (offers.amount - offers.amount.mean()) / offers.amount.std()])
    beta = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ beta))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + np.eye(3)
        beta += np.linalg.solve(hessian, x.T @ (offers.outcome - p) - beta)
    np.testing.assert_allclose(fitted.mean, beta, atol=1e-9)
    np.testing.assert_allclose(fitted.cov, np.linalg.inv(hessian), atol=1e-9)
    assert fitted.iterations < 10
    table = {r.parameter: r.sd for r in acceptance.posterior_table(spark, fitted).collect()}
    assert table["beta_1"] == pytest.approx(np.sqrt(np.linalg.inv(hessian)[1, 1]))


POSTERIOR = acceptance.Posterior(["beta_0", "beta_1", "beta_2"], [-1.0, -0.5, -0.8], [[0.04, 0.01, 0.0], [0.01, 0.09, 0.02], [0.0, 0.02, 0.01]], 5)
STATS = {"rate": (0.06, 0.03), "amount": (30_000.0, 16_000.0)}


def test_draws_have_the_posterior_moments(spark):
    draws = acceptance.draw_posterior(spark, POSTERIOR, 5000).toPandas()
    cols = draws[POSTERIOR.names]
    np.testing.assert_allclose(cols.mean(), POSTERIOR.mean, atol=0.02)
    np.testing.assert_allclose(cols.cov().to_numpy(), POSTERIOR.cov, atol=0.01)
    free = acceptance.draw_posterior(spark, POSTERIOR, 5000, independent=True).toPandas()
    assert abs(free["beta_1"].corr(free["beta_2"])) < 0.05
    again = acceptance.draw_posterior(spark, POSTERIOR, 5000).toPandas()
    pd.testing.assert_frame_equal(draws, again)
    assert acceptance.draw_posterior(spark, POSTERIOR, 50_000).count() == 50_000


def test_resampling_keeps_rows_joint(spark):
    draws = acceptance.draw_posterior(spark, POSTERIOR, 30)
    rows = {tuple(r) for r in draws.select(*POSTERIOR.names).collect()}
    picked = acceptance.resample_draws(draws, 100, seed=2)
    assert picked.count() == 100 and {tuple(r) for r in picked.select(*POSTERIOR.names).collect()} <= rows
    mixed = {tuple(r) for r in acceptance.resample_draws(draws, 100, seed=2, independent=True).select(*POSTERIOR.names).collect()}
    assert not mixed <= rows


def test_posterior_predictive(spark, frame, offers):
    draws = acceptance.draw_posterior(spark, POSTERIOR, 40)
    got = acceptance.posterior_predictive(explore.standardize(frame, STATS), draws, ["rate_std", "amount_std"]).toPandas().sort_values("id")
    b = draws.toPandas()[POSTERIOR.names].to_numpy()
    z = b[:, 0] + np.outer((offers.rate - 0.06) / 0.03, b[:, 1]) + np.outer((offers.amount - 30_000) / 16_000, b[:, 2])
    np.testing.assert_allclose(got["acceptance_probability"], (1 / (1 + np.exp(-z))).mean(axis=1), atol=1e-12)
    plan = acceptance.posterior_predictive(frame, draws, ["rate", "amount"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


def test_many_draws_keep_the_plan_small(spark, frame):
    draws = acceptance.draw_posterior(spark, POSTERIOR, 30_000)
    plan = acceptance.posterior_predictive(frame, draws, ["rate", "amount"])._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000


def test_no_verdict_without_convergence(spark, frame):
    with pytest.raises(RuntimeError):
        acceptance.fit_posterior(frame, ["rate"], "outcome", 1.0, max_iter=1)


def test_expectation_by_price(spark, frame, offers):
    draws = spark.createDataFrame([(0, -1.0, -3.0), (1, 0.5, -9.0)], "draw_id int, beta_0 double, beta_1 double")
    got = acceptance.predictive_by_price(frame, draws, "rate").toPandas()
    assert (got.groupby("draw_id")["n"].sum() == len(offers)).all()
    for d, b0, b1 in ((0, -1.0, -3.0), (1, 0.5, -9.0)):
        p = 1 / (1 + np.exp(-(b0 + b1 * offers.rate)))
        assert got[got.draw_id == d]["expected_accepted"].sum() == pytest.approx(p.sum())


def test_price_chain(frame):
    got = {r.goal: r for r in acceptance.price_chain(frame, n_draws=100).collect()}
    assert got["revenue"].expected_revenue >= got["profit"].expected_revenue and got["profit"].expected_profit >= got["revenue"].expected_profit
    assert got["profit"].n_loans == frame.count()


def test_one_curve_per_draw(spark):
    draws = acceptance.draw_posterior(spark, POSTERIOR, 20)
    curves = acceptance.loan_curves(draws, STATS, "profit", 25_000.0, 0.015).toPandas()
    band = acceptance.loan_curve(draws, STATS, "profit", 25_000.0, 0.015).toPandas().set_index("rate")
    assert len(curves) == 20 * 30
    np.testing.assert_allclose(curves.groupby("rate")["expected_profit"].mean(), band.sort_index()["expected_profit_mean"])
    assert acceptance.acceptance_curves(draws).count() == 20 * 15 and acceptance.target_prices(draws, STATS).count() == 20 * 8


def test_target_price_reaches_target(spark):
    draws = spark.createDataFrame([(0, -1.0, -0.5, -0.8)], "draw_id int, beta_0 double, beta_1 double, beta_2 double")
    for r in acceptance.target_price(draws, STATS).collect():
        z = -1.0 - 0.5 * (r.target_rate - 0.06) / 0.03 - 0.8 * (r.amount - 30_000) / 16_000
        assert 1 / (1 + np.exp(-z)) == pytest.approx(0.2) and r.target_rate_low == pytest.approx(r.target_rate)


def test_loan_curves(spark):
    draws = spark.createDataFrame([(0, -1.0, -0.5, -0.8), (1, -1.2, -0.4, -0.8)], "draw_id int, beta_0 double, beta_1 double, beta_2 double")
    profit = acceptance.loan_curve(draws, STATS, "profit", 25_000.0, 0.015).toPandas().set_index("rate")
    revenue = acceptance.loan_curve(draws, STATS, "revenue", 25_000.0, 0.015).toPandas().set_index("rate")
    p = 1 / (1 + np.exp(1.1 + 0.45 * (0.1 - 0.06) / 0.03 + 0.8 * (25_000 - 30_000) / 16_000))
    assert profit.loc[0.1, "expected_profit"] == pytest.approx(25_000 * 0.085 * p)
    assert revenue.loc[0.1, "expected_revenue"] == pytest.approx(25_000 * 0.1 * p)
    assert len(profit) == 30 and (profit["expected_profit_low"] <= profit["expected_profit_high"]).all()
    curve = acceptance.acceptance_curve(draws)
    assert curve.count() == 15


@pytest.mark.parametrize("goal", ["revenue", "profit"])
def test_best_price_is_the_grid_maximum(frame, offers, goal):
    b = (-1.0, -0.5, -0.8)
    got = acceptance.best_price(frame, b, STATS, goal).toPandas().sort_values("id")
    grid = np.array(acceptance.RATE_GRID)
    p = 1 / (1 + np.exp(-(b[0] + b[1] * (grid - 0.06) / 0.03)[None, :] - b[2] * ((offers.amount - 30_000) / 16_000).to_numpy()[:, None]))
    margin = grid[None, :] - (offers.cost_of_funds.to_numpy()[:, None] if goal == "profit" else 0)
    value = offers.amount.to_numpy()[:, None] * margin * p
    best = value.argmax(axis=1)
    np.testing.assert_allclose(got["best_rate"], grid[best])
    np.testing.assert_allclose(got[f"expected_{goal}"], value.max(axis=1))
    totals = acceptance.best_price_totals(acceptance.best_price(frame, b, STATS, goal)).first()
    assert totals[f"expected_{goal}"] == pytest.approx(value.max(axis=1).sum())
    with pytest.raises(ValueError):
        acceptance.best_price(frame, b, STATS, "volume")


def test_first_maximum_wins(spark):
    df = spark.createDataFrame([(0.0, 0.01)], "amount double, cost_of_funds double")
    assert acceptance.best_price(df, (-1.0, -0.5, 0.0), STATS, "revenue").first().best_rate == 0.0


def test_trim_and_correlation(frame, offers):
    lo, hi = offers.rate.quantile(0.025), offers.rate.quantile(0.975)
    assert explore.quantile_trim(frame, "rate").count() == ((offers.rate > lo) & (offers.rate < hi)).sum()
    got = {r.series: (r.n_rows, r.correlation) for r in explore.trimmed_correlation(frame, "rate", "outcome", "tier").collect()}
    for tier, part in [("all", offers), *[(str(t), offers[offers.tier == t]) for t in range(1, 5)]]:
        kept = part[(part.rate > part.rate.quantile(0.025)) & (part.rate < part.rate.quantile(0.975))]
        assert got[tier] == (len(kept), pytest.approx(kept.rate.corr(kept.outcome)))


def test_histograms(spark, frame, offers):
    got = explore.rate_histogram(frame, "rate", "outcome", "tier").toPandas()
    for tier in range(1, 5):
        part = offers[offers.tier == tier]
        want, _ = np.histogram(part.rate, explore.RATE_EDGES)
        mine = got[got.tier == tier].sort_values("bin")
        assert mine["n_total"].tolist() == want.tolist()
        assert mine.loc[mine.n_total == 0, "acceptance_rate"].isna().all()
    edges = spark.createDataFrame([(1, 0.0, 1), (1, 0.14, 1), (1, 0.15, 1), (1, -0.1, 0)], "tier int, rate double, outcome int")
    counts = {r.bin: r.n_total for r in explore.rate_histogram(edges, "rate", "outcome", "tier").collect() if r.n_total}
    assert counts == {0: 1, 13: 1}
    auto = explore.auto_histograms(frame.withColumn("flat", F.lit(2.0)), ["amount", "flat"], ["tier"]).toPandas()
    assert auto[auto.measure == "amount"].groupby("tier")["n"].sum().to_dict() == offers.groupby("tier").size().to_dict()
    flat = auto[auto.measure == "flat"]
    assert set(flat["bin"]) == {5} and set(flat["lo"]) == {1.5}


def test_counted_loans_give_the_same_fit(spark, frame):
    rounded = frame.withColumn("rate", F.round("rate", 2))
    counted = acceptance.counted_loans(rounded, ["rate"], "outcome")
    assert counted.count() < 15 and counted.agg(F.sum("n"), F.sum("s")).first() == frame.agg(F.count("*"), F.sum("outcome").cast("double")).first()
    rows = rounded.select("rate", "outcome").toPandas()
    x, beta = np.column_stack([np.ones(len(rows)), rows.rate]), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ beta))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + np.eye(2) / 100
        beta += np.linalg.solve(hessian, x.T @ (rows.outcome - p) - beta / 100)
    np.testing.assert_allclose(acceptance.fit_counted(counted, 2, 10.0).mean, beta, atol=1e-8)
    holed = rounded.withColumn("rate", F.when(F.col("id") % 3 > 0, F.col("rate")))
    assert acceptance.counted_loans(holed, ["rate"], "outcome").agg(F.sum("n")).first()[0] == holed.where("rate IS NOT NULL").count()


def test_weights_lead_from_the_approximation_to_the_posterior(spark, offers):
    few = offers.head(25)  # few loans: the normal approximation is visibly off
    frame = spark.createDataFrame(few.assign(x=(few.rate - 0.06) / 0.03)[["x", "outcome"]])
    counted = acceptance.counted_loans(frame, ["x"], "outcome")
    fitted = acceptance.fit_counted(counted, 2, 2.0)
    weighted = acceptance.weighted_draws(counted, acceptance.draw_posterior(spark, fitted, 400), fitted, 2.0)
    got = weighted.toPandas().sort_values("draw_id")
    b = got[["beta_0", "beta_1"]].to_numpy()
    eta = b[:, :1] + np.outer(b[:, 1], (few.rate - 0.06) / 0.03)
    away = b - np.array(fitted.mean)
    log = (few.outcome.to_numpy() * eta - np.logaddexp(0, eta)).sum(axis=1) - (b**2).sum(axis=1) / 8
    log += np.einsum("di,ij,dj->d", away, np.linalg.inv(fitted.cov), away) / 2
    weight = np.exp(log - log.max())
    np.testing.assert_allclose(got["weight"], weight / weight.sum(), atol=1e-12)
    grid = np.linspace(-8, 8, 401)  # the posterior itself, on a grid
    u, v = np.meshgrid(grid, grid, indexing="ij")
    points = u[..., None] + v[..., None] * ((few.rate - 0.06) / 0.03).to_numpy()
    density = (few.outcome.to_numpy() * points - np.logaddexp(0, points)).sum(axis=-1) - (u**2 + v**2) / 8
    density = np.exp(density - density.max())
    true_mean = [(u * density).sum() / density.sum(), (v * density).sum() / density.sum()]
    summary = {r.parameter: r for r in acceptance.weighted_summary(weighted).collect()}
    for i in range(2):
        row = summary[f"beta_{i}"]
        assert abs(row["mean"] - true_mean[i]) < 4 * row["sd"] / np.sqrt(row["effective_draws"])
        assert row["effective_draws"] == pytest.approx(1 / (got["weight"] ** 2).sum())


def test_no_draws_no_weights(spark, frame):
    counted = acceptance.counted_loans(frame, ["rate"], "outcome")
    fitted = acceptance.fit_counted(counted, 2, 10.0)
    assert acceptance.weighted_draws(counted, acceptance.draw_posterior(spark, fitted, 0), fitted, 10.0).count() == 0
