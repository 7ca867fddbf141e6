"""Price acceptance: posterior of a logistic model, acceptance and profit curves, best price per loan.

The posterior is approximated by its mode and curvature (Newton steps, one aggregate each). Draws
are a table whose size is a parameter of the sampling, never a function of the data; where rows are
scored with all of them, they enter the plan as one array value.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lendlens.functions.economics import sigmoid
from lendlens.operators.explore import standard_stats, standardize
from lendlens.session import settle

# Price grid 0..29 %, loan amounts and acceptance target of the price curves.
RATE_GRID = [0.01 * i for i in range(30)]
ACCEPTANCE_GRID = [0.01 * i for i in range(15)]
TARGET_AMOUNTS = [5000.0 * (i + 1) for i in range(8)]
TARGET_ACCEPTANCE = 0.2
SAMPLE_LOAN = {"amount": 25000.0, "cost": 0.015}


@dataclass(frozen=True)
class Posterior:
    names: list[str]
    mean: list[float]
    cov: list[list[float]]
    iterations: int


def linear(names: Sequence[Column], coefficients: Sequence[float]) -> Column:
    total = F.lit(float(coefficients[0]))
    for c, b in zip(names, coefficients[1:]):
        total = total + F.lit(float(b)) * c
    return total


def counted_loans(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """(x1, x2, …, n, s): the distinct values of the columns with their number of rows and of accepted ones, written once.

    Everything the likelihood of a logistic model needs is a sum over these rows; rows with a missing value are left out.
    """
    xs = [F.col(c).cast("double").alias(f"x{i + 1}") for i, c in enumerate(columns)]
    rows = df.select(*xs, F.col(label).cast("double").alias("y")).dropna()
    return settle(rows.groupBy(*[f"x{i + 1}" for i in range(len(columns))]).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s")))


def fit_counted(counted: DataFrame, k: int, sigma: float, max_iter: int = 50, tol: float = 1e-10) -> Posterior:
    """Mode and curvature of a logistic likelihood over ``counted_loans`` with Normal(0, sigma) priors on all k coefficients.

    Each step is one aggregate of the gradient and Hessian sums (at most 14 for three columns); only these sums and
    a k x k solve are on the driver.
    """
    xs = [F.lit(1.0)] + [F.col(f"x{i}") for i in range(1, k)]

    def slopes(beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and negative Hessian of the log posterior at ``beta``."""
        p = sigmoid(linear(xs[1:], beta))
        weight, residual = F.col("n") * p * (1 - p), F.col("s") - F.col("n") * p
        sums = [F.sum(residual * x) for x in xs] + [F.sum(weight * xs[i] * xs[j]) for i in range(k) for j in range(i, k)]
        row = [v or 0.0 for v in counted.agg(*sums).first()]
        hessian = np.eye(k) / sigma**2
        upper = np.triu_indices(k)
        hessian[upper] += row[k:]
        return np.array(row[:k]) - beta / sigma**2, np.triu(hessian) + np.triu(hessian, 1).T

    beta = np.zeros(k)
    for step in range(1, max_iter + 1):
        gradient, hessian = slopes(beta)
        move = np.linalg.solve(hessian, gradient)
        beta = beta + move
        if np.max(np.abs(move)) < tol:
            break
    else:
        raise RuntimeError(f"no posterior mode after {max_iter} Newton steps; the last one moved {np.max(np.abs(move)):.3g}")
    hessian = slopes(beta)[1]
    names = [f"beta_{i}" for i in range(k)]
    return Posterior(names, beta.tolist(), np.linalg.inv(hessian).tolist(), step)


def fit_posterior(df: DataFrame, columns: Sequence[str], label: str, sigma: float, max_iter: int = 50, tol: float = 1e-10) -> Posterior:
    """The same from loans: they are read once and counted."""
    return fit_counted(counted_loans(df, columns, label), len(columns) + 1, sigma, max_iter, tol)


def posterior_table(spark: SparkSession, posterior: Posterior) -> DataFrame:
    rows = [(n, float(m), float(np.sqrt(posterior.cov[i][i]))) for i, (n, m) in enumerate(zip(posterior.names, posterior.mean))]
    return spark.createDataFrame(rows, "parameter string, mean double, sd double")


def _drawn_number(seed: int, salt: int, key: Column) -> Column:
    """A number below 2^60 from seed, salt and key: the first digits of an MD5 sum, which any engine can repeat."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(str(salt)), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def _normal(key: Column, seed: int) -> Column:
    """A standard normal number that depends on the key and the seed only (two hashed uniform numbers)."""
    def uniform(salt: int) -> Column:
        return (_drawn_number(seed, salt, key) + F.lit(0.5)) / F.lit(float(2**60))

    return F.sqrt(-2 * F.log(uniform(0))) * F.cos(2 * np.pi * uniform(1))


def draw_posterior(spark: SparkSession, posterior: Posterior, n_draws: int = 500, seed: int = 1, independent: bool = False) -> DataFrame:
    """(draw_id, beta_0, …): joint normal draws, or one independent draw per coefficient."""
    cov = np.array(posterior.cov)
    factor = np.diag(np.sqrt(np.diag(cov))) if independent else np.linalg.cholesky(cov)
    base = spark.range(n_draws).select(
        F.col("id").cast("int").alias("draw_id"), *[_normal(F.col("id"), seed + i).alias(f"_z{i}") for i in range(len(cov))]
    )
    return base.select(
        "draw_id",
        *[
            linear([F.col(f"_z{j}") for j in range(len(cov))], [m, *factor[i]]).alias(n)
            for i, (n, m) in enumerate(zip(posterior.names, posterior.mean))
        ],
    )


def draw_array(draws: DataFrame) -> Column:
    """All draws as one array value, ordered by draw: a scalar subquery, computed once per query."""
    return draws.agg(F.sort_array(F.collect_list(F.struct(*_draw_columns(draws))))).scalar()


def _draw_columns(draws: DataFrame) -> list[str]:
    return ["draw_id", *[c for c in draws.columns if c != "draw_id"]]


def resample_draws(draws: DataFrame, n: int = 500, seed: int = 1, independent: bool = False) -> DataFrame:
    """n rows of the draws table with replacement; ``independent`` picks each coefficient on its own."""
    names = _draw_columns(draws)[1:]
    picked = draws.sparkSession.range(n).withColumn("_draws", draw_array(draws))

    def value(j: int, name: str) -> Column:
        place = F.pmod(_drawn_number(seed, j if independent else 0, F.col("id")), F.size("_draws"))
        return F.get("_draws", place.cast("int"))[name]

    return picked.select(F.col("id").cast("int").alias("draw_id"), *[value(j, name).alias(name) for j, name in enumerate(names)])


def draw_means(draws: DataFrame) -> tuple[float, ...]:
    """Point estimate: the mean of every coefficient."""
    names = [c for c in draws.columns if c != "draw_id"]
    return tuple(draws.agg(*[F.avg(n) for n in names]).first())


def draw_summary(draws: DataFrame, low: float = 0.03, high: float = 0.97) -> DataFrame:
    """(parameter, mean, sd, low, high) per coefficient. The draws table is bounded, so an exact percentile fits."""
    names = [c for c in draws.columns if c != "draw_id"]
    long = draws.select(F.explode(F.array(*[F.struct(F.lit(n).alias("parameter"), F.col(n).alias("v")) for n in names])).alias("c"))
    return long.groupBy("c.parameter").agg(
        F.avg("c.v").alias("mean"),
        F.stddev_samp("c.v").alias("sd"),
        F.percentile("c.v", F.lit(low)).alias("low"),
        F.percentile("c.v", F.lit(high)).alias("high"),
    )


def weighted_draws(counted: DataFrame, draws: DataFrame, posterior: Posterior, sigma: float) -> DataFrame:
    """The draws with ``log_weight`` and ``weight``: how much more likely the true posterior is at a draw than the normal
    approximation it was drawn from; the weights sum to 1.

    The log-likelihoods of all draws are the entries of one aggregate, so the loans' counts are read once for any number of draws. The
    draws themselves, whose number is a parameter, are on the driver.
    """
    names = posterior.names
    rows = [tuple(r) for r in draws.select("draw_id", *names).orderBy("draw_id").collect()]
    betas = np.array([r[1:] for r in rows], dtype=float).reshape(-1, len(names))
    xs = [F.col(f"x{i}") for i in range(1, len(names))]

    def log_likelihood(beta: np.ndarray) -> Column:
        eta = linear(xs, beta)
        return F.sum(F.col("s") * eta - F.col("n") * (F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta)))))

    likely = np.array([v or 0.0 for v in counted.agg(*[log_likelihood(b) for b in betas]).first()]) if rows else np.zeros(0)
    away = betas - np.array(posterior.mean)
    log_weight = likely - (betas**2).sum(axis=1) / (2 * sigma**2) + np.einsum("di,ij,dj->d", away, np.linalg.inv(posterior.cov), away) / 2
    weight = np.exp(log_weight - log_weight.max(initial=-np.inf))
    weight = weight / weight.sum() if rows else weight
    cells = [(*r, float(lw), float(w)) for r, lw, w in zip(rows, log_weight, weight)]
    return draws.sparkSession.createDataFrame(cells, f"draw_id int, {', '.join(f'{n} double' for n in names)}, log_weight double, weight double")


def weighted_summary(weighted: DataFrame) -> DataFrame:
    """(parameter, mean, sd, effective_draws) under the weights; the effective number says how far the approximation holds."""
    names = [c for c in weighted.columns if c.startswith("beta_")]
    long = weighted.select("weight", F.explode(F.array(*[F.struct(F.lit(n).alias("parameter"), F.col(n).alias("v")) for n in names])).alias("c"))
    total, first, second = F.sum("weight"), F.sum(F.col("weight") * F.col("c.v")), F.sum(F.col("weight") * F.col("c.v") * F.col("c.v"))
    mean = first / total
    return long.groupBy("c.parameter").agg(
        mean.alias("mean"), F.sqrt(F.greatest(second / total - mean * mean, F.lit(0.0))).alias("sd"),
        (total * total / F.sum(F.col("weight") * F.col("weight"))).alias("effective_draws"),
    )


def _draw_logit(d: Column, names: Sequence[str], xs: Sequence[Column]) -> Column:
    total = d[names[0]]
    for name, x in zip(names[1:], xs):
        total = total + d[name] * x
    return total


def posterior_predictive(df: DataFrame, draws: DataFrame, columns: Sequence[str], output: str = "acceptance_probability") -> DataFrame:
    """Mean acceptance probability over the draws, per row: an array fold, no row is multiplied."""
    names = _draw_columns(draws)[1:]
    xs = [F.col(c).cast("double") for c in columns]
    rows = df.withColumn("_draws", draw_array(draws))
    total = F.aggregate("_draws", F.lit(0.0), lambda acc, d: acc + 1 / (1 + F.exp(-_draw_logit(d, names, xs))))
    return rows.withColumn(output, total / F.size("_draws")).drop("_draws")


def predictive_by_price(df: DataFrame, draws: DataFrame, column: str, bin_width: float = 0.01) -> DataFrame:
    """(draw_id, bin, n, expected_accepted): what each draw of a price-only model expects of the
    loans in each price bin. Prices are counted first, so a draw meets every distinct price once."""
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    met = counted.withColumn("d", F.explode(draw_array(draws)))
    p = sigmoid(F.col("d.beta_0") + F.col("d.beta_1") * F.col("_x"))
    return met.groupBy(F.col("d.draw_id").alias("draw_id"), F.floor(F.col("_x") / bin_width).alias("bin")).agg(
        F.sum("_n").alias("n"), F.sum(F.col("_n") * p).alias("expected_accepted")
    )


def on_grid(draws: DataFrame, name: str, grid: Sequence[float]) -> DataFrame:
    """Every draw at every grid point (an explode of a literal array)."""
    return draws.withColumn(name, F.explode(F.array(*[F.lit(float(g)) for g in grid])))


def curve_band(points: DataFrame, at: str, value: Column, mean_curve: Column, name: str) -> DataFrame:
    """(at, <name> at the mean coefficients, and mean, 3 % and 97 % over the draws)."""
    return points.groupBy(at).agg(
        F.max(mean_curve).alias(name),
        F.avg(value).alias(f"{name}_mean"),
        F.percentile(value, F.lit(0.03)).alias(f"{name}_low"),
        F.percentile(value, F.lit(0.97)).alias(f"{name}_high"),
    )


def per_draw(points: DataFrame, at: str, value: Column, name: str) -> DataFrame:
    """(draw_id, at, <name>): one curve for every draw."""
    return points.select("draw_id", at, value.alias(name))


def acceptance_curves(draws: DataFrame, grid: Sequence[float] = ACCEPTANCE_GRID) -> DataFrame:
    """Acceptance by price of a price-only model, one curve per draw."""
    return per_draw(on_grid(draws, "rate", grid), "rate", sigmoid(F.col("beta_0") + F.col("beta_1") * F.col("rate")), "acceptance")


def acceptance_curve(draws: DataFrame, grid: Sequence[float] = ACCEPTANCE_GRID) -> DataFrame:
    """Acceptance by price for a price-only model: mean curve and band over the draws."""
    b0, b1 = draw_means(draws)[:2]
    points = on_grid(draws, "rate", grid)
    value = sigmoid(F.col("beta_0") + F.col("beta_1") * F.col("rate"))
    return curve_band(points, "rate", value, sigmoid(F.lit(b0) + F.lit(b1) * F.col("rate")), "acceptance")


Stats = dict[str, tuple[float, float]]


def _std(x, stat: tuple[float, float]):
    return (x - F.lit(stat[0])) / F.lit(stat[1])


def _target_rate(b: Sequence[Column], stats: Stats, target: float) -> Column:
    logit = float(-np.log((1 - target) / target))
    mean_rate, sd_rate = stats["rate"]
    return F.try_divide(F.lit(logit) - b[0] - b[2] * _std(F.col("amount"), stats["amount"]), b[1]) * F.lit(sd_rate) + F.lit(mean_rate)


def _drawn() -> list[Column]:
    return [F.col(f"beta_{i}") for i in range(3)]


def target_prices(draws: DataFrame, stats: Stats, target: float = TARGET_ACCEPTANCE, amounts: Sequence[float] = TARGET_AMOUNTS) -> DataFrame:
    """Price at which the model reaches the target acceptance, per draw and loan amount."""
    return per_draw(on_grid(draws, "amount", amounts), "amount", _target_rate(_drawn(), stats, target), "target_rate")


def target_price(draws: DataFrame, stats: Stats, target: float = TARGET_ACCEPTANCE, amounts: Sequence[float] = TARGET_AMOUNTS) -> DataFrame:
    """The same per loan amount: closed form at the mean coefficients, with the band over the draws."""
    means = [F.lit(m) for m in draw_means(draws)[:3]]
    points = on_grid(draws, "amount", amounts)
    return curve_band(points, "amount", _target_rate(_drawn(), stats, target), _target_rate(means, stats, target), "target_rate")


def acceptance_at(b0: Column, b1: Column, b2: Column, rate: Column, amount: Column, stats: Stats) -> Column:
    return sigmoid(b0 + b1 * _std(rate, stats["rate"]) + b2 * _std(amount, stats["amount"]))


def _loan_value(b: Sequence[Column], stats: Stats, kind: str, amount: float, cost: float) -> Column:
    gain = F.col("rate") - F.lit(cost) if kind == "profit" else F.col("rate")
    return F.lit(amount) * gain * acceptance_at(*b, F.col("rate"), F.lit(amount), stats)


def loan_curves(draws: DataFrame, stats: Stats, kind: str, amount: float, cost: float, grid: Sequence[float] = RATE_GRID) -> DataFrame:
    """Expected profit or revenue of one loan over the price grid, one curve per draw."""
    return per_draw(on_grid(draws, "rate", grid), "rate", _loan_value(_drawn(), stats, kind, amount, cost), f"expected_{kind}")


def loan_curve(draws: DataFrame, stats: Stats, kind: str, amount: float, cost: float, grid: Sequence[float] = RATE_GRID) -> DataFrame:
    """The same as one curve: at the mean coefficients, with the band over the draws."""
    means = [F.lit(m) for m in draw_means(draws)[:3]]
    points = on_grid(draws, "rate", grid)
    value = _loan_value(_drawn(), stats, kind, amount, cost)
    return curve_band(points, "rate", value, _loan_value(means, stats, kind, amount, cost), f"expected_{kind}")


def realised_totals(df: DataFrame) -> DataFrame:
    """Revenue and profit of the loans that were accepted."""
    taken = F.col("amount") * F.col("outcome")
    return df.agg(
        F.count(F.lit(1)).alias("n_loans"),
        F.sum(taken * F.col("rate")).alias("realised_revenue"),
        F.sum(taken * (F.col("rate") - F.col("cost_of_funds"))).alias("realised_profit"),
    )


def best_price(df: DataFrame, coefficients: Sequence[float], stats: Stats, goal: str, grid: Sequence[float] = RATE_GRID) -> DataFrame:
    """Per loan the grid price with the highest expected revenue or profit (the lower price on ties),
    with its acceptance probability, expected revenue and expected profit.

    The price part of the exponent is a constant per grid point, so a loan costs one ``exp`` and a
    comparison per point, all in generated code.
    """
    if goal not in ("revenue", "profit"):
        raise ValueError("goal must be 'revenue' or 'profit'")
    b0, b1, b2 = coefficients[:3]
    mean_rate, sd_rate = stats["rate"]
    factors = [float(np.exp(-b1 * (r - mean_rate) / sd_rate)) for r in grid]
    base = df.withColumn("_e", F.exp(-(F.lit(b0) + F.lit(b2) * _std(F.col("amount"), stats["amount"]))))

    def candidate(j: int) -> Column:
        p = 1 / (1 + F.lit(factors[j]) * F.col("_e"))
        margin = F.lit(float(grid[j])) - F.col("cost_of_funds") if goal == "profit" else F.lit(float(grid[j]))
        return F.struct((F.col("amount") * margin * p).alias("v"), F.lit(-j).alias("j"))

    picked = base.withColumn("_j", -F.greatest(*[candidate(j) for j in range(len(grid))])["j"])
    at = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("_j") + 1)
    priced = picked.withColumns({"best_rate": at(grid), "acceptance_probability": 1 / (1 + at(factors) * F.col("_e"))})
    chance = F.col("amount") * F.col("acceptance_probability")
    return priced.withColumns({
        "expected_revenue": chance * F.col("best_rate"),
        "expected_profit": chance * (F.col("best_rate") - F.col("cost_of_funds")),
    }).drop("_e", "_j")


def best_price_totals(priced: DataFrame) -> DataFrame:
    return priced.agg(
        F.count(F.lit(1)).alias("n_loans"),
        F.avg("best_rate").alias("avg_best_rate"),
        F.sum("expected_revenue").alias("expected_revenue"),
        F.sum("expected_profit").alias("expected_profit"),
    )


def price_chain(df: DataFrame, label: str = "outcome", n_draws: int = 500, sigma: float = 10.0, seed: int = 1) -> DataFrame:
    """(goal, n_loans, avg_best_rate, expected_revenue, expected_profit): the whole way from loans to prices.

    Rates and amounts are standardised, the acceptance model is fitted, its posterior drawn, and the loans are priced
    at the mean of the draws, once for revenue and once for profit.
    """
    stats = standard_stats(df, ["rate", "amount"])
    fitted = fit_posterior(standardize(df, stats), ["rate_std", "amount_std"], label, sigma)
    means = draw_means(draw_posterior(df.sparkSession, fitted, n_draws, seed))
    parts = [best_price_totals(best_price(df, means, stats, goal)).withColumn("goal", F.lit(goal)) for goal in ("revenue", "profit")]
    return parts[0].unionByName(parts[1])
