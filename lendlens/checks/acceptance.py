"""Acceptance model and price optimisation O1–O13."""

from pyspark.sql import functions as F

from lendlens.operators import acceptance, explore
from lendlens.operators.model import hash_split
from lendlens.session import settle

from .newton_sql import drawn_sql, fitted_sql, number_sql
from .registry import check, key_hash_sql

N_DRAWS = 200  # draws of the posterior that the curves are made of
_STATS_SQL = "(SELECT avg(rate) AS rm, stddev_samp(rate) AS rs, avg(amount) AS am, stddev_samp(amount) AS s FROM loan_offers WHERE tier = 2)"
_TRAIN_SQL = f"{key_hash_sql('1', 'offer_no', 'offer_ref')} % 10000 >= 2000"


def _standard_sql(*columns: str) -> str:
    """The standardised training loans."""
    cells = ", ".join(f"(o.{c} - m_{c}) / s_{c} AS {c}_std" for c in columns)
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in columns)
    return f"SELECT {cells}, outcome FROM loan_offers o, (SELECT {stats} FROM loan_offers WHERE tier = 2) q WHERE tier = 2 AND {_TRAIN_SQL}"


_RAW_SQL = f"SELECT rate, outcome FROM loan_offers WHERE tier = 2 AND {_TRAIN_SQL}"
_FITS = {
    "price": fitted_sql(_RAW_SQL, ["rate"], 10.0),
    "price_amount": fitted_sql(_standard_sql("rate", "amount"), ["rate_std", "amount_std"], 10.0),
    "price_fico_amount": fitted_sql(_standard_sql("rate", "fico", "amount"), ["rate_std", "fico_std", "amount_std"], 1.0),
}


def _fit_sql(name: str, query: str) -> str:
    return f"WITH {_FITS[name]}\n{query}"


def _draws_sql(name: str, k: int) -> str:
    return f"WITH {_FITS[name]},\n{drawn_sql(k, N_DRAWS)}\nSELECT * FROM drawn"


_DRAWS_SQL = _draws_sql("price_amount", 3)
_PRICE_DRAWS_SQL = _draws_sql("price", 2)


def _tier(ctx):
    return explore.tier_filter(ctx.offers, 2)


def _stats(ctx):
    return explore.standard_stats(_tier(ctx), ["rate", "amount"])


def _standardised(ctx, columns):
    tier = _tier(ctx)
    return explore.standardize(tier, explore.standard_stats(tier, columns))


def _train(df):
    return hash_split(df, ["offer_no", "offer_ref"], 0.2, 1)[0]


def _counted(ctx, columns):
    """Training loans, counted by their standardised columns."""
    return acceptance.counted_loans(_train(_standardised(ctx, columns)), [f"{c}_std" for c in columns], "outcome")


def _price_fit(ctx):
    return acceptance.fit_posterior(_train(_tier(ctx)), ["rate"], "outcome", 10.0)


def _fit(ctx, columns, sigma):
    return acceptance.fit_counted(_counted(ctx, columns), len(columns) + 1, sigma)


def _draws(ctx):
    """Draws of the price and amount model, fitted on the loans."""
    return settle(acceptance.draw_posterior(ctx.spark, _fit(ctx, ["rate", "amount"], 10.0), N_DRAWS))


def _price_draws(ctx):
    """Draws of the price-only model."""
    return settle(acceptance.draw_posterior(ctx.spark, _price_fit(ctx), N_DRAWS))


@check("o1_acceptance_model", "model parameter mean:f4 sd:f4",
       " UNION ALL ".join(
           f"SELECT '{name}' AS model, unnest([{', '.join(repr(f'beta_{i}') for i in range(k))}]) AS parameter, unnest([{', '.join(f'b{i}' for i in range(k))}]) AS mean, unnest([{', '.join(f'sqrt(c_{i}_{i})' for i in range(k))}]) AS sd FROM ({_fit_sql(name, 'SELECT * FROM fit')}) {name}_fit"
           for name, k in (("price", 2), ("price_amount", 3), ("price_fico_amount", 4))))
def _(ctx):
    fits = {"price": _price_fit(ctx), "price_amount": _fit(ctx, ["rate", "amount"], 10.0), "price_fico_amount": _fit(ctx, ["rate", "fico", "amount"], 1.0)}
    tables = [acceptance.posterior_table(ctx.spark, p).withColumn("model", F.lit(m)) for m, p in fits.items()]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


_RESAMPLED = ", ".join(f"(SELECT beta_{i} FROM d WHERE draw_id = {number_sql(1, i, 'id')} % {N_DRAWS}) AS beta_{i}" for i in range(3))


@check("o2_posterior_draws", "kind draw_id:i beta_0:f beta_1:f beta_2:f",
       f"""WITH d AS MATERIALIZED ({_DRAWS_SQL})
       SELECT 'draw' AS kind, * FROM d UNION ALL SELECT 'resampled', id, {_RESAMPLED} FROM range(50) r(id)""")
def _(ctx):
    draws = _draws(ctx)
    again = acceptance.resample_draws(draws, 50, independent=True)
    return draws.withColumn("kind", F.lit("draw")).unionByName(again.withColumn("kind", F.lit("resampled")))


@check("o3_weighted_summary", "parameter mean:f sd:f effective_draws:f2",
       f"""WITH {_FITS['price_amount']},
       {drawn_sql(3, N_DRAWS)},
       likely AS (SELECT draw_id, sum(s * eta - n * (greatest(eta, 0) + ln(1 + exp(-abs(eta))))) AS ll FROM (SELECT draw_id, n, s, beta_0 + beta_1 * x1 + beta_2 * x2 AS eta FROM counted, drawn) e GROUP BY draw_id),
       sides AS (SELECT d.*, ll - (beta_0 * beta_0 + beta_1 * beta_1 + beta_2 * beta_2) / 200 + (z0 * z0 + z1 * z1 + z2 * z2) / 2 AS lw FROM drawn d JOIN likely USING (draw_id) JOIN numbers USING (draw_id)),
       weighted AS (SELECT *, exp(lw - (SELECT max(lw) FROM sides)) AS w FROM sides)
       """ + " UNION ALL ".join(
           f"SELECT 'beta_{i}' AS parameter, sum(w * beta_{i}) / sum(w) AS mean, sqrt(sum(w * beta_{i} * beta_{i}) / sum(w) - (sum(w * beta_{i}) / sum(w)) * (sum(w * beta_{i}) / sum(w))) AS sd, sum(w) * sum(w) / sum(w * w) AS effective_draws FROM weighted"
           for i in range(3)))
def _(ctx):
    """The posterior itself, by importance weights of the draws of its approximation."""
    counted = _counted(ctx, ["rate", "amount"])
    fitted = acceptance.fit_counted(counted, 3, 10.0)
    draws = acceptance.draw_posterior(ctx.spark, fitted, N_DRAWS)
    return acceptance.weighted_summary(acceptance.weighted_draws(counted, draws, fitted, 10.0))


@check("o3_posterior_summary", "parameter mean:f sd:f low:f high:f",
       " UNION ALL ".join(
           f"SELECT 'beta_{i}' AS parameter, avg(beta_{i}) AS mean, stddev_samp(beta_{i}) AS sd, quantile_cont(beta_{i}, 0.03) AS low, quantile_cont(beta_{i}, 0.97) AS high FROM ({_DRAWS_SQL}) d"
           for i in range(3)))
def _(ctx):
    return acceptance.draw_summary(_draws(ctx))


@check("o4_prior_predictive", "draw_id:i bin:i n:i expected_accepted:f4",
       f"""SELECT draw_id, floor(rate / 0.01::DOUBLE) AS bin, count(*) AS n, sum(1 / (1 + exp(-(beta_0 + beta_1 * rate)))) AS expected_accepted
       FROM loan_offers, ({_PRICE_DRAWS_SQL}) d WHERE tier = 2 GROUP BY 1, 2""")
def _(ctx):
    return acceptance.predictive_by_price(_tier(ctx), _price_draws(ctx), "rate")


@check("o5_posterior_predictive", "offer_no:i offer_ref:i acceptance_probability:f",
       f"""SELECT offer_no, offer_ref, list_avg(list_transform(ds, lambda d: 1 / (1 + exp(-(d.beta_0 + d.beta_1 * (rate - rm) / rs + d.beta_2 * (amount - am) / s))))) AS acceptance_probability
       FROM loan_offers, {_STATS_SQL} q, (SELECT list({{'beta_0': beta_0, 'beta_1': beta_1, 'beta_2': beta_2}}) AS ds FROM ({_DRAWS_SQL}) d) l WHERE tier = 2""")
def _(ctx):
    return acceptance.posterior_predictive(_standardised(ctx, ["rate", "amount"]), _draws(ctx), ["rate_std", "amount_std"])


def _band_sql(at, name, grid_sql, value, mean, draws=_DRAWS_SQL, k=3):
    means = ", ".join(f"avg(beta_{i}) AS b{i}" for i in range(k))
    return f"""WITH d AS MATERIALIZED ({draws})
      SELECT {at}, max({mean}) AS {name}, avg({value}) AS {name}_mean, quantile_cont({value}, 0.03) AS {name}_low, quantile_cont({value}, 0.97) AS {name}_high
      FROM d, (SELECT {means} FROM d) m, {grid_sql} g({at}), {_STATS_SQL} q GROUP BY {at}"""


_RATES = "(VALUES " + ", ".join(f"(CAST('{r!r}' AS DOUBLE))" for r in acceptance.RATE_GRID) + ")"
_ACCEPT_RATES = "(VALUES " + ", ".join(f"(CAST('{r!r}' AS DOUBLE))" for r in acceptance.ACCEPTANCE_GRID) + ")"
_AMOUNTS = "(VALUES " + ", ".join(f"(CAST({a} AS DOUBLE))" for a in acceptance.TARGET_AMOUNTS) + ")"


@check("o6_acceptance_curve", "rate:f acceptance:f acceptance_mean:f acceptance_low:f acceptance_high:f",
       _band_sql("rate", "acceptance", _ACCEPT_RATES, "1 / (1 + exp(-(beta_0 + beta_1 * rate)))", "1 / (1 + exp(-(b0 + b1 * rate)))", _PRICE_DRAWS_SQL, 2))
def _(ctx):
    return acceptance.acceptance_curve(_price_draws(ctx))


@check("o7_target_price", "amount:f target_rate:f target_rate_mean:f target_rate_low:f target_rate_high:f",
       _band_sql("amount", "target_rate", _AMOUNTS, "(ln(0.2 / 0.8) - beta_0 - beta_2 * (amount - am) / s) / beta_1 * rs + rm", "(ln(0.2 / 0.8) - b0 - b2 * (amount - am) / s) / b1 * rs + rm"))
def _(ctx):
    return acceptance.target_price(_draws(ctx), _stats(ctx))


def _each_sql(at, name, grid_sql, value, draws=_DRAWS_SQL):
    return f"SELECT draw_id, {at}, {value} AS {name} FROM ({draws}) d, {grid_sql} g({at}), {_STATS_SQL} q"


@check("o6_acceptance_curves", "draw_id:i rate:f acceptance:f", _each_sql("rate", "acceptance", _ACCEPT_RATES, "1 / (1 + exp(-(beta_0 + beta_1 * rate)))", _PRICE_DRAWS_SQL))
def _(ctx):
    return acceptance.acceptance_curves(_price_draws(ctx))


@check("o7_target_prices", "draw_id:i amount:f target_rate:f", _each_sql("amount", "target_rate", _AMOUNTS, "(ln(0.2 / 0.8) - beta_0 - beta_2 * (amount - am) / s) / beta_1 * rs + rm"))
def _(ctx):
    return acceptance.target_prices(_draws(ctx), _stats(ctx))


def _drawn_loan(gain):
    return f"25000 * {gain} / (1 + exp(-(beta_0 + beta_1 * (rate - rm) / rs + beta_2 * (25000 - am) / s)))"


@check("o8_profit_curves", "draw_id:i rate:f expected_profit:f4", _each_sql("rate", "expected_profit", _RATES, _drawn_loan("(rate - 0.015)")))
def _(ctx):
    return acceptance.loan_curves(_draws(ctx), _stats(ctx), "profit", **acceptance.SAMPLE_LOAN)


@check("o9_revenue_curves", "draw_id:i rate:f expected_revenue:f4", _each_sql("rate", "expected_revenue", _RATES, _drawn_loan("rate")))
def _(ctx):
    return acceptance.loan_curves(_draws(ctx), _stats(ctx), "revenue", **acceptance.SAMPLE_LOAN)


def _loan_sql(name, gain):
    def value(b0, b1, b2):
        return f"25000 * {gain} / (1 + exp(-({b0} + {b1} * (rate - rm) / rs + {b2} * (25000 - am) / s)))"

    return _band_sql("rate", name, _RATES, value("beta_0", "beta_1", "beta_2"), value("b0", "b1", "b2"))


@check("o8_profit_curve", "rate:f expected_profit:f4 expected_profit_mean:f4 expected_profit_low:f4 expected_profit_high:f4", _loan_sql("expected_profit", "(rate - 0.015)"))
def _(ctx):
    return acceptance.loan_curve(_draws(ctx), _stats(ctx), "profit", **acceptance.SAMPLE_LOAN)


@check("o9_revenue_curve", "rate:f expected_revenue:f4 expected_revenue_mean:f4 expected_revenue_low:f4 expected_revenue_high:f4", _loan_sql("expected_revenue", "rate"))
def _(ctx):
    return acceptance.loan_curve(_draws(ctx), _stats(ctx), "revenue", **acceptance.SAMPLE_LOAN)


@check("o10_realised_totals", "n_loans:i realised_revenue:f2 realised_profit:f2",
       "SELECT count(*) AS n_loans, sum(amount * rate * outcome) AS realised_revenue, sum(amount * (rate - cost_of_funds) * outcome) AS realised_profit FROM loan_offers WHERE tier = 2")
def _(ctx):
    return acceptance.realised_totals(_tier(ctx))


def _best_sql(gain: str) -> str:
    p = "1 / (1 + exp(-(-1.2 - 0.45 * (g.rate - rm) / rs - 0.5 * (amount - am) / s)))"
    return f"""SELECT offer_no, offer_ref, best_rate, acceptance_probability, amount * best_rate * acceptance_probability AS expected_revenue,
        amount * (best_rate - cost_of_funds) * acceptance_probability AS expected_profit
      FROM (SELECT offer_no, offer_ref, amount, cost_of_funds, g.rate AS best_rate, {p} AS acceptance_probability
        FROM loan_offers o, {_STATS_SQL} q, {_RATES} g(rate) WHERE tier = 2
        QUALIFY row_number() OVER (PARTITION BY offer_no, offer_ref, amount, cost_of_funds, fico, term, outcome, o.rate, o.reference_rate, loan_type ORDER BY amount * {gain} * {p} DESC, g.rate) = 1) x"""


_BEST = "offer_no:i offer_ref:i best_rate:f acceptance_probability:f expected_revenue:f4 expected_profit:f4"
_COEFFICIENTS = (-1.2, -0.45, -0.5)


@check("o11_revenue_price", _BEST, _best_sql("g.rate"))
def _(ctx):
    return acceptance.best_price(_tier(ctx), _COEFFICIENTS, _stats(ctx), "revenue")


@check("o12_profit_price", _BEST, _best_sql("(g.rate - cost_of_funds)"))
def _(ctx):
    return acceptance.best_price(_tier(ctx), _COEFFICIENTS, _stats(ctx), "profit")


def _totals_sql(gain):
    return f"SELECT count(*) AS n_loans, avg(best_rate) AS avg_best_rate, sum(expected_revenue) AS expected_revenue, sum(expected_profit) AS expected_profit FROM ({_best_sql(gain)}) b"


_TOTALS = "goal n_loans:i avg_best_rate:f expected_revenue:f2 expected_profit:f2"


@check("o12_best_price_totals", _TOTALS, f"SELECT 'revenue' AS goal, * FROM ({_totals_sql('g.rate')}) r UNION ALL SELECT 'profit', * FROM ({_totals_sql('(g.rate - cost_of_funds)')}) p")
def _(ctx):
    tier, stats = _tier(ctx), _stats(ctx)
    parts = [
        acceptance.best_price_totals(acceptance.best_price(tier, _COEFFICIENTS, stats, goal)).withColumn("goal", F.lit(goal))
        for goal in ("revenue", "profit")
    ]
    return parts[0].unionByName(parts[1])


_CHAIN_FIT = fitted_sql(
    f"SELECT (rate - rm) / rs AS rate_std, (amount - am) / s AS amount_std, outcome FROM loan_offers, {_STATS_SQL} q WHERE tier = 2", ["rate_std", "amount_std"], 10.0
)
_CHAIN_MEANS = f"WITH {_CHAIN_FIT},\n{drawn_sql(3, 500)}\nSELECT avg(beta_0) AS m0, avg(beta_1) AS m1, avg(beta_2) AS m2 FROM drawn"


def _chain_sql(goal, gain):
    p = "1 / (1 + exp(-(m0 + m1 * (g.rate - rm) / rs + m2 * (amount - am) / s)))"
    return f"""SELECT '{goal}' AS goal, count(*) AS n_loans, avg(best_rate) AS avg_best_rate, sum(amount * best_rate * p) AS expected_revenue, sum(amount * (best_rate - cost_of_funds) * p) AS expected_profit
      FROM (SELECT offer_no, offer_ref, o.rate, amount, cost_of_funds, g.rate AS best_rate, {p} AS p FROM loan_offers o, {_STATS_SQL} q, ({_CHAIN_MEANS}) m, {_RATES} g(rate) WHERE tier = 2
        QUALIFY row_number() OVER (PARTITION BY offer_no, offer_ref, amount, cost_of_funds, fico, term, outcome, o.rate, o.reference_rate, loan_type ORDER BY amount * {gain} * {p} DESC, g.rate) = 1) x"""


@check("o12_price_chain", _TOTALS, f"{_chain_sql('revenue', 'g.rate')} UNION ALL {_chain_sql('profit', '(g.rate - cost_of_funds)')}")
def _(ctx):
    """Fit, draws, mean coefficients, best price of every loan, totals."""
    return acceptance.price_chain(_tier(ctx))


@check("o13_split", "part n:i",
       f"SELECT CASE WHEN {key_hash_sql('1', 'offer_no', 'offer_ref')} % 10000 < 2000 THEN 'test' ELSE 'train' END AS part, count(*) AS n FROM loan_offers WHERE tier = 2 GROUP BY 1")
def _(ctx):
    train, test = hash_split(_tier(ctx), ["offer_no", "offer_ref"], 0.2, 1)
    both = train.select(F.lit("train").alias("part")).unionByName(test.select(F.lit("test").alias("part")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
