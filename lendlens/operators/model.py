"""Win-probability model on Spark ML, and the ranking of active deals by expected value."""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendlens.functions.economics import expected_deal_value, win_label
from lendlens.operators.evaluate import evaluate_classifier
from lendlens.operators.ordered import as_doubles, column_modes, column_quantiles, prefix_counts, row_numbers
from lendlens.operators.quality import require_columns
from lendlens.session import settle


def split_features(df: DataFrame, features: Sequence[str]) -> tuple[list[str], list[str]]:
    """(numeric, categorical); booleans count as numeric."""
    numeric = [f for f in features if isinstance(df.schema[f].dataType, (T.NumericType, T.BooleanType))]
    return numeric, [f for f in features if f not in numeric]


def key_hash(keys: Sequence[str], seed: int) -> Column:
    """A number below 2^60 from a row's key: the first digits of an MD5 sum, which any engine can repeat."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def hash_split(df: DataFrame, keys: Sequence[str], test_share: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a hash of the row's key: a filter, no shuffle, stable under any partitioning."""
    place = F.pmod(key_hash(keys, seed), F.lit(10_000))
    edge = round(test_share * 10_000)
    return df.where(place >= edge), df.where(place < edge)


def stratified_split(df: DataFrame, label: str, keys: Sequence[str], test_share: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(train, test) in which every class has its exact share: of each class the rows with the smallest key
    hashes are tested, as many as ``test_share`` of the class, rounded. Rows with equal keys stay together.

    The last hash of each class is read off running counts; the split itself is a filter. One number per class
    reaches the driver: ``label`` must be a class column.
    """
    hashed = df.select(F.col(label).alias("_class"), key_hash(keys, seed).alias("_hash"))
    counts = prefix_counts(hashed, "_hash", "_class")
    tested = counts.where(F.col("n_before") < F.round(F.col("n_total") * F.lit(float(test_share))))
    edges = tested.groupBy("_class").agg(F.max("_hash").alias("edge")).collect()
    picked = F.lit(False)
    for r in edges:
        picked = picked | (F.col(label).eqNullSafe(F.lit(r["_class"])) & (key_hash(keys, seed) <= F.lit(r["edge"])))
    return df.where(~picked), df.where(picked)


def split_shares(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """(part, label, n): what the split did to each class."""
    parts = [d.select(F.lit(p).alias("part"), F.col(label).alias("label")) for p, d in (("train", train), ("test", test))]
    return parts[0].unionByName(parts[1]).groupBy("part", "label").agg(F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class Imputation:
    """Fill values and scaling of a training set."""

    medians: dict[str, float] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)
    scale: dict[str, tuple[float, float]] = field(default_factory=dict)


def fit_imputation(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> Imputation:
    """Exact medians, most frequent labels (smallest on ties), mean and population deviation after filling."""
    df = as_doubles(df, numeric)
    medians = {}
    if numeric:
        medians = {r["series"]: r["q0"] for r in column_quantiles(df, numeric, [0.5]).collect()}
    modes = {}
    if categorical:
        found = {r["series"]: r["mode_value"] for r in column_modes(df, categorical).collect()}
        modes = {c: found.get(c) for c in categorical}
    empty = [c for c in numeric if c not in medians]
    if empty:
        warnings.warn(f"features without any value are left out: {empty}", stacklevel=2)
    numeric = [c for c in numeric if c in medians]
    scale = {}
    if numeric:
        filled = [F.coalesce(F.col(c), F.lit(medians.get(c))) for c in numeric]
        row = df.agg(*[f(x) for x in filled for f in (F.avg, F.stddev_pop)]).first()
        scale = {c: (row[2 * i], row[2 * i + 1] or 1.0) for i, c in enumerate(numeric)}
    return Imputation(medians, modes, scale)


def _number(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def _text(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def preparation_stage(imputation: Imputation) -> SQLTransformer:
    """Fill and scale as one projection inside the pipeline (stays in the JVM, is saved with the model)."""
    parts = []
    for c, (mean, std) in imputation.scale.items():
        filled = f"coalesce(CAST(`{c}` AS DOUBLE), {_number(imputation.medians[c])})"
        parts.append(f"({filled} - {_number(mean)}) / {_number(std)} AS `_num_{c}`")
    for c, mode in imputation.modes.items():
        parts.append(f"coalesce(CAST(`{c}` AS STRING), {_text(mode or '')}) AS `_cat_{c}`")
    return SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")


def one_hot_stages(categorical: Sequence[str]) -> list:
    """All levels get a slot; a level unseen in training becomes all zeros."""
    if not categorical:
        return []
    indexer = StringIndexer(
        inputCols=[f"_cat_{c}" for c in categorical], outputCols=[f"_idx_{c}" for c in categorical], handleInvalid="keep"
    )
    encoder = OneHotEncoder(
        inputCols=[f"_idx_{c}" for c in categorical], outputCols=[f"_hot_{c}" for c in categorical], dropLast=True
    )
    return [indexer, encoder]


def fit_logistic(df: DataFrame, target: str, features: Sequence[str]) -> PipelineModel:
    """L2-penalised logistic regression with unit penalty on the summed loss and a free intercept."""
    numeric, categorical = split_features(df, features)
    n = df.count()
    imputation = fit_imputation(df, numeric, categorical)
    inputs = [f"_num_{c}" for c in imputation.scale] + [f"_hot_{c}" for c in categorical]
    regression = LogisticRegression(
        featuresCol="_features", labelCol=target, regParam=1.0 / n, elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-10
    )
    stages = [preparation_stage(imputation), *one_hot_stages(categorical)]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=inputs, outputCol="_features"), regression]).fit(df)


def coefficients(fitted: PipelineModel) -> list[tuple[str, float]]:
    """(name, value) of the intercept and of every input, levels as ``feature=level``."""
    regression = fitted.stages[-1]
    indexer = next((s for s in fitted.stages if isinstance(s, StringIndexerModel)), None)
    levels = dict(zip(indexer.getInputCols(), indexer.labelsArray)) if indexer else {}
    names: list[str] = []
    for c in next(s for s in fitted.stages if isinstance(s, VectorAssembler)).getInputCols():
        if c.startswith("_num_"):
            names.append(c.removeprefix("_num_"))
        else:
            feature = c.removeprefix("_hot_")
            names += [f"{feature}={level}" for level in levels[f"_cat_{feature}"]]
    return [("intercept", float(regression.intercept)), *zip(names, map(float, regression.coefficients.toArray()))]


def optimum_certificate(fitted: PipelineModel, df: DataFrame, target: str) -> DataFrame:
    """(coefficient, gradient): the slope of the penalised mean loss at the fitted value of every coefficient, zero at the optimum.

    Each row gives its error times its inputs, one long-form aggregate over feature and level sums them; the
    coefficients themselves are a small table. ``df`` must be the rows that were fitted.
    """
    scored = fitted.transform(df)
    error = vector_to_array("probability")[1] - F.col(target)
    numeric = [c.removeprefix("_num_") for c in scored.columns if c.startswith("_num_")]
    levels = [c.removeprefix("_cat_") for c in scored.columns if c.startswith("_cat_")]
    cells = [(F.lit("intercept"), F.lit(1.0)), *[(F.lit(c), F.col(f"_num_{c}")) for c in numeric]]
    cells += [(F.concat(F.lit(f"{c}="), F.col(f"_cat_{c}")), F.lit(1.0)) for c in levels]
    parts = F.array(*[F.struct(name.alias("coefficient"), (error * x).alias("slope")) for name, x in cells])
    sums = scored.select(F.explode(parts).alias("c")).groupBy("c.coefficient").agg(F.sum("c.slope").alias("slope"), F.count(F.lit(1)).alias("rows"))
    own = [(name, value if name != "intercept" else 0.0) for name, value in coefficients(fitted)]  # the intercept is free
    n = F.lit(float(df.count()))
    table = df.sparkSession.createDataFrame(own, "coefficient string, penalty double")
    return table.join(sums, "coefficient", "left").select("coefficient", ((F.coalesce("slope", F.lit(0.0)) + F.col("penalty")) / n).alias("gradient"))


def flat_metrics(metrics: dict, prefix: str = "") -> Iterator[tuple[str, float]]:
    """Every number among the metrics with its path as name, the confusion matrix included."""
    for k, v in metrics.items():
        if isinstance(v, (dict, list)):
            yield from flat_metrics(dict(enumerate(v)) if isinstance(v, list) else v, f"{prefix}{k}.")
        elif isinstance(v, (int, float)):
            yield f"{prefix}{k}", float(v)


def add_win_probability(model: PipelineModel, df: DataFrame) -> DataFrame:
    """The input columns plus ``win_probability``."""
    scored = model.transform(df)
    return scored.select(*df.columns, vector_to_array("probability")[1].alias("win_probability"))


def train_win_model(
    df: DataFrame, target: str, features: Sequence[str], keys: Sequence[str], test_share: float = 0.25, seed: int = 42
) -> tuple[PipelineModel, dict]:
    """(model, test metrics): drop rows without label, encode it, split each class by key hash, fit, evaluate."""
    require_columns(df, [target, *features, *keys])
    data = df.where(F.col(target).isNotNull())
    label = win_label(target) if isinstance(df.schema[target].dataType, T.StringType) else F.col(target).cast("int")
    data = data.select(label.alias("_label"), *dict.fromkeys([*features, *keys]))
    train, test = stratified_split(data, "_label", keys, test_share, seed)
    model = fit_logistic(train, "_label", features)
    scored = add_win_probability(model, test).select("_label", "win_probability").persist()
    try:
        return model, evaluate_classifier(scored, "_label", "win_probability")
    finally:
        scored.unpersist()


def prioritise(df: DataFrame, keys: Sequence[str], profit: str = "total_expected_profit") -> DataFrame:
    """Adds ``expected_deal_value`` (when the profit exists) and ``priority_rank`` 1..n, best first, missing last.

    Only keys and order columns are written, sorted and numbered; the wide rows meet their rank by the keys, which must
    name a row.
    """
    lead = ["win_probability"]
    if profit in df.columns:
        df = df.withColumn("expected_deal_value", expected_deal_value("win_probability", profit))
        lead = ["expected_deal_value", "win_probability"]
    order = [F.col(c).desc_nulls_last() for c in lead] + [F.col(k).asc() for k in keys]
    ranked = row_numbers(settle(df.select(*keys, *lead)), order, "priority_rank")
    names = {k: f"__{k}" for k in keys}
    own = ranked.select(*[F.col(k).alias(n) for k, n in names.items()], "priority_rank")
    same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(own[n]) for k, n in names.items()])
    return df.join(own, same).select(df["*"], "priority_rank")


def score_active_deals(model: PipelineModel, df: DataFrame, keys: Sequence[str], profit: str = "total_expected_profit") -> DataFrame:
    return prioritise(add_win_probability(model, df), keys, profit)


def top_deals(df: DataFrame, k: int, keys: Sequence[str]) -> DataFrame:
    """The k best deals without ranking the rest (a top-k sort keeps k rows per task)."""
    lead = [c for c in ("expected_deal_value", "win_probability") if c in df.columns]
    return df.orderBy(*[F.col(c).desc_nulls_last() for c in lead], *[F.col(x).asc() for x in keys]).limit(k)


def seeded_sample(df: DataFrame, k: int, keys: Sequence[str], seed: int) -> DataFrame:
    """k rows in hash order of their key: the same rows for any partitioning."""
    return df.orderBy(key_hash(keys, seed), *keys).limit(k)
