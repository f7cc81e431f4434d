"""Fitting and scoring with pyspark.ml: ridge, boosted trees, stacking, forest of metrics.

There is no multi-layer perceptron regressor in pyspark.ml; that learner is left out (README).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_features(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    """Numeric and boolean columns but the excluded ones, in schema order."""
    kinds = (T.NumericType, T.BooleanType)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds) and f.name not in exclude]


def guard_leakage(features: Sequence[str], forbidden: Sequence[str]) -> None:
    """ValueError where a feature would give the label away."""
    bad = sorted(f for f in features if f in forbidden or f.startswith("next_"))
    if bad:
        raise ValueError(f"features that leak the label: {bad}")


def known_features(df: DataFrame, features: Sequence[str]) -> list[str]:
    """Features with any value at all; one action over all columns."""
    row = df.agg(*[F.count(c).alias(c) for c in features]).first()
    return [c for c in features if row[c] > 0]


def fill_medians(train: DataFrame, others: Sequence[DataFrame], features: Sequence[str]) -> list[DataFrame]:
    """train and others with nulls filled by the exact medians of train (0 where train knows none)."""
    doubles = {c: F.col(c).cast("double") for c in features}
    row = train.agg(*[F.median(d).alias(c) for c, d in doubles.items()]).first()
    fill = {c: float(row[c]) if row[c] is not None else 0.0 for c in features}
    return [d.withColumns(doubles).na.fill(fill) for d in (train, *others)]


def ridge(features: Sequence[str], label: str, alpha: float = 0.1, output: str = "prediction") -> Pipeline:
    """Standardised ridge regression."""
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x"), StandardScaler(inputCol="_x", outputCol="_z", withMean=True), LinearRegression(featuresCol="_z", labelCol=label, predictionCol=output, regParam=alpha, elasticNetParam=0.0, standardization=False)])


def boosted(features: Sequence[str], label: str, output: str = "prediction", depth: int = 3, rounds: int = 20) -> Pipeline:
    """Gradient-boosted trees."""
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x"), GBTRegressor(featuresCol="_x", labelCol=label, predictionCol=output, maxDepth=depth, maxIter=rounds, seed=7)])


def fold_of(key: str, folds: int) -> F.Column:
    """A fold by hash of a key: the same on every run and at every size."""
    return F.pmod(F.xxhash64(key), F.lit(folds)).cast("int")


def grid_ridge(train: DataFrame, features: Sequence[str], label: str, key: str, alphas: Sequence[float] = (0.01, 0.1, 1.0, 10.0), folds: int = 3) -> tuple[float, PipelineModel]:
    """(alpha, model) with the least mean absolute error over hash folds."""
    data = train.withColumn("_f", fold_of(key, folds))
    score = {}
    for a in alphas:
        errors = []
        for k in range(folds):
            fitted = ridge(features, label, a).fit(data.filter(F.col("_f") != k))
            errors.append(fitted.transform(data.filter(F.col("_f") == k)).agg(F.avg(F.abs(F.col("prediction") - F.col(label)))).first()[0] or 0.0)
        score[a] = sum(errors) / folds
    best = min(alphas, key=lambda a: (score[a], a))
    return best, ridge(features, label, best).fit(train)


def stacked(train: DataFrame, valid: DataFrame, features: Sequence[str], label: str, key: str, folds: int = 3) -> DataFrame:
    """valid with the predictions of ridge and trees and of a ridge over their out-of-fold predictions."""
    bases = {"p_ridge": ridge(features, label, output="p_ridge"), "p_trees": boosted(features, label, output="p_trees")}
    data, parts = train.withColumn("_f", fold_of(key, folds)), []
    for k in range(folds):
        part = data.filter(F.col("_f") == k)
        for p in bases.values():
            part = p.fit(data.filter(F.col("_f") != k)).transform(part).drop("_x", "_z")
        parts.append(part)
    oof = parts[0]
    for p in parts[1:]:
        oof = oof.unionByName(p)
    meta = ridge(list(bases), label, alpha=0.01).fit(oof.drop("prediction"))
    out = valid
    for p in bases.values():
        out = p.fit(train).transform(out).drop("_x", "_z")
    return meta.transform(out).drop("_x", "_z")


def with_residual_interval(scored: DataFrame, calibration: DataFrame, value: str, prediction: str, by: Sequence[str], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """scored with [ci_low, ci_high] from exact residual quantiles of the calibration rows of the same group.

    The nominal level is high - low: 90 % by default.
    """
    q = calibration.select(*by, (F.col(value) - F.col(prediction)).alias("_r")).groupBy(*by).agg(F.percentile("_r", F.array(F.lit(low), F.lit(high))).alias("_q"))
    return scored.join(q, list(by), "left").withColumns({"ci_low": F.col(prediction) + F.get("_q", 0), "ci_high": F.col(prediction) + F.get("_q", 1)}).drop("_q")
