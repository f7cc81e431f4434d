"""Training: datasets, learners with their grids, metrics of every slot, the best model of each, importance, saving.

A slot is a position, or a position and a target; there are a handful, so the loop over them runs on the driver and
every fit in it on the cluster.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.operators.windows import consecutive_pairs
from touchline.plans.lineage import cut
from touchline.plans.models import fold_of, guard_leakage, known_features, numeric_features

#: Stats that are projected a season on, by position. Fixed values.
TARGETS = {
    "GK": ["saves_per_90", "save_pct", "clean_sheets_per_match", "goals_against_per_90"],
    "DEF": ["tackles_won_per_90", "interceptions_per_90", "goals_per_90"],
    "MID": ["goals_per_90", "assists_per_90", "xg_per_90", "understat_xa_per_90", "tackles_won_per_90", "interceptions_per_90"],
    "FWD": ["goals_per_90", "shots_per_90", "xg_per_90", "assists_per_90", "npxg_per_90", "understat_xa_per_90"],
}
#: Columns that are no features: what is valued, and what is said about a row. Fixed values.
NO_FEATURES = ["market_value_eur", "log_market_value", "log_market_value_lag1", "delta_log_market_value", "market_value_date", "resolve_score", "min_minutes_threshold", "meets_min_minutes", "season_end_year"]
#: Learners from the simplest on; of equal errors the simpler wins. Fixed values.
ORDER = ["ridge", "trees", "mlp", "stacked"]
LEAST_ROWS = 30
#: Rank error of the medians that nulls are filled with: a sketch whose size the bound fixes, not the rows.
MEDIAN_ERROR = 0.001


def projection_pairs(df: DataFrame, targets: Sequence[str], train: Sequence[str], valid: Sequence[str], period: str = "season") -> DataFrame:
    """Rows whose next season is the year after, both with enough minutes and in one position, with next_<target> and their split
    by the current season; others are left out."""
    have = [t for t in targets if t in df.columns]
    dated = df.withColumn("_year", F.substring(period, 1, 4).try_cast("int"))
    pairs = consecutive_pairs(dated, "player_id", "_year", have, F.coalesce(F.col("meets_min_minutes"), F.lit(False)), ["primary_position"])
    split = F.when(F.col(period).isin(list(train)), "train").when(F.col(period).isin(list(valid)), "val")
    return pairs.drop("_year").withColumn("split", split).filter(F.col("split").isNotNull())


def valuation_rows(df: DataFrame, train: Sequence[str], valid: Sequence[str], period: str = "season") -> DataFrame:
    """Rows with a market value and enough minutes, split by season; others are left out."""
    split = F.when(F.col(period).isin(list(train)), "train").when(F.col(period).isin(list(valid)), "val")
    return df.filter(F.col("market_value_eur").isNotNull() & F.coalesce(F.col("meets_min_minutes"), F.lit(False))).withColumn("split", split).filter(F.col("split").isNotNull())


def features_of(train: DataFrame) -> list[str]:
    """Numeric and boolean columns that may be features and that train knows at all (one action), guarded against leaks."""
    names = [c for c in numeric_features(train, NO_FEATURES) if not c.startswith("next_")]
    guard_leakage(names, [c for c in train.columns if "market_value" in c and c != "league_value_multiplier"])
    return known_features(train, names)


def as_numbers(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """df with its features as doubles (flags too) and NaN as null."""
    doubles = {c: F.col(c).cast("double") for c in features}
    return df.withColumns({c: F.when(~F.isnan(d), d) for c, d in doubles.items()})


def _stages(features: Sequence[str], scaled: bool) -> list:
    filled = [f"_f_{c}" for c in features]
    stages = [Imputer(inputCols=list(features), outputCols=filled, strategy="median", relativeError=MEDIAN_ERROR), VectorAssembler(inputCols=filled, outputCol="_x")]
    return [*stages, StandardScaler(inputCol="_x", outputCol="_z", withMean=True)] if scaled else stages


def ridge(features: Sequence[str], label: str, alpha: float = 0.1) -> Pipeline:
    """Medians for nulls, standardised, ridge."""
    return Pipeline(stages=[*_stages(features, True), LinearRegression(featuresCol="_z", labelCol=label, regParam=alpha, elasticNetParam=0.0, standardization=False)])


def trees(features: Sequence[str], label: str, depth: int = 3, step: float = 0.1, rounds: int = 20) -> Pipeline:
    """Medians for nulls, boosted trees."""
    return Pipeline(stages=[*_stages(features, False), GBTRegressor(featuresCol="_x", labelCol=label, maxDepth=depth, stepSize=step, maxIter=rounds, seed=7)])


RIDGE_GRID = [{"alpha": a} for a in (0.01, 0.1, 1.0, 10.0)]
TREE_GRID = [{"depth": d, "step": s, "rounds": r} for d in (3, 5, 7) for s in (0.05, 0.1) for r in (200, 500)]


def search(make, train: DataFrame, features: Sequence[str], label: str, key: str, grid: Sequence[Mapping], folds: int) -> tuple[PipelineModel, dict, float]:
    """(model, settings, mean absolute error over the folds) of the best settings; folds go by hash of the key. One setting
    is fitted without a search, its error NaN. The first of equal settings wins."""
    if len(grid) == 1:
        return make(features, label, **grid[0]).fit(train), dict(grid[0]), float("nan")
    data, errors = train.withColumn("_f", fold_of(key, folds)).persist(), []
    for settings in grid:
        per = []
        for k in range(folds):
            scored = make(features, label, **settings).fit(data.filter(F.col("_f") != k)).transform(data.filter(F.col("_f") == k))
            per.append(scored.agg(F.avg(F.abs(F.col("prediction") - F.col(label)))).first()[0] or 0.0)
        errors.append(sum(per) / folds)
    data.unpersist()
    best = min(range(len(grid)), key=lambda i: (errors[i], i))
    return make(features, label, **grid[best]).fit(train), dict(grid[best]), errors[best]


@dataclass
class Mlp:
    """A network of ReLU layers over median-filled, standardised features; predicts in Arrow batches."""

    features: list[str]
    medians: list[float]
    means: list[float]
    scales: list[float]
    weights: list[np.ndarray] = field(default_factory=list)
    offsets: list[np.ndarray] = field(default_factory=list)
    label: tuple[float, float] = (0.0, 1.0)

    def inputs(self, frame: pd.DataFrame) -> np.ndarray:
        x = frame[self.features].to_numpy(dtype=float)
        return (np.where(np.isnan(x), self.medians, x) - self.means) / self.scales

    def run(self, x: np.ndarray) -> list[np.ndarray]:
        layers = [x]
        for i, (w, b) in enumerate(zip(self.weights, self.offsets)):
            x = x @ w + b
            layers.append(x if i == len(self.weights) - 1 else np.maximum(x, 0.0))
            x = layers[-1]
        return layers

    def transform(self, df: DataFrame) -> DataFrame:
        @F.pandas_udf("double")
        def predict(part: pd.DataFrame) -> pd.Series:
            return pd.Series(self.run(self.inputs(part))[-1][:, 0] * self.label[1] + self.label[0])

        return df.withColumn("prediction", predict(F.struct(*[F.col(c).cast("double").alias(c) for c in self.features])))

    def save(self, spark: SparkSession, path: str) -> None:
        state = {k: [a.tolist() for a in v] if k in ("weights", "offsets") else v for k, v in self.__dict__.items()}
        spark.createDataFrame([(json.dumps(state),)], "model string").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Mlp:
        state = json.loads(spark.read.parquet(path).first()["model"])
        return Mlp(**state | {"weights": [np.array(a) for a in state["weights"]], "offsets": [np.array(a) for a in state["offsets"]], "label": tuple(state["label"])})


def fit_mlp(train: DataFrame, features: Sequence[str], label: str, key: str, hidden: Sequence[int] = (64,), alpha: float = 0.001, most_rows: int = 20_000, epochs: int = 500, seed: int = 7) -> Mlp:
    """A network fitted by Adam on at most ``most_rows`` rows, a hash of the key deciding which, stopping early on a tenth of them.

    The bound holds for any table: the sample is what reaches the driver.
    """
    rows = train.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias("_y"), F.xxhash64(key).alias("_h")).filter("_y is not null")
    frame = rows.orderBy("_h").limit(most_rows).toPandas()
    x = frame[list(features)].to_numpy(dtype=float)
    medians = np.nan_to_num(np.nanmedian(x, axis=0)) if len(x) else np.zeros(len(features))
    x = np.where(np.isnan(x), medians, x)
    means, scales = x.mean(axis=0), x.std(axis=0)
    scales[scales == 0] = 1.0
    y = frame["_y"].to_numpy(dtype=float)
    spread = float(y.std()) or 1.0
    rng = np.random.default_rng(seed)
    sizes = [len(features), *hidden, 1]
    net = Mlp(list(features), medians.tolist(), means.tolist(), scales.tolist(), [rng.normal(0, np.sqrt(2 / a), (a, b)) for a, b in zip(sizes, sizes[1:])], [np.zeros(b) for b in sizes[1:]], (float(y.mean()), spread))
    x, t = (x - means) / scales, (y - y.mean()) / spread
    held = np.arange(len(x)) % 10 == 0
    fit_x, fit_t, own = x[~held], t[~held], np.arange((~held).sum())
    moments = [[np.zeros_like(p) for p in (*net.weights, *net.offsets)] for _ in range(2)]
    size = max(16, min(200, len(own) // 20))  # few rows are learnt in small steps
    best, kept, wait, step = np.inf, None, 0, 0
    for _ in range(epochs):
        rng.shuffle(own)
        for i in range(0, len(own), size):
            part = own[i : i + size]
            layers = net.run(fit_x[part])
            delta, grads_w, grads_b = 2 * (layers[-1] - fit_t[part, None]) / len(part), [], []
            for k in range(len(net.weights) - 1, -1, -1):
                grads_w.insert(0, layers[k].T @ delta + alpha * net.weights[k] / len(own))
                grads_b.insert(0, delta.sum(axis=0))
                delta = (delta @ net.weights[k].T) * (layers[k] > 0)
            step += 1
            for j, (p, g) in enumerate(zip((*net.weights, *net.offsets), (*grads_w, *grads_b))):
                moments[0][j] = 0.9 * moments[0][j] + 0.1 * g
                moments[1][j] = 0.999 * moments[1][j] + 0.001 * g * g
                p -= 0.001 * (moments[0][j] / (1 - 0.9**step)) / (np.sqrt(moments[1][j] / (1 - 0.999**step)) + 1e-8)
        error = float(np.mean((net.run(x[held])[-1][:, 0] - t[held]) ** 2)) if held.any() else 0.0
        if error < best - 1e-4:
            best, kept, wait = error, ([w.copy() for w in net.weights], [b.copy() for b in net.offsets]), 0
        else:
            wait += 1
            if wait == 10:
                break
    if kept:
        net.weights, net.offsets = kept
    return net


@dataclass
class Stack:
    """A ridge over the predictions of other models."""

    bases: dict[str, object]
    meta: PipelineModel

    def transform(self, df: DataFrame) -> DataFrame:
        names, out = df.columns, df
        for name, model in self.bases.items():
            out = model.transform(out).select(*names, *[f"p_{b}" for b in self.bases if f"p_{b}" in out.columns], F.col("prediction").alias(f"p_{name}"))
        return self.meta.transform(out).select(*names, "prediction")


def fit_stack(train: DataFrame, refit: Mapping[str, object], bases: Mapping[str, object], label: str, key: str, folds: int = 3) -> Stack:
    """``bases`` (name -> fitted on all of train) under a ridge over predictions out of folds. refit: name -> function of a
    DataFrame that fits that base anew."""
    data, parts = train.withColumn("_f", fold_of(key, folds)), []
    names = train.columns
    for k in range(folds):
        part = data.filter(F.col("_f") == k)
        for i, name in enumerate(bases):
            done = [f"p_{b}" for b in list(bases)[:i]]
            part = refit[name](data.filter(F.col("_f") != k)).transform(part).select(*names, *done, F.col("prediction").alias(f"p_{name}"))
        parts.append(part)
    oof = parts[0]
    for p in parts[1:]:
        oof = oof.unionByName(p)
    return Stack(dict(bases), ridge([f"p_{b}" for b in bases], label, 0.01).fit(oof))


@dataclass
class Learners:
    """Which learners run, with what settings to choose from. The tree grid of ``TREE_GRID`` is the full one."""

    names: Sequence[str] = ("ridge", "trees", "mlp", "stacked")
    ridge_grid: Sequence[Mapping] = field(default_factory=lambda: RIDGE_GRID)
    tree_grid: Sequence[Mapping] = field(default_factory=lambda: TREE_GRID)
    ridge_folds: int = 5
    tree_folds: int = 3
    hidden: Sequence[int] = (64,)
    alpha: float = 0.001
    most_rows: int = 20_000


def fit_all(train: DataFrame, features: Sequence[str], label: str, key: str, learners: Learners) -> dict[str, tuple[object, float]]:
    """learner -> (model, error over folds) for one slot."""
    out: dict[str, tuple[object, float]] = {}
    refit: dict[str, object] = {}
    for name, make, grid, folds in (("ridge", ridge, learners.ridge_grid, learners.ridge_folds), ("trees", trees, learners.tree_grid, learners.tree_folds)):
        if name in learners.names:
            model, settings, error = search(make, train, features, label, key, grid, folds)
            out[name], refit[name] = (model, error), lambda d, make=make, settings=settings: make(features, label, **settings).fit(d)
    if "mlp" in learners.names:
        fit = lambda d: fit_mlp(d, features, label, key, learners.hidden, learners.alpha, learners.most_rows)
        out["mlp"], refit["mlp"] = (fit(train), float("nan")), fit
    if "stacked" in learners.names and len(out) >= 2:
        out["stacked"] = (fit_stack(train, refit, {k: m for k, (m, _) in out.items()}, label, key), float("nan"))
    return out


def slot_metrics(scored: DataFrame, label: str, baseline: str) -> DataFrame:
    """One row: n_val, mae, rmse, r2, mape (over labels beyond 0.1), baseline_mae, improvement, and for labels that are logs of
    money mae_eur and median_ae_eur."""
    y, p, b = F.col(label).cast("double"), F.col("prediction"), F.col(baseline).cast("double")
    euro = F.abs(F.expm1(p) - F.expm1(y))
    n = F.count(F.lit(1))
    one = scored.filter(y.isNotNull() & p.isNotNull()).agg(
        n.alias("n_val"), F.avg(F.abs(y - p)).alias("mae"), F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"),
        F.when((n > 1) & (F.var_pop(y) > 0), 1 - F.sum((y - p) * (y - p)) / (F.var_pop(y) * n)).alias("r2"),
        F.avg(F.when(F.abs(y) > 0.1, F.abs((y - p) / y))).alias("mape"), F.avg(F.abs(y - b)).alias("baseline_mae"), F.avg(euro).alias("mae_eur"), F.median(euro).alias("median_ae_eur"),
    )
    return one.withColumn("improvement", F.when(F.col("baseline_mae") > 0, (F.col("baseline_mae") - F.col("mae")) / F.col("baseline_mae")))


def train_slots(spark: SparkSession, data: DataFrame, slots: Sequence[tuple[str, str, str, str | None]], key: str = "player_id", learners: Learners = Learners()) -> tuple[DataFrame, dict, dict]:
    """(metrics, models, features) over slots of (position, target, label, baseline column or None for the median of train).

    data has ``primary_position`` and ``split``. Slots of fewer than LEAST_ROWS training rows are left out. metrics:
    position, target, model, n_train, the columns of ``slot_metrics``, cv_mae. models: (position, target, learner) ->
    model. features: (position, target) -> what it was trained on.
    """
    rows, models, used = [], {}, {}
    data = cut(data)  # every fit reads it again
    for position, target, label, baseline in slots:
        if label not in data.columns:
            continue
        mine = data.filter((F.col("primary_position") == position) & F.col(label).isNotNull())
        train = mine.filter("split = 'train'")
        n_train = train.count()
        if n_train < LEAST_ROWS:
            continue
        features = features_of(train)
        train, valid = as_numbers(train, features).persist(), as_numbers(mine.filter("split = 'val'"), features)
        valid = valid.withColumn("_base", F.lit(train.agg(F.median(label)).first()[0])) if baseline is None else valid.filter(F.col(baseline).isNotNull()).withColumn("_base", F.col(baseline))
        used[(position, target)] = features
        for name, (model, error) in fit_all(train, features, label, key, learners).items():
            models[(position, target, name)] = model
            rows.append({"position": position, "target": target, "model": name, "n_train": n_train, "cv_mae": error, **slot_metrics(model.transform(valid), label, "_base").first().asDict()})
        train.unpersist()
    schema = "position string, target string, model string, n_train long, n_val long, mae double, rmse double, r2 double, mape double, baseline_mae double, improvement double, mae_eur double, median_ae_eur double, cv_mae double"
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema), models, used


def best_models(metrics: DataFrame, slot: Sequence[str] = ("position", "target"), order: Sequence[str] = ORDER) -> DataFrame:
    """The row of least error of each slot as it stands; of equal ones the simpler model. Nulls come last."""
    rank = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    w = Window.partitionBy(*slot).orderBy(F.col("mae").asc_nulls_last(), rank)
    return metrics.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def importance(model: object, features: Sequence[str], scored_on: DataFrame | None = None, label: str | None = None, top: int = 20, repeats: int = 3) -> list[tuple[str, float]]:
    """The ``top`` features: by gain for trees, by |coefficient| for ridge, else by how much the error grows where the feature's
    values change places (``repeats`` times; scored_on and label are needed)."""
    last = model.stages[-1] if isinstance(model, PipelineModel) else None
    if hasattr(last, "featureImportances"):
        values = [float(v) for v in last.featureImportances.toArray()]
    elif hasattr(last, "coefficients"):
        values = [abs(float(v)) for v in last.coefficients]
    else:
        error = lambda df: model.transform(df).agg(F.avg(F.abs(F.col("prediction") - F.col(label)))).first()[0] or 0.0
        base = error(scored_on)
        values = [sum(error(shuffled(scored_on, c, k)) for k in range(repeats)) / repeats - base for c in features]
    return sorted(zip(features, values), key=lambda kv: (-kv[1], kv[0]))[:top]


def shuffled(df: DataFrame, column: str, seed: int, block_rows: int = 1000) -> DataFrame:
    """df with the values of a column dealt out anew within blocks by hash, of some ``block_rows`` rows each (counts the rows once)."""
    blocks = df.count() // block_rows + 1
    h = F.xxhash64(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.lit(seed))
    keyed = df.withColumn("_h", h).withColumn("_b", F.pmod("_h", F.lit(blocks)))
    a = keyed.withColumn("_i", F.row_number().over(Window.partitionBy("_b").orderBy("_h")))
    b = keyed.select("_b", F.col(column).alias("_v"), F.xxhash64("_h", F.lit(seed)).alias("_g")).withColumn("_i", F.row_number().over(Window.partitionBy("_b").orderBy("_g"))).drop("_g")
    return a.join(b, ["_b", "_i"]).withColumn(column, F.col("_v")).drop("_h", "_b", "_i", "_v")


def save_model(spark: SparkSession, model: object, path: str) -> None:
    """A model under a folder, overwriting what is there; a stack with its bases beside it."""
    if isinstance(model, Stack):
        for name, base in model.bases.items():
            save_model(spark, base, f"{path}/base_{name}")
        spark.createDataFrame([(",".join(model.bases),)], "bases string").write.mode("overwrite").parquet(f"{path}/bases")
        model.meta.write().overwrite().save(f"{path}/meta")
    elif isinstance(model, Mlp):
        model.save(spark, path)
    else:
        model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str, kind: str) -> object:
    """What ``save_model`` wrote; kind: the learner's name."""
    if kind == "stacked":
        names = spark.read.parquet(f"{path}/bases").first()["bases"].split(",")
        return Stack({n: load_model(spark, f"{path}/base_{n}", n) for n in names}, PipelineModel.load(f"{path}/meta"))
    return Mlp.load(spark, path) if kind == "mlp" else PipelineModel.load(path)


def load_best(spark: SparkSession, metrics: DataFrame, root: str) -> dict[tuple[str, str], object]:
    """(position, target) -> the best model by the metrics, from <root>/<position>_<target>_<model>."""
    return {(r["position"], r["target"]): load_model(spark, f"{root}/{r['position']}_{r['target']}_{r['model']}", r["model"]) for r in best_models(metrics).collect()}
