"""Forward valuation: project stats, roll rows a season on, value them, put an interval around, validate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.scalars import fold_name
from touchline.operators import joins, stats
from touchline.plans import features as M
from touchline.plans.training import TARGETS, as_numbers

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def _predicted(df: DataFrame, model: object, used: Sequence[str], name: str) -> DataFrame:
    """df with the model's prediction as ``name``; the features are read as numbers, the columns stay as they are."""
    own = df.columns
    inputs = df.withColumn("_keep", F.struct(*[F.col(f"`{c}`") for c in own]))
    scored = model.transform(as_numbers(inputs, used))
    return scored.select("_keep.*", F.col("prediction").alias(name))


def predict_batch(df: DataFrame, projections: Mapping[tuple[str, str], object], valuations: Mapping[str, object], used: Mapping[tuple[str, str], Sequence[str]], season: str | None = None, targets: Mapping[str, Sequence[str]] = TARGETS) -> DataFrame:
    """Every row (of one season, if asked) valued now and a season on; rows of no known position, or one without a valuation
    model, are left out.

    projections: (position, target) -> model of the next season's stat. valuations: position -> model of the log
    value. used: what each was trained on, valuations under (position, 'value').
    columns: player_id, player_name, position, current_season, next_season, observed_current_mv, current_mv_estimate,
    projected_mv_next, projected_log, n_fallback, notes, stage1_projections, mv_delta, mv_delta_pct (against the
    observed value, else the estimate).
    """
    rows = df if season is None else df.filter(F.col("season") == season)
    parts = []
    for position, value in valuations.items():
        part = rows.filter(F.col("primary_position") == position)
        mine = [t for t in targets.get(position, ()) if t in df.columns]
        columns = {t: f"_proj_{t}" for t in mine}
        for t in mine:
            if (position, t) in projections:
                part = _predicted(part, projections[(position, t)], used[(position, t)], columns[t])
            else:
                part = part.withColumn(columns[t], F.lit(None).cast("double"))
        part = _predicted(part, value, used[(position, "value")], "_now")
        fallback = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in columns.values()], F.lit(0))
        pairs = [x for t, c in columns.items() for x in (F.lit(t), F.col(c))]
        said = {
            "_season": F.col("season"),
            "_n": fallback,
            "_notes": M.fallback_notes(columns),
            "_stats": F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>"),
            "_seen": F.col("market_value_eur"),
        }
        ahead = _predicted(M.forward(part.withColumns(said), columns), value, used[(position, "value")], "_next")
        parts.append(
            ahead.select(
                "player_id",
                "player_name",
                F.lit(position).alias("position"),
                F.col("_season").alias("current_season"),
                F.col("season").alias("next_season"),
                F.col("_seen").alias("observed_current_mv"),
                F.expm1("_now").alias("current_mv_estimate"),
                F.expm1("_next").alias("projected_mv_next"),
                F.col("_next").alias("projected_log"),
                F.col("_n").alias("n_fallback"),
                F.col("_notes").alias("notes"),
                F.col("_stats").alias("stage1_projections"),
            )
        )
    out = reduce(lambda a, b: a.unionByName(b), parts)
    base = F.coalesce("observed_current_mv", "current_mv_estimate")
    return out.withColumn("mv_delta", F.col("projected_mv_next") - base).withColumn("mv_delta_pct", F.when(base != 0, 100 * F.col("mv_delta") / base))


def predict_one(df: DataFrame, player_id: str, season: str, *models: object, **settings: object) -> DataFrame:
    """``predict_batch`` of one player and season: one row, or an error at run time where there is none (the first of several)."""
    rows = df.filter((F.col("player_id") == player_id) & (F.col("season") == season)).orderBy(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).limit(1)
    out = predict_batch(rows, *models, **settings)
    count = out.agg(F.count(F.lit(1)).alias("_n"))
    found = count.join(out, F.lit(True), "left")  # one row on both sides
    missing = F.raise_error(F.lit(f"no row of {player_id} in {season}")).cast("string")
    return found.withColumn("player_id", F.when(F.col("_n") == 0, missing).otherwise(F.col("player_id"))).drop("_n")


def residual_quantiles(scored: DataFrame, actual: Column, predicted: Column, by: str = "position", least: int = 10) -> DataFrame:
    """(by, q05 .. q95): interpolated quantiles of actual - predicted, of the groups with ``least`` residuals.

    Both calibrations come from here: over a model's own training rows, and over the whole chain's projections
    against what came true.
    """
    residuals = scored.select(by, (actual - predicted).alias("_r")).filter("_r is not null")
    return stats.quantile_table(residuals, "_r", [by], QUANTILES).filter(F.col("n") >= least).drop("n")


def with_interval(predictions: DataFrame, quantiles: DataFrame, low: str = "q05", high: str = "q95", names: tuple[str, str] = ("ci_low", "ci_high")) -> DataFrame:
    """predictions with the interval of their position around ``projected_log``, in money. q05 to q95 is nominally 90 %; a
    position without quantiles has none."""
    q = quantiles.select(F.col("position").alias("_p"), F.col(low).alias("_lo"), F.col(high).alias("_hi"))
    out = predictions.join(q, F.col("position") == F.col("_p"), "left")
    return out.withColumns({names[0]: F.expm1(F.col("projected_log") + F.col("_lo")), names[1]: F.expm1(F.col("projected_log") + F.col("_hi"))}).drop("_p", "_lo", "_hi")


def validate_chain(predictions: DataFrame, actual: DataFrame, oracle: DataFrame | None = None) -> DataFrame:
    """(scenario, n, mae, r2_log, median_ratio, share_within, common): projections, the naive 'no change' and an oracle against
    what came true, each over the rows it has and, where ``common``, over those that all have.

    actual: player_id, actual_mv. oracle: player_id, oracle_mv, from models that saw the next season.
    """
    both = predictions.join(actual, "player_id")
    both = both.join(oracle, "player_id", "left") if oracle is not None else both.withColumn("oracle_mv", F.lit(None).cast("double"))
    columns = {"pipeline": "projected_mv_next", "naive": "observed_current_mv"} | ({"oracle": "oracle_mv"} if oracle is not None else {})
    shared = both.filter(reduce(lambda a, b: a & b, [F.col(c) > 0 for c in columns.values()]))
    parts = []
    for frame, common in ((both, False), (shared, True)):
        parts += [stats.scenario_metrics(frame, F.col("actual_mv"), F.col(c)).select(F.lit(name).alias("scenario"), "*", F.lit(common).alias("common")) for name, c in columns.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def match_fees(fees: DataFrame, rows: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Paid transfers with the row of the same folded name whose age is nearest, ``tolerance`` years off at most.

    fees: fee_id, player_name, player_age, transfer_fee_eur. rows: row_id, player_name, age_at_season_end and more.
    Equal distances: the lower row_id. Transfers without such a row are left out.
    """
    paid = fees.filter(F.col("transfer_fee_eur") > 0).withColumns({"_n": fold_name(F.col("player_name")), "player_age": F.col("player_age").cast("double")})
    named = rows.withColumn("_n", fold_name(F.col("player_name")))
    near = joins.nearest_in_group(paid.filter("_n <> ''"), named, "_n", "fee_id", "player_age", "row_id", "age_at_season_end", tolerance)
    return near.join(paid.select("fee_id", "transfer_fee_eur"), "fee_id").join(rows.drop("player_name"), "row_id")


def fee_validation(matched: DataFrame, predicted: str, naive: str) -> DataFrame:
    """One row: n, median and mean ratio of prediction to fee, correlations, error and R2 of logs, and the same of the naive
    value where it is positive (naive_n, naive_pearson, naive_pearson_log, naive_median_ratio)."""
    fee, p, v = F.col("transfer_fee_eur"), F.col(predicted), F.col(naive)
    lf, lp = F.log1p(fee), F.log1p(p)
    n = F.count(F.lit(1))
    own = F.when(v > 0, v)
    return matched.filter(p.isNotNull()).agg(
        n.alias("n"), F.median(p / fee).alias("median_ratio"), F.avg(p / fee).alias("mean_ratio"), stats.pearson(p, fee).alias("pearson"), stats.pearson(lp, lf).alias("pearson_log"),
        F.avg(F.abs(lp - lf)).alias("log_mae"), F.when(F.var_pop(lf) > 0, 1 - F.sum((lf - lp) * (lf - lp)) / (F.var_pop(lf) * n)).alias("r2_log"),
        F.count(own).alias("naive_n"), stats.pearson(own, F.when(own.isNotNull(), fee)).alias("naive_pearson"), stats.pearson(F.log1p(own), F.when(own.isNotNull(), lf)).alias("naive_pearson_log"), F.median(own / fee).alias("naive_median_ratio"),
    )


def naive_error(df: DataFrame, current: Column, following: Column) -> DataFrame:
    """One row (n, mae): the error of 'the next value is the current one' on complete pairs."""
    d = F.abs(following - current)
    return df.agg(F.count(d).alias("n"), F.avg(d).alias("mae"))


def money_errors(df: DataFrame, actual_log: Column, predicted_log: Column) -> DataFrame:
    """One row (n, mae_eur, median_ae_eur) of log predictions in money."""
    e = F.abs(F.expm1(predicted_log) - F.expm1(actual_log))
    return df.agg(F.count(e).alias("n"), F.avg(e).alias("mae_eur"), F.lit(stats.exact_median(df, e)).cast("double").alias("median_ae_eur"))

