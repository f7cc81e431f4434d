"""Statistics that describe a panel: blocks of columns, distributions, gaps and their causes, peaks, outliers, careers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.scalars import matches_text
from touchline.operators import stats
from touchline.operators.windows import dominant_value, pct_change, top_k

#: Blocks of a panel's columns; what is in none is performance. Fixed values.
BLOCKS = {
    "identity": ["player_id", "player_name", "player_name_fbref", "birth_year", "birth_date", "born", "nation", "nationality", "continent_group"],
    "season_context": ["season", "season_end_year", "season_end_date", "league", "league_tier", "uefa_coefficient", "league_value_multiplier", "club", "is_loan", "is_split_season", "age_at_season_end", "age_precision", "minutes_played", "meets_min_minutes", "min_minutes_threshold"],
    "position": ["primary_position", "detailed_position"],
    "target": ["market_value_eur", "market_value_date", "log_market_value"],
    "contract": ["contract_end_date", "contract_remaining_months", "has_contract_date"],
    "external": ["fifa_rating", "fifa_potential", "worldcup_25_squad"],
    "xg": ["xg", "xag", "npxg", "understat_xg", "understat_xa", "xg_source"],
    "provenance": ["resolve_method", "resolve_score", "data_richness"],
}
#: Stats only goalkeepers have, and columns a source does not give for all. Fixed values.
KEEPER_STATS = {
    "goals_against", "goals_against_per_90", "shots_on_target_against", "saves", "save_pct", "gk_wins", "gk_draws", "gk_losses", "clean_sheets", "clean_sheet_pct",
    "gk_penalty_attempts", "gk_penalty_allowed", "gk_penalty_saved", "gk_penalty_missed", "gk_penalty_save_pct",
}
SOURCE_GAPS = {"xg", "xag", "npxg", "understat_xa", "understat_xg", "fifa_rating", "fifa_potential"}


def column_blocks(columns: Sequence[str]) -> dict[str, list[str]]:
    """The columns of each block that are there; performance is told apart by names with a table's prefix."""
    known = {c for block in BLOCKS.values() for c in block}
    rest = [c for c in columns if c not in known]
    return {k: [c for c in v if c in columns] for k, v in BLOCKS.items()} | {"performance_clean": [c for c in rest if "__" not in c], "performance_namespaced": [c for c in rest if "__" in c]}


def gap_cause(column: str) -> str:
    """Why a column has gaps: a source's gap, a stat of keepers or of others, a sparse target or contract, or none of these."""
    if "psxg" in column or column in SOURCE_GAPS:
        return "source_gap"
    if column in KEEPER_STATS:
        return "structural_gk"
    for block, cause in (("target", "target_sparse"), ("contract", "contract_sparse")):
        if column in BLOCKS[block]:
            return cause
    return "other" if any(column in block for block in BLOCKS.values()) else "structural_outfield"


def gaps(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, n_rows, n_null, null_rate, cause) from one pass over all columns; NaN counts as null."""
    numbers = {n for n, t in df.dtypes if t in ("double", "float")}
    clean = df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in numbers else F.col(c) for c in columns])
    cause = reduce(lambda c, n: c.when(F.col("column_name") == n, gap_cause(n)), columns, F.when(F.lit(False), ""))
    return stats.null_rates(clean, columns).withColumn("cause", cause)


def share_where(df: DataFrame, shares: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """One row with, for each name -> (rows, condition), the share of these rows that meet the condition, from one pass."""
    return df.agg(*[F.avg(F.when(rows, F.coalesce(met, F.lit(False)).cast("double"))).alias(n) for n, (rows, met) in shares.items()])


def value_distribution(df: DataFrame, value: str) -> DataFrame:
    """One row: n, median, population skewness and excess kurtosis of the values and of their logs."""
    x = df.select(F.col(value).cast("double").alias("x")).filter("x is not null and not isnan(x)").withColumn("y", F.log1p("x"))
    return x.agg(F.count("x").alias("n"), F.median("x").alias("median"), F.skewness("x").alias("skew_raw"), F.kurtosis("x").alias("kurtosis_raw"), F.skewness("y").alias("skew_log"), F.kurtosis("y").alias("kurtosis_log"))


def medians_in_order(df: DataFrame, value: str, dimension: str, order: Sequence[str], change: bool = False) -> DataFrame:
    """(dimension, place, median, mean[, change]): a row for each entry of ``order``, null where it has no values; change is
    against the entry before."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(v, i) for i, v in enumerate(order)], f"{dimension} string, place int")
    by = df.groupBy(F.col(dimension).alias("_d")).agg(F.median(value).alias("median"), F.avg(value).alias("mean"))
    out = wanted.join(by, F.col(dimension) == F.col("_d"), "left").drop("_d")
    return pct_change(out, "place", "median", "change") if change else out


def several_values(df: DataFrame, entity: str, column: str) -> DataFrame:
    """One row (n_entities, n_changers, share): entities with more than one value of a column."""
    per = df.filter(F.col(entity).isNotNull()).groupBy(entity).agg(F.count_distinct(column).alias("_d"))
    return per.agg(F.count(F.lit(1)).alias("n_entities"), F.count(F.when(F.col("_d") > 1, 1)).alias("n_changers")).withColumn("share", F.when(F.col("n_entities") > 0, F.col("n_changers") / F.col("n_entities")))


def age_summary(df: DataFrame, age: str, low: float = 15, high: float = 43) -> DataFrame:
    """One row: least, median and greatest age, and how many are not plausible."""
    a = F.when(~F.isnan(F.col(age)), F.col(age))
    return df.agg(F.min(a).alias("min_age"), F.median(a).alias("median_age"), F.max(a).alias("max_age"), F.count(F.when((a < low) | (a > high), 1)).alias("n_implausible"))


def local_peak(x: np.ndarray, y: np.ndarray, w: np.ndarray, share: float) -> float:
    """The x at which a locally weighted line through (x, y, weight) stands highest: tricube over the nearest ``share`` of the weight."""
    order = np.argsort(x)
    x, y, w = x[order], y[order], w[order]
    need, best, at = share * w.sum(), -np.inf, float("nan")
    for v in x:
        d = np.abs(x - v)
        near = np.argsort(d, kind="stable")
        reach = d[near[min(np.searchsorted(np.cumsum(w[near]), need), len(x) - 1)]]
        k = w * (1 - np.minimum(d / reach, 1.0) ** 3) ** 3 if reach > 0 else w * (d == 0)
        s, sx, sy = k.sum(), (k * x).sum(), (k * y).sum()
        sxx, sxy = (k * x * x).sum(), (k * x * y).sum()
        slope = (s * sxy - sx * sy) / (s * sxx - sx * sx) if s * sxx - sx * sx > 1e-12 else 0.0
        fitted = (sy - slope * sx) / s + slope * v
        if fitted > best:
            best, at = fitted, float(v)
    return at


def peak_ages(df: DataFrame, age: str, value: str, by: str, share: float = 0.5, least: int = 50, step: float = 0.1) -> DataFrame:
    """(by, n, peak_age): the age at which a local regression of value on age stands highest; null under ``least`` rows.

    Ages are first put into bins of ``step`` years with the mean value and the count of each, by a combining
    aggregate: what reaches a task are the bins of one group, a few hundred however many rows.
    """
    known = df.filter(F.col(age).isNotNull() & ~F.isnan(age) & F.col(value).isNotNull() & F.col(by).isNotNull())
    bins = known.groupBy(by, F.round(F.col(age) / step).cast("long").alias("_b")).agg(F.count(F.lit(1)).cast("double").alias("w"), F.avg(value).alias("y"), F.avg(age).alias("x"))

    def run(part):
        import pandas as pd

        n = int(part["w"].sum())
        peak = local_peak(part["x"].to_numpy(), part["y"].to_numpy(), part["w"].to_numpy(), share) if n >= least else None
        return pd.DataFrame({by: [part[by].iloc[0]], "n": [n], "peak_age": [peak]})

    return bins.select(by, "x", "y", "w").groupBy(by).applyInPandas(run, f"{by} string, n long, peak_age double")


def source_agreement(df: DataFrame, a: str, b: str, source: str, least: int = 11) -> DataFrame:
    """(source, n, pearson, mean_difference): how b follows a by source, and over all as source 'all'; small sources are left out."""
    x = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"), F.col(source).alias("source")).filter("a is not null and b is not null and not isnan(a) and not isnan(b)")
    both = x.unionByName(x.withColumn("source", F.lit("all")))
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"), stats.pearson("a", "b").alias("pearson"), F.avg(F.col("b") - F.col("a")).alias("mean_difference")).filter((F.col("n") >= least) | (F.col("source") == "all"))


def extremes(df: DataFrame, a: str, b: str, unique: str, k: int, columns: Sequence[str]) -> DataFrame:
    """The k rows in which b exceeds a most, and least, as side 'over' and 'under'; ties by the unique column."""
    d = df.withColumn("difference", F.col(b).cast("double") - F.col(a).cast("double")).filter("difference is not null and not isnan(difference)").select(*columns, unique, "difference")
    return top_k(d, F.col("difference").desc(), unique, k).withColumn("side", F.lit("over")).unionByName(top_k(d, F.col("difference"), unique, k).withColumn("side", F.lit("under")))


def outlier_counts(df: DataFrame, minutes: str, value: str, few_minutes: float = 100, much: float = 10e6, many_minutes: float = 3500) -> DataFrame:
    """One row: rows of few minutes and much value, the most minutes, and rows of many minutes."""
    return df.agg(F.count(F.when((F.col(minutes) < few_minutes) & (F.col(value) > much), 1)).alias("n_low_min_high_mv"), F.max(minutes).cast("double").alias("max_minutes"), F.count(F.when(F.col(minutes) > many_minutes, 1)).alias("n_over_minutes"))


def career_of(df: DataFrame, pattern: str, name: str = "player_name", order: str = "season") -> DataFrame:
    """(player_id, name, seasons, leagues) of the player with most rows whose name matches a regular expression, whatever the
    case; no row where none does."""
    hits = df.filter(matches_text(F.col(name), pattern)).withColumn("_one", F.lit(1))
    most = dominant_value(hits, "_one", "player_id").select(F.col("player_id").alias("_p"))
    rows = df.join(F.broadcast(most), F.col("player_id") == F.col("_p"))  # one row at most
    by = F.array_sort(F.collect_list(F.struct(order, "league", name)))  # the seasons of one player
    return rows.groupBy("player_id").agg(by.alias("_r")).select("player_id", F.col(f"_r.{name}")[0].alias("name"), F.col(f"_r.{order}").alias("seasons"), F.col("_r.league").alias("leagues"))


def headline(df: DataFrame, entity: str = "player_id") -> DataFrame:
    """One row: rows, columns, and the distinct players, leagues and seasons of a panel."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"), F.count_distinct(entity).alias("n_players"), F.count_distinct("league").alias("n_leagues"), F.count_distinct("season").alias("n_seasons"))
