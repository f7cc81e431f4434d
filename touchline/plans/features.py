"""Feature modules of a player panel in their fixed order; each adds columns lazily and keeps every row.

Column names are the panel's: minutes_played, matches_played, the counting stats, <stat>_per_90, and so on. A
module adds only what its inputs allow.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.scalars import clip_lower, completeness, extrapolated, flag, guarded_rate, mapped, next_period
from touchline.operators.windows import group_zscores, lag_delta, streak

#: Counting stats with a rate for 90 minutes, and stats with a history. Fixed values.
PER_90_STATS = [
    "goals", "assists", "shots", "shots_on_target", "xg", "xag", "npxg", "understat_xa", "understat_xg",
    "saves", "tackles_won", "interceptions", "goals_against", "shots_on_target_against",
]
LAG_STATS = [
    "goals_per_90", "assists_per_90", "shots_per_90", "xg_per_90", "minutes_played", "matches_played",
    "tackles_won_per_90", "interceptions_per_90", "log_market_value", "fifa_rating", "fifa_potential",
]
#: Stats with z-scores, where present. Fixed values.
Z_SCORE_STATS = [
    "goals_per_90", "assists_per_90", "shots_per_90", "xg_per_90", "xag_per_90", "npxg_per_90",
    "tackles_won_per_90", "interceptions_per_90", "saves_per_90", "clean_sheets_per_match",
    "minutes_played", "matches_played", "goal_threat", "defensive_actions", "creative_threat",
]
#: Age of the highest value by position. Fixed values.
PEAK_AGE = {"GK": 30, "DEF": 26, "MID": 25, "FWD": 26}
POSITIONS = ["GK", "DEF", "MID", "FWD"]
CONTINENTS = ["Europe", "Africa", "SouthAmerica", "NorthAmerica", "Asia", "Oceania", "Other"]


def _has(df: DataFrame, *names: str) -> bool:
    return set(names) <= set(df.columns)


def per_90(df: DataFrame, stats: Sequence[str] = PER_90_STATS, minutes: str = "minutes_played") -> DataFrame:
    """<stat>_per_90 where it is not there yet; null where minutes are not positive. Clean sheets go by match."""
    new = {f"{s}_per_90": guarded_rate(F.col(s) * 90.0, F.col(minutes)) for s in stats if s in df.columns and f"{s}_per_90" not in df.columns}
    if _has(df, "clean_sheets", "matches_played") and "clean_sheets_per_match" not in df.columns:
        new["clean_sheets_per_match"] = guarded_rate(F.col("clean_sheets").cast("double"), F.col("matches_played"))
    return df.withColumns(new) if new else df


def composites(df: DataFrame, least_shots: float = 0.5) -> DataFrame:
    """Threat, creation, work and output from per-90 columns, and the share of the five that a row has.

    Nulls carry over, but expected assists are an optional part of the output. A column the frame lacks counts
    as null.
    """
    rate = lambda s: F.col(f"{s}_per_90").cast("double") if f"{s}_per_90" in df.columns else F.lit(None).cast("double")
    expected_assists = F.coalesce(rate("xag"), rate("understat_xa"))
    new: dict[str, Column] = {
        "goal_threat": rate("xg") + 0.5 * rate("shots"),
        "creative_threat": expected_assists,
        "defensive_actions": rate("tackles_won") + rate("interceptions"),
        "shooting_efficiency": guarded_rate(rate("goals"), rate("shots"), least_shots, inclusive=True),
        "attacking_output": rate("goals") + rate("assists") + 0.5 * F.coalesce(expected_assists, F.lit(0.0)),
    }
    return df.withColumns(new | {"composite_completeness": completeness(list(new.values()))})


def z_scores(df: DataFrame, stats: Sequence[str] = Z_SCORE_STATS, period: str = "season", position: str = "primary_position", league: str = "league", least: int = 15) -> DataFrame:
    """<stat>_z_pos within (period, position) and <stat>_z_league within (period, league), of the stats present."""
    have = [s for s in stats if s in df.columns]
    for keys, suffix in (([period, position], "z_pos"), ([period, league], "z_league")):
        df = group_zscores(df, {f"{s}_{suffix}": s for s in have}, keys, least)
    return df


def thin_groups(df: DataFrame, stats: Sequence[str] = Z_SCORE_STATS, period: str = "season", position: str = "primary_position", league: str = "league", least: int = 15) -> DataFrame:
    """(stat, grouping, n_groups): how many groups of each grouping know the stat, but in too few rows to score it."""
    parts = []
    have = [s for s in stats if s in df.columns]
    for keys, name in (([period, position], "z_pos"), ([period, league], "z_league")):
        counts = df.groupBy(*keys).agg(*[F.count(s).alias(s) for s in have])
        thin = counts.agg(*[F.count(F.when((F.col(s) > 0) & (F.col(s) < least), 1)).alias(s) for s in have])
        parts.append(thin.unpivot([], have, "stat", "n_groups").select("stat", F.lit(name).alias("grouping"), "n_groups"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def age_curve(df: DataFrame, age: str = "age_at_season_end", position: str = "primary_position", peaks: Mapping[str, int] = PEAK_AGE) -> DataFrame:
    """Powers of age, distance from the position's peak, and bands: young < 24, peak 24 to 29, declining > 29."""
    a = F.col(age)
    return df.withColumns(
        {
            "age_squared": a * a,
            "age_cubed": a * a * a,
            "distance_from_peak": F.abs(a - mapped(F.col(position), peaks)),
            "is_young": flag(a < 24),
            "is_peak": flag(a.between(24, 29)),
            "is_declining": flag(a > 29),
        }
    )


def contract(df: DataFrame, months: str = "contract_remaining_months") -> DataFrame:
    """Years to expiry and flags: expiring within 6 months, long beyond 36; unknown is neither."""
    m = F.col(months)
    return df.withColumns({"contract_years_until_expiry": m / 12, "is_expiring": flag(m <= 6), "is_long_contract": flag(m > 36)})


def history(df: DataFrame, entity: str = "player_id", period: str = "season", stats: Sequence[str] = LAG_STATS) -> DataFrame:
    """Lags, deltas, has_lag1 and the gap-aware run of seasons."""
    df = lag_delta(df, entity, period, [s for s in stats if s in df.columns])
    return streak(df.withColumn("_year", F.substring(period, 1, 4).cast("int")), entity, "_year", "consecutive_seasons").drop("_year")


def one_hot(df: DataFrame, column: str, values: Sequence[str], prefix: str = "is_") -> DataFrame:
    """A flag for each value; null is none of them."""
    return df.withColumns({f"{prefix}{v}": flag(F.col(column) == v) for v in values})


#: Value of a year against the first, and growth a year beyond the table. Fixed values.
YEAR_INFLATION = {2021: 1.000, 2022: 1.100, 2023: 1.254, 2024: 1.505}


def multipliers(df: DataFrame, inflation: Mapping[int, float] = YEAR_INFLATION, leagues: Mapping[str, float] | None = None) -> DataFrame:
    """Inflation of the season by table (null outside it), and the league's value multiplier where the frame has none yet."""
    year = F.substring("season", 1, 4).try_cast("int")
    new = {"year_inflation_multiplier": mapped(year, {k: float(v) for k, v in inflation.items()})}
    if leagues is not None and "league_value_multiplier" not in df.columns:
        new["league_value_multiplier"] = mapped(F.col("league"), {k: float(v) for k, v in leagues.items()})
    return df.withColumns(new)


def rating_gap(df: DataFrame) -> DataFrame:
    """Potential over rating (null where the frame knows no potential), and the rating's change; the lag must be there."""
    if "fifa_rating_lag1" not in df.columns:
        raise ValueError("rating_gap needs fifa_rating_lag1: run history first")
    potential = F.col("fifa_potential") if "fifa_potential" in df.columns else F.lit(None).cast("double")
    return df.withColumns({"fifa_potential_gap": potential - F.col("fifa_rating"), "delta_fifa_rating": F.col("fifa_rating") - F.col("fifa_rating_lag1")})


def build(df: DataFrame, z_stats: Sequence[str] = Z_SCORE_STATS, leagues: Mapping[str, float] | None = None) -> DataFrame:
    """All modules in their order: rates, composites, z-scores, age, contract, history, multipliers, flags, ratings."""
    df = z_scores(composites(per_90(df)), z_stats)
    df = contract(age_curve(df)) if "contract_remaining_months" in df.columns else age_curve(df)
    df = one_hot(multipliers(history(df), leagues=leagues), "primary_position", POSITIONS)
    if "continent_group" in df.columns:
        df = one_hot(df, "continent_group", CONTINENTS, "is_continent_")
    return rating_gap(df) if "fifa_rating_lag1" in df.columns else df


def forward(df: DataFrame, projected: Mapping[str, str], position: str = "primary_position", peaks: Mapping[str, int] = PEAK_AGE, lag_stats: Sequence[str] = LAG_STATS) -> DataFrame:
    """The panel one season on, as one projection over the current row.

    projected: stat -> column with its projection (null keeps the current value). Age grows by one with all that
    hangs on it, contracts run 12 months on, present values become lags, deltas are taken anew (0 for stats without
    projection), composites are recomputed, z-scores stay as they are.
    """
    have = set(df.columns)
    age = F.col("age_at_season_end") + 1
    new: dict[str, Column] = {"age_at_season_end": age}
    new |= {k: v for k, v in {"age_squared": age * age, "age_cubed": age * age * age, "distance_from_peak": F.abs(age - mapped(F.col(position), peaks)), "is_young": flag(age < 24), "is_peak": flag(age.between(24, 29)), "is_declining": flag(age > 29)}.items() if k in have}
    if "contract_remaining_months" in have:
        m = clip_lower(F.col("contract_remaining_months") - 12)
        new |= {k: v for k, v in {"contract_remaining_months": m, "contract_years_until_expiry": m / 12, "is_expiring": flag(m <= 6), "is_long_contract": flag(m > 36)}.items() if k in have}
    ahead = {s: F.coalesce(F.col(p), F.col(s)) for s, p in projected.items() if s in have}
    new |= ahead
    for s in lag_stats:
        if s in have:
            if f"{s}_lag1" in have:
                new[f"{s}_lag1"] = F.col(s)
            if f"delta_{s}" in have:
                new[f"delta_{s}"] = ahead.get(s, F.col(s)) - F.col(s)
    if "has_lag1" in have:
        new["has_lag1"] = F.lit(True)
    if "consecutive_seasons" in have:
        new["consecutive_seasons"] = F.coalesce("consecutive_seasons", F.lit(0)) + 1
    new["season"] = next_period(F.col("season"))
    if "year_inflation_multiplier" in have:
        new["year_inflation_multiplier"] = extrapolated(F.substring("season", 1, 4).try_cast("int") + 1, YEAR_INFLATION)
    kept = [c for c in df.columns if c not in projected.values()]
    moved = df.withColumns(new).select(*kept)
    return composites(moved) if "composite_completeness" in have else moved


def fallback_notes(projected: Mapping[str, str]) -> Column:
    """array<string> of notes on the stats whose projection is null, in their order."""
    return F.array_compact(F.array(*[F.when(F.col(p).isNull(), F.lit(f"{s}: no projection, current value kept")) for s, p in projected.items()])) if projected else F.array().cast("array<string>")
