"""Queries of problem 2: the panel's gaps filled from like records and marked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators import impute as I
from touchline.sources.tables import table

FIELDS = ["fifa_rating", "xg", "contract_remaining_months"]
DAYS_PER_MONTH = 30.44
GROUPS = [["season"], ["league", "primary_position"], ["player_id"]]


def _number(name: str):
    return F.col(name).cast("double")


def rating_field() -> I.NumericField:
    """Ratings run from 1 to 99, and no player of a league squad has fewer than 20."""
    return I.NumericField(
        "fifa_rating",
        low=20,
        high=99,
        covariates={"log_minutes": F.log1p(F.when(_number("minutes_played").between(0, 3800), _number("minutes_played"))), "log_value": F.log1p(F.when(_number("market_value_eur") > 0, _number("market_value_eur"))), "no_value": F.when(_number("market_value_eur") > 0, 0.0).otherwise(1.0), "age": _number("age_at_season_end"), "age2": _number("age_at_season_end") * _number("age_at_season_end")},
    )


def xg_field() -> I.NumericField:
    """Each shot is worth more than nothing and less than a goal, so zero with shots, or more than the shots, cannot be."""
    shots, goals, xg = _number("shots"), _number("goals"), _number("xg")
    return I.NumericField(
        "xg",
        low=0,
        high=80,
        covariates={"shots": shots, "goals": goals, "minutes": F.when(_number("minutes_played").between(0, 3800), _number("minutes_played"))},
        refuted=((xg == 0) & ((shots >= 3) | (goals >= 1))) | (xg > F.greatest(shots, goals)),
        eligible=F.col("_league_has_xg"),
    )


def contract_field() -> I.NumericField:
    """Months from the season's end to the contract's end, 0 once it is over; a stored value must agree with the dates."""
    months = F.greatest(F.datediff("contract_end_date", "season_end_date") / DAYS_PER_MONTH, F.lit(0.0))
    derived = F.when(F.col("contract_end_date").isNotNull() & F.col("season_end_date").isNotNull(), months)
    return I.NumericField(
        "contract_remaining_months",
        low=0,
        high=120,
        covariates={"age": _number("age_at_season_end"), "age2": _number("age_at_season_end") * _number("age_at_season_end")},
        refuted=F.abs(_number("contract_remaining_months") - derived) > 0.5,
        derived=derived,
    )


def _with_xg_leagues(panel: DataFrame, coverage: DataFrame) -> DataFrame:
    """Marks the leagues that have files of the xG source; their table has a row for each league."""
    leagues = coverage.filter((F.col("source") == "understat") & (F.col("row_count") > 0)).select(F.col("league").alias("_xg_league")).distinct()
    return panel.join(leagues, F.col("league") == F.col("_xg_league"), "left").withColumn("_league_has_xg", F.col("_xg_league").isNotNull()).drop("_xg_league")


def filled_panel(spark: SparkSession, sf_dir: str, fields: list[str] = FIELDS) -> DataFrame:
    """unified_panel with the fields filled and masked."""
    df = _with_xg_leagues(table(spark, sf_dir, "unified_panel"), table(spark, sf_dir, "fbref_coverage_summary"))
    makers = {"fifa_rating": rating_field, "xg": xg_field, "contract_remaining_months": contract_field}
    df = I.fill_numeric(df, [makers[name]() for name in fields], GROUPS)
    return df.drop("_league_has_xg")


def p2_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filled panel: numbers by mixed effects, data_richness by shrunk multinomial counts, with masks."""
    df = I.fill_category(filled_panel(spark, sf_dir), I.CategoryField("data_richness", pattern="full|synthetic_basic", groups=[["resolve_method"], ["resolve_method", "record_source"]], times=["season"]))
    names = [*FIELDS, "data_richness"]
    return df.select("row_id", "player_id", "season", *[F.round(c, 6).alias(c) for c in FIELDS], "data_richness", *[I.mask_column(c) for c in names])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells without a value that can be true of their record, as the model filled and marked them."""
    return I.filled_cells(filled_panel(spark, sf_dir), "row_id", FIELDS)


P2_SQL = """
with xl as (select distinct league from fbref_coverage_summary where source = 'understat' and row_count > 0 and league is not null),
q as (select p.*, greatest(date_diff('day', cast(season_end_date as date), cast(contract_end_date as date)) / 30.44, 0) as months, xl.league is not null as has_xg from unified_panel p left join xl on p.league = xl.league)
select row_id, 'fifa_rating' as field_name from q where not coalesce(not isnan(fifa_rating) and fifa_rating between 20 and 99, false)
union all select row_id, 'xg' from q where has_xg and not coalesce(not isnan(xg) and xg between 0 and 80 and not coalesce(xg = 0 and (shots >= 3 or goals >= 1), false) and not coalesce(xg > greatest(shots, goals), false), false)
union all select row_id, 'contract_remaining_months' from q where not coalesce(not isnan(contract_remaining_months) and contract_remaining_months between 0 and 120
  and not coalesce(contract_end_date is not null and season_end_date is not null and abs(contract_remaining_months - months) > 0.5, false), false)
"""

QUERIES = {"p2_found": p2_found, "p2_fill": p2_fill}
SQL: dict[str, str] = {"p2_found": P2_SQL}
