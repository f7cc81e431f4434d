"""Queries of problems 4 (surviving records) and 5 (nearest in time)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import asof
from touchline.llm import survivorship as S
from touchline.sources.tables import table

#: A season has no more minutes than this: 38 rounds of 90 minutes and some stoppage time.
MOST_MINUTES = 3800

#: Days between a season's end and a snapshot that still counts for it.
TOLERANCE_DAYS = 45


def _panel_survivorship() -> tuple[S.Survivorship, dict]:
    minutes = F.coalesce(F.col("minutes_played").between(0, MOST_MINUTES), F.lit(False))
    s = S.Survivorship(["player_id", "season"], "row_id", "record_source", "load_id", "loaded_at", "is_split_season", "minutes_played", minutes)
    return s, {"club": S.says_something(F.col("club")), "minutes_played": minutes}


def p4_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each player and season, with the best club and minutes and a true is_split_season."""
    s, fields = _panel_survivorship()
    return S.survive(table(spark, sf_dir, "unified_panel"), table(spark, sf_dir, "panel_sources"), s, fields)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row each group's club and minutes survive from, for groups of two or more rows."""
    groups = p4_survivors(spark, sf_dir).filter("group_rows >= 2")
    return S.surviving_cells(groups, ["player_id", "season"], ["club", "minutes_played"])


def p5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest valuation of each player season with its distance in microseconds."""
    return asof.nearest_in_time(
        table(spark, sf_dir, "tm_player_seasons"),
        table(spark, sf_dir, "tm_valuations"),
        "tm_player_id",
        "player_season_id",
        "season_end_date",
        "valuation_id",
        "snapshot_date",
        TOLERANCE_DAYS,
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each player season with the nearest snapshot within 45 days."""
    return p5_nearest(spark, sf_dir).select("player_season_id", "valuation_id")


_UNKNOWN = ", ".join("'" + t.replace("'", "''") + "'" for t in S.UNKNOWN_TEXTS)

P4_SQL = f"""
with r as (
  select p.*, coalesce(s.trust_rank, 2147483646) as trust,
    club is not null and lower(trim(club)) not in ({_UNKNOWN}) as club_ok,
    coalesce(minutes_played between 0 and {MOST_MINUTES}, false) as min_ok,
    count(*) over (partition by player_id, season) as g,
    sum(case when coalesce(is_split_season, false) then 0 else 1 end)
      over (partition by player_id, season, coalesce(p.record_source, ''), load_id) as parts
  from unified_panel p left join panel_sources s on p.record_source = s.record_source
  where player_id is not null and season is not null
), o as (
  select player_id, season, 'club' as field_name, row_id, club_ok as ok, false as built, g, trust, loaded_at, is_split_season, min_ok, minutes_played from r
  union all
  select player_id, season, 'minutes_played', row_id, min_ok, not coalesce(is_split_season, false) and parts > 1, g, trust, loaded_at, is_split_season, min_ok, minutes_played from r
), k as (
  select *, row_number() over (partition by player_id, season, field_name order by trust, loaded_at desc nulls last,
    coalesce(is_split_season, false) desc, case when min_ok then minutes_played end desc nulls last, row_id) as n
  from o where ok and g >= 2
)
select player_id, season, field_name, row_id from k where n = 1 and not built
"""

P5_SQL = f"""
with v as (
  select tm_player_id, snapshot_date, min(valuation_id) as valuation_id from tm_valuations
  where tm_player_id is not null and snapshot_date is not null group by 1, 2
), c as (
  select s.player_season_id, v.valuation_id,
    row_number() over (partition by s.player_season_id order by abs(epoch_us(v.snapshot_date) - epoch_us(s.season_end_date)), v.snapshot_date, v.valuation_id) as n
  from tm_player_seasons s join v on s.tm_player_id = v.tm_player_id
   and abs(epoch_us(v.snapshot_date) - epoch_us(s.season_end_date)) <= {TOLERANCE_DAYS} * 86400000000
)
select player_season_id, valuation_id from c where n = 1
"""

QUERIES = {"p4_found": p4_found, "p4_survivors": p4_survivors, "p5_found": p5_found, "p5_nearest": p5_nearest}
SQL = {"p4_found": P4_SQL, "p5_found": P5_SQL}
