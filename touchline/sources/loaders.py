"""Loaders of the sources a panel is built from: stat files in folders, wide exports, ratings, a player master.

A loader takes paths, names columns canonically and gives values their types; a value that does not fit is null.
Nothing here goes to a network: fetching is a contract (``missing_parts``) that says what a fetcher has still to get.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.scalars import between_dates, first_token, mapped, transfer_window
from touchline.operators import joins
from touchline.operators.joins import flag_repeated, schema_aligned
from touchline.sources.tables import exists
from touchline.sources.text_formats import plain_name, rename_columns, without_suffix_copies

#: Schema of ratings of every edition, and the season of an edition. Fixed values.
RATING_SCHEMA = {
    "fifa_year": "int", "season": "string", "source": "string", "player_name": "string", "age": "double", "date_of_birth": "string", "nationality": "string",
    "club": "string", "league": "string", "primary_position": "string", "position_detail": "string", "overall": "double", "potential": "double", "sofifa_id": "string",
}
EDITION_SEASONS = {22: "2021-22", 23: "2022-23", 24: "2023-24", 25: "2024-25"}
#: Position groups by the codes of the rating game, and of the player master. Fixed values.
RATING_POSITIONS = {
    "GK": "GK", "CB": "DEF", "LB": "DEF", "RB": "DEF", "LWB": "DEF", "RWB": "DEF", "LCB": "DEF", "RCB": "DEF", "SW": "DEF", "CDM": "MID", "CM": "MID", "CAM": "MID",
    "LM": "MID", "RM": "MID", "LCM": "MID", "RCM": "MID", "LDM": "MID", "RDM": "MID", "LAM": "MID", "RAM": "MID", "ST": "FWD", "CF": "FWD", "LW": "FWD", "RW": "FWD",
    "LS": "FWD", "RS": "FWD", "LF": "FWD", "RF": "FWD",
}
MASTER_POSITIONS = {"Goalkeeper": "GK", "Defender": "DEF", "Midfield": "MID", "Attack": "FWD"}
#: Endings that mark a column as a copy from another stat table. Fixed values.
STAT_SUFFIXES = [
    "_stats_shooting", "_stats_passing", "_stats_passing_types", "_stats_gca", "_stats_defense", "_stats_possession", "_stats_playing_time", "_stats_misc",
    "_stats_keeper", "_stats_keeper_adv",
]


def folder_of(league: str) -> str:
    """The folder of a league: ``scalars.slug`` for names on the driver."""
    return league.lower().replace("ü", "u").replace(" ", "_")


def part_paths(spark: SparkSession, root: str, leagues: Sequence[str], parts: Sequence[str], suffix: str = ".parquet") -> tuple[dict[tuple[str, str], str], list[str]]:
    """({(league, part): path}, missing): the files <root>/<league slug>/<part><suffix> that are there, and those that aren't."""
    wanted = {(league, part): f"{root.rstrip('/')}/{folder_of(league)}/{part}{suffix}" for league in leagues for part in parts}
    there = {k: p for k, p in wanted.items() if exists(spark, p)}
    return there, [p for k, p in wanted.items() if k not in there]


def missing_parts(spark: SparkSession, root: str, leagues: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """(league, part, status) of a resumable fetch: ``skipped`` where the file is there already, ``to_do`` where not."""
    there, _ = part_paths(spark, root, leagues, parts)
    rows = [(league, part, "skipped" if (league, part) in there else "to_do") for league in leagues for part in parts]
    return spark.createDataFrame(rows, "league string, part string, status string")


def read_parts(spark: SparkSession, root: str, leagues: Sequence[str], seasons: Sequence[str], table: str | None = None, labels: Mapping[str, str] | None = None, schema: str | None = None) -> DataFrame:
    """All files <root>/<league slug>/<season>/<table>.parquet (or <season>.parquet) as one table, read in one scan.

    league and season come from the path, the season by ``labels``. Files may lack columns. Missing files are left
    out; where none is there, an empty table of ``schema``, or FileNotFoundError without one.
    """
    there, _ = part_paths(spark, root, leagues, [f"{s}/{table}" if table else s for s in seasons])
    if not there:
        if schema is None:
            raise FileNotFoundError(f"no stat file of {table or 'any season'} under {root}")
        return spark.createDataFrame([], schema)
    folder = {folder_of(league): league for league in leagues}
    df = spark.read.option("mergeSchema", "true").parquet(*there.values())
    path = F.col("_metadata.file_path")
    place = F.regexp_extract(path, r"/([^/]+)/([^/]+)/[^/]+\.parquet" if table else r"/([^/]+)/([^/]+)\.parquet", 1)
    season = F.regexp_extract(path, r"/([^/]+)/([^/]+)/[^/]+\.parquet" if table else r"/([^/]+)/([^/]+)\.parquet", 2)
    return df.withColumns({"league": mapped(place, folder), "season": F.coalesce(mapped(season, dict(labels)), season) if labels else season})


def footer_rows(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, n_rows) of parquet files, counted from their footers without reading a column."""
    if not paths:
        return spark.createDataFrame([], "path string, n_rows long")
    counted = spark.read.parquet(*paths).groupBy(F.col("_metadata.file_path").alias("path"))
    return counted.agg(F.count(F.lit(1)).alias("n_rows"))


def load_wide_stats(df: DataFrame, names: Mapping[str, str], leagues: Mapping[str, str], season: str, positions: Mapping[str, str], preserve: Mapping[str, str] | None = None, drop: Sequence[str] = ("Rk",)) -> DataFrame:
    """A wide export of season stats in canonical names with league, nation, position, season and is_split_season.

    Columns copied from several stat tables are one; the others are named by ``names``, else plainly. The raw
    nation is '<code> <ISO3>', the raw league maps by ``leagues`` or stays. ValueError where two columns come out
    alike, an error at run time for a position of no group. Rows of one player are flagged, not merged.
    """
    fate = without_suffix_copies([c for c in df.columns if c not in drop], STAT_SUFFIXES, preserve or {})
    kept = df.select(*[F.col(f"`{c}`").alias(t) for c, t in fate.items() if t is not None])
    out = rename_columns(kept, {c: names.get(c) or plain_name(c) for c in kept.columns})
    numbers = {c: F.col(c).cast("string").try_cast("double") for c in ("age", "minutes_played", "matches_90s") if c in out.columns}
    parts = F.split(F.trim("nationality_raw"), r"\s+", 2)
    out = out.withColumns(numbers | {"birth_year": F.col("birth_year").cast("string").try_cast("double").cast("long")}).withColumns(
        {
            "league": F.coalesce(mapped(F.col("league_raw"), dict(leagues)), F.col("league_raw")),
            "nationality_fbref": F.lower(F.get(parts, 0)),
            "nationality_iso3": F.upper(F.element_at(parts, -1)),
            "position_detail": F.col("position_raw"),
            "position_primary": first_token(F.col("position_raw"), positions, strict=True),
            "season": F.lit(season),
            "season_end_year": F.lit(int(season[:4]) + 1),
        }
    )
    return flag_repeated(out, ["player_name", "birth_year", "nationality_iso3"], "is_split_season")


def load_ratings(df: DataFrame, names: Mapping[str, str], source: str, editions: Sequence[int] | None = None, edition: int | None = None) -> DataFrame:
    """Ratings in the schema of all editions: of several ``editions`` by the column ``fifa_version``, or of one ``edition``."""
    out = df
    if edition is None:
        out = out.withColumn("fifa_year", F.col("fifa_version").cast("string").try_cast("double").cast("int")).filter(F.col("fifa_year").isin(list(editions or EDITION_SEASONS)))
    else:
        out = out.withColumn("fifa_year", F.lit(edition))
    out = out.withColumnsRenamed({k: v for k, v in names.items() if k in out.columns})
    group = first_token(F.upper("position_detail"), RATING_POSITIONS, unknown="Other")
    out = out.withColumns({"season": mapped(F.col("fifa_year"), EDITION_SEASONS), "source": F.lit(source), "primary_position": F.coalesce(group, F.lit("Other"))})
    return schema_aligned(out, RATING_SCHEMA)


def load_competitions(df: DataFrame, leagues: Mapping[str, str], tiers: Mapping[str, float], coefficients: Mapping[str, float], values: Mapping[str, float]) -> DataFrame:
    """The competitions among ``leagues`` (competition id -> league) with tier, coefficient and value multiplier, by name."""
    name = mapped(F.col("competition_id"), dict(leagues))
    kept = df.filter(F.col("competition_id").isin(list(leagues))).withColumn("league_name", name)
    number = lambda m: mapped(F.col("league_name"), {k: float(v) for k, v in m.items()})
    return kept.select("competition_id", "league_name", F.col("country_name").alias("country"), number(tiers).cast("int").alias("league_tier"), number(coefficients).alias("uefa_coefficient"), number(values).alias("league_value_multiplier"))


def load_players(df: DataFrame, leagues: Mapping[str, str]) -> DataFrame:
    """Players whose club plays in one of ``leagues`` (competition id -> league), with position group, league and caps."""
    caps = F.coalesce(F.col("international_caps").cast("string").try_cast("double"), F.lit(0.0))
    out = df.filter(F.col("current_club_domestic_competition_id").isin(list(leagues)))
    return out.withColumns({"position_primary": mapped(F.col("position"), MASTER_POSITIONS, "Other"), "current_league_name": mapped(F.col("current_club_domestic_competition_id"), dict(leagues)), "has_international_caps": caps > 0}).withColumnsRenamed({"player_id": "tm_player_id", "name": "player_name"})


def season_snapshots(valuations: DataFrame, seasons: DataFrame, leagues: Sequence[str], days: int) -> DataFrame:
    """(tm_player_id, season, season_end_date, market_value_eur, snapshot_date, days_from_season_end, domestic_competition_id):
    for every player and season the snapshot nearest to the season's end, ``days`` before or after at most.

    seasons: season, season_end_date, a handful of rows. A snapshot meets only the ends within its reach, so the
    result of that join is at most a few rows for each snapshot; the nearest is a combining aggregate. At equal
    distance the earlier snapshot wins, then the lower value.
    """
    v = valuations.select(F.col("player_id").alias("tm_player_id"), F.to_date(F.try_to_timestamp(F.col("date").cast("string"))).alias("snapshot_date"), F.col("market_value_in_eur").cast("double").alias("market_value_eur"), F.col("player_club_domestic_competition_id").alias("domestic_competition_id"))
    v = v.filter(F.col("domestic_competition_id").isin(list(leagues)) & F.col("snapshot_date").isNotNull() & F.col("tm_player_id").isNotNull())
    ends = seasons.select("season", F.col("season_end_date").cast("date").alias("season_end_date"))
    month = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / F.lit(days + 1)).cast("long")
    near = ends.withColumn("_b", F.explode(F.sequence(month(F.col("season_end_date")) - 1, month(F.col("season_end_date")) + 1)))
    met = v.withColumn("_b", month(F.col("snapshot_date"))).join(near, "_b").withColumn("days_from_season_end", F.datediff("snapshot_date", "season_end_date")).filter(F.abs("days_from_season_end") <= days)
    rank = F.struct(F.abs("days_from_season_end").alias("d"), "snapshot_date", "market_value_eur", "domestic_competition_id")
    best = met.groupBy("tm_player_id", "season", "season_end_date").agg(F.min_by(F.struct("market_value_eur", "snapshot_date", "days_from_season_end", "domestic_competition_id"), rank).alias("b"))
    return best.select("tm_player_id", "season", "season_end_date", "b.*")


def load_transfers(df: DataFrame, clubs: DataFrame, leagues: Mapping[str, str], to_leagues: Sequence[str], first: str, last: str) -> DataFrame:
    """Paid transfers into ``to_leagues`` (competition ids) from ``first`` to ``last``, with both clubs' leagues and the window."""
    t = df.withColumns({"transfer_date": F.to_date(F.try_to_timestamp(F.col("transfer_date").cast("string"))), "transfer_fee_eur": F.col("transfer_fee").cast("string").try_cast("double")})
    t = joins.join_roles(t.filter(between_dates(F.col("transfer_date"), first, last)), clubs, "club_id", {"to_": "to_club_id", "from_": "from_club_id"}, ["domestic_competition_id"])
    t = t.filter(F.col("to_domestic_competition_id").isin(list(to_leagues)) & (F.col("transfer_fee_eur") > 0))
    name: dict[str, Column] = {f"{side}_league_name": mapped(F.col(f"{side}_domestic_competition_id"), dict(leagues)) for side in ("from", "to")}
    t = t.withColumns(name | {"window": transfer_window(F.col("transfer_date"))}).withColumnsRenamed({"player_id": "tm_player_id", "market_value_in_eur": "market_value_at_transfer"})
    keep = ["tm_player_id", "transfer_date", "transfer_season", "from_club_name", "to_club_name", "from_league_name", "to_league_name", "transfer_fee_eur", "market_value_at_transfer", "window"]
    return t.select(*[c for c in keep if c in t.columns])


def load_national_teams(df: DataFrame) -> DataFrame:
    """The columns of national teams that are kept, those that are there."""
    keep = ["national_team_id", "name", "country_name", "confederation", "fifa_ranking", "squad_size", "average_age", "total_market_value", "coach_name"]
    return df.select(*[c for c in keep if c in df.columns])

