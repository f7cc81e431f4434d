"""The build of a panel: stat tables to one backbone, identities, parts of a season, secondary sources, final schema.

Each stage is a function of DataFrames and lazy unless its docstring names an action. Secondary sources are
matched to the panel by keys with one distinct id each, so no stage can add rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.scalars import age_at, club_key, first_token, flag, fold_name, initials, key_of, mapped, months_until, plain_number, synthetic_id
from touchline.operators import joins, panel, resolve
from touchline.operators.resolve import similarity
from touchline.sources.text_formats import plain_name

#: Identity columns of stat tables, and those that make a stint's key. Fixed values.
IDENTITY = ["league", "season", "team", "player", "nation", "pos", "age", "born"]
STINT_KEY = ["league", "season", "team", "player", "nation", "born"]
#: Position groups by the first token of a detailed position. Fixed values.
POSITION_GROUPS = {"GK": "GK", "DF": "DEF", "MF": "MID", "FW": "FWD"}
#: Counts that per-90 stats of several stints are recomputed from. Fixed values.
RATE_COUNTS = {
    "goals_per_90": "goals", "assists_per_90": "assists", "goals_plus_assists_per_90": "goals_plus_assists", "non_penalty_goals_per_90": "non_penalty_goals",
    "shots_per_90": "shots", "shots_on_target_per_90": "shots_on_target", "sca_per_90": "shot_creating_actions", "gca_per_90": "goal_creating_actions",
    "goals_against_per_90": "goals_against", "psxg_per_90": "psxg", "gk_sweeper_per_90": "gk_sweeper_actions", "plus_minus_per_90": "plus_minus",
}
#: A season has no more minutes; minutes a row of a top league, or of another, needs to count. Fixed values.
MOST_MINUTES, TOP_MINIMUM, MINIMUM = 3800, 450, 300


def merge_stat_tables(tables: Mapping[str, DataFrame], names: Mapping[str, Mapping[str, str]] | None = None, drop: Mapping[str, Sequence[str]] | None = None, order: Column | None = None) -> DataFrame:
    """The first table, with the identity columns, left-joined by the stint key to the others in their order.

    names: table -> raw column -> canonical name; other stats become <table>__<plain name>. drop: columns that
    repeat another table's. ValueError where two tables would give one column. Null key parts match each other. A
    key that stands twice in a table counts once: the first by ``order`` (default: by all columns), so no join
    adds rows; keys the first table lacks are left out (``joins.keys_only_in`` counts them).
    """
    out, taken = None, set()
    for i, (table, df) in enumerate(tables.items()):
        known, gone = (names or {}).get(table, {}), set((drop or {}).get(table, ()))
        stats = {c: known.get(c) or f"{table}__{plain_name(c)}" for c in df.columns if c not in IDENTITY and c not in gone}
        twice = sorted(taken & set(stats.values())) or sorted({t for t in stats.values() if list(stats.values()).count(t) > 1})
        if twice:
            raise ValueError(f"columns given twice by {table}: {twice}")
        taken |= set(stats.values())
        keep = [c for c in IDENTITY if c in df.columns] if i == 0 else []
        rank = order if order is not None else F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
        one = df.withColumn("_key", key_of(*[F.col(c) for c in STINT_KEY])).groupBy("_key").agg(F.min_by(F.struct(*keep, *[F.col(f"`{c}`").alias(t) for c, t in stats.items()]), rank).alias("_r")).select("_key", "_r.*")
        out = one if out is None else out.join(one, "_key", "left")
    return out.drop("_key").withColumns({"primary_position": first_token(F.col("pos"), POSITION_GROUPS)}).withColumnRenamed("pos", "detailed_position")


def resolve_backbone(stints: DataFrame, master: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Every stint with player_id, resolve_method, resolve_score and data_richness; a synthetic id where the master has no match.

    stints: stint_id (unique), player, born, nation, team, source and the nation as ``nationality`` in the master's
    spelling.
    """
    asked = stints.select(F.col("stint_id").alias("row_id"), F.col("player").alias("name"), F.col("born").alias("year"), F.col("nationality").alias("nation"), "team", "source")
    found = resolve.resolve(asked, master, overrides).select(F.col("row_id").alias("stint_id"), F.col("id").cast("string").alias("player_id"), F.col("method").alias("resolve_method"), F.col("score").alias("resolve_score"))
    made = synthetic_id(F.coalesce(fold_name(F.col("player")), F.lit("")), F.col("born").cast("int"), F.col("nation"))
    out = stints.join(found, "stint_id", "left")
    matched = F.col("player_id").isNotNull()
    return out.withColumns(
        {
            "resolve_method": F.when(matched, F.col("resolve_method")).otherwise("synthetic"),
            "data_richness": F.when(matched, "full").otherwise("synthetic_basic"),
            "player_id": F.coalesce("player_id", made),
        }
    )


def split_identities(stints: DataFrame) -> DataFrame:
    """Stints whose id is shared by several names, or has more minutes in a season than there are, under ids of their own.

    The name, then the stint, with most minutes keeps the id; others are marked ``synthetic_split``.
    """
    named = stints.withColumns({"_n": fold_name(F.col("player")), "_was": F.col("player_id"), "minutes": F.coalesce("minutes_played", F.lit(0))})
    born = F.col("born").cast("int")
    out = panel.split_shared_ids(named, "player_id", "_n", "minutes", synthetic_id(F.col("_n"), born, F.col("nation")), real=~F.col("player_id").startswith("synthetic_"))
    salted = F.concat_ws("|", F.coalesce("_n", F.lit("")), F.coalesce(club_key(F.col("team")), F.lit("")))
    out = panel.split_overflow(out, "player_id", "season", "minutes", MOST_MINUTES, [F.col("team"), F.col("stint_id")], synthetic_id(salted, born, F.col("nation")))
    moved = ~F.col("player_id").eqNullSafe(F.col("_was"))
    return out.withColumns({"resolve_method": F.when(moved, "synthetic_split").otherwise(F.col("resolve_method")), "data_richness": F.when(moved, "synthetic_basic").otherwise(F.col("data_richness"))}).drop("_n", "_was", "minutes")


def collapse_seasons(stints: DataFrame, top_leagues: Sequence[str], context: Sequence[str]) -> DataFrame:
    """One row for each player and season, its stats put together by their kind, with the minimum of minutes of its league.

    context: columns taken from the stint with most minutes (equal minutes: the team first in order).
    """
    fixed = {"player_id", "season", "minutes_played", *context, *IDENTITY, "stint_id"}
    stats = [f.name for f in stints.schema if f.name not in fixed and plain_number(f.dataType)]
    kinds = {c: panel.stat_kind(c) for c in stats}
    rates = {c: (RATE_COUNTS.get(c, ""), "matches_90s") for c, k in kinds.items() if k == "rate"}
    out = panel.collapse_parts(stints, ["player_id", "season"], "minutes_played", [F.col("team")], [c for c, k in kinds.items() if k == "sum"], [c for c, k in kinds.items() if k == "mean"], rates, list(context))
    out = out.withColumnRenamed("is_split", "is_split_season").withColumnRenamed("team", "club").withColumnRenamed("player", "player_name_fbref")
    return panel.with_minimum(out, "minutes_played", "league", top_leagues, TOP_MINIMUM, MINIMUM)


def _one_id(rows: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """(keys, name): the id of each key that has exactly one distinct id; null key parts are alike."""
    ids = rows.groupBy(*keys).agg(F.count_distinct("player_id").alias("_d"), F.min("player_id").alias(name))
    return ids.filter("_d = 1").drop("_d")


def _names(rows: DataFrame, name: str) -> DataFrame:
    folded = rows.withColumn("_n", F.coalesce(fold_name(F.col(name)), F.lit("")))
    return folded.withColumn("_i", F.coalesce(initials(F.col("_n")), F.lit("")))


def match_to_panel(rows: DataFrame, panel_rows: DataFrame, name: str, by: str) -> DataFrame:
    """``rows`` with player_id: the panel's id of the same folded name, else of the same initials, and ``by`` (the column of
    rows and panel that must agree too, a year of birth or a season; null matches null), where it is one id only."""
    mine, theirs = _names(rows, name), _names(panel_rows, "player_name_fbref").select("player_id", by, "_n", "_i")
    out = joins.left_join_nullsafe(mine, _one_id(theirs, ["_n", by], "_exact"), ["_n", by])
    out = joins.left_join_nullsafe(out, _one_id(theirs, ["_i", by], "_short"), ["_i", by])
    return out.withColumn("player_id", F.coalesce("_exact", "_short")).drop("_n", "_i", "_exact", "_short")


def match_in_club(rows: DataFrame, panel_rows: DataFrame, row_id: str, name: str, club: str, least: float = 85.0) -> DataFrame:
    """``rows`` with player_id: within (season, club key) the one id of the folded name, else the name most alike by
    ``least`` or more (ties: the name, then the id first in order), else the season's one id of that name or its initials.

    A club's squad of a season is small, so its names are compared in pairs.
    """
    mine = _names(rows, name).withColumn("_c", F.coalesce(club_key(F.col(club)), F.lit("")))
    theirs = _names(panel_rows, "player_name_fbref").withColumn("_c", F.coalesce(club_key(F.col("club")), F.lit(""))).select("player_id", "season", "_c", "_n", "_i")
    out = joins.left_join_nullsafe(mine, _one_id(theirs, ["season", "_c", "_n"], "_exact"), ["season", "_c", "_n"])
    squads = theirs.select(F.col("season").alias("_s"), F.col("_c").alias("_sc"), F.col("_n").alias("_pn"), F.col("player_id").alias("_pid")).distinct()
    asked = out.filter(F.col("_exact").isNull()).select(row_id, "season", "_c", "_n")
    alike = asked.join(squads, (F.col("season") == F.col("_s")) & (F.col("_c") == F.col("_sc"))).withColumn("_x", similarity(F.col("_n"), F.col("_pn"))).filter(F.col("_x") >= least)
    best = alike.groupBy(F.col(row_id).alias("_rid")).agg(F.min_by("_pid", F.struct((-F.col("_x")).alias("x"), F.col("_pn").alias("n"), F.col("_pid").alias("p"))).alias("_alike"))
    out = out.join(best, F.col(row_id) == F.col("_rid"), "left").drop("_rid")
    out = joins.left_join_nullsafe(out, _one_id(theirs, ["season", "_n"], "_named"), ["season", "_n"])
    out = joins.left_join_nullsafe(out, _one_id(theirs, ["season", "_i"], "_short"), ["season", "_i"])
    return out.withColumn("player_id", F.coalesce("_exact", "_alike", "_named", "_short")).drop("_n", "_i", "_c", "_exact", "_alike", "_named", "_short")


def _attach(panel_rows: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join to a side that has each key once, null keys matching nothing."""
    side = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    return panel_rows.join(side, reduce(lambda a, b: a & b, [panel_rows[k] == F.col(f"_{k}") for k in keys]), "left").drop(*[f"_{k}" for k in keys])


def attach_xg(panel_rows: DataFrame, first: DataFrame, second: DataFrame, top_leagues: Sequence[str], season: str) -> DataFrame:
    """xg, npxg, xag, understat_xg, understat_xa and xg_source, by priority of source, for the top leagues alone.

    first: player_id, xg, npxg, xag of the one ``season`` it covers. second: player_id, season, xg, np_xg, xa of any.
    Both may have several rows for a player, which add up; rows without an id are orphans and left out.
    """
    a = first.filter("player_id is not null").groupBy("player_id").agg(*[F.sum(c).cast("double").alias(f"_a_{c}") for c in ("xg", "npxg", "xag")]).withColumn("season", F.lit(season))
    b = second.filter("player_id is not null").groupBy("player_id", "season").agg(F.sum("xg").cast("double").alias("understat_xg"), F.sum("np_xg").cast("double").alias("_b_npxg"), F.sum("xa").cast("double").alias("understat_xa"))
    out = _attach(_attach(panel_rows.drop("xg", "npxg", "xag", "xg_source"), a, ["player_id", "season"]), b, ["player_id", "season"])
    top = flag(F.col("league").isin(list(top_leagues)))
    mine = top & flag(F.col("season") == season)
    pick = lambda x, y: F.coalesce(F.when(mine, F.col(x)), F.when(top, F.col(y)))
    source = F.when(mine & F.col("_a_xg").isNotNull(), "kaggle").when(top & F.col("understat_xg").isNotNull(), "understat").otherwise("none")
    return out.withColumns({"xg": pick("_a_xg", "understat_xg"), "npxg": pick("_a_npxg", "_b_npxg"), "xag": F.when(mine, F.col("_a_xag")), "xg_source": source}).drop("_a_xg", "_a_npxg", "_a_xag", "_b_npxg")


def attach_market_value(panel_rows: DataFrame, values: DataFrame) -> DataFrame:
    """market_value_eur, market_value_date and log_market_value of (player_id, season). values: tm_player_id, season,
    market_value_eur, snapshot_date, a player season once."""
    side = values.select(F.col("tm_player_id").cast("string").alias("player_id"), "season", "market_value_eur", F.col("snapshot_date").alias("market_value_date"))
    return _attach(panel_rows.drop("market_value_eur"), side, ["player_id", "season"]).withColumn("log_market_value", F.log1p("market_value_eur"))


def attach_contract(panel_rows: DataFrame, master: DataFrame, season_ends: Mapping[str, str]) -> DataFrame:
    """Contract end, remaining months at the season's end, date of birth and caps, from the one current master row of a player.

    master: tm_player_id, contract_expiration_date, date_of_birth, has_international_caps (texts that are no dates
    are null); of several rows of an id the one first in order of these counts. The current contract holds for every
    season of the player.
    """
    columns = ["contract_expiration_date", "date_of_birth", "has_international_caps"]
    one = master.groupBy(F.col("tm_player_id").cast("string").alias("player_id")).agg(F.min(F.struct(*columns)).alias("_m")).select("player_id", "_m.*")
    out = _attach(panel_rows.drop("contract_end_date", "season_end_date", "contract_remaining_months", "has_contract_date"), one, ["player_id"])
    day = lambda c: F.to_date(F.try_to_timestamp(F.col(c).cast("string")))
    out = out.withColumns({"contract_end_date": day("contract_expiration_date"), "season_end_date": mapped(F.col("season"), dict(season_ends)).cast("date"), "birth_date": day("date_of_birth")})
    return out.withColumns(
        {
            "contract_remaining_months": months_until(F.col("contract_end_date"), F.col("season_end_date")),
            "has_contract_date": F.col("contract_end_date").isNotNull(),
            "worldcup_25_squad": flag(F.col("has_international_caps")),
        }
    ).drop(*columns)


def attach_rating(panel_rows: DataFrame, ratings: DataFrame) -> DataFrame:
    """fifa_rating and fifa_potential: the greatest of the player's ratings in a season. ratings: player_name, birth_year, season,
    overall, potential; matched by name and year of birth where there is one, else by name and season."""
    dated = match_to_panel(ratings.filter("birth_year is not null").withColumn("born", F.col("birth_year").cast("int")), panel_rows.withColumn("born", F.col("born").cast("int")), "player_name", "born").select("player_id", "season", "overall", "potential")
    undated = match_to_panel(ratings.filter("birth_year is null"), panel_rows, "player_name", "season").select("player_id", "season", "overall", "potential")
    best = dated.unionByName(undated).filter("player_id is not null").groupBy("player_id", "season").agg(F.max("overall").alias("fifa_rating"), F.max("potential").alias("fifa_potential"))
    return _attach(panel_rows.drop("fifa_rating", "fifa_potential"), best, ["player_id", "season"])


def attach_league_meta(panel_rows: DataFrame, competitions: DataFrame, codes: Mapping[str, str]) -> DataFrame:
    """league_tier, uefa_coefficient and league_value_multiplier by the competition a league is known under."""
    side = competitions.select("competition_id", F.col("league_tier").cast("byte").alias("league_tier"), "uefa_coefficient", "league_value_multiplier")
    return _attach(panel_rows.withColumn("competition_id", mapped(F.col("league"), dict(codes))), side, ["competition_id"]).drop("competition_id")


#: Columns the final panel begins with, in their order. Fixed values.
FINAL_ORDER = [
    "player_id", "player_name", "birth_year", "birth_date", "nationality", "continent_group", "season", "season_end_year", "season_end_date", "league",
    "league_tier", "uefa_coefficient", "league_value_multiplier", "club", "is_loan", "is_split_season", "age_at_season_end", "age_precision",
    "primary_position", "detailed_position", "minutes_played", "meets_min_minutes", "min_minutes_threshold", "xg", "xag", "npxg", "understat_xa", "xg_source",
    "market_value_eur", "market_value_date", "log_market_value", "contract_end_date", "contract_remaining_months", "has_contract_date", "fifa_rating",
    "fifa_potential", "worldcup_25_squad", "resolve_method", "resolve_score", "data_richness",
]


def finalize(panel_rows: DataFrame, nationality: Column, continents: Mapping[str, str], spare: Sequence[str] = ("nation", "born", "age")) -> DataFrame:
    """The panel with nationality, continent, exact or rough age, in its final order, without stats that no row has.

    One action over all stat columns finds those. A second row of a player and season is an error at run time.
    """
    age, precision = age_at(F.col("birth_date"), F.col("born"), F.col("season_end_date"))
    out = panel_rows.withColumn("nationality", nationality)
    out = out.withColumns({"continent_group": mapped(F.col("nationality"), dict(continents), "Other"), "season_end_year": F.year("season_end_date").cast("short"), "age_at_season_end": age, "age_precision": precision, "is_loan": F.lit(False)})
    out = out.withColumnRenamed("player_name_fbref", "player_name")
    leading = [c for c in FINAL_ORDER if c in out.columns]
    tail = [c for c in out.columns if c not in leading and c not in spare]
    known = out.agg(*[F.count(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(tail)]).first() if tail else []
    return joins.require_unique(out.select(*leading, *[F.col(f"`{c}`") for i, c in enumerate(tail) if known[i] > 0]), ["player_id", "season"])
