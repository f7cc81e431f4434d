"""Queries of the panel build, the feature modules, validation and exploration over the test tables, with their SQL.

``latest`` is one row for each player and season, the last loaded. Sources the tables lack are played by others: the
panel's rows of one xG source by the first source, those of another by the second, its ratings by the rating game.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions import scalars as X
from touchline.operators import joins, panel, resolve
from touchline.operators.windows import top_k
from touchline.plans import explore, features, inference, panel_build, training
from touchline.plans.lineage import cut
from touchline.queries.reference import nudged, r
from touchline.sources import loaders
from touchline.sources.tables import table
from touchline.sources.text_formats import arrivals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

LEAGUES = {"MR1": "Meridian League", "NC1": "Northern Crown", "LS1": "Liga Solenne", "BP1": "Bay Premiership", "OD1": "Ostmark Division", "EK1": "Eredia Klasse"}
TOP = ["Meridian League", "Northern Crown", "Liga Solenne"]
SEASON_ENDS = {"2021-22": "2022-06-30", "2022-23": "2023-06-30", "2023-24": "2024-06-30", "2024-25": "2025-06-30"}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with its SQL where there is one."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = nudged(sql)
        return f

    return register


def _known(c: str) -> str:
    return f"case when not isnan({c}) then {c} end"


def _fold(c: str) -> str:
    """``scalars.fold_text`` in SQL."""
    out = f"strip_accents(lower({c}))"
    for letter, plain in X.WHOLE_LETTERS.items():
        out = f"replace({out}, '{letter}', '{plain}')"
    return f"trim(regexp_replace(regexp_replace({out}, '[''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"


def _in(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


NUMBERS = ["xg", "fifa_rating", "contract_remaining_months", "age_at_season_end", "market_value_eur"]
LATEST = f"""p as (select * exclude (n) replace ({", ".join(f"{_known(c)} as {c}" for c in NUMBERS)}) from
  (select *, row_number() over (partition by player_id, season order by loaded_at desc, row_id) as n from unified_panel) where n = 1)"""
ENDS = "e as (select * from (values " + ", ".join(f"('{s}', date '{d}')" for s, d in SEASON_ENDS.items()) + ") t(season, season_end))"


def latest(spark: SparkSession, d: str) -> DataFrame:
    p = joins.keep_first(table(spark, d, "unified_panel"), ["player_id", "season"], [F.col("loaded_at").desc(), F.col("row_id")])
    return p.withColumns({c: X.clean_number(F.col(c)) for c in NUMBERS})


def _rates(minutes: str = "minutes_played") -> str:
    return ", ".join(f"case when {minutes} > 0 then {s} * 90.0 / {minutes} end as {s}90" for s in ("goals", "assists", "shots", "xg"))


# -- feature modules ---------------------------------------------------------------------------------------------


@query(
    f"""with {LATEST}, q as (select row_id, {_rates()} from p)
    select row_id, round(goals90, 6) as goals_per_90, round(xg90 + 0.5 * shots90, 6) as goal_threat, cast(null as double) as creative_threat, cast(null as double) as defensive_actions,
      round(case when shots90 >= 0.5 then goals90 / shots90 end, 6) as shooting_efficiency, round(goals90 + assists90, 6) as attacking_output,
      round(((xg90 + shots90 is not null)::int + (shots90 >= 0.5 and goals90 is not null)::int + (goals90 + assists90 is not null)::int) / 5.0, 6) as composite_completeness from
      (select row_id, goals90, assists90, shots90, xg90 from q) where shots90 is not null
    union all select row_id, round(goals90, 6), null, null, null, null, round(goals90 + assists90, 6), round((goals90 + assists90 is not null)::int / 5.0, 6) from q where shots90 is null"""
)
def feature_composites(spark: SparkSession, d: str) -> DataFrame:
    """Rates and composites; the panel has no expected assists, tackles or interceptions."""
    f = features.composites(features.per_90(latest(spark, d)))
    return f.select("row_id", *[r(c).alias(c) for c in ("goals_per_90", "goal_threat", "creative_threat", "defensive_actions", "shooting_efficiency", "attacking_output", "composite_completeness")])


def _z(c: str, keys: str) -> str:
    return f"case when count({c}) over (partition by {keys}) >= 15 and {keys.replace(', ', ' is not null and ')} is not null then ({c} - avg({c}) over (partition by {keys})) / (stddev_samp({c}) over (partition by {keys}) + 1e-6) end"


@query(
    f"""with {LATEST}, q as (select *, {_rates()} from p) select row_id, """
    + ", ".join(f"round({_z(c, keys)}, 4) as {n}_{suffix}" for n, c in (("goals_per_90", "goals90"), ("shots_per_90", "shots90"), ("minutes_played", "minutes_played")) for suffix, keys in (("z_pos", "season, primary_position"), ("z_league", "season, league")))
    + " from q"
)
def feature_zscores(spark: SparkSession, d: str) -> DataFrame:
    """Scores within season and position, and within season and league."""
    stats = ["goals_per_90", "shots_per_90", "minutes_played"]
    f = features.z_scores(features.per_90(latest(spark, d)), stats)
    return f.select("row_id", *[r(f"{s}_{z}", 4).alias(f"{s}_{z}") for s in stats for z in ("z_pos", "z_league")])


@query(
    f"""with {LATEST}, q as (select * from p), a as (select season as k1, primary_position as k2, count(minutes_played) as m, count(xg) as x from q group by all), b as (select season as k1, league as k2, count(minutes_played) as m, count(xg) as x from q group by all)
    select 'minutes_played' as stat, 'z_pos' as grouping, count(*) filter (where m between 1 and 14) as n_groups from a union all select 'xg', 'z_pos', count(*) filter (where x between 1 and 14) from a
    union all select 'minutes_played', 'z_league', count(*) filter (where m between 1 and 14) from b union all select 'xg', 'z_league', count(*) filter (where x between 1 and 14) from b"""
)
def feature_thin_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups too thin to be scored."""
    return features.thin_groups(latest(spark, d), ["minutes_played", "xg"])


@query(f"with {LATEST} select row_id, case season when '2021-22' then 1.0 when '2022-23' then 1.1 when '2023-24' then 1.254 when '2024-25' then 1.505 end::double as year_inflation_multiplier, case league when 'Meridian League' then 1.5 when 'Liga Solenne' then 1.25 end::double as league_value_multiplier from p")
def feature_multipliers(spark: SparkSession, d: str) -> DataFrame:
    """Inflation by season and value multiplier by league."""
    return features.multipliers(latest(spark, d), leagues={"Meridian League": 1.5, "Liga Solenne": 1.25}).select("row_id", "year_inflation_multiplier", "league_value_multiplier")


_REGIONS = {"AFRICA": "Africa", "ASIA": "Asia", "EUROPE": "Europe", "AMERICA": "NorthAmerica"}


@query(
    "select s_suppkey, "
    + ", ".join(f"c = '{c}' as is_continent_{c}" for c in features.CONTINENTS)
    + f" from (select s_suppkey, case r_name {' '.join(f'''when '{k}' then '{v}' ''' for k, v in _REGIONS.items())} else 'Other' end as c from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"
)
def feature_continents(spark: SparkSession, d: str) -> DataFrame:
    """A flag for each of the seven continents (suppliers by the region of their nation)."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    f = features.one_hot(s.withColumn("continent_group", X.mapped(F.col("r_name"), _REGIONS, "Other")), "continent_group", features.CONTINENTS, "is_continent_")
    return f.select("s_suppkey", *[f"is_continent_{c}" for c in features.CONTINENTS])


@query(
    f"""with {LATEST}, q as (select row_id, fifa_rating, fifa_rating + goals as potential, fifa_rating - lag(fifa_rating) over (partition by player_id order by season) as delta from p)
    select row_id, round(potential - fifa_rating, 4) as fifa_potential_gap, round(delta, 4) as delta_fifa_rating from q"""
)
def feature_rating(spark: SparkSession, d: str) -> DataFrame:
    """Potential gap and change of rating (goals on top of the rating play the potential)."""
    p = latest(spark, d).withColumn("fifa_potential", F.col("fifa_rating") + F.col("goals"))
    return features.rating_gap(features.history(p)).select("row_id", r("fifa_potential_gap", 4).alias("fifa_potential_gap"), r("delta_fifa_rating", 4).alias("delta_fifa_rating"))


# -- panel build -------------------------------------------------------------------------------------------------


@query(
    f"""with {LATEST}, v as (select tm_player_id, cast(snapshot_date as date) as sd, market_value_in_eur as mv, player_club_domestic_competition_id as comp from tm_valuations where tm_player_id is not null and snapshot_date is not null and player_club_domestic_competition_id in ({_in(list(LEAGUES))})), {ENDS},
    c as (select tm_player_id, season, season_end, mv, sd, comp, row_number() over (partition by tm_player_id, season order by abs(date_diff('day', season_end, sd)), sd, mv nulls first, comp nulls first) as k from v, e where abs(date_diff('day', season_end, sd)) <= 45)
    select row_id, mv as market_value_eur, sd as market_value_date, round(ln(1 + mv), 6) as log_market_value from p left join (select * from c where k = 1) s on p.player_id = cast(s.tm_player_id as varchar) and p.season = s.season"""
)
def attach_market_value(spark: SparkSession, d: str) -> DataFrame:
    """Season snapshots within 45 days of the season's end, attached by player and season."""
    v = table(spark, d, "tm_valuations").select(F.col("tm_player_id").alias("player_id"), F.col("snapshot_date").alias("date"), "market_value_in_eur", "player_club_domestic_competition_id")
    ends = spark.createDataFrame(list(SEASON_ENDS.items()), "season string, season_end_date string")
    out = panel_build.attach_market_value(latest(spark, d), loaders.season_snapshots(v, ends, list(LEAGUES), 45))
    return out.select("row_id", "market_value_eur", "market_value_date", r("log_market_value").alias("log_market_value"))


_MASTER = """m as (select cast(tm_player_id as varchar) as id, try_cast(contract_expiration_date as date) as ce, try_cast(date_of_birth as date) as dob, coalesce(international_caps, 0) > 0 as caps from tm_players)"""


@query(
    f"""with {LATEST}, {_MASTER}, {ENDS} select row_id, ce as contract_end_date, season_end as season_end_date, round(greatest(date_diff('day', season_end, ce) / 30.44, 0), 6) as contract_remaining_months, ce is not null as has_contract_date, coalesce(caps, false) as worldcup_25_squad
    from p left join m on p.player_id = m.id left join e using (season) where ce is not null and season_end is not null
    union all select row_id, ce, season_end, null, ce is not null, coalesce(caps, false) from p left join m on p.player_id = m.id left join e using (season) where ce is null or season_end is null"""
)
def attach_contract(spark: SparkSession, d: str) -> DataFrame:
    """The current contract of a player's master row, in months at each season's end."""
    m = table(spark, d, "tm_players").withColumn("has_international_caps", F.coalesce(F.col("international_caps") > 0, F.lit(False)))
    out = panel_build.attach_contract(latest(spark, d), _plain_dates(m), SEASON_ENDS)
    return out.select("row_id", "contract_end_date", "season_end_date", r("contract_remaining_months").alias("contract_remaining_months"), "has_contract_date", "worldcup_25_squad")


def _plain_dates(m: DataFrame) -> DataFrame:
    """Dates of the usual form only, so that both engines read the same ones."""
    usual = lambda c: F.when(F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}( 00:00:00)?$"), F.substring(c, 1, 10))
    return m.withColumns({c: usual(c) for c in ("contract_expiration_date", "date_of_birth")})


@query(
    f"""with {LATEST}, a as (select player_id, sum(xg) as xg, sum(goals)::double as npxg, sum(assists)::double as xag from (select player_id, {_known("xg")} as xg, goals, assists from unified_panel where xg_source = 'kaggle' and season = '2024-25') group by all),
    b as (select player_id, season, sum(xg) as xg, sum(goals)::double as npxg, sum(assists)::double as xa from (select player_id, season, {_known("xg")} as xg, goals, assists from unified_panel where xg_source = 'understat') group by all),
    j as (select p.row_id, p.league in ({_in(TOP)}) as top, p.season = '2024-25' as last, a.xg as ax, a.npxg as an, a.xag as aa, b.xg as bx, b.npxg as bn, b.xa as ba from p left join a on p.player_id = a.player_id and p.season = '2024-25' left join b on p.player_id = b.player_id and p.season = b.season)
    select row_id, round(case when top and last and ax is not null then ax when top then bx end, 6) as xg, round(case when top and last and an is not null then an when top then bn end, 6) as npxg, case when top and last then aa end as xag, ba as understat_xa,
      case when top and last and ax is not null then 'kaggle' when top and bx is not null then 'understat' else 'none' end as xg_source from j"""
)
def attach_xg(spark: SparkSession, d: str) -> DataFrame:
    """Expected goals by priority of source with their label."""
    p = table(spark, d, "unified_panel").withColumn("xg", X.clean_number(F.col("xg")))
    first = p.filter("xg_source = 'kaggle' and season = '2024-25'").select("player_id", "xg", F.col("goals").alias("npxg"), F.col("assists").alias("xag"))
    second = p.filter("xg_source = 'understat'").select("player_id", "season", "xg", F.col("goals").alias("np_xg"), F.col("assists").alias("xa"))
    out = panel_build.attach_xg(latest(spark, d), first, second, TOP, "2024-25")
    return out.select("row_id", r("xg").alias("xg"), r("npxg").alias("npxg"), "xag", "understat_xa", "xg_source")


_NAMED = f"""n as (select player_id, season, born, {_fold("player_name_fbref")} as n from p), i as (select *, case when n like '% %' then n[1] || substr(n, instr(n, ' ')) else n[1] end as ini from n)"""


def _one_id(keys: str) -> str:
    return f"(select {keys}, min(player_id) as id from i group by {keys} having count(distinct player_id) = 1)"


@query(
    f"""with {LATEST}, {_NAMED}, t as (select fee_id, {_fold("player_name")} as n, 2024 - player_age as y from transfer_fees_2024_25), q as (select *, case when n like '% %' then n[1] || substr(n, instr(n, ' ')) else n[1] end as ini from t),
    x as {_one_id("n, born")}, s as {_one_id("ini, born")}
    select fee_id, coalesce(x.id, s.id) as player_id from q left join x on q.n is not distinct from x.n and q.y is not distinct from x.born left join s on q.ini is not distinct from s.ini and q.y is not distinct from s.born"""
)
def match_name_and_year(spark: SparkSession, d: str) -> DataFrame:
    """Transfers matched to the panel by folded name, else by initials, and year of birth, where that is one id."""
    t = table(spark, d, "transfer_fees_2024_25").select("fee_id", F.coalesce("player_name", F.lit("")).alias("player_name"), (F.lit(2024) - F.col("player_age")).alias("born"))
    return panel_build.match_to_panel(t, latest(spark, d).filter("player_name_fbref is not null"), "player_name", "born").select("fee_id", "player_id")


@query(
    f"""with {LATEST}, {_NAMED}, g as (select player_name_fbref as name, born as y, season, {_known("fifa_rating")} as overall from unified_panel), q0 as (select *, {_fold("name")} as n from g), q as (select *, case when n like '% %' then n[1] || substr(n, instr(n, ' ')) else n[1] end as ini from q0),
    x as {_one_id("n, born")}, s as {_one_id("ini, born")}, u as {_one_id("n, season")}, w as {_one_id("ini, season")},
    k as (select coalesce(x.id, s.id) as id, q.season, overall from q left join x on q.n = x.n and y = x.born left join s on q.ini = s.ini and y = s.born where y is not null
      union all select coalesce(u.id, w.id), q.season, overall from q left join u on q.n = u.n and q.season = u.season left join w on q.ini = w.ini and q.season = w.season where y is null),
    b as (select id, season, max(overall) as rating from k where id is not null group by all)
    select p.row_id, b.rating as fifa_rating from p left join b on p.player_id = b.id and p.season = b.season"""
)
def attach_rating(spark: SparkSession, d: str) -> DataFrame:
    """Ratings matched by name and year of birth, else by name and season, the best of a season kept."""
    rows = table(spark, d, "unified_panel").select(F.col("player_name_fbref").alias("player_name"), F.col("born").alias("birth_year"), "season", X.clean_number(F.col("fifa_rating")).alias("overall"), F.lit(None).cast("double").alias("potential"))
    return panel_build.attach_rating(latest(spark, d), rows).select("row_id", "fifa_rating")


@query(
    f"""with {LATEST}, c as (select domestic_competition_id as id, count(*) as n from tm_clubs group by all), k as (select league, any_value(domestic_competition_id) as id from tm_clubs group by all)
    select row_id, cast(n % 5 as tinyint) as league_tier, cast(n as double) as uefa_coefficient, n / 100.0 as league_value_multiplier from p left join k using (league) left join c on k.id = c.id"""
)
def attach_league_meta(spark: SparkSession, d: str) -> DataFrame:
    """Tier, coefficient and multiplier of a league's competition (made from its number of clubs)."""
    n = F.count(F.lit(1))
    c = table(spark, d, "tm_clubs").groupBy(F.col("domestic_competition_id").alias("competition_id")).agg((n % 5).alias("league_tier"), n.cast("double").alias("uefa_coefficient"), (n / 100.0).alias("league_value_multiplier"))
    return panel_build.attach_league_meta(latest(spark, d), c, {v: k for k, v in LEAGUES.items()}).select("row_id", "league_tier", "uefa_coefficient", "league_value_multiplier")


@query(
    f"""with {LATEST}, {_MASTER}, {ENDS}, q as (select p.row_id, dob, born, season_end as se, country from p left join (select distinct * from m) m on p.player_id = m.id left join e using (season) left join nationality_map on nation = code)
    select row_id, country as nationality, case when country like 'V%' then 'Europe' when country like 'C%' then 'Africa' else 'Other' end as continent_group, cast(year(se) as smallint) as season_end_year,
      round(case when dob is not null then date_diff('day', dob, se) / 365.25 else year(se) - born end, 6) as age_at_season_end, case when dob is not null then 'exact' else 'year_only' end as age_precision from q"""
)
def finalize_panel(spark: SparkSession, d: str) -> DataFrame:
    """Nationality, continent, season year and age with its precision, in the final order of columns."""
    codes = {row["code"]: row["country"] for row in table(spark, d, "nationality_map").collect()}  # 24 rows, fixed
    m = table(spark, d, "tm_players").withColumn("has_international_caps", F.lit(False))
    p = panel_build.attach_contract(latest(spark, d), _plain_dates(m), SEASON_ENDS)
    continents = {c: "Europe" if c.startswith("V") else "Africa" for c in codes.values() if c[:1] in "VC"}
    out = panel_build.finalize(p.drop("age_at_season_end", "age_precision"), X.nationality(F.col("nation"), codes, []), continents)
    return out.select("row_id", "nationality", "continent_group", "season_end_year", r("age_at_season_end").alias("age_at_season_end"), "age_precision")


@query(f"select row_id, case when league in ({_in(TOP)}) then 450 else 300 end as min_minutes_threshold, coalesce(minutes_played, 0) >= case when league in ({_in(TOP)}) then 450 else 300 end as meets_min_minutes from unified_panel")
def minimum_minutes(spark: SparkSession, d: str) -> DataFrame:
    """The minutes a row needs to count, by league."""
    return panel.with_minimum(table(spark, d, "unified_panel"), "minutes_played", "league", TOP, 450, 300).select("row_id", "min_minutes_threshold", "meets_min_minutes")


@query(
    """with s as (select player_id, season, club, minutes_played, goals, row_id, shots::double as save_pct, goals * 90.0 / nullif(minutes_played, 0) as goals_per_90, minutes_played / 90.0 as matches_90s, primary_position from unified_panel where minutes_played between 0 and 3800),
    g as (select player_id, season, count(*) as n, sum(minutes_played) as minutes_played, sum(goals) as goals, sum(matches_90s) as nineties, max(goals_per_90) as own, max(save_pct) as own_pct,
      sum(case when save_pct is not null then save_pct * minutes_played end) / nullif(sum(case when save_pct is not null then minutes_played end), 0) as pct,
      sum(case when goals_per_90 is not null then goals_per_90 * minutes_played end) / nullif(sum(case when goals_per_90 is not null then minutes_played end), 0) as mean90,
      arg_max(primary_position, (minutes_played, -row_id)) as primary_position from s group by all)
    select player_id, season, minutes_played, goals, round(case when n = 1 then own_pct else pct end, 6) as save_pct, round(case when n = 1 then own when nineties > 0 then goals / nineties else mean90 end, 6) as goals_per_90, primary_position, n > 1 as is_split_season from g"""
)
def collapse_seasons(spark: SparkSession, d: str) -> DataFrame:
    """Stints put together by the kind of each stat; a season of one stint stays as it is, also without minutes."""
    p = table(spark, d, "unified_panel").filter("minutes_played between 0 and 3800")
    p = p.select("player_id", "season", "minutes_played", "goals", "row_id", F.col("shots").cast("double").alias("save_pct"), X.guarded_rate(F.col("goals") * 90.0, F.col("minutes_played")).alias("goals_per_90"), (F.col("minutes_played") / 90.0).alias("matches_90s"), "primary_position")
    out = panel.collapse_parts(p, ["player_id", "season"], "minutes_played", [-F.col("row_id")], ["goals"], ["save_pct"], {"goals_per_90": ("goals", "matches_90s")}, ["primary_position"])
    return out.select("player_id", "season", "minutes_played", "goals", r("save_pct").alias("save_pct"), r("goals_per_90").alias("goals_per_90"), "primary_position", F.col("is_split").alias("is_split_season"))


@query(f"select tm_player_id, {_fold('player_name')} as folded, case when f like '% %' then f[1] || substr(f, instr(f, ' ')) else f[1] end as initials from (select *, {_fold('player_name')} as f from tm_players)")
def fold_and_initials(spark: SparkSession, d: str) -> DataFrame:
    """Folded names and their initials."""
    p = table(spark, d, "tm_players").select("tm_player_id", X.fold_name(F.col("player_name")).alias("folded"))
    return p.withColumn("initials", X.initials(F.col("folded")))


_STOP = _in(X.CLUB_STOPWORDS)
_ALIAS = " ".join(f"when '{a}' then '{b}'" for a, b in X.CLUB_ALIASES.items())


@query(f"select club_id, array_to_string(list_filter(list_transform(string_split({_fold('club_name')}, ' '), lambda w: case w {_ALIAS} else w end), lambda w: w not in ({_STOP})), ' ') as club_key from tm_clubs")
def club_keys(spark: SparkSession, d: str) -> DataFrame:
    """Club names without the words that say nothing."""
    return table(spark, d, "tm_clubs").select("club_id", X.club_key(F.col("club_name")).alias("club_key"))


@query()
def club_pairs_alike(spark: SparkSession, d: str) -> DataFrame:
    """Transfers whose former club is, however spelled, the player's current one in the master (similarity; fixtures in the tests)."""
    t, m = table(spark, d, "transfer_fees_2024_25"), table(spark, d, "tm_players")
    j = t.join(m, t.player_name == m.player_name).select("fee_id", "tm_player_id", X.club_key(F.col("from_club")).alias("a"), X.club_key(F.col("current_club_name")).alias("b"))
    return j.select("fee_id", "tm_player_id", resolve.clubs_match(F.col("a"), F.col("b")).alias("same_club"))


@query(f"select tm_player_id, coalesce(c.country, d.country) as nationality from tm_players left join nationality_map c on trim(country_of_citizenship) = c.code left join nationality_map d on replace({_fold('country_of_citizenship')}, ' ', '') = replace({_fold('d.country')}, ' ', '')")
def nationality_of(spark: SparkSession, d: str) -> DataFrame:
    """Countries however written, by the canonical name."""
    codes = {row["code"]: row["country"] for row in table(spark, d, "nationality_map").collect()}  # 24 rows, fixed
    X.require_targets(codes, list(codes.values()))
    return table(spark, d, "tm_players").select("tm_player_id", X.nationality(F.col("country_of_citizenship"), codes, list(codes.values())).alias("nationality"))


# -- joins, filters, sources ---------------------------------------------------------------------------------------


@query("select o_orderkey, c.n_name as buyer_n_name, s.n_name as seller_n_name from orders left join lineitem on o_orderkey = l_orderkey and l_linenumber = 1 left join customer on o_custkey = c_custkey left join supplier on l_suppkey = s_suppkey left join nation c on c_nationkey = c.n_nationkey left join nation s on s_nationkey = s.n_nationkey")
def same_dimension_twice(spark: SparkSession, d: str) -> DataFrame:
    """One dimension in two roles."""
    o = table(spark, d, "orders").join(table(spark, d, "lineitem").filter("l_linenumber = 1").select("l_orderkey", "l_suppkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    o = o.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"), "left").join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return joins.join_roles(o, table(spark, d, "nation"), "n_nationkey", {"buyer_": "c_nationkey", "seller_": "s_nationkey"}, ["n_name"]).select("o_orderkey", "buyer_n_name", "seller_n_name")


@query("select row_id, count(*) over (partition by player_name_fbref, born, nation) > 1 as is_repeated from unified_panel")
def self_flag_from_counts(spark: SparkSession, d: str) -> DataFrame:
    """Whether a name, year and nation stand more than once, nulls alike."""
    p = table(spark, d, "unified_panel").select("row_id", "player_name_fbref", "born", "nation")
    return joins.flag_repeated(p, ["player_name_fbref", "born", "nation"], "is_repeated").select("row_id", "is_repeated")


@query("select c_custkey as id, c_name as name, cast(null as varchar) as phone, c_acctbal as balance from customer")
def schema_align(spark: SparkSession, d: str) -> DataFrame:
    """Columns in a stated order and type, null where a source lacks them."""
    c = table(spark, d, "customer").select(F.col("c_acctbal").alias("balance"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return joins.schema_aligned(c, {"id": "long", "name": "string", "phone": "string", "balance": "double"})


@query("select distinct nation, season from unified_panel where minutes_played < 300 except select nation, season from unified_panel where minutes_played > 3000")
def key_difference(spark: SparkSession, d: str) -> DataFrame:
    """Key pairs of one side that another lacks, null keys alike."""
    p = table(spark, d, "unified_panel")
    return joins.keys_only_in(p.filter("minutes_played < 300"), p.filter("minutes_played > 3000"), ["nation", "season"])


@query(
    """with a as (select league, player_id, sum(coalesce(goals, 0)) as goals, sum(coalesce(shots, 0)) as shots from unified_panel where season = '2022-23' and player_id is not null group by all), b as (select league, player_id, sum(coalesce(goals, 0)) as goals, sum(coalesce(shots, 0)) as shots from unified_panel where season = '2023-24' and player_id is not null group by all),
    j as (select league, 'goals' as stat, a.goals::double as x, b.goals::double as y from a join b using (league, player_id) union all select league, 'shots', a.shots, b.shots from a join b using (league, player_id))
    select league, stat, count(*) as n, round(corr(x, y), 6) as pearson, round(avg(abs(x - y)), 6) as mae, round(avg(x), 6) as mean_a, round(avg(y), 6) as mean_b from j group by all"""
)
def source_cross_check(spark: SparkSession, d: str) -> DataFrame:
    """The same stats of two sources (two seasons play them), matched by key."""
    p = table(spark, d, "unified_panel").filter("player_id is not null")
    out = joins.cross_check(p.filter("season = '2022-23'"), p.filter("season = '2023-24'"), "player_id", ["league"], ["goals", "shots"])
    return out.select("league", "stat", "n", *[r(c).alias(c) for c in ("pearson", "mae", "mean_a", "mean_b")])


@query("select fee_id, player_name from transfer_fees_2024_25 where regexp_matches(lower(player_name), '^mar|an') and cast(transfer_date as date) between date '2024-06-15' and date '2025-01-31'")
def text_and_date_filter(spark: SparkSession, d: str) -> DataFrame:
    """A regular expression whatever the case, and a range of dates with both ends."""
    t = table(spark, d, "transfer_fees_2024_25")
    return t.filter(X.matches_text(F.col("player_name"), "^MAR|an") & X.between_dates(F.col("transfer_date"), "2024-06-15", "2025-01-31")).select("fee_id", "player_name")


@query("select 'orders' as name, count(*) as n_rows from orders union all select 'nation', count(*) from nation union all select 'tm_clubs', count(*) from tm_clubs")
def footer_row_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of files, from their footers."""
    f = loaders.footer_rows(spark, [f"{d}/{n}.parquet" for n in ("orders", "nation", "tm_clubs")])
    name = F.regexp_extract("path", r"(\w+)\.parquet", 1)
    return f.groupBy(name.alias("name")).agg(F.sum("n_rows").alias("n_rows"))


_FEE_TEXT = """case transfer_type when 'free' then 'Free transfer' when 'end_of_loan' then 'End of loan<br>' || cast(transfer_date as date) when 'loan' then 'loan transfer €' || fee_id || 'k' when 'undisclosed' then case when fee_id % 2 = 0 then '?' else '-' end
  else case when transfer_fee_eur >= 1e6 then '€' || printf('%.2f', transfer_fee_eur / 1e6) || 'm' else '€' || printf('%.0f', transfer_fee_eur / 1e3) || 'k' end end"""


def _fee_text() -> F.Column:
    kind, fee = F.col("transfer_type"), F.col("transfer_fee_eur")
    paid = F.when(fee >= 1e6, F.concat(F.lit("€"), F.format_string("%.2f", fee / 1e6), F.lit("m"))).otherwise(F.concat(F.lit("€"), F.format_string("%.0f", fee / 1e3), F.lit("k")))
    loan = F.concat(F.lit("loan transfer €"), F.col("fee_id").cast("string"), F.lit("k"))
    ended = F.concat(F.lit("End of loan<br>"), F.coalesce(F.col("transfer_date").cast("date").cast("string"), F.lit("")))
    return F.when(kind == "free", "Free transfer").when(kind == "end_of_loan", ended).when(kind == "loan", loan).when(kind == "undisclosed", F.when(F.col("fee_id") % 2 == 0, "?").otherwise("-")).when(fee.isNotNull(), paid)


_FEE_SQL = "select fee_id, round(case when transfer_type = 'fee' then case when transfer_fee_eur >= 1e6 then cast(printf('%.2f', transfer_fee_eur / 1e6) as double) * 1e6 else cast(printf('%.0f', transfer_fee_eur / 1e3) as double) * 1e3 end end, 2) as amount, case when transfer_type = 'fee' and transfer_fee_eur is not null then 'paid' when transfer_type in ('free', 'end_of_loan', 'loan') then transfer_type else 'undisclosed' end as kind from transfer_fees_2024_25"


@query(_FEE_SQL)
def fee_texts(spark: SparkSession, d: str) -> DataFrame:
    """Amount and kind of fees, written as a page would and read back."""
    amount, kind = X.fee_parts(F.col("text"))
    return table(spark, d, "transfer_fees_2024_25").withColumn("text", _fee_text()).select("fee_id", r(amount, 2).alias("amount"), kind.alias("kind"))


@query(
    "select fee_id, coalesce(trim(regexp_replace(replace(player_name, chr(160), ' '), '\\s+', ' ', 'g')), '') as player_name, trim(replace(to_club, chr(160), ' ')) as to_club, amount as transfer_fee_eur, kind as transfer_type from transfer_fees_2024_25 join (" + _FEE_SQL + ") using (fee_id) where trim(to_club) <> '' and not contains(lower(to_club), 'season')"
)
def arrivals_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Arrivals of club boxes of a page, pages made from the transfers: departures and rows without a player do not count."""
    t = table(spark, d, "transfer_fees_2024_25").withColumn("text", _fee_text())
    cell = lambda css, c: F.concat(F.lit(f'<td class="{css}">'), c, F.lit("</td>"))
    esc = lambda c: F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    row = F.concat(F.lit('<tr><td><a href="/x/profil/spieler/1">'), esc("player_name"), F.lit("</a></td>"), cell("alter-transfer-cell", F.coalesce(F.col("player_age").cast("string"), F.lit(""))), cell("verein-flagge-transfer-cell", esc("from_club")), cell("rechts mw-transfer-cell", F.lit("€1.00m")), cell("rechts", F.coalesce("text", F.lit("?"))), F.lit("</tr>"))
    page = F.concat(
        F.lit('<div class="box"><h2>Transfer record</h2><div class="responsive-table"><table><thead><tr><th>In</th></tr></thead></table></div></div><div class="box"><h2>'), esc("to_club"),
        F.lit('</h2><div class="responsive-table"><table><thead><tr><th>Out</th></tr></thead><tbody>'), row, F.lit('</tbody></table></div><div class="responsive-table"><table><thead><tr><th>In</th><th>Age</th></tr></thead><tbody><tr><td>No arrivals</td></tr>'), row, F.lit("</tbody></table></div></div>"),
    )
    return arrivals(t.select("fee_id", page.alias("html")), "fee_id", "html").select("fee_id", "player_name", "to_club", r("transfer_fee_eur", 2).alias("transfer_fee_eur"), "transfer_type")


@query(f"select tm_player_id, case position_name when 'Goalkeeper' then 'GK' when 'Defender' then 'DEF' when 'Midfield' then 'MID' when 'Attack' then 'FWD' else 'Other' end as position_primary, case current_club_domestic_competition_id {' '.join(f'''when '{k}' then '{v}' ''' for k, v in LEAGUES.items())} end as current_league_name, coalesce(international_caps, 0) > 0 as has_international_caps from tm_players where current_club_domestic_competition_id in ({_in(list(LEAGUES))})")
def load_players(spark: SparkSession, d: str) -> DataFrame:
    """The player master with position groups, leagues and caps."""
    raw = table(spark, d, "tm_players").withColumnsRenamed({"tm_player_id": "player_id", "player_name": "name", "position_name": "position"})
    return loaders.load_players(raw, LEAGUES).select("tm_player_id", "position_primary", "current_league_name", "has_international_caps")


# -- training, inference, validation -------------------------------------------------------------------------------


@query(
    f"""with {LATEST}, q as (select *, cast(substr(season, 1, 4) as int) as y, coalesce(minutes_played, 0) >= 450 as ok from p), w as (select *, lead(y) over k as ny, lead(ok) over k as nok, lead(primary_position) over k as npos, lead(goals) over k as ng from q window k as (partition by player_id order by y))
    select row_id, ng as next_goals, case when season in ('2021-22', '2022-23') then 'train' else 'val' end as split from w where ny = y + 1 and ok and nok and primary_position = npos and season in ('2021-22', '2022-23', '2023-24')"""
)
def projection_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of consecutive seasons with enough minutes in one position, split by season."""
    p = latest(spark, d).withColumn("meets_min_minutes", F.coalesce("minutes_played", F.lit(0)) >= 450)
    return training.projection_pairs(p, ["goals"], ["2021-22", "2022-23"], ["2023-24"]).select("row_id", "next_goals", "split")


@query(f"with {LATEST} select row_id, case when season = '2024-25' then 'val' else 'train' end as split from p where market_value_eur is not null and minutes_played >= 450 and season in ('2021-22', '2022-23', '2023-24', '2024-25')")
def valuation_rows(spark: SparkSession, d: str) -> DataFrame:
    """Valued rows with enough minutes, split by season."""
    p = latest(spark, d).withColumn("meets_min_minutes", F.col("minutes_played") >= 450)
    return training.valuation_rows(p, ["2021-22", "2022-23", "2023-24"], ["2024-25"]).select("row_id", "split")


@query("with m as (select p_brand as position, p_size as target, case p_partkey % 4 when 0 then 'ridge' when 1 then 'trees' when 2 then 'mlp' else 'stacked' end as model, p_partkey % 4 as o, min(p_retailprice) as mae from part group by all) select position, target, model, mae from (select *, row_number() over (partition by position, target order by mae, o) as k from m) where k = 1")
def best_model_per_slot(spark: SparkSession, d: str) -> DataFrame:
    """The row of least error of each slot, the simpler of equal ones."""
    names = {0: "ridge", 1: "trees", 2: "mlp", 3: "stacked"}
    m = table(spark, d, "part").groupBy(F.col("p_brand").alias("position"), F.col("p_size").alias("target"), X.mapped((F.col("p_partkey") % 4).cast("int"), names).alias("model")).agg(F.min("p_retailprice").alias("mae"))
    return training.best_models(m).select("position", "target", "model", "mae")


@query(f"with {LATEST}, w as (select goals, lead(goals) over (partition by player_id order by season) as ng from p) select count(abs(ng - goals)) as n, round(avg(abs(ng - goals)), 6) as mae from w")
def naive_baseline(spark: SparkSession, d: str) -> DataFrame:
    """The error of 'as this season, so the next'."""
    from touchline.operators.windows import Window

    p = latest(spark, d).withColumn("ng", F.lead("goals").over(Window.partitionBy("player_id").orderBy("season")))
    return inference.naive_error(p, F.col("goals"), F.col("ng")).withColumn("mae", r("mae"))


@query("with x as (select abs(exp(ln(1 + l_quantity * 1500)) - 1 - l_extendedprice) as e from lineitem) select count(e) as n, round(avg(e), 3) as mae_eur, round(median(e), 3) as median_ae_eur from x")
def money_errors(spark: SparkSession, d: str) -> DataFrame:
    """Errors of log predictions in money."""
    li = table(spark, d, "lineitem")
    e = inference.money_errors(li, F.log1p("l_extendedprice"), F.log1p(F.col("l_quantity") * 1500))
    return e.select("n", r("mae_eur", 3).alias("mae_eur"), r("median_ae_eur", 3).alias("median_ae_eur"))


_FEES = f"""t as (select fee_id, {_fold("player_name")} as n, player_age::double as age, transfer_fee_eur as fee from transfer_fees_2024_25 where transfer_fee_eur > 0 and not isnan(transfer_fee_eur)), s as (select row_id, {_fold("player_name_fbref")} as n, age_at_season_end as age, market_value_eur as mv, fifa_rating from p where season = '2023-24'),
  c as (select fee_id, fee, row_id, mv, fifa_rating, row_number() over (partition by fee_id order by abs(t.age - s.age), row_id) as k from t join s using (n) where n <> '' and abs(t.age - s.age) <= 3), j as (select *, fifa_rating * fifa_rating * 3000 as pred from c where k = 1 and fifa_rating is not null)"""


@query(
    f"""with {LATEST}, {_FEES} select count(*) as n, round(median(pred / fee), 6) as median_ratio, round(avg(pred / fee), 6) as mean_ratio, round(corr(pred, fee), 6) as pearson, round(corr(ln(1 + pred), ln(1 + fee)), 6) as pearson_log, round(avg(abs(ln(1 + pred) - ln(1 + fee))), 6) as log_mae,
    round(1 - sum(pow(ln(1 + fee) - ln(1 + pred), 2)) / (var_pop(ln(1 + fee)) * count(*)), 6) as r2_log, count(*) filter (where mv > 0) as naive_n, round(corr(case when mv > 0 then mv end, fee), 6) as naive_pearson, round(median(case when mv > 0 then mv / fee end), 6) as naive_median_ratio from j"""
)
def fee_validation(spark: SparkSession, d: str) -> DataFrame:
    """Fees against a value (of the rating) of the season before, and against the naive market value."""
    t = table(spark, d, "transfer_fees_2024_25").withColumn("transfer_fee_eur", X.clean_number(F.col("transfer_fee_eur")))
    rows = latest(spark, d).filter("season = '2023-24'").select("row_id", F.col("player_name_fbref").alias("player_name"), "age_at_season_end", "market_value_eur", "fifa_rating")
    m = inference.match_fees(t, rows).withColumn("pred", F.col("fifa_rating") * F.col("fifa_rating") * 3000)
    v = inference.fee_validation(m, "pred", "market_value_eur")
    return v.select("n", "naive_n", *[r(c).alias(c) for c in ("median_ratio", "mean_ratio", "pearson", "pearson_log", "log_mae", "r2_log", "naive_pearson", "naive_median_ratio")])


_CHAIN = """x as (select player_id, market_value_eur as actual from p where season = '2024-25' and market_value_eur is not null), y as (select player_id, fifa_rating * fifa_rating * 3000 as pred, market_value_eur as naive from p where season = '2023-24'), j as (select pred, naive, actual, actual * 1.1 as oracle from x join y using (player_id)),
  s as (select *, pred > 0 and naive > 0 and oracle > 0 as shared from j)"""


def _scenario(name: str, c: str, common: bool) -> str:
    return f"""select '{name}' as scenario, count(*) as n, round(avg(abs(actual - {c})), 2) as mae, round(1 - sum(pow(ln(1 + actual) - ln(1 + {c}), 2)) / (var_pop(ln(1 + actual)) * count(*)), 6) as r2_log, round(median({c} / actual), 6) as median_ratio,
    round(avg(case when abs({c} / actual - 1) <= 0.3 then 1.0 else 0 end), 6) as share_within, {str(common).lower()} as common from s where actual > 0 and {c} > 0{" and shared" if common else ""}"""


@query(f"with {LATEST}, {_CHAIN} " + " union all ".join(_scenario(n, c, common) for common in (False, True) for n, c in (("pipeline", "pred"), ("naive", "naive"), ("oracle", "oracle"))))
def chain_validation(spark: SparkSession, d: str) -> DataFrame:
    """Projection, naive and oracle against what came true, each on its own rows and on those all have."""
    p = latest(spark, d)
    actual = p.filter("season = '2024-25' and market_value_eur is not null").select("player_id", F.col("market_value_eur").alias("actual_mv"))
    pred = p.filter("season = '2023-24'").select("player_id", (F.col("fifa_rating") * F.col("fifa_rating") * 3000).alias("projected_mv_next"), F.col("market_value_eur").alias("observed_current_mv"))
    v = inference.validate_chain(pred, actual, actual.select("player_id", (F.col("actual_mv") * 1.1).alias("oracle_mv")))
    return v.select("scenario", "n", r("mae", 2).alias("mae"), r("r2_log").alias("r2_log"), r("median_ratio").alias("median_ratio"), r("share_within").alias("share_within"), "common")


@query(
    f"""with {LATEST}, z as (select row_id, primary_position as position, ln(1 + fifa_rating * fifa_rating * 3000) as pl, ln(1 + market_value_eur) as al from p where primary_position is not null), q as (select position, quantile_cont(al - pl, 0.05) as lo, quantile_cont(al - pl, 0.95) as hi from z where al - pl is not null group by all having count(*) >= 10)
    select row_id, round(exp(pl + lo) - 1, 2) as ci_low, round(exp(pl + hi) - 1, 2) as ci_high from z left join q using (position)"""
)
def residual_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Intervals in money from the residual quantiles of each position."""
    p = latest(spark, d).filter("primary_position is not null").select("row_id", F.col("primary_position").alias("position"), F.log1p(F.col("fifa_rating") * F.col("fifa_rating") * 3000).alias("projected_log"), F.log1p("market_value_eur").alias("al"))
    out = inference.with_interval(p, inference.residual_quantiles(p, F.col("al"), F.col("projected_log")))
    return out.select("row_id", r("ci_low", 2).alias("ci_low"), r("ci_high", 2).alias("ci_high"))


_LIGHT = training.Learners(ridge_grid=training.RIDGE_GRID[:1], tree_grid=[{"depth": 3, "rounds": 5}], hidden=(16,))


def _features(spark: SparkSession, d: str) -> DataFrame:
    f = latest(spark, d).withColumns({"log_market_value": F.log1p("market_value_eur"), "meets_min_minutes": F.coalesce("minutes_played", F.lit(0)) >= 450, "player_name": F.col("player_name_fbref")})
    return cut(features.build(f.drop("row_id", "born", "load_id", "resolve_score"), ["goals_per_90", "shots_per_90", "minutes_played"]))


@query()
def train_and_project(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of all four learners on one projection and one valuation slot (the full tree grid is ``training.TREE_GRID``)."""
    f = _features(spark, d)
    pairs = training.projection_pairs(f, ["goals_per_90"], ["2021-22", "2022-23"], ["2023-24"])
    m, _, _ = training.train_slots(spark, pairs, [("FWD", "goals_per_90", "next_goals_per_90", "goals_per_90")], learners=_LIGHT)
    v, _, _ = training.train_slots(spark, training.valuation_rows(f, ["2021-22", "2022-23", "2023-24"], ["2024-25"]), [("FWD", "value", "log_market_value", None)], learners=_LIGHT)
    return m.unionByName(v)


@query()
def predict_forward(spark: SparkSession, d: str) -> DataFrame:
    """Forwards of a season valued a season on, with intervals from the chain's own residuals."""
    f, light = _features(spark, d), training.Learners(["ridge"], training.RIDGE_GRID[:1])
    pairs = training.projection_pairs(f, ["goals_per_90"], ["2021-22", "2022-23"], ["2023-24"])
    _, projections, used = training.train_slots(spark, pairs, [("FWD", "goals_per_90", "next_goals_per_90", "goals_per_90")], learners=light)
    _, values, more = training.train_slots(spark, training.valuation_rows(f, ["2021-22", "2022-23", "2023-24"], ["2024-25"]), [("FWD", "value", "log_market_value", None)], learners=light)
    if ("FWD", "value", "ridge") not in values:
        raise ValueError("too few valued forwards to train on")
    chain = inference.predict_batch(f, {k[:2]: m for k, m in projections.items()}, {k[0]: m for k, m in values.items()}, used | more, "2023-24")
    came = f.filter("season = '2024-25'").select("player_id", F.col("log_market_value").alias("al"))
    return inference.with_interval(chain, inference.residual_quantiles(chain.join(came, "player_id"), F.col("al"), F.col("projected_log"))).drop("stage1_projections")


# -- exploration ---------------------------------------------------------------------------------------------------


_GAPS = ["xg", "fifa_rating", "contract_end_date", "market_value_eur", "goals", "club"]


@query(" union all ".join(f"select '{c}' as column_name, count(*) as n_rows, count(*) - count({_known(c) if c in NUMBERS else c}) as n_null, round((count(*) - count({_known(c) if c in NUMBERS else c})) / count(*), 6) as null_rate, '{explore.gap_cause(c)}' as cause from unified_panel" for c in _GAPS))
def gaps_with_cause(spark: SparkSession, d: str) -> DataFrame:
    """Null rates and why there are nulls."""
    return explore.gaps(table(spark, d, "unified_panel"), _GAPS).withColumn("null_rate", r("null_rate"))


@query(f"with {LATEST} select round(avg(case when league in ({_in(TOP)}) then (xg is null)::int::double end), 6) as xg_null_top, round(avg(case when season = '2024-25' then (fifa_rating is null)::int::double end), 6) as rating_null_last from p")
def gap_proofs(spark: SparkSession, d: str) -> DataFrame:
    """Shares that show where gaps come from."""
    s = explore.share_where(latest(spark, d), {"xg_null_top": (F.col("league").isin(TOP), F.col("xg").isNull()), "rating_null_last": (F.col("season") == "2024-25", F.col("fifa_rating").isNull())})
    return s.select(*[r(c).alias(c) for c in s.columns])


@query(f"with {LATEST}, o as (select * from (values ('2021-22', 0), ('2022-23', 1), ('2023-24', 2), ('2024-25', 3), ('2025-26', 4)) t(season, place)), m as (select season, median(market_value_eur) as median, avg(market_value_eur) as mean from p group by all) select season, place, round(median, 2) as median, round(mean, 2) as mean, round(median / nullif(lag(median) over (order by place), 0) - 1, 6) as change from o left join m using (season)")
def medians_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Medians in a stated order with their change, a row for each entry of the order."""
    m = explore.medians_in_order(latest(spark, d), "market_value_eur", "season", [*SEASON_ENDS, "2025-26"], change=True)
    return m.select("season", "place", r("median", 2).alias("median"), r("mean", 2).alias("mean"), r("change").alias("change"))


@query("with q as (select player_id, count(distinct primary_position) as k from unified_panel where player_id is not null group by all) select count(*) as n_entities, count(*) filter (where k > 1) as n_changers, round(count(*) filter (where k > 1) / count(*), 6) as share from q")
def position_changers(spark: SparkSession, d: str) -> DataFrame:
    """Players seen in several positions."""
    return explore.several_values(table(spark, d, "unified_panel"), "player_id", "primary_position").withColumn("share", r("share"))


@query(f"with {LATEST} select round(min(age_at_season_end), 6) as min_age, round(median(age_at_season_end), 6) as median_age, round(max(age_at_season_end), 6) as max_age, count(*) filter (where age_at_season_end < 15 or age_at_season_end > 43) as n_implausible from p")
def age_summary(spark: SparkSession, d: str) -> DataFrame:
    """Ages and how many are not plausible."""
    a = explore.age_summary(latest(spark, d), "age_at_season_end")
    return a.select(*[r(c).alias(c) for c in ("min_age", "median_age", "max_age")], "n_implausible")


@query()
def peak_ages(spark: SparkSession, d: str) -> DataFrame:
    """The age of highest value by position, by local regression (brute force in the tests)."""
    return explore.peak_ages(latest(spark, d), "age_at_season_end", "market_value_eur", "primary_position")


@query(f"with {LATEST}, x as (select xg_source as source, xg, goals from p where xg is not null and goals is not null union all select 'all', xg, goals from p where xg is not null and goals is not null) select source, count(*) as n, round(corr(xg, goals), 6) as pearson, round(avg(goals - xg), 6) as mean_difference from x group by source having count(*) >= 11 or source = 'all'")
def xg_calibration(spark: SparkSession, d: str) -> DataFrame:
    """How goals follow expected goals, by source."""
    return explore.source_agreement(latest(spark, d), "xg", "goals", "xg_source").select("source", "n", r("pearson").alias("pearson"), r("mean_difference").alias("mean_difference"))


@query(f"with {LATEST}, x as (select row_id, season, goals - xg as g from p where xg is not null and goals is not null) (select 'over' as side, row_id, season, round(g, 6) as difference from x order by g desc, row_id limit 5) union all (select 'under', row_id, season, round(g, 6) from x order by g, row_id limit 5)")
def over_and_under(spark: SparkSession, d: str) -> DataFrame:
    """The rows furthest over and under expectation."""
    return explore.extremes(latest(spark, d), "xg", "goals", "row_id", 5, ["season"]).select("side", "row_id", "season", r("difference").alias("difference"))


@query(f"with {LATEST} select count(*) filter (where minutes_played < 100 and market_value_eur > 10e6) as n_low_min_high_mv, max(minutes_played)::double as max_minutes, count(*) filter (where minutes_played > 3500) as n_over_minutes from p")
def outlier_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of odd rows."""
    return explore.outlier_counts(latest(spark, d), "minutes_played", "market_value_eur")


@query(f"with {LATEST}, h as (select * from p where regexp_matches(lower(player_name_fbref), 'an')), m as (select player_id from h where player_id is not null group by player_id order by count(*) desc, player_id limit 1), q as (select * from p join m using (player_id)) select player_id, arg_min(player_name_fbref, (season, league, player_name_fbref)) as name, cast(count(*) as int) as n_seasons, string_agg(season, ',' order by season, league, player_name_fbref) as seasons from q group by all")
def career_of_a_match(spark: SparkSession, d: str) -> DataFrame:
    """The career of the player with most rows whose name matches."""
    c = explore.career_of(latest(spark, d), "an", "player_name_fbref")
    return c.select("player_id", "name", F.size("seasons").alias("n_seasons"), F.array_join("seasons", ",").alias("seasons"))


@query(f"with {LATEST} select count(*) as n_rows, count(distinct player_id) as n_players, count(distinct league) as n_leagues, count(distinct season) as n_seasons from p")
def panel_headline(spark: SparkSession, d: str) -> DataFrame:
    """Rows, players, leagues and seasons."""
    return explore.headline(latest(spark, d)).drop("n_columns")


@query("with x as (select l_extendedprice as x, ln(1 + l_extendedprice) as y from lineitem), m as (select avg(x) as mx, stddev_pop(x) as sx, avg(y) as my, stddev_pop(y) as sy from x) select count(*) as n, round(median(x), 4) as median, round(avg(pow((x - mx) / sx, 3)), 5) as skew_raw, round(avg(pow((x - mx) / sx, 4)) - 3, 5) as kurtosis_raw, round(avg(pow((y - my) / sy, 3)), 5) as skew_log, round(avg(pow((y - my) / sy, 4)) - 3, 5) as kurtosis_log from x, m")
def value_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Shape of values and of their logs."""
    v = explore.value_distribution(table(spark, d, "lineitem"), "l_extendedprice")
    return v.select("n", r("median", 4).alias("median"), *[r(c, 5).alias(c) for c in ("skew_raw", "kurtosis_raw", "skew_log", "kurtosis_log")])


@query("select row_id, player_id, resolve_score from unified_panel where resolve_method = 'fuzzy' and resolve_score is not null order by resolve_score, row_id limit 30")
def lowest_fuzzy_scores(spark: SparkSession, d: str) -> DataFrame:
    """The thirty fuzzy matches of lowest score, to be looked at."""
    p = table(spark, d, "unified_panel").filter("resolve_method = 'fuzzy' and resolve_score is not null")
    return top_k(p.select("row_id", "player_id", "resolve_score"), F.col("resolve_score"), "row_id", 30)


@query(
    """with a as (select regexp_replace(lower(player_name_fbref), '[^a-z ]', ' ', 'g') as k, goals from unified_panel where season = '2022-23' and regexp_full_match(player_name_fbref, '[A-Za-z ]+')), b as (select regexp_replace(lower(player_name_fbref), '[^a-z ]', ' ', 'g') as k, goals from unified_panel where season = '2023-24' and regexp_full_match(player_name_fbref, '[A-Za-z ]+')),
    x as (select trim(k) as k, sum(coalesce(goals, 0))::double as g from a group by all), y as (select trim(k) as k, sum(coalesce(goals, 0))::double as g from b group by all)
    select 'goals' as stat, count(*) as n, round(corr(x.g, y.g), 6) as pearson, round(avg(abs(x.g - y.g)), 6) as mae, round(avg(x.g), 6) as mean_a, round(avg(y.g), 6) as mean_b from x join y using (k)"""
)
def cross_check_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Two sources matched by the plainer fold of names (plain names only, which SQL folds alike)."""
    p = table(spark, d, "unified_panel").filter(F.col("player_name_fbref").rlike("^[A-Za-z ]+$")).withColumn("k", X.fold_name_ascii(F.col("player_name_fbref")))
    out = joins.cross_check(p.filter("season = '2022-23'"), p.filter("season = '2023-24'"), "k", [], ["goals"])
    return out.select("stat", "n", *[r(c).alias(c) for c in ("pearson", "mae", "mean_a", "mean_b")])
