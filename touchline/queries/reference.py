"""Queries of the panel operators over the test tables, each beside the SQL that must give the same rows.

Roles: a customer is an entity, an order year a period, an order a part of it; tm_player_seasons and tm_valuations
are periods and snapshots. Floats are rounded alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions import scalars as X
from touchline.operators import joins, panel, resolve, stats, windows
from touchline.plans import features, models
from touchline.sources.tables import table
from touchline.sources.text_formats import html_table_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


#: Part of the last digit that values are moved by before rounding, on both sides: engines settle exact halves differently.
NUDGE = 0.0031


def nudged(sql: str) -> str:
    """``round(x, d)`` as ``round(x + NUDGE / 10^d, d)`` throughout."""
    out, i = [], 0
    while (j := sql.find("round(", i)) >= 0:
        depth, comma, k = 1, -1, j + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            comma = k if sql[k] == "," and depth == 1 else comma
            k += 1
        digits = int(sql[comma + 1 : k - 1])
        out.append(f"{sql[i:j]}round({nudged(sql[j + 6 : comma])} + {NUDGE / 10**digits:.6e}, {digits})")
        i = k
    return "".join(out) + sql[i:]


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with its SQL where there is one."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = nudged(sql)
        return f

    return register


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded as ``nudged`` SQL rounds."""
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(float(f"{NUDGE / 10**digits:.6e}")), digits)


def _customer_years(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").cast("long").alias("year"), "o_totalprice")
    per = o.groupBy("o_custkey", "year").agg(F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("total"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return per.join(c, per.o_custkey == c.c_custkey).drop("o_custkey").withColumn("avg_price", X.guarded_rate(F.col("total"), F.col("n_orders")))


CY = """cy as (select c_custkey, cast(year(o_orderdate) as bigint) as year, c_mktsegment as segment, count(*) as n_orders, sum(o_totalprice) as total,
  sum(o_totalprice) / count(*) as avg_price from orders join customer on o_custkey = c_custkey group by all)"""


@query(
    f"""with {CY}, z as (select *, case when count(avg_price) over g >= 15 then (avg_price - avg(avg_price) over g) / (stddev_samp(avg_price) over g + 1e-6) end as z,
  lag(avg_price) over w as lag1, lag(year) over w as py from cy window g as (partition by year, segment), w as (partition by c_custkey order by year)),
  b as (select *, sum(case when year - py = 1 then 0 else 1 end) over (partition by c_custkey order by year) as isl from z)
  select c_custkey, year, segment, cast(n_orders as bigint) as n_orders, round(avg_price, 2) as avg_price, round(z, 4) as avg_price_z, round(lag1, 2) as avg_price_lag1,
  round(avg_price - lag1, 2) as delta_avg_price, row_number() over (partition by c_custkey, isl order by year) as consecutive_years from b"""
)
def panel_rate_zscore_lag(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a customer-by-year panel: guarded rate, z-score by (year, segment), lag, delta, gap-aware streak."""
    df = windows.group_zscore(_customer_years(spark, d), "avg_price", ["year", "segment"], "avg_price_z")
    df = windows.streak(windows.lag_delta(df, "c_custkey", "year", ["avg_price"]), "c_custkey", "year", "consecutive_years")
    return df.select("c_custkey", "year", "segment", "n_orders", r("avg_price", 2).alias("avg_price"), r("avg_price_z", 4).alias("avg_price_z"), r("avg_price_lag1", 2).alias("avg_price_lag1"), r("delta_avg_price", 2).alias("delta_avg_price"), "consecutive_years")


@query("select l_orderkey, l_linenumber, round(case when l_quantity > 0 then l_extendedprice / l_quantity end, 6) as unit_price, round(case when l_quantity >= 25 then l_tax / l_quantity end, 9) as bulk_tax from lineitem")
def guarded_rate(spark: SparkSession, d: str) -> DataFrame:
    """Rates that are null where the divisor is not positive or under a threshold."""
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", r(X.guarded_rate(F.col("l_extendedprice"), F.col("l_quantity"))).alias("unit_price"), r(X.guarded_rate(F.col("l_tax"), F.col("l_quantity"), 25, inclusive=True), 9).alias("bulk_tax"))


@query(
    """select row_id, coalesce(xg0, rating0, 0) as best, round(((xg0 is not null)::int + (rating0 is not null)::int + (mv0 is not null)::int) / 3.0, 6) as completeness
    from (select row_id, case when not isnan(xg) then xg end as xg0, case when not isnan(fifa_rating) then fifa_rating end as rating0, case when not isnan(market_value_eur) then market_value_eur end as mv0 from unified_panel)"""
)
def composite_coalesce_completeness(spark: SparkSession, d: str) -> DataFrame:
    """NaN as null at ingest, coalesce with a default, and the share of known columns."""
    p = table(spark, d, "unified_panel")
    c = [X.clean_number(F.col(n)) for n in ("xg", "fifa_rating", "market_value_eur")]
    return p.select("row_id", F.coalesce(c[0], c[1], F.lit(0.0)).alias("best"), r(X.completeness(c)).alias("completeness"))


@query(
    """with p as (select o_custkey, cast(year(o_orderdate) as bigint) as year, o_orderkey, o_orderpriority, sum(l_quantity) as minutes, sum(l_extendedprice) as value, avg(l_discount) as disc, sum(l_extendedprice) / sum(l_quantity) as rate
      from orders join lineitem on o_orderkey = l_orderkey group by all)
    select o_custkey, year, round(sum(minutes), 2) as minutes, round(sum(value), 2) as value, round(sum(disc * minutes) / sum(minutes), 6) as disc,
      round(case when count(*) = 1 then max(rate) else sum(value) / sum(minutes) end, 4) as rate, arg_max(o_orderpriority, (minutes, -o_orderkey)) as o_orderpriority, count(*) as n_parts, count(*) > 1 as is_split from p group by all"""
)
def split_stint_collapse(spark: SparkSession, d: str) -> DataFrame:
    """Parts of a period as one row: sums, weighted means, recomputed rates, context of the largest part."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("minutes"), F.sum("l_extendedprice").alias("value"), F.avg("l_discount").alias("disc"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").cast("long").alias("year"), "o_orderpriority")
    parts = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("rate", F.col("value") / F.col("minutes"))
    out = panel.collapse_parts(parts, ["o_custkey", "year"], "minutes", [-F.col("o_orderkey")], ["value"], ["disc"], {"rate": ("value", "minutes")}, ["o_orderpriority"])
    return out.select("o_custkey", "year", r("minutes", 2).alias("minutes"), r("value", 2).alias("value"), r("disc").alias("disc"), r("rate", 4).alias("rate"), "o_orderpriority", "n_parts", "is_split")


@query(
    """select league, season, round(sum(case when m then shots * minutes_played end) / sum(case when m then minutes_played end), 6) as shots_weighted, count(*) as n
    from (select *, minutes_played is not null and shots is not null and minutes_played between 1 and 3800 as m from unified_panel) group by all"""
)
def weighted_avg_null_safe(spark: SparkSession, d: str) -> DataFrame:
    """Weighted means over rows where value and weight are known."""
    p = table(spark, d, "unified_panel")
    w = F.when(F.col("minutes_played").between(1, 3800), F.col("minutes_played"))
    return p.groupBy("league", "season").agg(r(panel.weighted_mean(F.col("shots"), w)).alias("shots_weighted"), F.count(F.lit(1)).alias("n"))


@query(
    """with q as (select p_partkey, p_brand, p_size, p_retailprice from part)
    select p_partkey, round(case when count(p_retailprice) over b >= 15 then (p_retailprice - avg(p_retailprice) over b) / (stddev_samp(p_retailprice) over b + 1e-6) end, 5) as z_brand,
    round(case when count(p_retailprice) over c >= 15 then (p_retailprice - avg(p_retailprice) over c) / (stddev_samp(p_retailprice) over c + 1e-6) end, 5) as z_brand_size
    from q window b as (partition by p_brand), c as (partition by p_brand, p_size)"""
)
def zscore_two_groupings(spark: SparkSession, d: str) -> DataFrame:
    """Z-scores within two groupings, null in thin groups."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    df = windows.group_zscore(windows.group_zscore(p, "p_retailprice", ["p_brand"], "z_brand"), "p_retailprice", ["p_brand", "p_size"], "z_brand_size")
    return df.select("p_partkey", r("z_brand", 5).alias("z_brand"), r("z_brand_size", 5).alias("z_brand_size"))


@query(f"with {CY} select c_custkey, year, lag(n_orders) over w as n_orders_lag1, n_orders - lag(n_orders) over w as delta_n_orders, row_number() over w > 1 as has_lag1 from cy window w as (partition by c_custkey order by year)")
def lag_delta(spark: SparkSession, d: str) -> DataFrame:
    """Previous row and difference by entity."""
    return windows.lag_delta(_customer_years(spark, d), "c_custkey", "year", ["n_orders"]).select("c_custkey", "year", "n_orders_lag1", "delta_n_orders", "has_lag1")


@query(f"with {CY}, a as (select *, case when year - lag(year) over (partition by c_custkey order by year) = 1 then 0 else 1 end as br from cy), b as (select *, sum(br) over (partition by c_custkey order by year) as isl from a) select c_custkey, year, row_number() over (partition by c_custkey, isl order by year) as consecutive from b")
def gap_aware_streak(spark: SparkSession, d: str) -> DataFrame:
    """Runs of years without a gap."""
    return windows.streak(_customer_years(spark, d), "c_custkey", "year").select("c_custkey", "year", "consecutive")


@query(f"with {CY}, n as (select *, lead(year) over w as ny, lead(n_orders) over w as nn, lead(total) over w as nt from cy window w as (partition by c_custkey order by year)) select c_custkey, year, n_orders, round(nt, 2) as next_total from n where ny = year + 1 and n_orders >= 2 and nn >= 2")
def pair_builder_lead_consecutive(spark: SparkSession, d: str) -> DataFrame:
    """Training pairs of consecutive, valid periods."""
    df = windows.consecutive_pairs(_customer_years(spark, d), "c_custkey", "year", ["total"], F.col("n_orders") >= 2)
    return df.select("c_custkey", "year", "n_orders", r("next_total", 2).alias("next_total"))


@query(
    """with c as (select s.player_season_id, v.valuation_id, abs(date_diff('day', cast(s.season_end_date as date), cast(v.snapshot_date as date))) as days_apart, cast(v.snapshot_date as date) as sd
      from tm_player_seasons s join tm_valuations v using (tm_player_id) where days_apart <= 45)
    select player_season_id, valuation_id, cast(days_apart as bigint) as days_apart from (select *, row_number() over (partition by player_season_id order by days_apart, sd, valuation_id) as n from c) where n = 1"""
)
def asof_nearest_tolerance(spark: SparkSession, d: str) -> DataFrame:
    """The snapshot nearest to each period's end, in whole days, within 45."""
    s = table(spark, d, "tm_player_seasons").withColumn("season_end_date", F.col("season_end_date").cast("date"))
    v = table(spark, d, "tm_valuations").withColumn("snapshot_date", F.col("snapshot_date").cast("date"))
    return joins.asof_nearest(s, v, "tm_player_id", "player_season_id", "season_end_date", "valuation_id", "snapshot_date", 45)


@query(
    """with c as (select t.fee_id, p.row_id, abs(t.player_age - p.age_at_season_end) as d from transfer_fees_2024_25 t join unified_panel p on t.player_name = p.player_name_fbref and p.season = '2023-24' where not isnan(p.age_at_season_end) and d <= 3)
    select fee_id, row_id, round(d, 6) as distance from (select *, row_number() over (partition by fee_id order by d, row_id) as n from c) where n = 1"""
)
def nearest_in_group_tolerance(spark: SparkSession, d: str) -> DataFrame:
    """Transfers to the row of the same name with the nearest age, at most 3 years off."""
    t = table(spark, d, "transfer_fees_2024_25").select("fee_id", F.col("player_name").alias("name"), F.col("player_age").cast("double").alias("player_age"))
    p = table(spark, d, "unified_panel").filter("season = '2023-24' and not isnan(age_at_season_end)").select("row_id", F.col("player_name_fbref").alias("name"), "age_at_season_end")
    return joins.nearest_in_group(t, p, "name", "fee_id", "player_age", "row_id", "age_at_season_end", 3.0).withColumn("distance", r("distance"))


@query(
    """select o_orderkey, o_custkey, c_name, n_name, r_name from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey"""
)
def left_join_chain(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their dimensions; Spark broadcasts those its size estimates allow."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    g = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return joins.left_join_nullsafe(joins.left_join_nullsafe(joins.left_join_nullsafe(o, c, ["o_custkey"]), n, ["c_nationkey"]), g, ["n_regionkey"]).select("o_orderkey", "o_custkey", "c_name", "n_name", "r_name")


@query(
    """with k as (select nation, season, row_id from unified_panel), a as (select nation, season, count(*) as n_rows from k group by all), b as (select nation, season, min(row_id) as first_row from k group by all), c as (select nation, season, max(row_id) as last_row from k group by all)
    select a.nation, a.season, a.n_rows, b.first_row, c.last_row from a left join b on a.nation is not distinct from b.nation and a.season is not distinct from b.season left join c on a.nation is not distinct from c.nation and a.season is not distinct from c.season"""
)
def nullsafe_key_join(spark: SparkSession, d: str) -> DataFrame:
    """Many left joins on one composite key in which null matches null."""
    p, keys = table(spark, d, "unified_panel"), ["nation", "season"]
    tables = [p.groupBy(*keys).agg(a) for a in (F.count(F.lit(1)).alias("n_rows"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"))]
    return joins.left_join_many(tables[0], tables[1:], keys)


@query("select count(*) as n_rows, count(*) filter (where tm_player_id is null or tm_player_id not in (select tm_player_id from tm_players)) as n_orphans, round(count(*) filter (where tm_player_id is null or tm_player_id not in (select tm_player_id from tm_players)) / count(*), 6) as orphan_rate from tm_valuations")
def orphan_rate(spark: SparkSession, d: str) -> DataFrame:
    """Valuations without a master row."""
    return joins.orphan_rate(table(spark, d, "tm_valuations"), table(spark, d, "tm_players"), "tm_player_id").withColumn("orphan_rate", r("orphan_rate"))


@query(
    """with a as (select distinct player_name as n from transfer_fees_2024_25 where player_name is not null), b as (select distinct player_name_fbref as n from unified_panel where player_name_fbref is not null)
    select (select count(*) from (select n from a intersect select n from b)) as in_both, (select count(*) from (select n from a except select n from b)) as only_a, (select count(*) from (select n from b except select n from a)) as only_b"""
)
def set_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Names two sources share and do not."""
    return joins.set_overlap(table(spark, d, "transfer_fees_2024_25").select(F.col("player_name").alias("n")), table(spark, d, "unified_panel").select(F.col("player_name_fbref").alias("n")), "n")


@query(
    """with t as (select player_id, player_name_fbref, coalesce(sum(minutes_played), 0) as w from unified_panel where player_name_fbref is not null group by all),
    k as (select player_id, player_name_fbref as keep from (select *, row_number() over (partition by player_id order by w desc, player_name_fbref) as n from t) where n = 1)
    select p.row_id, case when p.player_name_fbref = k.keep then p.player_id else 'synthetic_' || substr(sha256(coalesce(p.player_name_fbref, '') || '|' || coalesce(cast(p.born as varchar), '') || '|' || coalesce(p.nation, '')), 1, 12) end as player_id
    from unified_panel p left join k using (player_id)"""
)
def id_collision_guard(spark: SparkSession, d: str) -> DataFrame:
    """Ids that go by several names: the name with most minutes keeps the id."""
    p = table(spark, d, "unified_panel").select("row_id", "player_id", "player_name_fbref", "minutes_played", "born", "nation")
    return panel.split_shared_ids(p, "player_id", "player_name_fbref", "minutes_played", X.synthetic_id(F.col("player_name_fbref"), F.col("born"), F.col("nation"))).select("row_id", "player_id")


@query(
    """select row_id, case when s > 3800 and n > 1 then 'synthetic_' || substr(sha256(player_id || '|' || coalesce(club, '')), 1, 12) else player_id end as player_id from
    (select *, sum(minutes_played) over (partition by player_id, season) as s, row_number() over (partition by player_id, season order by minutes_played desc nulls last, row_id) as n from unified_panel)"""
)
def overflow_guard(spark: SparkSession, d: str) -> DataFrame:
    """Seasons with more minutes than there are: the largest part keeps the id."""
    p = table(spark, d, "unified_panel").select("row_id", "player_id", "season", "minutes_played", "club")
    return panel.split_overflow(p, "player_id", "season", "minutes_played", 3800, [F.col("row_id")], X.synthetic_id(F.col("player_id"), F.col("club"))).select("row_id", "player_id")


@query("select c_custkey, 'synthetic_' || substr(sha256(c_name || '|' || cast(c_nationkey as varchar)), 1, 12) as synthetic_id from customer")
def synthetic_id_sha256(spark: SparkSession, d: str) -> DataFrame:
    """Stable ids from a hash of a composite key."""
    return table(spark, d, "customer").select("c_custkey", X.synthetic_id(F.col("c_name"), F.col("c_nationkey")).alias("synthetic_id"))


@query("select row_id, coalesce(country, 'unknown') as country from unified_panel left join nationality_map on nation = code")
def dict_map_default(spark: SparkSession, d: str) -> DataFrame:
    """Lookup in a small table with a default."""
    m = table(spark, d, "nationality_map")
    return table(spark, d, "unified_panel").join(m, F.col("nation") == F.col("code"), "left").select("row_id", F.coalesce("country", F.lit("unknown")).alias("country"))


@query(
    """select row_id, coalesce(a, b) as value, case when a is not null then 'rating' when b is not null then 'contract' else 'none' end as value_source from
    (select row_id, case when not isnan(fifa_rating) then fifa_rating end as a, case when not isnan(contract_remaining_months) then contract_remaining_months end as b from unified_panel)"""
)
def source_priority_label(spark: SparkSession, d: str) -> DataFrame:
    """The first known of several sources, and which it was."""
    v, s = X.first_source([("rating", X.clean_number(F.col("fifa_rating"))), ("contract", X.clean_number(F.col("contract_remaining_months")))])
    return table(spark, d, "unified_panel").select("row_id", v.alias("value"), s.alias("value_source"))


@query(
    """select row_id, round(a * a, 4) as age_squared, round(abs(a - case primary_position when 'GK' then 30 when 'DEF' then 26 when 'MID' then 25 when 'FWD' then 26 end), 4) as distance_from_peak,
    coalesce(a < 24, false) as is_young, coalesce(a between 24 and 29, false) as is_peak, coalesce(a > 29, false) as is_declining from (select *, case when not isnan(age_at_season_end) then age_at_season_end end as a from unified_panel)"""
)
def age_bands_peak_distance(spark: SparkSession, d: str) -> DataFrame:
    """Age curve features."""
    p = table(spark, d, "unified_panel").withColumn("age_at_season_end", X.clean_number(F.col("age_at_season_end")))
    return features.age_curve(p).select("row_id", r("age_squared", 4).alias("age_squared"), r("distance_from_peak", 4).alias("distance_from_peak"), "is_young", "is_peak", "is_declining")


@query(
    """select row_id, round(greatest(date_diff('day', cast(season_end_date as date), cast(contract_end_date as date)) / 30.44, 0), 6) as months, coalesce(months <= 6, false) as is_expiring, coalesce(months > 36, false) as is_long_contract
    from unified_panel where contract_end_date is not null union all select row_id, null, false, false from unified_panel where contract_end_date is null"""
)
def contract_months_clip(spark: SparkSession, d: str) -> DataFrame:
    """Months to a contract's end, not under 0, and flags."""
    p = table(spark, d, "unified_panel").withColumn("months", X.months_until(F.col("contract_end_date"), F.col("season_end_date")))
    return features.contract(p, "months").select("row_id", r("months").alias("months"), "is_expiring", "is_long_contract")


@query("select c_custkey, " + ", ".join(f"coalesce(c_mktsegment = '{v}', false) as is_{v.lower()}" for v in ("AUTOMOBILE", "BUILDING", "MACHINERY")) + " from customer")
def onehot_flags(spark: SparkSession, d: str) -> DataFrame:
    """A flag for each category."""
    c = features.one_hot(table(spark, d, "customer"), "c_mktsegment", ["AUTOMOBILE", "BUILDING", "MACHINERY"])
    return c.select("c_custkey", *[F.col(f"is_{v}").alias(f"is_{v.lower()}") for v in ("AUTOMOBILE", "BUILDING", "MACHINERY")])


@query(
    """select o_orderkey, round(case when y > 1995 then 1.254 * pow(1.15, y - 1995) when y = 1995 then 1.254 when y = 1994 then 1.1 when y = 1993 then 1.0 end, 6) as inflation,
    cast(y as varchar) || '-' || lpad(cast((y + 1) % 100 as varchar), 2, '0') as period, cast(y + 1 as varchar) || '-' || lpad(cast((y + 2) % 100 as varchar), 2, '0') as next_period from (select o_orderkey, year(o_orderdate) as y from orders)"""
)
def inflation_and_next_period(spark: SparkSession, d: str) -> DataFrame:
    """Index by year, grown beyond its table, and the label of the next period."""
    y = F.year("o_orderdate")
    period = F.concat(y.cast("string"), F.lit("-"), F.lpad(((y + 1) % 100).cast("string"), 2, "0"))
    o = table(spark, d, "orders").select("o_orderkey", r(X.extrapolated(y, {1993: 1.0, 1994: 1.1, 1995: 1.254})).alias("inflation"), period.alias("period"))
    return o.withColumn("next_period", X.next_period(F.col("period")))


@query(
    """with w as (select season, avg(case when xg is not null and not isnan(xg) then 1.0 else 0 end) as xg, avg(case when fifa_rating is not null and not isnan(fifa_rating) then 1.0 else 0 end) as fifa_rating, avg(case when contract_end_date is not null then 1.0 else 0 end) as contract_end_date from unified_panel group by all)
    select season, source, round(coverage, 6) as coverage from w unpivot (coverage for source in (xg, fifa_rating, contract_end_date))"""
)
def coverage_matrix_unpivot(spark: SparkSession, d: str) -> DataFrame:
    """Share of known values by period and source."""
    p = table(spark, d, "unified_panel").select("season", X.clean_number(F.col("xg")).alias("xg"), X.clean_number(F.col("fifa_rating")).alias("fifa_rating"), "contract_end_date")
    return stats.coverage_matrix(p, "season", ["xg", "fifa_rating", "contract_end_date"]).withColumn("coverage", r("coverage"))


_NR = ["born", "nation", "club", "minutes_played", "data_richness", "record_source"]


@query(" union all ".join(f"select '{c}' as column_name, count(*) as n_rows, count(*) - count({c}) as n_null, round((count(*) - count({c})) / count(*), 6) as null_rate from unified_panel" for c in _NR))
def null_rate_by_column(spark: SparkSession, d: str) -> DataFrame:
    """Null rates of all columns in one pass."""
    return stats.null_rates(table(spark, d, "unified_panel"), _NR).withColumn("null_rate", r("null_rate"))


@query("select league, " + ", ".join(f"count(*) filter (where primary_position = '{v}') as {v}" for v in features.POSITIONS) + " from unified_panel group by league")
def pivot_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of league by position."""
    return stats.pivot_counts(table(spark, d, "unified_panel"), "league", "primary_position", features.POSITIONS)


@query(
    """with m as (select count(l_extendedprice) as n, avg(l_extendedprice) as mean, stddev_samp(l_extendedprice) as std, stddev_pop(l_extendedprice) as sp from lineitem)
    select any_value(n) as n, round(any_value(mean), 4) as mean, round(any_value(std), 4) as std, round(avg(pow((l_extendedprice - mean) / sp, 3)), 5) as skew, round(avg(pow((l_extendedprice - mean) / sp, 4)) - 3, 5) as kurt from lineitem, m"""
)
def skew_kurtosis(spark: SparkSession, d: str) -> DataFrame:
    """Moments of a column, population skewness and excess kurtosis."""
    return stats.moments(table(spark, d, "lineitem"), "l_extendedprice").select("n", *[r(c, k).alias(c) for c, k in (("mean", 4), ("std", 4), ("skew", 5), ("kurt", 5))])


@query("select l_returnflag, count(*) as n, round(corr(l_quantity, l_extendedprice), 6) as pearson from lineitem group by all")
def correlation(spark: SparkSession, d: str) -> DataFrame:
    """Pearson correlation by group."""
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), r(stats.pearson("l_quantity", "l_extendedprice")).alias("pearson"))


def _residuals(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice", (F.col("l_quantity") * 1500).alias("predicted"))
    return li.withColumn("residual", F.col("l_extendedprice") - F.col("predicted"))


@query("select l_returnflag, count(*) as n, " + ", ".join(f"round(quantile_cont(l_extendedprice - l_quantity * 1500, {p}), 4) as q{int(p * 100):02d}" for p in (0.05, 0.25, 0.5, 0.75, 0.95)) + " from lineitem group by all")
def residual_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact interpolated residual quantiles by group."""
    q = stats.quantile_table(_residuals(spark, d), "residual", ["l_returnflag"], [0.05, 0.25, 0.5, 0.75, 0.95])
    return q.select("l_returnflag", "n", *[r(c, 4).alias(c) for c in ("q05", "q25", "q50", "q75", "q95")])


@query(
    """with x as (select l_returnflag, l_extendedprice as y, l_quantity * 1500 as p from lineitem), q as (select l_returnflag, quantile_cont(y - p, 0.05) as lo, quantile_cont(y - p, 0.95) as hi from x group by all)
    select l_returnflag, count(*) as n, round(avg(case when y between p + lo and p + hi then 1.0 else 0 end), 3) as coverage from x join q using (l_returnflag) group by all"""
)
def interval_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Share of values inside the 90 % residual interval of their group."""
    x = _residuals(spark, d)
    s = models.with_residual_interval(x, x, "l_extendedprice", "predicted", ["l_returnflag"])
    return stats.interval_coverage(s, F.col("l_extendedprice"), F.col("ci_low"), F.col("ci_high"), ["l_returnflag"]).withColumn("coverage", r("coverage", 3))


@query(
    """select l_returnflag, count(*) as n, round(avg(abs(y - p)), 3) as mae, round(sqrt(avg((y - p) * (y - p))), 3) as rmse, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) as r2, round(avg(case when abs(y) > 0.1 then abs((y - p) / y) end), 6) as mape
    from (select l_returnflag, l_extendedprice as y, l_quantity * 1500 as p from lineitem) group by all"""
)
def regression_metrics(spark: SparkSession, d: str) -> DataFrame:
    """MAE, RMSE, R2 and masked MAPE by group."""
    m = stats.regression_metrics(_residuals(spark, d), F.col("l_extendedprice"), F.col("predicted"), ["l_returnflag"])
    return m.select("l_returnflag", "n", r("mae", 3).alias("mae"), r("rmse", 3).alias("rmse"), r("r2").alias("r2"), r("mape").alias("mape"))


@query(
    """select count(*) as n, round(avg(abs(y - p)), 3) as mae, round(1 - sum(pow(ln(1 + y) - ln(1 + p), 2)) / (var_pop(ln(1 + y)) * count(*)), 6) as r2_log, round(median(p / y), 6) as median_ratio, round(avg(case when abs(p / y - 1) <= 0.3 then 1.0 else 0 end), 6) as share_within
    from (select l_extendedprice as y, l_quantity * 1500 as p from lineitem) where y > 0 and p > 0"""
)
def scenario_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of a scenario on positive pairs."""
    m = stats.scenario_metrics(_residuals(spark, d), F.col("l_extendedprice"), F.col("predicted"))
    return m.select("n", r("mae", 3).alias("mae"), *[r(c).alias(c) for c in ("r2_log", "median_ratio", "share_within")])


@query("with m as (select cast(year(o_orderdate) as bigint) as year, median(o_totalprice) as med from orders group by all) select year, round(med, 2) as median_price, round(med / lag(med) over (order by year) - 1, 6) as change from m")
def pct_change_ordered_median(spark: SparkSession, d: str) -> DataFrame:
    """Medians by period and their relative change."""
    m = table(spark, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.median("o_totalprice").alias("median_price"))
    return windows.pct_change(m, "year", "median_price", "change").select("year", r("median_price", 2).alias("median_price"), r("change").alias("change"))


@query("(select 'top' as side, o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25) union all (select 'bottom', o_orderkey, o_totalprice from orders order by o_totalprice, o_orderkey limit 25)")
def topk_bottomk(spark: SparkSession, d: str) -> DataFrame:
    """The highest and lowest orders, ties by key."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    top, bottom = windows.top_k(o, F.col("o_totalprice").desc(), "o_orderkey", 25), windows.top_k(o, F.col("o_totalprice"), "o_orderkey", 25)
    return top.withColumn("side", F.lit("top")).unionByName(bottom.withColumn("side", F.lit("bottom"))).select("side", "o_orderkey", "o_totalprice")


@query("select * from (select c_mktsegment, c_custkey, c_acctbal, row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) as rank from customer) where rank <= 10")
def best_per_group(spark: SparkSession, d: str) -> DataFrame:
    """The ten best rows of each group."""
    c = table(spark, d, "customer").select("c_mktsegment", "c_custkey", "c_acctbal")
    return windows.top_k_per_group(c, ["c_mktsegment"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 10)


@query("with n as (select o_custkey as c_custkey, o_orderpriority, count(*) as n_rows from orders group by all) select c_custkey, o_orderpriority, n_rows from (select *, row_number() over (partition by c_custkey order by n_rows desc, o_orderpriority) as k from n) where k = 1")
def dominant_value(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent value of each entity."""
    return windows.dominant_value(table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "o_orderpriority")


@query("select 'customer' as kind, c_custkey as id, c_name as name, c_acctbal as acctbal, c_mktsegment as segment from customer union all select 'supplier', s_suppkey, s_name, s_acctbal, null from supplier")
def union_missing_columns(spark: SparkSession, d: str) -> DataFrame:
    """Two tables as one, the columns one lacks being null."""
    c = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"))
    return c.unionByName(s, allowMissingColumns=True)


@query("select player_id, season, row_id, club from (select *, row_number() over (partition by player_id, season order by loaded_at desc, row_id) as n from unified_panel) where n = 1")
def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    """One row for each key: the latest, ties by id."""
    return joins.keep_first(table(spark, d, "unified_panel"), ["player_id", "season"], [F.col("loaded_at").desc(), F.col("row_id")]).select("player_id", "season", "row_id", "club")


@query(
    """select player_id, cast(substr(season, 1, 4)::int + 1 as varchar) || '-' || lpad(cast((substr(season, 1, 4)::int + 2) % 100 as varchar), 2, '0') as season, row_id, round(age_at_season_end + 1, 4) as age_at_season_end, coalesce(age_at_season_end + 1 between 24 and 29, false) as is_peak,
    round(case when m is not null then greatest(m - 12, 0) end, 4) as contract_remaining_months, coalesce(greatest(m - 12, 0) <= 6, false) and m is not null as is_expiring
    from (select *, case when not isnan(contract_remaining_months) then contract_remaining_months end as m, row_number() over (partition by player_id, season order by loaded_at desc, row_id) as n from unified_panel) where n = 1"""
)
def forward_features(spark: SparkSession, d: str) -> DataFrame:
    """The panel rolled one season on."""
    p = joins.keep_first(table(spark, d, "unified_panel"), ["player_id", "season"], [F.col("loaded_at").desc(), F.col("row_id")])
    p = p.withColumn("contract_remaining_months", X.clean_number(F.col("contract_remaining_months"))).select("player_id", "season", "row_id", "age_at_season_end", "primary_position", "contract_remaining_months")
    f = features.forward(features.contract(features.age_curve(p)), {})
    return f.select("player_id", "season", "row_id", r("age_at_season_end", 4).alias("age_at_season_end"), "is_peak", r("contract_remaining_months", 4).alias("contract_remaining_months"), "is_expiring")


@query("select record_source, resolve_method, count(*) as n, round(avg(case when resolve_method <> 'synthetic' then 1.0 else 0 end), 6) as resolved_rate from unified_panel group by all")
def resolution_rates(spark: SparkSession, d: str) -> DataFrame:
    """How records of each source were resolved."""
    return table(spark, d, "unified_panel").groupBy("record_source", "resolve_method").agg(F.count(F.lit(1)).alias("n"), r(F.avg((F.col("resolve_method") != "synthetic").cast("double"))).alias("resolved_rate"))


@query()
def resolve_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Panel names against the player master by the cascade of tiers (fixtures in the tests)."""
    nations = table(spark, d, "nationality_map").select("code", X.folded(F.col("country")).alias("land"))
    m = table(spark, d, "tm_players").withColumn("land", X.folded(F.col("country_of_citizenship"))).join(nations, "land", "left")
    master = m.select(F.col("tm_player_id").alias("id"), F.col("player_name").alias("name"), X.year_of(F.col("date_of_birth")).alias("year"), F.col("code").alias("nation"), F.col("current_club_name").alias("team"))
    rows = table(spark, d, "unified_panel").select("row_id", F.col("player_name_fbref").alias("name"), F.col("born").alias("year"), "nation", F.col("club").alias("team"), F.col("record_source").alias("source"))
    return resolve.resolve(rows, master)


@query()
def html_table_rows_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Rows of HTML tables, over pages made from the clubs (no page table is given)."""
    c = table(spark, d, "tm_clubs")
    page = F.concat(F.lit("<h2>"), F.col("league"), F.lit("</h2><table><tr><th>Club</th><th>Id</th></tr><tr><td>"), F.col("club_name"), F.lit("</td><td>"), F.col("domestic_competition_id"), F.lit("</td></tr></table>"))
    return html_table_rows(c.select("club_id", page.alias("html")), "club_id", "html")


def _fit_frame(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = joins.keep_first(table(spark, d, "unified_panel"), ["player_id", "season"], [F.col("loaded_at").desc(), F.col("row_id")])
    p = p.select("player_id", "season", X.clean_number(F.col("fifa_rating")).alias("fifa_rating"), F.col("age_at_season_end").alias("age"), "goals", "assists", "shots", F.log1p(X.clean_number(F.col("market_value_eur"))).alias("label")).filter("label is not null")
    f = ["fifa_rating", "age", "goals", "assists", "shots"]
    train, valid = models.fill_medians(p.filter("season < '2024-25'"), [p.filter("season = '2024-25'")], f)
    return train, valid


_F = ["fifa_rating", "age", "goals", "assists", "shots"]


@query()
def ridge_fit_score(spark: SparkSession, d: str) -> DataFrame:
    """Ridge with its penalty chosen over hash folds, scored on the last season."""
    train, valid = _fit_frame(spark, d)
    alpha, model = models.grid_ridge(train, _F, "label", "player_id")
    return stats.regression_metrics(model.transform(valid), F.col("label"), F.col("prediction")).withColumn("alpha", F.lit(alpha))


@query()
def gbt_fit_score(spark: SparkSession, d: str) -> DataFrame:
    """Boosted trees scored on the last season."""
    train, valid = _fit_frame(spark, d)
    return stats.regression_metrics(models.boosted(_F, "label").fit(train).transform(valid), F.col("label"), F.col("prediction"))


@query()
def stacked_fit_score(spark: SparkSession, d: str) -> DataFrame:
    """Ridge and trees stacked over out-of-fold predictions."""
    train, valid = _fit_frame(spark, d)
    return stats.regression_metrics(models.stacked(train, valid, _F, "label", "player_id"), F.col("label"), F.col("prediction"))


@query()
def feature_modules(spark: SparkSession, d: str) -> DataFrame:
    """The feature modules over one row for each player and season (README names what the panel has no input for)."""
    p = joins.keep_first(table(spark, d, "unified_panel"), ["player_id", "season"], [F.col("loaded_at").desc(), F.col("row_id")])
    numbers = {c: X.clean_number(F.col(c)) for c in ("xg", "fifa_rating", "contract_remaining_months", "age_at_season_end")}
    return features.build(p.withColumns(numbers | {"log_market_value": F.log1p(X.clean_number(F.col("market_value_eur")))}))
