"""Queries of problem 3: column profiles by load and what went wrong in a load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators import quality as Q
from touchline.queries.reference import nudged, r
from touchline.sources.tables import table

#: Rules of the columns with findings. No file of one league and season has as many rows as ``high``.
COVERAGE_RULES = [Q.ColumnRule("row_count", low=0, high=20_000), Q.ColumnRule("file_exists", pattern="True|False")]
PANEL_RULES = [Q.ColumnRule("data_richness", pattern="[a-z]+(_[a-z]+)*")]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads whose row_count, file_exists or data_richness is plainly unlike the ordinary loads."""
    parts = [Q.value_counts(table(spark, sf_dir, name), name, "load_id", rules) for name, rules in (("fbref_coverage_summary", COVERAGE_RULES), ("unified_panel", PANEL_RULES))]
    return Q.findings(parts[0].unionByName(parts[1]), [*COVERAGE_RULES, *PANEL_RULES])


def p3_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of every column of both tables in each load."""
    out = None
    for name, own in (("fbref_coverage_summary", COVERAGE_RULES), ("unified_panel", PANEL_RULES)):
        df = table(spark, sf_dir, name)
        special = {rule.column: rule for rule in own}
        rules = [special.get(rule.column, rule) for rule in Q.default_rules(df.schema, exclude=["load_id"])]
        part = Q.profile(df, name, "load_id", rules)
        out = part if out is None else out.unionByName(part)
    keep = ["table_name", "load_id", "column_name", "n", "nulls", "pattern_violations", "range_violations", "distinct_values"]
    return out.select(*keep, r("null_rate").alias("null_rate"), r("low", 4).alias("low"), r("high", 4).alias("high"), r("mean", 4).alias("mean"), r("stddev", 4).alias("stddev"))


#: Columns of the two tables, numbers apart, that the SQL of the profile is written from.
_NUMBERS = {
    "fbref_coverage_summary": ["row_count"],
    "unified_panel": ["row_id", "born", "age_at_season_end", "minutes_played", "goals", "assists", "shots", "xg", "market_value_eur", "contract_remaining_months", "fifa_rating", "resolve_score"],
}
_OTHERS = {
    "fbref_coverage_summary": ["loaded_at", "source", "league", "season", "stat_type", "file_exists"],
    "unified_panel": [
        "player_id", "player_name_fbref", "nation", "season", "season_end_date", "league", "club", "primary_position", "detailed_position", "age_precision", "is_split_season", "xg_source",
        "contract_end_date", "has_contract_date", "resolve_method", "data_richness", "record_source", "loaded_at",
    ],
}


def _profile_sql() -> str:
    parts, rules = [], {rule.column: rule for rule in (*COVERAGE_RULES, *PANEL_RULES)}
    for name in _NUMBERS:
        for c in _NUMBERS[name]:
            x = f"case when not isnan({c}::double) then {c}::double end"
            rule = rules.get(c)
            bad = f"coalesce({x} < {rule.low} or {x} > {rule.high}, false)" if rule else "false"
            ok = f"case when not {bad} then {x} end"
            parts.append(
                f"select '{name}' as table_name, load_id, '{c}' as column_name, count(*) as n, count(*) - count({x}) as nulls, 0 as pattern_violations, count(*) filter (where {bad}) as range_violations, count(distinct {ok}) as distinct_values, "
                f"round((count(*) - count({x})) / count(*), 6) as null_rate, round(min({x}), 4) as low, round(max({x}), 4) as high, round(avg({ok}), 4) as mean, round(stddev_pop({ok}), 4) as stddev from {name} group by load_id"
            )
        for c in _OTHERS[name]:
            rule = rules.get(c)
            bad = f"coalesce(not regexp_full_match({c}, '{rule.pattern}'), false)" if rule else "false"
            parts.append(
                f"select '{name}', load_id, '{c}', count(*), count(*) - count({c}), count(*) filter (where {bad}), 0, count(distinct case when not {bad} then {c} end), round((count(*) - count({c})) / count(*), 6), null, null, null, null from {name} group by load_id"
            )
    return nudged(" union all ".join(parts))


QUERIES = {"p3_found": p3_found, "p3_profile": p3_profile}
SQL: dict[str, str] = {"p3_profile": _profile_sql()}
