"""Loaders, panel build, training, inference and exploration on small fixtures."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.functions import scalars as X
from touchline.operators import joins, resolve, stats
from touchline.plans import explore, inference, panel_build, training
from touchline.sources import loaders, text_formats as TF


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


# -- loaders -----------------------------------------------------------------------------------------------------


def test_parts_of_a_tree(spark, tmp_path):
    one = spark.createDataFrame([("Ann", "Red", 3)], "player string, team string, goals int")
    one.write.parquet(f"{tmp_path}/süper_lig".replace("ü", "u") + "/2122/standard.parquet")
    one.withColumn("assists", F.lit(2)).write.parquet(f"{tmp_path}/la_liga/2223/standard.parquet")
    df = loaders.read_parts(spark, str(tmp_path), ["Süper Lig", "La Liga"], ["2122", "2223"], "standard", {"2122": "2021-22", "2223": "2022-23"})
    assert rows(df, "league", "season", "goals", "assists") == [("La Liga", "2022-23", 3, 2), ("Süper Lig", "2021-22", 3, None)]
    status = {(r["league"], r["part"]): r["status"] for r in loaders.missing_parts(spark, str(tmp_path), ["La Liga"], ["2122/standard", "2223/standard"]).collect()}
    assert status == {("La Liga", "2122/standard"): "to_do", ("La Liga", "2223/standard"): "skipped"}
    assert loaders.read_parts(spark, str(tmp_path), ["Nowhere"], ["2122"], schema="player string, xg double").columns == ["player", "xg"]
    with pytest.raises(FileNotFoundError):
        loaders.read_parts(spark, str(tmp_path), ["Nowhere"], ["2122"], "standard")
    assert loaders.footer_rows(spark, [f"{tmp_path}/la_liga/2223/standard.parquet"]).agg(F.sum("n_rows")).first()[0] == 1 and loaders.footer_rows(spark, []).count() == 0


def test_wide_stats(spark):
    cols = "Rk string, Player string, Nation string, Pos string, Comp string, Born string, Age string, Min string, Gls string, Gls_stats_shooting string, `SoT%_stats_shooting` string, Cmp_stats_passing_types string"
    df = spark.createDataFrame([("1", "Ann", "eng ENG", "FW,MF", "eng Premier League", "1999.0", "x", "900", "3", "3", "40", "7"), ("2", "Ann", "eng ENG", "FW", "zz Other", "1999", "25", "10", "0", "0", None, None), ("3", "Bo", "it ITA", "GK", "zz Other", None, "30", None, "1", "1", "1", "1")], cols)
    names = {"Player": "player_name", "Nation": "nationality_raw", "Pos": "position_raw", "Comp": "league_raw", "Born": "birth_year", "Age": "age", "Min": "minutes_played", "Gls": "goals"}
    out = loaders.load_wide_stats(df, names, {"eng Premier League": "Premier League"}, "2024-25", panel_build.POSITION_GROUPS, {"Cmp_stats_passing_types": "passes_by_type"})
    assert {"sot_pct", "passes_by_type", "goals"} <= set(out.columns) and "gls" not in out.columns
    got = rows(out, "player_name", "league", "nationality_fbref", "nationality_iso3", "position_primary", "birth_year", "age", "is_split_season", "season_end_year")
    assert got[0] == ("Ann", "Premier League", "eng", "ENG", "FWD", 1999, None, True, 2025) and got[2] == ("Bo", "zz Other", "it", "ITA", "GK", None, 30.0, False, 2025)
    with pytest.raises(ValueError, match="clash"):
        loaders.load_wide_stats(df.withColumn("goals", F.lit("1")), names, {}, "2024-25", panel_build.POSITION_GROUPS)
    with pytest.raises(Exception, match="no class"):
        loaders.load_wide_stats(df.withColumn("Pos", F.lit("??")), names, {}, "2024-25", panel_build.POSITION_GROUPS).collect()


def test_ratings_of_editions(spark):
    a = spark.createDataFrame([("23", "Ann", "ST, CF", "80", "85"), ("21", "Old", "GK", "1", "1"), ("x", "Bad", "GK", "1", "1"), ("24.0", "Bo", "LWB", "n/a", None)], "fifa_version string, short_name string, player_positions string, overall string, potential string")
    many = loaders.load_ratings(a, {"short_name": "player_name", "player_positions": "position_detail"}, "s")
    assert rows(many, "fifa_year", "season", "player_name", "primary_position", "overall", "potential") == [(23, "2022-23", "Ann", "FWD", 80.0, 85.0), (24, "2023-24", "Bo", "DEF", None, None)]
    one = loaders.load_ratings(spark.createDataFrame([("Cy", None, 70)], "Name string, Position string, OVR int"), {"Name": "player_name", "Position": "position_detail", "OVR": "overall"}, "t", edition=25)
    assert one.columns == many.columns and rows(one, "season", "primary_position", "overall", "potential") == [("2024-25", "Other", 70.0, None)]


def test_master_loaders(spark):
    comp = spark.createDataFrame([("GB1", "England"), ("XX", "Nowhere")], "competition_id string, country_name string")
    assert rows(loaders.load_competitions(comp, {"GB1": "Premier League"}, {"Premier League": 1}, {"Premier League": 90.5}, {"Premier League": 1.5}), "league_name", "country", "league_tier", "uefa_coefficient", "league_value_multiplier") == [("Premier League", "England", 1, 90.5, 1.5)]
    t = spark.createDataFrame([(1, "2024-07-01", 10, 20, "5"), (2, "2024-07-01", 10, 20, "0"), (3, "2026-01-01", 10, 20, "5"), (4, "2025-01-15", 30, 10, "7"), (5, "bad", 10, 20, "5")], "player_id int, transfer_date string, to_club_id int, from_club_id int, transfer_fee string")
    clubs = spark.createDataFrame([(10, "GB1"), (20, "XX")], "club_id int, domestic_competition_id string")
    assert rows(loaders.load_transfers(t, clubs, {"GB1": "Premier League"}, ["GB1"], "2024-06-01", "2025-09-30"), "tm_player_id", "from_league_name", "to_league_name", "window") == [(1, None, "Premier League", "summer")]
    v = spark.createDataFrame([(1, "2024-06-15", 5.0, "GB1"), (1, "2024-07-15", 9.0, "GB1"), (2, "2024-05-16", 1.0, "GB1"), (2, "2024-05-15", 2.0, "GB1"), (3, "2024-05-01", 1.0, "GB1"), (4, "2024-06-30", 1.0, "XX")], "player_id int, date string, market_value_in_eur double, player_club_domestic_competition_id string")
    ends = spark.createDataFrame([("2023-24", "2024-06-30")], "season string, season_end_date string")
    assert rows(loaders.season_snapshots(v, ends, ["GB1"], 45), "tm_player_id", "market_value_eur", "days_from_season_end") == [(1, 5.0, -15), (2, 1.0, -45)]
    assert loaders.load_national_teams(spark.createDataFrame([(1, 2)], "national_team_id int, other int")).columns == ["national_team_id"]


def test_arrivals_of_a_page():
    row = '<tr><td><a href="/a/profil/spieler/7">Ann&nbsp;O\'X</a></td><td class="alter-transfer-cell">21</td><td class="rechts mw-transfer-cell">€2.00m</td><td class="rechts"><a>End of loan<br>Jun 30</a></td></tr>'
    box = lambda club, first, body: f'<div class="box"><h2><a>{club}</a></h2><div class="responsive-table"><table><thead><tr><th>{first}</th></tr></thead><tbody>{body}</tbody></table></div></div>'
    page = box("Red FC", "In", row + "<tr><td>No arrivals</td></tr>") + box("Red FC", "Out", row) + box("Transfer record", "In", row) + box("Best of the Season", "In", row) + '<div class="box">no heading</div>'
    assert TF.page_arrivals(page) == [("Ann O'X", "21", "", "", "Red FC", "End of loan Jun 30", "€2.00m")]
    assert TF.page_arrivals(None) == [] and TF.page_arrivals("<div class='box'><h2>Red<table><tr><td>") == []


# -- panel build -------------------------------------------------------------------------------------------------


def test_merge_stat_tables(spark):
    key = "league string, season string, team string, player string, nation string, pos string, age string, born int"
    ident = lambda p, n: ("L", "s", "T", p, n, "FW,MF", "20", 2000)
    standard = spark.createDataFrame([(*ident("Ann", None), 3), (*ident("Bo", "ENG"), 1), (*ident("Bo", "ENG"), 1)], f"{key}, Gls int")
    shooting = spark.createDataFrame([(*ident("Ann", None), 40.0, 3), (*ident("Cy", "ENG"), 1.0, 1)], f"{key}, `SoT%` double, Gls int")
    out = panel_build.merge_stat_tables({"standard": standard, "shooting": shooting}, {"standard": {"Gls": "goals"}}, {"shooting": ["Gls"]})
    assert rows(out, "player", "goals", "shooting__sot_pct", "primary_position") == [("Ann", 3, 40.0, "FWD"), ("Bo", 1, None, "FWD")]
    with pytest.raises(ValueError, match="goals"):
        panel_build.merge_stat_tables({"standard": standard, "shooting": shooting}, {"standard": {"Gls": "goals"}, "shooting": {"Gls": "goals"}})


STINTS = "stint_id long, player string, born int, nation string, nationality string, team string, source string, season string, league string, minutes_played int, goals double, matches_90s double, goals_per_90 double, save_pct double"


def test_backbone_identities_and_collapse(spark):
    master = spark.createDataFrame([(7, "Ann Ox", 1999, "England", "Red FC")], "id long, name string, year int, nation string, team string")
    stints = spark.createDataFrame(
        [
            (1, "Ann Ox", 1999, "ENG", "England", "Red", "f", "2023-24", "L", 1000, 5.0, 1000 / 90, 0.45, 80.0),
            (2, "Ann Ox", 1999, "ENG", "England", "Blue", "f", "2023-24", "L", 500, 3.0, 500 / 90, 0.54, 90.0),
            (3, "Bo Qi", 2001, "CHN", None, "Red", "f", "2023-24", "L", 0, 1.0, 0.0, 0.7, None),
        ],
        STINTS,
    )
    got = panel_build.resolve_backbone(stints, master)
    assert rows(got, "stint_id", "player_id", "resolve_method", "data_richness")[:2] == [(1, "7", "exact", "full"), (2, "7", "exact", "full")]
    third = [r for r in got.collect() if r["stint_id"] == 3][0]
    assert third["player_id"].startswith("synthetic_") and (third["resolve_method"], third["data_richness"]) == ("synthetic", "synthetic_basic")
    out = panel_build.collapse_seasons(got, ["L"], ["team", "player", "league", "resolve_method", "data_richness"])
    a, b = sorted(out.collect(), key=lambda r: r["player_id"])
    assert (a["minutes_played"], a["goals"], a["club"], a["is_split_season"], a["meets_min_minutes"]) == (1500, 8.0, "Red", True, True)
    assert math.isclose(a["goals_per_90"], 8 / (1500 / 90)) and math.isclose(a["save_pct"], (80 * 1000 + 90 * 500) / 1500)
    assert (b["goals_per_90"], b["is_split_season"], b["meets_min_minutes"]) == (0.7, False, False)


def test_split_identities(spark):
    base = lambda i, pid, name, team, season, minutes: (i, name, 1990, "BRA", None, team, "f", season, "L", minutes, 1.0, 1.0, 0.1, 0.1, pid, "exact", "full")
    df = spark.createDataFrame(
        [
            base(1, "43", "Gabriel Magalhaes", "Arsenal", "2021-22", 3000), base(2, "43", "Gabriel Other", "Wolves", "2021-22", 700), base(3, "43", "GABRIEL  Magalhães", "Arsenal", "2022-23", 10),
            base(4, "X", "Vitinha", "Paris", "2022-23", 3000), base(5, "X", "Vitinha", "Marseille", "2022-23", 2000), base(6, "synthetic_1", "A", "P", "2022-23", 10), base(7, "synthetic_1", "B", "P", "2021-22", 10),
        ],
        STINTS + ", player_id string, resolve_method string, data_richness string",
    )
    got = {r["stint_id"]: (r["player_id"], r["resolve_method"], r["data_richness"]) for r in panel_build.split_identities(df).collect()}
    assert got[1][0] == got[3][0] == "43" and got[2][0].startswith("synthetic_") and got[2][1:] == ("synthetic_split", "synthetic_basic")
    assert got[4] == ("X", "exact", "full") and got[5][0].startswith("synthetic_") and got[5][0] != got[2][0] and got[6][0] == got[7][0] == "synthetic_1"


PANEL = "player_id string, player_name_fbref string, born int, season string, club string, league string"


def test_panel_matches(spark):
    p = spark.createDataFrame([("1", "Kylian Mbappé", 1998, "2023-24", "Paris SG", "L"), ("2", "Jon Doe", 1990, "2023-24", "Red FC", "L"), ("3", "Jon Doe", 1990, "2023-24", "Blue", "L"), ("4", "Wout Faes", None, "2023-24", "Leicester City", "L")], PANEL)
    r = spark.createDataFrame([(1, "K. Mbappe", 1998, "2023-24", "x"), (2, "Jon Doe", 1990, "2023-24", "Red"), (3, "Wout Faes", None, "2023-24", "?"), (4, "Nobody", 1990, "2023-24", "Red"), (5, "Wouter Faes", 1, "2023-24", "Leicester City"), (6, "J. Doe", 1990, "2023-24", "Blue")], "k int, name string, born int, season string, team string")
    by_year = {x["k"]: x["player_id"] for x in panel_build.match_to_panel(r, p, "name", "born").collect()}
    assert by_year == {1: "1", 2: None, 3: "4", 4: None, 5: None, 6: None}
    by_club = {x["k"]: x["player_id"] for x in panel_build.match_in_club(r, p, "k", "name", "team").collect()}
    assert by_club == {1: "1", 2: "2", 3: "4", 4: None, 5: "4", 6: None}


def test_attach_and_finalize(spark):
    p = spark.createDataFrame([("1", "Ann", 1999, "2023-24", "Red", "Top"), ("1", "Ann", 1999, "2024-25", "Red", "Top"), ("2", "Bo", 2001, "2024-25", "Red", "Low"), (None, "Cy", None, "2024-25", "Red", None)], PANEL).withColumn("nation", F.lit("ENG")).withColumn("empty__stat", F.lit(None).cast("int"))
    first = spark.createDataFrame([("1", 1.0, 0.5, 0.2), ("1", 2.0, None, 0.3), ("2", 9.0, 9.0, 9.0), (None, 7.0, 7.0, 7.0)], "player_id string, xg double, npxg double, xag double")
    second = spark.createDataFrame([("1", "2023-24", 4.0, 3.0, 1.0), ("1", "2024-25", 8.0, 7.0, 2.0), ("2", "2024-25", 6.0, 6.0, 6.0)], "player_id string, season string, xg double, np_xg double, xa double")
    out = panel_build.attach_xg(p, first, second, ["Top"], "2024-25")
    assert rows(out, "player_id", "season", "xg", "npxg", "xag", "understat_xa", "xg_source")[:3] == [("1", "2023-24", 4.0, 3.0, None, 1.0, "understat"), ("1", "2024-25", 3.0, 0.5, 0.5, 2.0, "kaggle"), ("2", "2024-25", None, None, None, 6.0, "none")]
    values = spark.createDataFrame([(1, "2023-24", 100.0, dt.date(2024, 6, 1))], "tm_player_id long, season string, market_value_eur double, snapshot_date date")
    out = panel_build.attach_market_value(out, values)
    master = spark.createDataFrame([(1, "2025-12-30", "1999-07-01", True), (2, "2020-01-01", "garbage", None)], "tm_player_id long, contract_expiration_date string, date_of_birth string, has_international_caps boolean")
    out = panel_build.attach_contract(out, master, {"2023-24": "2024-06-30", "2024-25": "2025-06-30"})
    ratings = spark.createDataFrame([("Ann", 1999, "2024-25", 70, 75), ("Ann", 1999, "2024-25", 72, None), ("Bo", None, "2024-25", 60, 61)], "player_name string, birth_year int, season string, overall int, potential int")
    out = panel_build.attach_rating(out, ratings)
    meta = spark.createDataFrame([("T1", 1, 90.0, 1.5)], "competition_id string, league_tier int, uefa_coefficient double, league_value_multiplier double")
    out = panel_build.attach_league_meta(out, meta, {"Top": "T1"})
    assert out.count() == 4
    final = panel_build.finalize(out, X.nationality(F.col("nation"), {"ENG": "England"}, ["England"]), {"England": "Europe"})
    assert "empty__stat" not in final.columns and final.columns[:2] == ["player_id", "player_name"] and final.count() == 4
    a = [r for r in final.collect() if r["player_id"] == "1" and r["season"] == "2024-25"][0]
    assert (a["fifa_rating"], a["fifa_potential"], a["league_tier"], a["age_precision"], a["continent_group"], a["has_contract_date"], a["worldcup_25_squad"], a["is_loan"]) == (72, 75, 1, "exact", "Europe", True, True, False)
    assert math.isclose(a["contract_remaining_months"], 183 / 30.44) and math.isclose(a["age_at_season_end"], 9496 / 365.25)
    b = [r for r in final.collect() if r["player_id"] == "2"][0]
    assert (b["contract_remaining_months"], b["age_at_season_end"], b["age_precision"], b["league_tier"], b["fifa_rating"], b["log_market_value"]) == (0.0, 24.0, "year_only", None, 60, None)
    with pytest.raises(Exception, match="duplicate key"):
        panel_build.finalize(out.unionByName(out), F.lit("England"), {}).collect()


def test_join_helpers(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, n string")
    assert rows(joins.flag_repeated(a, ["k", "n"], "again"), "k", "again") == [(1, True), (1, True), (2, False)]
    assert rows(joins.keys_only_in(a, a.filter("k = 2"), ["k", "n"]), "k", "n") == [(1, None)]
    assert rows(joins.schema_aligned(a.withColumn("k", F.lit("z")), {"n": "string", "k": "int", "new": "double"}), "n", "k", "new") == [("x", None, None), (None, None, None), (None, None, None)]
    v = spark.createDataFrame([(1, 20.0), (2, None), (3, float("nan"))], "l int, v double").withColumn("g", F.lit("a"))
    w = spark.createDataFrame([(1, 23.0), (2, 17.0), (3, 23.5)], "r int, x double").withColumn("g", F.lit("a"))
    assert rows(joins.nearest_in_group(v, w, "g", "l", "v", "r", "x", 3.0), "l", "r", "distance") == [(1, 1, 3.0)]


def test_pearson_of_what_does_not_vary(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 9.0)], "a double, b double")
    assert df.agg(stats.pearson("a", "b")).first()[0] is None
    assert math.isclose(df.union(df.selectExpr("a + 1", "b + 1")).agg(stats.pearson("a", "b")).first()[0], np.corrcoef([1, 1, 2, 2], [2, 3, 3, 4])[0, 1])


# -- training, inference, exploration --------------------------------------------------------------------------------


def _data(spark, n=260):
    rng = np.random.default_rng(12)
    out = []
    for i in range(n):
        a, b = float(rng.normal()), float(rng.normal())
        out.append((f"p{i}", "FWD", "train" if i % 4 else "val", a if i % 9 else None, b, i % 2 == 0, 2 * a + b + float(rng.normal(0, 0.1)), a, None))
    return spark.createDataFrame(out, "player_id string, primary_position string, split string, a double, b double, flag boolean, next_y double, y double, never double")


def test_train_slots_and_best_models(spark, tmp_path):
    light = training.Learners(ridge_grid=[{"alpha": 0.01}, {"alpha": 10.0}], ridge_folds=2, tree_grid=[{"depth": 3, "rounds": 3}], hidden=(8,))
    data = _data(spark).drop("y").withColumn("y", F.col("b"))
    metrics, models, used = training.train_slots(spark, data, [("FWD", "y", "next_y", "y"), ("GK", "y", "next_y", "y"), ("FWD", "z", "next_z", "z")], learners=light)
    got = {r["model"]: r for r in metrics.collect()}
    assert set(got) == {"ridge", "trees", "mlp", "stacked"} and "never" not in used[("FWD", "y")] and "next_y" not in used[("FWD", "y")]
    assert got["ridge"]["improvement"] > 0.5 and got["mlp"]["mae"] < got["mlp"]["baseline_mae"] and not math.isnan(got["ridge"]["cv_mae"])
    best = training.best_models(metrics).collect()
    assert len(best) == 1 and best[0]["mae"] == min(r["mae"] for r in got.values())
    tie = spark.createDataFrame([("FWD", "y", "mlp", 1.0), ("FWD", "y", "trees", 1.0), ("GK", "y", "ridge", None)], "position string, target string, model string, mae double")
    assert rows(training.best_models(tie), "position", "model") == [("FWD", "trees"), ("GK", "ridge")]
    valid = training.as_numbers(data.filter("split = 'val'"), used[("FWD", "y")])
    for name in ("ridge", "mlp", "stacked"):
        training.save_model(spark, models[("FWD", "y", name)], f"{tmp_path}/FWD_y_{name}")
    for name in ("ridge", "mlp", "stacked"):
        again = training.load_model(spark, f"{tmp_path}/FWD_y_{name}", name).transform(valid).agg(F.sum("prediction")).first()[0]
        assert math.isclose(again, models[("FWD", "y", name)].transform(valid).agg(F.sum("prediction")).first()[0], rel_tol=1e-9)
    loaded = training.load_best(spark, metrics.filter("model = 'ridge'"), str(tmp_path))
    assert set(loaded) == {("FWD", "y")}
    features = used[("FWD", "y")]
    assert training.importance(models[("FWD", "y", "ridge")], features)[0][0] == "a" and len(training.importance(models[("FWD", "y", "trees")], features, top=2)) == 2
    assert training.importance(models[("FWD", "y", "mlp")], features, valid, "next_y", repeats=1)[0][0] == "a"


def test_forward_chain(spark):
    light = training.Learners(["ridge"], [{"alpha": 0.01}])
    rng = np.random.default_rng(3)
    out = []
    for i in range(120):
        for year in (2021, 2022, 2023, 2024):
            g = float(rng.uniform(0.1, 0.9))
            out.append((f"p{i}", f"N{i}", f"{year}-{year - 1999:02d}", "FWD" if i % 10 else None, 20.0 + i % 10, 900, True, g, None if year == 2023 and i % 7 == 0 else 1e6 * (1 + g), math.log1p(1e6 * (1 + g))))
    df = spark.createDataFrame(out, "player_id string, player_name string, season string, primary_position string, age_at_season_end double, minutes_played int, meets_min_minutes boolean, goals_per_90 double, market_value_eur double, log_market_value double")
    pairs = training.projection_pairs(df, ["goals_per_90"], ["2021-22", "2022-23"], ["2023-24"])
    assert set(r["split"] for r in pairs.select("split").distinct().collect()) == {"train", "val"}
    _, proj, used = training.train_slots(spark, pairs, [("FWD", "goals_per_90", "next_goals_per_90", "goals_per_90")], learners=light)
    _, value, more = training.train_slots(spark, training.valuation_rows(df, ["2021-22", "2022-23", "2023-24"], ["2024-25"]), [("FWD", "value", "log_market_value", None)], learners=light)
    models = ({k[:2]: m for k, m in proj.items()}, {k[0]: m for k, m in value.items()}, used | more)
    got = inference.predict_batch(df, *models, "2023-24")
    assert got.count() == 108 and {r["next_season"] for r in got.select("next_season").distinct().collect()} == {"2024-25"}
    r = got.filter("player_id = 'p7'").first()
    assert r["observed_current_mv"] is None and math.isclose(r["mv_delta"], r["projected_mv_next"] - r["current_mv_estimate"]) and r["n_fallback"] == 0 and set(r["stage1_projections"]) == {"goals_per_90"}
    none = inference.predict_batch(df, {}, *models[1:], "2023-24").filter("player_id = 'p1'").first()
    assert none["n_fallback"] == 1 and len(none["notes"]) == 1
    one = inference.predict_one(df, "p1", "2023-24", *models).collect()
    assert len(one) == 1 and one[0]["player_id"] == "p1"
    with pytest.raises(Exception, match="no row"):
        inference.predict_one(df, "ghost", "2023-24", *models).collect()
    came = df.filter("season = '2024-25'").select("player_id", F.col("log_market_value").alias("al"), F.col("market_value_eur").alias("actual_mv"))
    q = inference.residual_quantiles(got.join(came, "player_id"), F.col("al"), F.col("projected_log"))
    c = stats.interval_coverage(inference.with_interval(got, q).join(came, "player_id"), F.col("actual_mv"), F.col("ci_low"), F.col("ci_high")).first()["coverage"]
    assert 0.85 <= c <= 0.95
    v = {(r["scenario"], r["common"]): r["n"] for r in inference.validate_chain(got, came.select("player_id", "actual_mv")).collect()}
    assert v[("pipeline", False)] == 108 and v[("naive", False)] == v[("naive", True)] == v[("pipeline", True)] < 108


def test_fee_matching(spark):
    fees = spark.createDataFrame([(1, "Ánn Ox", 21, 10.0), (2, "Ann Ox", 40, 10.0), (3, "Bo", None, 5.0), (4, "Ann Ox", 21, 0.0)], "fee_id int, player_name string, player_age int, transfer_fee_eur double")
    rows_ = spark.createDataFrame([(1, "Ann Ox", 24.0, 20.0, None), (2, "Ann Ox", 22.5, 30.0, 12.0), (3, "Bo", 20.0, 1.0, 1.0)], "row_id int, player_name string, age_at_season_end double, pred double, mv double")
    m = inference.match_fees(fees, rows_)
    assert rows(m, "fee_id", "row_id") == [(1, 2)]
    v = inference.fee_validation(m, "pred", "mv").first()
    assert (v["n"], v["median_ratio"], v["naive_n"], v["naive_median_ratio"], v["pearson"]) == (1, 3.0, 1, 1.2, None)


def test_peak_age_against_every_row(spark):
    rng = np.random.default_rng(9)
    age = np.round(rng.uniform(17, 38, 600), 1)
    value = 100 - (age - 27.4) ** 2 + rng.normal(0, 1, 600)
    df = spark.createDataFrame([("MID", float(a), float(v)) for a, v in zip(age, value)] + [("GK", 30.0, 1.0)] * 3 + [(None, 20.0, 1.0)], "pos string, age double, value double")
    got = {r["pos"]: (r["n"], r["peak_age"]) for r in explore.peak_ages(df, "age", "value", "pos", share=0.3).collect()}
    assert got["GK"] == (3, None) and set(got) == {"GK", "MID"}
    assert abs(got["MID"][1] - explore.local_peak(age, value, np.ones(600), 0.3)) < 0.15 and abs(got["MID"][1] - 27.4) < 0.8


def test_blocks_and_causes():
    b = explore.column_blocks(["player_id", "xg", "goals", "shooting__sot"])
    assert b["identity"] == ["player_id"] and b["performance_clean"] == ["goals"] and b["performance_namespaced"] == ["shooting__sot"]
    assert [explore.gap_cause(c) for c in ("xg", "psxg_net", "saves", "market_value_eur", "has_contract_date", "goals", "season")] == ["source_gap", "source_gap", "structural_gk", "target_sparse", "contract_sparse", "structural_outfield", "other"]


def test_medians_keep_their_order(spark):
    df = spark.createDataFrame([("b", 2.0), ("b", 4.0), ("a", 6.0), ("z", 1.0)], "d string, v double")
    got = sorted(explore.medians_in_order(df, "v", "d", ["b", "c", "a"], change=True).collect(), key=lambda r: r["place"])
    assert [(r["d"], r["median"], r["change"]) for r in got] == [("b", 3.0, None), ("c", None, None), ("a", 6.0, None)]


def test_career(spark):
    df = spark.createDataFrame([("1", "Jude B", "2022-23", "X"), ("1", "Jude B", "2021-22", "Y"), ("2", "jude c", "2021-22", "X"), (None, "Jude", "2021-22", "X")], "player_id string, player_name string, season string, league string")
    assert rows(explore.career_of(df, "JUDE"), "player_id", "name", "seasons", "leagues") == [("1", "Jude B", ["2021-22", "2022-23"], ["Y", "X"])]
    assert explore.career_of(df, "nobody").count() == 0


def test_resolver_similarity_is_symmetric(spark):
    df = spark.createDataFrame([("ann ox", "ox ann"), ("a", None)], "a string, b string")
    assert [r[0] for r in df.select(resolve.similarity(F.col("a"), F.col("b"))).collect()] == [100.0, None]
