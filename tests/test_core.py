"""Traps and exact fixtures of the panel operators."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from touchline.functions import scalars as X
from touchline.functions.similarity import edits, indel_ratio, lcs_length, token_set_ratio
from touchline.operators import impute as I
from touchline.operators import joins, panel, quality, resolve, stats, windows
from touchline.plans import features, inference, models
from touchline.queries import reference
from touchline.sources import text_formats as TF


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


# -- scalars -------------------------------------------------------------------------------------------------


def test_nan_is_null_and_rates_are_guarded(spark):
    df = spark.createDataFrame([(float("nan"), 0.0), (4.0, 2.0), (None, None)], "a double, b double")
    got = [tuple(r) for r in df.select(X.clean_number(F.col("a")), X.guarded_rate(F.col("a"), F.col("b")), X.clip_lower(F.col("a") - 5), X.flag(F.col("b") > 1)).collect()]
    assert got[0][0] is None and got[0][1] is None and got[0][3] is False
    assert got[1] == (4.0, 2.0, 0.0, True)
    assert got[2] == (None, None, None, False)


def test_names_fold():
    assert [X.fold_text(n) for n in ("O'Riley", "Ødegaard", "L. Messi", "  Jean-Luc   Đoković ", "Ħal Għaxaq", "Иван Ivan 7", None, "")] == ["oriley", "odegaard", "l messi", "jean luc dokovic", "hal ghaxaq", "ivan 7", None, ""]
    assert [X.fold_compact(n) for n in ("Côte d'Ivoire", "Korea, North", None)] == ["cotedivoire", "koreanorth", None]
    assert [X.fold_ascii(n) for n in ("Ødegaard", "J. Müller-Lee", None)] == ["degaard", "j  muller lee", None]


def test_initials_and_lone_names(spark):
    df = spark.createDataFrame([("lionel messi",), ("danilo",), (None,)], "n string")
    got = df.select(X.initials(F.col("n")), X.initials(F.col("n"), lone_to_letter=False)).collect()
    assert [tuple(r) for r in got][:2] == [("l messi", "l messi"), ("d", "danilo")]


@pytest.mark.parametrize(("text", "amount", "kind"), [("€1.5m", 1.5e6, "paid"), ("1,5m", 15e6, "paid"), ("€500k", 5e5, "paid"), ("€800Th.", 800.0, "paid"), (" €\u00a02.10bn ", 2.1e9, "paid"), ("€1,250", 1250.0, "paid"), ("loan fee: €2m", None, "loan"), ("End of loan Jun 30", None, "end_of_loan"), ("free transfer", None, "free"), ("loan, free of charge", None, "free"), ("fee 3m", None, "undisclosed"), ("1.2.3m", None, "undisclosed"), ("-", None, "undisclosed"), ("?", None, "undisclosed"), ("", None, "undisclosed"), (None, None, "undisclosed")])
def test_fees(spark, text, amount, kind):
    a, k = X.fee_parts(F.col("t"))
    assert tuple(spark.createDataFrame([(text,)], "t string").select(a, k).first()) == (amount, kind)


def test_synthetic_id_matches_hashlib(spark):
    import hashlib

    df = spark.createDataFrame([("a", None, "b")], "x string, y int, z string")
    assert df.select(X.synthetic_id(F.col("x"), F.col("y"), F.col("z"))).first()[0] == "synthetic_" + hashlib.sha256(b"a||b").hexdigest()[:12]


def test_taxonomy_variants(spark):
    df = spark.createDataFrame([("FW,MF",), ("XX",), (None,)], "p string")
    table = {"FW": "FWD", "MF": "MID"}
    assert [r[0] for r in df.select(X.first_token(F.col("p"), table)).collect()] == ["FWD", None, None]
    assert [r[0] for r in df.select(X.first_token(F.col("p"), table, "Other")).collect()] == ["FWD", "Other", "Other"]
    with pytest.raises(Exception, match="no class"):
        df.select(X.first_token(F.col("p"), table, strict=True)).collect()


def test_similarity_against_brute_force():
    rng = random.Random(3)

    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(2))
        assert lcs_length(a, b) == lcs(a, b)
    assert indel_ratio("", "") == 100 and token_set_ratio("", "a") == 0
    assert token_set_ratio("kylian mbappe lottin", "kylian mbappe") == 100
    assert edits("ab", "ba") == 1 and edits("abc", "abc") == 0 and edits("abcd", "xy", most=1) == 2


# -- joins and panel -------------------------------------------------------------------------------------------


def test_asof_ties_and_inclusive_edge(spark):
    day = dt.date(2024, 6, 30)
    left = spark.createDataFrame([(1, 7, day), (2, 8, day), (3, None, day)], "lid int, k int, d date")
    right = spark.createDataFrame([(10, 7, day + dt.timedelta(5)), (11, 7, day - dt.timedelta(5)), (12, 7, day - dt.timedelta(5)), (13, 8, day + dt.timedelta(45)), (14, 8, day - dt.timedelta(46)), (15, None, day)], "rid int, k int, s date")
    got = {r[0]: (r[1], r[2]) for r in joins.asof_nearest(left, right, "k", "lid", "d", "rid", "s", 45).collect()}
    assert got == {1: (11, 5), 2: (13, 45)}


def test_asof_against_brute_force(spark):
    rng = random.Random(5)
    base = dt.date(2024, 1, 1)
    ls = [(i, rng.randint(0, 3), base + dt.timedelta(rng.randint(0, 400))) for i in range(60)]
    rs = [(i, rng.randint(0, 3), base + dt.timedelta(rng.randint(0, 400))) for i in range(60)]
    got = {r[0]: r[1] for r in joins.asof_nearest(spark.createDataFrame(ls, "lid int, k int, d date"), spark.createDataFrame(rs, "rid int, k int, s date"), "k", "lid", "d", "rid", "s", 30).collect()}
    want = {}
    for i, k, d in ls:
        c = sorted((abs((s - d).days), s, j) for j, kk, s in rs if kk == k and abs((s - d).days) <= 30)
        if c:
            want[i] = c[0][2]
    assert got == want


def test_null_safe_join_and_clash(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, v int")
    b = spark.createDataFrame([(None, 5)], "k string, w int")
    assert {(r["k"], r["w"]) for r in joins.left_join_nullsafe(a, b, ["k"]).collect()} == {(None, 5), ("x", None)}
    with pytest.raises(ValueError, match="both sides"):
        joins.left_join_nullsafe(a, b.withColumnRenamed("w", "v"), ["k"])


def test_require_unique(spark):
    df = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(Exception, match="duplicate key"):
        joins.require_unique(df, ["k"]).collect()


def test_nearest_in_group_tolerance_and_tie(spark):
    l = spark.createDataFrame([("a", 1, 25.0), ("a", 2, 40.0), ("b", 3, None)], "k string, lid int, v double")
    rr = spark.createDataFrame([("a", 9, 24.0), ("a", 8, 26.0), ("a", 7, 36.9)], "k string, rid int, w double")
    assert [tuple(r) for r in joins.nearest_in_group(l, rr, "k", "lid", "v", "rid", "w", 3.0).collect()] == [(1, 8, 1.0)]


def test_collapse_parts(spark):
    rows = [("p", "s", "A", 1000, 5, 80.0, 0.5), ("p", "s", "B", 500, 3, 90.0, 0.7), ("q", "s", "C", 90, 1, None, 9.9)]
    df = spark.createDataFrame(rows, "id string, season string, club string, minutes int, goals int, pct double, per90 double").withColumn("nineties", F.col("minutes") / 90)
    got = {r["id"]: r.asDict() for r in panel.collapse_parts(df, ["id", "season"], "minutes", [F.col("club")], ["goals", "nineties"], ["pct"], {"per90": ("goals", "nineties")}, ["club"]).collect()}
    assert got["p"]["minutes"] == 1500 and got["p"]["goals"] == 8 and got["p"]["club"] == "A" and got["p"]["is_split"]
    assert math.isclose(got["p"]["pct"], 83.33333, rel_tol=1e-5) and math.isclose(got["p"]["per90"], 8 / (1500 / 90))
    assert got["q"]["per90"] == 9.9 and got["q"]["pct"] is None and not got["q"]["is_split"]


def test_guards(spark):
    df = spark.createDataFrame([("x", "ann", 100), ("x", "bob", 50), ("y", "cy", 1), ("y", None, 5)], "id string, name string, m int")
    got = {(r["name"], r["id"]) for r in panel.split_shared_ids(df, "id", "name", "m", F.lit("new")).collect()}
    assert got == {("ann", "x"), ("bob", "new"), ("cy", "y"), (None, "y")}
    d2 = spark.createDataFrame([("x", "s", 3000, 1), ("x", "s", 2000, 2), ("y", "s", 3800, 3)], "id string, s string, m int, n int")
    assert {(r["n"], r["id"]) for r in panel.split_overflow(d2, "id", "s", "m", 3800, [F.col("n")], F.lit("new")).collect()} == {(1, "x"), (2, "new"), (3, "y")}


def test_streak_lag_pairs(spark):
    df = spark.createDataFrame([("a", 2020, 1.0), ("a", 2021, 2.0), ("a", 2023, 5.0), ("b", 2020, None)], "e string, y int, v double")
    assert [r["consecutive"] for r in windows.streak(df, "e", "y").orderBy("e", "y").collect()] == [1, 2, 1, 1]
    lag = windows.lag_delta(df, "e", "y", ["v"]).orderBy("e", "y").collect()
    assert [(r["v_lag1"], r["delta_v"], r["has_lag1"]) for r in lag] == [(None, None, False), (1.0, 1.0, True), (2.0, 3.0, True), (None, None, False)]
    assert [tuple(r) for r in windows.consecutive_pairs(df, "e", "y", ["v"], F.lit(True)).select("e", "y", "next_v").collect()] == [("a", 2020, 2.0)]


def test_zscore_needs_enough_rows_and_keys(spark):
    df = spark.createDataFrame([("g", float(i)) for i in range(15)] + [("h", 1.0), (None, 1.0)], "g string, v double")
    got = windows.group_zscore(df, "v", ["g"], "z").collect()
    z = [r["z"] for r in got if r["g"] == "g"]
    assert abs(sum(z)) < 1e-9 and abs(np.std(z, ddof=1) - 1) < 1e-4
    assert all(r["z"] is None for r in got if r["g"] != "g")


def test_features_forward(spark):
    df = spark.createDataFrame([("p", "2023-24", "MID", 28.5, 18.0, 0.4, 10.0)], "player_id string, season string, primary_position string, age_at_season_end double, contract_remaining_months double, goals_per_90 double, proj double")
    df = features.contract(features.age_curve(df))
    got = one(features.forward(features.history(df, stats=["goals_per_90"]), {"goals_per_90": "proj"}))
    assert got["season"] == "2024-25" and got["age_at_season_end"] == 29.5 and got["is_declining"] and not got["is_peak"]
    assert got["contract_remaining_months"] == 6.0 and got["is_expiring"] and got["goals_per_90"] == 10.0
    assert got["goals_per_90_lag1"] == 0.4 and math.isclose(got["delta_goals_per_90"], 9.6) and got["consecutive_seasons"] == 2


def test_features_build_scores_every_stat_by_season_and_league(spark):
    # 20 rows of two positions in one league: each position has 10 (too few), the league has enough
    rows = [(f"p{i}", "2023-24", "DEF" if i % 2 else "MID", "L", 25.0, 900 + i, i % 5, i % 3, i % 7, float(i % 4), "Asia" if i else None) for i in range(20)]
    df = spark.createDataFrame(rows, "player_id string, season string, primary_position string, league string, age_at_season_end double, minutes_played int, goals int, assists int, shots int, xg double, continent_group string")
    built = features.build(df)
    want = ["goals_per_90", "assists_per_90", "shots_per_90", "xg_per_90", "minutes_played", "goal_threat"]
    unknown = ["creative_threat", "defensive_actions"]
    assert {c for c in built.columns if "_z_" in c} == {f"{s}_z_{g}" for s in want + unknown for g in ("pos", "league")}
    got = built.collect()
    for s in want:
        v = np.array([r[s] for r in got])
        assert np.allclose([r[f"{s}_z_league"] for r in got], (v - v.mean()) / (v.std(ddof=1) + 1e-6))
        assert all(r[f"{s}_z_pos"] is None for r in got)
    assert all(r[f"{s}_z_{g}"] is None for r in got for s in unknown for g in ("pos", "league"))
    assert all(r["is_continent_Asia"] == (r["player_id"] != "p0") and r["is_continent_Other"] is False for r in got)
    assert all(r["year_inflation_multiplier"] == 1.254 for r in got)
    thin = {(r["stat"], r["grouping"]): r["n_groups"] for r in features.thin_groups(built).collect()}
    assert thin[("goals_per_90", "z_pos")] == 2 and thin[("goals_per_90", "z_league")] == 0 and thin[("creative_threat", "z_pos")] == 0


def test_composites_by_formula(spark):
    names = ["xg", "shots", "xag", "understat_xa", "tackles_won", "interceptions", "goals", "assists"]
    rows = [(0.4, 2.0, 0.3, 0.9, 1.0, 2.0, 0.5, 0.2), (0.4, 0.4, None, 0.9, None, 2.0, 0.5, 0.2), (None, None, None, None, 1.0, 1.0, 0.5, 0.2)]
    got = features.composites(spark.createDataFrame(rows, ", ".join(f"{n}_per_90 double" for n in names))).collect()
    keys = ["goal_threat", "creative_threat", "defensive_actions", "shooting_efficiency", "attacking_output", "composite_completeness"]
    want = [(1.4, 0.3, 3.0, 0.25, 0.85, 1.0), (0.6, 0.9, None, None, 1.15, 0.6), (None, None, 2.0, None, 0.7, 0.4)]
    for r, w in zip(got, want):
        assert [None if r[k] is None else round(r[k], 9) for k in keys] == [None if x is None else x for x in w]


def test_multipliers_and_notes(spark):
    df = spark.createDataFrame([("2022-23", "A", None), ("2030-31", "B", 1.0)], "season string, league string, p double")
    got = features.multipliers(df, leagues={"A": 1.5}).select("*", features.fallback_notes({"goals": "p"}).alias("notes")).collect()
    assert [(r["year_inflation_multiplier"], r["league_value_multiplier"], len(r["notes"])) for r in got] == [(1.1, 1.5, 1), (None, None, 0)]
    assert "league_value_multiplier" in features.multipliers(df.withColumn("league_value_multiplier", F.lit(9)), leagues={"A": 1.5}).columns


def test_collapse_leaves_single_parts_alone(spark):
    df = spark.createDataFrame([("a", "x", 0, 3.0, 80.0, 0.7), ("b", "y", 1000, 5.0, 80.0, 0.45), ("b", "z", 500, 3.0, 90.0, 0.54)], "id string, club string, minutes int, goals double, pass_pct double, per90 double").withColumn("nineties", F.col("minutes") / 90)
    got = {r["id"]: r for r in panel.collapse_parts(df, ["id"], "minutes", [F.col("club")], ["goals", "nineties"], ["pass_pct"], {"per90": ("goals", "nineties")}, ["club"]).collect()}
    assert (got["a"]["pass_pct"], got["a"]["per90"]) == (80.0, 0.7)  # no minutes, one part: as it stands
    assert math.isclose(got["b"]["pass_pct"], (80 * 1000 + 90 * 500) / 1500) and math.isclose(got["b"]["per90"], 8 / (1500 / 90)) and got["b"]["club"] == "y"
    assert [panel.stat_kind(c) for c in ("goals_per_90", "save_pct", "on_off", "avg_len", "goals")] == ["rate", "mean", "mean", "mean", "sum"]


def test_rating_gap_needs_history(spark):
    with pytest.raises(ValueError, match="history"):
        features.rating_gap(spark.createDataFrame([(1.0,)], "fifa_rating double"))


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, None)], "y double, p double")
    m = one(stats.regression_metrics(df, F.col("y"), F.col("p")))
    assert m["n"] == 2 and m["mae"] == 0.25 and math.isclose(m["rmse"], math.sqrt(0.125)) and math.isclose(m["r2"], 0.5)


def test_resolver_cascade(spark):
    master = spark.createDataFrame([(1, "Martin Ødegaard", 1998, "NOR", "Red"), (2, "Danilo Silva", 1991, "BRA", "Blue"), (3, "Danilo Silva", 1991, "BRA", "Green"), (4, "Lars Smith", 1990, "ENG", "Red"), (5, "Leo Smith", 1990, "ENG", "Gold")], "id long, name string, year int, nation string, team string")
    rows = spark.createDataFrame(
        [(1, "Martin Odegaard", 1998, "NOR", "x", "s"), (2, "Danilo Silva", 1991, "BRA", "Green", "s"), (3, "Danilo Silva", 1991, "BRA", "?", "s"), (4, "L. Smith", 1990, "ENG", "Gold", "s"), (5, "L. Smith", 1990, "ENG", None, "s"), (6, "Marten Odegard", 1998, "NOR", None, "s"), (7, "Variant", None, None, None, "src"), (8, "Nobody", 1980, "FRA", None, "s"), (9, None, None, None, None, None)],
        "row_id long, name string, year int, nation string, team string, source string",
    )
    overrides = spark.createDataFrame([("Variant", "src", 4)], "variant_name string, source string, id long")
    got = {r["row_id"]: (r["id"], r["method"]) for r in resolve.resolve(rows, master, overrides).collect()}
    assert got == {1: (1, "exact"), 2: (3, "exact"), 3: (None, "unmatched"), 4: (5, "fuzzy_team"), 5: (5, "fuzzy_nat"), 6: (1, "fuzzy_nat"), 7: (4, "manual"), 8: (None, "unmatched"), 9: (None, "unmatched")}


_MASTER = "id long, name string, year int, nation string, team string"
_ROWS = "row_id long, name string, year int, nation string, team string, source string"


def _resolved(spark, master, rows, overrides=None):
    o = None if overrides is None else spark.createDataFrame(overrides, "variant_name string, source string, id long")
    return {r["row_id"]: r for r in resolve.resolve(spark.createDataFrame(rows, _ROWS), spark.createDataFrame(master, _MASTER), o).collect()}


def test_resolver_takes_the_best_name_and_falls_through(spark):
    master = [
        (1, "jonathan smithe", 1990, "ENG", "Red"), (2, "nathan smith", 1990, "ENG", "Blue"),
        (3, "Sam Roe", 1991, "ENG", "Old Town FC"), (4, "Sam Roe", 1991, "WAL", "Newport"), (5, "Sam Roe", 1991, "WAL", "Cardiff"),
        (6, "Ivo Kral", 1985, None, "Brno"), (7, "Petr Vlk", 1992, "CZE", None), (8, "Petr Vlk", 1993, "CZE", "Zlin"),
    ]
    rows = [
        (1, "jonathan smith", 1990, "ENG", None, "s"),  # 96.6 against 92.3: the best name wins
        (2, "Sam Roe", 1991, "ENG", None, "s"),  # one namesake of the nation
        (3, "Sam Roe", 1991, "WAL", "Newport County", "s"), (4, "Sam Roe", 1991, "WAL", "Newport", "s"),
        (5, "Sam Roe", 1991, "SCO", "Old Town", "s"),  # none of the nation: all namesakes, told apart by club
        (6, "Ivo Kral", 1985, "CZE", None, "s"),  # name and year alone
        (7, "Ivo Kralj", None, None, None, "s"),  # neither year nor nation: all of the master
        (8, "Petr Vlk", 1999, "CZE", "FC Zlin", "s"), (9, "Petr Vlk", 1999, "CZE", None, "s"),
        (10, "Sam Roe", 2001, "ISL", None, "s"),  # known, but no such block
        (11, "  vLK-petr ", None, "CZE", None, "t"), (12, "...", 1990, "ENG", None, "s"),
    ]
    got = _resolved(spark, master, rows, [("vlk petr", "t", 7), ("Sam Roe", "other", 3)])
    assert {k: (r["id"], r["method"]) for k, r in got.items()} == {
        1: (1, "fuzzy_nat"), 2: (3, "exact"), 3: (None, "unmatched"), 4: (4, "exact"), 5: (3, "exact_name_year"), 6: (6, "exact_name_year"), 7: (6, "fuzzy"),
        8: (8, "fuzzy_team"), 9: (None, "unmatched"), 10: (None, "unmatched"), 11: (7, "manual"), 12: (None, "unmatched"),
    }
    assert math.isclose(got[1]["score"], 2 * 14 / 29 * 100) and got[9]["score"] == 100.0 and got[9]["n_candidates"] == 2 and [c["id"] for c in got[9]["candidates"]] == [7, 8]
    a = {r["row_id"]: r for r in resolve.audit(spark.createDataFrame(rows, _ROWS), spark.createDataFrame(list(got.values()), resolve.resolve(spark.createDataFrame(rows, _ROWS), spark.createDataFrame(master, _MASTER)).schema)).collect()}
    assert (a[9]["candidate_ids"], a[9]["candidate_scores"], a[1]["input_norm_name"]) == ("7;8", "100.0;100.0", "jonathan smith")


def test_name_index_finds_every_pair_over_the_threshold():
    import random
    from collections import Counter

    from touchline.functions.similarity import token_set_ratio

    rng = random.Random(11)
    base = ["anna maria", "ban nam", "jon smith", "jonathan smithe", "li", "xu", "o neil", "van der berg", "aaaa aaa", "abcabcabc"]
    names = set(base)
    while len(names) < 260:
        x = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            k, op = rng.randrange(len(x) + 1), rng.randint(0, 2)
            x[k : k + (op > 0)] = rng.choice("abno ") if op < 2 else ""
        folded = " ".join("".join(x).split())
        if folded:
            names.add(folded)
    counts = Counter(p for n in names for p in resolve.letter_pairs(n))
    keys = {n: set(resolve.index_keys(n, counts, 85.0)) for n in names}
    hits = [(a, b) for a in names for b in names if token_set_ratio(a, b) >= 85.0]
    assert len(hits) > 400 and all(keys[a] & keys[b] for a, b in hits)


def test_only_names_that_may_be_alike_are_compared(spark, monkeypatch):
    import random
    from collections import Counter

    rng = random.Random(5)
    given = ["anna", "anna maria", "jo", "jon", "jonathan", "li", "aaaa aaaa", "bob bobby bobbo", "x1", "maria del mar"]
    family = ["smith", "smithe", "van der berg", "berg", "zuzuzuzuzu", "lopez lopez", "o", "quintana rivera", "smyth jones", "77"]
    family += ["".join(rng.choice("bdfgklprtv") + rng.choice("aeiou") for _ in range(4)) for _ in range(25)]
    names = sorted({" ".join(f"{g} {f}".replace(rng.choice("abimn"), rng.choice("aen"), rng.randint(0, 1)).split()) for g in given for f in family for _ in range(2)})
    counts = Counter(p for n in names for p in resolve.letter_pairs(n))
    want = {(a, b): token_set_ratio(a, b) for a in names for b in names if token_set_ratio(a, b) >= 85.0}
    compared = spark.sparkContext.accumulator(0)

    def counted(a, b):
        @F.pandas_udf("double")
        def run(x: pd.Series, y: pd.Series) -> pd.Series:
            compared.add(len(x))
            return pd.Series([token_set_ratio(p, q) for p, q in zip(x, y)], dtype="float64")

        return run.asNondeterministic()(a, b)

    monkeypatch.setattr(resolve, "similarity", counted)
    df = spark.createDataFrame([("b", n) for n in names], "block string, n string")
    met = df.select("block", "n"), df.select("block", F.col("n").alias("m_n"))
    got = {(r["n"], r["m_n"]): r["s"] for r in resolve.alike_pairs(*met, counts, 85.0).collect()}
    assert got == want and len(want) > 300
    keys = {n: set(resolve.index_keys(n, counts, 85.0)) for n in names}
    meet = sum(bool(keys[a] & keys[b]) for a in names for b in names)
    assert compared.value < 0.5 * meet
    assert resolve.letter_bits("b aaaab") == (7, resolve.letter_bits("b aaaab")[1], resolve.letter_bits("b aaaab")[2], 1)


def test_clubs_and_nationalities(spark):
    df = spark.createDataFrame([("Manchester Utd", "Manchester United FC"), ("Wolves", "Wolverhampton"), ("FC", "AFC"), ("Real Sporting", "Real Sportng"), ("Red", "Blue"), (None, "Red")], "a string, b string")
    got = [r[0] for r in df.select(resolve.clubs_match(X.club_key(F.col("a")), X.club_key(F.col("b")))).collect()]
    assert got == [True, True, False, True, False, False]
    c = spark.createDataFrame([("ENG",), ("England",), ("Turkiye",), ("cote d ivoire",), ("Nowhere",), (" ",), (None,)], "c string")
    n = X.nationality(F.col("c"), {"ENG": "England"}, ["England", "Turkey", "Côte d'Ivoire"], {"Turkiye": "Turkey"})
    assert [r[0] for r in c.select(n).collect()] == ["England", "England", "Turkey", "Côte d'Ivoire", None, None, None]
    with pytest.raises(ValueError, match="Atlantis"):
        X.require_targets({"ATL": "Atlantis"}, ["England"])


def test_resolver_query_reads_every_form_of_date_and_country(spark, tmp_path):
    born = ["2002-02-18", "18.02.2002", "2002-02-18 00:00:00", "Mar 10, 2002", "Mar 1, 2002"]
    land = ["Wadi Amr", "WADI AMR", "Île-Vervane", "Ile-Vervane", "ÎLE-VERVANE"]
    names = ["Ada Bek", "Cem Dor", "Eli Fay", "Gus Hol", "Ivo Jun"]
    code = {"w": "WAD", "i": "ILV", "î": "ILV"}
    master = [(k, n, b, c, "Red") for k, (n, b, c) in enumerate(zip(names, born, land))]
    # a namesake of another year, and one player by initials only, in a block of a year and nation
    master += [(10, "Cem Dor", "18.02.1990", "WADI AMR", "Red"), (11, "Nia Oz", "05.06.1999", "WADI AMR", None)]
    rows = [(k, n, 2002, code[land[k][0].lower()], "Red", "s") for k, n in enumerate(names)] + [(11, "N. Oz", 1999, "WAD", None, "s")]
    spark.createDataFrame(master, "tm_player_id long, player_name string, date_of_birth string, country_of_citizenship string, current_club_name string").write.parquet(f"{tmp_path}/tm_players.parquet")
    spark.createDataFrame([("WAD", "Wadi Amr"), ("ILV", "Île-Vervane")], "code string, country string").write.parquet(f"{tmp_path}/nationality_map.parquet")
    spark.createDataFrame(rows, "row_id long, player_name_fbref string, born int, nation string, club string, record_source string").write.parquet(f"{tmp_path}/unified_panel.parquet")
    got = {r["row_id"]: (r["id"], r["method"]) for r in reference.resolve_cascade(spark, str(tmp_path)).collect()}
    assert got == {k: (k, "exact") for k in range(5)} | {11: (11, "fuzzy_nat")}
    assert one(spark.range(1).select(X.year_of(F.lit("born 12345")).alias("y"), X.folded(F.lit("İÎ-ğ 1")).alias("f"))) == {"y": None, "f": "iig"}


def test_exact_median_against_sparks_own(spark):
    nan, inf = float("nan"), float("inf")
    for values in ([], [None], [3.0], [1.0, 2.0], [5.0, None, 1.0, 2.0], [0.0] * 50 + [1.0] * 50, [-inf, nan, 1.0], [nan, nan, 1.0], [2.0**k for k in range(-500, 500)], [float(k * k % 1009) for k in range(4001)]):
        df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
        want = df.agg(F.median("x")).first()[0]
        for margin, accuracy in ((1e-3, 10_000), (1e-9, 2), (0.5, 10)):  # bounds that may miss the middle, and such as hold everything
            got = stats.exact_median(df, F.col("x"), margin, accuracy)
            assert got == want or (want != want and got != got), (values[:5], margin)


def test_medians_of_errors_are_not_held_in_one_place(spark):
    df = spark.range(1, 6).select(F.col("id").cast("double").alias("y"), F.lit(2.0).alias("p"))
    scenario = stats.scenario_metrics(df, F.col("y"), F.col("p"))
    assert scenario.first()["median_ratio"] == 2 / 3
    money = inference.money_errors(df, F.log1p("y"), F.log1p("p"))
    assert round(money.first()["median_ae_eur"], 9) == 1.0
    for out in (scenario, money):
        plan = out._jdf.queryExecution().toString().lower()
        assert "median(" not in plan and "percentile(" not in plan
    none = df.filter("y < 0")
    assert stats.scenario_metrics(none, F.col("y"), F.col("p")).first()["median_ratio"] is None and inference.money_errors(none, F.col("y"), F.col("p")).first()["n"] == 0


# -- sources ---------------------------------------------------------------------------------------------------


def test_html_rows_and_names(spark):
    page = "<h2>Club &amp; Co</h2><table><tr><th>A</th></tr><tr><td> 1 <b>x</b></td><td></td></tr></table><table><tr><td>2</td></tr></table>"
    assert TF.html_rows(page) == [(0, "Club & Co", ["A"]), (0, "Club & Co", ["1 x", ""]), (1, "Club & Co", ["2"])]
    assert TF.html_rows(None) == [] and TF.html_rows("<p>no table") == []
    df = spark.createDataFrame([(1, page), (2, None)], "id long, html string")
    assert TF.html_table_rows(df, "id", "html").count() == 3
    assert [TF.plain_name(n) for n in ("% Won", "Gls/90", "+/-", "On-Off")] == ["pct_won", "gls_per_90", "plus_minus", "on_off"]
    assert TF.without_suffix_copies(["a", "a_dup", "b_dup"], ["_dup"]) == {"a": "a", "a_dup": None, "b_dup": "b"}


def test_csv_report_and_parquet(spark, tmp_path):
    from touchline.sources import tables

    (tmp_path / "m.csv").write_text("key,value\na,1\nb,2\n")
    assert {tuple(r) for r in TF.read_lookup(spark, str(tmp_path / "m.csv"), "key", "value").collect()} == {("a", "1"), ("b", "2")}
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    TF.write_report(df, str(tmp_path / "r.md"))
    assert (tmp_path / "r.md").read_text().splitlines()[2] == "| 1 | x |"
    tables.save_parquet(df, str(tmp_path / "deep/t.parquet"))
    assert tables.table(spark, str(tmp_path / "deep"), "t").count() == 1
    with pytest.raises(FileNotFoundError, match="no parquet table"):
        tables.table(spark, str(tmp_path), "gone")
    with pytest.raises(ValueError, match="clash"):
        TF.rename_columns(df, {"a": "z", "b": "z"})


# -- models ----------------------------------------------------------------------------------------------------


def test_models_fit(spark):
    rows = [(i, float(i % 7), float(i % 5), 2.0 * (i % 7) - (i % 5)) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, a double, b double, y double")
    alpha, m = models.grid_ridge(df, ["a", "b"], "y", "id", alphas=(0.01, 10.0))
    assert alpha == 0.01 and one(stats.regression_metrics(m.transform(df), F.col("y"), F.col("prediction")))["r2"] > 0.99
    with pytest.raises(ValueError, match="leak"):
        models.guard_leakage(["a", "next_a"], ["y"])
    assert models.numeric_features(df, ["id", "y"]) == ["a", "b"]
    iv = models.with_residual_interval(df.withColumn("p", F.lit(0.0)).withColumn("g", F.lit(1)), df.withColumn("p", F.lit(0.0)).withColumn("g", F.lit(1)), "y", "p", ["g"]).first()
    assert math.isclose(iv["ci_low"], np.percentile([r[3] for r in rows], 5)) and math.isclose(iv["ci_high"], np.percentile([r[3] for r in rows], 95))


# -- quality ---------------------------------------------------------------------------------------------------

RULES = [quality.ColumnRule("n", low=0, high=1000), quality.ColumnRule("t", pattern="[a-z]+")]


def _loads(spark, change=None, loads=15, rows=200):
    rng = random.Random(1)
    out = []
    for k in range(loads):
        for i in range(rows):
            n, t = rng.randint(100, 300), rng.choice(["full"] * 7 + ["basic"] * 3)
            if change and k == 7:
                n, t = change(i, n, t)
            out.append((k, n, t))
    return spark.createDataFrame(out, "load_id long, n int, t string")


@pytest.mark.parametrize(
    ("change", "want"),
    [
        (None, set()),
        (lambda i, n, t: (None if i % 5 == 0 else n, t), {("n", "null_rate")}),
        (lambda i, n, t: (-1 if i == 0 else n, t), {("n", "range")}),
        (lambda i, n, t: (n, "Full" if i < 3 else t), {("t", "pattern")}),
        (lambda i, n, t: (n + 100, t), {("n", "distribution")}),
        (lambda i, n, t: (100 + (n - 50) // 100 * 100, t), {("n", "distinct")}),
        (lambda i, n, t: (n, "legacy" if i < 10 else t), {("t", "distinct")}),
        (lambda i, n, t: (n, "basic" if i % 2 else t), {("t", "distribution")}),
    ],
)
def test_findings(spark, change, want):
    counts = quality.value_counts(_loads(spark, change), "x", "load_id", RULES)
    got = quality.findings(counts, RULES).collect()
    assert {(r["column_name"], r["finding"]) for r in got} == want
    assert {r["load_id"] for r in got} <= {7}


def test_findings_of_a_load_with_only_new_values(spark):
    for change in (lambda i, n, t: (n, "legacy"), lambda i, n, t: (n, "x" + chr(97 + i % 26) + chr(97 + i // 26))):
        counts = quality.value_counts(_loads(spark, change), "x", "load_id", RULES)
        assert {(r["load_id"], r["column_name"]) for r in quality.findings(counts, RULES).filter("finding = 'distinct'").collect()} == {(7, "t")}


def test_findings_of_a_change_of_spread_alone(spark):
    rng = np.random.default_rng(6)
    rows = [(load, float(round(x, 2))) for load in range(20) for x in rng.normal(100, 25 if load == 13 else 5, 400)]
    rules = [quality.ColumnRule("x")]
    df = spark.createDataFrame(rows, "load_id long, x double")
    got = {(r["load_id"], r["finding"]) for r in quality.findings(quality.value_counts(df, "t", "load_id", rules), rules).collect()}
    assert got == {(13, "distribution")}


def test_profile_by_sums_equals_profile_by_values(spark):
    big = 10**9
    df = spark.createDataFrame([(1, big + 1, "a"), (1, big + 3, "B"), (1, None, None), (2, big + 7, "a"), (None, 5, "a"), (1, big + 3, "c")], "load_id long, x long, s string")
    rules = [quality.ColumnRule("x", low=0, high=2.0 * big, origin=float(big)), quality.ColumnRule("s", pattern="[a-z]")]
    keys = ["load_id", "column_name", "n", "nulls", "pattern_violations", "range_violations", "distinct_values", "low", "high", "p0", "p1", "p2", "p3", "p4", "mean", "stddev"]
    a = sorted(map(str, quality.profile(df, "t", "load_id", rules).select(*keys).collect()))
    counts = quality.value_counts(df, "t", "load_id", rules)
    assert a == sorted(map(str, quality.profile_from_counts(counts, rules).select(*keys).collect()))
    halves = [quality.value_counts(df.filter(c), "t", "load_id", rules) for c in ("s = 'a'", "s is null or s <> 'a'")]
    assert a == sorted(map(str, quality.profile_from_counts(quality.merge_counts(halves), rules).select(*keys).collect()))
    one_load = [r for r in quality.profile(df, "t", "load_id", rules).collect() if r["load_id"] == 1 and r["column_name"] == "x"][0]
    assert (one_load["p1"], one_load["p2"], one_load["mean"]) == (7.0, 19.0, big + 7 / 3)


def test_profiles_merge_and_odd_tables(spark):
    df = _loads(spark, loads=3)
    a, b = df.filter("n % 2 = 0"), df.filter("n % 2 = 1")
    whole = {(r["load_id"], r["column_name"]): r for r in quality.profile(df, "x", "load_id", RULES).collect()}
    parts = quality.merge_profiles([quality.profile(p, "x", "load_id", RULES) for p in (a, b)]).collect()
    for p in parts:
        w = whole[(p["load_id"], p["column_name"])]
        assert p["n"] == w["n"] and p["low"] == w["low"] and (p["mean"] is None or math.isclose(p["mean"], w["mean"]) and math.isclose(p["stddev"], w["stddev"]))
    empty = df.filter("false")
    assert quality.findings(quality.value_counts(empty, "x", "load_id", RULES), RULES).count() == 0
    odd = spark.createDataFrame([(None, None, None), (None, 5, "x" * 100_000), (1, None, "")], "load_id long, n int, t string").withColumn("column_name", F.lit("clash")).withColumn("v", F.lit(1))
    got = {(r["load_id"], r["column_name"]): (r["nulls"], r["pattern_violations"]) for r in quality.profile(odd, "x", "load_id", RULES).collect()}
    assert got == {(None, "n"): (1, 0), (None, "t"): (1, 0), (1, "n"): (1, 0), (1, "t"): (0, 1)}
    assert {r["finding"] for r in quality.findings(quality.value_counts(odd, "x", "load_id", RULES), RULES).collect()} == {"pattern"}


# -- filling ---------------------------------------------------------------------------------------------------


def test_fill_numeric_beats_the_mean_on_held_out_cells(spark):
    rng = np.random.default_rng(2)
    effect = rng.normal(0, 5, 80)
    rows, truth = [], {}
    for i in range(1600):
        g, x, s = int(rng.integers(80)), float(rng.normal()), int(rng.integers(4))
        y = float(50 + 3 * x + effect[g] + s + rng.normal(0, 1))
        hide = bool(rng.random() < 0.2)
        truth[i] = (y, hide)
        rows.append((i, f"g{g}", s, x, -1.0 if hide and i % 2 else float("nan") if hide else y))
    df = spark.createDataFrame(rows, "row_id int, g string, s int, x double, y double")
    f = I.NumericField("y", low=0, high=200, covariates={"x": F.col("x")})
    got = {r["row_id"]: (r["y"], r["y__filled"]) for r in I.fill_numeric(df, [f], [["s"], ["g"]]).collect()}
    hidden = [i for i, (_, h) in truth.items() if h]
    assert {i for i, (_, m) in got.items() if m} == set(hidden)
    assert math.sqrt(np.mean([(got[i][0] - truth[i][0]) ** 2 for i in hidden])) < 1.4
    assert all(math.isclose(got[i][0], truth[i][0]) for i in truth if not truth[i][1])


def test_fill_numeric_odd_tables(spark):
    f = I.NumericField("y", low=0, high=10, refuted=F.col("z") > 5, eligible=F.col("e"), derived=F.col("d"))
    schema = "row_id int, g string, y double, z int, e boolean, d double, _y0 int"
    assert I.fill_numeric(spark.createDataFrame([], schema), [f], [["g"]]).count() == 0
    df = spark.createDataFrame([(1, None, None, None, True, None, 1), (2, "a", 4.0, 9, True, 2.5, 1), (3, "a", 99.0, None, None, None, 1), (4, "a", None, None, False, None, 1)], schema)
    got = {r["row_id"]: (r["y"], r["y__filled"]) for r in I.fill_numeric(df.drop("_y0"), [f], [["g"]]).collect()}
    assert got == {1: (0.0, True), 2: (2.5, True), 3: (None, False), 4: (None, False)}


def test_fill_numeric_takes_an_unknown_covariate_at_its_mean(spark):
    rows = [(i, "g", float(20 + i % 15), 40.0 + 3 * (20 + i % 15)) for i in range(150)] + [(900, "g", None, None), (901, "g", float("nan"), None), (902, "g", 30.0, None)]
    df = spark.createDataFrame(rows, "row_id int, g string, age double, y double")
    got = {r["row_id"]: r["y"] for r in I.fill_numeric(df, [I.NumericField("y", 0, 500, {"age": F.col("age")})], [["g"]]).collect()}
    assert math.isclose(got[900], 121.0, abs_tol=0.01) and math.isclose(got[901], 121.0, abs_tol=0.01) and math.isclose(got[902], 130.0, abs_tol=0.01)


def test_fill_numeric_fits_crossed_effects_together(spark):
    rng = np.random.default_rng(4)
    group, time = rng.normal(0, 6, 30), rng.normal(0, 4, 8)
    rows, truth = [], {}
    for i in range(3000):
        g = int(rng.integers(30))
        t = int(min(7, max(0, round(g / 4 + rng.normal()))))  # groups live in their own times, so single fits confuse the two
        y = 100 + group[g] + time[t] + rng.normal(0, 0.5)
        hide = rng.random() < 0.15
        truth[i] = (y, hide)
        rows.append((i, g, t, None if hide else float(y)))
    df = spark.createDataFrame(rows, "row_id int, g int, t int, y double")
    error = {}
    for sweeps in (1, 3):
        got = {r["row_id"]: r["y"] for r in I.fill_numeric(df, [I.NumericField("y", 0, 500)], [["t"], ["g"]], sweeps).collect()}
        error[sweeps] = math.sqrt(np.mean([(got[i] - y) ** 2 for i, (y, h) in truth.items() if h]))
    assert error[3] < 0.8 and error[3] < error[1]


def test_fill_category(spark):
    rows = [(i, "a", "full") for i in range(20)] + [(100, "a", None), (101, "b", "Basic"), (102, None, None)] + [(200 + i, "b", "basic") for i in range(9)]
    df = spark.createDataFrame(rows, "row_id int, g string, c string")
    got = {r["row_id"]: (r["c"], r["c__filled"]) for r in I.fill_category(df, I.CategoryField("c", "full|basic", [["g"]])).collect()}
    assert got[100] == ("full", True) and got[101] == ("basic", True) and got[102] == ("full", True) and got[0] == ("full", False)
    assert len(got) == len(rows)
    empty = I.fill_category(df.filter("false"), I.CategoryField("c", "full|basic", [["g"]]))
    assert empty.count() == 0
    with pytest.raises(ValueError, match="more than 1"):
        I.fill_category(df, I.CategoryField("c", "full|basic", [["g"]], most_classes=1))


def test_fill_category_by_group_and_time(spark):
    rows = [(i, g, t, c) for g, t, c, n in (("a", 1, "x", 8), ("a", 1, "y", 8), ("b", 2, "y", 60), ("b", 1, "x", 30), ("a", 2, "y", 6), ("a", 2, "x", 5)) for i in range(n)] + [(1, "a", 1, None), (2, "a", 2, None), (3, None, None, None), (4, "new", 1, "?")]
    df = spark.createDataFrame(rows, "row_id int, g string, t int, c string")
    got = [(r["g"], r["t"], r["c"]) for r in I.fill_category(df, I.CategoryField("c", "x|y", [["g"]], ["t"])).filter("c__filled").collect()]
    assert sorted(got, key=str) == sorted([("a", 1, "x"), ("a", 2, "y"), (None, None, "y"), ("new", 1, "x")], key=str)


def test_windowed_sums(spark):
    from touchline.streaming.windows import windowed_sums

    df = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:00:00", "a", 4.0)], "ts string, k string, v double")
    assert sorted((r["n"], r["total"]) for r in windowed_sums(df, "ts", "k", "v").collect()) == [(1, 4.0), (2, 3.0)]


def test_entry_has_sql_for_known_queries_only():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
