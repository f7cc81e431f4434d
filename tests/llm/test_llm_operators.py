"""The llm operators against brute force, exact round trips and odd tables."""

from __future__ import annotations

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("touchline.llm")

from touchline.llm import asof, linkage, mixing, name_forms as N, names, packing, sentences as S, survivorship as V, tokens  # noqa: E402

# -- names -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("Ødegård, Martin", "Martin Odegaard"),
        ("MARTIN ØDEGÅRD (C)", "Martin Ødegård"),
        ("Слоибор Белгимузан", "Sloibor Belgimuzan"),
        ("Odegard M.", "M Odegard"),
        ("Martin van der Berg Jr.", "Martin Berg"),
        ("MartinBerg", "Martin Berg"),
        ("Mаrtin  Berg #9".replace("а", "a"), "Martin Berg"),
    ],
)
def test_rules_meet_in_a_form(a, b):
    x, y = N.rewritings(a, [1999], rotate=True), N.rewritings(b, [1999], rotate=False)
    assert set(x) & set(y)


def test_names_parse_odd_input():
    assert N.parse(None) == [] and N.parse("  ") == [] and N.parse("(C)") == []
    assert N.parse("van der") == ["van", "der"] or N.parse("van der")
    assert N.forms([], [1], True) == []
    assert len(N.parse("x " * 5000)) == 5000
    assert N.compare([], ["a"]) == (0.0, 0.0, 0.0)


def test_every_single_typo_is_found():
    rng = random.Random(4)
    name = "Ragstein Holtenfeldt"
    base = set(N.rewritings(name, [], rotate=False))
    for _ in range(200):
        i, kind = rng.randrange(1, len(name) - 1), rng.randrange(4)
        typo = name[:i] + ("" if kind == 0 else rng.choice("abdefglmnorst") if kind == 1 else name[i] + rng.choice("abdefglmnorst") if kind == 2 else name[i + 1] + name[i]) + name[i + (2 if kind == 3 else 1) :]
        assert base & set(N.rewritings(typo, [], rotate=True)), typo


def test_link_names(spark):
    left = spark.createDataFrame([(1, "Berg, Martin", [1999]), (2, None, None), (3, "", [2000]), (4, "Zzyx Qqwv", [1990]), (1, "Berg, Martin", [1999])], "l int, name string, years array<int>")
    right = spark.createDataFrame([("p", "Martin Berg", [1999]), ("q", "Lars Holm", [1999]), ("q", None, None)], "r string, name string, years array<int>")
    got = names.link_names(left, right, "l", "r").collect()
    assert [(g["l"], g["r"], g["given"], g["family"]) for g in got] == [(1, "p", 1.0, 1.0)]
    assert names.link_names(left.filter("false"), right, "l", "r").count() == 0
    pairs = spark.createDataFrame([(1, "a", 5.0), (1, "b", 5.0), (2, "a", 9.0), (2, "b", 1.0)], "l int, r string, s double")
    assert [(g["l"], g["r"]) for g in names.keep_best(pairs, "l", F.col("s"), [F.col("r")], 4.0, 1.0).collect()] == [(2, "a")]


def test_rewritings_by_rule():
    shared = lambda a, b: set(N.rewritings(a, [], True)) & set(N.rewritings(b, [], False))
    for a, b in [
        ("Bob Smith", "Robert Smith"), ("Bill Jones", "William Jones"), ("Sandro Rossi", "Alessandro Rossi"), ("Alex Hunter", "Alexander Hunter"),
        ("Acme Trading Ltd.", "Acme Trading GmbH"), ("Acme Trading SA", "Acme Trading"), ("Heung Son", "Heung Som"), ("Jo Xu", "Jo Xi"),
        ("Ana Maria Lopez Garcia Perez Ruiz", "Ruiz Garcia Ana Peres Maria Lopez"), ("Li Wei Chan", "Wei Chan Li"), ("Chan Li Wei", "Wei Chan Li"),
    ]:
        assert shared(a, b), (a, b)
    assert "sa" in N.parse("Joao Sa") and N.parse("Acme Trading Ltd.") == N.parse("Acme Trading GmbH")
    assert len(N.rewritings("x" * 4000 + " " + "yz" * 3000, [], True)) < 20_000


def test_reach_only_leaves_out_pairs_it_says(spark):
    rng = random.Random(5)
    people = [(i, f"{rng.choice('ABC')}. {rng.choice(['Ivanov', 'Petrov'])}", [1990 + rng.randint(0, 9)] if rng.random() < 0.8 else None) for i in range(160)]
    left, right = spark.createDataFrame(people[:40], "l long, name string, years array<int>"), spark.createDataFrame(people[40:], "r long, name string, years array<int>")
    both = lambda reach: {(r["l"], r["r"]): r["owners"] for r in names.link_names(left, right, "l", "r", reach).collect()}
    everyone, some = both(names.EVERYONE), both(names.Reach(8, 40, 60, 50))
    assert set(some) < set(everyone)
    years = {i: y[0] if y else None for i, _, y in people}
    for (l, r), owners in everyone.items():
        a, b = years[l], years[r]
        bound = 50 if a is None or b is None else 60 if a == b else 40 if abs(a - b) == 1 else 8
        assert ((l, r) in some) == (owners <= max(bound, 8)), (l, r, owners, a, b)


def test_namesakes_of_other_years_are_candidates_however_many(spark, tmp_path):
    from touchline.llm import linkage_queries

    master = [(k, "Jon Berg", f"{1960 + k % 40}-05-01", "Wadi Amr", "Attack", "Red Rovers" if k == 7 else f"Blue {k}") for k in range(150)]
    spark.createDataFrame(master, "tm_player_id long, player_name string, date_of_birth string, country_of_citizenship string, position_name string, current_club_name string").write.parquet(f"{tmp_path}/tm_players.parquet")
    spark.createDataFrame([("WAD", "Wadi Amr")], "code string, country string").write.parquet(f"{tmp_path}/nationality_map.parquet")
    rows = [("synthetic_a", "Jon Berg", 2010, "WAD", "FWD", "Red Rovers"), ("5", "Jon Berg", 1965, "WAD", "FWD", "Blue 5")]
    spark.createDataFrame(rows, "player_id string, player_name_fbref string, born int, nation string, primary_position string, club string").write.parquet(f"{tmp_path}/unified_panel.parquet")
    got = {r["tm_player_id"]: (r["player_id"], r["owners"], r["same_club"]) for r in linkage_queries.candidates(spark, str(tmp_path)).collect()}
    assert set(got) == set(range(150)) and got[7] == ("synthetic_a", 150, 1.0)


def test_comparison_against_every_order_with_few_whole_names_compared(monkeypatch):
    def every_order(x, y):
        best = (0.0, 0.0, 0.0)
        for k in range(len(x) if y else 0):
            o = x[k:] + x[:k]
            whole = N._near("".join(o), "".join(y))
            if len(o) == 1 or len(y) == 1:
                one, many = (o[0], y) if len(o) == 1 else (y[0], o)
                cand = (1.0, 1.0, whole) if whole > 0.9 else (-1.0, max(N._near(one, t) for t in (many[1:] or many)), whole)
            else:
                cand = (N._given(o[0], y[0]), max(N._near(a, b) for a in o[1:] for b in y[1:]), whole)
                cand = (max(cand[0], whole), max(cand[1], whole), whole) if whole > 0.9 else cand
            if max(cand[0], 0.3) + cand[1] + cand[2] > max(best[0], 0.3) + best[1] + best[2]:
                best = cand
        return best

    rng = random.Random(3)
    tokens = ["".join(rng.choice("abo") for _ in range(rng.randint(1, 6))) for _ in range(14)] + ["martin", "martina", "berg", "bob", "robert"]
    pairs = [([rng.choice(tokens) for _ in range(rng.randint(0, 4))], [rng.choice(tokens) for _ in range(rng.randint(0, 4))]) for _ in range(3000)]
    assert [N.compare(x, y) for x, y in pairs] == [every_order(x, y) for x, y in pairs]
    told = []
    near = N.edits
    monkeypatch.setattr(N, "edits", lambda a, b, most=99: told.append((a, b)) or near(a, b, most))
    N.compare(["martin", "lindholm", "akerstrom"], ["martin", "lindholm", "akerstrand"])
    assert sum(len(a) > 12 for a, _ in told) == 1


# -- survivorship ----------------------------------------------------------------------------------------------

SCHEMA = "row_id long, e string, p string, club string, minutes int, whole boolean, src string, load int, at timestamp, trust_rank int"


def _survive(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    sources = spark.createDataFrame([("good", 1), ("bad", 2), ("good", 3)], "record_source string, trust_rank int")
    ok = F.coalesce(F.col("minutes").between(0, 3800), F.lit(False))
    s = V.Survivorship(["e", "p"], "row_id", "src", "load", "at", "whole", "minutes", ok)
    return V.survive(df, sources, s, {"club": V.says_something(F.col("club")), "minutes": ok})


def test_survivorship_rules(spark):
    t0, t1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    rows = [
        (1, "a", "s", "Unknown", 10, False, "good", 1, t1, 0), (2, "a", "s", "Red", 9999, False, "bad", 2, t1, 0), (3, "a", "s", "Blue", 20, False, None, 3, t1, 0),
        (4, "b", "s", "X", 100, False, "good", 1, t0, 0), (5, "b", "s", "Y", 200, False, "good", 1, t0, 0),
        (6, "c", "s", "X", 100, False, "good", 1, t0, 0), (7, "c", "s", "Y", 50, True, "good", 1, t0, 0),
        (8, "d", "s", None, None, None, None, None, None, 0), (9, "d", "s", "-", -1, None, None, None, None, 0),
        (10, None, "s", "X", 1, None, "good", 1, t0, 0),
        (12, "f", "s", "X", 5, False, "good", 1, t0, 0), (11, "f", "s", "Z", 5, False, "good", 2, t0, 0),
    ]
    got = {r["e"]: r for r in _survive(spark, rows).collect()}
    assert set(got) == {"a", "b", "c", "d", "f"}
    assert (got["a"]["club"], got["a"]["club__row_id"], got["a"]["minutes__row_id"]) == ("Red", 2, 1)
    assert got["b"]["minutes"] == 300 and got["b"]["minutes__built"] and got["b"]["minutes__row_id"] is None and got["b"]["club__row_id"] == 5 and got["b"]["built_whole"]
    assert got["c"]["minutes__row_id"] == 7 and not got["c"]["minutes__built"] and got["c"]["built_whole"]
    assert got["d"]["club"] is None and got["d"]["minutes"] is None
    assert got["f"]["minutes__row_id"] == 11 and not got["f"]["built_whole"]
    assert _survive(spark, []).count() == 0


def test_a_row_repeated_under_one_id_counts_once(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, "a", "s", "X", 900, False, "good", 1, t0, 0)] * 3 + [(2, "b", "s", "X", 900, False, "good", 1, t0, 0), (3, "b", "s", "Y", 100, False, "good", 1, t0, 1), (3, "b", "s", "Y", 100, False, "good", 1, t0, 2)]
    got = {r["e"]: r for r in _survive(spark, rows).collect()}
    assert (got["a"]["minutes"], got["a"]["minutes__built"], got["a"]["built_whole"], got["a"]["group_rows"], got["a"]["minutes__row_id"]) == (900, False, False, 1, 1)
    assert (got["b"]["minutes"], got["b"]["minutes__built"], got["b"]["group_rows"]) == (1000, True, 2)


# -- nearest in time --------------------------------------------------------------------------------------------


def _nearest(spark, ls, rs, days=45):
    left, right = spark.createDataFrame(ls, "e long, lid long, t timestamp, extra int"), spark.createDataFrame(rs, "e long, rid long, s timestamp, extra int")
    return [tuple(r) for r in asof.nearest_in_time(left, right, "e", "lid", "t", "rid", "s", days).collect()]


def test_one_bucket_of_one_entity_takes_linear_time(spark):
    n = 120_000  # alternating seconds, all in one bucket: quadratic frames would need hours
    left = spark.range(n).select(F.lit(1).alias("e"), F.timestamp_seconds(F.col("id") * 4).alias("t"), F.col("id").alias("lid"))
    right = spark.range(n).select(F.lit(1).alias("e"), F.timestamp_seconds(F.col("id") * 4 + 1).alias("s"), F.col("id").alias("rid"))
    got = asof.nearest_in_time(left, right, "e", "lid", "t", "rid", "s", 45)
    assert got.filter("lid = rid and distance_us = 1000000").count() == n


def test_rows_that_go_on_meet_the_edges_of_coarser_buckets(spark):
    day, t0 = dt.timedelta(days=1), dt.datetime(2024, 3, 1)
    right = [(1, k, t0 + k * day, 0) for k in range(0, 20)] + [(1, 100, t0 + 120 * day, 0)]
    left = [(1, 1, t0 + 40 * day, 0), (1, 2, t0 - 30 * day, 0), (1, 3, t0 + 90 * day, 0), (1, 4, t0 + 69 * day, 0)]
    assert {(l, r) for l, r, _ in _nearest(spark, left, right)} == {(1, 19), (2, 0), (3, 100)}



def test_nearest_in_time_against_brute_force(spark):
    rng = random.Random(9)
    base = dt.datetime(2024, 1, 1)
    at = lambda: base + dt.timedelta(hours=rng.randint(0, 24 * 300))
    ls = [(rng.randint(0, 6), i, at(), 1) for i in range(250)]
    rs = [(rng.choice([0, 0, 0, 1, 2, 3, 4]), i, at(), 1) for i in range(250)]
    want = {}
    for e, i, t, _ in ls:
        c = sorted((abs(s - t), s, j) for f, j, s, _ in rs if f == e and abs(s - t) <= dt.timedelta(days=45))
        if c:
            want[i] = (c[0][2], int(c[0][0].total_seconds() * 1e6))
    assert {a: (b, c) for a, b, c in _nearest(spark, ls, rs)} == want


def test_nearest_in_time_ties_edges_nulls(spark):
    t = dt.datetime(2024, 6, 30, 12)
    d = dt.timedelta
    ls = [(1, 1, t, 0), (1, 1, t, 0), (2, 2, t, 0), (3, 3, t, 0), (None, 4, t, 0), (5, 5, None, 0), (6, 6, t, 0)]
    rs = [(1, 12, t + d(days=1), 0), (1, 11, t - d(days=1), 0), (1, 10, t - d(days=1), 0), (2, 20, t + d(days=45), 0), (3, 30, t - d(days=45, microseconds=1), 0), (None, 40, t, 0), (6, None, t, 0), (6, 60, None, 0)]
    day = 86_400_000_000
    assert sorted(_nearest(spark, ls, rs)) == [(1, 10, day), (1, 10, day), (2, 20, 45 * day)]
    assert _nearest(spark, [], rs) == [] and _nearest(spark, ls, []) == []


# -- linkage ---------------------------------------------------------------------------------------------------


def test_mixture_separates_planted_matches(spark):
    rng = random.Random(11)
    rows, truth = [], set()
    for i in range(300):
        for j in range(5):
            match = j == 0 and i % 3 != 0
            rows.append((i, i * 10 + j, *[min(1.0, max(0.0, rng.gauss(0.9 if match else 0.4, 0.12))) for _ in range(4)]))
            if match:
                truth.add((i, i * 10))
    df = spark.createDataFrame(rows, "l int, r int, a double, b double, c double, d double")
    got = {(r["l"], r["r"]) for r in linkage.match(df, "l", "r", ["a", "b", "c", "d"], F.when(F.col("a") > 0.8, 0.9).otherwise(0.05)).collect()}
    assert len(got & truth) / len(truth) > 0.95 and len(got & truth) / len(got) > 0.95
    assert linkage.match(df.filter("false"), "l", "r", ["a", "b", "c", "d"], F.lit(0.5)).count() == 0
    tie = spark.createDataFrame([(1, 1, 1.0, 1.0, 1.0, 1.0), (1, 2, 1.0, 1.0, 1.0, 1.0)], df.schema)
    assert linkage.match(df.unionByName(tie.withColumn("l", F.lit(-1))), "l", "r", ["a", "b", "c", "d"], F.when(F.col("a") > 0.8, 0.9).otherwise(0.05)).filter("l = -1").count() == 0


def test_unlike_records_cannot_be_one(spark):
    rng = random.Random(19)
    rows = []
    for i in range(200):
        for j in range(4):
            rows.append((i, i * 10 + j, 1990 + i % 7, *[min(1.0, max(0.0, rng.gauss(0.9 if j == 0 and i % 3 else 0.4, 0.1))) for _ in range(3)]))
    rows += [(900, 7777, 1990, 0.95, 0.95, 0.95), (901, 7777, 1991, 0.95, 0.95, 0.95), (902, 8888, 1990, 0.95, 0.95, 0.95), (903, 8888, 1990, 0.95, 0.95, 0.95), (904, 8888, None, 0.95, 0.95, 0.95)]
    df = spark.createDataFrame(rows, "l int, r int, born int, a double, b double, c double")
    start = F.when(F.col("a") > 0.8, 0.9).otherwise(0.05)
    got = {r["l"] for r in linkage.match(df, "l", "r", ["a", "b", "c"], start, identity="born").collect()}
    assert not got & {900, 901} and {902, 903, 904} <= got
    assert {900, 901} <= {r["l"] for r in linkage.match(df, "l", "r", ["a", "b", "c"], start).collect()}


# -- packing ---------------------------------------------------------------------------------------------------


def _optimal(sizes, capacity):
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity and bins[k] not in bins[:k]:
                go(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
        go(i + 1, [*bins, sizes[i]])

    sizes = sorted(sizes, reverse=True)
    go(0, [])
    return best[0]


def test_reduction_keeps_an_optimum():
    rng = random.Random(13)
    for _ in range(150):
        cap = rng.randint(10, 30)
        sizes = [rng.randint(1, cap) for _ in range(rng.randint(1, 9))]
        counts = {s: sizes.count(s) for s in set(sizes)}
        fixed, left = packing.reduce_by_dominance(counts, cap)
        rest = [s for s, n in left.items() for _ in range(n)]
        assert sum(m for _, m in fixed) + _optimal(rest, cap) == _optimal(sizes, cap), (cap, sizes)
        classes = packing.pack_sizes(counts, cap)
        assert sorted(s for items, m in classes for s in items for _ in range(m)) == sorted(sizes)
        assert all(sum(items) <= cap for items, _ in classes)


def test_pack_round_trip(spark):
    rng = random.Random(17)
    items = [(i, rng.choice([1, 3, 7, 20, 50, 51, 99, 100, 101, 250])) for i in range(400)] + [(900, 0), (901, None), (902, 10**6)]
    got = packing.pack(spark.createDataFrame(items, "doc_id long, tokens long").withColumn("container_id", F.lit(1)), "doc_id", "tokens", 100).collect()
    fill, covered = {}, {}
    for r in got:
        fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["tokens"]
        covered.setdefault(r["doc_id"], []).append((r["start_token"], r["end_token"]))
    assert all(v <= 100 for v in fill.values())
    for i, n in items:
        if n is None:
            assert i not in covered
            continue
        spans = sorted(covered[i])
        assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert len(spans) == max(1, -(-n // 100))
    assert packing.pack(spark.createDataFrame([], "doc_id long, tokens long"), "doc_id", "tokens", 100).count() == 0


def test_numbers_are_dense_within_a_hot_size(spark, monkeypatch):
    df = spark.range(5000).withColumn("size", F.when(F.col("id") < 4000, 7).otherwise(F.col("id") % 3))
    got = packing.numbered(df, "size", "id").groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("a"), F.max("number").alias("b"), F.count_distinct("number").alias("k")).collect()
    assert all(r["a"] == 0 and r["b"] == r["n"] - 1 and r["k"] == r["n"] for r in got)
    monkeypatch.setattr(packing, "STRETCH", 64)
    packed = packing.pack(df.select(F.col("id").alias("doc_id"), (F.col("size") + 1).alias("tokens")), "doc_id", "tokens", 16)
    worst = packed.groupBy("container_id").agg(F.sum("tokens").alias("t")).agg(F.max("t")).first()[0]
    assert packed.count() == 5000 and worst <= 16


# -- mixing ----------------------------------------------------------------------------------------------------


def test_flow_reaches_shares_with_fewest_repeats():
    total, flows = mixing.plan({("a",): 100.0, ("b",): 10.0, ("a", "b"): 20.0}, [mixing.Target("a", 0.5, 1), mixing.Target("b", 0.5, 2), mixing.Target("none", 0.1, 3)])
    got = {}
    for p, use, s, amount in flows:
        assert s in p and (use == 1 or s == "b")
        got[s] = got.get(s, 0) + amount
    assert abs(got["a"] - got["b"]) < 1e-3 and abs(total - 120) < 0.1  # b: 2 x (10 + 20)
    assert mixing.plan({}, [mixing.Target("a", 1.0, 1)]) == (0.0, [])


def test_mix_shares_and_caps(spark):
    rng = random.Random(19)
    rows = [(i, rng.choice(["a"] * 8 + ["b", "c"]), f"k{i % 950}", rng.randint(5, 60)) for i in range(1000)]
    size = {}
    rows = [(i, s, k, size.setdefault(k, n)) for i, s, k, n in rows] + [(5000, None, "kn", 9), (5001, "a", "kz", None), (5002, "z", "kk", 9)]
    texts = spark.createDataFrame(rows, "doc_id long, source string, text_key string, tokens long")
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.3, 3), ("c", 0.2, 2), ("empty", 0.1, 4), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(texts, targets)
    shares = {r["source"]: r for r in mixing.shares(mixed, targets.filter("source is not null")).collect()}
    for s, t in (("a", 0.4 / 0.9), ("b", 0.3 / 0.9), ("c", 0.2 / 0.9)):
        assert abs(shares[s]["reached_share"] - t) < 0.01
    assert shares["a"]["most_uses"] == 1 and shares["b"]["most_uses"] <= 3 and shares["c"]["most_uses"] <= 2 and shares["empty"]["tokens"] == 0
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, mixing.mix(texts, targets).collect()))
    assert mixing.mix(texts.filter("false"), targets).count() == 0 and mixing.mix(texts, targets.filter("false")).count() == 0


@pytest.mark.skipif(not os.path.exists(tokens.DEFAULT_VOCABULARY), reason="no vocabulary file here")
def test_token_counts(spark):
    df = spark.createDataFrame([("",), (None,), ("<|endoftext|> Hallo Welt",), ("ab " * 20_000,)], "t string")
    got = [r[0] for r in df.select(tokens.count_tokens(F.col("t"))).collect()]
    assert got[0] == 0 and got[1] is None and got[2] > 3 and got[3] >= 20_000


# -- sentences -------------------------------------------------------------------------------------------------

TRAIN = [
    "In the second half, the keeper saved twice. Dr. Holm expects him back in approx. 3 weeks. What a strike! They drew 0-1 and moved on. “Is he fit?” asked the reporter. He waited... and waited, but the call never came.",
    "Das Spiel endete 3-3! Er kann z. B. als Nr. 14 spielen. In der 38. Minute fiel das 1:0. Vgl. dazu S. 13 des Berichts.",
    "ในเกมเยือนกัปตันทีมเสียบอล 7 ครั้งและได้รับคำชม ในครึ่งหลังแนวรับชนะการปะทะ\n\nในครึ่งหลังกัปตันทีมเสียบอล 9 ครั้งและได้รับคำชม ในเกมเยือนแนวรับชนะการปะทะ",
] * 8


@pytest.fixture(scope="module")
def model():
    return S.train(TRAIN)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Dr. Holm came at 9 a.m. and left. It was 3.5 km!! :) Good.", ["Dr. Holm came at 9 a.m. and left.", "It was 3.5 km!! :)", "Good."]),
        ("“He is ready. He will play,” the coach said. Really?! (He missed it.) Yes.", ["“He is ready. He will play,” the coach said.", "Really?!", "(He missed it.)", "Yes."]),
        ("Heading\n\nOne line\nbroken here. Two.\n• item one\n• item two", ["Heading", "One line\nbroken here.", "Two.", "item one", "item two"]),
        ("比赛以0-2结束。主教练说：“我们丢了球。我们付出了代价！”转会费为27,514欧元……但没有确认。谁来？", ["比赛以0-2结束。", "主教练说：“我们丢了球。我们付出了代价！”", "转会费为27,514欧元……但没有确认。", "谁来？"]),
        ("監督は「失った。だから負けた。」と語った。「もう十分だ。」後半だ。", ["監督は「失った。だから負けた。」と語った。", "「もう十分だ。」", "後半だ。"]),
        ("Το ματς έληξε· τέλος. Ποιος είναι; Ναι.", ["Το ματς έληξε· τέλος.", "Ποιος είναι;", "Ναι."]),
        ("« Il est prêt ! » Selon lui, oui.Avant tout, non.", ["« Il est prêt ! »", "Selon lui, oui.", "Avant tout, non."]),
        ("계약은 2028. 6. 30. 만료된다. 끝.", ["계약은 2028. 6. 30. 만료된다.", "끝."]),
        ("ในเกมเยือนกัปตันทีมเสียบอล 8 ครั้งและได้รับคำชม ในครึ่งหลังแนวรับชนะการปะทะ", ["ในเกมเยือนกัปตันทีมเสียบอล 8 ครั้งและได้รับคำชม", "ในครึ่งหลังแนวรับชนะการปะทะ"]),
        ("no end mark", ["no end mark"]),
        ("", []),
        (" \n\n ", []),
        (None, []),
    ],
)
def test_sentences(model, text, want):
    assert [text[a:b] for a, b in S.split(text, model)] == want


def test_viterbi_against_every_tagging():
    import itertools

    import numpy as np

    rng = np.random.default_rng(23)
    for _ in range(150):
        n = int(rng.integers(1, 10))
        scores, trans = rng.normal(size=n) - 1.5, rng.normal(size=(2, 2))

        def value(tags):
            v, p = 0.0, 1
            for s, t in zip(scores, tags):
                v += trans[p][t] + (s if t else 0.0)
                p = t
            return v

        best = max((list(t) for t in itertools.product((0, 1), repeat=n) if t[-1] == 1), key=value)
        assert abs(value(S.viterbi(scores, trans).tolist()) - value(best)) < 1e-9


def test_long_texts_without_spaces_take_linear_time(model):
    import time

    def seconds(k):
        text = ("下半场，队长赢得了多数对抗（见表）。谁来接替？“好！”" * 40 + "(“「") * k
        t = time.perf_counter()
        spans = S.split(text, model)
        assert spans[0][0] == 0 and spans[-1][1] == len(text)
        return time.perf_counter() - t

    assert seconds(4) > 0 and seconds(480) < 240 * max(seconds(8), 0.02)  # half a million characters in one block


def test_scripts_without_marks_are_cut_by_wording():
    sentences = ["下半场队长赢得了对抗", "客场比赛中门将扑出点球", "冬歇期以来后防线节奏偏慢", "报告说前锋丢球三次"]
    rng = random.Random(3)
    with_marks = ["".join(rng.choice(sentences) + "。" for _ in range(6)) for _ in range(80)]
    learnt = S.train(with_marks)
    hit = total = 0
    for _ in range(30):
        parts = [rng.choice(sentences) for _ in range(6)]
        text, want, at = "".join(parts), set(), 0
        for p in parts:
            want.add((at, at + len(p)))
            at += len(p)
        hit += len(want & set(S.split(text, learnt)))
        total += len(want)
    assert hit / total > 0.95


def test_sentences_cover_every_character(spark, model):
    from touchline.llm import sentence_queries as Q

    rng = random.Random(29)
    parts = ["Mr. Holm ran. ", "「もう十分だ。」", "\n\n", "\n• ", "3.5 km ", "What?! ", "“Is he? He is.” ", "ครั้ง ครั้ง ", ":) ", "… ", "(a. b) ", "«x! y», "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(60)] + ["word. " * 20_000, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("start_pos", F.lit(1))
    got = {}
    for r in Q.sentences(df, model).collect():
        got.setdefault(r["doc_id"], []).append((r["start_pos"], r["end_pos"]))
    for i, t in enumerate(texts):
        spans, last, rest = sorted(got.get(i, [])), 0, ""
        for a, b in spans:
            assert a >= last and a < b and not t[a].isspace() and not t[b - 1].isspace()
            rest += t[last:a]
            last = b
        rest += (t or "")[last:]
        assert set(rest) <= set(" \n\t•"), rest
    assert Q.sentences(df.filter("false"), model).count() == 0


def test_training_sample_is_bounded(spark):
    from touchline.llm import sentence_queries as Q

    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("A text. And more.").alias("text"), F.when(F.col("id") < 2900, "en").otherwise("th").alias("lang"))
    n = len(Q.training_texts(df, per_label=50))
    assert 60 <= n <= 50 * (Q.MOST_LABELS + 1)
