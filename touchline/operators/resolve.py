"""Resolving names against a master by a cascade of tiers; ambiguity gives no match, never a guess.

Rows are resolved once for each distinct (name, year, nation, team, source), and only those the exact tiers leave
open go on to the fuzzy one. There a row meets the master entries of its block through an inverted index: two
names that a token-set ratio could put over the threshold share a token, or else so many letter pairs that one of
them lies among each name's rarest. No row meets a whole block, and no pair over the threshold is lost.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.scalars import club_key, fold_name, initials
from touchline.functions.similarity import indel_ratio, token_set_ratio
from touchline.operators.joins import keep_first
from touchline.plans.lineage import cut


def similarity(a: Column, b: Column) -> Column:
    """Token-set ratio, 0 to 100, of two folded texts, where the plan has it: Spark moves no filter on it below an aggregation."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else token_set_ratio(p, q) for p, q in zip(x, y)], dtype="float64")

    return run.asNondeterministic()(a, b)


def clubs_match(a: Column, b: Column, least: float = 90.0) -> Column:
    """Whether two club keys mean one club: equal, or alike by ``least``; a missing or empty key matches none."""

    @F.pandas_udf("boolean")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([bool(p) and bool(q) and (p == q or indel_ratio(p, q) >= least) for p, q in zip(x, y)], dtype=bool)

    return run(a, b)


def letter_pairs(name: str) -> list[str]:
    """Neighbouring letters of the sorted tokens, the k-th copy of a pair marked as such."""
    text, seen = " ".join(sorted(set(name.split()))), Counter()
    out = []
    for i in range(len(text) - 1):
        pair = text[i : i + 2]
        out.append(f"{pair}{seen[pair] or ''}")
        seen[pair] += 1
    return out


def pairs_shared_at_least(size: int, least: float) -> int:
    """Letter pairs that a name of ``size`` letters shares with any other whose ratio reaches ``least``.

    A ratio of r leaves (1 - r) * (both sizes) letters to be lost on one side or put in on the other. A lost letter
    undoes two of the pairs of its side at most, one put in one of them, so the pairs of both sides together lose
    three for each.
    """
    r = least / 100.0
    fewest = float(size)
    for other in range(math.floor(size * r / (2 - r)), math.ceil(size * (2 - r) / r) + 1):
        changes = math.floor((1 - r) * (size + other) + 1e-9)
        fewest = min(fewest, (size + other) / 2 - 1 - 1.5 * changes)
    return math.ceil(fewest)


def index_keys(name: str, counts: Mapping[str, int], least: float) -> list[str]:
    """Keys under which a name is found: its tokens, and of its letter pairs the rarest that suffice.

    Of two sets that share t members, the (size - t + 1) rarest of each, in one order for both, share one.
    """
    keys = [f"t {t}" for t in set(name.split())]
    pairs = sorted(letter_pairs(name), key=lambda p: (counts.get(p, 0), p))
    shared = pairs_shared_at_least(len(pairs) + 1, least)
    kept = pairs if shared <= 1 else pairs[: len(pairs) - shared + 1]
    return keys + [f"p {p}" for p in kept]


#: Places of letters in ``letter_bits``; a folded name has no others.
_PLACES = {ch: k for k, ch in enumerate("abcdefghijklmnopqrstuvwxyz0123456789 ")}


def letter_bits(name: str) -> tuple[int, int, int, int]:
    """(size, low, high, over): letters of the sorted tokens; a bit for the first, second and third of each letter, and how many have none."""
    text, bits, over = " ".join(sorted(set(name.split()))), 0, 0
    for ch, n in Counter(text).items():
        place = _PLACES.get(ch)
        kept = min(n, 3) if place is not None else 0
        for k in range(kept):
            bits |= 1 << (k * len(_PLACES) + place)
        over += n - kept
    return len(text), bits & (1 << 62) - 1, bits >> 62, over


def letters_shared_at_most(a: Column, b: Column) -> Column:
    """Letters that two names of ``letter_bits`` have in common, or a few more: no common subsequence is longer."""
    both = lambda c: F.bit_count(a[c].bitwiseAND(b[c]))
    return both("low") + both("high") + F.least(a["over"], b["over"])


def _index_column(name: Column, counts: Mapping[str, int], least: float) -> Column:
    """struct<keys, bits>: ``index_keys`` and ``letter_bits`` of a name."""

    @F.pandas_udf("keys array<string>, size int, low bigint, high bigint, over int")
    def run(names: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(index_keys(n, counts, least), *letter_bits(n)) for n in names], columns=["keys", "size", "low", "high", "over"])

    return run(name)


def alike_pairs(asked: DataFrame, offered: DataFrame, counts: Mapping[str, int], least: float) -> DataFrame:
    """(block, n, m_n, s): pairs of names of a block with their token-set ratio, where it reaches ``least``.

    asked: block, n. offered: block, m_n; no row twice. A ratio is twice the letters in common over the letters of both
    sides; or, of the shared tokens against one side, twice theirs over theirs and that side's. Counts bound the
    first, and a pair meets once for each shared token, so that the second is known before a text is compared.
    """
    x = lambda df, name, to: df.withColumn(to, _index_column(F.col(name), counts, least)).select("block", name, F.explode(F.col(to)["keys"]).alias("k"), F.col(to).dropFields("keys").alias(to))
    a, b = F.col("_a"), F.col("_b")
    shared, fewer = letters_shared_at_most(a, b), F.least(a["size"], b["size"])
    token = F.col("k").startswith("t ")
    # a hair under the threshold, for the sake of rounding; the ratio itself decides
    alike = 200.0 * shared >= least * (a["size"] + b["size"]) - 1e-6
    within = lambda common: 200.0 * common >= least * (common + fewer) - 1e-6
    met = x(asked, "n", "_a").join(x(offered, "m_n", "_b"), ["block", "k"]).filter(alike | (token & within(shared)))
    pairs = met.groupBy("block", "n", "m_n").agg(F.max(alike).alias("alike"), F.max(fewer).alias("fewer"), F.sum(F.when(token, F.length("k") - 1)).alias("common"))
    # the shared tokens with a blank before each but the first
    common = F.coalesce(F.col("common"), F.lit(1)) - 1
    pairs = pairs.filter(F.col("alike") | (200.0 * common >= least * (common + F.col("fewer")) - 1e-6))
    return pairs.select("block", "n", "m_n", similarity(F.col("n"), F.col("m_n")).alias("s")).filter(F.col("s") >= least)


def _pair_counts(names: DataFrame) -> dict[str, int]:
    """Names that have each letter pair; names are letters, digits and blanks, so there are some 1,400 pairs and their copies."""

    @F.pandas_udf("array<string>")
    def run(n: pd.Series) -> pd.Series:
        return pd.Series([letter_pairs(x) for x in n], dtype=object)

    pairs = names.select(F.explode(run(F.col("m_n"))).alias("p")).filter(F.length("p") <= 3)
    return {r["p"]: r["n"] for r in pairs.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}


def _key(*columns: Column) -> Column:
    return F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns])


def _chosen(candidates: DataFrame, method: Column, team_method: Column, score: Column, tier: int) -> DataFrame:
    """(q, tier, id, method, score) where a query has one candidate, or several of which one is of its club."""
    per = candidates.groupBy("q").agg(
        F.count_distinct("m_id").alias("n"),
        F.count_distinct(F.when(F.col("club"), F.col("m_id"))).alias("n_club"),
        F.min("m_id").alias("one"),
        F.min(F.when(F.col("club"), F.col("m_id"))).alias("club_one"),
        F.max(score).alias("score"),
        F.max(method).alias("method"),
        F.max(team_method).alias("team_method"),
    )
    alone = F.col("n") == 1
    hit = per.filter(alone | (F.col("n_club") == 1))
    return hit.select("q", F.lit(tier).alias("tier"), F.when(alone, F.col("one")).otherwise(F.col("club_one")).alias("id"), F.when(alone, F.col("method")).otherwise(F.col("team_method")).alias("method"), "score")


def resolve(rows: DataFrame, master: DataFrame, overrides: DataFrame | None = None, least: float = 85.0, club_least: float = 90.0) -> DataFrame:
    """(row_id, id, method, score, n_candidates, candidates): each row's master id by the first tier that decides.

    rows: row_id, name, year, nation, team, source. master: id, name, year, nation, team. overrides: variant_name,
    source, id. Tiers: ``manual`` by the name as written or folded within its source (100); ``exact`` name, year and
    nation (100); ``exact_name_year`` (99), namesakes narrowed by nation and then by club; within the tightest block
    that the master has, (year, nation), nation, year, or all of it where the row knows neither: one entry of the same
    initials (90), else the entry of the name most alike, ``least`` at least (its score). The last two are
    ``fuzzy_nat`` where the row knows its nation, ``fuzzy`` where not, ``fuzzy_team`` where the club told
    namesakes apart. A tier that stays ambiguous leaves the row to the next; after the last it is ``unmatched``,
    with the best score seen and the namesakes as ``candidates`` (eight at most are listed, n_candidates counts all).

    Names equally alike: the first in order. An override of two ids decides nothing. Rows without letters in their
    name, and master entries without, match nothing but overrides. Repeated rows come out as often as they came in;
    other columns are not read; an empty side gives unmatched rows or none.
    """
    r = rows.select("row_id", "name", F.col("year").cast("int").alias("year"), "nation", "team", "source")
    r = r.withColumn("q", _key(*[F.col(c) for c in ("name", "year", "nation", "team", "source")]))
    queries = r.groupBy("q").agg(*[F.first(c).alias(c) for c in ("name", "year", "nation", "team", "source")])
    folded = F.coalesce(fold_name(F.col("name")), F.lit(""))
    queries = cut(queries.withColumns({"n": folded, "club_key": F.coalesce(club_key(F.col("team")), F.lit(""))}).withColumn("i", initials(F.col("n"))))
    m = master.select(F.col("id").alias("m_id"), F.col("name").alias("m_name"), F.col("year").cast("int").alias("m_year"), F.col("nation").alias("m_nation"), F.col("team").alias("m_team"))
    m = m.withColumns({"m_n": fold_name(F.col("m_name")), "m_club": F.coalesce(club_key(F.col("m_team")), F.lit(""))}).filter("m_n <> ''")
    m = cut(m.withColumn("m_i", initials(F.col("m_n"))).select("m_id", "m_n", "m_i", "m_year", "m_nation", "m_club"))
    club = clubs_match(F.col("club_key"), F.col("m_club"), club_least)

    # exact tiers: candidates by name and year
    exact = queries.filter("n <> ''").join(m, (F.col("n") == F.col("m_n")) & (F.col("year") == F.col("m_year"))).withColumn("club", club)
    same_nation = F.coalesce(F.col("nation") == F.col("m_nation"), F.lit(False))
    decided = [_chosen(exact.filter(same_nation), F.lit("exact"), F.lit("exact"), F.lit(100.0), 2)]
    # of namesakes those of the row's nation count, or all where none is of it or it is not known
    narrowed = exact.groupBy("q").agg(F.max(same_nation).alias("_has"), F.count_distinct("m_id").alias("_all"))
    kept = exact.join(narrowed, "q").filter((F.col("_all") == 1) | ~F.col("_has") | same_nation)
    decided.append(_chosen(kept, F.lit("exact_name_year"), F.lit("exact_name_year"), F.lit(99.0), 3))
    if overrides is not None:
        given = overrides.filter("variant_name <> '' and id is not null").select(F.col("variant_name").alias("o_name"), F.coalesce("source", F.lit("")).alias("o_source"), F.col("id").cast(m.schema["m_id"].dataType).alias("m_id"))
        spelled = given.select("o_source", "m_id", F.explode(F.array(F.concat(F.lit("="), "o_name"), F.concat(F.lit("~"), fold_name(F.col("o_name"))))).alias("o_key"))
        for tier, key in ((0, F.concat(F.lit("="), F.col("name"))), (1, F.concat(F.lit("~"), F.col("n")))):
            hit = queries.join(spelled, (key == F.col("o_key")) & (F.coalesce("source", F.lit("")) == F.col("o_source"))).withColumn("club", F.lit(False))
            decided.append(_chosen(hit, F.lit("manual"), F.lit("manual"), F.lit(100.0), tier))
    known = decided[0]
    for d in decided[1:]:
        known = known.unionByName(d)
    known = cut(keep_first(known, ["q"], [F.col("tier")]))

    # the tightest block the master has for each row that is still open
    left_open = queries.filter("n <> ''").join(known.select("q"), "q", "left_anti")
    years, nations = m.filter("m_year is not null").select(F.col("m_year").alias("_y")).distinct(), m.filter("m_nation is not null").select(F.col("m_nation").alias("_n")).distinct()
    both = m.filter("m_year is not null and m_nation is not null").select(F.col("m_year").alias("_by"), F.col("m_nation").alias("_bn")).distinct()
    left_open = left_open.join(both, (F.col("year") == F.col("_by")) & (F.col("nation") == F.col("_bn")), "left").join(nations, F.col("nation") == F.col("_n"), "left").join(years, F.col("year") == F.col("_y"), "left")
    block = (
        F.when(F.col("_by").isNotNull(), _key(F.lit("b"), F.col("year"), F.col("nation")))
        .when(F.col("_n").isNotNull(), _key(F.lit("n"), F.col("nation")))
        .when(F.col("_y").isNotNull(), _key(F.lit("y"), F.col("year")))
        .when(F.col("year").isNull() & F.col("nation").isNull(), F.lit("all"))
    )
    left_open = cut(left_open.withColumn("block", block).filter("block is not null").select("q", "n", "i", "nation", "club_key", "block"))
    in_blocks = F.array_compact(
        F.array(
            F.when(F.col("m_year").isNotNull() & F.col("m_nation").isNotNull(), _key(F.lit("b"), F.col("m_year"), F.col("m_nation"))),
            F.when(F.col("m_nation").isNotNull(), _key(F.lit("n"), F.col("m_nation"))),
            F.when(F.col("m_year").isNotNull(), _key(F.lit("y"), F.col("m_year"))),
            F.lit("all"),
        )
    )
    pool = m.withColumn("block", F.explode(in_blocks)).join(left_open.select("block").distinct(), "block", "left_semi")
    pool = cut(pool.select("block", "m_id", "m_n", "m_i", "m_club"))
    label = F.when(F.col("nation").isNotNull(), "fuzzy_nat").otherwise("fuzzy")
    by_initials = left_open.join(pool.withColumnRenamed("block", "m_block"), (F.col("block") == F.col("m_block")) & (F.col("i") == F.col("m_i"))).withColumn("club", club)
    short = _chosen(by_initials, label, F.lit("fuzzy_team"), F.lit(90.0), 4)

    # names alike: pairs of distinct names through the index, the best one of each, then its entries
    counts = _pair_counts(pool.select("m_n").distinct())
    asked, offered = left_open.select("block", "n").distinct(), pool.select("block", "m_n").distinct()
    met = alike_pairs(asked, offered, counts, least)
    best = met.groupBy("block", "n").agg(F.min_by(F.struct("m_n", "s"), F.struct((-F.col("s")).alias("s"), F.col("m_n").alias("m"))).alias("b")).select("block", "n", "b.m_n", "b.s")
    namesakes = cut(left_open.join(best, ["block", "n"]).join(pool.withColumnRenamed("block", "m_block"), (F.col("block") == F.col("m_block")) & (best["m_n"] == pool["m_n"])).select("q", "nation", "club_key", "m_id", "m_club", "s").withColumn("club", club))
    alike = _chosen(namesakes, label, F.lit("fuzzy_team"), F.col("s"), 5)
    seen = namesakes.groupBy("q").agg(F.count_distinct("m_id").alias("n_candidates"), F.max("s").alias("best"))
    listed = keep_ranked(namesakes.select("q", "m_id", "s").distinct(), 8)
    fuzzy = keep_first(short.unionByName(alike), ["q"], [F.col("tier")])
    final = known.unionByName(fuzzy)
    out = r.select("row_id", "q").join(final, "q", "left").join(seen, "q", "left").join(listed, "q", "left")
    by_name = F.coalesce(F.col("tier"), F.lit(9)) >= 5  # the candidates are those of the last tier
    return out.select(
        "row_id",
        "id",
        F.coalesce("method", F.lit("unmatched")).alias("method"),
        F.coalesce("score", "best", F.lit(0.0)).alias("score"),
        F.when(by_name, F.coalesce("n_candidates", F.lit(0))).otherwise(0).cast("long").alias("n_candidates"),
        F.when(by_name, F.col("candidates")).alias("candidates"),
    )


def keep_ranked(pairs: DataFrame, most: int) -> DataFrame:
    """(q, candidates): the first ``most`` (m_id, s) of each query by id; Spark drops the rest before it shuffles."""
    from pyspark.sql import Window

    ranked = pairs.withColumn("_k", F.row_number().over(Window.partitionBy("q").orderBy("m_id"))).filter(F.col("_k") <= most)
    return ranked.groupBy("q").agg(F.array_sort(F.collect_list(F.struct(F.col("m_id").alias("id"), F.col("s").alias("score")))).alias("candidates"))


def audit(rows: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row for each decision: what was asked, how the name was folded, what came out and which candidates there were."""
    asked = rows.select("row_id", "source", F.col("name").alias("input_name"), F.coalesce(fold_name(F.col("name")), F.lit("")).alias("input_norm_name"), F.col("year").alias("input_birth_year"), F.col("nation").alias("input_nationality"), F.col("team").alias("input_team"))
    each = lambda f: F.array_join(F.transform(F.coalesce("candidates", F.array().cast(resolved.schema["candidates"].dataType)), f), ";")
    return asked.join(resolved, "row_id").select(
        *asked.columns,
        F.col("id").alias("resolved_player_id"),
        "method",
        F.round("score", 2).alias("score"),
        each(lambda c: c["id"].cast("string")).alias("candidate_ids"),
        each(lambda c: F.format_string("%.1f", c["score"])).alias("candidate_scores"),
        "n_candidates",
    )
