"""Linking variant spellings: rewriting, equi-join, scores by rarity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm import name_forms as N
from touchline.plans.lineage import cut


#: Stands for the year of those whose year is unknown.
UNKNOWN = -1


def exploded_forms(df: DataFrame, key: str, name: str, years: str, rotate: bool) -> DataFrame:
    """(key, h) for every distinct rewriting of a key's names; h is the rewriting's 64-bit hash.

    Only the rewritings of keys with several rows are shuffled to be told apart; most keys have one.
    """
    rows = df.filter(F.col(name).isNotNull()).withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(key)))

    def hashes(part: DataFrame) -> DataFrame:
        each = F.transform(N.forms_column(F.col(name), F.col(years), rotate), lambda f: F.xxhash64(f))
        return part.select(key, F.explode(F.array_distinct(each)).alias("h"))

    return hashes(rows.filter("_rows = 1")).unionByName(hashes(rows.filter("_rows > 1")).distinct())


@dataclass(frozen=True)
class Reach:
    """Owners up to which a shared rewriting alone makes a pair a candidate, by what the years of birth say about the pair.

    A rewriting that more entities own says less than the decision needs, whatever else agrees: the caller derives
    the bounds from its own score, so that no pair that could be decided for is left out. None: no bound.
    """

    any_year: float
    near_year: float
    same_year: float | None = None
    unknown_year: float | None = None


#: Any number of owners may share a rewriting.
EVERYONE = Reach(float(2**62), float(2**62))


def _at_most(bound: float | None) -> Column:
    return F.lit(True) if bound is None else F.col("df") <= bound


def rewriting_pairs(left_forms: DataFrame, right_forms: DataFrame, left_years: DataFrame, right_years: DataFrame, left_key: str, right_key: str, n_right: int, reach: Reach) -> DataFrame:
    """(left_key, right_key, rarity, owners, shared): pairs that share a rewriting within ``reach``.

    left_years, right_years: a row for each key with ``years``, its possible years of birth, empty where none is known.
    owners: right entities that have the rarest rewriting shared; rarity: log2(all right entities / owners). Where the
    reach is bounded, a common rewriting is joined together with a year, so that neither its owners nor their pairs meet in one place. Rewritings
    are counted where those of both sides meet, and only those both sides have go on to be joined. A name has some hundred
    rewritings, which size estimates don't know: every join asks for a sort-merge, never a broadcast.
    """
    none = {c: F.lit(None).cast(f.schema[c].dataType).alias(c) for f, c in ((left_forms, left_key), (right_forms, right_key))}
    met = left_forms.select("h", left_key, none[right_key]).unionByName(right_forms.select("h", none[left_key], right_key))
    w = Window.partitionBy("h")
    met = met.withColumns({"_asked": F.count(left_key).over(w), "df": F.count(right_key).over(w)}).filter((F.col("_asked") > 0) & (F.col("df") > 0))
    met = cut(met.select("h", left_key, right_key, "df"))
    left, right = met.filter(F.col(left_key).isNotNull()).select("h", left_key, "df"), met.filter(F.col(right_key).isNotNull()).select("h", right_key)
    if reach == EVERYONE:
        pairs = left.join(right.hint("merge"), "h").select(left_key, right_key, "df")
        return _by_pair(pairs, left_key, right_key, n_right)
    rare, common = left.filter(F.col("df") <= reach.any_year), left.filter(F.col("df") > reach.any_year)
    pairs = rare.join(right.hint("merge"), "h").select(left_key, right_key, "df")
    dated = common.join(left_years.hint("merge"), left_key)
    near = F.array_distinct(F.flatten(F.transform("years", lambda y: F.array(y - 1, y, y + 1))))
    years = F.when(F.col("df") <= reach.near_year, near).when(_at_most(reach.same_year), F.col("years")).otherwise(F.array().cast("array<int>"))
    asked = F.concat(years, F.when(_at_most(reach.unknown_year), F.array(F.lit(UNKNOWN))).otherwise(F.array().cast("array<int>")))
    dated_left = dated.filter(F.size("years") > 0).select("h", left_key, "df", F.explode(asked).alias("y"))
    common_right = right.join(common.select("h").distinct().hint("merge"), "h", "left_semi").join(right_years.hint("merge"), right_key)
    dated_right = common_right.select("h", right_key, F.explode(F.when(F.size("years") > 0, F.col("years")).otherwise(F.array(F.lit(UNKNOWN)))).alias("y"))
    pairs = pairs.unionByName(dated_left.join(dated_right.hint("merge"), ["h", "y"]).select(left_key, right_key, "df"))
    undated = dated.filter((F.size("years") == 0) & _at_most(reach.unknown_year)).select("h", left_key, "df")
    pairs = pairs.unionByName(undated.join(right.hint("merge"), "h").select(left_key, right_key, "df"))
    return _by_pair(pairs, left_key, right_key, n_right)


def _by_pair(met: DataFrame, left_key: str, right_key: str, n_right: int) -> DataFrame:
    """A row for each pair out of one for each rewriting it shares."""
    bits = F.log2(F.lit(float(max(n_right, 1))) / F.col("df"))
    return met.groupBy(left_key, right_key).agg(F.max(bits).alias("rarity"), F.min("df").alias("owners"), F.count(F.lit(1)).alias("shared"))


def keep_best(pairs: DataFrame, left: str, score: Column, order: list[Column], least: float, margin: float) -> DataFrame:
    """The best right record of each left one, where it reaches ``least`` and leads the next by ``margin``; a tie is no match."""
    w = Window.partitionBy(left).orderBy(F.col("score").desc(), *order)
    ranked = pairs.withColumn("score", score).withColumns({"n": F.row_number().over(w), "next": F.lead("score").over(w)})
    return ranked.filter((F.col("n") == 1) & (F.col("score") >= least) & (F.col("next").isNull() | (F.col("score") - F.col("next") >= margin)))


def _years(df: DataFrame, key: str) -> DataFrame:
    """(key, years): every possible year of a key; a key has few."""
    return df.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_set(F.coalesce(F.col("years"), F.array().cast("array<int>"))))).alias("years"))


def candidate_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str, reach: Reach = EVERYONE) -> DataFrame:
    """(left_key, right_key, rarity, owners, shared): keys of which two spellings share a rewriting within ``reach``.

    left and right have their key, ``name`` and ``years`` (array<int> of possible years of birth, may be null);
    a key may have several rows, one for each spelling. Null and blank names have no rewriting and no pair.
    """
    ls = left.select(left_key, "name", "years").distinct()
    rs = right.select(right_key, "name", "years").distinct()
    lf = exploded_forms(ls, left_key, "name", "years", rotate=True)
    rf = exploded_forms(rs, right_key, "name", "years", rotate=False)
    n_right = rs.agg(F.count_distinct(right_key)).first()[0]
    return rewriting_pairs(lf, rf, _years(ls, left_key), _years(rs, right_key), left_key, right_key, n_right, reach)


def with_spellings(pairs: DataFrame, left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """``pairs`` with left_name, right_name, given, family, whole: of the spellings of the pair those that agree best."""
    ln = left.select(left_key, F.col("name").alias("left_name")).distinct()
    rn = right.select(right_key, F.col("name").alias("right_name")).distinct()
    rest = [c for c in pairs.columns if c not in (left_key, right_key)]
    spelled = pairs.join(ln.hint("merge"), left_key).join(rn.hint("merge"), right_key)
    spelled = spelled.withColumn("c", N.compare_columns(F.col("left_name"), F.col("right_name")))
    total = F.greatest(F.col("c.given"), F.lit(0.3)) + F.col("c.family") + F.col("c.whole")
    best = F.max_by(F.struct("left_name", "right_name", "c"), F.struct(total, "left_name", "right_name")).alias("b")
    return spelled.groupBy(left_key, right_key, *rest).agg(best).select(left_key, right_key, *rest, "b.left_name", "b.right_name", "b.c.*")


def link_names(left: DataFrame, right: DataFrame, left_key: str, right_key: str, reach: Reach = EVERYONE) -> DataFrame:
    """``candidate_pairs`` with ``with_spellings``: left_key, right_key, rarity, owners, shared, left_name, right_name, given,
    family, whole. Empty sides give no rows; repeated rows and ties change nothing."""
    return with_spellings(candidate_pairs(left, right, left_key, right_key, reach), left, right, left_key, right_key)
