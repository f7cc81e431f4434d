"""Column profiles per load and findings about loads that are unlike the others.

A profile holds counts, distinct counts, ranges, pattern violations and power sums. Power sums of disjoint parts
add up, so profiles of parts merge (``merge_profiles``) without reading the rows again; for whole numbers they are
exact as long as they stay below 2**53, which an ``origin`` near the values is for. Distinct counts come from a
table of values (``value_counts``, which merges exactly too: ``merge_counts``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from touchline.plans.lineage import cut


@dataclass(frozen=True)
class ColumnRule:
    """How a column is profiled: numbers by ``low``/``high`` (inclusive), texts by ``pattern`` (whole value).

    origin: what power sums are taken about; the same in all profiles that are to be merged.
    """

    column: str
    pattern: str | None = None
    low: float | None = None
    high: float | None = None
    origin: float = 0.0

    @property
    def numeric(self) -> bool:
        return self.pattern is None


def _long_form(df: DataFrame, table_name: str, load: str, rules: Sequence[ColumnRule]) -> DataFrame:
    """One row per (load, column, value) with its count; NaN counts as null. Partial aggregation keeps the shuffle small."""

    def entry(r: ColumnRule) -> Column:
        c = F.col(f"`{r.column}`")
        if not r.numeric:
            number, text = F.lit(None).cast("double"), c.cast("string")
            bad_pattern, bad_range = ~text.rlike(f"\\A(?:{r.pattern})\\z"), F.lit(False)
        else:
            number = c.cast("double")
            number = F.when(~F.isnan(number), number)
            text = number.cast("string")
            bad_pattern = F.lit(False)
            bad_range = (number < r.low if r.low is not None else F.lit(False)) | (number > r.high if r.high is not None else F.lit(False))
        return F.struct(
            F.lit(r.column).alias("column_name"),
            text.alias("v"),
            number.alias("x"),
            F.coalesce(bad_pattern, F.lit(False)).alias("bad_pattern"),
            F.coalesce(bad_range, F.lit(False)).alias("bad_range"),
        )

    cells = df.select(F.col(f"`{load}`").cast("long").alias("load_id"), F.explode(F.array(*[entry(r) for r in rules])).alias("c"))
    return (
        cells.select(F.lit(table_name).alias("table_name"), "load_id", "c.*")
        .groupBy("table_name", "load_id", "column_name", "v", "x", "bad_pattern", "bad_range")
        .agg(F.count(F.lit(1)).alias("k"))
    )


def value_counts(df: DataFrame, table_name: str, load: str, rules: Sequence[ColumnRule]) -> DataFrame:
    """Counts by load, column and value, the table every other figure is made from."""
    return _long_form(df, table_name, load, rules)


def merge_counts(parts: Sequence[DataFrame]) -> DataFrame:
    """``value_counts`` of disjoint parts as one, so that every figure of the whole, distinct values too, comes out exactly."""
    both = reduce(lambda a, b: a.unionByName(b), parts)
    return both.groupBy(*[c for c in both.columns if c != "k"]).agg(F.sum("k").alias("k"))


PROFILE_KEYS = ["table_name", "load_id", "column_name"]


def _power(x: Column, i: int) -> Column:
    """x to the i-th by multiplication, which keeps whole numbers whole."""
    return F.lit(1.0) if i == 0 else reduce(lambda a, b: a * b, [x] * i)


def _origins(rules: Sequence[ColumnRule]) -> Column:
    own = {r.column: r.origin for r in rules if r.origin}
    return reduce(lambda c, kv: c.when(F.col("column_name") == kv[0], kv[1]), own.items(), F.when(F.lit(False), 0.0)).otherwise(0.0)


def profile_from_counts(counts: DataFrame, rules: Sequence[ColumnRule] = ()) -> DataFrame:
    """Profile rows of ``value_counts``. Values out of form or range count in their own column and nowhere else.

    columns: n, nulls, null_rate, pattern_violations, range_violations, distinct_values, low, high (over all
    numbers), origin, p0..p4 (power sums about it of the numbers in range), mean, stddev. rules: for their origins.
    Empty input gives no rows; a load whose column is all null has distinct_values 0 and null mean.
    """
    ok = F.col("v").isNotNull() & ~F.col("bad_pattern") & ~F.col("bad_range")
    x = F.when(ok, F.col("x") - F.col("origin"))
    power = [F.sum(F.when(x.isNotNull(), F.col("k") * _power(x, i))).alias(f"p{i}") for i in range(5)]
    out = (
        counts.withColumn("origin", _origins(rules))
        .groupBy(*PROFILE_KEYS)
        .agg(
            F.sum("k").alias("n"),
            F.sum(F.when(F.col("v").isNull(), F.col("k")).otherwise(0)).alias("nulls"),
            F.sum(F.when(F.col("bad_pattern"), F.col("k")).otherwise(0)).alias("pattern_violations"),
            F.sum(F.when(F.col("bad_range"), F.col("k")).otherwise(0)).alias("range_violations"),
            F.sum(F.when(ok, 1).otherwise(0)).alias("distinct_values"),
            F.min("x").alias("low"),
            F.max("x").alias("high"),
            F.max("origin").alias("origin"),
            *power,
        )
    )
    return with_moments(out)


def with_moments(profile: DataFrame) -> DataFrame:
    """null_rate, mean, (population) stddev and the fourth moment against its square, out of counts and power sums."""
    p0 = F.nullif(F.col("p0"), F.lit(0.0))
    m = [F.col(f"p{i}") / p0 for i in range(5)]
    variance = F.greatest(m[2] - m[1] * m[1], F.lit(0.0))
    fourth = m[4] - 4 * m[1] * m[3] + 6 * m[1] * m[1] * m[2] - 3 * m[1] * m[1] * m[1] * m[1]
    return profile.withColumns(
        {
            "null_rate": F.col("nulls") / F.col("n"),
            "mean": F.col("origin") + m[1],
            "stddev": F.when(p0.isNotNull(), F.sqrt(variance)),
            "kurtosis": F.when(variance > 0, F.greatest(fourth, F.lit(0.0)) / (variance * variance)),
        }
    )


def merge_profiles(profiles: Sequence[DataFrame]) -> DataFrame:
    """Profiles of disjoint parts as one. Their origins must agree (error at run time). distinct_values is an upper bound
    then, as parts may share values; ``merge_counts`` keeps it exact."""
    sums = ["n", "nulls", "pattern_violations", "range_violations", "distinct_values", *[f"p{i}" for i in range(5)]]
    both = reduce(lambda a, b: a.unionByName(b), [p.select(*PROFILE_KEYS, *sums, "low", "high", "origin") for p in profiles])
    same = F.when(F.min("origin") == F.max("origin"), F.max("origin")).otherwise(F.raise_error(F.lit("profiles about different origins")).cast("double"))
    return with_moments(both.groupBy(*PROFILE_KEYS).agg(*[F.sum(c).alias(c) for c in sums], F.min("low").alias("low"), F.max("high").alias("high"), same.alias("origin")))


def profile(df: DataFrame, table_name: str, load: str, rules: Sequence[ColumnRule]) -> DataFrame:
    """The profile of every column in each load, as ``profile_from_counts`` has it.

    Counts, ranges, violations and power sums are one aggregation that combines before the shuffle (a row for each
    load and task, whatever the rows); only for distinct values is a table of (load, column, value) built, of 64-bit
    hashes of the values, so that two values in 2**64 would count as one.
    """
    wide, shown, hashes = [F.count(F.lit(1)).alias("n")], [], []
    for i, r in enumerate(rules):
        c = F.col(f"`{r.column}`")
        if r.numeric:
            x = F.when(~F.isnan(c.cast("double")), c.cast("double"))
            over = [x < r.low] if r.low is not None else []
            over += [x > r.high] if r.high is not None else []
            bad_range, bad_pattern = F.coalesce(reduce(lambda a, b: a | b, over), F.lit(False)) if over else F.lit(False), F.lit(False)
        else:
            x, bad_range = F.lit(None).cast("double"), F.lit(False)
            bad_pattern = F.coalesce(~c.cast("string").rlike(f"\\A(?:{r.pattern})\\z"), F.lit(False)) if r.pattern != ANYTHING else F.lit(False)
        value = x if r.numeric else c
        ok = value.isNotNull() & ~bad_range & ~bad_pattern
        d = F.when(ok, x - F.lit(r.origin))
        wide += [F.count(value).alias(f"v{i}"), F.count(F.when(bad_pattern, 1)).alias(f"bp{i}"), F.count(F.when(bad_range, 1)).alias(f"br{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
        wide += [F.sum(F.when(d.isNotNull(), _power(d, j))).alias(f"p{j}_{i}") for j in range(5)]
        shown.append(F.struct(F.lit(r.column).alias("column_name"), (F.col("n") - F.col(f"v{i}")).alias("nulls"), F.col(f"bp{i}").alias("pattern_violations"), F.col(f"br{i}").alias("range_violations"), F.col(f"lo{i}").alias("low"), F.col(f"hi{i}").alias("high"), F.lit(r.origin).alias("origin"), *[F.col(f"p{j}_{i}").alias(f"p{j}") for j in range(5)]))
        hashes.append(F.struct(F.lit(i).alias("i"), F.when(ok, F.xxhash64(value.cast("string") if not r.numeric else x)).alias("h")))
    keyed = df.withColumn("_load", F.col(f"`{load}`").cast("long"))
    sums = keyed.groupBy("_load").agg(*wide).select(F.lit(table_name).alias("table_name"), F.col("_load").alias("load_id"), "n", F.explode(F.array(*shown)).alias("s")).select("table_name", "load_id", "n", "s.*")
    values = keyed.select("_load", F.explode(F.array(*hashes)).alias("e")).select("_load", "e.i", "e.h").filter("h is not null").distinct()
    names = F.element_at(F.array(*[F.lit(r.column) for r in rules]), F.col("i") + 1)
    distinct = values.groupBy(F.col("_load").alias("_l"), names.alias("_c")).agg(F.count(F.lit(1)).alias("distinct_values"))
    both = sums.join(distinct, sums["load_id"].eqNullSafe(distinct["_l"]) & (sums["column_name"] == distinct["_c"]), "left").drop("_l", "_c")
    return with_moments(both.withColumn("distinct_values", F.coalesce("distinct_values", F.lit(0))))


def _middle(c: Column, frame: WindowSpec) -> Column:
    """Median over a sliding frame, which Spark's median has no form of; the frame bounds the array."""
    a = F.array_sort(F.collect_list(c).over(frame))
    n = F.size(a)
    return F.when(n > 0, (F.get(a, F.floor((n - 1) / 2).cast("int")) + F.get(a, F.floor(n / 2).cast("int"))) / 2)


@dataclass(frozen=True)
class Thresholds:
    """When a load is plainly unlike the ordinary ones. Each test asks for a size of effect and for significance."""

    null_gain: float = 0.03  # share of nulls above the ordinary share
    violation_share: float = 0.0  # any violation at all is one
    distinct_ratio: float = 0.5  # distinct values at most this part of, or 1 / this times, the ordinary number
    new_value_share: float = 0.005  # share a value unknown to the other loads needs
    level_shift: float = 0.25  # standardised difference of means
    spread_ratio: float = 2.5  # standard deviation against the ordinary one, or the other way round
    share_shift: float = 0.10  # change of a known value's share
    z: float = 5.0  # standard errors
    local: int = 12  # neighbouring loads on each side that say what is ordinary now
    categories: int = 20  # a column with so many ordinary values at most is compared by the shares of its values


def findings(counts: DataFrame, rules: Sequence[ColumnRule], t: Thresholds = Thresholds()) -> DataFrame:
    """(table_name, load_id, column_name, finding) for loads unlike their neighbours.

    counts: ``value_counts`` of one or more tables; column names must tell their rules apart. Works on per-load tables
    only (the counts and the profile are written once): their size is loads x columns (x known values for categories), never rows.
    Ordinary is the median over the ``local`` loads before and after, so slow growth is no finding. Ties,
    repeated rows and extra columns have no effect; a null load id is a load of its own; a single load has
    nothing to be compared with and can only show range and pattern violations.
    """
    counts = cut(counts)  # read for every test; the loads' tables are scanned once
    profile = cut(profile_from_counts(counts, rules))
    by = Window.partitionBy("table_name", "column_name").orderBy(F.col("load_id").asc_nulls_first())
    near = by.rowsBetween(-t.local, t.local)
    med = lambda c: _middle(F.expr(c), near)
    n = F.col("n")
    known = F.col("n") - F.col("nulls")
    base_null, base_mean, base_sd, base_distinct = F.col("base_null"), F.col("base_mean"), F.col("base_sd"), F.col("base_distinct")
    usual = profile.withColumns({"base_null": med("null_rate"), "base_mean": med("mean"), "base_sd": med("stddev"), "base_distinct": med("cast(distinct_values as double)")})
    p = F.greatest(base_null, F.lit(0.005))
    null_hit = (F.col("null_rate") - base_null > t.null_gain) & ((F.col("null_rate") - p) / F.sqrt(p * (1 - p) / n) > t.z)
    shift = F.abs(F.col("mean") - base_mean) / F.greatest(base_sd, F.lit(1e-9))
    level_hit = (shift > t.level_shift) & (shift * F.sqrt(F.col("p0")) > t.z)
    # twice the log of the ratio of deviations has a variance of (kurtosis - 1) / rows, as the fourth power sum tells
    ratio = F.log(F.col("stddev") / base_sd)
    error = F.sqrt(F.greatest(F.col("kurtosis") - 1, F.lit(0.5)) / (4 * F.col("p0")))
    spread_hit = (base_sd > 0) & (F.col("stddev") > 0) & (F.abs(ratio) > math.log(t.spread_ratio)) & (F.abs(ratio) / error > t.z)
    many = base_distinct > t.categories
    # expected distinct values shrink with the rows that are known, so a load full of nulls has no finding of its own here
    expected = base_distinct * F.least(F.lit(1.0), known / F.greatest(med("cast(n - nulls as double)"), F.lit(1.0)))
    usual = usual.withColumn("expected_distinct", expected)
    distinct_hit = many & ((F.col("distinct_values") < t.distinct_ratio * F.col("expected_distinct")) | (F.col("distinct_values") * t.distinct_ratio > base_distinct))
    hits = {
        "null_rate": null_hit,
        "range": F.col("range_violations") > t.violation_share * n,
        "pattern": F.col("pattern_violations") > t.violation_share * n,
        "distinct": distinct_hit,
        "distribution": level_hit | F.coalesce(spread_hit, F.lit(False)),
    }
    tests = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in hits.items()])
    numeric = usual.select(*PROFILE_KEYS, F.explode(F.array_compact(tests)).alias("finding"))

    names = [r.column for r in rules if not r.numeric]
    if not names:
        return numeric.distinct()
    values = counts.filter(F.col("column_name").isin(names) & F.col("v").isNotNull() & ~F.col("bad_pattern")).groupBy(*PROFILE_KEYS, "v").agg(F.sum("k").alias("k"))
    totals = profile.filter(F.col("column_name").isin(names)).select(*PROFILE_KEYS, "n", (F.col("n") - F.col("nulls") - F.col("pattern_violations")).alias("m"))
    seen = values.groupBy("table_name", "column_name", "v").agg(F.count(F.lit(1)).alias("loads"), F.sum("k").alias("all_k"))
    loads = totals.groupBy("table_name", "column_name").agg(F.count(F.lit(1)).alias("n_loads"))
    seen = seen.join(loads, ["table_name", "column_name"]).withColumn("ordinary", F.col("loads") > 0.5 * F.col("n_loads"))
    # a column is compared if its loads share values at all, whether this load has any of them or not
    seen = seen.withColumn("shared", F.max("ordinary").over(Window.partitionBy("table_name", "column_name")))
    # shares are followed for the ordinary values of columns that have few: loads x categories rows at most
    few = seen.groupBy("table_name", "column_name").agg(F.sum(F.col("ordinary").cast("int")).alias("_few")).filter(F.col("_few") <= t.categories).drop("_few")
    ordinary = seen.filter("ordinary").join(few, ["table_name", "column_name"]).drop("loads")
    grid = totals.join(ordinary, ["table_name", "column_name"])
    v = values.select(*[F.col(c).alias(f"_{c}") for c in (*PROFILE_KEYS, "v", "k")])
    same = reduce(lambda a, b: a & b, [grid[c].eqNullSafe(v[f"_{c}"]) for c in (*PROFILE_KEYS, "v")])
    grid = grid.join(v, same, "left").withColumn("k", F.coalesce("_k", F.lit(0)))
    byv = Window.partitionBy("table_name", "column_name", "v").orderBy(F.col("load_id").asc_nulls_first()).rowsBetween(-t.local, t.local)
    # shares among the ordinary values only, so that a new value moves none of them
    grid = grid.withColumn("mo", F.sum("k").over(Window.partitionBy(*PROFILE_KEYS)))
    grid = grid.withColumn("share", F.when(F.col("mo") > 0, F.col("k") / F.col("mo")))
    grid = grid.withColumn("base", _middle(F.col("share"), byv))
    q = F.least(F.greatest(F.col("base"), F.lit(0.005)), F.lit(0.995))
    moved = (F.abs(F.col("share") - F.col("base")) > t.share_shift) & (F.abs(F.col("share") - q) / F.sqrt(q * (1 - q) / F.nullif(F.col("mo"), F.lit(0))) > t.z)
    gone = (F.col("k") == 0) & (F.col("base") * F.col("m") > t.z * t.z)
    tests = F.array(F.when(F.coalesce(moved, F.lit(False)), F.lit("distribution")), F.when(F.coalesce(gone, F.lit(False)), F.lit("distinct")))
    categorical = grid.select(*PROFILE_KEYS, F.explode(F.array_compact(tests)).alias("finding"))
    # a value that is not ordinary is looked at only where it occurs
    odd = seen.filter(~F.col("ordinary") & F.col("shared") & (F.col("n_loads") >= 3)).select("table_name", "column_name", "v").join(few, ["table_name", "column_name"])
    there = values.join(odd, ["table_name", "column_name", "v"]).select(*[F.col(c).alias(f"_{c}") for c in (*PROFILE_KEYS, "k")])
    same = reduce(lambda a, b: a & b, [totals[c].eqNullSafe(there[f"_{c}"]) for c in PROFILE_KEYS])
    fresh = totals.join(there, same).filter((F.col("m") > 0) & (F.col("_k") / F.col("m") >= t.new_value_share)).select(*PROFILE_KEYS, F.lit("distinct").alias("finding"))
    return numeric.unionByName(categorical).unionByName(fresh).distinct()


#: The form of a text column without one.
ANYTHING = "(?s).*"


def default_rules(schema: T.StructType, exclude: Sequence[str] = ()) -> list[ColumnRule]:
    """A rule for every column: numbers without bounds, anything else as text without a form."""
    numbers = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
    return [ColumnRule(f.name) if isinstance(f.dataType, numbers) else ColumnRule(f.name, pattern=ANYTHING) for f in schema if f.name not in exclude]
