"""Window operators over (entity, period)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lag_delta(df: DataFrame, entity: str, period: str, columns: Sequence[str]) -> DataFrame:
    """<c>_lag1 and delta_<c> against the previous row of the entity (whatever the gap), and has_lag1."""
    w = Window.partitionBy(entity).orderBy(period)
    new = {f"{c}_lag1": F.lag(c).over(w) for c in columns}
    out = df.withColumns(new | {"has_lag1": F.row_number().over(w) > 1})
    return out.withColumns({f"delta_{c}": F.col(c) - F.col(f"{c}_lag1") for c in columns})


def streak(df: DataFrame, entity: str, year: str, name: str = "consecutive") -> DataFrame:
    """Rows in a row so far without a missing year, 1 after each gap."""
    w = Window.partitionBy(entity).orderBy(year)
    broken = F.when(F.col(year) - F.lag(year).over(w) == 1, 0).otherwise(1)
    island = df.withColumn("_b", broken).withColumn("_i", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.withColumn(name, F.row_number().over(Window.partitionBy(entity, "_i").orderBy(year)).cast("long")).drop("_b", "_i")


def group_zscores(df: DataFrame, scores: Mapping[str, str], groups: Sequence[str], least: int = 15, eps: float = 1e-6) -> DataFrame:
    """<name>: (x - mean) / (sample deviation + eps) within a group for each name -> column of ``scores``; null in groups of
    fewer than ``least`` values or with a null key.

    Groups are summed before the shuffle and joined back, so a group of any size never lies in one task.
    """
    keys = [f"_g{i}" for i in range(len(groups))]
    parts = [a for i, c in enumerate(scores.values()) for a in (F.count(c).alias(f"_n{i}"), F.avg(c).alias(f"_m{i}"), F.stddev_samp(c).alias(f"_s{i}"))]
    stats = df.groupBy(*[F.col(g).alias(k) for g, k in zip(groups, keys)]).agg(*parts)
    joined = df.join(stats, reduce(lambda a, b: a & b, [F.col(g) == F.col(k) for g, k in zip(groups, keys)]), "left")
    new = {n: F.when(F.col(f"_n{i}") >= least, (F.col(c) - F.col(f"_m{i}")) / (F.col(f"_s{i}") + eps)) for i, (n, c) in enumerate(scores.items())}
    return joined.withColumns(new).drop(*keys, *[f"_{x}{i}" for i in range(len(scores)) for x in "nms"])


def group_zscore(df: DataFrame, column: str, groups: Sequence[str], name: str, least: int = 15, eps: float = 1e-6) -> DataFrame:
    """``group_zscores`` of one column."""
    return group_zscores(df, {name: column}, groups, least, eps)


def consecutive_pairs(df: DataFrame, entity: str, year: str, targets: Sequence[str], valid: Column, same: Sequence[str] = ()) -> DataFrame:
    """Rows whose next row is the next year, both valid and alike in ``same``, with next_<target>: training pairs."""
    w = Window.partitionBy(entity).orderBy(year)
    work = df.withColumns({"_v": F.coalesce(valid, F.lit(False))})
    work = work.withColumns({"_ny": F.lead(year).over(w), "_nv": F.lead("_v").over(w)} | {f"next_{t}": F.lead(t).over(w) for t in targets} | {f"_n_{c}": F.lead(c).over(w) for c in same})
    keep = (F.col("_ny") == F.col(year) + 1) & F.col("_v") & F.col("_nv")
    for c in same:
        keep = keep & (F.col(c) == F.col(f"_n_{c}"))
    return work.filter(keep).drop("_v", "_ny", "_nv", *[f"_n_{c}" for c in same])


def top_k(df: DataFrame, by: Column, unique: str, k: int) -> DataFrame:
    """The k first rows by an order made total by a unique column."""
    return df.orderBy(by, unique).limit(k)


def top_k_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The k first rows of each group; Spark keeps only k rows a group and task before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)).cast("long")).filter(F.col("rank") <= k)


def dominant_value(df: DataFrame, entity: str, column: str) -> DataFrame:
    """The most frequent non-null value of each entity; ties to the first in order."""
    n = df.filter(F.col(column).isNotNull()).groupBy(entity, column).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(entity).agg(F.min_by(column, F.struct((-F.col("_n")).alias("n"), F.col(column).alias("v"))).alias(column), F.max("_n").alias("n_rows"))


def pct_change(df: DataFrame, order: str, column: str, name: str) -> DataFrame:
    """x / previous x - 1 over a small table in order (one row for each period, so one task is enough)."""
    w = Window.partitionBy(F.lit(0)).orderBy(order)
    prev = F.lag(column).over(w)
    return df.withColumn(name, F.when(prev != 0, F.col(column) / prev - 1))
