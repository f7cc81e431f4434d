"""Joins with stated keys: uniqueness, nulls, tolerance and ties are part of each operator's contract."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.stats import pearson


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df``, failing at run time where a key occurs twice (null keys count as equal)."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return df.withColumn("_n", n).withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.lit(f"duplicate key {list(keys)}")).cast("long")).otherwise(F.col("_n"))).filter("_n = 1").drop("_n")


def left_join_nullsafe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join in which null keys match each other; the right side's other columns must not clash."""
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[f"_r_{k}"]) for k in keys])
    return left.join(r, on, "left").drop(*[f"_r_{k}" for k in keys])


def left_join_many(left: DataFrame, others: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """left joined to each of the others on the same keys; one partitioning by the keys serves all joins."""
    return reduce(lambda a, b: left_join_nullsafe(a, b, keys), others, left)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def orphan_rate(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: left rows, those whose key the right side lacks, and their share."""
    marked = left.select(key).join(right.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left")
    n, o = F.count(F.lit(1)), F.count(F.when(F.col("_k").isNull(), 1))
    return marked.agg(n.alias("n_rows"), o.alias("n_orphans")).withColumn("orphan_rate", F.when(F.col("n_rows") > 0, F.col("n_orphans") / F.col("n_rows")))


def set_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys in both, in a alone, in b alone."""
    sides = a.select(key, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(key, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    per = sides.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    cnt = lambda x, y: F.coalesce(F.sum(((F.col("_a") == x) & (F.col("_b") == y)).cast("long")), F.lit(0))
    return per.agg(cnt(1, 1).alias("in_both"), cnt(1, 0).alias("only_a"), cnt(0, 1).alias("only_b"))


def nearest_in_group(left: DataFrame, right: DataFrame, key: str, left_id: str, left_value: str, right_id: str, right_value: str, tolerance: float) -> DataFrame:
    """For each left row the right row of its key whose value lies nearest, within the tolerance; ties go to the lowest right id.

    Values fall into buckets as wide as the tolerance, so a key's rows meet only where they could match; the best right
    row is kept by a combinable aggregate, so candidates are never sorted or collected. Null and NaN values match nothing.
    """
    width = F.lit(float(tolerance) if tolerance > 0 else 1.0)
    bucket = lambda c: F.floor(F.col(c).cast("double") / width).cast("long")
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    near = F.explode(F.sequence(bucket(left_value) - 1, bucket(left_value) + 1))
    l = left.filter(known(left_value)).select(key, left_id, left_value, near.alias("_lb"))
    r = right.filter(known(right_value)).select(F.col(key).alias("_k"), right_id, right_value, bucket(right_value).alias("_rb"))
    d = F.abs(F.col(left_value) - F.col(right_value))
    met = l.join(r, (F.col(key) == F.col("_k")) & (F.col("_lb") == F.col("_rb"))).withColumn("_d", d).filter(F.col("_d") <= tolerance)
    return met.groupBy(left_id).agg(F.min_by(F.struct(right_id, "_d"), F.struct("_d", right_id)).alias("b")).select(left_id, f"b.{right_id}", F.col("b._d").alias("distance"))


def asof_nearest(left: DataFrame, right: DataFrame, key: str, left_id: str, left_date: str, right_id: str, right_date: str, days: int) -> DataFrame:
    """The right row of the same key nearest in days, within ``days`` inclusive; ties: earlier date, then lower id.

    Both sides are cut into buckets of ``days`` days, so a key's rows meet only where they could match.
    """
    origin = F.lit("1970-01-01").cast("date")
    bucket = lambda c: F.floor(F.datediff(F.col(c), origin) / F.lit(days + 1)).cast("long")
    l = left.filter(F.col(key).isNotNull() & F.col(left_date).isNotNull()).select(F.col(key).alias("_lk"), left_id, left_date, F.explode(F.array(bucket(left_date) - 1, bucket(left_date), bucket(left_date) + 1)).alias("_lb"))
    r = right.filter(F.col(right_date).isNotNull()).select(key, right_id, right_date, bucket(right_date).alias("_rb"))
    gap = F.abs(F.datediff(F.col(right_date), F.col(left_date)))
    near = l.join(r, (F.col("_lk") == F.col(key)) & (F.col("_lb") == F.col("_rb"))).withColumn("_d", gap).filter(F.col("_d") <= days)
    return near.groupBy(left_id).agg(F.min_by(F.struct(right_id, "_d"), F.struct("_d", right_date, right_id)).alias("b")).select(left_id, f"b.{right_id}", F.col("b._d").cast("long").alias("days_apart"))


def join_roles(df: DataFrame, dimension: DataFrame, key: str, roles: Mapping[str, str], columns: Sequence[str]) -> DataFrame:
    """One dimension joined once for each role: role prefix -> the column of df that holds the role's key.

    columns: <prefix><column> of the dimension, null where the key is null or unknown. The dimension's keys are unique.
    """
    for prefix, fk in roles.items():
        side = dimension.select(F.col(key).alias("_dim_key"), *[F.col(c).alias(f"{prefix}{c}") for c in columns])
        df = df.join(side, F.col(fk) == F.col("_dim_key"), "left").drop("_dim_key")
    return df


def flag_repeated(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """name: whether a row shares its keys with another; null keys are alike. Counted before the shuffle and joined back."""
    counts = df.groupBy(*keys).agg((F.count(F.lit(1)) > 1).alias(name))
    return left_join_nullsafe(df, counts, keys)


def schema_aligned(df: DataFrame, schema: Mapping[str, str]) -> DataFrame:
    """The columns of ``schema`` (name -> type) in its order, cast where they are there, null where they are not."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{c}`").try_cast(t) if c in have else F.lit(None).cast(t)).alias(c) for c, t in schema.items()])


def keys_only_in(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of a that b lacks; null keys match each other."""
    return a.select(*keys).distinct().exceptAll(b.select(*keys).distinct())


def cross_check(a: DataFrame, b: DataFrame, key: str, by: Sequence[str], stats: Sequence[str], least: int = 6) -> DataFrame:
    """(by, stat, n, pearson, mae, mean_a, mean_b): the same stats of two sources, summed by key and matched by it.

    Nulls count as nothing in the sums; correlation and error need ``least`` matched keys with both values.
    """
    side = lambda df, tag: df.groupBy(*by, key).agg(*[F.coalesce(F.sum(s), F.lit(0)).cast("double").alias(f"{tag}_{s}") for s in stats])
    both = side(a, "a").join(side(b, "b"), [*by, key])
    pairs = both.select(*by, F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(f"a_{s}").alias("a"), F.col(f"b_{s}").alias("b")) for s in stats])).alias("p")).select(*by, "p.*")
    enough = F.count(F.lit(1)) >= least
    return pairs.groupBy(*by, "stat").agg(F.count(F.lit(1)).alias("n"), F.when(enough, pearson("a", "b")).alias("pearson"), F.when(enough, F.avg(F.abs(F.col("a") - F.col("b")))).alias("mae"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"))
