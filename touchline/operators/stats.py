"""Metrics, distributions and coverage as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pearson(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation of complete pairs as an aggregate; null where a side does not vary."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 0, F.covar_pop(x, y) / spread)


def moments(df: DataFrame, column: str) -> DataFrame:
    """n, mean, sample deviation, population skewness and excess kurtosis."""
    return df.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.skewness(column).alias("skew"), F.kurtosis(column).alias("kurt"))


def null_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, n_rows, n_null, null_rate) from one aggregation over all columns."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), (F.col("n") - F.col(c)).alias("n_null")) for c in columns])).alias("r")
    return one.select("n", rows).select("r.column_name", F.col("n").alias("n_rows"), "r.n_null", F.when(F.col("n") > 0, F.col("r.n_null") / F.col("n")).alias("null_rate"))


def coverage_matrix(df: DataFrame, period: str, columns: Sequence[str]) -> DataFrame:
    """(period, source, coverage): share of rows of a period in which each column is known."""
    wide = df.groupBy(period).agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns])
    return wide.unpivot([period], list(columns), "source", "coverage")


def pivot_counts(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts of row x column for stated column values, 0 where there are none."""
    return df.groupBy(row).pivot(column, list(values)).count().na.fill(0)


def quantile_table(df: DataFrame, value: str, by: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """Exact interpolated quantiles of each group as q05, q50, ..."""
    q = F.percentile(value, F.array(*[F.lit(p) for p in probabilities]))
    out = df.groupBy(*by).agg(q.alias("_q"), F.count(value).alias("n"))
    return out.select(*by, "n", *[F.get("_q", i).alias(f"q{round(p * 100):02d}") for i, p in enumerate(probabilities)])


def exact_median(df: DataFrame, value: Column, margin: float = 1e-3, accuracy: int = 10_000) -> float | None:
    """The median of a column, interpolated, as ``F.median`` has it; null values don't count, None where there are no others.

    ``F.median`` holds every distinct value in one place. Here sketched quantiles on both sides of the middle give bounds,
    and a second pass counts the rows below them and each value between them; what one task orders is about two
    ``margin`` of the rows. Where the bounds miss the middle they are widened, up to the lowest and highest values.
    """
    x = df.select(value.cast("double").alias("v")).filter("v is not null")
    while True:
        low, high = max(0.5 - margin, 0.0), min(0.5 + margin, 1.0)
        n, bounds = x.agg(F.count("v"), F.percentile_approx("v", [low, high], accuracy)).first()
        if not n:
            return None
        below, upto = F.col("v") < F.lit(bounds[0]), F.col("v") <= F.lit(bounds[1])
        if low == 0.0:  # the lowest and highest values of a sketch are exact, but nothing hangs on it here
            below, upto = F.lit(False), F.lit(True)
        counts = x.filter(upto).groupBy(below.alias("below"), F.when(~below, F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("c"))
        first, last = (n - 1) // 2, n // 2
        upper = F.sum("c").over(Window.orderBy(F.col("below").desc(), "v"))
        middle = counts.withColumn("_to", upper).filter((F.col("_to") > first) & (F.col("_to") - F.col("c") <= last)).orderBy("_to").collect()
        if middle and not middle[0]["below"] and middle[0]["_to"] - middle[0]["c"] <= first and middle[-1]["_to"] > last:
            a, b = middle[0]["v"], middle[-1]["v"]
            return a if first == last or a == b else 0.5 * a + 0.5 * b
        margin *= 8


def regression_metrics(df: DataFrame, actual: Column, predicted: Column, by: Sequence[str] = (), masked: float = 0.1) -> DataFrame:
    """n, mae, rmse, r2 and mape (over |actual| above ``masked``) on complete pairs, in one pass of sums."""
    pairs = df.select(*by, actual.cast("double").alias("y"), predicted.cast("double").alias("p")).filter("y is not null and p is not null")
    e = F.col("y") - F.col("p")
    sse, n = F.sum(e * e), F.count(F.lit(1))
    sst = F.var_pop("y") * n
    big = F.abs(F.col("y")) > masked
    return pairs.groupBy(*by).agg(n.alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.when(sst > 0, 1 - sse / sst).alias("r2"), F.avg(F.when(big, F.abs(e / F.col("y")))).alias("mape"))


def scenario_metrics(df: DataFrame, actual: Column, predicted: Column, within: float = 0.3) -> DataFrame:
    """For positive pairs: n, mae, r2 of logs, median ratio and the share within a band of the actual value."""
    pairs = df.select(actual.cast("double").alias("y"), predicted.cast("double").alias("p")).filter("y > 0 and p > 0")
    d = F.log1p("y") - F.log1p("p")
    n = F.count(F.lit(1))
    ratio = F.lit(exact_median(pairs, F.col("p") / F.col("y"))).cast("double")
    return pairs.agg(n.alias("n"), F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae"), (1 - F.sum(d * d) / (F.var_pop(F.log1p("y")) * n)).alias("r2_log"), ratio.alias("median_ratio"), F.avg((F.abs(F.col("p") / F.col("y") - 1) <= within).cast("double")).alias("share_within"))


def interval_coverage(df: DataFrame, value: Column, low: Column, high: Column, by: Sequence[str] = ()) -> DataFrame:
    """Share of values inside their interval, bounds included."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value.between(low, high).cast("double")).alias("coverage"))
