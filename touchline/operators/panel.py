"""Entity-by-period panels: collapsing parts of a period, and guards on identities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_mean(v: Column, w: Column) -> Column:
    """Mean of v weighted by w over rows where v is known; null where their weight is not positive."""
    known = v.isNotNull() & w.isNotNull()
    total = F.sum(F.when(known, w))
    return F.when(total > 0, F.sum(F.when(known, v * w)) / total)


def collapse_parts(
    df: DataFrame,
    keys: Sequence[str],
    weight: str,
    order: Sequence[Column],
    sums: Sequence[str] = (),
    means: Sequence[str] = (),
    rates: Mapping[str, tuple[str, str]] | None = None,
    context: Sequence[str] = (),
) -> DataFrame:
    """One row for each key: sums, weighted means, rates recomputed from summed parts, and context from the part
    with the most weight (``order`` settles ties, first wins). A key with one part keeps its own means and rates.

    A rate without its numerator or denominator column is a weighted mean too, and so is one whose summed
    denominator is not positive.
    columns: keys, weight (summed), sums, means, rates, context, n_parts, is_split. Null keys form groups of their own.
    """
    rates = dict(rates or {})
    rank = F.struct(F.col(weight), *[o.alias(f"o{i}") for i, o in enumerate(order)])
    lead = F.max_by(F.struct(*context), rank).alias("_ctx") if context else None
    alone = F.count(F.lit(1)) == 1
    own_or = lambda c, value: F.when(alone, F.max(F.col(c).cast("double"))).otherwise(value).alias(c)
    mean = lambda c: weighted_mean(F.col(c), F.coalesce(F.col(weight), F.lit(0)))
    parts = [F.sum(weight).alias(weight), *[F.sum(c).alias(c) for c in sums], *[own_or(c, mean(c)) for c in means]]
    for name, (num, den) in rates.items():
        if num in df.columns and den in df.columns:
            parts.append(own_or(name, F.when(F.sum(den) > 0, F.sum(num) / F.sum(den)).otherwise(mean(name))))
        else:
            parts.append(own_or(name, mean(name)))
    out = df.groupBy(*keys).agg(*parts, *([lead] if context else []), F.count(F.lit(1)).alias("n_parts"))
    own = [F.col(f"_ctx.{c}").alias(c) for c in context]
    return out.select(*keys, weight, *sums, *means, *rates, *own, "n_parts", (F.col("n_parts") > 1).alias("is_split"))


#: Stats that are means though their names do not say so. Fixed values.
MEANS_BY_NAME = {"goals_per_shot", "goals_per_shot_on_target", "on_off"}


def stat_kind(column: str) -> str:
    """How parts of a stat are put together, by its name: ``rate`` (per 90), ``mean`` (percentages, averages), else ``sum``."""
    if column.endswith("_per_90"):
        return "rate"
    return "mean" if column in MEANS_BY_NAME or column.endswith(("_pct", "_per_sot")) or "avg" in column or "per_match" in column else "sum"


def with_minimum(df: DataFrame, minutes: str, league: str, top: Sequence[str], top_minimum: int, minimum: int) -> DataFrame:
    """min_minutes_threshold by league and meets_min_minutes against it; unknown minutes are none."""
    least = F.when(F.coalesce(F.col(league).isin(list(top)), F.lit(False)), top_minimum).otherwise(minimum)
    return df.withColumns({"min_minutes_threshold": least, "meets_min_minutes": F.coalesce(F.col(minutes), F.lit(0)) >= least})


def split_shared_ids(df: DataFrame, entity: str, name: str, weight: str, new_id: Column, real: Column | None = None) -> DataFrame:
    """Where one id goes by several names, the name with the most weight keeps it and the others get ``new_id``.

    name: compare folded names, so that mere spellings are one. real: which rows' ids are meant (default all); the
    others keep theirs. Ties go to the name first in order. Rows with a null name keep their id.
    """
    real = F.lit(True) if real is None else F.coalesce(real, F.lit(False))
    totals = df.filter(real & F.col(name).isNotNull()).groupBy(entity, name).agg(F.coalesce(F.sum(weight), F.lit(0)).alias("_w"))
    top = totals.groupBy(F.col(entity).alias("_e")).agg(F.min_by(name, F.struct((-F.col("_w")).alias("w"), F.col(name).alias("n"))).alias("_keep"))
    return df.join(top, F.col(entity) == F.col("_e"), "left").withColumn(entity, F.when(~real | F.col("_keep").isNull() | F.col(name).isNull() | (F.col(name) == F.col("_keep")), F.col(entity)).otherwise(new_id)).drop("_e", "_keep")


def split_overflow(df: DataFrame, entity: str, period: str, amount: str, limit: float, order: Sequence[Column], new_id: Column) -> DataFrame:
    """Where the parts of (entity, period) add up to more than can be, the largest part keeps the id, the others get ``new_id``."""
    w = Window.partitionBy(entity, period)
    rank = F.row_number().over(w.orderBy(F.col(amount).desc_nulls_last(), *order))
    marked = df.withColumns({"_sum": F.sum(amount).over(w), "_rn": rank})
    return marked.withColumn(entity, F.when((F.col("_sum") > limit) & (F.col("_rn") > 1), new_id).otherwise(F.col(entity))).drop("_sum", "_rn")
