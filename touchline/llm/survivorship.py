"""One surviving record for each group of duplicates, chosen field by field.

Every field is settled by the maximum of a composite struct (usable, source priority, time, ...), so a group is
never collected or sorted. Copies of a row under one id are made one first, spread by that id; then the maxima are
taken in two aggregations with map-side combining, within (keys, source, load) and within keys. A hot group is
spread over all tasks by its ids and shrinks to a row per task before it is shuffled again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What people and loaders write where they know no club.
UNKNOWN_TEXTS = ["", "-", "--", "?", "??", "n/a", "na", "none", "null", "nan", "tbc", "tbd", "unknown", "missing", "not available"]


def says_something(c: Column) -> Column:
    """True for a text that is no stand-in for an unknown one."""
    return F.coalesce(~F.lower(F.trim(c)).isin(UNKNOWN_TEXTS), F.lit(False))


@dataclass(frozen=True)
class Survivorship:
    """How records rank.

    keys: what duplicates share. row_id: unique, the last tie-break (lowest wins). source, load, loaded_at:
    where and when a record came. whole: true where a record speaks for the whole group (a split season's
    total). amount: additive number; among records that rank alike the larger wins, and parts add up.
    amount_usable: whether the amount can be true.
    """

    keys: Sequence[str]
    row_id: str
    source: str
    load: str
    loaded_at: str
    whole: str
    amount: str
    amount_usable: Column


def _rank(s: Survivorship, usable: Column, value: Column) -> Column:
    """Nulls rank lowest in a struct comparison, which is what a missing source or time should do."""
    return F.struct(
        usable.alias("usable"),
        (-F.col("_trust")).alias("trust"),
        F.col(s.loaded_at).alias("at"),
        F.coalesce(F.col(s.whole), F.lit(False)).alias("whole"),
        F.when(s.amount_usable, F.col(s.amount).cast("double")).alias("amount"),
        (-F.col(s.row_id)).alias("neg_id"),
        value.alias("value"),
        F.col(s.row_id).alias("row_id"),
        F.col("_src").alias("src"),
        F.col(s.load).alias("load"),
    )


def survive(df: DataFrame, sources: DataFrame, s: Survivorship, fields: dict[str, Column]) -> DataFrame:
    """A row for each group of equal keys.

    fields: name -> whether the value is usable. ``sources`` has record_source and trust_rank (1 is best); a
    source without rank comes last. columns: keys, group_rows, built_<whole>, for each field its value and
    <field>__row_id, and <amount>__built (the value was added up from parts).
    A group without a usable value has null value and null row id. Rows with a null key are no duplicates of
    anything and are left out. Ties end with the lowest row id. A row repeated under one id, source and load counts
    once, as a part, as an amount and in group_rows; where such copies differ, the latest and then the fullest and
    greatest in the order of time, whole, amount and fields stands. Other columns, also of clashing names, are not touched. Empty input gives no rows.
    """
    ranks = sources.groupBy(F.col("record_source").alias("_rs")).agg(F.min("trust_rank").cast("int").alias("_rank"))
    keyed = df
    for k in s.keys:
        keyed = keyed.filter(F.col(k).isNotNull())
    used = list(dict.fromkeys([*s.keys, s.row_id, s.source, s.load, s.loaded_at, s.whole, s.amount, *fields]))
    keyed = keyed.select(*used).join(ranks, F.col(s.source) == F.col("_rs"), "left")
    keyed = keyed.withColumn("_trust", F.coalesce("_rank", F.lit(2**31 - 2))).withColumn("_src", F.coalesce(F.col(s.source), F.lit("")))
    part = ~F.coalesce(F.col(s.whole), F.lit(False))
    names = list(fields)
    own = [*s.keys, s.row_id, s.source, s.load]
    rest = [c for c in dict.fromkeys([s.loaded_at, s.whole, s.amount, *fields]) if c not in own]
    keyed = keyed.groupBy(*own, "_src", "_trust").agg(F.max(F.struct(*rest)).alias("_r")).select(*own, "_src", "_trust", *[F.col("_r")[c].alias(c) for c in rest])
    first = keyed.groupBy(*s.keys, "_src", F.col(s.load).alias("_load")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.max(~part).alias("whole"),
        F.sum(part.cast("int")).alias("parts"),
        F.sum(F.when(part & s.amount_usable, F.col(s.amount).cast("double"))).alias("parts_amount"),
        *[F.max(_rank(s, usable, F.col(n))).alias(f"b{i}") for i, (n, usable) in enumerate(fields.items())],
    )
    second = first.groupBy(*s.keys).agg(
        F.sum("rows").alias("group_rows"),
        F.max("whole").alias("_whole"),
        F.max("parts").alias("_parts"),
        *[F.max(F.struct(F.col(f"b{i}"), F.col("parts"), F.col("parts_amount"))).alias(f"b{i}") for i in range(len(names))],
    )
    columns: list[Column] = [*[F.col(k) for k in s.keys], F.col("group_rows"), (F.col("_whole") | (F.col("_parts") > 1)).alias(f"built_{s.whole}")]
    for i, n in enumerate(names):
        best = F.col(f"b{i}.b{i}")
        ok = best["usable"]
        built = ok & ~best["whole"] & (F.col(f"b{i}.parts") > 1) if n == s.amount else F.lit(False)
        value = F.when(built, F.col(f"b{i}.parts_amount").cast(df.schema[n].dataType)).otherwise(best["value"]) if n == s.amount else best["value"]
        columns += [F.when(ok, value).alias(n), F.when(ok & ~built, best["row_id"]).alias(f"{n}__row_id")]
        if n == s.amount:
            columns.append(built.alias(f"{n}__built"))
    return second.select(*columns)


def surviving_cells(survivors: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(keys, field_name, row_id): which row each field's value came from, where one row did."""
    cells = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"{f}__row_id").alias("row_id")) for f in fields])
    return survivors.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.field_name", "c.row_id").filter(F.col("row_id").isNotNull())
