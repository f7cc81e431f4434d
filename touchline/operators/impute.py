"""Filling missing values from like records by mixed-effects prediction, with a mask of what was filled.

Numbers: y = fixed effects (least squares on covariates) + one random effect for each grouping, time among them,
each shrunk towards zero by the variance ratio the data show (best linear unbiased prediction). All effects are
fitted together by sweeps: each is fitted to what the others leave, until the last sweep. Categories: a multinomial
model with main effects of group and time, P(c) of the overall shares times the shrunk ratio by which each of them
changes it. Everything is fitted on all usable rows by aggregation; no row is collected.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.plans.lineage import cut


@dataclass(frozen=True)
class NumericField:
    """A number to fill.

    low, high: what the value can be at all. refuted: condition under which the row's other columns rule the
    value out. eligible: rows in which the field can have a value. derived: what the row itself says the value
    is, taken before any model. covariates: fixed effects; a null or NaN in one counts as its mean.
    """

    column: str
    low: float
    high: float
    covariates: dict[str, Column] = field(default_factory=dict)
    refuted: Column | None = None
    eligible: Column | None = None
    derived: Column | None = None


@dataclass(frozen=True)
class CategoryField:
    """A category to fill: the form of its values, the groups, coarse to fine, and the times its shares change by.

    prior: rows that a parent's shares count for in a group. most_classes: a column of more classes is no category.
    """

    column: str
    pattern: str
    groups: Sequence[Sequence[str]] = ()
    times: Sequence[str] = ()
    prior: float = 5.0
    most_classes: int = 200


def usable_number(f: NumericField) -> Column:
    """True where the stored value can be true of its record: no null, no NaN, in range, not refuted."""
    c = F.col(f"`{f.column}`").cast("double")
    ok = c.isNotNull() & ~F.isnan(c) & c.between(f.low, f.high)
    if f.refuted is not None:
        ok = ok & ~F.coalesce(f.refuted, F.lit(False))
    return F.coalesce(ok, F.lit(False))


def mask_column(name: str) -> str:
    return f"{name}__filled"


def missing_mask(f: NumericField) -> Column:
    """True for a cell to be filled: eligible, and without a usable value."""
    eligible = F.lit(True) if f.eligible is None else F.coalesce(f.eligible, F.lit(False))
    return eligible & ~usable_number(f)


def _fixed_effects(df: DataFrame, targets: dict[str, Sequence[str]], ridge: float = 1e-6) -> dict[str, list[float]]:
    """Intercept and slopes of every target by normal equations, from one aggregation of sums of products."""
    value = lambda n: F.lit(1.0) if n == "1" else F.col(n)
    sums = []
    for t, (y, covariates) in enumerate(targets.items()):
        names = ["1", *covariates]
        complete = F.col(y).isNotNull()
        sums += [F.sum(F.when(complete, value(a) * value(b))).alias(f"s{t}_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
        sums += [F.sum(F.when(complete, value(a) * F.col(y))).alias(f"y{t}_{i}") for i, a in enumerate(names)]
    row = df.agg(*sums).first()
    out = {}
    for t, (y, covariates) in enumerate(targets.items()):
        k = len(covariates) + 1
        if row[f"s{t}_0_0"] is None:
            out[y] = [0.0] * k
            continue
        xx = np.array([[row[f"s{t}_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], dtype=float)
        xy = np.array([row[f"y{t}_{i}"] for i in range(k)], dtype=float)
        scale = np.sqrt(np.maximum(np.diag(xx), 1e-12))
        out[y] = [float(b) for b in np.linalg.solve(xx / np.outer(scale, scale) + ridge * np.eye(k), xy / scale) / scale]
    return out


def _shrunk_effects(df: DataFrame, residuals: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """A row for each group with the shrunk mean of each residual, cut from its history.

    The variance ratio comes from one-way sums of squares over all groups (a method of moments, exact in one
    pass over the group table). A hot group is aggregated before the shuffle.
    """
    stats = []
    for i, r in enumerate(residuals):
        stats += [F.count(r).alias(f"n{i}"), F.avg(r).alias(f"m{i}"), F.sum(F.col(r) * F.col(r)).alias(f"q{i}")]
    known = df
    for k in keys:
        known = known.filter(F.col(k).isNotNull())
    groups = cut(known.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(*stats))
    sums = []
    for i in range(len(residuals)):
        n, m, q = F.col(f"n{i}"), F.col(f"m{i}"), F.col(f"q{i}")
        for name, c in (("n", n), ("g", (n > 0).cast("int")), ("nn", n * n), ("within", q - n * m * m), ("raw", n * m * m), ("tot", n * m)):
            sums.append(F.sum(c).alias(f"{name}{i}"))
    s = groups.agg(*sums).first()
    effects = []
    for i in range(len(residuals)):
        n, g = float(s[f"n{i}"] or 0), float(s[f"g{i}"] or 0)
        effect = F.lit(0.0)
        if n:
            mean = s[f"tot{i}"] / n
            within = s[f"within{i}"] / max(n - g, 1.0)
            between = (s[f"raw{i}"] - n * mean * mean) / max(g - 1.0, 1.0) - within
            between /= max((n - s[f"nn{i}"] / n) / max(g - 1.0, 1.0), 1e-9)
            if between > 0:
                effect = F.coalesce(F.col(f"m{i}") * F.col(f"n{i}") / (F.col(f"n{i}") + F.lit(within / between)), F.lit(0.0))
        effects.append(effect.alias(f"_e{i}"))
    return groups.select(*[f"_k{i}" for i in range(len(keys))], *effects)


def _with_effects(df: DataFrame, tables: dict[int, DataFrame], groups: Sequence[Sequence[str]]) -> DataFrame:
    """df with the effects of every table of ``tables`` (grouping -> table) as _e<grouping>_<i>; null where a row is in none."""
    for g, table in tables.items():
        keys = [F.col(f"_k{i}").alias(f"_k{g}_{i}") for i in range(len(groups[g]))]
        effects = [F.col(c).alias(f"_e{g}_{c[2:]}") for c in table.columns if c.startswith("_e")]
        on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_k{g}_{i}") for i, k in enumerate(groups[g])])
        df = df.join(table.select(*keys, *effects), on, "left").drop(*[f"_k{g}_{i}" for i in range(len(groups[g]))])
    return df


def fill_numeric(df: DataFrame, fields: Sequence[NumericField], groups: Sequence[Sequence[str]], sweeps: int = 2) -> DataFrame:
    """``df`` with the fields filled and ``<field>__filled`` saying which cells were.

    groups: groupings of the random effects, time among them; rows with a null in a key get no effect of that
    grouping. A prediction outside of what the value can be at all is put at its bound. Rows keep their number.
    Cells that are not eligible keep their null. With no usable value anywhere, or an empty table, nothing can be
    learnt: such cells get ``derived`` where given, else the value nearest 0 that can be, and stay marked. Ties,
    repeated rows and other columns have no effect. Each sweep runs one small action for the fixed effects and two
    for each grouping; what is kept between them is the group tables, never the rows.
    """
    work, targets = df, {}
    for t, f in enumerate(fields):
        names = [f"_x{t}_{i}" for i in range(len(f.covariates))]
        columns = {n: F.when(~F.isnan(c.cast("double")), c.cast("double")) for n, c in zip(names, f.covariates.values())}
        columns |= {f"_y{t}": F.when(usable_number(f), F.col(f"`{f.column}`").cast("double")), f"_m{t}": missing_mask(f)}
        if f.derived is not None:
            columns[f"_d{t}"] = f.derived
        work = work.withColumns(columns)
        targets[f"_y{t}"] = names
    covariates = [n for names in targets.values() for n in names]
    if covariates:
        # where a covariate isn't known the row is predicted at its mean, which says nothing either way
        means = work.agg(*[F.avg(F.when(F.col(y).isNotNull(), F.col(n))).alias(n) for y, names in targets.items() for n in names]).first()
        work = work.withColumns({n: F.coalesce(F.col(n), F.lit(float(means[n] or 0.0))) for n in covariates})
    ys = list(targets)
    keys = list(dict.fromkeys(k for g in groups for k in g))
    known = work.select(*keys, *ys, *covariates).filter(reduce(lambda a, b: a | b, [F.col(y).isNotNull() for y in ys]))
    tables: dict[int, DataFrame] = {}
    beta: dict[str, list[float]] = {}

    def fixed(y: str) -> Column:
        return reduce(lambda a, b: a + b, [F.lit(b) * F.col(n) for n, b in zip(targets[y], beta[y][1:])], F.lit(beta[y][0]))

    def effects(i: int, of: Iterable[int]) -> Column:
        return reduce(lambda a, b: a + b, [F.coalesce(F.col(f"_e{g}_{i}"), F.lit(0.0)) for g in of], F.lit(0.0))

    for _ in range(sweeps):
        rest = _with_effects(known, tables, groups).withColumns({f"_r{y}": F.col(y) - effects(i, tables) for i, y in enumerate(ys)})
        fitted = _fixed_effects(rest, {f"_r{y}": names for y, names in targets.items()})
        beta = {y: fitted[f"_r{y}"] for y in ys}
        for g, by in enumerate(groups):
            others = {h: table for h, table in tables.items() if h != g}
            rest = _with_effects(known, others, groups).select(*by, *[(F.col(y) - fixed(y) - effects(i, others)).alias(f"_r{y}") for i, y in enumerate(ys)])
            tables[g] = _shrunk_effects(rest, [f"_r{y}" for y in ys], by)
    work = _with_effects(work, {g: t for g, t in tables.items()}, groups)
    done, extra = {}, [f"_e{g}_{i}" for g in tables for i in range(len(ys))]
    for t, (f, y) in enumerate(zip(fields, ys)):
        p = F.least(F.greatest(fixed(y) + effects(t, tables), F.lit(float(f.low))), F.lit(float(f.high)))
        p = F.coalesce(F.col(f"_d{t}"), p) if f.derived is not None else p
        done |= {f.column: F.when(F.col(y).isNotNull(), F.col(y)).when(F.col(f"_m{t}"), p), mask_column(f.column): F.col(f"_m{t}")}
        extra += [y, f"_m{t}", f"_d{t}", *targets[y]]
    return work.withColumns(done).drop(*extra)


def fill_category(df: DataFrame, f: CategoryField) -> DataFrame:
    """``df`` with the category filled by the most probable value of its group and time, and a mask of the filled cells.

    A group's share of a class is (count + prior * its parent's share) / (rows + prior), from the overall shares down to
    the finest group; a time changes the odds by its own shrunk share against the overall one. A group or time that is
    not known says nothing. Equal probabilities go to the first value in order. A value out of ``pattern`` counts as
    missing. The classes are read once (``most_classes`` of them; ValueError beyond), the counts are one column for each,
    so no group is paired with classes. With no usable value nothing is filled, but marked.
    """
    c = F.col(f"`{f.column}`")
    ok = F.coalesce(c.rlike(f"\\A(?:{f.pattern})\\z"), F.lit(False))
    work = df.withColumn(mask_column(f.column), ~ok).withColumn("_c", F.when(ok, c))
    known = work.filter(F.col("_c").isNotNull())
    totals = known.groupBy("_c").agg(F.count(F.lit(1)).alias("k")).limit(f.most_classes + 1).collect()
    if len(totals) > f.most_classes:
        raise ValueError(f"{f.column} has more than {f.most_classes} classes")
    if not totals:
        return work.withColumn(f.column, F.col("_c")).drop("_c")
    classes = sorted(r["_c"] for r in totals)
    n = sum(r["k"] for r in totals)
    overall = {r["_c"]: r["k"] / n for r in totals}
    shares: list[Column] = [F.lit(overall[x]) for x in classes]

    def joined(frame: DataFrame, by: Sequence[str], tag: str) -> DataFrame:
        counts = known.groupBy(*[F.col(k).alias(f"_{tag}k{i}") for i, k in enumerate(by)]).agg(F.count(F.lit(1)).alias(f"_{tag}n"), *[F.count(F.when(F.col("_c") == x, 1)).alias(f"_{tag}c{j}") for j, x in enumerate(classes)])
        on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{tag}k{i}") for i, k in enumerate(by)])
        return frame.join(counts, on, "left")

    def shrunk(tag: str, parents: Sequence[Column]) -> list[Column]:
        rows = F.coalesce(F.col(f"_{tag}n"), F.lit(0))
        return [(F.coalesce(F.col(f"_{tag}c{j}"), F.lit(0)) + f.prior * p) / (rows + f.prior) for j, p in enumerate(parents)]

    tags = []
    for i, by in enumerate(f.groups):
        work, shares = joined(work, by, f"g{i}"), shrunk(f"g{i}", shares)
        tags.append((f"g{i}", len(by)))
    base = [F.lit(overall[x]) for x in classes]
    for i, time in enumerate(f.times):
        work = joined(work, [time], f"t{i}")
        shares = [s * r / b for s, r, b in zip(shares, shrunk(f"t{i}", base), base)]
        tags.append((f"t{i}", 1))
    # the first of equal ones: classes are in order, so the greatest (probability, place from the end) wins
    best = F.greatest(*[F.struct(s.alias("p"), F.lit(-j).alias("j"), F.lit(x).alias("c")) for j, (s, x) in enumerate(zip(shares, classes))]) if len(classes) > 1 else F.struct(F.lit(classes[0]).alias("c"))
    spare = [x for tag, k in tags for x in (f"_{tag}n", *[f"_{tag}k{i}" for i in range(k)], *[f"_{tag}c{j}" for j in range(len(classes))])]
    return work.withColumn(f.column, F.coalesce(F.col("_c"), best["c"])).drop("_c", *spare)


def filled_cells(filled: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field_name) of every cell that the masks mark and the model gave a value."""
    marks = F.array_compact(F.array(*[F.when(F.col(mask_column(c)) & F.col(f"`{c}`").isNotNull(), F.lit(c)) for c in fields]))
    return filled.select(key, F.explode(marks).alias("field_name"))
