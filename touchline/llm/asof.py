"""Nearest record in time by expanding rings.

Records of both sides fall into time buckets of a fine width. A left row looks at its own bucket and the two
beside it. A match no farther than the width is provably the nearest, for nothing closer can lie beyond the
neighbouring buckets; such rows are done. The others go on with buckets twice as wide, up to the tolerance.

Within a round nothing is paired: both sides are sorted together by (entity, bucket, time) and one pass with a
running last and a running next picks the neighbours; of the two adjacent buckets only the last and the first
record matter, so one record each is sent over. A row that goes on has no right record in its own bucket, so
from any bucket of the round it can only ever need the first or the last: the right side of the next round is
those edges, at most two records a bucket however many there were. A hot entity is split by time, and copies of
an instant are aggregated before the first shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.plans.lineage import cut


def micros(c: Column) -> Column:
    """Microseconds of a timestamp with or without zone, or of a date."""
    return F.unix_micros(c.cast("timestamp"))


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    entity: str,
    left_id: str,
    left_time: str,
    right_id: str,
    right_time: str,
    tolerance_days: float,
    first_width_days: float | None = None,
) -> DataFrame:
    """(left_id, right_id, distance_us): each left row's nearest right row of its entity, where one lies within the tolerance.

    Distances are inclusive. At equal distance the earlier right row wins, then the lower right id. Rows with a
    null entity, time or (right) id take no part. Left rows of one instant share their answer; repeated left ids
    come out as often as they came in. Other columns are not read. Empty sides give no rows. The number of
    rounds is log2(tolerance / first width), whatever the data hold; each round writes the rows still open.
    """
    tol = int(tolerance_days * 86_400_000_000)
    width = max(1, int((first_width_days or tolerance_days / 8) * 86_400_000_000))
    lrows = left.select(F.col(entity).alias("e"), micros(F.col(left_time)).alias("t"), F.col(left_id).alias("l")).filter("e is not null and t is not null")
    rrows = right.select(F.col(entity).alias("e"), micros(F.col(right_time)).alias("t"), F.col(right_id).alias("r")).filter("e is not null and t is not null and r is not null")
    everything = cut(rrows.groupBy("e", "t").agg(F.min("r").alias("r")))
    points, open_rows, done = everything, lrows.select("e", "t").distinct(), None
    while True:
        last = width >= tol
        answered = _round(open_rows, points, width)
        answered = answered if last else cut(answered)
        good = F.col("d") <= min(width, tol)
        hit = answered.filter(good).select("e", "t", "r", "d")
        done = hit if done is None else done.unionByName(hit)
        if last:
            break
        open_rows = answered.filter(~F.coalesce(good, F.lit(False))).select("e", "t")
        ends = F.when(F.col("lo.t") == F.col("hi.t"), F.array("lo")).otherwise(F.array("lo", "hi"))
        points = _edges(everything, width).select("e", F.explode(ends).alias("p")).select("e", "p.t", "p.r")
        width *= 2
    return lrows.join(done, ["e", "t"]).select(F.col("l").alias(left_id), F.col("r").alias(right_id), F.col("d").alias("distance_us"))


def _bucket(width: int) -> Column:
    return F.floor(F.col("t") / F.lit(width)).cast("long").alias("b")


def _edges(points: DataFrame, width: int) -> DataFrame:
    """The first and the last right record of every bucket; an instant has one record, so its id goes with the time."""
    ends = points.groupBy("e", _bucket(width)).agg(F.min("t").alias("t0"), F.min_by("r", "t").alias("r0"), F.max("t").alias("t1"), F.max_by("r", "t").alias("r1"))
    return ends.select("e", "b", F.struct(F.col("t0").alias("t"), F.col("r0").alias("r")).alias("lo"), F.struct(F.col("t1").alias("t"), F.col("r1").alias("r")).alias("hi"))


def _round(open_rows: DataFrame, points: DataFrame, width: int) -> DataFrame:
    """Each open row with its nearest right row of three buckets, null where they hold none."""
    r_type = points.schema["r"].dataType
    mine = open_rows.select("e", _bucket(width), "t", F.lit(None).cast(r_type).alias("r"), F.lit(True).alias("ask"))
    own = points.select("e", _bucket(width), "t", "r", F.lit(False).alias("ask"))
    over = F.array(F.struct((F.col("b") - 1).alias("b"), F.col("lo").alias("p")), F.struct((F.col("b") + 1).alias("b"), F.col("hi").alias("p")))
    sent = _edges(points, width).select("e", F.explode(over).alias("s")).select("e", "s.b", "s.p.t", "s.p.r", F.lit(False).alias("ask"))
    both = mine.unionByName(own).unionByName(sent).withColumn("point", F.when(~F.col("ask"), F.struct("t", "r")))
    # at one instant right rows stand before the left row, so that an exact match is the running last; both
    # functions move on with the row, so a bucket costs time in proportion to its rows
    w = "over (partition by e, b order by t, ask"
    before = F.expr(f"last(point) ignore nulls {w} rows between unbounded preceding and current row)")
    after = F.expr(f"lead(point) ignore nulls {w})")
    seen = both.select("e", "t", "ask", before.alias("p"), after.alias("q")).filter("ask")
    dp, dq = F.col("t") - F.col("p.t"), F.col("q.t") - F.col("t")
    back = F.col("p").isNotNull() & (F.col("q").isNull() | (dp <= dq))
    return seen.select("e", "t", F.when(back, F.col("p.r")).otherwise(F.col("q.r")).alias("r"), F.when(back, dp).otherwise(dq).alias("d"))
