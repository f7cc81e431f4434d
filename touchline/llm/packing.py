"""Filling containers: dominance reduction over a histogram of sizes, best fit for the rest.

Which items go together depends on their sizes only, and there are no more different sizes than a container has
tokens. So the instance is a histogram: sizes with counts. Reduction and best fit work on classes of equal
containers (a multiset of sizes, and how many containers hold it), in memory bounded by the capacity, not by
the number of texts. The classes then go back to the rows: texts of a size are numbered, and a class holds
runs of numbers.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.plans.lineage import cut

#: Numbers of a size are handled in stretches of this length, so that a size most texts share is split.
STRETCH = 50_000


class _Sizes:
    """Sizes left with their counts, in order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {s: k for s, k in counts.items() if k > 0}
        self.order = sorted(self.n)

    def take(self, size: int, k: int) -> None:
        self.n[size] -= k
        if self.n[size] == 0:
            del self.n[size]
            self.order.pop(bisect_left(self.order, size))

    def smallest(self, k: int, without: int) -> list[int]:
        """The k smallest items, one item of size ``without`` set aside; fewer where there are fewer."""
        out: list[int] = []
        for s in self.order:
            out += [s] * min(self.n[s] - (s == without), k - len(out))
            if len(out) == k:
                break
        return out

    def largest(self, limit: int, without: tuple[int, ...] = ()) -> int | None:
        """The largest size within the limit of which an item is left beside those set aside."""
        i = bisect_right(self.order, limit) - 1
        while i >= 0:
            s = self.order[i]
            if self.n[s] > without.count(s):
                return s
            i -= 1
        return None

    def best_pair(self, limit: int, without: int) -> tuple[int, int] | None:
        """Two items (larger first) whose sum comes nearest the limit from below."""
        lo, hi, best = 0, bisect_right(self.order, limit) - 1, None
        while 0 <= lo <= hi:
            a, b = self.order[hi], self.order[lo]
            if a + b > limit:
                hi -= 1
                continue
            if self.n[a] == (a == without):  # its only item is the one set aside
                hi -= 1
                continue
            enough = self.n[b] - (b == without) >= (2 if a == b else 1)
            if enough and (best is None or a + b > sum(best)):
                best = (a, b)
            lo += 1
        return best


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Container classes that some best packing contains, and the sizes left.

    For the largest item j in turn: alone where nothing else fits; with the largest item that fits where that
    fills the container or no two others fit; where two but no three fit, by comparing the best single partner
    with the best pair. Each such set dominates any other that could hold j, so fixing it loses nothing.
    """
    left, fixed = _Sizes(counts), []
    for j in sorted(left.n, reverse=True):
        while left.n.get(j, 0) > 0:
            room = capacity - j
            small = left.smallest(3, j)
            fits, total = 0, 0
            for s in small:
                total += s
                if total > room:
                    break
                fits += 1
            if fits == 0:
                fixed.append(((j,), left.n[j]))
                left.take(j, left.n[j])
                continue
            one = left.largest(room, (j,))
            chosen: tuple[int, ...] | None = None
            if one is None:
                break
            if fits == 1 or one == room:
                chosen = (j, one)
            elif fits == 2:
                pair = left.best_pair(room, j)
                if pair is None or one >= sum(pair):
                    chosen = (j, one)
                elif one == pair[0]:
                    i = bisect_left(left.order, pair[1])
                    above = left.order[i + 1 : i + 3]
                    if len(above) < 2 and left.n[pair[1]] < 2 or sum((above + [capacity] * 2)[:2]) > room and left.n[pair[1]] < 2:
                        chosen = (j, *pair)
            if chosen is None:
                break
            m = min(left.n[s] // chosen.count(s) for s in set(chosen))
            if m == 0:
                break
            fixed.append((chosen, m))
            for s in chosen:
                left.take(s, m)
    return fixed, dict(left.n)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, sizes falling, over classes of equal containers: each item goes where least room is left over."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # room left -> classes
    rooms: list[int] = []
    done: list[tuple[tuple[int, ...], int]] = []

    def put(items: tuple[int, ...], m: int, room: int) -> None:
        if room == 0:
            done.append((items, m))
            return
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append((items, m))

    for size in sorted(counts, reverse=True):
        k = counts[size]
        while k > 0:
            i = bisect_left(rooms, size)
            if i == len(rooms):
                per = capacity // size  # new containers take as many as they hold
                full, rest = divmod(k, per)
                if full:
                    put((size,) * per, full, capacity - per * size)
                if rest:
                    put((size,) * rest, 1, capacity - rest * size)
                break
            room = rooms[i]
            items, m = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(i)
            used = min(m, k)
            if used < m:
                put(items, m - used, room)
            put((*items, size), used, room - size)
            k -= used
    return done + [x for classes in open_.values() for x in classes]


def pack_sizes(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Classes (sizes, number of containers) that hold every item once; sizes must lie in 1..capacity."""
    fixed, left = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(left, capacity)


def _runs(classes: list[tuple[tuple[int, ...], int]], first_container: int) -> list[tuple[int, int, int, int]]:
    """(size, first number, last number + 1, first container): numbers of a size and the containers they fill, split by STRETCH."""
    used: dict[int, int] = {}
    runs: list[tuple[int, int, int, int]] = []
    container = first_container
    for items, m in classes:
        for s in items:
            a = used.get(s, 0)
            used[s] = a + m
            i = a
            while i < a + m:
                e = min(a + m, (i // STRETCH + 1) * STRETCH)
                runs.append((s, i, e, container + i - a))
                i = e
        container += m
    return runs


def numbered(items: DataFrame, size: str, order: str) -> DataFrame:
    """items with ``number``: 0, 1, ... within each size, without ever putting one size into one task.

    Rows are first numbered within (size, salt), salts by hash of the order column; the salts' counts, a table of
    sizes x salts, say where each salt begins.
    """
    salts = max(8, items.sparkSession.sparkContext.defaultParallelism * 4)
    salted = items.withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(salts)).cast("int"))
    counts = salted.groupBy(size, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(size).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(size, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(size, "_salt").orderBy(order)) - 1
    return salted.withColumn("_own", own).join(offsets, [size, "_salt"]).withColumn("number", F.col("_before") + F.col("_own")).drop("_salt", "_own", "_before")


def pack(items: DataFrame, item_id: str, tokens: str, capacity: int) -> DataFrame:
    """Where every item goes: (item_id, piece, start_token, end_token, tokens, container_id).

    An item within the capacity stays whole (piece 0). A larger one is cut into pieces that each fill a
    container, and one for the remainder, which is packed like any other item. Items of 0 tokens share container
    0 and use no room. Null sizes are no items. Items repeated under one id are placed as often. Ties between
    items of a size are settled by hash and id. Only the histogram of sizes (at most ``capacity`` rows) reaches
    the driver. No items, no rows.
    """
    spark = items.sparkSession
    sized = items.select(item_id, F.col(tokens).cast("long").alias("_t")).filter(F.col("_t").isNotNull())
    whole = F.floor(F.col("_t") / capacity)
    last = F.when(F.col("_t") % capacity > 0, whole).when(F.col("_t") == 0, F.lit(0)).otherwise(whole - 1)
    pieces = sized.select(item_id, F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("piece"), "_t")
    start = F.col("piece").cast("long") * capacity
    pieces = pieces.select(item_id, "piece", start.alias("start_token"), F.least(start + capacity, F.col("_t")).alias("end_token"))
    pieces = pieces.withColumn("tokens", F.col("end_token") - F.col("start_token")).withColumn("_order", F.struct(F.xxhash64(item_id), F.col(item_id), F.col("piece")))
    pieces = cut(pieces)
    counts = {int(r["tokens"]): int(r["n"]) for r in pieces.filter("tokens > 0").groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = _runs(pack_sizes(counts, capacity), 1)
    starts = spark.createDataFrame(runs or [(0, 0, 0, 0)], "tokens long, number long, _until long, _container long").filter("tokens > 0")
    placed = numbered(pieces.filter("tokens > 0"), "tokens", "_order").withColumn("_chunk", F.floor(F.col("number") / STRETCH))
    marks = starts.withColumn("_chunk", F.floor(F.col("number") / STRETCH)).select("tokens", "number", "_chunk", F.struct("number", "_container").alias("_run"))
    both = placed.withColumn("_run", F.lit(None).cast("struct<number:long,_container:long>")).unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy("tokens", "_chunk").orderBy("number", F.col("_run").isNull())
    found = both.withColumn("_run", F.last("_run", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col(item_id).isNotNull())
    columns = [item_id, "piece", "start_token", "end_token", "tokens"]
    full = found.select(*columns, (F.col("_run._container") + F.col("number") - F.col("_run.number")).alias("container_id"))
    return full.unionByName(pieces.filter("tokens = 0").select(*columns, F.lit(0).cast("long").alias("container_id")))
