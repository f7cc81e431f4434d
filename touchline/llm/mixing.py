"""Mixing sources to target shares by a flow from membership patterns to source quotas.

One text may stand under several sources. Texts are aggregated by the set of sources they stand under; the
table of those patterns is small (at most 2 to the number of sources). Tokens flow from the uses of a pattern
(first, second, ... use of its texts) to the quotas of its sources; the n-th use costs more the larger n is, a
convex cost, so no text is repeated while a fresh one would do. The total is the largest for which every source
that has texts reaches its share exactly; texts are then drawn in seeded order.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.plans.lineage import cut


class Network:
    """A small flow network with real capacities; successive shortest paths (Bellman-Ford with a queue)."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.cap: list[float] = []
        self.cost: list[float] = []

    def edge(self, a: int, b: int, cap: float, cost: float = 0.0) -> int:
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0.0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def run(self, source: int, sink: int, eps: float = 1e-6) -> float:
        """Sends as much as possible at least cost; returns the amount."""
        total = 0.0
        while True:
            n = len(self.out)
            dist, via, queued = [float("inf")] * n, [-1] * n, [False] * n
            dist[source] = 0.0
            queue = deque([source])
            while queue:
                a = queue.popleft()
                queued[a] = False
                for e in self.out[a]:
                    b = self.to[e]
                    if self.cap[e] > eps and dist[a] + self.cost[e] < dist[b] - 1e-9:
                        dist[b], via[b] = dist[a] + self.cost[e], e
                        if not queued[b]:
                            queued[b] = True
                            queue.append(b)
            if via[sink] < 0:
                return total
            push, b = float("inf"), sink
            while b != source:
                push = min(push, self.cap[via[b]])
                b = self.to[via[b] ^ 1]
            b = sink
            while b != source:
                self.cap[via[b]] -= push
                self.cap[via[b] ^ 1] += push
                b = self.to[via[b] ^ 1]
            total += push


@dataclass(frozen=True)
class Target:
    source: str
    share: float
    repeats: int


def plan(patterns: dict[tuple[str, ...], float], targets: Sequence[Target]) -> tuple[float, list[tuple[tuple[str, ...], int, str, float]]]:
    """(total, flows): flows are (pattern, use, source, tokens). The n-th use of a text counts for sources that allow n uses."""
    have = {s for p in patterns for s in p}
    live = [t for t in targets if t.source in have and t.share > 0 and t.repeats > 0]
    if not live:
        return 0.0, []
    index = {t.source: i for i, t in enumerate(live)}
    uses = [(p, r) for p in sorted(patterns) for r in range(1, max([t.repeats for t in live if t.source in p], default=0) + 1)]

    def solve(total: float) -> tuple[float, Network, list[tuple[int, int, int]]]:
        net = Network(2 + len(live) + len(uses))
        edges = []
        for i, t in enumerate(live):
            net.edge(2 + i, 1, t.share * total)
        for k, (p, r) in enumerate(uses):
            net.edge(0, 2 + len(live) + k, patterns[p], float(r - 1))
            for s in p:
                if s in index and live[index[s]].repeats >= r:
                    edges.append((net.edge(2 + len(live) + k, 2 + index[s], float("inf")), k, index[s]))
        return net.run(0, 1), net, edges

    weight = sum(t.share for t in live)
    high = sum(sum(v for p, v in patterns.items() if t.source in p) * t.repeats for t in live) / weight
    low = 0.0
    for _ in range(50):
        mid = (low + high) / 2
        if solve(mid)[0] >= weight * mid * (1 - 1e-9):
            low = mid
        else:
            high = mid
    total = low
    _, net, edges = solve(total)
    flows = [(uses[k][0], uses[k][1], live[i].source, net.cap[e ^ 1]) for e, k, i in edges if net.cap[e ^ 1] > 1e-6]
    return total, flows


#: Rows up to which the table of patterns, 2 to the number of sources at most, is sent to every executor.
MOST_BROADCAST = 10_000


def mix(texts: DataFrame, targets: DataFrame, seed: int = 42, rounds: int = 3) -> DataFrame:
    """(doc_id, source, use, tokens): the texts of the mix, use 1, 2, ... of each.

    texts: doc_id, source, text_key (equal for equal texts), tokens. targets: source, target_share, max_repeats.
    Equal texts are one text, known by their lowest doc_id and standing under all their sources. Sources without
    target, null sources and null or zero sizes contribute nothing; a target whose source has no text stays at
    0. A text that would overrun its source's quota is passed over, and ``rounds`` more draws fill what is then
    missing with texts that fit and may be used (again), so shares end within a short text of the plan. Empty tables give no rows.
    The driver sees the pattern table and sums of fixed-width hash buckets, never texts.
    """
    goals = [Target(r["source"], float(r["target_share"]), int(r["max_repeats"])) for r in targets.filter("source is not null and target_share is not null and max_repeats is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).collect()]
    known = [g.source for g in goals]
    one = texts.filter(F.col("source").isin(known) & (F.col("tokens") > 0)).groupBy("text_key").agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens"), F.array_sort(F.collect_set("source")).alias("pattern"))
    one = cut(one.withColumn("draw", F.xxhash64(F.lit(seed), F.col("text_key"))))
    totals = {tuple(r["pattern"]): float(r["t"]) for r in one.groupBy("pattern").agg(F.sum("tokens").alias("t")).collect()}
    _, flows = plan(totals, goals)
    stretches = []
    at: dict[tuple[tuple[str, ...], int], float] = {}
    for pattern, use, source, amount in sorted(flows):
        a = at.get((pattern, use), 0.0)
        stretches.append((list(pattern), use, source, a, a + amount))
        at[(pattern, use)] = a + amount
    spark = texts.sparkSession
    schema = "pattern array<string>, use int, source string, a double, b double"
    taken = spark.createDataFrame(stretches or [([], 0, "", 0.0, 0.0)], schema)
    placed = _positions(one)
    by_pattern = taken.groupBy("pattern").agg(F.collect_list(F.struct("use", "source", "a", "b")).alias("stretches"))  # uses x sources of a pattern
    start, end = F.col("position"), F.col("position") + F.col("tokens")
    within = F.filter("stretches", lambda x: (start >= x["a"] - 0.5) & (end <= x["b"] + 0.5))
    drawn = placed.join(F.broadcast(by_pattern) if len(totals) <= MOST_BROADCAST else by_pattern, "pattern").select("doc_id", "tokens", F.explode(within).alias("s"))
    out = cut(drawn.select("doc_id", "s.source", "s.use", "tokens"))
    quota: dict[str, float] = {}
    for _, _, source, amount in flows:
        quota[source] = quota.get(source, 0.0) + amount
    for _ in range(rounds):
        got = {r["source"]: float(r["t"]) for r in out.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}  # a row for each target
        short = {s: q - got.get(s, 0.0) for s, q in quota.items() if q - got.get(s, 0.0) >= 1}
        if not short:
            break
        out = cut(out.unionByName(_top_up(one, out, short, {g.source: g.repeats for g in goals})))
    return out


def _top_up(one: DataFrame, used: DataFrame, short: dict[str, float], repeats: dict[str, int]) -> DataFrame:
    """Another use of texts, each for one of its sources that lack tokens and allow it, as far as they fit in drawn order."""
    lack = F.create_map(*[x for s, v in short.items() for x in (F.lit(s), F.lit(v))])
    allowed = F.create_map(*[x for s in short for x in (F.lit(s), F.lit(repeats[s]))])
    uses = used.groupBy(F.col("doc_id").alias("_d")).agg(F.max("use").alias("_u"))
    open_ = one.join(uses, F.col("doc_id") == F.col("_d"), "left").withColumn("use", F.coalesce(F.col("_u"), F.lit(0)) + 1)
    mine = F.filter("pattern", lambda s: s.isin(list(short)) & (F.try_element_at(allowed, s) >= F.col("use")))
    open_ = open_.withColumn("_s", F.when(F.size(mine) > 0, F.get(mine, F.pmod(F.col("draw"), F.size(mine)).cast("int"))))
    fits = open_.filter(F.col("_s").isNotNull()).filter(F.col("tokens") <= lack[F.col("_s")])
    placed = _positions(fits.withColumn("pattern", F.array("_s")))
    return placed.filter(F.col("position") + F.col("tokens") <= lack[F.col("_s")]).select("doc_id", F.col("_s").alias("source"), "use", "tokens")


def _positions(one: DataFrame) -> DataFrame:
    """Tokens drawn before each text within its pattern, in the order of ``draw``; hash buckets keep a hot pattern in many tasks."""
    buckets = max(16, one.sparkSession.sparkContext.defaultParallelism * 4)
    width = 2**64 // buckets
    part = one.withColumn("_b", F.floor((F.col("draw").cast("double") + F.lit(float(2**63))) / F.lit(float(width))).cast("int"))
    sums = part.groupBy("pattern", "_b").agg(F.sum("tokens").alias("_t"))
    before = Window.partitionBy("pattern").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("pattern", "_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("pattern", "_b").orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    own = part.withColumn("_own", F.coalesce(F.sum("tokens").over(inner), F.lit(0)))
    return own.join(offsets, ["pattern", "_b"]).withColumn("position", F.col("_before") + F.col("_own")).drop("_b", "_own", "_before")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: its share, the tokens and share reached, texts used and the most uses of one text."""
    t = targets.select("source", "target_share", "max_repeats")
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count_distinct("doc_id").alias("texts"), F.count(F.lit(1)).alias("uses"))
    most = mixed.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("k")).groupBy("source").agg(F.max("k").alias("most_uses"))
    total = mixed.agg(F.sum("tokens").alias("all_tokens"))
    out = t.join(got, "source", "left").join(most, "source", "left").crossJoin(total)  # one row
    return out.select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("reached_share"), F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"))
