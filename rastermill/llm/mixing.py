"""Mixing sources to target weights by min-cost flow.

Documents are summed by membership pattern (the set of sources that a document belongs to). Token
capacity flows from each pattern, once free and again at a convex cost for repetitions, to the
sources' quotas. Sources that no pattern ties together are networks of their own, and one source alone
needs no search for paths. The flow tells how many words of each pattern the mix takes: every document of
the pattern so many whole times, and once more those that come first in a seeded order, up to the
rest. Where that order is cut is found with histograms of the seeded key, level by level, so that
no task ever sorts a source.

The driver holds a row for each membership pattern and none for a document.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import WORD, materialize, prepare

#: A document is taken so many times at most.
MOST = 3
SEED = 20
#: Patterns up to which their table is broadcast; more are joined as Spark sees fit.
BROADCAST_PATTERNS = 10_000
#: Bits of the seeded key that each histogram resolves.
LEVEL_BITS = 12
LEVELS = 2


def targets(sizes: list[int], weights: list[float], most: int = MOST) -> list[float]:
    """Shares of sum(sizes) by weight; none above most * size, the excess reshared by weight."""
    out = [0.0] * len(sizes)
    rest, weight = float(sum(sizes)), float(sum(weights))
    # Who is above gets there first the smaller its size for its weight.
    order = sorted(range(len(sizes)), key=lambda i: sizes[i] / weights[i] if weights[i] else float("inf"))
    for k, i in enumerate(order):
        if not weight or rest * weights[i] / weight <= most * sizes[i]:
            weight = float(sum(weights[j] for j in order[k:]))
            for j in order[k:]:
                out[j] = rest * weights[j] / weight if weight else 0.0
            break
        out[i] = float(most * sizes[i])
        rest, weight = rest - out[i], weight - weights[i]
    return out


class Network:
    """Min-cost flow by successive shortest paths with potentials."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, s: int, t: int) -> None:
        high = [0] * len(self.out)
        while True:
            dist: list[float] = [float("inf")] * len(self.out)
            via = [-1] * len(self.out)
            dist[s], queue = 0, [(0.0, s)]
            while queue:
                d, a = heapq.heappop(queue)
                if d > dist[a]:
                    continue
                for e in self.out[a]:
                    b = self.to[e]
                    if self.room[e] and (n := d + self.cost[e] + high[a] - high[b]) < dist[b]:
                        dist[b], via[b] = n, e
                        heapq.heappush(queue, (n, b))
            if via[t] < 0:
                return
            for i, d in enumerate(dist):
                high[i] += int(d) if d < float("inf") else 0
            least, at = self.room[via[t]], t
            while at != s:
                least, at = min(least, self.room[via[at]]), self.to[via[at] ^ 1]
            at = t
            while at != s:
                self.room[via[at]] -= least
                self.room[via[at] ^ 1] += least
                at = self.to[via[at] ^ 1]


@dataclass
class Plan:
    """What the mix takes. sources: name -> (size, target); words: pattern -> words taken, repeats counted; routed: (pattern, source) -> words."""

    sources: dict[str | None, tuple[int, float]]
    words: dict[tuple, int]
    routed: dict[tuple, int]


def tied(patterns: dict[tuple, int]) -> list[list[tuple]]:
    """The patterns in groups that share sources, directly or through others."""
    up: dict = {}

    def find(s):
        while up.setdefault(s, s) != s:
            up[s] = up[up[s]]
            s = up[s]
        return s

    for p in patterns:
        for s in p[1:]:
            up[find(s)] = find(p[0])
    groups: dict = {}
    for p in patterns:
        groups.setdefault(find(p[0]), []).append(p)
    return list(groups.values())


def solve(patterns: dict[tuple, int], weights: dict[str | None, float], most: int = MOST) -> Plan:
    """patterns: tuple of sources -> words. A repetition k costs k^2 a word, so repeats are spread thinly."""
    size = dict.fromkeys(weights, 0)
    for p, n in patterns.items():
        for s in p:
            size[s] += n
    share = sum(patterns.values()) / max(1, sum(size.values()))  # sources that overlap count a word more than once
    wanted = {s: w * share for s, w in zip(weights, targets(list(size.values()), list(weights.values()), most), strict=True)}
    words, routed = {}, {}
    for group in tied(patterns):
        if len(group) == 1 and len(group[0]) == 1:
            p = group[0]
            words[p] = routed[p, p[0]] = min(round(wanted[p[0]]), most * patterns[p])
            continue
        sources = {s: k for k, s in enumerate(dict.fromkeys(s for p in group for s in p))}
        net = Network(2 + len(group) + len(sources))
        copies, routes = {}, {}
        for i, p in enumerate(group):
            copies[p] = [net.arc(0, 2 + i, patterns[p], k * k) for k in range(most)]
            for s in p:
                routes[p, s] = net.arc(2 + i, 2 + len(group) + sources[s], most * patterns[p], 0)
        for s, j in sources.items():
            net.arc(2 + len(group) + j, 1, round(wanted[s]), 0)
        net.run(0, 1)
        words |= {p: sum(net.room[e ^ 1] for e in arcs) for p, arcs in copies.items()}
        routed |= {k: net.room[e ^ 1] for k, e in routes.items()}
    return Plan({s: (size[s], wanted[s]) for s in weights}, words, routed)


def cycle_weights(names: list[str | None], cycle: tuple[float, ...] = (1, 2, 3)) -> dict[str | None, float]:
    """Weights 1, 2, 3 repeating over the names by code point, null last."""
    ordered = sorted((n for n in names if n is not None)) + [None] * (None in names)
    return {n: float(cycle[i % len(cycle)]) for i, n in enumerate(ordered)}


def mix(df: DataFrame, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken, *keep) for each row; taken / size is how often the mix has it.

    source_col may be a string or an array of strings (overlapping sources); for an array,
    source_size and target are sums over the document's sources. A null source is a source of its
    own, as is an empty array. A null or empty text has size 0 and is taken with 0 words. Rows with equal ids,
    repeated ones too, share their place in the seeded order: they are taken equally often. An empty table gives no rows.
    weights: 1, 2, 3 repeating where not given.
    """
    prepare(df.sparkSession)
    source = df[source_col]
    many = isinstance(df.schema[source_col].dataType, T.ArrayType)
    pattern = F.array_sort(F.array_distinct(F.when(F.size(source) > 0, source).otherwise(F.array(F.lit(None).cast("string"))))) if many else F.array(source.cast("string"))
    sized = df.select(
        df[id_col].cast("long").alias("doc_id"), pattern.alias("pattern"), F.regexp_count(F.coalesce(df[text_col], F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), df[id_col].cast("long")), 1).alias("key"), *(df[c].alias(f"_keep_{i}") for i, c in enumerate(keep)),
    )
    light = materialize(sized.select("doc_id", "pattern", "size", "key"), "mix")
    totals = light.groupBy("pattern").agg(F.sum("size").alias("n")).collect()  # a row for each membership pattern
    small = F.broadcast if len(totals) <= BROADCAST_PATTERNS else lambda table: table
    patterns = {tuple(r["pattern"]): int(r["n"]) for r in sorted(totals, key=lambda r: [(x is None, x or "") for x in r["pattern"]])}
    plan = solve(patterns, weights or cycle_weights(sorted({s for p in patterns for s in p}, key=lambda s: (s is None, s or ""))), most)

    rest = {p: plan.words[p] % n if n else 0 for p, n in patterns.items()}
    spark = df.sparkSession
    fields = "pattern array<string>, whole long, rest long, source_size long, target double"
    chosen = small(spark.createDataFrame([(list(p), plan.words[p] // n if n else 0, rest[p], sum(plan.sources[s][0] for s in p), float(sum(plan.sources[s][1] for s in p))) for p, n in patterns.items()] or [], fields))
    cut = small(cutting_keys(light, chosen, small))
    out = (sized if keep else light).join(chosen, "pattern").join(cut, "pattern", "left")
    times = F.col("whole") + (F.col("key") <= F.coalesce("cut", F.lit(-1))).cast("long")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.least(times, F.lit(most))).alias("taken"), *(F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)), *([F.least(times, F.lit(most)).alias("times")] if keep else []))


def cutting_keys(light: DataFrame, chosen: DataFrame, small=F.broadcast) -> DataFrame:
    """(pattern, cut): the documents with keys up to `cut` have as nearly as may be `rest` words together.

    Each level sums sizes by the next LEVEL_BITS bits of the key, finds the slot in which the sum
    passes `rest` and goes on within it; the last sorts single rows of a slot that holds 2^-24 of
    the pattern's. One row a pattern comes back.
    """
    spark = light.sparkSession
    slots = chosen.where("rest > 0").select("pattern", F.lit(0).cast("long").alias("prefix"), "rest")
    for level in range(LEVELS):
        shift = 63 - LEVEL_BITS * (level + 1)
        inside = light.join(small(slots), "pattern").where(F.shiftright("key", shift + LEVEL_BITS) == F.col("prefix"))
        sums = inside.groupBy("pattern", "rest", F.shiftright("key", shift).alias("slot")).agg(F.sum("size").alias("n"))
        w = Window.partitionBy("pattern").orderBy("slot")
        passed = sums.withColumn("upto", F.sum("n").over(w)).where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("n") < F.col("rest")))
        slots = spark.createDataFrame(passed.select("pattern", "slot", F.col("rest") - (F.col("upto") - F.col("n"))).collect(), "pattern array<string>, prefix long, rest long")
    inside = light.join(small(slots), "pattern").where(F.shiftright("key", shift) == F.col("prefix"))
    w = Window.partitionBy("pattern").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    last = inside.withColumn("upto", F.sum("size").over(w)).where(F.col("upto") - F.col("size") / 2 <= F.col("rest")).groupBy("pattern").agg(F.max("key").alias("last"))
    found = slots.join(last, "pattern", "left").select("pattern", F.coalesce("last", F.shiftleft("prefix", shift) - 1).alias("cut"))
    return spark.createDataFrame(found.collect(), "pattern array<string>, cut long")
