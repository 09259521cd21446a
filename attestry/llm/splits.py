"""Splits that keep related records together: connected components are bundled by identical size and label profile, a
min-cost flow from bundles to splits, with costs on deviation from the quotas of labels and of splits, places them in
whole components, and a component's place in the order of its hash decides which of its bundle it is."""

from __future__ import annotations

from collections.abc import Callable
from heapq import heappop, heappush

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.components import components
from attestry.session import broadcast_if_small, cut

#: Cost of a row beyond a label's quota in a split, and beyond the split's whole quota, in units of COST_STEPS a row.
LABEL_COST, TOTAL_COST, COST_STEPS = 1, 8, 64
#: Hash buckets per bundle in which members are ranked apart.
RANK_BUCKETS = 256


def links_by_key(df: DataFrame, node: str, key: str) -> DataFrame:
    """Links (a, b) from every node to the smallest node that shares its key. Keys that one node alone holds drop out in
    a fold before anything is joined."""
    held = df.where(F.col(node).isNotNull() & F.col(key).isNotNull()).select(F.col(node).alias("a"), F.col(key).alias("__k"))
    shared = held.groupBy("__k").agg(F.min("a").alias("b"), F.max("a").alias("__m")).where("b < __m").select("__k", "b")
    return held.join(shared, "__k").where("a <> b").select("a", "b").distinct()


def with_component(df: DataFrame, row_id: str, node: str, key: str) -> DataFrame:
    """df with __comp: rows that share a node or a key, directly or through others, have the same.

    A row without a node goes with the component of its key, a row without either stands alone.
    """
    labels = components(links_by_key(df, node, key)).withColumnRenamed("node", node).withColumnRenamed("label", "__label")
    out = df.where(F.col(node).isNotNull()).join(labels, node, "left").withColumn("__comp", F.concat(F.lit("p:"), F.coalesce("__label", node).cast("string")))
    bare = df.where(F.col(node).isNull())
    wanted = bare.where(F.col(key).isNotNull()).select(key).distinct()
    by_key = out.join(wanted, key, "left_semi").groupBy(key).agg(F.min("__comp").alias("__kc"))
    keyed = bare.where(F.col(key).isNotNull()).join(by_key, key, "left").withColumn("__comp", F.coalesce("__kc", F.concat(F.lit("k:"), F.col(key)))).drop("__kc")
    alone = bare.where(F.col(key).isNull()).withColumn("__comp", F.concat(F.lit("r:"), F.col(row_id).cast("string")))
    return out.drop("__label").unionByName(keyed).unionByName(alone)


class Flow:
    """Min-cost flow by successive shortest paths with potentials, integer capacities."""

    def __init__(self, n: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, cap: int, cost: int) -> int:
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def run(self, s: int, t: int) -> None:
        pot = [0] * len(self.out)
        while True:
            dist: list[float] = [float("inf")] * len(self.out)
            dist[s], via, heap = 0, [-1] * len(self.out), [(0, s)]
            while heap:
                d, v = heappop(heap)
                if d > dist[v]:
                    continue
                for e in self.out[v]:
                    u = self.to[e]
                    if self.cap[e] and (nd := d + self.cost[e] + pot[v] - pot[u]) < dist[u]:
                        dist[u], via[u] = nd, e
                        heappush(heap, (nd, u))
            if via[t] < 0:
                return
            pot = [p + (d if d < float("inf") else 0) for p, d in zip(pot, dist, strict=True)]
            push, v = float("inf"), t
            while v != s:
                push, v = min(push, self.cap[via[v]]), self.to[via[v] ^ 1]
            v = t
            while v != s:
                self.cap[via[v]] -= push
                self.cap[via[v] ^ 1] += push
                v = self.to[via[v] ^ 1]


def quotas(total: int, shares: list[int]) -> list[int]:
    """total parted by shares, by largest remainder."""
    whole = sum(shares) or 1
    out = [total * s // whole for s in shares]
    order = sorted(range(len(shares)), key=lambda i: (-(total * shares[i] % whole), i))
    for i in order[: total - sum(out)]:
        out[i] += 1
    return out


def _pieces(flow: Flow, a: int, b: int, most: int, cost: Callable[[int], float], edges: list[float]) -> list[int]:
    """Arcs for up to most components whose cost together is a convex function of their number, linear between edges."""
    near = {min(most, max(0, int(e) + k)) for e in edges for k in (0, 1)}
    points = sorted({0, most, *near})
    return [flow.arc(a, b, t - s, round((cost(t) - cost(s)) / (t - s))) for s, t in zip(points[:-1], points[1:], strict=True)]


def allocate(bundles: list[tuple[int, str, int]], shares: list[int], profiles: dict[tuple[int, str], dict[str, int]] | None = None, placed: dict[str, list[int]] | None = None) -> dict[tuple[int, str], list[int]]:
    """bundles: (size, name, components). Per bundle, how many of its components each split takes.

    profiles: rows per label of a bundle's components together, all under the bundle's name if it is not given; placed:
    rows per label and split that have their place already. Sizes are worked off from the largest down: the components of
    one size are the units of a flow from their bundles to the splits and on to the sink, so its answer is whole. Components
    of a bundle that go to a split cost LABEL_COST for every row by which a label then passes what it lacks there, and what
    reaches the sink costs TOTAL_COST for every row by which the split passes its share; of equal costs the split that
    lacks more takes more. What a size has placed is taken off before the next.
    """
    k = len(shares)
    profiles = profiles or {(s, x): {x: s * n} for s, x, n in bundles}
    rows: dict[str, int] = {lb: sum(v) for lb, v in (placed or {}).items()}
    for s, x, _ in bundles:
        for lb, m in profiles[s, x].items():
            rows[lb] = rows.get(lb, 0) + m
    lacks: dict[str, list[float]] = {lb: [q - p for q, p in zip(quotas(m, shares), (placed or {}).get(lb, [0] * k), strict=True)] for lb, m in rows.items()}
    total = [q - sum(v[j] for v in (placed or {}).values()) for j, q in enumerate(quotas(sum(rows.values()), shares))]
    out: dict[tuple[int, str], list[int]] = {}
    sizes: dict[int, list[tuple[str, int]]] = {}
    for s, x, n in bundles:
        sizes.setdefault(s, []).append((x, n))
    for size in sorted(sizes, reverse=True):
        own = sorted(sizes[size])
        flow = Flow(2 + len(own) + k)
        arcs: list[list[list[int]]] = []
        open_ = sum(max(0.0, v) for v in total) or 1.0
        for i, (x, n) in enumerate(own):
            flow.arc(0, 2 + i, n, 0)
            each = {lb: m / n for lb, m in profiles[size, x].items() if m}
            to = []
            for j in range(k):
                room = max(0.0, total[j]) / open_ * n  # this bundle's even share
                cost = lambda t, j=j, room=room: COST_STEPS * LABEL_COST * sum(max(0.0, t * m - max(0.0, lacks[lb][j])) for lb, m in each.items()) + max(0.0, t - room) * size  # noqa: B023, E731
                to.append(_pieces(flow, 2 + i, 2 + len(own) + j, n, cost, [room, *[max(0.0, lacks[lb][j]) / m for lb, m in each.items()]]))
            arcs.append(to)
        count = sum(n for _, n in own)
        for j in range(k):
            cost = lambda t, j=j: COST_STEPS * TOTAL_COST * max(0.0, t * size - max(0.0, total[j]))  # noqa: B023, E731
            _pieces(flow, 2 + len(own) + j, 1, count, cost, [max(0.0, total[j]) / size])
        flow.run(0, 1)
        for (x, n), to in zip(own, arcs, strict=True):
            take = [sum(flow.cap[e ^ 1] for e in arc) for arc in to]
            out[size, x] = take
            for j, t in enumerate(take):
                total[j] -= t * size
                for lb, m in profiles[size, x].items():
                    lacks[lb][j] -= m * t / n
    return out


def _ranked(comps: DataFrame, keys: list[str]) -> DataFrame:
    """comps with __n, how many have the same keys, and __place, 1 for the first by hash. Ranks run within hash buckets, and
    buckets are counted, so a bundle that holds a third of all components is sorted in many tasks."""
    counts = comps.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__own"))
    w = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("__own").over(w.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = counts.select(*keys, "__b", before.alias("__before"), F.sum("__own").over(w).alias("__n"))
    rank = F.row_number().over(Window.partitionBy(*keys, "__b").orderBy("__h", "__comp"))
    return comps.withColumn("__r", rank).join(edges, [*keys, "__b"]).withColumn("__place", F.col("__before") + F.col("__r")).drop("__before", "__r")


def _profiled(rows: DataFrame, seed: str) -> DataFrame:
    """Per component its size, label profile, main label, hash and hash bucket."""
    by = rows.groupBy("__comp", "__lb").agg(F.count(F.lit(1)).alias("n"))
    comps = by.groupBy("__comp").agg(F.sum("n").alias("size"), F.max_by("__lb", F.struct("n", F.col("__lb"))).alias("main"), F.sort_array(F.collect_list(F.struct("__lb", "n"))).alias("profile"))  # one entry per label
    h = F.sha2(F.concat(F.lit(seed + "|"), F.col("__comp")), 256)
    return comps.withColumn("__h", h).withColumn("__b", (F.conv(F.substring("__h", 1, 8), 16, 10).cast("bigint") % RANK_BUCKETS).cast("int"))


def assign(df: DataFrame, row_id: str, node: str, key: str, label: str, splits: list[tuple[str, int]], seed: str = "split") -> DataFrame:
    """(row id, node, component, split): shares as splits asks, by rows and by each label's rows, with every component whole.

    A bundle is all components of one size and one vector of rows per label. Of n of them each split takes the whole part
    of n times its share, which is what the flow's free arcs carry; it is computed in place, bundle by bundle, in the
    order of hashes. The components left over, fewer than there are splits in each bundle, are bundled by size and main
    label with the vectors added up, and allocate() solves the flow for them from the largest size down. At most L *
    sqrt(2 N) such bundles reach the driver, with L labels and N rows, as that many sizes use up all rows; labels are
    classes, of which there are few. A main label is the one with most rows, ties to the larger text; a NULL label counts
    as empty. A row without a node goes with its key's component, one without either stands alone. Other columns are not
    read; an empty table gives no rows. A component larger than a split's share goes where it does least harm, as a rule
    to the largest split.
    """
    spark = df.sparkSession
    names, shares = [s for s, _ in sorted(splits)], [p for _, p in sorted(splits)]
    rows = cut(with_component(df, row_id, node, key).select(row_id, node, "__comp", F.coalesce(F.col(label), F.lit("")).alias("__lb")))
    ranked = _ranked(_profiled(rows, seed), ["size", "profile"])
    upto = [sum((F.floor(F.col("__n") * p / (sum(shares) or 1)) for p in shares[: j + 1]), F.lit(0)) for j in range(len(shares))]
    own = F.coalesce(*[F.when(F.col("__place") <= u, F.lit(n)) for u, n in zip(upto, names, strict=True)])
    placed = cut(ranked.select("__comp", "size", "main", "profile", "__h", "__b", own.alias("split")))
    rest = placed.where("split IS NULL")
    label_rows = placed.select("split", "size", "main", F.explode("profile").alias("p"))
    done = label_rows.where("split IS NOT NULL").groupBy("split", "p.__lb").agg(F.sum("p.n").alias("n")).collect()  # splits x labels
    placed_rows: dict[str, list[int]] = {}
    for r in done:
        placed_rows.setdefault(r["__lb"], [0] * len(names))[names.index(r["split"])] = r["n"]
    profiles: dict[tuple[int, str], dict[str, int]] = {}
    for r in label_rows.where("split IS NULL").groupBy("size", "main", "p.__lb").agg(F.sum("p.n").alias("n")).toLocalIterator():
        profiles.setdefault((r["size"], r["main"]), {})[r["__lb"]] = r["n"]
    bundles = [(s, m, sum(v.values()) // s) for (s, m), v in profiles.items()]
    plan = allocate(bundles, shares, profiles, placed_rows)
    cuts = spark.createDataFrame([(s, m, [sum(t[: j + 1]) for j in range(len(t))]) for (s, m), t in plan.items()], "size bigint, main string, upto array<bigint>")
    at = F.size(F.filter("upto", lambda u: u < F.col("__place")))
    late = _ranked(rest.select("__comp", "size", "main", "__h", "__b"), ["size", "main"]).join(broadcast_if_small(cuts), ["size", "main"])
    owner = placed.where("split IS NOT NULL").select("__comp", "split").unionByName(late.select("__comp", F.get(F.array(*[F.lit(n) for n in names]), at).alias("split")))
    return rows.join(owner, "__comp").select(row_id, node, F.col("__comp").alias("component"), "split")
