"""Mixing sources to target weights by a flow of least cost.

Equal texts count once, with all sources that hold them: their membership pattern. Texts are
aggregated by pattern; the tokens of a pattern may be used again and again in layers of rising cost,
the r-th layer only for sources that allow r uses. A flow of least cost routes these capacities to the
quotas of the sources. Documents are then selected in a seeded order, cut where the flow says.
"""

from __future__ import annotations

import heapq
from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.session import broadcast_if_small, written

#: Patterns, mixes and sources are solved on the driver; more of them raise an error.
MAX_PATTERNS = 50_000
#: Documents of one part of the seeded order, which one task sorts.
PART = 2000


def min_cost_flow(n: int, arcs: list[tuple[int, int, float, float]], source: int, sink: int, eps: float = 1e-6) -> list[float]:
    """Flow on each arc ``(from, to, capacity, cost)`` of the greatest flow that costs least.

    Primal-dual: distances by cost from the source with potentials, then a greatest flow along the arcs
    that lie on shortest ways, all at once; as many rounds as there are different distances. Costs must
    not be negative.
    """
    graph: list[list[int]] = [[] for _ in range(n)]
    to, cap, cost = [], [], []
    for a, b, c, w in arcs:
        graph[a].append(len(to))
        to += [b, a]
        cap += [c, 0.0]
        cost += [w, -w]
        graph[b].append(len(to) - 1)
    high = [0.0] * n
    while True:
        dist = [float("inf")] * n
        dist[source] = 0.0
        heap = [(0.0, source)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > dist[x] + 1e-9:
                continue
            for e in graph[x]:
                if cap[e] > eps:
                    y = to[e]
                    nd = d + max(0.0, cost[e] + high[x] - high[y])
                    if nd < dist[y] - 1e-9:
                        dist[y] = nd
                        heapq.heappush(heap, (nd, y))
        if dist[sink] == float("inf"):
            return [cap[2 * k + 1] for k in range(len(arcs))]
        far = dist[sink]
        for x in range(n):
            high[x] += min(dist[x], far)
        _saturate(graph, to, cap, cost, high, source, sink, eps)


def _saturate(graph: list[list[int]], to: list[int], cap: list[float], cost: list[float], high: list[float], source: int, sink: int, eps: float) -> None:
    """A greatest flow along arcs without reduced cost: levels from the source, then blocking flows."""
    n = len(graph)
    tight = lambda e, x: cap[e] > eps and abs(cost[e] + high[x] - high[to[e]]) < 1e-7
    while True:
        level = [-1] * n
        level[source] = 0
        queue = deque([source])
        while queue:
            x = queue.popleft()
            for e in graph[x]:
                if level[to[e]] < 0 and tight(e, x):
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return
        at = [0] * n
        way: list[int] = []
        x = source
        while True:
            if x == sink:
                push = min(cap[e] for e in way)
                for e in way:
                    cap[e] -= push
                    cap[e ^ 1] += push
                first = next(i for i, e in enumerate(way) if cap[e] <= eps)
                x = to[way[first] ^ 1]
                del way[first:]
                continue
            while at[x] < len(graph[x]):
                e = graph[x][at[x]]
                if level[to[e]] == level[x] + 1 and tight(e, x):
                    break
                at[x] += 1
            if at[x] < len(graph[x]):
                way.append(graph[x][at[x]])
                x = to[way[-1]]
            elif way:
                x = to[way.pop() ^ 1]
                at[x] += 1
            else:
                break


def _merged(patterns: dict[frozenset, float], names: set[str]) -> dict[frozenset, float]:
    """Tokens by the sources of this mix that hold them: other sources make no difference to it."""
    out: dict[frozenset, float] = {}
    for p, c in patterns.items():
        if mine := p & names:
            out[mine] = out.get(mine, 0.0) + c
    return out


def _solve(patterns: dict[frozenset, float], targets: dict[str, tuple[float, int]], total: float) -> tuple[float, dict]:
    """Reached tokens and ``{(pattern, source, layer): tokens}`` for one mix of ``total`` tokens."""
    names = sorted(targets)
    layers = [(p, r) for p in sorted(patterns, key=sorted) for r in range(1, max(targets[s][1] for s in p) + 1)]
    n = 2 + len(layers) + len(names)
    arcs, meaning = [], []
    for k, (p, r) in enumerate(layers):
        arcs.append((0, 2 + k, patterns[p], float(r * r)))
        meaning.append(None)
        for j, s in enumerate(names):
            if s in p and r <= targets[s][1]:
                arcs.append((2 + k, 2 + len(layers) + j, float("inf"), 0.0))
                meaning.append((p, s, r))
    for j, s in enumerate(names):
        arcs.append((2 + len(layers) + j, 1, targets[s][0] * total, 0.0))
        meaning.append(None)
    flow = min_cost_flow(n, arcs, 0, 1)
    routed = {m: f for m, f in zip(meaning, flow, strict=True) if m and f > 0.5}
    return sum(routed.values()), routed


def _greatest(patterns: dict[frozenset, float], targets: dict[str, tuple[float, int]]) -> float:
    """The greatest total at which every source reaches its share.

    What some sources can get together is bounded by the tokens that any of them may use, layer by
    layer. A greatest flow that misses the quotas names the sources that are short; the total falls to
    their bound, until the flow reaches all. Each step is exact, none a bisection.
    """
    def room(some: frozenset) -> float:
        return sum(c * max(targets[s][1] for s in p & some) for p, c in patterns.items() if p & some)

    total = min(room(frozenset([s])) / t[0] for s, t in targets.items())
    for _ in range(len(targets) + 1):
        reached, routed = _solve(patterns, targets, total)
        if reached >= total * (1 - 1e-9) - len(targets):
            return total
        got: dict[str, float] = {}
        used: dict[tuple, float] = {}
        for (p, s, r), f in routed.items():
            got[s] = got.get(s, 0.0) + f
            used[p, r] = used.get((p, r), 0.0) + f
        # sources that a short one can't take from: all that share its full layers, directly or not
        short = {s for s in targets if got.get(s, 0.0) < targets[s][0] * total - 1}
        grown = True
        while grown:
            more = {s for (p, s, r) in routed if any(q in short and r <= targets[q][1] for q in p)} - short
            short |= more
            grown = bool(more)
        bound = room(frozenset(short)) / sum(targets[s][0] for s in short)
        if bound >= total * (1 - 1e-9):
            break
        total = bound
    return total


def plan(patterns: dict[frozenset, float], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict:
    """``{(pattern, source, layer): tokens}`` of one mix, by the sources of the mix that hold a text.

    Sources without documents can give nothing; the shares of the others are raised in proportion.
    Without a ``total`` the greatest is taken at which every other source still reaches its share.
    """
    held = {s for p in patterns for s in p}
    real = {s: t for s, t in targets.items() if s in held and t[0] > 0 and t[1] > 0}
    weight = sum(t[0] for t in real.values())
    if not real or not weight:
        return {}
    real = {s: (t[0] / weight, t[1]) for s, t in real.items()}
    mine = _merged(patterns, set(real))
    return _solve(mine, real, _greatest(mine, real) if total is None else total)[1]


def distinct_texts(sized: DataFrame) -> DataFrame:
    """``(text_key, n_tokens, members)`` of ``sized`` (``row_key, source, text_key, n_tokens``): one row
    per text, members being each source that holds it with its least id there. Copies are combined
    before the shuffle, so that a text with any number of copies is one small row."""
    one = sized.where("source is not null and source <> '' and n_tokens > 0").groupBy("text_key", "source").agg(F.min("row_key").alias("row_key"), F.max("n_tokens").alias("n_tokens"))
    return one.groupBy("text_key").agg(F.max("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("source", "row_key"))).alias("members"))


def mix(sized: DataFrame, targets: DataFrame, seed: int = 11, total: float | None = None) -> DataFrame:
    """``(mix_name, source, row_key, use_no, n_tokens)``: the documents drawn for each mix.

    ``targets``: ``mix_name, source, target_share, max_repeats``; a listed source may lack documents.
    No text is drawn more often, all sources together, than the source it is drawn for allows.
    Documents without source or tokens are never drawn. Ties in the seeded order go by the text.
    """
    spark = sized.sparkSession
    clean = lambda c: F.lower(F.trim(F.col(c)))
    rows = targets.select("mix_name", clean("source").alias("source"), "target_share", "max_repeats").where("mix_name is not null and source is not null").limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError("too many targets")
    mixes: dict[str, dict[str, tuple[float, int]]] = {}
    for r in rows:
        mixes.setdefault(r["mix_name"], {})[r["source"]] = (float(r["target_share"] or 0), int(r["max_repeats"] or 0))
    listed = sorted({s for m in mixes.values() for s in m})
    texts = distinct_texts(sized.withColumn("source", clean("source")).where(F.col("source").isin(listed)))
    names = F.transform("members", lambda m: m["source"])
    texts = written(texts.withColumn("pattern", F.array_join(names, "\u0001")), "mix-texts")
    totals = texts.groupBy("pattern").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("docs")).limit(MAX_PATTERNS + 1).collect()
    if len(totals) > MAX_PATTERNS:
        raise ValueError("too many membership patterns")
    patterns = {frozenset(r["pattern"].split("\u0001")): float(r["n"]) for r in totals}
    key = {frozenset(r["pattern"].split("\u0001")): r["pattern"] for r in totals}
    cuts = []
    for name, t in sorted(mixes.items()):
        at: dict[tuple, float] = {}
        routes = plan(patterns, t, total)
        # patterns that are one to this mix are cut alike, each at the same part of its own tokens
        real = {s for p, _, _ in routes for s in p}
        alike: dict[frozenset, list[frozenset]] = {}
        for p in patterns:
            alike.setdefault(p & real, []).append(p)
        for (p, s, layer), tokens in sorted(routes.items(), key=lambda x: (sorted(x[0][0]), x[0][2], x[0][1])):
            whole = sum(patterns[q] for q in alike[p])
            start = at.get((p, layer), 0.0)
            cuts += [(name, key[q], s, layer, start / whole * patterns[q], (start + tokens) / whole * patterns[q]) for q in alike[p]]
            at[p, layer] = start + tokens
    schema = "mix_name string, pattern string, source string, use_no int, lo double, hi double"
    cut = spark.createDataFrame(cuts, schema)
    parts = max(1, sum(r["docs"] for r in totals) // PART)
    # place of each text in the seeded order of its pattern: totals of the parts before, then within
    u = F.xxhash64("text_key", F.lit(seed))
    ordered = texts.withColumn("u", u).withColumn("part", F.floor((F.shiftrightunsigned(u, 1) / F.lit(2.0**63)) * parts))
    sums = ordered.groupBy("pattern", "part").agg(F.sum("n_tokens").alias("t"))
    before = sums.withColumn("before", F.sum("t").over(Window.partitionBy("pattern").orderBy("part")) - F.col("t")).drop("t")
    within = F.sum("n_tokens").over(Window.partitionBy("pattern", "part").orderBy(F.shiftrightunsigned("u", 1), "text_key").rowsBetween(Window.unboundedPreceding, 0))
    placed = ordered.withColumn("within", within - F.col("n_tokens")).join(broadcast_if_small(before, 200_000), ["pattern", "part"]).withColumn("at", F.col("before") + F.col("within"))
    # a text belongs to the cut that holds its middle, so that rounding favours no cut
    middle = F.col("at") + F.col("n_tokens") / 2
    drawn = placed.join(F.broadcast(cut) if len(cuts) <= 100_000 else cut, "pattern").where((middle >= F.col("lo")) & (middle < F.col("hi")))
    mine = F.filter("members", lambda m: m["source"] == F.col("source"))[0]["row_key"]
    return drawn.select("mix_name", "source", mine.alias("row_key"), "use_no", "n_tokens")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and listed source: target and actual share of the tokens, tokens, draws, most uses."""
    got = mixed.groupBy("mix_name", "source", "row_key").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("uses"))
    got = got.groupBy("mix_name", "source").agg(F.sum("t").alias("n_tokens"), F.sum("uses").alias("n_draws"), F.max("uses").alias("most_uses"))
    want = targets.select("mix_name", F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats")
    both = want.join(got, ["mix_name", "source"], "left").fillna({"n_tokens": 0, "n_draws": 0, "most_uses": 0})
    whole = F.sum("n_tokens").over(Window.partitionBy("mix_name"))
    return both.withColumn("actual_share", F.coalesce(F.round(F.try_divide(F.col("n_tokens"), whole), 6), F.lit(0.0)))


def kept(report: DataFrame) -> DataFrame:
    """What must hold of ``shares``: each source with documents near its share of what such sources were
    to give (``near``: within 0.01), none used more often than allowed (``capped``)."""
    has = F.col("n_tokens") > 0
    weight = F.sum(F.when(has, F.col("target_share"))).over(Window.partitionBy("mix_name"))
    wanted = F.when(has, F.col("target_share") / weight).otherwise(F.lit(0.0))
    return report.select("mix_name", "source", has.alias("has_documents"), F.round(wanted, 6).alias("wanted_share"), (F.abs(F.col("actual_share") - wanted) < 0.01).alias("near"), (F.col("most_uses") <= F.col("max_repeats")).alias("capped"))
