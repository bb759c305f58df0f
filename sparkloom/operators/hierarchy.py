"""Parent-child links to full hierarchies, with detection of closed chains.

Links are rows ``(grp, child, parent, weight, prio)``; a row with a null parent only says that the
node exists. The links of a group are read as a directed graph. Each node has one primary parent,
that of the least ``(prio, parent)``; the primary links form the forest whose paths are returned.
Descendants are counted and listed over all links, not over primary links alone.

Groups of up to ``bound`` links are solved inside one partition, many groups to a partition and one
group in memory at a time. Larger groups are spread over salted partitions: partition-local weighted
disjoint sets first, then merges of whole forests by joins that at least double the joined distance
each round, so that no group is ever collected into one task.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from sparkloom.session import cut

#: Links of one group that a single task may hold.
GROUP_BOUND = 200_000
#: Links of one group whose pairs a single task may list; they can be as many as its square.
PAIRS_BOUND = 20_000
#: Nodes whose ancestors are counted at a time: bits held for each node of a group.
BLOCK = 2048
#: First character of nodes that connect others but are no part of paths and results.
HIDDEN = "\u0001"
NODES = "grp string, node string, parent string, root string, depth bigint, path array<string>, state string, n_descendants bigint"
PAIRS = "grp string, ancestor string, descendant string, distance bigint"


class OffsetForest:
    """Weighted disjoint sets over parent links: each node knows its root and its distance to it."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}
        self.off: dict[str, int] = {}

    def find(self, node: str) -> tuple[str, int]:
        """Root of ``node`` and distance to it; compresses the path walked."""
        trail = []
        while (above := self.up.get(node)) is not None:
            trail.append(node)
            node = above
        total = 0
        for x in reversed(trail):
            total += self.off[x]
            self.up[x], self.off[x] = node, total
        return node, total

    def link(self, child: str, parent: str, weight: int) -> bool:
        """Put ``child``, which must be a root, under ``parent``; False if that closes a chain."""
        root, _ = self.find(parent)
        if root == child:
            return False
        self.up[child], self.off[child] = parent, weight
        return True


def components(links: list[tuple[str, str]]) -> Iterator[list[str]]:
    """Strongly connected components, iteratively; each comes after all that lie above it."""
    out: dict[str, list[str]] = {}
    for child, parent in links:
        out.setdefault(child, []).append(parent)
    order: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    on: set[str] = set()
    for start in out:
        if start in order:
            continue
        work = [(start, iter(out[start]))]
        order[start] = low[start] = len(order)
        stack.append(start)
        on.add(start)
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in order:
                    order[nxt] = low[nxt] = len(order)
                    stack.append(nxt)
                    on.add(nxt)
                    work.append((nxt, iter(out.get(nxt, ()))))
                    break
                if nxt in on:
                    low[node] = min(low[node], order[nxt])
            else:
                work.pop()
                if work:
                    above = work[-1][0]
                    low[above] = min(low[above], low[node])
                if low[node] == order[node]:
                    members = []
                    while True:
                        x = stack.pop()
                        on.discard(x)
                        members.append(x)
                        if x == node:
                            break
                    yield members


def closed_nodes(links: list[tuple[str, str]]) -> set[str]:
    """Nodes on a directed cycle, self-links included."""
    closed = {child for child, parent in links if child == parent}
    for members in components(suspects(links)):
        if len(members) > 1:
            closed.update(members)
    return closed


def suspects(links: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The links of those connected parts that may hold a closed chain.

    Weighted disjoint sets over (child, parent): every node knows its root and its offset to it, a
    child lying one below its parent. A link whose ends already share a root must agree with their
    offsets. Around a closed chain the offsets would have to sum up to nothing while each link adds
    one, so a part without contradiction holds none.
    """
    up: dict[str, str] = {}
    off: dict[str, int] = {}
    rank: dict[str, int] = {}

    def find(n: str) -> tuple[str, int]:
        if n not in up:
            up[n], off[n], rank[n] = n, 0, 1
            return n, 0
        trail = []
        while up[n] != n:
            trail.append(n)
            n = up[n]
        total = 0
        for x in reversed(trail):
            total += off[x]
            up[x], off[x] = n, total
        return n, total

    odd: set[str] = set()
    for child, parent in links:
        a, i = find(child)
        b, j = find(parent)
        if a == b:
            if i - j != 1:
                odd.add(a)
            continue
        if rank[a] > rank[b]:
            up[b], off[b] = a, i - j - 1
            rank[a] += rank[b]
        else:
            up[a], off[a] = b, j + 1 - i
            rank[b] += rank[a]
    if not odd:
        return []
    odd = {find(n)[0] for n in odd}
    return [link for link in links if find(link[0])[0] in odd]


def count_below(links: list[tuple[str, str]]) -> dict[str, int]:
    """Number of other nodes that each node reaches downwards over all links.

    The components are walked from below with one bit for each node reached, ``BLOCK`` nodes at a
    time, so that memory follows the number of nodes and not that of pairs.
    """
    parts = list(components(links))
    parts.reverse()
    part_of = {n: i for i, members in enumerate(parts) for n in members}
    under: list[set[int]] = [set() for _ in parts]
    for child, parent in links:
        if part_of[child] != part_of[parent]:
            under[part_of[parent]].add(part_of[child])
    shown = [n for members in parts for n in members if not n.startswith(HIDDEN)]
    total = [0] * len(parts)
    for start in range(0, len(shown), BLOCK):
        bits = [0] * len(parts)
        for k, n in enumerate(shown[start : start + BLOCK]):
            bits[part_of[n]] |= 1 << k
        for i, lower in enumerate(under):
            for j in lower:
                bits[i] |= bits[j]
            total[i] += bits[i].bit_count()
    return {n: total[part_of[n]] - 1 for n in shown}


def reach_group(grp: str, links: list[tuple]) -> Iterator[tuple]:
    """``(grp, ancestor, descendant, distance)`` over all links of one group that fits in memory."""
    under: dict[str, list[str]] = {}
    for child, parent, *_ in links:
        if parent is not None:
            under.setdefault(parent, []).append(child)
    for start in under:
        if start.startswith(HIDDEN):
            continue
        seen, edge, distance = {start}, [start], 0
        while edge:
            distance += 1
            reached = []
            while edge:
                for n in under.get(edge.pop(), ()):
                    if n not in seen:
                        seen.add(n)
                        (edge if n.startswith(HIDDEN) else reached).append(n)
            for n in reached:
                yield grp, start, n, distance
            edge = reached


def solve_group(grp: str, links: list[tuple], counts: bool = True) -> Iterator[tuple]:
    """Result rows of one group that fits in memory; ``links`` are (child, parent, weight, prio)."""
    primary: dict[str, tuple] = {}
    nodes: dict[str, None] = {}
    pairs = []
    for child, parent, weight, prio in links:
        nodes[child] = None
        if parent is not None:
            nodes[parent] = None
            pairs.append((child, parent))
            best = primary.get(child)
            if best is None or (prio, parent) < best[:2]:
                primary[child] = (prio, parent, weight)
    closed = closed_nodes(pairs)
    forest = OffsetForest()
    broken = {c for c, (_, p, w) in primary.items() if not forest.link(c, p, w)}
    below = count_below(pairs) if counts else {}
    for n in nodes:
        if n.startswith(HIDDEN):
            continue
        root, depth = forest.find(n)
        circles = root in broken
        up = primary[n][1] if n in primary else None
        while up is not None and up.startswith(HIDDEN) and up in primary:
            up = primary[up][1]
        if up is not None and up.startswith(HIDDEN):
            up = None
        if n in closed or circles:
            yield grp, n, up, None, None, None, "closed" if n in closed else "below_closed", below.get(n, 0) if counts else None
            continue
        path = []
        x: str | None = n
        while x is not None:
            if not x.startswith(HIDDEN):
                path.append(x)
            x = primary[x][1] if x in primary else None
        path.reverse()
        yield grp, n, up, path[0], len(path) - 1, path, "tree", below.get(n, 0) if counts else None


def _solve_partition(batches: Iterator[pa.RecordBatch], solve: Callable, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Groups of a sorted partition, one after the other, through ``solve``."""
    held: list[tuple] = []
    key = None
    out: list[tuple] = []

    def frame() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        for grp, *link in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if grp != key:
                for row in solve(key, held) if held else ():
                    out.append(row)
                    if len(out) >= 5000:
                        yield frame()
                        out = []
                held, key = [], grp
            held.append(link)
    for row in solve(key, held) if held else ():
        out.append(row)
        if len(out) >= 5000:
            yield frame()
            out = []
    if out:
        yield frame()


def closed_all(grp: str, links: list[tuple]) -> Iterator[tuple]:
    """``(grp, node)`` of all closed nodes of one group, hidden ones too."""
    return ((grp, n) for n in closed_nodes([(c, p) for c, p in links]))


def closed_group(grp: str, links: list[tuple]) -> Iterator[tuple]:
    """``(grp, node)`` of the closed nodes of one group; ``links`` are (child, parent)."""
    for n in closed_nodes([(c, p) for c, p in links if p is not None]):
        if not n.startswith(HIDDEN):
            yield grp, n


def _local_forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partition-local weighted disjoint sets of primary links: each node's local top and offset."""
    held: dict[str, list[tuple]] = {}
    for batch in batches:
        for grp, child, parent, weight in zip(*[batch[c] for c in ("grp", "child", "parent", "weight")], strict=True):
            held.setdefault(grp, []).append((child, parent, weight))
    for grp, links in held.items():
        forest = OffsetForest()
        loose = {}
        for c, p, w in links:
            if not forest.link(c, p, w):
                loose[c] = (p, w)
        rows = []
        for c, _, _ in links:
            if c in loose:
                rows.append((grp, c, *loose[c]))
            else:
                rows.append((grp, c, *forest.find(c)))
        yield pd.DataFrame(rows, columns=["grp", "node", "top", "off"])


def _merge_forests(links: DataFrame, salt_rows: int) -> DataFrame:
    """``(grp, node, top, off)`` of spread groups: tops that no merge can lift are roots or circle.

    Each round lifts a node to the top of its top. After as many rounds as the number of links has
    binary digits every node that leads to a root has reached it.
    """
    n = links.count()
    parts = max(2, n // salt_rows + 1)
    state = cut(links.repartition(parts, "grp", F.xxhash64("child")).mapInPandas(_local_forests, "grp string, node string, top string, off bigint"))
    for _ in range(max(1, n.bit_length()) + 1):
        over = state.select(F.col("grp").alias("g2"), F.col("node").alias("n2"), F.col("top").alias("top2"), F.col("off").alias("off2"))
        lifted = state.join(over, (F.col("grp") == F.col("g2")) & (F.col("top") == F.col("n2")), "left").select(
            "grp", "node", F.coalesce("top2", "top").alias("top"), (F.col("off") + F.coalesce("off2", F.lit(0))).alias("off"), F.col("n2").isNotNull().alias("moved")
        )
        lifted = cut(lifted)
        moved = lifted.where("moved").limit(1).count()
        state = lifted.drop("moved")
        if not moved:
            break
    return state


def _circle_nodes(links: DataFrame) -> DataFrame:
    """Nodes on closed chains where each child has one parent: after 2^k >= n equal steps from
    every node, exactly the nodes on circles are still stood on."""
    n = links.count()
    state = links.select("grp", F.col("child").alias("node"), F.col("parent").alias("top"))
    for _ in range(max(1, n.bit_length())):
        over = state.select(F.col("grp").alias("g2"), F.col("node").alias("n2"), F.col("top").alias("top2"))
        state = cut(state.join(over, (F.col("grp") == F.col("g2")) & (F.col("top") == F.col("n2"))).select("grp", "node", F.col("top2").alias("top")))
    return state.select("grp", F.col("top").alias("node")).distinct()


def _trimmed(links: DataFrame) -> DataFrame:
    """Links whose child has a child and whose parent has a parent, again and again until it stays."""
    core = cut(links.select("grp", "child", "parent").distinct())
    before = core.count()
    while before:
        has_parent = core.select("grp", F.col("child").alias("parent")).distinct()
        has_child = core.select("grp", F.col("parent").alias("child")).distinct()
        core = cut(core.join(has_parent, ["grp", "parent"], "left_semi").join(has_child, ["grp", "child"], "left_semi").select("grp", "child", "parent"))
        now = core.count()
        if now == before:
            break
        before = now
    return core


def _closed_spread(links: DataFrame, bound: int) -> DataFrame:
    """Nodes on closed chains of groups too large for one task, any number of parents per child.

    Trimming leaves only what lies on or between circles. A remainder that fits a task is solved
    there; the others by colouring: the greatest node name that reaches a node is its colour, and
    the nodes of a colour that reach its namesake back form one component, which is taken out.
    """
    found = links.where(F.col("child") == F.col("parent")).select("grp", F.col("child").alias("node")).distinct()
    core = _trimmed(links)
    while core.limit(1).count():
        sizes = core.groupBy("grp").count()
        small = core.join(sizes.where(F.col("count") <= bound).select("grp"), "grp", "left_semi")
        found = found.unionByName(_solve_small(small, closed_all, "grp string, node string", ("child", "parent")))
        core = cut(core.join(sizes.where(F.col("count") > bound).select("grp"), "grp", "left_semi"))
        if not core.limit(1).count():
            break
        colour = core.select("grp", F.explode(F.array("child", "parent")).alias("node")).distinct().withColumn("colour", F.col("node"))
        while True:
            reach = core.join(colour.withColumnRenamed("node", "child"), ["grp", "child"]).select("grp", F.col("parent").alias("node"), "colour")
            nxt = cut(colour.unionByName(reach).groupBy("grp", "node").agg(F.max("colour").alias("colour")))
            changed = nxt.join(colour, ["grp", "node", "colour"], "left_anti").limit(1).count()
            colour = nxt
            if not changed:
                break
        inside = (
            core.join(colour.select("grp", F.col("node").alias("child"), F.col("colour").alias("c1")), ["grp", "child"])
            .join(colour.select("grp", F.col("node").alias("parent"), F.col("colour").alias("c2")), ["grp", "parent"])
            .where("c1 = c2")
            .select("grp", "child", "parent", F.col("c1").alias("colour"))
        )
        inside = cut(inside)
        member = inside.where(F.col("parent") == F.col("colour")).select("grp", F.col("parent").alias("node"), "colour").distinct()
        seen = 0
        while True:
            back = inside.join(member.select("grp", "colour", F.col("node").alias("parent")), ["grp", "colour", "parent"]).select("grp", F.col("child").alias("node"), "colour")
            member = cut(member.unionByName(back).distinct())
            now = member.count()
            if now == seen:
                break
            seen = now
        found = found.unionByName(member.select("grp", "node"))
        gone = member.select("grp", "node")
        core = _trimmed(
            core.join(gone.withColumnRenamed("node", "child"), ["grp", "child"], "left_anti").join(gone.withColumnRenamed("node", "parent"), ["grp", "parent"], "left_anti")
        )
    return found.distinct()


def _solve_small(links: DataFrame, solve: Callable = solve_group, schema: str = NODES, columns: tuple[str, ...] = ("child", "parent", "weight", "prio")) -> DataFrame:
    sorted_links = links.select("grp", *columns).repartition("grp").sortWithinPartitions("grp")
    return sorted_links.mapInArrow(functools.partial(_solve_partition, solve=solve, schema=to_arrow_schema(_parse_datatype_string(schema))), schema)


def _reach_spread(links: DataFrame) -> DataFrame:
    """Pairs of groups too large for one task, any number of parents per child.

    After round k all pairs up to 2^k hops apart are there; those up to twice as far are a walk of
    just 2^k hops and a pair known. Without a new pair in a round there are none farther apart.
    """
    real = cut(links.where(F.col("parent").isNotNull()).select("grp", F.col("parent").alias("ancestor"), F.col("child").alias("descendant")).distinct())
    hidden = F.col("descendant").startswith(HIDDEN)
    on = real.select("grp", F.col("ancestor").alias("mid"), "descendant")
    hops = cut(real.where(~F.col("ancestor").startswith(HIDDEN)))
    fresh = hops.where(hidden)
    while fresh.limit(1).count():
        fresh = fresh.select("grp", "ancestor", F.col("descendant").alias("mid")).join(on, ["grp", "mid"]).select("grp", "ancestor", "descendant").distinct()
        fresh = cut(fresh.join(hops, ["grp", "ancestor", "descendant"], "left_anti"))
        hops = cut(hops.unionByName(fresh))
        fresh = fresh.where(hidden)
    walks = hops.where(~hidden)
    reach = cut(walks.withColumn("distance", F.lit(1).cast("bigint")))
    length, before = 1, reach.count()
    while before:
        first = walks.select("grp", "ancestor", F.col("descendant").alias("mid"))
        far = first.join(reach.withColumnRenamed("ancestor", "mid"), ["grp", "mid"]).select("grp", "ancestor", "descendant", (F.col("distance") + length).alias("distance"))
        reach = cut(reach.unionByName(far).groupBy("grp", "ancestor", "descendant").agg(F.min("distance").alias("distance")))
        now = reach.count()
        if now == before:
            break
        walks = cut(first.join(walks.withColumnRenamed("ancestor", "mid"), ["grp", "mid"]).select("grp", "ancestor", "descendant").distinct())
        length, before = 2 * length, now
    return reach.where(F.col("ancestor") != F.col("descendant"))


def _solve_spread(links: DataFrame, single_parent: bool, bound: int, counts: bool) -> DataFrame:
    links = cut(links)
    real = links.where(F.col("parent").isNotNull())
    best = Window.partitionBy("grp", "child").orderBy("prio", "parent")
    primary = cut(real.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r"))
    nodes = links.select("grp", F.col("child").alias("node")).unionByName(real.select("grp", F.col("parent").alias("node"))).distinct()
    tops = _merge_forests(primary, bound)
    still = tops.join(primary.select("grp", F.col("child").alias("top")), ["grp", "top"], "left_semi").select("grp", "node")
    closed = _circle_nodes(primary.join(still.withColumnRenamed("node", "child"), ["grp", "child"], "left_semi")) if single_parent else _closed_spread(real, bound)
    # paths by doubling: a node's known upper piece is put before that of the node it ends at
    state = primary.join(still.withColumnRenamed("node", "child"), ["grp", "child"], "left_anti").select(
        "grp", F.col("child").alias("node"), F.col("parent").alias("top"), F.array("child").alias("piece")
    )
    rounds = primary.count().bit_length() + 1
    for _ in range(rounds):
        over = state.select(F.col("grp").alias("g2"), F.col("node").alias("n2"), F.col("top").alias("top2"), F.col("piece").alias("piece2"))
        state = cut(
            state.join(over, (F.col("grp") == F.col("g2")) & (F.col("top") == F.col("n2")), "left").select(
                "grp", "node", F.coalesce("top2", "top").alias("top"), F.when(F.col("piece2").isNull(), F.col("piece")).otherwise(F.concat("piece2", "piece")).alias("piece"), F.col("n2").isNotNull().alias("moved")
            )
        )
        moved = state.where("moved").limit(1).count()
        state = state.drop("moved")
        if not moved:
            break
    shown = ~F.col("node").startswith(HIDDEN)
    full = (
        nodes.join(state, ["grp", "node"], "left")
        .join(closed.withColumn("_closed", F.lit(True)), ["grp", "node"], "left")
        .join(still.distinct().withColumn("_still", F.lit(True)), ["grp", "node"], "left")
        .withColumn("path", F.filter(F.when(F.col("top").isNull(), F.array("node")).otherwise(F.concat(F.array("top"), "piece")), lambda x: ~x.startswith(HIDDEN)))
        .withColumn("state", F.when(F.col("_closed"), "closed").when(F.col("_still"), "below_closed").otherwise("tree"))
    )
    full = cut(full.where(shown).select("grp", "node", F.when(F.col("state") == "tree", F.col("path")).alias("path"), "state"))
    # the parent shown is the first above that isn't hidden
    up = primary.select("grp", F.col("child").alias("node"), "parent")
    over = primary.where(F.col("child").startswith(HIDDEN)).select("grp", F.col("child").alias("parent"), F.col("parent").alias("above"))
    while up.join(over, ["grp", "parent"], "left_semi").limit(1).count():
        up = cut(up.join(over, ["grp", "parent"], "left").select("grp", "node", F.coalesce("above", "parent").alias("parent")))
    full = full.join(up.where(~F.col("parent").startswith(HIDDEN)), ["grp", "node"], "left")
    if counts:
        below = _reach_spread(links).groupBy("grp", F.col("ancestor").alias("node")).agg(F.count(F.lit(1)).alias("n_descendants"))
        full = full.join(below, ["grp", "node"], "left").withColumn("n_descendants", F.coalesce("n_descendants", F.lit(0)))
    else:
        full = full.withColumn("n_descendants", F.lit(None).cast("bigint"))
    return full.select(
        "grp", "node", "parent", F.try_element_at("path", F.lit(1)).alias("root"), (F.size("path") - 1).cast("bigint").alias("depth"), "path", "state", "n_descendants"
    )


def _whole(links: DataFrame) -> DataFrame:
    whole = links.select("grp", "child", "parent", F.col("weight").cast("int").alias("weight"), F.col("prio").cast("string").alias("prio"))
    return whole.where(F.col("grp").isNotNull() & F.col("child").isNotNull()).fillna({"prio": "", "weight": 1})


def _large(links: DataFrame, bound: int) -> DataFrame:
    """Groups with more than ``bound`` rows, repeated ones included: what a task would have to hold."""
    return cut(links.where(F.col("grp").isNotNull()).groupBy("grp").count().where(F.col("count") > bound).select("grp"))


def closed_chains(links: DataFrame, bound: int = GROUP_BOUND) -> DataFrame:
    """``(grp, node)``: nodes on a closed chain of links, a self-link included, whatever the number of
    parents. ``links`` as in ``hierarchy``. Weighted disjoint sets tell the connected parts that can't
    hold one; only the others are searched."""
    large = _large(links, bound)
    whole = _whole(links).select("grp", "child", "parent").where(F.col("parent").isNotNull())
    solve = functools.partial(_solve_small, solve=closed_group, schema="grp string, node string", columns=("child", "parent"))
    if not large.limit(1).count():
        return solve(whole)
    spread = _closed_spread(cut(whole.join(large, "grp", "left_semi").distinct()), bound)
    return solve(whole.join(large, "grp", "left_anti")).unionByName(spread.where(~F.col("node").startswith(HIDDEN)))


def hierarchy(links: DataFrame, single_parent: bool = False, bound: int = GROUP_BOUND, counts: bool = True) -> DataFrame:
    """Full path, depth, root and number of descendants of each node, and closed chains.

    ``links``: ``grp, child, parent, weight, prio`` (strings but ``weight``). Rows without group or
    child refer to nothing and are left out; repeated rows count once. ``state`` is ``tree`` for
    nodes that lead up to a root, ``closed`` for nodes on a closed chain (a self-link included) and
    ``below_closed`` for nodes whose primary parents lead into one; the last two have no root, depth
    and path. ``n_descendants`` is the number of other nodes reached downwards over all links,
    whatever the state; it is null without ``counts``. ``parent`` is the primary one, whatever the
    state. An empty table gives no rows.
    """
    whole = _whole(links)
    large = _large(links, bound)
    solve = functools.partial(solve_group, counts=counts)
    if not large.limit(1).count():
        return _solve_small(whole, solve)
    small = _solve_small(whole.join(large, "grp", "left_anti"), solve)
    return small.unionByName(_solve_spread(whole.join(large, "grp", "left_semi").distinct(), single_parent, bound, counts))


def reachable(links: DataFrame, bound: int = PAIRS_BOUND) -> DataFrame:
    """``(grp, ancestor, descendant, distance)``: every other node that a node reaches downwards over
    all links, any number of parents per child, on and below closed chains too. ``distance`` is the
    least number of hops between shown nodes. ``links`` as in ``hierarchy``."""
    whole = _whole(links)
    large = _large(links, bound)
    if not large.limit(1).count():
        return _solve_small(whole, reach_group, PAIRS)
    small = _solve_small(whole.join(large, "grp", "left_anti"), reach_group, PAIRS)
    return small.unionByName(_reach_spread(whole.join(large, "grp", "left_semi")).select("grp", "ancestor", "descendant", "distance"))


def descendants(nodes: DataFrame) -> DataFrame:
    """``(grp, ancestor, descendant, distance)``: every node under every node, from the
    paths, so along primary links and outside closed chains only; ``reachable`` gives all."""
    up = nodes.where("state = 'tree'").select("grp", F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("_level", "ancestor"))
    return up.where(F.col("_level") < F.col("depth")).select("grp", "ancestor", "descendant", (F.col("depth") - F.col("_level")).alias("distance"))
