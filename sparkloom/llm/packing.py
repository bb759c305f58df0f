"""Filling containers of fixed capacity with texts of varying length: a grouping genetic algorithm.

A solution is a set of containers; its genes are whole containers. Crossover injects well-filled
containers of one parent into the other, removes those of the other that hold an injected text again,
and best-fits the texts this displaced. Texts are dealt at random into shards of bounded size, each
solved by several islands with populations of their own; between epochs the elite of each island
moves on to the next. Only a shard whose best-fit no solution can surpass in fitness is not evolved:
the least number of containers possible is not enough for that, as its space may still be gathered
in fewer of them. What remains in poorly filled containers of all shards is dealt and
solved once more, as often as it still shrinks.
"""

from __future__ import annotations

import random
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.session import written

#: Texts of one shard on average; the work of a task grows with the square of it at worst.
SHARD = 1000
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
GENERATIONS = 6
#: Containers filled less than this are opened again in the next level.
WELL_FILLED = 0.97
#: Another level must bring the open texts down to this share.
SHRINK = 0.9
#: Kinds of containers that are written into one projection; more take another one each.
KINDS = 200

Bins = list[list[int]]


def best_fit(order: list[int], sizes: list[int], capacity: int, bins: Bins | None = None) -> Bins:
    """Put the items of ``order``, one after the other, where they leave the least space."""
    bins = [list(b) for b in bins] if bins else []
    room = sorted((capacity - sum(sizes[i] for i in b), k) for k, b in enumerate(bins))
    for i in order:
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            left, k = room.pop(at)
        else:
            left, k = capacity, len(bins)
            bins.append([])
        bins[k].append(i)
        insort(room, (left - sizes[i], k))
    return bins


def fitness(bins: Bins, sizes: list[int], capacity: int) -> float:
    """Mean of squared fillings: few containers, and full ones beside empty ones."""
    return sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def highest(sizes: list[int], capacity: int) -> float:
    """Fitness that no solution surpasses: the least number of containers, all but one of them full."""
    n, rest = divmod(sum(sizes), capacity)
    return (n + (rest / capacity) ** 2) / max(1, n + (rest > 0))


def crossover(a: Bins, b: Bins, sizes: list[int], capacity: int, rng: random.Random) -> Bins:
    """``a`` with well-filled containers of ``b`` injected."""
    fill = [sum(sizes[i] for i in x) for x in b]
    good = [k for k, f in enumerate(fill) if f >= WELL_FILLED * capacity] or sorted(range(len(b)), key=lambda k: -fill[k])[: max(1, len(b) // 4)]
    chosen = rng.sample(good, max(1, len(good) // 2))
    inside = {i for k in chosen for i in b[k]}
    kept = [x for x in a if not inside.intersection(x)]
    held = {i for x in kept for i in x} | inside
    displaced = [i for x in a for i in x if i not in held]
    displaced.sort(key=lambda i: -sizes[i])
    return best_fit(displaced, sizes, capacity, [list(b[k]) for k in chosen] + kept)


def mutate(bins: Bins, sizes: list[int], capacity: int, rng: random.Random) -> Bins:
    """Dissolve the worst-filled containers and some others, and best-fit their texts again."""
    ranked = sorted(range(len(bins)), key=lambda k: sum(sizes[i] for i in bins[k]))
    n = max(2, len(bins) // 20)
    out = set(ranked[:n]) | set(rng.sample(range(len(bins)), min(len(bins), n)))
    loose = [i for k in out for i in bins[k]]
    loose.sort(key=lambda i: -sizes[i])
    return best_fit(loose, sizes, capacity, [x for k, x in enumerate(bins) if k not in out])


def evolve(sizes: list[int], capacity: int, seed: int, elites: list[Bins]) -> Bins:
    """One epoch of one island: its best solution. ``elites`` are its own and its neighbour's, at first
    the best-fit of the texts in falling order."""
    rng = random.Random(seed)
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    people = list(elites)
    while len(people) < POPULATION:
        noisy = sorted(order, key=lambda i: -sizes[i] * rng.uniform(0.6, 1.4))
        people.append(best_fit(noisy, sizes, capacity))
    scored = sorted(((fitness(p, sizes, capacity), k, p) for k, p in enumerate(people)), key=lambda x: -x[0])
    tight = -(-sum(sizes) // capacity)
    for g in range(GENERATIONS):
        if len(scored[0][2]) <= tight and scored[0][0] > 0.9999:
            break
        (_, _, a), (_, _, b) = scored[0], scored[rng.randrange(1, len(scored))]
        for child in (crossover(a, b, sizes, capacity, rng), mutate(crossover(b, a, sizes, capacity, rng), sizes, capacity, rng)):
            scored.append((fitness(child, sizes, capacity), POPULATION + g, child))
        scored = sorted(scored, key=lambda x: -x[0])[:POPULATION]
    return scored[0][2]


def _codes(bins: Bins, n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def _bins(codes) -> Bins:
    out: dict[int, list[int]] = {}
    for i, k in enumerate(codes):
        out.setdefault(int(k), []).append(i)
    return list(out.values())


ISLAND = "pack_name string, capacity int, shard bigint, island int, sizes array<int>, codes array<int>, fit double, solved boolean"
NAMES = ["pack_name", "capacity", "shard", "island", "sizes", "codes", "fit", "solved"]


def _row(pack: str, cap: int, shard: int, island: int, sizes: list[int], bins: Bins) -> tuple:
    return pack, cap, shard, island, sizes, _codes(bins, len(sizes)), (fit := fitness(bins, sizes, cap)), fit >= highest(sizes, cap) - 1e-12


def _first_fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Best-fit of each shard, its sizes being in falling order, and whether no solution can be fitter."""
    for batch in batches:
        rows = []
        for pack, cap, shard, sizes in zip(*[batch[c] for c in ("pack_name", "capacity", "shard", "sizes")], strict=True):
            s = sizes.tolist()
            rows.append(_row(pack, int(cap), int(shard), 0, s, best_fit(list(range(len(s))), s, int(cap))))
        yield pd.DataFrame(rows, columns=NAMES)


def _epoch(number: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for pack, cap, shard, island, sizes, elites in zip(*[batch[c] for c in ("pack_name", "capacity", "shard", "island", "sizes", "elites")], strict=True):
                s = sizes.tolist()
                best = evolve(s, int(cap), int(shard) * 7919 + int(island) * 104729 + number, [_bins(e) for e in elites])
                rows.append(_row(pack, int(cap), int(shard), int(island), s, best))
            yield pd.DataFrame(rows, columns=NAMES)

    return run


def _level(items: DataFrame, counts: dict[str, int], seed: int) -> DataFrame:
    """Deal the items into shards and solve them: ``items`` with ``shard`` and ``slot``."""
    parts = {k: max(1, round(n / SHARD)) for k, n in counts.items()}
    n_shards = F.coalesce(F.element_at(F.create_map(*[x for k, n in parts.items() for x in (F.lit(k), F.lit(n))]), F.col("pack_name")), F.lit(1))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("row_key", "piece", F.lit(seed)), n_shards))
    keys = ["pack_name", "capacity", "shard"]
    boxed = dealt.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("neg"), "row_key", "piece"))).alias("items"))
    boxed = written(boxed, "pack-shards")
    base = boxed.select(*keys, F.transform("items", lambda x: (-x["neg"]).cast("int")).alias("sizes"))
    # few and slow rows: more tasks than their bytes would ask for
    spread = lambda df, n: df.repartition(max(8, min(4000, n // 8)), *keys, *(["island"] if "island" in df.columns else []))
    first = written(spread(base, sum(parts.values())).mapInPandas(_first_fit, ISLAND), "pack-first")
    solved = first.where("solved")
    hard = first.where("not solved").count()
    if hard:
        state = first.where("not solved").withColumn("elites", F.array("codes")).withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)]))).select(*keys, "sizes", "island", "elites")
        for e in range(EPOCHS):
            done = written(spread(state, hard * ISLANDS).mapInPandas(_epoch(e), ISLAND), "pack-epoch")
            if e + 1 < EPOCHS:
                own = done.select(*keys, "sizes", "island", F.col("codes").alias("own"))
                near = done.select(*keys, ((F.col("island") + 1) % ISLANDS).cast("int").alias("island"), F.col("codes").alias("near"))
                state = own.join(near, [*keys, "island"]).select(*keys, "sizes", "island", F.array("own", "near").alias("elites"))
        best = done.groupBy(*keys).agg(F.max_by("codes", F.struct("fit", "island")).alias("codes"))
        solved = solved.select(*keys, "codes").unionByName(best)
    placed = boxed.join(solved.select(*keys, "codes"), keys).select(*keys, F.explode(F.arrays_zip("items", "codes")).alias("x"))
    return placed.select(*keys, F.col("x.items.row_key").alias("row_key"), F.col("x.items.piece").alias("piece"), (-F.col("x.items.neg")).alias("size"), F.col("x.codes").alias("slot"))


def pack(sizes: DataFrame, packs: DataFrame) -> DataFrame:
    """``(pack_name, container, row_key, piece, size)``: every text of ``sizes`` (``row_key``,
    ``n_tokens``) in a container of each of ``packs`` (``pack_name``, ``capacity_tokens``).

    Only texts longer than the capacity are split, into full pieces, each a container of its own,
    and a rest. Texts without tokens need no space: their container is null. Packs without name or
    with no capacity are left out. Loads never exceed the capacity; every token is placed once.
    """
    rows = packs.select("pack_name", F.col("capacity_tokens").cast("int").alias("capacity")).where("pack_name is not null and capacity_tokens > 0").distinct().orderBy("pack_name", "capacity").collect()
    out: list[DataFrame] = []
    for start in range(0, max(1, len(rows)), KINDS):
        out += _packed(sizes, rows[start : start + KINDS])
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole.select("pack_name", "capacity", "container", "row_key", "piece", "size")


def _packed(sizes: DataFrame, rows: list) -> list[DataFrame]:
    kinds = F.array(*[F.struct(F.lit(r["pack_name"]).alias("pack_name"), F.lit(r["capacity"]).alias("capacity")) for r in rows]).cast("array<struct<pack_name:string,capacity:int>>")
    pairs = sizes.select("row_key", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.inline(kinds))
    full = pairs.where("n_tokens >= capacity").select("pack_name", "capacity", "row_key", F.explode(F.sequence(F.lit(0), (F.col("n_tokens") / F.col("capacity")).cast("int") - 1)).alias("piece"), F.col("capacity").cast("bigint").alias("size"))
    full = full.withColumn("container", F.concat_ws("-", F.lit("f"), F.col("row_key").cast("string"), F.col("piece").cast("string")))
    none = pairs.where("n_tokens = 0").select("pack_name", "capacity", "row_key", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("size"), F.lit(None).cast("string").alias("container"))
    rest = F.pmod("n_tokens", F.col("capacity").cast("bigint"))
    loose = pairs.where(rest > 0).select("pack_name", "capacity", "row_key", (F.col("n_tokens") / F.col("capacity")).cast("int").alias("piece"), rest.alias("size"))
    out = [full, none]
    before, level = None, 0
    while True:
        loose = written(loose, "pack-items")
        counts = {r["pack_name"]: r["n"] for r in loose.groupBy("pack_name").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not counts:
            return out
        placed = written(_level(loose, counts, level).withColumn("container", F.concat_ws("-", F.lit(f"l{level}"), "shard", "slot")), "pack-placed")
        total = sum(counts.values())
        if max(counts.values()) <= SHARD or (before is not None and total > SHRINK * before):
            out.append(placed.select("pack_name", "capacity", "row_key", "piece", "size", "container"))
            return out
        before, level = total, level + 1
        load = placed.groupBy("pack_name", "container").agg(F.sum("size").alias("load"))
        judged = placed.join(load, ["pack_name", "container"])
        out.append(judged.where(F.col("load") >= WELL_FILLED * F.col("capacity")).select("pack_name", "capacity", "row_key", "piece", "size", "container"))
        loose = judged.where(F.col("load") < WELL_FILLED * F.col("capacity")).select("pack_name", "capacity", "row_key", "piece", "size")


def filling(packed: DataFrame) -> DataFrame:
    """Per pack: containers, tokens, mean filling and the least number of containers possible."""
    used = packed.where("container is not null").groupBy("pack_name", "capacity", "container").agg(F.sum("size").alias("load"))
    report = used.groupBy("pack_name", "capacity").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("load").alias("n_tokens"), F.max("load").alias("max_load"))
    return report.withColumn("least_containers", F.ceil(F.col("n_tokens") / F.col("capacity"))).withColumn("filling", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")), 6))


def kept(packed: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per pack, what must hold: ``within`` no load above the capacity, ``whole`` every text's tokens
    placed once, ``unsplit`` no text split that fits, ``filled`` mean filling of 0.97 or more, or the
    least number of containers."""
    per = packed.groupBy("pack_name", "capacity", "row_key").agg(F.sum("size").alias("placed"), F.count(F.lit(1)).alias("n"))
    joined = sizes.select("row_key", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")).join(per, "row_key")
    texts = joined.groupBy("pack_name").agg((F.count_if(F.col("placed") != F.col("n_tokens")) == 0).alias("whole"), (F.count_if((F.col("n_tokens") <= F.col("capacity")) & (F.col("n") > 1)) == 0).alias("unsplit"), F.count(F.lit(1)).alias("n_texts"))
    loads = filling(packed).select("pack_name", (F.col("max_load") <= F.col("capacity")).alias("within"), ((F.col("filling") >= 0.97) | (F.col("n_containers") == F.col("least_containers"))).alias("filled"))
    return texts.join(loads, "pack_name", "left").select("pack_name", "n_texts", F.coalesce("within", F.lit(True)).alias("within"), "whole", "unsplit", F.coalesce("filled", F.lit(True)).alias("filled"))
