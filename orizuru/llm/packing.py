"""Pack documents, measured in tokens, into containers of fixed capacity by a distributed grouping genetic algorithm.

Items are spread by hash over shards of about `SHARD_ITEMS`; each shard is evolved on `ISLANDS` islands with seeds of
their own. Crossover injects whole well-filled bins of one parent into the other, removes the bins that hold
duplicates and best-fits the displaced items. After each epoch the elite of an island migrates to its neighbour. The
best island of a shard keeps its well-filled bins; what lies in the others of all shards is packed again in the same
way, level after level until one shard is left or a level settles less than a tenth of its items, so that the unused
space doesn't grow with the number of shards.

Only an item longer than the capacity is split: into full pieces, which fill containers of their own, and a rest.

Defined results: empty and null texts are items of size 0 and lie in a container of their shard; repeated rows of a
document count once; an empty table gives no rows; ties are settled by document.
"""

from __future__ import annotations

import itertools
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orizuru.session import cut

CAPACITY = 2048
SHARD_ITEMS = 1500
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 40
ISLANDS_A_TASK = 4
POPULATION = 8
WELL_FILLED = 0.985
SHRINKS = 0.9  # packing again goes on while a level settles a tenth of the items

Bins = list[list[int]]


def best_fit(sizes: np.ndarray, order: list[int], bins: Bins, capacity: int) -> Bins:
    """Put the items of `order` into the fullest bins that hold them; new bins where none does."""
    room = sorted((capacity - int(sizes[b].sum()), k) for k, b in enumerate(bins))
    for i in order:
        s = int(sizes[i])
        at = bisect_left(room, (s, -1))
        if at < len(room):
            r, k = room.pop(at)
            bins[k].append(i)
            insort(room, (r - s, k))
        else:
            bins.append([i])
            insort(room, (capacity - s, len(bins) - 1))
    return bins


def fitness(sizes: np.ndarray, bins: Bins, capacity: int) -> float:
    """Few bins, and among as many the unevenly filled: mean squared fill."""
    if not bins:
        return 1.0
    fills = np.array([sizes[b].sum() for b in bins]) / capacity
    return float((fills**2).sum() / len(bins))


def slack_fill(sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> Bins:
    """Bins filled one by one: the largest item, then pairs or single items that leave least room."""
    order = sorted(range(len(sizes)), key=lambda i: (-int(sizes[i]), i))
    free = sorted((int(sizes[i]), i) for i in order)
    bins: Bins = []
    while free:
        s, i = free.pop()
        room, content = capacity - s, [i]
        while free and free[0][0] <= room:
            at = bisect_left(free, (room + 1, -1)) - 1
            single = free[at][0]
            best = (room - single, at, -1)
            lo, hi = 0, at
            while lo < hi and best[0]:  # two items that fill the room best
                both = free[lo][0] + free[hi][0]
                if both <= room:
                    if room - both < best[0]:
                        best = (room - both, hi, lo)
                    lo += 1
                else:
                    hi -= 1
            taken = [k for k in best[1:] if k >= 0]
            for k in sorted(taken, reverse=True):
                t, j = free.pop(k)
                content.append(j)
                room -= t
        bins.append(content)
    return bins


def crossover(sizes: np.ndarray, a: Bins, b: Bins, capacity: int, rng: np.random.Generator) -> Bins:
    """A child of `a` with some well-filled bins of `b`."""
    fills = np.array([sizes[x].sum() for x in b], float)
    chance = np.exp((fills / capacity - 1) * 40) + 1e-9
    many = max(1, int(len(b) * rng.uniform(0.1, 0.5)))
    chosen = rng.choice(len(b), size=min(many, len(b)), replace=False, p=chance / chance.sum())
    inside = np.zeros(len(sizes), bool)
    child: Bins = []
    for k in chosen:
        child.append(list(b[k]))
        inside[b[k]] = True
    displaced: list[int] = []
    for x in a:
        if inside[x].any():
            displaced += [i for i in x if not inside[i]]
        else:
            child.append(list(x))
    return best_fit(sizes, sorted(displaced, key=lambda i: (-int(sizes[i]), i)), child, capacity)


def mutate(sizes: np.ndarray, bins: Bins, capacity: int, rng: np.random.Generator) -> Bins:
    """Empty the worst bins and some others, and fit their items anew in a shaken order."""
    fills = np.array([sizes[x].sum() for x in bins])
    out = set(np.argsort(fills, kind="stable")[: max(1, len(bins) // 20)].tolist()) | set(rng.choice(len(bins), max(1, len(bins) // 20), replace=False).tolist())
    loose = [i for k in out for i in bins[k]]
    noise = rng.uniform(0.85, 1.15, len(loose))
    order = [i for _, i in sorted(zip((-sizes[loose] * noise).tolist(), loose))]
    return best_fit(sizes, order, [list(x) for k, x in enumerate(bins) if k not in out], capacity)


def evolve(sizes: np.ndarray, seeds: list[Bins], capacity: int, seed: int, generations: int = GENERATIONS) -> Bins:
    """The best packing of an island after some generations."""
    rng = np.random.default_rng(seed)
    n = len(sizes)
    if not n:
        return []
    falling = sorted(range(n), key=lambda i: (-int(sizes[i]), i))
    population = [*seeds]
    if not population:
        population = [best_fit(sizes, falling, [], capacity), slack_fill(sizes, capacity, rng)]
    least = -(-int(sizes.sum()) // capacity)
    few = min(population, key=len)
    if len(few) <= least:
        return few  # no packing needs fewer bins
    while len(population) < POPULATION:
        population.append(mutate(sizes, population[int(rng.integers(len(population)))], capacity, rng))
    scored = sorted(((fitness(sizes, p, capacity), k, p) for k, p in enumerate(population)), key=lambda x: (-x[0], x[1]))
    for g in range(generations):
        if len(scored[0][2]) <= least:
            break  # no packing needs fewer bins
        i, j = sorted(rng.choice(min(len(scored), 5), 2, replace=False).tolist())
        children = [crossover(sizes, scored[i][2], scored[j][2], capacity, rng), crossover(sizes, scored[j][2], scored[i][2], capacity, rng)]
        children.append(mutate(sizes, scored[int(rng.integers(len(scored)))][2], capacity, rng))
        scored += [(fitness(sizes, c, capacity), POPULATION + 3 * g + k, c) for k, c in enumerate(children)]
        scored = sorted(scored, key=lambda x: (-x[0], x[1]))[:POPULATION]
    return scored[0][2]


_ROWS = "shard bigint, island int, doc_id bigint, piece int, size int, bin int, visitor int"


def _bins_of(bins: np.ndarray) -> Bins:
    """Places by bin."""
    order = np.argsort(bins, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(bins[order])) + 1)] if len(bins) else []


def _island(capacity: int, epoch: int, generations: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[rows["visitor"] == 0].sort_values(["doc_id", "piece"], kind="stable")
        shard, island = int(own["shard"].iloc[0]), int(own["island"].iloc[0])
        sizes = own["size"].to_numpy(np.int64)
        seeds = []
        if epoch:  # the visitor holds the same items
            visitor = rows[rows["visitor"] == 1].sort_values(["doc_id", "piece"], kind="stable")
            seeds = [_bins_of(x["bin"].to_numpy()) for x in (own, visitor)]
        best = evolve(sizes, [s for s in seeds if s], capacity, seed=(shard * 31 + island) * 7 + epoch, generations=generations)
        bin_of = np.zeros(len(sizes), np.int32)
        for k, b in enumerate(best):
            bin_of[b] = k
        return own.assign(bin=bin_of, visitor=np.int32(0))[["shard", "island", "doc_id", "piece", "size", "bin", "visitor"]]

    return run


def _evolve_shards(items: DataFrame, shards: int, capacity: int, generations: int) -> DataFrame:
    """(shard, doc_id, piece, size, bin) of the best island of each shard."""
    sharded = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("long"))
    rows = sharded.select("shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "doc_id", "piece", "size", F.lit(0).alias("bin"), F.lit(0).alias("visitor"))
    for epoch in range(EPOCHS):
        rows = cut(rows.repartition(max(1, -(-shards * ISLANDS // ISLANDS_A_TASK)), "shard", "island").groupBy("shard", "island").applyInPandas(_island(capacity, epoch, generations), _ROWS))
        if epoch + 1 < EPOCHS:  # the elite visits the next island
            visit = rows.withColumn("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int")).withColumn("visitor", F.lit(1))
            rows = rows.unionByName(visit)
    fill = rows.groupBy("shard", "island", "bin").agg(F.sum("size").alias("fill"))
    worth = fill.groupBy("shard", "island").agg(F.count("*").alias("bins"), F.sum(F.pow(F.col("fill") / capacity, F.lit(2))).alias("square"))
    best = worth.groupBy("shard").agg(F.min_by("island", F.struct("bins", -F.round("square", 6), "island")).alias("island"))
    return rows.join(best, ["shard", "island"], "left_semi").select("shard", "doc_id", "piece", "size", "bin")


def pack(counts: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS, generations: int = GENERATIONS) -> DataFrame:
    """counts: (doc_id, n_tokens). Gives (container_id, doc_id, piece, start_at, size): the tokens start_at to
    start_at + size of the document lie in the container."""
    counts = counts.groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))
    full = F.floor(F.col("n_tokens") / capacity).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), full), lambda i: F.struct(i.cast("int").alias("piece"), F.least(F.lit(capacity), F.col("n_tokens") - i * capacity).cast("int").alias("size")))
    items = cut(counts.select("doc_id", F.explode(pieces).alias("p")).select("doc_id", "p.piece", "p.size").where((F.col("size") > 0) | (F.col("piece") == 0)))
    whole = items.where(F.col("size") == capacity).select(F.concat_ws("-", F.lit("full"), "doc_id", "piece").alias("container_id"), "doc_id", "piece", "size")
    rest, done = items.where(F.col("size") < capacity), []
    n = rest.count()
    for level in itertools.count():
        shards = max(1, round(n / shard_items))
        packed = cut(_evolve_shards(rest, shards, capacity, generations))
        named = packed.withColumn("container_id", F.concat_ws("-", F.lit(f"l{level}"), "shard", "bin"))
        if shards == 1:
            done.append(named)
            break
        fill = packed.groupBy("shard", "bin").agg(F.sum("size").alias("fill"))
        good = fill.where(F.col("fill") >= WELL_FILLED * capacity)
        done.append(named.join(good, ["shard", "bin"], "left_semi"))
        left = cut(named.join(good, ["shard", "bin"], "left_anti"))
        before, n = n, left.count()
        if not n or n > SHRINKS * before:  # a rest that no longer shrinks is as well packed as it will be
            done.append(left)
            break
        rest = left.select("doc_id", "piece", "size")
    out = whole
    for d in done:
        out = out.unionByName(d.select("container_id", "doc_id", "piece", "size"))
    return out.select("container_id", "doc_id", "piece", (F.col("piece") * capacity).cast("int").alias("start_at"), "size")
