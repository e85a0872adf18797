"""Problem 5: pack chunks into selections of a fixed budget by a grouping genetic algorithm on islands.

The chunks of a job are dealt at random into shards of bounded size. Each shard is worked on by several islands: a population of packings is bred by
injecting whole well-filled selections of one parent into another, dropping the selections that hold an injected chunk, and putting the
displaced chunks back: first by exchanging one or two chunks of a selection for displaced ones that fill it better, then by best fit. After each epoch the best packing
of every island migrates to the next one. An island ends at a proven lower bound of the number of selections, or when an epoch brought it nothing
``PATIENCE`` times in a row. The best island of a shard gives its selections; those that are left less than ``FULL`` filled are opened and packed again in new, fewer shards, so little room is lost at the shards' borders.

A chunk above the budget, and no other, is divided: into full selections and one rest, which is packed like a chunk.

Cases: tokens that are null or below 1 become ceil(code points / 4); a chunk of 0 tokens takes no room and is packed all the same; null or
non-positive budgets and null sources pack nothing; repeated rows of an id count once (the greatest tokens, if they differ); jobs without chunks give no row; extra columns are ignored.
"""

from __future__ import annotations

import random
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.functions.session import cut, small

#: Chunks of a shard, islands of a shard, epochs between migrations, packings of an island, offspring of an epoch.
SHARD_ROWS, ISLANDS, EPOCHS, POPULATION, OFFSPRING = 1_500, 4, 8, 12, 80
#: Epochs without gain after which an island ends.
PATIENCE = 2
#: Selections filled less than this are opened and packed again.
FULL, ROUNDS = 0.995, 2
STATE = "job_id int, shard int, island int, budget long, ids array<string>, sizes array<long>, elite array<int>, bins int, fill double, stale int, done boolean"

Bins = list[list[int]]


def best_fit(order: list[int], sizes: list[int], budget: int, bins: Bins) -> Bins:
    """``bins`` with the items of ``order`` put, one by one, where the least room is left."""
    room = sorted((budget - sum(sizes[i] for i in b), k) for k, b in enumerate(bins))
    for i in order:
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            left, k = room.pop(at)
            bins[k].append(i)
        else:
            left, k = budget, len(bins)
            bins.append([i])
        insort(room, (left - sizes[i], k))
    return bins


def fitness(bins: Bins, sizes: list[int], budget: int) -> tuple[int, float]:
    """Fewer selections first, then fuller ones: mean squared fill."""
    return -len(bins), sum((sum(sizes[i] for i in b) / budget) ** 2 for b in bins) / max(1, len(bins))


def lower_bound(sizes: list[int], budget: int) -> int:
    """A number of selections that no packing is below: for each size a, items above budget - a stand alone, those above half need one each, and those from a to half must go into what these leave."""
    ordered = sorted(x for x in sizes if x > 0)
    before = [0]
    for x in ordered:
        before.append(before[-1] + x)
    n, half = len(ordered), bisect_right(ordered, budget // 2)
    best = -(-before[-1] // budget)
    for k in range(half + 1):
        a = ordered[k] if k < half else budget // 2 + 1  # items smaller than a are left out
        alone = max(half, bisect_right(ordered, budget - a))
        large = n - half
        room = (alone - half) * budget - (before[alone] - before[half])
        best = max(best, large + max(0, -(-(before[half] - before[k] - room) // budget)))
    return max(best, 1 if sizes else 0)


def exchange(bins: Bins, loose: list[int], sizes: list[int], budget: int) -> list[int]:
    """One or two items of a bin go for one or two loose ones that fill it better; ``bins`` changes, what is loose afterwards comes back."""
    free = sorted((sizes[i], i) for i in loose)
    for bin_ in bins:
        if not free:
            break
        room = budget - sum(sizes[i] for i in bin_)
        if not room:
            continue
        out: tuple[int, ...] = ()
        into: tuple[tuple[int, int], ...] = ()
        gain = 0
        for give in [*((i,) for i in bin_), *combinations(bin_, 2)]:
            held = sum(sizes[i] for i in give)
            least, most = held + gain, held + room
            at = bisect_right(free, (most, len(sizes)))
            if at and free[at - 1][0] > least:
                out, into, gain = give, (free[at - 1],), free[at - 1][0] - held
                least = held + gain
            lo, hi = 0, len(free) - 1
            while lo < hi and least < most:
                both = free[lo][0] + free[hi][0]
                if both > most:
                    hi -= 1
                    continue
                if both > least:
                    out, into, gain, least = give, (free[lo], free[hi]), both - held, both
                lo += 1
            if gain == room:
                break
        if gain:
            bin_[:] = [i for i in bin_ if i not in out] + [i for _, i in into]
            for x in into:
                free.remove(x)
            for i in out:
                insort(free, (sizes[i], i))
    return [i for _, i in reversed(free)]


def crossover(a: Bins, b: Bins, sizes: list[int], budget: int, rng: random.Random) -> Bins:
    """Whole well-filled bins of a are injected into b; bins of b that hold an injected item go, and their other items are exchanged into the rest or best-fitted."""
    fill = sorted(range(len(a)), key=lambda k: -sum(sizes[i] for i in a[k]))
    take = fill[: max(1, len(fill) // 2)]
    injected = [a[k][:] for k in take if rng.random() < 0.5] or [a[take[0]][:]]
    inside = {i for b_ in injected for i in b_}
    kept, displaced = injected, []
    for bin_ in b:
        if inside.isdisjoint(bin_):
            kept.append(bin_[:])
        else:
            displaced += [i for i in bin_ if i not in inside]
    return best_fit(exchange(kept, displaced, sizes, budget), sizes, budget, kept)


def mutate(bins: Bins, sizes: list[int], budget: int, rng: random.Random) -> Bins:
    """The emptiest bin and a few others are opened and their items exchanged into the rest or best-fitted anew."""
    if len(bins) < 2:
        return bins
    emptiest = min(range(len(bins)), key=lambda k: sum(sizes[i] for i in bins[k]))
    opened = {emptiest, *(rng.randrange(len(bins)) for _ in range(min(4, len(bins))))}
    kept = [b[:] for k, b in enumerate(bins) if k not in opened]
    rng.shuffle(kept)
    loose = exchange(kept, [i for k in opened for i in bins[k]], sizes, budget)
    loose.sort(key=lambda i: -sizes[i] + rng.random() * sizes[i] * 0.1)
    return best_fit(loose, sizes, budget, kept)


def evolve(sizes: list[int], budget: int, start: list[Bins], seed: int, offspring: int = OFFSPRING, population: int = POPULATION) -> Bins:
    """The best packing of one island after an epoch; it ends at once at the lower bound."""
    rng = random.Random(seed)
    least = lower_bound(sizes, budget)
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    pool = [(fitness(b, sizes, budget), b) for b in start or [best_fit(order, sizes, budget, [])]]
    if max(pool, key=lambda p: p[0])[0][0] == -least:
        return max(pool, key=lambda p: p[0])[1]
    while len(pool) < population:
        noisy = sorted(range(len(sizes)), key=lambda i: -sizes[i] * (0.7 + 0.6 * rng.random()))
        b = best_fit(noisy, sizes, budget, [])
        pool.append((fitness(b, sizes, budget), b))
    for _ in range(offspring):
        pool.sort(key=lambda p: p[0], reverse=True)
        if pool[0][0][0] == -least:
            break
        (_, a), (_, b) = rng.sample(pool[: max(2, population // 2 + 1)], 2)
        child = mutate(crossover(a, b, sizes, budget, rng), sizes, budget, rng)
        pool[-1] = (fitness(child, sizes, budget), child)
    return max(pool, key=lambda p: p[0])[1]


def _to_bins(at: list[int]) -> Bins:
    bins: dict[int, list[int]] = {}
    for i, k in enumerate(at):
        bins.setdefault(k, []).append(i)
    return list(bins.values())


def _from_bins(bins: Bins, n: int) -> list[int]:
    at = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            at[i] = k
    return at


def items(chunks: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job_id, budget, chunk_id, tokens, part, parts, size): the chunks of each job, those above the budget in parts."""
    tokens = F.when(F.col("tokens") >= 1, F.col("tokens")).otherwise(F.coalesce(F.ceil(F.length("content") / 4), F.lit(0))).cast("long")
    distinct = chunks.filter(F.col("id").isNotNull()).select("id", "source_id", tokens.alias("tokens")).groupBy("id").agg(F.min("source_id").alias("source_id"), F.max("tokens").alias("tokens"))
    wanted = jobs.filter((F.col("budget") > 0) & F.col("source_id").isNotNull()).select("job_id", F.col("source_id").alias("of"), F.col("budget").cast("long").alias("budget")).dropDuplicates(["job_id"])
    parts = F.greatest(F.ceil(F.col("tokens") / F.col("budget")), F.lit(1)).cast("long")
    last = F.col("tokens") - (F.col("parts") - 1) * F.col("budget")
    return (
        distinct.join(small(wanted), F.col("source_id") == F.col("of"))
        .select("job_id", "budget", F.col("id").alias("chunk_id"), "tokens", parts.alias("parts"))
        .withColumn("part", F.explode(F.sequence(F.lit(1).cast("long"), F.col("parts"))))
        .withColumn("size", F.when(F.col("part") < F.col("parts"), F.col("budget")).otherwise(last))
    )


def _start(pieces: DataFrame, shard_rows: int, islands: int, seed: int) -> DataFrame:
    """One row of state per island; a shard holds about ``shard_rows`` pieces."""
    counts = pieces.groupBy("job_id").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("shards")).withColumnRenamed("job_id", "j")
    dealt = pieces.join(small(counts), F.col("job_id") == F.col("j")).withColumn("shard", F.pmod(F.xxhash64("key", F.lit(seed)), F.col("shards")).cast("int"))
    shards = dealt.groupBy("job_id", "shard").agg(F.max("budget").alias("budget"), F.sort_array(F.collect_list(F.struct("key", "size"))).alias("all"))
    return shards.select("job_id", "shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "budget", F.col("all.key").alias("ids"), F.col("all.size").alias("sizes"), F.expr("cast(array() as array<int>)").alias("elite"), F.lit(0).alias("bins"), F.lit(0.0).alias("fill"), F.lit(0).alias("stale"), F.lit(False).alias("done"))


def _epoch(state: DataFrame, epoch: int) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for r in p.itertuples(index=False):
                if r.done:
                    rows.append((*r[: len(STATE.split(","))],))
                    continue
                sizes = [int(x) for x in r.sizes]
                start = [_to_bins(list(e)) for e in (r.elite, r.guest) if len(e)]
                best = evolve(sizes, int(r.budget), start, seed=hash((int(r.job_id), int(r.shard), int(r.island), epoch)))
                bins, fill = fitness(best, sizes, int(r.budget))
                stale = 0 if (bins, fill) > (-r.bins, r.fill + 1e-9) or not r.bins else r.stale + 1
                rows.append((r.job_id, r.shard, r.island, r.budget, list(r.ids), sizes, _from_bins(best, len(sizes)), len(best), fill, stale, stale >= PATIENCE or len(best) <= lower_bound(sizes, int(r.budget))))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in STATE.split(", ")])

    # the elite of each island goes to the next one of its shard
    nxt = F.pmod(F.col("island") + 1, F.max("island").over(Window.partitionBy("job_id", "shard")) + 1)
    guests = state.select(F.col("job_id").alias("j"), F.col("shard").alias("s"), nxt.alias("i"), F.col("elite").alias("guest"))
    with_guest = state.join(guests, (F.col("job_id") == F.col("j")) & (F.col("shard") == F.col("s")) & (F.col("island") == F.col("i"))).drop("j", "s", "i") if epoch else state.withColumn("guest", F.col("elite"))
    columns = [c.split()[0] for c in STATE.split(", ")]
    return with_guest.repartition("job_id", "shard", "island").select(*columns, "guest").mapInPandas(run, STATE)


def _packed(pieces: DataFrame, shard_rows: int, islands: int, epochs: int, seed: int) -> DataFrame:
    """(job_id, key, size, budget, shard, bin, fill) of each piece by the best island of its shard."""
    state = _start(pieces, shard_rows, islands, seed)
    for epoch in range(epochs):
        state = cut(_epoch(state, epoch))
        if state.filter("not done").isEmpty():
            break
    best = state.withColumn("r", F.row_number().over(Window.partitionBy("job_id", "shard").orderBy("bins", "island"))).filter("r = 1")
    flat = best.select("job_id", "budget", "shard", F.explode(F.arrays_zip("ids", "sizes", "elite")).alias("x")).select("job_id", "budget", "shard", F.col("x.ids").alias("key"), F.col("x.sizes").alias("size"), F.col("x.elite").alias("bin"))
    return flat.withColumn("fill", F.sum("size").over(Window.partitionBy("job_id", "shard", "bin")) / F.col("budget"))


def pack(chunks: DataFrame, jobs: DataFrame, shard_rows: int = SHARD_ROWS, islands: int = ISLANDS, epochs: int = EPOCHS, rounds: int = ROUNDS) -> DataFrame:
    """(job_id, selection, chunk_id, part, parts, tokens, budget): which selection each chunk, or part of one, is in."""
    every = cut(items(chunks, jobs).withColumn("key", F.concat_ws("#", F.col("part").cast("string"), "chunk_id")))
    whole = every.filter(F.col("size") == F.col("budget")).select("job_id", "key", F.concat_ws("-", F.lit("w"), "key").alias("selection"))
    rest = every.filter(F.col("size") < F.col("budget")).select("job_id", "budget", "key", "size")
    placed = whole
    for k in range(rounds):
        packed = cut(_packed(rest, shard_rows, islands, epochs, seed=k))
        last = k == rounds - 1
        closed = packed if last else packed.filter(F.col("fill") >= FULL)
        placed = placed.unionByName(closed.select("job_id", "key", F.concat_ws("-", F.lit(f"r{k}"), F.col("shard").cast("string"), F.col("bin").cast("string")).alias("selection")))
        if not last:
            rest = packed.filter(F.col("fill") < FULL).select("job_id", "budget", "key", "size")
    return every.join(placed, ["job_id", "key"]).select("job_id", "selection", "chunk_id", "part", "parts", F.col("size").alias("tokens"), "budget")


def selections(packed: DataFrame) -> DataFrame:
    """(job_id, selection, chunks, total_tokens, budget, unused) of each selection."""
    return packed.groupBy("job_id", "selection").agg(F.count(F.lit(1)).alias("chunks"), F.sum("tokens").alias("total_tokens"), F.max("budget").alias("budget")).withColumn("unused", F.col("budget") - F.col("total_tokens"))


def divided(packed: DataFrame) -> DataFrame:
    """(job_id, chunk_id) of the chunks that had to be divided."""
    return packed.filter(F.col("parts") > 1).select("job_id", "chunk_id").distinct()
