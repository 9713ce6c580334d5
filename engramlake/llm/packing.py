"""Best-fit packing by a grouping genetic algorithm on islands.

A chromosome is a packing: a list of bins. Crossover injects the best filled bins of one parent into another, removes
the bins there that hold any of the same pieces, and best-fits the displaced pieces into what is left; mutation empties
a few badly filled bins and best-fits their pieces anew. Fitness is the number of bins, then the sum of squared fills.

Pieces of the full length are sequences as they are. All others are dealt evenly into neighbourhoods of a bounded
number of pieces by their row number (so copies and hot sources spread). Several islands evolve each neighbourhood, in
tasks of their own, from differently perturbed best-fit packings, for FIRST generations at least; after each epoch every
island's elite is written to the shared folder and read by its neighbour island, which goes on with both elites. A
neighbourhood is done when it meets its lower bound, ceil(sum / capacity), or after EPOCHS. Then the bins that are not
well filled of all neighbourhoods are dissolved and their pieces evolve again in fewer neighbourhoods, until these have no
more to give. So memory and time of a task are bounded, and the waste is about one partly filled bin for a neighbourhood
of the last round. The result says how many generations and migrations each piece's packing went through.

Null and empty texts give one piece of the end id alone. Null ids and repeated rows are pieces like any others (a
piece is known by its row, not its id). An empty table gives no rows. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Window as W, functions as F

from engramlake.session import partitions, release, stage

CAPACITY = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces of a neighbourhood, islands for each, epochs between which elites migrate, generations in an epoch, packings
#: on an island.
NEIGHBOURHOOD, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 8192, 2, 2, 6, 4
#: Generations that every island goes through, even if a packing to begin with meets the bound.
FIRST = 1
#: A bin is well filled from this share of the capacity on; others are dissolved for the next round.
WELL_FILLED, ROUNDS = 0.99, 3


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """PIECES: ids of each document with the end id; only documents beyond the capacity are cut."""

    def cut(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from engramlake.llm.tokens import word_ids

        words, end = word_ids(vocabulary), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                rows = []
                part = batch.slice(low, 2000)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = words.encode(text) + end
                    n = len(ids) // 4
                    rows += [(doc_id, k, at, min(capacity, n - at), zlib.crc32(ids[4 * at : 4 * (at + capacity)])) for k, at in enumerate(range(0, n, capacity))]
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return stage(docs.select("doc_id", "text").mapInArrow(cut, PIECES), "pieces")


# --- one neighbourhood -------------------------------------------------------------------------------------------


def best_fit(lengths: list[int], order: Iterable[int], capacity: int, bins: list[list[int]] | None = None, free: list[int] | None = None) -> list[list[int]]:
    """Put pieces, in the order given, each into the fullest bin that holds it, and else into a new one."""
    from bisect import bisect_left, insort

    bins, free = bins if bins is not None else [], free if free is not None else []
    room = sorted((f, k) for k, f in enumerate(free) if f)
    for i in order:
        n = lengths[i]
        at = bisect_left(room, (n, -1))
        if at < len(room):
            f, k = room.pop(at)
            bins[k].append(i)
        else:
            f, k = capacity, len(bins)
            bins.append([i])
        if f > n:
            insort(room, (f - n, k))
    return bins


def _fill(lengths: list[int], b: list[int]) -> int:
    return sum(lengths[i] for i in b)


def fitness(lengths: list[int], bins: list[list[int]]) -> tuple[int, int]:
    """Smaller is better."""
    return len(bins), -sum(_fill(lengths, b) ** 2 for b in bins)


def crossover(lengths: list[int], ours: list[list[int]], theirs: list[list[int]], capacity: int, rng, share: float = 0.5) -> list[list[int]]:
    """Inject the best filled bins of theirs that ours doesn't have, drop our bins with duplicates, best-fit the rest."""
    own = {frozenset(b) for b in ours}
    ranked = sorted((b for b in theirs if frozenset(b) not in own), key=lambda b: (-_fill(lengths, b), rng.random()))
    injected = [list(b) for b in ranked[: max(1, int(share * len(ranked)))]]
    taken = {i for b in injected for i in b}
    kept, displaced = [], []
    for b in ours:
        if taken.isdisjoint(b):
            kept.append(list(b))
        else:
            displaced += [i for i in b if i not in taken]
    bins = injected + kept
    displaced.sort(key=lambda i: -lengths[i])
    return best_fit(lengths, displaced, capacity, bins, [capacity - _fill(lengths, b) for b in bins])


def mutate(lengths: list[int], bins: list[list[int]], capacity: int, rng) -> list[list[int]]:
    """Empty the worst filled bins and a few others and best-fit their pieces anew, the longest first."""
    ranked = sorted(range(len(bins)), key=lambda k: _fill(lengths, bins[k]))
    gone = set(ranked[: max(1, len(bins) // 50)]) | set(rng.sample(ranked, min(len(ranked), 1 + len(bins) // 50)))
    kept = [list(b) for k, b in enumerate(bins) if k not in gone]
    loose = sorted((i for k in gone for i in bins[k]), key=lambda i: (-lengths[i], rng.random()))
    return best_fit(lengths, loose, capacity, kept, [capacity - _fill(lengths, b) for b in kept])


def evolve(lengths: list[int], capacity: int, seed: int, elites: list[list[list[int]]] = (), generations: int = GENERATIONS, population: int = POPULATION) -> tuple[list[list[int]], int]:
    """The best packing that an island finds, and after how many generations; elites: packings to begin with."""
    from random import Random

    rng, bound = Random(seed), -(-sum(lengths) // capacity)
    group = [[list(b) for b in e] for e in elites]
    while len(group) < max(2, population):
        spread = 0.0 if not group and seed % ISLANDS == 0 else 0.15  # the first is best-fit decreasing itself
        order = sorted(range(len(lengths)), key=lambda i: -lengths[i] * (1 + spread * rng.random()))
        group.append(best_fit(lengths, order, capacity))
    marks = [fitness(lengths, g) for g in group]
    for n in range(generations):
        if n >= FIRST and min(marks)[0] <= bound:
            return group[marks.index(min(marks))], n
        a, b = rng.sample(range(len(group)), 2)
        for x, y in ((a, b), (b, a)):
            child = mutate(lengths, crossover(lengths, group[x], group[y], capacity, rng), capacity, rng)
            worst, mark = marks.index(max(marks)), fitness(lengths, child)
            if mark < marks[worst]:
                group[worst], marks[worst] = child, mark
    return group[marks.index(min(marks))], generations


# --- all of them -------------------------------------------------------------------------------------------------

SOLUTION = "place long, island int, row long, length long, bin int, n_bins int, open boolean, generations int, migrations int"


def _island(capacity: int, islands: int, seed: int):
    """applyInPandas: one island of one neighbourhood, with the elites that came to it (column elite, -1: none)."""

    def run(pdf):
        import pandas as pd

        first = pdf["elite"].min()
        base = pdf[pdf["elite"] == first].sort_values("row")
        rows, lengths = base["row"].to_numpy(), base["length"].tolist()
        elites = []
        for e, own in pdf[pdf["elite"] >= 0].groupby("elite"):
            own = own.sort_values("row")
            bins: dict[int, list[int]] = {}
            for i, b in enumerate(own["bin"].tolist()):
                bins.setdefault(b, []).append(i)
            elites.append([bins[b] for b in sorted(bins)])
        place, island = int(pdf["place"].iloc[0]), int(pdf["island"].iloc[0])
        best, n = evolve(lengths, capacity, (seed + place) * islands + island, elites)
        number = [0] * len(lengths)
        for k, b in enumerate(best):
            for i in b:
                number[i] = k
        return pd.DataFrame({"place": place, "island": island, "row": rows, "length": lengths, "bin": number, "n_bins": len(best), "open": len(best) > -(-sum(lengths) // capacity), "generations": int(pdf["generations"].max()) + n, "migrations": int(pdf["migrations"].max()) + bool(elites)})

    return run


def _evolved(items: DataFrame, n: int, capacity: int, neighbourhood: int, seed: int) -> DataFrame:
    """(place, row, length, bin, generations, migrations) for n items (row, length): each neighbourhood's best packing."""
    places = max(1, -(-n // neighbourhood))
    tasks = max(partitions(items.sparkSession), min(places * ISLANDS, 10_000))  # of like work, which their bytes don't tell

    def islands(rows: DataFrame, seed: int) -> DataFrame:
        return rows.repartition(tasks, "place", "island").groupBy("place", "island").applyInPandas(_island(capacity, ISLANDS, seed), SOLUTION)

    dealt = items.select(F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(places)).alias("place"), "row", "length")
    none = [F.lit(v).alias(c) for v, c in ((-1, "elite"), (0, "bin"), (0, "generations"), (0, "migrations"))]
    begin = dealt.select("*", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), *none)
    found = stage(islands(begin, seed), "islands-0")
    done = []
    for epoch in range(EPOCHS + 1):
        best = found.groupBy("place").agg(F.min(F.struct("n_bins", "island")).alias("_best"), F.min("open").alias("_open"))
        best = stage(found.join(best, "place"), "elites")
        release(found)
        of = (F.col("n_bins") == F.col("_best.n_bins")) & (F.col("island") == F.col("_best.island"))
        last = epoch == EPOCHS
        done.append(best.where(of if last else of & ~F.col("_open")))
        if last or not best.where("_open").limit(1).count():
            break
        # Elites migrate: each island goes on with its own and its neighbour's.
        left = best.where("_open")
        own = ["row", "length", "bin", F.col("island").alias("elite"), "generations", "migrations"]
        home, guest = left.select("place", "island", *own), left.select("place", ((F.col("island") + 1) % ISLANDS).alias("island"), *own)
        found = stage(islands(home.unionByName(guest), seed + 7919 * (epoch + 1)), f"islands-{epoch + 1}")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return stage(out.select("place", "row", "length", "bin", "generations", "migrations"), "packed")


def pack(pieces: DataFrame, capacity: int = CAPACITY, neighbourhood: int = NEIGHBOURHOOD) -> DataFrame:
    """The pieces with sequence_id, offset, and the generations and migrations of their neighbourhood's packing (0 of pieces
    of the full length). Pieces must come from a written table and have a length from 1 to capacity."""
    rows = stage(pieces.withColumn("row", F.monotonically_increasing_id()), "piece-rows")
    whole = F.col("length") == capacity
    seen = rows.agg(F.count_if(~F.col("length").between(1, capacity) | F.col("length").isNull()).alias("wrong"), F.count_if(F.col("length") < capacity).alias("items")).first()
    if seen["wrong"]:
        raise ValueError(f"a piece has a length outside 1 to {capacity}")
    none = [F.lit(0).alias(c) for c in ("generations", "migrations")]
    parts = [rows.where(whole).select("row", F.lit(-1).alias("round"), F.lit(0).cast("long").alias("place"), F.col("row").alias("bin"), *none)]
    items, n = rows.where("length < %d" % capacity).select("row", "length"), seen["items"]
    for k in range(ROUNDS):
        packed = _evolved(items, n, capacity, neighbourhood, 104729 * (k + 1))
        fills = packed.groupBy("place", "bin").agg(F.sum("length").alias("fill"), F.count("*").alias("n"))
        poor = F.col("fill") < WELL_FILLED * capacity
        # Another round can save bins only if the badly filled ones have room for whole bins among different places.
        had = fills.agg(F.count_distinct("place").alias("places"), F.count_if(poor).alias("bins"), F.sum(F.when(poor, F.col("fill"))).alias("fill"), F.sum(F.when(poor, F.col("n"))).alias("n")).first()
        last = k == ROUNDS - 1 or had["places"] <= 1 or had["bins"] <= -(-(had["fill"] or 0) // capacity)
        out = [F.lit(k).alias("round"), "place", F.col("bin").cast("long").alias("bin"), "generations", "migrations"]
        if last:
            parts.append(packed.select("row", *out))
            break
        parts.append(packed.join(fills.where(poor).select("place", "bin"), ["place", "bin"], "left_anti").select("row", *out))
        items, n = stage(packed.join(fills.where(poor).select("place", "bin"), ["place", "bin"], "left_semi").select("row", "length"), "displaced"), had["n"]
    where = parts[0]
    for p in parts[1:]:
        where = where.unionByName(p)
    out = rows.join(where, "row")
    bin_ = ["round", "place", "bin"]
    offset = F.sum("length").over(W.partitionBy(*bin_).orderBy("row").rowsBetween(W.unboundedPreceding, -1))
    # A bin is named by its first row, which no other bin has.
    named = out.withColumn("offset", F.coalesce(offset, F.lit(0)).cast("long")).withColumn("sequence_id", F.min("row").over(W.partitionBy(*bin_)))
    return named.select(*pieces.columns, "sequence_id", "offset", "generations", "migrations")
