"""SimHash near-dedup over a Gray-order hierarchical index.

A fingerprint's bit is set if it is set in over half of the hashes (XXH64, seed 42) of the text's word shingles,
repeats included. Fingerprints link at `radius` or fewer differing bits; documents of linked fingerprints form
components.

Equal fingerprints are grouped first, so copies cost nothing further. The distinct ones are dealt to parts of the index:
of radius + 1 blocks of bits two linked ones agree on one at least, so each fingerprint, turned so that the block comes
first, goes to the part of the block's leading bits, once for each block, and no link is lost. There are as many leading
bits as make parts of about PART fingerprints. A part stands in order of Gray rank (the place of a value in the Gray
code), so neighbours share most bits, and a hierarchical index is built on that order: an upper node holds the bits that
all below it share (mask and pattern) beyond those of its own parent. A search goes down from the roots and adds up the
differences in the newly shared bits; a node whose sum is beyond the radius is left out with all below it, and so is one
whose members are all linked with the seeker already. A part gives a spanning star for each linked set, never all its
pairs. Where many fingerprints share a block, their part is dealt on in pairs of slices.

Null, empty and blank texts have fingerprint zero and link like any other. Repeated rows and repeated ids are
documents like any others; a null doc_id is nobody's component id unless all are null. An empty table gives no rows.
Columns besides doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from engramlake.operators.components import connected_components
from engramlake.session import partitions, release, stage

SEED, SHINGLE, RADIUS = 42, 3, 2
FAN = 8  # children of a node
PART = 1 << 14  # fingerprints of a part of the index, about; parts of HOT times as many are dealt on in slices
HOT = 4


# --- fingerprints ------------------------------------------------------------------------------------------------


def _lanes():
    """By byte: its bits, the highest first, each in a byte of a 64-bit number."""
    import numpy as np

    return np.ascontiguousarray(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)).view(np.uint64)[:, 0]


def majority(digests: bytes, lanes) -> int:
    """Of hashes of 8 bytes each, big-endian: the bits set in over half, as a signed number."""
    import numpy as np

    d = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    if not len(d):
        return 0
    sums = np.add.reduceat(lanes[d], np.arange(0, len(d), 255), axis=0)  # a byte counts to 255
    counts = sums.view(np.uint8).reshape(len(sums), 64).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(d)).view(">i8")[0])


def shingle_digests(text: str | None, k: int) -> bytes:
    from xxhash import xxh64_digest

    words = text.encode().lower().split() if text else []  # of bytes: A-Z alone, and the six ASCII spaces
    if len(words) <= k:
        return xxh64_digest(b" ".join(words), SEED) if words else b""
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    return b"".join([xxh64_digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[k - 1 :])])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint): 64 bits as a signed number."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        lanes = _lanes()
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "fingerprint": pa.array([majority(shingle_digests(t, shingle), lanes) for t in part.column(1).to_pylist()], pa.int64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint long")


# --- the index ---------------------------------------------------------------------------------------------------


def gray_rank(c: Column) -> Column:
    """The place of a 64-bit pattern in the Gray code."""
    for n in (1, 2, 4, 8, 16, 32):
        c = c.bitwiseXOR(F.shiftrightunsigned(c, n))
    return c


def gray_ranks(x):
    """The same of a numpy array of unsigned numbers."""
    import numpy as np

    for n in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(n))
    return x


class GrayIndex:
    """Over distinct fingerprints in Gray order; node k of a level is over nodes FAN*k.. of the level below."""

    def __init__(self, values):
        import numpy as np

        self.visited = self.pruned = 0  # nodes compared by searches, and values below those that were left out
        self.values = np.asarray(values, np.uint64)
        every, any_ = self.values, self.values
        masks, self.patterns = [np.full(len(every), ~np.uint64(0))], [every]
        while len(every) > FAN:
            at = np.arange(0, len(every), FAN)
            every, any_ = np.bitwise_and.reduceat(every, at), np.bitwise_or.reduceat(any_, at)
            masks.append(~(every ^ any_))
            self.patterns.append(every)
        # What a node shares beyond its parent.
        self.own = [m & ~up[np.arange(len(m)) // FAN] for m, up in zip(masks, masks[1:])] + [masks[-1]]

    def search(self, queries, radius: int, labels=None, of=None):
        """(number of the query, number of the value) within the radius. With labels of all values and of the queries:
        not those of the query's own label."""
        import numpy as np

        low, high = [labels], [labels]
        if labels is not None:
            for p in self.patterns[1:]:
                at = np.arange(0, len(low[-1]), FAN)
                low, high = [*low, np.minimum.reduceat(low[-1], at)], [*high, np.maximum.reduceat(high[-1], at)]
        top = len(self.patterns) - 1
        n = len(self.patterns[top])
        q, node = np.repeat(np.arange(len(queries)), n), np.tile(np.arange(n), len(queries))
        sums = np.zeros(len(q), np.int64)
        for level in range(top, -1, -1):
            sums = sums + np.bitwise_count((queries[q] ^ self.patterns[level][node]) & self.own[level][node])
            keep = sums <= radius
            if labels is not None:
                keep &= (low[level][node] != of[q]) | (high[level][node] != of[q])
            self.visited += len(keep)
            if level:
                left = node[~keep] * FAN**level
                self.pruned += int((np.minimum(left + FAN**level, len(self.values)) - left).sum())
            q, node, sums = q[keep], node[keep], sums[keep]
            if level:
                size = len(self.patterns[level - 1])
                q, sums = np.repeat(q, FAN), np.repeat(sums, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                keep = node < size
                q, node, sums = q[keep], node[keep], sums[keep]
        return q, node


def spanning_links(values, radius: int):
    """For fingerprints in Gray order: (number, number of the first of its linked set) for all but the first ones."""
    import numpy as np

    index, n = GrayIndex(values), len(values)
    labels = np.arange(n)
    at, size = 0, 8
    while at < n:
        own = np.arange(at, min(n, at + size))
        q, v = index.search(index.values[own], radius, labels, labels[own])
        a, b = own[q], v
        while len(a):
            x, y = labels[a], labels[b]
            a, b, x, y = (z[x != y] for z in (a, b, x, y))
            to = np.arange(n)
            np.minimum.at(to, np.maximum(x, y), np.minimum(x, y))
            while (to[to] != to).any():
                to = to[to]
            labels = to[labels]
        at, size = at + size, min(512, size * 2)
    other = np.flatnonzero(labels != np.arange(n))
    return other, labels[other]


def _by_group(work):
    """mapInArrow over columns of numbers, sorted by the first: work gets the columns of whole groups."""

    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not held or held[0][0][0] == new[0][-1]:
                held.append(new)  # still in one group
                continue
            whole = [np.concatenate(x) for x in zip(*held, new)]
            cut = int(np.searchsorted(whole[0], whole[0][-1]))  # the last group may go on in the next batch
            held = [[x[cut:] for x in whole]]
            yield from map(pa.RecordBatch.from_pydict, work(*(x[:cut] for x in whole)))
        if held:
            yield from map(pa.RecordBatch.from_pydict, work(*(np.concatenate(x) for x in zip(*held))))

    return run


def _part_links(radius: int):
    """Work of _by_group: (cell, turned, fingerprint) sorted by cell and Gray rank of the turned one; gives links (a, b)."""

    def run(cell, turned, fingerprint):
        import numpy as np

        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(cell)]):
            if e - s > 1:
                own = fingerprint[s:e]
                a, b = spanning_links(turned[s:e].view(np.uint64), radius)
                yield {"a": own[a], "b": own[b]}

    return run


def in_slices(rows: DataFrame, sizes: DataFrame, key: str, salt_of: str) -> DataFrame:
    """Rows with cell, salt and other: a key with `salts` in sizes (key, salts) over one is dealt into that many slices, and
    each pair of slices has a cell of its own, that rows of either go to."""
    grid = rows.join(sizes, key, "left").withColumn("salts", F.coalesce("salts", F.lit(1))).withColumn("salt", F.pmod(F.xxhash64(salt_of), F.col("salts")).cast("int"))
    grid = grid.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    cell = F.when(F.col("salts") == 1, F.col(key)).otherwise(F.xxhash64(key, F.least("salt", "other"), F.greatest("salt", "other")))
    return grid.withColumn("cell", cell)


def parted(values: DataFrame, radius: int, n: int) -> DataFrame:
    """(part, turned, fingerprint) of n distinct fingerprints: the parts of the index that each is in."""
    blocks = radius + 1
    edges = [64 * k // blocks for k in range(blocks + 1)]
    lead = min(64 // blocks, max(0, (n // PART).bit_length()))
    turned = [F.shiftleft("fingerprint", e).bitwiseOR(F.shiftrightunsigned("fingerprint", 64 - e)) if e else F.col("fingerprint") for e in edges[: blocks if lead else 1]]
    top = lambda c, k: F.lit(k).cast("long") + len(turned) * (F.shiftrightunsigned(c, 64 - lead) if lead else F.lit(0).cast("long"))
    each = F.explode(F.array(*(F.struct(top(c, k).alias("part"), c.alias("turned")) for k, c in enumerate(turned))))
    return values.select(each.alias("p"), "fingerprint").select("p.part", "p.turned", "fingerprint")


def links(values: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fingerprint) that span every linked set."""
    dealt = parted(values, radius, values.count())
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > HOT * PART)
    cells = in_slices(dealt, sizes.select("part", F.ceil(F.col("n") / PART).cast("int").alias("salts")), "part", "fingerprint")
    cells = cells.withColumn("rank", gray_rank(F.col("turned"))).withColumn("rank", F.col("rank").bitwiseXOR(F.lit(-(1 << 63))))  # as an unsigned number
    cells = cells.repartition(partitions(values.sparkSession), "cell").sortWithinPartitions("cell", "rank")
    return cells.select("cell", "turned", "fingerprint").mapInArrow(_by_group(_part_links(radius)), "a long, b long")


def components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least doc_id reachable), one row for each of docs."""
    prints = stage(fingerprints(docs, shingle), "simhash")
    values = stage(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "simhash-values")
    parts = connected_components(links(values.select("fingerprint"), radius))
    linked = values.join(parts.withColumnRenamed("node", "fingerprint"), "fingerprint")
    named = linked.join(linked.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fingerprint", "component_id")
    named = stage(values.join(named, "fingerprint", "left").select("fingerprint", F.coalesce("component_id", "least").alias("component_id")), "simhash-components")
    release(values)
    return prints.join(named, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The documents that stay, with all their columns: of each component the rows with its least doc_id."""
    found = components(docs, shingle, radius)
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__el_id")).distinct()
    return docs.join(stay, F.col("doc_id").eqNullSafe(F.col("__el_id")), "left_semi")


# --- near copies by similarity -----------------------------------------------------------------------------------

#: For similarities well below equality, where fingerprints of near copies may differ in many bits.
NEAR_SHINGLE, SIMILARITY = 5, 0.8
COUNTER_BITS, COUNTER_SLICES = 22, 64  # counters of shingles, by their hash, for the order of the shingles only
SIDE = 8192  # a group with more than SIDE**2 comparisons is dealt over tasks
CLASSES = 1024  # of shingles, by hash, whose parities are held for a text
NO_WORDS = 0  # the key of all texts without words
SMALL = 16  # groups up to this size are compared together
FORESTS = 3
MEMBERS = 2000  # texts that are held against one in a task, about


def _may_be_near(n, m, at, other_at):
    """Not true of pairs of sets, of n and m shingles, that can't have SIMILARITY if the shingle at these places is the
    first that they share: sizes differ too much, or too few shingles come behind it."""
    import numpy as np

    return (np.minimum(n, m) >= SIMILARITY * np.maximum(n, m) - 1e-6) & (np.minimum(n - at, m - other_at) * (1 + SIMILARITY) >= SIMILARITY * (n + m) - 1e-6)


def shingles(text: str | None):
    """The hashes of a text's distinct word shingles, in order."""
    import numpy as np

    return np.unique(np.frombuffer(shingle_digests(text, NEAR_SHINGLE), ">u8").astype(np.uint64))


def prefix(h, levels):
    """The rarest of a text's shingles, rare ones first by levels (of how many texts have it), then by hash. Two sets of
    similarity SIMILARITY share that part of either one's size at least, so with any order they have a shingle in common
    among the first size - share + 1."""
    import numpy as np

    n = len(h)
    if not n:
        return np.full(1, NO_WORDS, np.int64)
    order = np.argsort(levels[h >> np.uint64(64 - COUNTER_BITS)], kind="stable")
    return h[order[: n - int(np.ceil(SIMILARITY * n - 1e-6)) + 1]].view(np.int64)


def parities(h) -> bytes:
    """Of each of CLASSES classes of shingles, whether their number is odd."""
    import numpy as np

    return np.packbits(np.bincount((h >> np.uint64(6)).astype(np.int64) & (CLASSES - 1), minlength=CLASSES) & 1).tobytes()


def shingle_levels(docs: DataFrame) -> bytes:
    """How common shingles are over all texts: a byte for each of 2**COUNTER_BITS counters, an eighth of a binary
    logarithm a step. Tasks count all their texts' shingles by the leading bits of the hash; slices of the counters are
    added up. What is found doesn't hang on the counts, how many rows meet does."""
    size = (1 << COUNTER_BITS) // COUNTER_SLICES

    def count(batches: Iterable) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        counts, held, n = np.zeros(1 << COUNTER_BITS, np.int64), [], 0

        def add():
            counts[:] += np.bincount(np.concatenate(held), minlength=1 << COUNTER_BITS)

        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                for t in batch.column(0).slice(low, 500).to_pylist():
                    held.append((shingles(t) >> np.uint64(64 - COUNTER_BITS)).astype(np.int32))
                    n += len(held[-1])
                    if n > 2_000_000:
                        add()
                        held, n = [], 0
        if held:
            add()
        if counts.any():
            parts = [zlib.compress(c.astype(np.uint32).tobytes(), 1) for c in np.split(counts, COUNTER_SLICES)]
            yield pa.RecordBatch.from_pydict({"slice": pa.array(range(COUNTER_SLICES), pa.int64()), "counts": pa.array(parts, pa.binary())})

    def merge(batches: Iterable) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        sums: dict = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(zlib.decompress(part), np.uint32).astype(np.int64)
        if sums:
            levels = [np.floor(8 * np.log2(np.maximum(s, 1))).clip(0, 255).astype(np.uint8).tobytes() for s in sums.values()]
            yield pa.RecordBatch.from_pydict({"slice": pa.array(list(sums), pa.int64()), "levels": pa.array(levels, pa.binary())})

    counts = docs.select("text").mapInArrow(count, "slice long, counts binary")
    merged = counts.repartition(COUNTER_SLICES, "slice").mapInArrow(merge, "slice long, levels binary")
    got = {r["slice"]: bytes(r["levels"]) for r in merged.collect()}  # COUNTER_SLICES rows
    return b"".join(got.get(k, bytes(size)) for k in range(COUNTER_SLICES))


def _sets(levels):
    """mapInArrow: (row, text) to (row, n, fingerprint, wide, keys); levels: a broadcast value."""

    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        own, lanes = np.frombuffer(levels.value, np.uint8), _lanes()

        def one(text):
            digests = shingle_digests(text, NEAR_SHINGLE)
            h = np.unique(np.frombuffer(digests, ">u8").astype(np.uint64))
            return len(h), majority(digests, lanes), parities(h), prefix(h, own)

        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                n, prints, wide, keys = zip(*map(one, part.column(1).to_pylist()))
                yield pa.RecordBatch.from_pydict({"row": part.column(0), "n": pa.array(n, pa.int32()), "fingerprint": pa.array(prints, pa.int64()), "wide": pa.array(wide, pa.binary()), "keys": pa.array(keys, pa.list_(pa.int64()))})

    return run


def _groups(key, row, n, at):
    """Of groups of two rows or more, sorted by key and row: with the first row, and whether near copies of it may be."""
    import numpy as np

    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    first, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    may = _may_be_near(n.astype(np.int64), n[first].astype(np.int64), at, at[first]) & (row != row[first])
    own = np.flatnonzero(size > 1)
    if len(own):
        yield {"key": key[own], "row": row[own], "n": n[own], "at": at[own], "least": row[first][own], "size": size[own].astype(np.int64), "may": may[own]}


def _forests(x, y, labels):
    """Numbers of the pairs (x, y) that make spanning forests over what labels (one array for each forest, changed here)
    leave apart: a pair is in the first forest that it joins parts of."""
    import numpy as np

    left = np.arange(len(x))
    for own in labels:
        taken = []
        while True:
            a, b = own[x[left]], own[y[left]]
            apart = np.flatnonzero(a != b)
            if not len(apart):
                break
            first = apart[np.unique(np.maximum(a, b)[apart], return_index=True)[1]]
            to = np.arange(len(own))
            to[np.maximum(a, b)[first]] = np.minimum(a, b)[first]
            while (to[to] != to).any():
                to = to[to]
            own[:] = to[own]
            taken.append(left[first])
            left = np.delete(left, first)
        yield from taken


def _group_pairs(whole: bool):
    """Work of _by_group: pairs of rows of a group that have different labels and may be near copies, in groups of more than
    SMALL by their parities too (wide); of a cross of two salts, only pairs with one row of each. Sorted by cell and label.
    whole: all such pairs; else in those groups FORESTS spanning forests of them, which join what all would, even if some
    prove to be no near copies, and are no more than FORESTS times the rows."""

    def run(*columns):
        return _pairs_of_groups(whole, *columns)

    return run


def _pairs_of_groups(whole, key, salt, cross, row, n, at, label, wide):
    import numpy as np

    n = n.astype(np.int64)

    def pairs(i, j):
        keep = (label[i] != label[j]) & ((salt[i] != salt[j]) | ~cross[i])
        return keep & _may_be_near(n[i], n[j], at[i], at[j])

    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    small = np.repeat(sizes <= SMALL, sizes)
    for d in range(1, SMALL):
        i = np.flatnonzero((key[d:] == key[:-d]) & small[d:]) if len(key) > d else np.zeros(0, int)
        if not len(i):
            break
        i = i[pairs(i, i + d)]
        yield {"a": row[i], "b": row[i + d]}
    for s, e in zip(starts[sizes > SMALL].tolist(), (starts + sizes)[sizes > SMALL].tolist()):
        bits = np.frombuffer(b"".join(wide[s:e]), np.uint64).reshape(-1, CLASSES // 64)
        parts = [np.unique(label[s:e], return_inverse=True)[1] for _ in range(0 if whole else FORESTS)]
        for low in range(s, e, 128):
            i = np.arange(low, min(e, low + 128))
            # What has the label of the first row comes at once, and is left out if all of the rows have it.
            begin = s + int(np.searchsorted(label[s:e], label[low], "right")) if label[low] == label[i[-1]] else low
            for to in range(begin, e, 2048):
                j = np.arange(to, min(e, to + 2048))
                x, y = np.nonzero((i[:, None] < j[None, :]) & pairs(i[:, None], j[None, :]))
                x, y = i[x], j[y]
                near = _parities_allow(bits[x - s] ^ bits[y - s], n[x] + n[y])
                x, y = x[near], y[near]
                for some in [slice(None)] if whole else _forests(x - s, y - s, parts):
                    if len(x[some]):
                        yield {"a": row[x[some]], "b": row[y[some]]}


def _parities_allow(differing, sizes):
    """Sets of similarity s differ in (n + m)(1 - s)/(1 + s) shingles at most, so parities of classes of them in no more."""
    import numpy as np

    return np.bitwise_count(differing).sum(1, dtype=np.int64) * (1 + SIMILARITY) <= sizes * (1 - SIMILARITY) + 1e-6


def similarity(a: str | None, b: str | None) -> float:
    """Jaccard similarity of the sets of word shingles; of two texts without words, 1."""
    return _similarity(shingles(a), shingles(b))


def _similarity(x, y) -> float:
    import numpy as np

    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def near_components(docs: DataFrame) -> DataFrame:
    """(row, component) of the rows of docs that have near copies: NEAR_SHINGLE words, SIMILARITY or more, linked.

    Candidates come from the Gray-order index over the fingerprints of these shingles, which finds the closest copies, and
    from a join that loses no pair: all pairs with a shingle in common among the rarest of each (see prefix), without those
    that sizes, places or parities rule out. In a group of rows with a shingle in common each is held against the least row
    first; of what the links so far leave in different components, spanning forests come next, and then all pairs that are
    still open, groups with many such comparisons in pairs of slices. Each candidate pair is verified on the whole texts.
    docs: (row, text) from a written table, row unique."""
    spark = docs.sparkSession
    docs = docs.select("row", "text")
    levels = spark.sparkContext.broadcast(shingle_levels(docs))  # 2**COUNTER_BITS bytes
    sets = stage(docs.mapInArrow(_sets(levels), "row long, n int, fingerprint long, wide binary, keys array<long>"), "near-sets")
    dealt = sets.select(F.posexplode("keys").alias("at", "key"), "row", "n").select("key", "row", "n", "at")
    dealt = dealt.repartition(partitions(spark), "key").sortWithinPartitions("key", "row")
    many = stage(dealt.mapInArrow(_by_group(_groups), "key long, row long, n int, at int, least long, size long, may boolean"), "near-groups")
    star = many.where("may").select(F.col("row").alias("a"), F.col("least").alias("b")).distinct()
    near = stage(star.unionByName(index_links(sets)), "near-first-pairs")
    tried, found = [near], [_links_on_texts(docs, sets, near)]
    for whole in (False, True):
        pairs = _open_pairs(many, sets, reduce(DataFrame.unionByName, found), whole)
        found.append(_links_on_texts(docs, sets, pairs, reduce(DataFrame.unionByName, tried)))
        tried.append(pairs)
    out = connected_components(reduce(DataFrame.unionByName, found)).withColumnRenamed("node", "row")
    release(sets, many, *tried, *found)
    return out


def _open_pairs(many: DataFrame, sets: DataFrame, links: DataFrame, whole: bool) -> DataFrame:
    """(a, b): pairs of rows of the groups, without the least row, that links leave in different components and that may be
    near copies: all of them, or forests (see _group_pairs)."""
    parts = connected_components(links)
    rest = many.where("size > 2 and row <> least").join(parts.withColumnRenamed("node", "row"), "row", "left")
    rest = stage(rest.select("key", "row", "n", "at", "size", F.coalesce("component", "row").alias("label")), "near-rest")
    sizes = rest.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.count("*").alias("labels"))
    sizes = sizes.where("labels > 1").select("key", F.ceil(F.sqrt(F.col("n") * (F.col("n") - F.col("most"))) / SIDE).cast("int").alias("salts"))
    open_ = rest.join(sizes, "key", "left_semi")
    wide = open_.where(F.col("size") > SMALL).join(sets.select("row", "wide"), "row")
    open_ = open_.where(F.col("size") <= SMALL).withColumn("wide", F.lit(None).cast("binary")).unionByName(wide)
    grid = in_slices(open_, sizes, "key", "row")
    grid = grid.select("cell", "salt", (F.col("salt") != F.col("other")).alias("cross"), "row", "n", "at", "label", "wide")
    grid = grid.repartition(partitions(many.sparkSession), "cell").sortWithinPartitions("cell", "label", "row")
    pairs = grid.mapInArrow(_by_group(_group_pairs(whole)), "a long, b long").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = stage(pairs, "near-open-pairs")
    release(rest)
    return pairs


def index_links(sets: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) rows of sets (row, fingerprint) with fingerprints that span linked ones, by the index."""
    values = stage(sets.groupBy("fingerprint").agg(F.min("row").alias("least"), F.count("*").alias("n")), "near-values")
    found = links(values.select("fingerprint"), radius)
    for side in "ab":
        found = found.join(values.select(F.col("fingerprint").alias(side), F.col("least").alias(f"row_{side}")), side)
    same = sets.select("row", "fingerprint").join(values.where("n > 1"), "fingerprint").where("row <> least")
    return found.select(F.col("row_a").alias("a"), F.col("row_b").alias("b")).unionByName(same.select(F.col("row").alias("a"), F.col("least").alias("b")))


def _possible(batches: Iterable) -> Iterator:
    """mapInArrow: (a, b, n_a, n_b, wide_a, wide_b) to the (a, b) that may be near copies by their parities."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        if not batch.num_rows:
            continue
        n_a, n_b = (batch.column(k).to_numpy().astype(np.int64) for k in (2, 3))
        x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(-1, CLASSES // 64) for k in (4, 5))
        at = pa.array(np.flatnonzero(_parities_allow(x ^ y, n_a + n_b)))
        yield pa.RecordBatch.from_pydict({"a": batch.column(0).take(at), "b": batch.column(1).take(at)})


def _verified(batches: Iterable) -> Iterator:
    """mapInArrow: (b, salt, member, row, text), each b's own text before its members', to the links (a, b)."""
    import pyarrow as pa

    mine, own = None, None
    for batch in batches:
        for low in range(0, batch.num_rows, 200):
            part = batch.slice(low, 200)
            found = []
            for b, member, row, text in zip(*(part.column(k).to_pylist() for k in (0, 2, 3, 4))):
                if not member:
                    mine, own = b, shingles(text)
                elif mine != b:
                    raise ValueError(f"the text of row {b} is missing")
                elif _similarity(own, shingles(text)) >= SIMILARITY:
                    found.append((row, b))
            yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def _links_on_texts(docs: DataFrame, sets: DataFrame, pairs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(a, b), a > b: the different pairs of rows, without known ones, that are near copies by their whole texts. A text
    goes once to each task that holds others against it, and once for each pair in which it is held against one."""

    def ordered(p: DataFrame) -> DataFrame:
        return p.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))

    spark = docs.sparkSession
    pairs = ordered(pairs).distinct()
    pairs = pairs.join(ordered(known), ["a", "b"], "left_anti") if known is not None else pairs
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("row").alias(side), F.col("n").alias(f"n_{side}"), F.col("wide").alias(f"wide_{side}")), side)
    pairs = stage(pairs.select("a", "b", "n_a", "n_b", "wide_a", "wide_b").mapInArrow(_possible, "a long, b long"), "near-pairs")
    sizes = pairs.groupBy("b").agg(F.ceil(F.count("*") / MEMBERS).alias("salts"))
    salted = pairs.join(sizes, "b").select("a", "b", F.pmod(F.xxhash64("a"), "salts").alias("salt"))
    held = salted.select("b", "salt", F.lit(True).alias("member"), F.col("a").alias("row"))
    own = sizes.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("member"), F.col("b").alias("row"))
    texts = held.unionByName(own).join(docs, "row").select("b", "salt", "member", "row", "text")
    texts = texts.repartition(partitions(spark), "b", "salt").sortWithinPartitions("b", "salt", "member")
    out = stage(texts.mapInArrow(_verified, "a long, b long"), "near-links")
    release(pairs)
    return out


def near_deduplicate(docs: DataFrame) -> DataFrame:
    """Documents without those that are near copies of an earlier row linked to them: the row with the least doc_id of
    each component stays, of equal ones the first. docs must come from a written table, whose rows are numbered by where
    they stand in its files."""
    numbered = docs.withColumn("__el_row", F.monotonically_increasing_id())
    parts = stage(near_components(numbered.select(F.col("__el_row").alias("row"), "text")), "near-components")
    of = parts.join(numbered.select(F.col("__el_row").alias("row"), "doc_id"), "row")
    stays = of.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    goes = of.select("component", "row").join(stays, "component").where("row <> first.row").select(F.col("row").alias("__el_row"))
    return numbered.join(goes, "__el_row", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
