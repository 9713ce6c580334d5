"""Document fingerprints by locally consistent parsing.

A text's code points are cut into phrases by deterministic coin tossing: each symbol is labelled by the lowest bit in
which it differs from the one before, three times over, until few labels are left; phrases begin where a label is a
local maximum (runs of a symbol are one symbol first). So where a phrase begins depends on a few symbols around it
alone, and equal substrings are cut alike inside, wherever they stand. A phrase is named by a hash of its symbols; the
names are the next level's symbols. A fingerprint holds, for each level, the least of the phrases' hashed names; the
likeness of two is the estimated Jaccard similarity of their phrases, of the highest level that both have enough of.

Texts of a batch are parsed together, level by level, by array operations; no phrase crosses from one text to another.
For edited texts, documents are dealt by ranges of doc_id and sorted; the first document of a range also goes to the
range before it, where it follows the last one.

Null and empty texts have no phrases; two of them are alike (1), one and any other text are not (0). A null doc_id
comes last; of repeated ids the lesser text comes first. A single document follows itself. An empty table gives no
rows. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from engramlake.session import partitions

#: By level from 1: how many names a fingerprint holds; how many make a level fit to compare.
HELD, ENOUGH = (8, 16, 64), 8
ROUNDS = 3
CHUNK = 600_000  # code points that are parsed together, at least
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _mix(x):
    """A bijection of 64-bit numbers that spreads every bit (fixed odd numbers)."""
    import numpy as np

    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def labels(symbols, first):
    """Coin tossing: neighbours of a text, which differ, get differing labels that are small after ROUNDS rounds."""
    import numpy as np

    x = symbols
    for _ in range(ROUNDS):
        before = np.empty_like(x)
        before[0], before[1:] = 0, x[:-1]
        differ = x ^ before
        bit = np.bitwise_count(~differ & (differ - x.dtype.type(1))).astype(x.dtype)  # zeros below the lowest one
        x = 2 * bit + ((x >> np.minimum(bit, x.dtype.type(63 if x.itemsize == 8 else 7))) & x.dtype.type(1))
        x[first] = 0
        x = x.astype(np.uint8)
    return x


def parse(symbols, first):
    """Names of the phrases, and which are the first of their text."""
    import numpy as np

    begins = first.copy()
    begins[1:] |= symbols[1:] != symbols[:-1]
    at = np.flatnonzero(begins)
    if len(at) < len(symbols):
        runs = np.diff(np.r_[at, len(symbols)]).astype(np.uint64)
        symbols, first = symbols[at], first[at]
        symbols = np.where(runs > 1, _mix(symbols + runs * np.uint64(0x9E3779B97F4A7C15)), symbols)
    x = labels(symbols, first)
    peak = first.copy()
    peak[1:-1] |= (x[1:-1] > x[:-2]) & (x[1:-1] >= x[2:]) & ~first[2:]
    at = np.flatnonzero(peak)
    offset = np.arange(len(symbols)) - np.repeat(at, np.diff(np.r_[at, len(symbols)]))
    names = np.add.reduceat(_mix(symbols + np.uint64(1)) * _powers(int(offset.max()) + 1)[offset], at)
    return _mix(names), first[at]


def _powers(n: int):
    import numpy as np

    return np.cumprod(np.r_[np.uint64(1), np.full(n - 1, np.uint64(0x9E3779B97F4A7C15))], dtype=np.uint64)


def sketches(texts: Sequence[str]) -> list[tuple[tuple[int, ...], ...]]:
    """By text and level: the least hashed names (32 bits), in order."""
    import numpy as np

    sizes = np.array([len(t) for t in texts])
    out: list[list[tuple[int, ...]]] = [[] for _ in texts]
    symbols = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.uint64)
    has = np.flatnonzero(sizes)
    first = np.zeros(len(symbols), bool)
    first[(np.cumsum(sizes) - sizes)[has]] = True
    for held in HELD:
        if len(symbols):
            symbols, first = parse(symbols, first)
            of = has[np.cumsum(first) - 1].astype(np.uint64)
            least = np.unique((of << np.uint64(32)) | (symbols >> np.uint64(32)))
            of = (least >> np.uint64(32)).astype(np.int64)
            starts = np.searchsorted(of, np.arange(len(texts) + 1))
            values = (least & np.uint64(0xFFFFFFFF)).tolist()
        for k, own in enumerate(out):
            own.append(tuple(values[starts[k] : min(starts[k] + held, starts[k + 1])]) if sizes[k] else ())
    return [tuple(x) for x in out]


def written(sketch: tuple[tuple[int, ...], ...]) -> str:
    """Levels parted by points, names in 8 hex digits each."""
    return ".".join("".join(f"{x:08x}" for x in level) for level in sketch)


def read(fingerprint: str) -> tuple[tuple[int, ...], ...]:
    return tuple(tuple(int(x[k : k + 8], 16) for k in range(0, len(x), 8)) for x in fingerprint.split("."))


def likeness(a: tuple[tuple[int, ...], ...], b: tuple[tuple[int, ...], ...]) -> float:
    if a == b:
        return 1.0
    level = next((k for k in range(len(HELD) - 1, 0, -1) if min(len(a[k]), len(b[k])) >= ENOUGH), 0)
    x, y = set(a[level]), set(b[level])
    if not x or not y:
        return float(not x and not y)
    union = sorted(x | y)[: HELD[level]]
    return sum(v in x and v in y for v in union) / len(union)


def edited(text: str, follower: str) -> str:
    """The last third replaced by as much of the next document's beginning."""
    n = len(text) // 3
    return text[: len(text) - n] + follower[:n]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every text."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "fingerprint": [written(s) for s in sketches([t or "" for t in part.column(1).to_pylist()])]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")


# --- texts and their followers -----------------------------------------------------------------------------------


def _ranges(docs: DataFrame, n: int) -> tuple[DataFrame, int]:
    """docs (doc_id, text) with _range from 0 (the largest ids) and _tail: rows of the range behind, whose first ones
    end a range. The bounds are some hundred numbers for each hundred ranges, however large the table is."""
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    bounds = sorted({int(x) for x in docs.select(key.cast("double").alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 0.1 / n)})
    step = max(1, round(len(bounds) ** 0.5))
    coarse = F.array(*(F.lit(b).cast("long") for b in bounds[::step])) if bounds else F.array().cast("array<long>")
    fine = F.array(*(F.array(*(F.lit(b).cast("long") for b in bounds[k : k + step])) for k in range(0, len(bounds), step))) if bounds else F.array().cast("array<array<long>>")
    d = docs.withColumn("_key", key).withColumn("_c", F.size(F.filter(coarse, lambda b: b < F.col("_key"))))
    below = F.when(F.col("_c") == 0, 0).otherwise((F.col("_c") - 1) * step + F.size(F.filter(F.get(fine, F.col("_c") - 1), lambda b: b < F.col("_key"))))
    d = d.withColumn("_range", (F.lit(len(bounds)) - below).cast("int")).drop("_c")
    tops = {r["_range"]: r["top"] for r in d.groupBy("_range").agg(F.max("_key").alias("top")).collect()}  # one row a range
    order = sorted(tops)
    before = {r: order[k - 1] for k, r in enumerate(order)}  # the first follows the last
    slots = range(len(bounds) + 1)
    top_of = F.array(*(F.lit(tops.get(r)).cast("long") for r in slots))
    before_of = F.array(*(F.lit(before.get(r)).cast("int") for r in slots))
    to = F.when(F.col("_key") == F.get(top_of, "_range"), F.array(F.struct(F.col("_range"), F.lit(False).alias("_tail")), F.struct(F.get(before_of, "_range").alias("_range"), F.lit(True).alias("_tail"))))
    return d.withColumn("_to", F.explode(F.coalesce(to, F.array(F.struct("_range", F.lit(False).alias("_tail")))))).select("doc_id", "text", "_key", "_to.*"), len(bounds) + 1


def _apart(spark: SparkSession, n: int) -> list[int]:
    """n numbers that go to n different tasks when rows are dealt by their hash."""
    ids = spark.range(0, 40 * n + 1000, 1, 1).groupBy(F.pmod(F.hash("id"), F.lit(n))).agg(F.min("id").alias("id"))
    found = [r["id"] for r in ids.collect()]  # n rows at most
    return (found * n)[:n]


def compare(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """RESULT for every document: its fingerprint, its edited text's, and the likeness of that and of the next one's."""

    def chunk(rows: list[tuple[int | None, str]], follower: str):
        import pyarrow as pa

        texts = [t for _, t in rows]
        changed = [edited(t, f) for t, f in zip(texts, [*texts[1:], follower])]
        found = sketches([*texts, follower, *changed])
        own, new = found[: len(texts) + 1], found[len(texts) + 1 :]
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array([i for i, _ in rows], pa.int64()), "n_chars": pa.array(map(len, texts), pa.int64()),
                "edited_sha256": [hashlib.sha256(c.encode()).hexdigest() for c in changed], "fingerprint": [written(s) for s in own[:-1]], "edited_fingerprint": [written(s) for s in new],
                "near_edited": [likeness(a, b) for a, b in zip(own, new)], "near_next": [likeness(a, b) for a, b in zip(own, own[1:])],
            }
        )

    def run(batches: Iterable) -> Iterator:
        rows: list[tuple[int | None, str]] = []
        size, current, ended = 0, None, True
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                for doc_id, text, no, tail in zip(*(c.to_pylist() for c in batch.slice(low, 200).columns)):
                    if no != current:
                        if not ended:
                            raise ValueError("a range has no follower")
                        rows, size, current, ended = [], 0, no, False
                    if ended:
                        continue  # other rows of the same id as the follower
                    if tail:
                        if rows:
                            yield chunk(rows, text)
                        rows, size, ended = [], 0, True
                        continue
                    if size >= CHUNK:
                        yield chunk(rows, text)
                        rows, size = [], 0
                    rows.append((doc_id, text))
                    size += len(text)
        if not ended:
            raise ValueError("a range has no follower")

    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = ranges or partitions(spark)
    dealt, n = _ranges(d, n)
    dealt = dealt.withColumn("_task", F.get(F.array(*(F.lit(i).cast("long") for i in _apart(spark, n))), "_range"))
    dealt = dealt.repartition(n, "_task").sortWithinPartitions("_range", "_tail", F.desc("_key"), "text")
    return dealt.select("doc_id", "text", "_range", "_tail").mapInArrow(run, RESULT)
