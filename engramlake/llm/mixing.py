"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Each source's documents stand in shuffled order (by a hash of their id) as one stream of words, cut into blocks of
equally many words. Each source has as many slots as blocks make its target. The schedule has all sources' slots: slot n
of N has the point (n * g mod N) / N, g being the number next to N divided by the golden ratio that has no divisor in
common with N, so each of the N points comes once (a golden-ratio lattice), and the cumulative slots map a point to a
source. A source's slots are ranked; rank k takes block k of its stream, from the start again after the last, and the
last one ends where the target is met. A document's words taken are those of its blocks, and it comes first in the slot of
the block that it begins in; the mix as documents is in the order of these slots.

Nothing is ranked or summed in one task: streams are summed by (source, slice of the hash), slots are ranked by
(source, stretch of the schedule), and only the totals of slices and stretches by source. Points find their source by
an equi-join on cells of the cumulative slots. The joins with the table of sources are Spark's to broadcast, by its size.

Null texts have size 0. A null source is one of its own, last in order. Documents of size 0 and of sources without
words get taken 0. Null and repeated ids and repeated rows are documents like any others. An empty table gives no rows.
Columns besides doc_id, source and text are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from engramlake.session import partitions, stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, CAP = (5, 2, 1), 3
BLOCK = 256  # words
SLICE_BITS = 12  # of the hash: slices of a source's stream
STRETCH = 1 << 16  # slots
CELLS = 1 << 12  # of the cumulative slots
GOLDEN = (5**0.5 - 1) / 2


def step(n: int) -> int:
    """The number next to n * GOLDEN, from below on a tie, that has no divisor in common with n."""
    from math import gcd

    near = int(n * GOLDEN)
    return next((g for d in range(n + 1) for g in (near - d, near + d) if g > 0 and gcd(g, n) == 1), 1)


def order_key(doc_id: Column, seed: int) -> Column:
    """60 bits of a hash of the id."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per source of (source, source_size): rank, target. Levels are filled by weight up to cap times the size."""
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    s = sizes.withColumn("rank", rank)
    s = s.withColumn("weight", F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    s = s.withColumn("most", F.col("source_size") * cap).withColumn("total", F.sum("source_size").over(W.partitionBy()))
    by = W.orderBy((F.col("most") / F.col("weight")).asc(), "rank")
    s = s.withColumn("below", F.coalesce(F.sum("most").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("rest", F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing))).withColumn("place", F.row_number().over(by))
    fits = F.col("most") * F.col("rest") >= F.col("weight") * (F.col("total") - F.col("below"))
    s = s.withColumn("level", F.min(F.when(fits, F.struct("place", "below", "rest"))).over(W.partitionBy()))
    share = (F.col("weight") * (F.col("total") - F.col("level.below"))).cast("double") / F.col("level.rest").cast("double")
    return s.select("source", "rank", "source_size", F.when(F.col("place") < F.col("level.place"), F.col("most").cast("double")).otherwise(share).alias("target"))


def schedule(plan: DataFrame) -> DataFrame:
    """(rank, slot, place): which source takes its place-th block in which slot. plan: (rank, slots)."""
    spark = plan.sparkSession
    n = int(plan.agg(F.sum("slots")).first()[0] or 0)
    cell = max(1, -(-n // CELLS))
    to = F.sum("slots").over(W.orderBy("rank"))
    cuts = plan.where("slots > 0").select("rank", (to - F.col("slots")).alias("low"), to.alias("high"))
    cells = cuts.withColumn("cell", F.explode(F.sequence(F.expr(f"low div {cell}"), F.expr(f"(high - 1) div {cell}"))))
    # Of 38 digits, as the product may be beyond 64 bits.
    point = F.expr(f"cast((cast(id as decimal(18, 0)) * cast({step(n)} as decimal(18, 0))) % cast({max(n, 1)} as decimal(18, 0)) as bigint)")
    points = spark.range(0, n, 1, max(partitions(spark), -(-n // STRETCH // 4))).select(F.col("id").alias("slot"), point.alias("point"))
    slots = points.withColumn("cell", F.expr(f"point div {cell}")).join(cells, "cell").where("point >= low and point < high").select("rank", "slot", F.floor(F.col("slot") / STRETCH).alias("stretch"))
    slots = stage(slots, "mix-slots")
    counts = slots.groupBy("rank", "stretch").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("rank").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(W.partitionBy("rank", "stretch").orderBy("slot")) - 1
    return slots.withColumn("within", within).join(before.drop("n"), ["rank", "stretch"]).select("rank", "slot", (F.col("before") + F.col("within")).alias("place"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, block: int = BLOCK, seed: int = 1, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot (null: none), slots (those of the block that the document begins
    in), and the columns in keep, one row for each of docs."""
    source = F.col("source")
    named = F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    rows = stage(docs.select("doc_id", source.alias("source"), named.alias("_name"), size.alias("size"), order_key(F.col("doc_id"), seed).alias("_key"), *keep), "mix-sizes")
    sizes = rows.groupBy("_name", "source").agg(F.sum("size").alias("source_size"))
    t = targets(sizes.select("source", "source_size"), weights, cap)
    full = F.col("source_size")
    words = F.floor("target")
    t = t.withColumn("words", words).withColumn("rounds", F.when(full > 0, F.floor(words / full)).otherwise(0)).withColumn("rest", words - F.col("rounds") * full)
    t = t.withColumn("blocks", F.ceil(full / block)).withColumn("slots", F.col("rounds") * F.col("blocks") + F.ceil(F.col("rest") / block))
    plan = stage(t.withColumn("_name", F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source")))).drop("source"), "mix-plan")

    # Where each document stands in its source's stream.
    d = rows.join(plan.select("_name", "rank", "source_size", "target"), "_name").drop("_name", "source").withColumn("_slice", F.shiftright("_key", 60 - SLICE_BITS))
    d = d.withColumn("_within", F.coalesce(F.sum("size").over(W.partitionBy("rank", "_slice").orderBy("_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    slices = d.groupBy("rank", "_slice").agg(F.sum("size").alias("_n"))
    slices = slices.select("rank", "_slice", F.coalesce(F.sum("_n").over(W.partitionBy("rank").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    d = stage(d.join(slices, ["rank", "_slice"]).withColumn("_at", F.col("_before") + F.col("_within")).drop("_slice", "_before", "_within", "_key"), "mix-streams")

    # What the schedule takes of each block: whole rounds, and up to which word in the last one.
    taken = schedule(plan.select("rank", "slots")).join(plan.select("rank", "blocks", "rounds", "rest"), "rank")
    taken = taken.select("rank", "slot", (F.col("place") % F.col("blocks")).alias("block"), F.floor(F.col("place") / F.col("blocks")).alias("round"), "rounds", "rest")
    part = F.when(F.col("round") >= F.col("rounds"), F.least((F.col("block") + 1) * block, F.col("rest")))
    taken = taken.groupBy("rank", "block").agg(F.sum((F.col("round") < F.col("rounds")).cast("long")).alias("whole"), F.max(part).alias("upto"), F.sort_array(F.collect_list("slot")).alias("slots"))  # cap slots at most

    keys = ["rank", "_at", "doc_id", "size", "source_size", "target", *keep]
    pieces = d.where("size > 0").select(*keys, F.explode(F.sequence(F.floor(F.col("_at") / block), F.floor((F.col("_at") + F.col("size") - 1) / block))).alias("block"))
    low, high = F.greatest(F.col("_at"), F.col("block") * block), F.least(F.col("_at") + F.col("size"), (F.col("block") + 1) * block)
    words = F.col("whole") * (high - low) + F.greatest(F.lit(0), F.least(high, F.coalesce("upto", F.lit(0))) - low)
    some = pieces.join(taken, ["rank", "block"]).select("rank", "_at", "block", "slots", words.alias("_words")).groupBy("rank", "_at").agg(F.sum("_words").alias("taken"), F.min_by("slots", "block").alias("slots"))
    out = ["doc_id", "size", "source_size", "target", "taken", "first_slot", "slots", *keep]
    has = d.where("size > 0").join(some, ["rank", "_at"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    has = has.withColumn("first_slot", F.when(F.col("taken") > 0, F.get("slots", F.lit(0))))
    none = d.where("size = 0").withColumn("taken", F.lit(0).cast("long")).withColumn("first_slot", F.lit(None).cast("long")).withColumn("slots", F.lit(None).cast("array<long>"))
    return has.select(*out).unionByName(none.select(*out))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """Documents as often as the mix takes them, in the order of the slots in which they begin: whole rounds, and once more
    where it takes half of the rest or more. docs must come from a written table, whose rows are numbered by where they
    stand in its files."""
    numbered = docs.withColumn("__el_row", F.monotonically_increasing_id())
    m = mix(numbered, keep=("__el_row",), **options)
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    times = m.select("__el_row", F.slice("slots", F.lit(1), times).alias("__el_slots"))
    copies = numbered.join(times.where(F.size("__el_slots") > 0), "__el_row").withColumn("__el_slot", F.explode("__el_slots"))
    ordered = copies.repartitionByRange(partitions(docs.sparkSession), "__el_slot", "__el_row").sortWithinPartitions("__el_slot", "__el_row")
    return ordered.select(*(F.col(f"`{c}`") for c in docs.columns))


ORACLE = f"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':1'), 1, 15))::bigint as k from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [5, 2, 1][((row_number() over (order by source asc nulls last) - 1) % 3 + 1)::int]::bigint as weight, (3 * source_size)::bigint as most,
    row_number() over (order by source asc nulls last) as rank, (sum(source_size) over ())::bigint as total from s),
o as (select *, row_number() over (order by most::double / weight, rank) as place,
    coalesce(sum(most) over (order by most::double / weight, rank rows between unbounded preceding and 1 preceding), 0)::bigint as below,
    (sum(weight) over (order by most::double / weight, rank rows between current row and unbounded following))::bigint as rest from w),
f as (select place as lplace, below as lbelow, rest as lrest from o where most * rest >= weight * (total - below) order by place limit 1),
t as (select source, source_size, case when place < lplace then most::double else (weight * (total - lbelow))::double / lrest::double end as target from o, f),
p as (select d.doc_id, d.size, d.source, t.source_size, t.target, floor(t.target)::bigint as words,
    coalesce(sum(d.size) over (partition by d.source order by d.k, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0)::bigint as pos
    from d join t on d.source is not distinct from t.source),
b as (select t.source, w.rank, case when source_size = 0 then 0 else floor(t.target)::bigint // t.source_size * ((t.source_size + {BLOCK - 1}) // {BLOCK}) + (floor(t.target)::bigint % t.source_size + {BLOCK - 1}) // {BLOCK} end as slots
    from (select source, source_size, target from t) t join (select source, rank from w) w on t.source is not distinct from w.source),
c as (select *, sum(slots) over (order by rank) as high from b),
n as (select sum(slots)::bigint as n from b),
g as (select n, list_filter(flatten(list_transform(range(0, 1000), lambda d: [floor(n * {GOLDEN!r}::double)::bigint - d, floor(n * {GOLDEN!r}::double)::bigint + d])), lambda g: g > 0 and gcd(g, n) = 1)[1] as g from n),
l as (select i as slot, (i * g)::hugeint % n as point from g, unnest(range(0, n)) as u(i)),
k as (select c.source, slot, row_number() over (partition by rank order by slot) - 1 as place from l join c on point >= high - slots and point < high),
r as (select p.*, (case when size = 0 then 0 else (words // source_size) * size + greatest(0, least(pos + size, words % source_size) - pos) end)::bigint as taken from p)
select doc_id, size, source_size, target, taken, case when taken > 0 then slot end as first_slot
  from r left join k on k.source is not distinct from r.source and k.place = r.pos // {BLOCK}"""
