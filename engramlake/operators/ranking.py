"""Fused keyword and vector recall, re-weighting, re-scoring, selection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window as W, functions as F

from engramlake.functions import decay, text, vector
from engramlake.session import release, stage

RRF_K = 60


def filter_meta(chunks: DataFrame, type: str | None = None, status: str | None = None, tag: str | None = None) -> DataFrame:
    """Before any ranking, so that ranks are those within what is left."""
    for name, value in (("type", type), ("status", status)):
        chunks = chunks if value is None else chunks.where(F.col(name) == value)
    return chunks if tag is None else chunks.where(F.array_contains("tags", tag))


def scored(chunks: DataFrame, query: str | None, vec: list[float] | None, stop=text.RECALL_STOP, path_bonus: bool = True, digits: int = 6) -> DataFrame:
    """chunks with sem (null without a vector) and kw."""
    words = text.terms(F.lit(query or ""), list(stop))
    kw = text.keyword_score(F.col("text"), words, F.coalesce("rel", F.lit("")) if path_bonus else None)
    sem = F.round(vector.cosine(F.col("vector"), F.array(*map(F.lit, vec))), digits) if vec else F.lit(None).cast("double")
    return chunks.withColumn("sem", sem).withColumn("kw", F.when(F.lit(bool(query)), kw).otherwise(0))


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Adds name, each row's place (from 0) in the order over all rows, without one task that sorts them all.

    Rows are dealt by ranges and written, so that the dealing stays as it was; each range is numbered for itself, after
    the sizes of the ranges before it, which are as few as partitions."""
    dealt = stage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_size"))
    before = sizes.select("_range", (F.sum("_size").over(W.orderBy("_range")) - F.col("_size")).alias("_before"))
    place = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    return dealt.join(F.broadcast(before), "_range").withColumn(name, (F.col("_before") + place).cast("long")).drop("_range", "_before")


def rrf(df: DataFrame, k0: int = RRF_K) -> DataFrame:
    """Adds sem_rank, kw_rank (from 0; null where a row isn't in a list) and rrf.

    Keyword hits alone are ranked by keyword; ties go by ord."""
    out = numbered(df.select("ord", "sem", "kw"), [F.desc_nulls_last("sem"), F.asc("ord")], "sem_rank")
    hit = F.when(F.col("kw") > 0, F.col("kw"))
    out = numbered(out, [F.desc_nulls_last(hit), F.asc("ord")], "kw_rank")
    ranks = out.select("ord", F.when(F.col("sem").isNotNull(), F.col("sem_rank")).alias("sem_rank"), F.when(F.col("kw") > 0, F.col("kw_rank")).alias("kw_rank"))
    part = lambda r: F.coalesce(1 / (k0 + F.col(r)), F.lit(0.0))
    return df.join(ranks, "ord").withColumn("rrf", part("sem_rank") + part("kw_rank"))


def safe_depth(k: int) -> int:
    """How many rows of each list are enough for the best k of both, with weights from 0.3 to 1.5."""
    return 531 + 10 * k


def _ranks_of(rows: DataFrame, few: DataFrame, value: str) -> DataFrame:
    """(ord, rank) of few rows by value, the largest first, ties by ord, among all rows; few (ord, value) is of bounded size.

    Few's places are one sorted array in pieces, each row finds by two short scans how many of few are ahead of it, and
    rows are counted by that number; so a row adds one to a partial count, whatever the number of few."""
    piece = 32
    at = lambda v: F.struct((-F.col(v)).alias("v"), F.col("ord").alias("o"))
    sorted_ = few.where(F.col(value).isNotNull()).agg(F.array_sort(F.collect_list(at(value))).alias("all"))
    pieces = F.when(F.size("all") > 0, F.transform(F.sequence(F.lit(0), F.size("all") - 1, F.lit(piece)), lambda i: F.slice("all", i + 1, F.lit(piece))))
    places = sorted_.select(pieces.alias("pieces"))
    placed = rows.where(F.col(value).isNotNull()).select(at(value).alias("own"), places.scalar().alias("pieces"))
    placed = placed.withColumn("n", F.size(F.filter("pieces", lambda p: p[0] < F.col("own"))))
    ahead = F.when(F.col("n") == 0, 0).otherwise((F.col("n") - 1) * piece + F.size(F.filter(F.get("pieces", F.col("n") - 1), lambda x: x < F.col("own"))))
    counts = placed.select(ahead.alias("ahead")).groupBy("ahead").agg(F.count("*").alias("n"))  # as many rows as few, and one
    upto = counts.select("ahead", (F.sum("n").over(W.orderBy("ahead")) - 1).alias("rank"))
    return sorted_.select(F.posexplode("all").alias("ahead", "x")).join(upto, "ahead").select(F.col("x.o").alias("ord"), "rank")


def pool_size(k: int | None, override: int | None = None) -> int:
    """How many neighbours a nearest-neighbour index is asked for where k are shown; never fewer. Recall here ranks all rows
    and needs no pool: this is for callers with an index of their own."""
    shown = int(k) if k and k > 0 else 8
    return max(shown, int(override)) if override and override > 0 else max(shown, 25 * shown, 400)


def rrf_top(df: DataFrame, k: int, k0: int = RRF_K) -> DataFrame:
    """rrf() of the rows that can be among the best k, without ranking all rows in one task.

    The best rows of each list are found by a limit (partial in each task); each survivor's true rank in the other list
    is the number of rows before it, counted in one pass."""
    m = safe_depth(k)
    slim = stage(df.select("ord", "sem", "kw"), "scored")  # texts and vectors are scored once
    slim = slim.select("ord", "sem", F.when(F.col("kw") > 0, F.col("kw")).alias("kw"))
    top = slim.where("sem is not null").orderBy(F.desc("sem"), "ord").limit(m).select("ord").union(slim.where("kw is not null").orderBy(F.desc("kw"), "ord").limit(m).select("ord")).distinct()
    marks = stage(slim.join(F.broadcast(top), "ord", "left_semi"), "survivors")  # at most 2 * m rows
    ranks = marks.select("ord")
    for value, name in (("sem", "sem_rank"), ("kw", "kw_rank")):
        ranks = ranks.join(_ranks_of(slim, marks, value).withColumnRenamed("rank", name), "ord", "left")
    out = df.join(F.broadcast(ranks), "ord")
    part = lambda r: F.coalesce(1 / (k0 + F.col(r)), F.lit(0.0))
    return out.withColumn("rrf", part("sem_rank") + part("kw_rank"))


def with_decay(df: DataFrame, entries: DataFrame | None, now_ms: int) -> DataFrame:
    """Adds factor and score; entries: (rel, access, last_access_ms, importance). Without entries the factor is 1."""
    if entries is None:
        return df.withColumn("factor", F.lit(1.0)).withColumn("score", F.col("rrf"))
    e = entries.select("rel", F.col("access").alias("_a"), F.col("last_access_ms").alias("_l"), F.col("importance").alias("_i"))
    out = df.join(e, "rel", "left").withColumn("factor", decay.decay_factor(F.col("_a"), F.col("_l"), F.col("_i"), now_ms))
    return out.withColumn("score", F.col("rrf") * F.col("factor")).drop("_a", "_l", "_i")


def recall(chunks: DataFrame, query: str | None = None, vec: list[float] | None = None, k: int = 8, entries: DataFrame | None = None, now_ms: int = 0, scorer: Callable | None = None, head: int = 50, stop=text.RECALL_STOP, path_bonus: bool = True, **filters) -> DataFrame:
    """The best k chunks by fused ranks, re-weighted by usage and optionally re-scored (scorer: text Column to score)."""
    if not isinstance(k, int):
        raise TypeError("k is a whole number")
    rows = scored(filter_meta(chunks, **filters), query, vec, stop, path_bonus)
    fused = rrf_top(rows if vec else rows.where("kw > 0"), max(k, head if scorer else 0))
    out = with_decay(fused.where("rrf > 0"), entries, now_ms)
    order = [F.desc("score"), F.desc("rrf"), F.asc("ord")]
    if scorer is None:
        return out.orderBy(*order).limit(k)
    few = out.orderBy(*order).limit(max(k, head)).withColumn("pos", F.row_number().over(W.orderBy(*order)) - 1)
    return two_stage_rerank(few.withColumn("rerank", scorer(F.col("text"))), head).orderBy("final").limit(k)


def two_stage_rerank(df: DataFrame, head: int = 50) -> DataFrame:
    """Adds final (from 0): the first `head` rows (by pos) by their rerank score, the others as they were.

    Ties go by pos; scores that aren't numbers come last in the head; with any score missing there, nothing moves."""
    in_head = F.col("pos") < head
    whole = F.min(F.when(in_head, F.col("rerank").isNotNull())).over(W.partitionBy())
    value = F.when(F.isnan("rerank"), F.lit(float("-inf"))).otherwise(F.col("rerank"))
    moved = F.row_number().over(W.partitionBy(in_head).orderBy(F.desc("_v"), "pos")) - 1
    return df.withColumn("_v", value).withColumn("final", F.when(in_head & whole, moved).otherwise(F.col("pos")).cast("long")).drop("_v")


def scan_cap(edges: DataFrame, cap: int = 8, used: DataFrame | None = None) -> DataFrame:
    """degree_cap() by one task, for edges of bounded number."""
    cols = edges.columns
    places = used.select("n", F.col("used").cast("int").alias("used")) if used is not None else None
    for end in ("a", "b"):
        edges = edges.withColumn(f"_{end}", F.lit(0)) if places is None else edges.join(places.select(F.col("n").alias(end), F.col("used").alias(f"_{end}")), end, "left")

    def scan(pdf):
        import numpy as np

        pdf = pdf.sort_values(["weight", "a", "b"], ascending=[False, True, True], ignore_index=True)
        names, ends = np.unique(np.r_[pdf["a"].to_numpy(), pdf["b"].to_numpy()], return_inverse=True)
        m, degree = len(pdf), np.zeros(len(names), np.int64)
        degree[ends] = np.nan_to_num(np.r_[pdf["_a"].to_numpy(float), pdf["_b"].to_numpy(float)]).astype(np.int64)
        degree, keep = degree.tolist(), []
        for k, (x, y) in enumerate(zip(ends[:m].tolist(), ends[m:].tolist())):
            if degree[x] < cap and degree[y] < cap:
                degree[x] += 1
                degree[y] += 1
                keep.append(k)
        return pdf.iloc[keep][cols]

    shape = ", ".join(f"{c} {kind}" for c, kind in edges.select(*cols).dtypes)
    return edges.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(scan, shape)


def degree_cap(edges: DataFrame, cap: int = 8, max_rounds: int = 200, used: DataFrame | None = None) -> DataFrame:
    """The edges (a, b, weight) that a scan from the strongest keeps while both ends have fewer than cap; used: (n, used) of
    nodes that have some places taken.

    In rounds: an undecided edge that is within both ends' free places, among their undecided ones, is kept; edges at
    a full end go. The strongest undecided edge is always kept, so this ends."""
    cols, order = edges.columns, [F.desc("weight"), F.asc("a"), F.asc("b")]
    kept, before, open_ = None, used, stage(edges, "cap-open")
    for _ in range(max_rounds):
        if kept is not None:
            ends = kept.select(F.explode(F.array("a", "b")).alias("n"), F.lit(1).cast("long").alias("used"))
            used = (ends if before is None else ends.unionByName(before.select("n", "used"))).groupBy("n").agg(F.sum("used").alias("used"))
        ends = open_.select(F.explode(F.array("a", "b")).alias("n"), "a", "b", "weight").withColumn("place", F.row_number().over(W.partitionBy("n").orderBy(*order)))
        ends = ends.join(used, "n", "left") if used is not None else ends.withColumn("used", F.lit(0))
        ends = ends.withColumn("used", F.coalesce("used", F.lit(0)))
        state = ends.groupBy("a", "b").agg(F.max(F.col("place") + F.col("used")).alias("_need"), F.max("used").alias("_used"))
        now = open_.join(state, ["a", "b"]).where(F.col("_used") < cap)
        now = stage(now, "cap-round")
        new = now.where(F.col("_need") <= cap).select(*cols)
        kept = new if kept is None else kept.unionByName(new)  # parts of written rounds
        open_ = now.where(F.col("_need") > cap).select(*cols)
        if not open_.limit(1).count():
            return kept
    raise RuntimeError("the degree cap did not settle")


def mmr(candidates: DataFrame, k: int = 8, penalty: float = 0.5, most: int = 100_000) -> DataFrame:
    """Per seed: k candidates (seed, id, rel, vector) by relevance less penalty times the most similarity to those
    taken, negative similarity as 0; ties by relevance, then id. Adds redundancy, mmr and pos (from 0).

    A seed's candidates are held against each other by one task where they are at most `most` vectors of one size; seeds of
    more take passes over spread candidates."""
    pool = stage(candidates.select("seed", "id", F.col("rel").cast("double").alias("rel"), F.col("vector").cast("array<double>").alias("vector")), "mmr")
    size = F.size("vector")
    plain = (F.count("*") <= most) & (F.count("rel") == F.count("*")) & ~F.max(F.isnan("rel")) & (F.count("vector") == F.count("*")) & (F.min(size) == F.max(size))
    other = stage(pool.groupBy("seed").agg(plain.alias("plain")).where(~F.coalesce("plain", F.lit(False))).select("seed"), "mmr-seeds")

    def choose(pdf):
        import numpy as np

        v = np.array(pdf["vector"].tolist(), float).reshape(len(pdf), -1)
        rel, id, near, open_ = pdf["rel"].to_numpy(float), pdf["id"].to_numpy(), np.zeros(len(pdf)), np.ones(len(pdf), bool)
        norm, rows = np.sqrt((v * v).sum(axis=1)), []
        for pos in range(min(k, len(pdf))):
            score = np.where(open_, np.round(rel - penalty * near, 12), -np.inf)
            at = np.nonzero(score == score.max())[0]
            at = at[rel[at] == rel[at].max()]
            one = at[np.argmin(id[at])]
            rows.append((one, near[one], score[one], pos))
            open_[one] = False
            with np.errstate(all="ignore"):
                both = norm * norm[one]
                near = np.maximum(near, np.nan_to_num(v @ v[one] / np.where(both == 0, 1, both)))
        at, redundancy, score, pos = zip(*rows)
        return pdf.iloc[list(at)][["seed", "id", "rel"]].assign(redundancy=redundancy, mmr=score, pos=pos)

    kinds = dict(pool.dtypes)
    shape = f"seed {kinds['seed']}, id {kinds['id']}, rel double, redundancy double, mmr double, pos long"
    out = stage(pool.join(other, "seed", "left_anti").groupBy("seed").applyInPandas(choose, shape), "mmr-chosen")
    if other.limit(1).count():
        out = out.unionByName(_mmr_in_passes(pool.join(other, "seed", "left_semi"), k, penalty))
    release(pool)
    return out


def _mmr_in_passes(pool: DataFrame, k: int, penalty: float) -> DataFrame:
    """mmr() in one pass over the candidates for each place: every one is held against what its seed has taken, and the best
    are found by partial aggregates, so a seed's candidates may be spread over any number of tasks."""
    taken = None
    for pos in range(k):
        rows, near = pool, F.lit(0.0)
        if taken is not None:
            rows = pool.join(taken, "seed").where(~F.exists("picked", lambda p: p["id"] == F.col("id")))
            near = F.greatest(F.lit(0.0), F.array_max(F.transform("picked", lambda p: F.coalesce(vector.cosine(F.col("vector"), p["vector"]), F.lit(0.0)))))
        rows = rows.withColumn("redundancy", near).withColumn("mmr", F.round(F.col("rel") - penalty * F.col("redundancy"), 12))
        order = F.struct((-F.col("mmr")).alias("m"), (-F.col("rel")).alias("r"), "id")
        best = rows.groupBy("seed").agg(F.min_by(F.struct("id", "rel", "redundancy", "mmr", F.lit(pos).cast("long").alias("pos"), "vector"), order).alias("best"))
        if taken is None:
            new = best.select("seed", F.array("best").alias("picked"))
        else:
            new = taken.join(best, "seed", "left").select("seed", F.when(F.col("best").isNull(), F.col("picked")).otherwise(F.array_append("picked", F.col("best"))).alias("picked"))
        new = stage(new, "mmr-taken")
        if taken is not None:
            release(taken)
        taken = new
    return taken.select("seed", F.explode("picked").alias("p")).select("seed", "p.id", "p.rel", "p.redundancy", "p.mmr", "p.pos")
