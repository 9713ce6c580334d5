"""Similarity joins: link graphs, near duplicates, reconciling, cross-links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from engramlake.functions import text as T
from engramlake.operators import ranking
from engramlake.session import release, stage

FLOOR, CEIL, WINDOW_DAYS, PER_NODE = 0.35, 0.85, 14.0, 8
HIGH, MID = 0.95, 0.85
BLOCK = 2048  # rows of a block of searches and all-pairs joins
STRIP = 256  # rows of a block that are multiplied at once
GRID, BATCH, STEPS = 6144, 1_000_000, 1000  # of capped links: rows of a block, links of a range of weights, ranges


def stable_id(*columns: str) -> Column:
    """The first of the columns that isn't null."""
    return F.coalesce(*(F.col(c).cast("string") for c in columns))


def time_ms(ms: Column, date: Column) -> Column:
    """Milliseconds: the number if there is one, else the date's midnight, else null."""
    return F.coalesce(ms, F.unix_millis(F.try_to_timestamp(date)))


def all_pairs(rows: DataFrame, least: float, id: str = "id", digits: int = 6, keep_days: float | None = None, block: int = 2 * BLOCK, top: int | None = None) -> DataFrame:
    """(a, b, sim, days, shared) with a < b for pairs with sim >= least, and where keep_days is given also those within
    so many days or with shared entities. rows: id, vector, optionally ms and entities.

    Rows fall into blocks; each pair of blocks is one matrix product in a task of its own. Rows without a vector
    are left out, and only vectors of one size are held against each other. top: only that many of the most similar pairs
    leave a pair of blocks, ties by a and b."""

    def best(out):
        return out if top is None else out.sort_values(["sim", "a", "b"], ascending=[False, True, True]).head(top)

    grid, kind = _grid(rows, id, block)
    out = grid.mapInPandas(_products(least, digits, keep_days, then=best), _pair(kind))
    return out.withColumn("days", F.nanvl("days", F.lit(None).cast("double")))


def _pair(kind: str) -> str:
    return f"a {kind}, b {kind}, sim double, days double, shared long"


def _blocks(rows: DataFrame, id: str = "id", block: int = BLOCK) -> DataFrame:
    """Rows with a vector in blocks, one row (own, rows) each, written once."""
    have = lambda c, kind: F.col(c) if c in rows.columns else F.lit(None).cast(kind)
    r = rows.where("vector is not null").select(F.col(id).alias("id"), F.col("vector").cast("array<double>").alias("vector"), have("ms", "long").alias("ms"), have("entities", "array<string>").alias("entities"))
    blocks = max(1, -(-rows.where("vector is not null").count() // block))
    r = r.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("own"), F.struct("id", "vector", "ms", "entities").alias("row"))
    return stage(r.repartitionByRange(blocks, "own").groupBy("own").agg(F.collect_list("row").alias("rows")), "blocks")


def _grid(rows: DataFrame, id: str = "id", block: int = BLOCK) -> tuple[DataFrame, str]:
    """The rows of each pair (i, j) of blocks, one pair after the other; the type of their ids."""
    blocks = _blocks(rows, id, block)
    return _crossed(blocks), blocks.schema["rows"].dataType.elementType["id"].dataType.simpleString()


def _crossed(blocks: DataFrame) -> DataFrame:
    """own, id, vector, ms, entities, i, j: each task reads the written blocks that it holds against each other, so that no row
    is shuffled or written for each of its pairs. A pair goes by the lower block or the higher one, so that tasks are alike."""
    x, y = blocks.select(F.col("own").alias("x"), F.col("rows").alias("xs")), blocks.select(F.col("own").alias("y"), F.col("rows").alias("ys"))
    once = (F.col("x") == F.col("y")) | (((F.col("x") + F.col("y")) % 2 == 0) == (F.col("x") < F.col("y")))
    own = lambda c, n: F.transform(c, lambda r: F.struct(F.col(n).alias("own"), r["id"].alias("id"), r["vector"].alias("vector"), r["ms"].alias("ms"), r["entities"].alias("entities")))
    both = F.when(F.col("x") == F.col("y"), own("xs", "x")).otherwise(F.concat(own("xs", "x"), own("ys", "y")))
    pairs = x.join(y.hint("shuffle_replicate_nl"), once).select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), both.alias("rows"))
    return pairs.select(F.inline("rows"), "i", "j")


def _products(least: float, digits: int, keep_days: float | None, then=None, some=None, tally=None):
    """A function of the rows of pairs of blocks: `then` of each one's pairs, strip by strip, so that no whole product is held.

    some: of (sim, days, shared), which pairs are wanted; the others' ids aren't looked up. tally: what each strip gives in
    place of its pairs."""

    def each(batches):
        import pandas as pd

        held, at = [], None
        for pdf in batches:
            for key, rows in pdf.groupby(["i", "j"], sort=False):
                if held and key != at:
                    yield product(pd.concat(held, ignore_index=True))
                    held = []
                held.append(rows)
                at = key
        if held:
            yield product(pd.concat(held, ignore_index=True))

    def product(pdf):
        import pandas as pd

        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        found = []
        for _, g in pdf.groupby(pdf["vector"].map(len)):
            x = g[g["own"] == i].reset_index(drop=True)
            found += of_size(x, x if i == j else g[g["own"] == j].reset_index(drop=True))
        out = pd.concat(found, ignore_index=True)
        return out if then is None else then(out)

    def of_size(x, y):
        import numpy as np
        import pandas as pd

        parts = [pd.DataFrame({"a": x["id"][:0], "b": x["id"][:0], "sim": [], "days": [], "shared": []}).astype({"shared": "int64"})]
        if tally is not None:
            parts = [tally(np.empty(0), np.empty(0), np.empty(0, np.int64))]
        if not len(x) or not len(y):
            return parts
        unit = lambda z: (m := np.array(z["vector"].tolist(), float).reshape(len(z), -1)) / np.where((n := np.linalg.norm(m, axis=1)) == 0, 1, n)[:, None]  # noqa: E731, F841
        ms = lambda z: z["ms"].to_numpy(float)
        u, own = unit(x), x["id"].to_numpy()
        v, other = (u, own) if y is x else (unit(y).copy(), y["id"].to_numpy())
        once = len(set(own)) == len(own) and len(set(other)) == len(other)
        at: dict[str, list[int]] = {}
        if keep_days is not None:
            for q, e in enumerate(y["entities"]):
                for w in set(e) if e is not None else ():
                    at.setdefault(w, []).append(q)
        mx, my = ms(x), ms(y)
        dated = keep_days is not None and not (np.isnan(mx).all() or np.isnan(my).all())
        for p0 in range(0, len(x), STRIP):
            rows = slice(p0, p0 + STRIP)
            raw = u[rows] @ v.T
            ok = raw >= least - 10.0**-digits
            shared = None
            if dated:
                ok |= np.abs(mx[rows, None] - my[None, :]) <= keep_days * 86_400_000.0
            if at:
                shared = np.zeros(raw.shape, np.int32)
                for p, e in enumerate(x["entities"][rows]):
                    for w in set(e) if e is not None else ():
                        shared[p, at.get(w, [])] += 1
                ok |= shared > 0
            p, q = np.nonzero(ok)
            sim = np.round(raw[p, q], digits)
            days = np.abs(mx[p + p0] - my[q]) / 86_400_000.0
            n = np.zeros(len(p), np.int64) if shared is None else shared[p, q].astype(np.int64)
            good = ~np.isnan(sim) & (sim >= least if keep_days is None else (sim >= least) | (days <= keep_days) | (n > 0))
            if y is x:
                good &= p + p0 < q  # else each pair comes from both ends
            if some is not None:
                good &= some(sim, days, n)
            p, q, sim, days, n = (z[good] for z in (p, q, sim, days, n))
            if tally is not None:
                parts.append(tally(sim, days, n))
                continue
            a, b = own[p + p0], other[q]
            swap = a > b
            out = pd.DataFrame({"a": np.where(swap, b, a), "b": np.where(swap, a, b), "sim": sim, "days": days, "shared": n})
            parts.append(out if once else out[out["a"] != out["b"]])
        return parts if once or tally is not None else [pd.concat(parts, ignore_index=True).drop_duplicates(["a", "b"])]

    return each


def link_parts(sim: Column, days: Column, shared: Column, floor: float = FLOOR, ceil: float = CEIL, window: float = WINDOW_DAYS) -> tuple[Column, Column, Column]:
    """Semantic, temporal and entity parts of a link's weight, each from 0 to 1."""
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    semantic = F.when(sim >= floor, 0.15 + 0.85 * clamp((sim - floor) / (ceil - floor))).otherwise(0.0)
    temporal = F.when(days <= window, 1 - days / window).otherwise(0.0)
    return semantic, F.coalesce(temporal, F.lit(0.0)), F.least(F.lit(1.0), shared / 3.0)


def link_weight(sim: Column, days: Column, shared: Column, **options) -> Column:
    s, t, e = link_parts(sim, days, shared, **options)
    return F.when(sim < options.get("ceil", CEIL), F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.60 * s + 0.25 * t + 0.15 * e)))


def build_links(notes: DataFrame, floor: float = FLOOR, ceil: float = CEIL, window: float = WINDOW_DAYS, per_node: int | None = PER_NODE) -> DataFrame:
    """a, b, sim, days, shared, weight, signals, reason; capped at per_node links of a node, the strongest first."""
    options = {"floor": floor, "ceil": ceil, "window": window}
    p = weighed(all_pairs(notes, floor, keep_days=window), options) if per_node is None else capped(notes, per_node, options)
    s, t, e = link_parts(F.col("sim"), F.col("days"), F.col("shared"), **options)
    names = F.array_compact(F.array(F.when(s > 0, "semantic"), F.when(t > 0, "temporal"), F.when(e > 0, "entity")))
    return p.withColumn("signals", names).withColumn("reason", F.concat_ws(" + ", "signals"))


def weighed(pairs: DataFrame, options: dict) -> DataFrame:
    return pairs.withColumn("weight", F.round(link_weight(F.col("sim"), F.col("days"), F.col("shared"), **options), 6)).where("weight > 0")


def capped(notes: DataFrame, cap: int, options: dict, batch: int = BATCH) -> DataFrame:
    """The links that a scan from the strongest keeps while both ends have fewer than cap, without writing all links.

    The scan goes by ranges of weight, from the highest. A first pass over the pairs of blocks counts links by weight; the
    next range reaches as low as about `batch` links are in it, and only its links leave the products. Notes that are full
    then take no part in later passes, as none of their links can be kept. A range that ties make larger than four
    batches is decided in rounds over all tasks, others by a scan in one task, which is of bounded size."""
    floor, ceil, window = (options[k] for k in ("floor", "ceil", "window"))
    have = [c for c in ("ms", "entities") if c in notes.columns]
    notes = stage(notes.where("vector is not null").select("id", "vector", *have), "notes")

    def weights(sim, days, shared):
        import numpy as np

        s = np.where(sim >= floor, 0.15 + 0.85 * np.clip((sim - floor) / (ceil - floor), 0, 1), 0.0)
        t = np.where(days <= window, 1 - days / window, 0.0)
        w = 0.60 * s + 0.25 * t + 0.15 * np.minimum(1.0, shared / 3)
        return np.where(sim < ceil, w, -1.0)

    def counts(high):
        def count(*links):
            import numpy as np
            import pandas as pd

            w = weights(*links)
            step, n = np.unique(np.floor(w[(w > 0) & (w < high)] * STEPS).astype(np.int64), return_counts=True)
            return pd.DataFrame({"step": step, "n": n.astype(np.int64)})

        return count

    def between(low, high):
        def keep(*links):
            w = weights(*links)
            return (w >= low - 2e-6) & (w < high + 2e-6)  # a little more: the range is exact by the rounded weight

        return keep

    def by_step(out):
        return out.groupby("step", as_index=False)["n"].sum()

    def reached(low):
        """The least similarity of a link of that weight, as far as weights go by similarity alone."""
        s = (low - 1e-5) / 0.60
        return floor if have or s <= 0.15 else max(floor, floor + (s - 0.15) / 0.85 * (ceil - floor))

    kept, used, high, open_, kind = None, None, 2.0, notes, dict(notes.dtypes)["id"]
    while True:
        blocks = _blocks(open_, block=GRID)
        grid = _crossed(blocks)
        tallied = grid.mapInPandas(_products(floor, 6, window, by_step, tally=counts(high)), "step long, n long")
        sizes = tallied.groupBy("step").agg(F.sum("n").alias("n")).orderBy(F.desc("step")).collect()  # STEPS rows at most
        low, n = 0.0, 0
        for r in sizes:
            if n and n + r["n"] > batch:
                break
            low, n = r["step"] / STEPS, n + r["n"]
        last = not sizes or low <= sizes[-1]["step"] / STEPS
        low = 0.0 if last else low
        found = grid.mapInPandas(_products(reached(low), 6, window, some=between(low, high)), _pair(kind))
        found = weighed(found.withColumn("days", F.nanvl("days", F.lit(None).cast("double"))), options)
        found = found.where((F.col("weight") >= low) & (F.col("weight") < high))
        new = (ranking.degree_cap if n > 4 * batch else ranking.scan_cap)(found, cap, used=used)
        before, kept = kept, stage(new if kept is None else kept.unionByName(new), "capped")
        release(blocks, *(x for x in (before, used) if x is not None))
        if last:
            release(notes)
            return kept
        high = low
        used = stage(kept.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").agg(F.count("*").alias("used")), "capped-used")
        open_ = notes.join(used.where(F.col("used") >= cap).select(F.col("n").alias("id")), "id", "left_anti")


def near_duplicates(chunks: DataFrame, mid: float = MID, high: float = HIGH, top: int = 40) -> DataFrame:
    """a, b, sim, label (DUP or SIM) of the most similar files, each by its first chunk with a vector."""
    first = chunks.where("vector is not null").groupBy("rel").agg(F.min_by("vector", "ord").alias("vector"))
    p = all_pairs(first, mid, id="rel", top=top)
    return p.select("a", "b", "sim", F.when(F.col("sim") >= high, "DUP").otherwise("SIM").alias("label")).orderBy(F.desc("sim"), "a", "b").limit(top)


def search(queries: DataFrame, rows: DataFrame, k: int | None = None, least: float | None = None, below: float | None = None, digits: int = 6, block: int = BLOCK) -> DataFrame:
    """(query, ord, sim, score) of each query's best k rows, or of all, with least <= sim < below where given.

    queries: id, vector and optionally rel (rows of the same rel are left out); rows: ord, vector and optionally rel and
    weight. score is sim times weight, 1 without; ties go by ord. Both sides fall into blocks, each pair of blocks is a
    matrix product in one task, and k rows of a query and pair go on. Rows without a vector, or of another size than
    the block's queries, are no partners, nor are scores that aren't finite."""
    many = lambda df: max(1, -(-df.count() // block))
    nq, nr = many(queries), many(rows)
    have = lambda df, c, kind, default=None: F.col(c) if c in df.columns else F.lit(default).cast(kind)
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    side = lambda df, c: df.where("vector is not null").select(F.col(c), F.col("vector").cast("array<double>").alias("vector"), have(df, "rel", "string").alias("rel"), have(df, "weight", "double", 1.0).alias("weight"))
    q = side(queries, "id").withColumn("i", part("id", nq)).withColumn("j", each(nr))
    r = side(rows, "ord").withColumn("j", part("ord", nr)).withColumn("i", each(nq))
    kinds = dict(q.dtypes)["id"], dict(r.dtypes)["ord"]

    def product(x, y):
        import numpy as np
        import pandas as pd

        found = []
        unit = lambda z: (m := np.array(z["vector"].tolist(), float).reshape(len(z), -1)) / np.where((n := np.linalg.norm(m, axis=1)) == 0, 1, n)[:, None]  # noqa: E731, F841
        by_size = {n: g.reset_index(drop=True) for n, g in y.sort_values("ord").groupby(y["vector"].map(len))} if len(y) else {}
        for size, a in x.groupby(x["vector"].map(len)) if len(x) else ():
            if size not in by_size:
                continue
            b = by_size[size]
            with np.errstate(all="ignore"):
                sims = np.round(unit(a) @ unit(b).T, digits)
            for one, rel, sim in zip(a["id"], a["rel"], sims):
                ok = np.isfinite(sim)
                ok &= sim >= least if least is not None else True
                ok &= sim < below if below is not None else True
                ok &= (b["rel"] != rel).to_numpy() if rel is not None else True
                at = np.nonzero(ok)[0]
                score = np.round(sim[at] * b["weight"].to_numpy(float)[at], digits)
                if k is not None and len(at) > k:
                    best = np.argsort(-score, kind="stable")[:k]
                    at, score = at[best], score[best]
                found.append((np.full(len(at), one, object), b["ord"].to_numpy()[at], sim[at], score))
        columns = zip(*found) if found else [[np.array([], object)]] * 4
        return pd.DataFrame({name: np.concatenate(list(c)) for name, c in zip(("query", "ord", "sim", "score"), columns)})

    out = q.groupBy("i", "j").cogroup(r.groupBy("i", "j")).applyInPandas(product, f"query {kinds[0]}, ord {kinds[1]}, sim double, score double")
    if k is None:
        return out
    best = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "ord"))
    return out.withColumn("_n", best).where(F.col("_n") <= k).drop("_n")


def reconcile(candidates: DataFrame, chunks: DataFrame, high: float = HIGH, mid: float = MID, top_k: int = 5) -> DataFrame:
    """id, action (skip, review or new), top_score, matches (up to top_k of mid or more) for candidates (id, vector).

    A candidate with a rel is an edit of that note and isn't held against the note's own chunks. Without a vector or
    with nothing to compare, a candidate is new."""
    hits = search(candidates, chunks, max(top_k, 1))
    best = hits.groupBy(F.col("query").alias("id")).agg(F.max("score").alias("top_score"))
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "ord"))
    hit = hits.where(F.col("score") >= mid).withColumn("_n", place).where(F.col("_n") <= top_k).join(chunks.select("ord", "rel", "text"), "ord")
    shown = F.struct("_n", "rel", "score", T.snippet(F.col("text")).alias("snippet"))
    bare = lambda x: F.struct(x["rel"].alias("path"), x["score"].alias("score"), x["snippet"].alias("snippet"))
    lists = hit.groupBy(F.col("query").alias("id")).agg(F.transform(F.array_sort(F.collect_list(shown)), bare).alias("matches"))
    out = candidates.select("id").join(best, "id", "left").join(lists, "id", "left")
    action = F.when(F.col("top_score") >= high, "skip").when(F.col("top_score") >= mid, "review").otherwise("new")
    none = F.array().cast("array<struct<path: string, score: double, snippet: string>>")
    return out.select("id", action.alias("action"), "top_score", F.coalesce("matches", none).alias("matches"))


def verdict_prompt(text: Column, matches: Column) -> Column:
    """A question to whoever judges a candidate that is similar to what is there."""
    lines = F.transform(matches, lambda m: F.format_string("- %s (%.3f): %s", m["path"], m["score"], m["snippet"]))
    return F.concat_ws("\n", F.lit("Is the new note a duplicate, an update, a contradiction or distinct?"), F.concat(F.lit("New: "), T.snippet(text, 150)), F.lit("Similar:"), F.concat_ws("\n", lines))


def connect(chunks: DataFrame, seeds: DataFrame, k: int = 8, penalty: float = 0.5, floor: float = FLOOR, ceil: float = CEIL) -> DataFrame:
    """Diverse cross-links of seeds (seed, seed_rel, seed_vector): seed, id, rel, redundancy, mmr, pos.

    Chunks within the band of similarity, the best one a file, chosen by maximal marginal relevance."""
    q = seeds.select(F.col("seed").alias("id"), F.col("seed_rel").alias("rel"), F.col("seed_vector").alias("vector"))
    p = search(q, chunks, least=floor, below=ceil).join(chunks.select("ord", "rel", "vector"), "ord")
    best = p.withColumn("_n", F.row_number().over(W.partitionBy("query", "rel").orderBy(F.desc("sim"), "ord"))).where("_n = 1")
    return ranking.mmr(best.select(F.col("query").alias("seed"), F.col("ord").alias("id"), F.col("sim").alias("rel"), "vector"), k, penalty)
