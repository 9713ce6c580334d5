"""Composite jobs over the operators. Each takes the time as a parameter and gives rows; writing them is the caller's."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from engramlake.functions import decay as D, text as T
from engramlake.operators import graph, links, metrics, ranking


def deep_recall(chunks: DataFrame, units: DataFrame, query: str, vec: list[float] | None = None, k: int = 8, entries: DataFrame | None = None, now_ms: int = 0, src: str | None = None, after: str = "", before: str = "9999", **options) -> DataFrame:
    """Recall over notes and transcript units (ref, text, ts, src, vector); units have no decay. Source and dates filter
    units only; undated ones pass. src may be given as thread or threads."""
    u = units if src is None else units.where(F.col("src").isin(src, src.removesuffix("s")))
    day = F.substring(F.coalesce("ts", F.lit("")), 1, 10)
    u = u.where((day == "") | day.between(after, before))
    c = chunks.select(F.lit("note").alias("src"), "rel", F.concat("rel", F.lit(":"), F.col("start_line").cast("string")).alias("ref"), "text", F.col("vector"), F.lit("").alias("ts"), F.struct(F.lit(0), "ord", F.lit("")).alias("ord"))
    t = u.select("src", F.lit(None).cast("string").alias("rel"), "ref", "text", F.col("vector").cast("array<double>"), "ts", F.struct(F.lit(1), F.lit(0).cast("long").alias("ord"), F.col("ref")).alias("ord"))
    both = c.unionByName(t.select(*c.columns[:-1], t.ord.cast(dict(c.dtypes)["ord"]).alias("ord")))
    return ranking.recall(both, query, vec, k, entries, now_ms, stop=T.DEEP_STOP, path_bonus=False, **options)


def merge_access(entries: DataFrame, hits: DataFrame, now_ms: int) -> DataFrame:
    """entries after one access more for each distinct rel in hits; a new entry has importance 0.5."""
    h = hits.where("rel is not null").select("rel").distinct().withColumn("_hit", F.lit(1))
    e = entries.join(h, "rel", "full_outer")
    hit = F.col("_hit").isNotNull()
    return e.select("rel", (F.coalesce("access", F.lit(0)) + hit.cast("int")).alias("access"), F.when(hit, F.lit(now_ms)).otherwise(F.col("last_access_ms")).alias("last_access_ms"), F.coalesce("importance", F.lit(0.5)).alias("importance"))


def surface(entries: DataFrame, now_ms: int, top: int = 5) -> DataFrame:
    """Forgotten but important notes."""
    a, m, i = F.col("access"), F.col("last_access_ms"), F.col("importance")
    s = entries.withColumn("score", F.round(D.surface_score(a, m, i, now_ms), 9)).where("score is not null")
    return s.select("rel", "score", F.round(D.age_days(m, now_ms), 6).alias("age_days"), "access", "importance", D.surface_reason(a, m, i, now_ms).alias("reason")).orderBy(F.desc("score"), "rel").limit(top)


def prune_candidates(entries: DataFrame, now_ms: int, importance: float = 0.6, age: float = 90.0, factor: float = 0.35, top: int = 50, kept: str = r"(?:^|/)(?:00-core|\.consolidation|\.semantic|active-tasks)") -> DataFrame:
    """Old, unimportant notes of a low weight, to be archived."""
    a, m, i = F.col("access"), F.col("last_access_ms"), F.col("importance")
    e = entries.withColumn("factor", F.round(D.decay_factor(a, m, i, now_ms), 9)).withColumn("age_days", F.round(D.age_days(m, now_ms), 6))
    return e.where((i < importance) & (F.col("age_days") >= age) & (F.col("factor") <= factor) & ~F.col("rel").rlike(kept)).orderBy("factor", "rel").limit(top)


def consolidate(chunks: DataFrame, entries: DataFrame, now_ms: int, **options) -> DataFrame:
    """Rows of a review: near duplicates, what to archive, what to resurface (without what is archived), what is flagged."""
    dup = links.near_duplicates(chunks, **{k: v for k, v in options.items() if k in ("mid", "high")})
    prune = prune_candidates(entries, now_ms)
    out = dup.select(F.col("label").alias("section"), F.concat_ws(" ~ ", "a", "b").alias("item"), F.col("sim").alias("value"))
    out = out.unionByName(prune.select(F.lit("PRUNE").alias("section"), F.col("rel").alias("item"), F.col("factor").alias("value")))
    shown = surface(entries.join(prune.select("rel"), "rel", "left_anti"), now_ms)
    out = out.unionByName(shown.select(F.lit("SURFACE").alias("section"), F.col("rel").alias("item"), F.col("score").alias("value")))
    return out.unionByName(flagged(chunks).select(F.lit("REVIEW").alias("section"), F.col("rel").alias("item"), F.lit(None).cast("double").alias("value")))


def flagged(chunks: DataFrame, marker: str = "reconcile: review", top: int = 30) -> DataFrame:
    return chunks.where(F.col("text").contains(marker)).select("rel").distinct().orderBy("rel").limit(top)


def heartbeat(notes: DataFrame, entries: DataFrame, queued: DataFrame, now_ms: int, window_min: int = 45, top: int = 15) -> DataFrame:
    """ORPHAN: entries without a note; RECENT: notes changed within the window and not queued."""
    orphans = entries.join(notes.select("rel"), "rel", "left_anti").select(F.lit("ORPHAN").alias("section"), "rel")
    recent = notes.where(F.col("mtime_ms") >= now_ms - window_min * 60_000).join(queued.select("rel"), "rel", "left_anti").orderBy(F.desc("mtime_ms"), "rel").limit(top)
    return orphans.unionByName(recent.select(F.lit("RECENT").alias("section"), "rel"))


def high_signal(messages: DataFrame, limit: int = 40) -> DataFrame:
    """pos, role, text, tags of marked lines, the first of equal ones; messages: (ord, role, text)."""
    lines = messages.select("ord", "role", F.posexplode(F.split("text", r"(?<=[.!?])\s+|\n+")).alias("n", "line")).withColumn("text", F.trim("line"))
    lines = lines.where(F.length("text").between(12, 400)).withColumn("tags", T.signal_tags(F.col("text"))).where(F.size("tags") > 0)
    key = F.substring(F.lower("text"), 1, 120)
    first = lines.groupBy(key.alias("_key")).agg(F.min_by(F.struct("ord", "n", "role", "text", "tags"), F.struct("ord", "n")).alias("_l")).select("_l.*")
    best = first.orderBy("ord", "n").limit(limit)
    return best.select((F.row_number().over(W.orderBy("ord", "n")) - 1).cast("long").alias("pos"), "role", "text", "tags")


def digest(messages: DataFrame) -> DataFrame:
    """digest of a window's messages (ord, role, text), in order. A window is what capture() gives, of bounded size."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", "role", "text"))), lambda m: F.concat(m["role"], F.lit(":"), m["text"]))
    return messages.agg(F.substring(F.sha2(F.array_join(lines, "\n"), 256), 1, 8).alias("digest"))


def capture(messages: DataFrame, taken_ms: int, now_ms: int, last: int = 400, chars: int = 1200, fresh_ms: int = 120_000) -> DataFrame:
    """mode, ord, role, text: the window's last messages, cut, where the snapshot is of this moment; else one stub."""
    if now_ms - taken_ms > fresh_ms:
        return messages.sparkSession.range(1).select(F.lit("reference").alias("mode"), F.lit(None).cast("long").alias("ord"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    return messages.orderBy(F.desc("ord")).limit(last).select(F.lit("snapshot").alias("mode"), "ord", "role", F.substring("text", 1, chars).alias("text"))


def save_notes(candidates: DataFrame, stored: DataFrame, chunks: DataFrame, **options) -> DataFrame:
    """What to write of candidates (id, type, text, vector; rel where they edit a note): redacted, not stored yet (path), not near duplicates of
    chunks; similar ones carry a review flag."""
    kind = F.coalesce(F.nullif("type", F.lit("")), F.lit("note"))
    c = candidates.withColumn("text", T.redact(F.col("text"))["text"]).withColumn("type", kind)
    name = F.concat(F.lit("memory/"), T.store_of(F.col("type")), F.lit("/"), T.slug(T.title(F.col("text"))), F.lit("-"), T.content_hash(F.col("type"), F.col("text")), F.lit(".md"))
    c = c.withColumn("path", name).join(stored.select("path"), "path", "left_anti")
    c = c.withColumn("_n", F.row_number().over(W.partitionBy("path").orderBy("id"))).where("_n = 1").drop("_n")
    v = links.reconcile(c.select("id", "vector", *(["rel"] if "rel" in c.columns else [])), chunks, **options)
    return c.join(v, "id").where("action <> 'skip'").select("id", "path", "type", "text", (F.col("action") == "review").alias("review"), "top_score")


def advise(state: DataFrame, scale: int = 8000, precise: int = 2000) -> DataFrame:
    """flag, severity, reason, measured of one row (chunks, content_ms, index_ms, has_cron, has_store, has_model)."""
    behind = F.col("content_ms") > F.col("index_ms")
    rules = F.array(
        F.when(~F.col("has_cron") | behind, F.struct(F.lit("--with-cron").alias("flag"), F.lit("recommend").alias("severity"), F.lit("staleness").alias("reason"), F.when(behind, D.duration((F.col("content_ms") - F.col("index_ms")) / 1000)).otherwise("no schedule").alias("measured"))),
        F.when((F.col("chunks") >= scale) & ~F.col("has_store"), F.struct(F.lit("--with-sqlite-vec").alias("flag"), F.lit("recommend").alias("severity"), F.lit("scale").alias("reason"), F.col("chunks").cast("string").alias("measured"))),
        F.when((F.col("chunks") >= precise) & ~F.col("has_model"), F.struct(F.lit("--with-reranker").alias("flag"), F.lit("suggest").alias("severity"), F.lit("precision").alias("reason"), F.col("chunks").cast("string").alias("measured"))),
    )
    return state.select(F.explode(F.array_compact(rules)).alias("r")).select("r.*")


def stale_logs(logs: DataFrame, limits: dict[str, float], now_ms: int) -> DataFrame:
    """name, hours, state of logs (name, mtime_ms) against limits in hours; absent ones are missing."""
    spark = logs.sparkSession
    want = spark.createDataFrame(sorted(limits.items()), "name string, most double")
    hours = (F.lit(now_ms) - F.col("mtime_ms")) / 3_600_000.0
    state = F.when(F.col("mtime_ms").isNull(), "missing").when(hours > F.col("most"), "stale").otherwise("fresh")
    return want.join(logs, "name", "left").select("name", F.round(hours, 3).alias("hours"), state.alias("state"))


def heads(files: DataFrame, n: int = 1, pattern: str = r"\S", limit: str | None = None) -> DataFrame:
    """name, pos (from 0), line: the first n lines of files (name, content) that fit the pattern, after the front matter, in
    the file's order, without the marks of a heading; limit: a pattern of lines that don't count."""
    lines = F.split(T.without_front_matter(F.col("content")), "\n", -1)
    fit = F.filter(lines, lambda x: x.rlike(pattern) if limit is None else x.rlike(pattern) & ~F.regexp_replace(x, "^#* *", "").rlike(limit))
    return files.select("name", F.posexplode(F.slice(F.transform(fit, lambda x: F.regexp_replace(x, "^#* *", "")), 1, n)).alias("pos", "line"))


def briefing(entries: DataFrame, insights: DataFrame, pending: DataFrame, now_ms: int, files: DataFrame | None = None) -> DataFrame:
    """section, item: what to resurface, what was learned, what waits; with files (name, content) also the focus, where one
    left off and the health, as far as the files are there."""
    out = surface(entries, now_ms, 3).select(F.lit("surfaced").alias("section"), F.col("rel").alias("item"))
    learned = insights.where("status = 'promoted'").orderBy(F.desc("runs"), F.desc("strength"), "id").limit(12).select(F.lit("learned").alias("section"), F.array_join("members", ", ").alias("item"))
    out = out.unionByName(learned).unionByName(pending.select(F.lit("pending").alias("section"), F.col("rel").alias("item")))
    if files is None:
        return out
    named = lambda name: files.where(F.col("name") == name)
    tasks, last = named("active-tasks.md"), named("last-conversation.md")
    part = lambda df, section: df.select(F.lit(section).alias("section"), F.col("line").alias("item"))
    out = out.unionByName(part(heads(tasks, 1, "^#{1,2} "), "focus")).unionByName(part(heads(last, 3), "continuity"))
    out = out.unionByName(part(heads(tasks, 5, "^#{1,3} ", "(?i)^location"), "pending")).unionByName(part(heads(named("learnings.md"), 1, "^#{2,3} |^- "), "learned"))
    log = F.reverse(F.filter(F.split("content", "\n"), lambda x: x != ""))
    status = F.filter(F.slice(log, 1, 8), lambda x: x.rlike("(?i)ok|healthy|critical|warn|alert"))
    health = named("health-monitor.log").select(F.lit("health").alias("section"), F.get(status, F.lit(0)).alias("item"))
    return out.unionByName(health.where("item is not null"))


def proactive(files: DataFrame, now_ms: int, stalled_days: int = 3, most_bytes: int = 10 * 1024) -> DataFrame:
    """what (pending, stalled, large), item, n of files (name, content, mtime_ms): marks of pending learnings, tasks that nobody
    has touched for days, a memory file near its cap in KB."""
    pending = files.where("name = 'learnings.md'").select(F.lit("pending").alias("what"), F.col("name").alias("item"), F.size(F.filter(F.split("content", "\n"), lambda x: x.rlike("(?i)pending"))).cast("long").alias("n"))
    days = F.floor((F.lit(now_ms) - F.col("mtime_ms")) / 86_400_000)
    stalled = files.where("name = 'active-tasks.md'").select(F.lit("stalled").alias("what"), F.col("name").alias("item"), days.cast("long").alias("n")).where(F.col("n") >= stalled_days)
    size = F.octet_length("content")
    large = files.where((F.col("name") == "MEMORY.md") & (F.floor(size / 1024) > most_bytes // 1024)).select(F.lit("large").alias("what"), F.col("name").alias("item"), F.floor(size / 1024).cast("long").alias("n"))
    return pending.where("n > 0").unionByName(stalled).unionByName(large)


# --- insights ----------------------------------------------------------------------------------------------------


def _members(insights: DataFrame, notes: DataFrame, shown: int, chars: int) -> DataFrame:
    """id, pos, member, snippet of insights' first members; notes: (id, text)."""
    m = insights.select("id", F.posexplode(F.slice("members", 1, shown)).alias("pos", "member"))
    n = notes.select(F.col("id").alias("member"), F.col("text").alias("_text"))
    return m.join(n, "member", "left").select("id", "pos", "member", T.snippet(F.coalesce("_text", F.lit("")), chars).alias("snippet"))


def insight_list(insights: DataFrame, notes: DataFrame, shown: int = 6) -> DataFrame:
    """id, status, runs, strength, size, pos, member, snippet, conflicts (pairs of all members that may contradict)."""
    pairs = graph.contradictions(insights.select(F.col("id").alias("cluster"), F.posexplode("members").alias("pos", "id")), notes)
    conflicts = pairs.groupBy(F.col("cluster").alias("id")).agg(F.count("*").alias("conflicts"))
    out = insights.select("id", "status", "runs", "strength", "size").join(_members(insights, notes, shown, 90), "id").join(conflicts, "id", "left")
    return out.withColumn("conflicts", F.coalesce("conflicts", F.lit(0)))


def insight_block(insights: DataFrame, themes: DataFrame, top: int = 12) -> DataFrame:
    """pos, line: a line for each of the strongest promoted insights; themes: (cluster, theme)."""
    order = [F.desc("runs"), F.desc("strength"), F.asc("id")]
    best = insights.where("status = 'promoted'").orderBy(*order).limit(top).join(themes.select(F.col("cluster").alias("id"), "theme"), "id", "left")
    named = F.coalesce(F.concat(F.lit("theme: "), "theme"), F.lit("a recurring theme"))
    line = F.concat(F.lit("- "), named, F.format_string(", in %d notes (%s%s), seen %d times, strength %s", "size", F.array_join(F.slice("members", 1, 2), ", "), F.when(F.col("size") > 2, ", …").otherwise(""), "runs", F.col("strength").cast("string")))
    return best.select((F.row_number().over(W.orderBy(*order)) - 1).alias("pos"), line.alias("line"))  # of `top` rows


def to_phrase(insights: DataFrame, notes: DataFrame, marks: DataFrame | None = None, top: int = 12, shown: int = 8, chars: int = 120) -> DataFrame:
    """id, size, runs, pos, member, snippet: what to write up of the strongest promoted insights, without those in marks (id)."""
    p = insights.where("status = 'promoted'")
    p = p if marks is None else p.join(marks.select("id"), "id", "left_anti")
    best = p.orderBy(F.desc("runs"), F.desc("strength"), "id").limit(top)
    return best.select("id", "size", "runs").join(_members(best, notes, shown, chars), "id")


def flywheel(insights: DataFrame, notes: DataFrame, marks: DataFrame) -> DataFrame:
    """What to write up next: eight promoted insights that aren't marked, six notes of each."""
    return to_phrase(insights, notes, marks, 8, 6, 100)


def mark_phrased(marks: DataFrame, insights: DataFrame, id: str, now_ms: int) -> DataFrame:
    """marks (id, phrased_ms) with that insight's; an id that no insight has changes nothing, a mark that is there stays."""
    new = insights.where(F.col("id") == id).select("id", F.lit(now_ms).cast("long").alias("phrased_ms")).join(marks.select("id"), "id", "left_anti")
    return marks.select("id", "phrased_ms").unionByName(new)


def consolidation_brief(rows: DataFrame) -> DataFrame:
    """section, pos, line: what consolidate() found as a brief's lists, a line each; a section without rows says so."""
    names = {"DUP": "A", "SIM": "A", "PRUNE": "B", "SURFACE": "C", "REVIEW": "D"}
    letter = F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), F.col("section"))
    line = F.when(letter == "A", F.concat(F.lit("- ["), "section", F.lit(" "), F.format_string("%.3f", "value"), F.lit("] "), "item")).otherwise(F.concat(F.lit("- "), "item"))
    order = [F.desc("value"), F.asc("item")]
    found = rows.select(letter.alias("section"), line.alias("line"), "value", "item").withColumn("pos", F.row_number().over(W.partitionBy("section").orderBy(*order)) - 1).select("section", "pos", "line")
    every = rows.sparkSession.createDataFrame([(x,) for x in "ABCD"], "section string")
    return every.join(found, "section", "left").select("section", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("line", F.lit("- (none)")).alias("line"))


def learn(chunks: DataFrame, prev: DataFrame, insights: DataFrame, round_: int, now_ms: int, floor: float = links.FLOOR, **gate) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Graph, clusters with themes, and insights after a round."""
    notes = graph.pool_notes(chunks).withColumn("id", F.col("rel"))
    edges = graph.reinforce(prev, links.build_links(notes, floor=floor), round_)
    clusters = graph.promotable(graph.dense_clusters(edges), **gate)
    members = clusters.select("cluster", F.posexplode("members").alias("pos", "id"))
    named = clusters.join(graph.theme_labels(members, notes), "cluster", "left")
    return edges, named, graph.merge_insights(insights, clusters, now_ms)


def evaluate(queries: DataFrame, ranked: dict[str, DataFrame], ks=(1, 2, 5, 10)) -> DataFrame:
    """config, k and means of the metrics; queries: (query, id) relevant."""
    out = None
    for name, r in ranked.items():
        m = metrics.macro(metrics.ir_metrics(r, queries, ks).withColumn("config", F.lit(name)), "config")
        out = m if out is None else out.unionByName(m)
    return out


def traverse(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """node, hop: nodes reached from seeds (node) within so many hops over undirected edges (a, b)."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct()
    seen = seeds.select("node").distinct().withColumn("hop", F.lit(0))
    front = seen
    for h in range(1, hops + 1):
        front = front.join(both, front.node == both.a).select(F.col("b").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(h))
        seen = seen.unionByName(front)
    return seen
