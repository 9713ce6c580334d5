"""Upkeep of a memory that documents describe: triggers, episodes, routing, scope of a reflection, audits, retention,
alerts, proposals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Phrases that ask for something, kinds of episodes.
REMEMBER = "remember that|don't forget|keep in mind|note that|important:|for future reference|save this|fyi for later"
FORGET = "forget about|never mind about|disregard|that's no longer relevant|scratch that|ignore what i said about|remove from memory|delete the memory about"
REFLECT = "reflect on|consolidate your memories|what do you remember about|review your memories|clean up your memory"
KINDS = ("decision", "fact", "preference", "task", "event", "emotion", "correction")
HEADING = r"^## ([0-9]{2}:[0-9]{2}) \| ([a-z]+) \| confidence:(high|medium|low)(?: \| tags:\[([^\]]*)\])?(?: \| source:([a-z-]+))?"
ROUTES = (("when did", "episodic"), ("what do you know", "semantic"), ("how do i", "procedural"), ("what's the latest", "recent"))


def trigger(text: Column) -> Column:
    """remember, forget or reflect, the first that a text asks for; null if none."""
    low = F.lower(text)
    return F.when(low.rlike(FORGET), "forget").when(low.rlike(REMEMBER), "remember").when(low.rlike(REFLECT), "reflect")


def route(query: Column) -> Column:
    """Which store a question goes to; core where nothing says more."""
    out = F.when(F.lower(query).contains(ROUTES[0][0]), ROUTES[0][1])
    for phrase, store in ROUTES[1:]:
        out = out.when(F.lower(query).contains(phrase), store)
    return out.otherwise("core")


def episodes(logs: DataFrame) -> DataFrame:
    """name, pos, time, type, confidence, tags, source, text of the entries of daily logs (name, content); entries without a
    proper heading are left out."""
    parts = F.filter(F.split("content", r"\n(?=## )"), lambda p: p.rlike(HEADING))
    e = logs.select("name", F.posexplode(parts).alias("pos", "p"))
    part = lambda k: F.regexp_extract("p", HEADING, k)
    tags = F.filter(F.split(part(4), r",\s*"), lambda t: t != "")
    body = F.trim(F.regexp_replace(F.regexp_replace("p", r"^[^\n]*\n?", ""), r"^\s+|\s+$", ""))
    out = e.select("name", "pos", part(1).alias("time"), part(2).alias("type"), part(3).alias("confidence"), tags.alias("tags"), F.nullif(part(5), F.lit("")).alias("source"), body.alias("text"))
    return out.where(F.col("type").isin(*KINDS))


def reflection_scope(notes: DataFrame, entities: DataFrame, last_ms: int | None, now_ms: int) -> DataFrame:
    """what (episode or entity) and id that a reflection reads: episodes (id, ms) since the last one, of seven days if there
    was none; entities (id, score) beyond 0.3, all if there was none."""
    since = now_ms - 7 * 86_400_000 if last_ms is None else last_ms
    new = notes.where(F.col("ms") > since).select(F.lit("episode").alias("what"), F.col("id").cast("string").alias("id"))
    live = entities if last_ms is None else entities.where("score > 0.3")
    return new.unionByName(live.select(F.lit("entity").alias("what"), F.col("id").cast("string").alias("id")))


def audit_rows(audit: DataFrame, file: str | None = None, actor: str | None = None, actions: Sequence[str] = (), last: int | None = None) -> DataFrame:
    """The rows of an audit (timestamp, action, file, actor, ...) of a file, of an actor whose name begins so, of some
    actions; the last ones where a number is given."""
    a = audit if file is None else audit.where(F.col("file") == file)
    a = a if actor is None else a.where(F.col("actor").startswith(actor))
    a = a.where(F.col("action").isin(*actions)) if actions else a
    return a if last is None else a.orderBy(F.desc("timestamp"), *(F.asc(c) for c in a.columns if c != "timestamp")).limit(last)


def retention(logs: DataFrame, full: int = 10, lines: int = 40) -> DataFrame:
    """Adds tier to logs (series, date): of each series the last `full` stay whole, `lines` more as one line, others go to
    the archive."""
    place = F.row_number().over(W.partitionBy("series").orderBy(F.desc("date")))
    return logs.withColumn("_n", place).withColumn("tier", F.when(F.col("_n") <= full, "full").when(F.col("_n") <= full + lines, "line").otherwise("archive")).drop("_n")


def alerts(files: DataFrame, known: DataFrame, critical: DataFrame, approved: Sequence[str] = ("manual",)) -> DataFrame:
    """file, why (changed, unauthorised) of critical files (file): what (file, checksum, actor) isn't as known (file,
    checksum), and by whom it may not be changed."""
    f = files.join(critical.select("file").distinct(), "file", "left_semi").join(known.select("file", F.col("checksum").alias("_known")), "file", "left")
    changed = ~F.col("checksum").eqNullSafe(F.col("_known"))
    why = F.when(changed & ~F.col("actor").isin(*approved), "unauthorised").when(changed, "changed")
    return f.select("file", why.alias("why")).where("why is not null")


def settle(proposals: DataFrame, decisions: DataFrame, agent: str) -> DataFrame:
    """id, store, status, action, actor of proposals (id, store) by decisions (id, decision, store): committed ones go to the
    store that was decided or else proposed, rejected ones go, what is deferred or undecided waits. action is null for what
    needs no audit."""
    d = decisions.select("id", F.col("decision").alias("_d"), F.col("store").alias("_store"))
    status = F.when(F.col("_d") == "commit", "committed").when(F.col("_d") == "reject", "rejected").otherwise("pending")
    done = F.when(status == "committed", "CREATE").when(status == "rejected", "REJECT")
    return proposals.join(d, "id", "left").select("id", F.when(status == "committed", F.coalesce("_store", "store")).otherwise(F.col("store")).alias("store"), status.alias("status"), done.alias("action"), F.when(done.isNotNull(), f"bot:commit-from:{agent}").alias("actor"))
