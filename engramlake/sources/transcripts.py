"""Conversation transcripts: lines of JSON to units of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from engramlake.functions import text as T
from engramlake.session import file_name_of, stage

UNIT = ["src", "file", "line", "ts", "role", "kind", "sub", "text", "id"]
# Fixed value: what a serialised dump of a message holds.
DUMP = r"""\{"type":"(?:text|message|tool|thinking)"|"signature":"[A-Za-z0-9+/]{30,}"""
SKIPPED = ("channel", "message_id", "sender_id")


def read_lines(spark: SparkSession, root: str, paths: list[str] | None = None) -> DataFrame:
    """file, line (from 1), value of all JSONL files below root, or of those in paths; blank lines count but aren't given.

    Files are read by lines in splits; a line's number is its place by split and by order within it."""
    df = spark.read.text(paths or root) if paths else spark.read.text(root, recursiveFileLookup=True, pathGlobFilter="*.jsonl")
    df = df.select(F.concat(F.lit("/"), file_name_of(F.col("_metadata.file_path"), root)).alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"), F.regexp_replace("value", "\r$", "").alias("value"))
    return df.withColumn("line", F.row_number().over(W.partitionBy("file").orderBy("_at", "_id"))).where("trim(value) <> ''").select("file", "line", "value")


def discover(spark: SparkSession, root: str, sessions: str | None = None) -> DataFrame:
    """path, file, size, mtime_ms, src of transcript files: those below root by their names, and all below the sessions
    folder, which is read only if it is given. A file that is below both is the root's."""

    def below(folder: str) -> DataFrame:
        df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(folder)
        return df.select("path", F.concat(F.lit("/"), file_name_of(F.col("path"), folder)).alias("file"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"))

    own = below(root).withColumn("src", T.kind_of(F.col("path"))).where("src is not null")
    if sessions is None:
        return own
    return own.unionByName(below(sessions).withColumn("src", F.lit("cc")).join(own.select("path"), "path", "left_anti"))


def _string(v: Column, path: str) -> Column:
    """The value at a path where it is a string."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))


def content_text(v: Column, path: str) -> Column:
    """A content that is a string, or the text blocks of one that is a list; serialised dumps are left out."""
    whole = _string(v, path)
    blocks = F.try_variant_get(v, path, "array<variant>")
    texts = F.transform(F.filter(blocks, lambda b: F.try_variant_get(b, "$.type", "string") == "text"), lambda b: F.try_variant_get(b, "$.text", "string"))
    texts = F.filter(texts, lambda t: t.isNotNull() & (t != "") & ~t.rlike(DUMP))
    return F.when(whole.isNotNull(), F.when(whole.rlike(DUMP), "").otherwise(whole)).otherwise(F.coalesce(F.trim(F.array_join(texts, "\n")), F.lit("")))


def _flatten_event(value):
    import json

    import pandas as pd

    def one(line):
        try:
            data = json.loads(line).get("data") or {}
        except (ValueError, AttributeError):
            return ""
        parts = []
        for k, v in data.items():  # in the order of the line
            if k in SKIPPED:
                continue
            if isinstance(v, str) and v.strip():
                parts.append(f"{k}: {v}")
            elif isinstance(v, list) and v:
                parts.append(f"{k}: {'; '.join(x for x in v if isinstance(x, str))}")
        return ". ".join(parts).strip()

    return pd.Series([one(x) for x in value])


def classify(lines: DataFrame, sample: int = 50) -> DataFrame:
    """Adds kind: by the path, else by the content of a file's first lines; other files are left out."""
    v = F.try_parse_json("value")
    head = lines.withColumn("v", v).where("v is not null").withColumn("n", F.row_number().over(W.partitionBy("file").orderBy("line"))).where(F.col("n") <= sample)
    session = F.try_variant_get("v", "$.type", "string").isin("user", "assistant") & F.schema_of_variant(F.try_variant_get("v", "$.message", "variant")).startswith("OBJECT")
    kinds = head.groupBy("file").agg(F.bool_or(F.coalesce(session, F.lit(False))).alias("_session"))
    kind = F.coalesce(T.kind_of(F.col("file")), F.when(F.col("_session"), "claude-code"))
    return lines.join(kinds, "file", "left").withColumn("kind", kind).where("kind is not null").drop("_session")


def parse_lines(lines: DataFrame, persona: str = "assistant") -> DataFrame:
    """file, line, kind, ts, role, text of lines (file, line, value, kind); what isn't a message goes. persona: the role of a
    thread's own events."""
    flatten = F.pandas_udf(_flatten_event, "string")
    p = lines.withColumn("v", F.try_parse_json("value")).where("v is not null")
    kind, type_ = F.col("kind"), F.try_variant_get("v", "$.type", "string")
    event, role = type_.isin("decision", "technical_note"), F.try_variant_get("v", "$.message.role", "string")
    body = content_text(F.col("v"), "$.message.content")
    said = F.when(kind == "thread", F.when(type_ == "user_message", F.coalesce(_string(F.col("v"), "$.data.content"), F.lit(""))))
    said = said.when((kind == "archive") & (type_ == "message"), F.when(role == "user", T.strip_channel(body)).otherwise(body))
    said = said.when(kind.isin("engineer", "claude-code") & type_.isin("user", "assistant"), body)
    who = F.when(kind == "thread", F.when(event, persona).otherwise("user")).when(kind == "archive", F.coalesce(role, F.lit("?"))).otherwise(type_)
    base = p.select("file", "line", "kind", F.coalesce(F.try_variant_get("v", "$.timestamp", "string"), F.lit("")).alias("ts"), who.alias("role"), said.alias("text"), "value", (event & (kind == "thread")).alias("_event"))
    plain = base.where("not coalesce(_event, false)").drop("value", "_event")
    events = base.where("_event").withColumn("text", flatten("value")).drop("value", "_event")
    return plain.unionByName(events).where("trim(text) <> ''")


def units(messages: DataFrame) -> DataFrame:
    """UNIT of messages (file, line, kind, ts, role, text): cleaned, opted-out and tiny ones left out, long ones split."""
    m = messages.where(~T.opted_out(F.col("text"))).withColumn("text", T.strip_wrappers(F.col("text"))).where(F.length("text") >= T.MIN_CHARS)
    m = m.select("file", "line", "kind", "ts", "role", F.posexplode(T.split_long(F.col("text"))).alias("sub", "text")).where(F.length("text") >= T.MIN_CHARS)
    return m.withColumn("src", F.col("kind")).withColumn("id", T.unit_id(F.col("file"), F.col("line"), F.col("sub"), F.col("text"))).select(*UNIT)


def shards(u: DataFrame) -> DataFrame:
    """Adds slug and month, by which units are kept, and redacts; ids are of the text before."""
    month = F.when(F.col("ts").rlike("^[0-9]{4}-[0-9]{2}"), F.substring("ts", 1, 7)).otherwise("undated")
    safe = T.redact(F.col("text"))
    slug = F.coalesce(F.regexp_extract("file", "/projects/([^/]+)/", 1), F.lit(""))
    return u.withColumn("_safe", safe).withColumn("text", F.col("_safe.text")).withColumn("redacted", F.col("_safe.redacted")).withColumn("slug", F.when(slug == "", "-").otherwise(slug)).withColumn("month", month).drop("_safe")


def new_units(u: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Units whose id isn't stored yet; of repeated ids the first."""
    first = u.withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy("file", "line", "sub"))).where("_n = 1").drop("_n")
    return first if stored is None else first.join(stored.select("id"), "id", "left_anti")


def read_shards(spark: SparkSession, out: str, src: str | None = None, months: tuple[str, str] | None = None) -> DataFrame:
    """The stored units, of one src and of months from and to where given: other shards aren't read. Shards that can't be
    read are left out."""
    df = spark.read.option("ignoreCorruptFiles", "true").parquet(out)
    df = df if src is None else df.where(F.col("src") == src)
    return df if months is None else df.where(F.col("month").between(*months) | (F.col("month") == "undated"))


def _stored(spark: SparkSession, out: str) -> DataFrame | None:
    try:
        return spark.read.parquet(out)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise  # a store that can't be read is no empty one
        return None


def _add(u: DataFrame, out: str) -> DataFrame:
    """Append the units that aren't stored to the shards in out; only shards of their own kind, project and month are read."""
    spark = u.sparkSession
    u = stage(shards(u), "units-read")
    stored = _stored(spark, out)
    if stored is not None:
        for key in ("src", "slug", "month"):  # as many values as there are kinds, projects and months
            stored = stored.where(F.col(key).isin([r[0] for r in u.select(key).distinct().collect()]))
    added = stage(new_units(u, stored), "units")
    added.write.mode("append").partitionBy("src", "slug", "month").parquet(out)
    return added


def ingest(spark: SparkSession, root: str, out: str) -> DataFrame:
    """Read all transcripts below root, append what is new to the shards in out; gives what was added."""
    return _add(units(parse_lines(classify(read_lines(spark, root)))), out)


CURSOR = "file string, size long, mtime_ms long, lines long"


def ingest_tails(spark: SparkSession, root: str, out: str, cursor: str, version: str, most: int | None = None) -> dict[str, int]:
    """Read what has come to the transcripts below root since the last run, append it to the shards in out; gives counters.

    The cursor (CURSOR, in versions) holds how far each file was read. Files of the same size and time aren't opened;
    others go on after their last line; `most` bounds the files of a run, in the order of their names, and the others'
    cursors stay. Units are told apart by id, so a run that ended before its cursor was written does no harm. Where files
    have changed and give neither new nor known units, a parser is broken, and the run says so."""
    from engramlake.sources.index import exists
    from engramlake.sources.notes import read_version, write_version

    had = read_version(spark, cursor) if exists(spark, f"{cursor}/_current") else spark.createDataFrame([], CURSOR)
    had = stage(had, "cursor")
    files = discover(spark, root).select("path", "file", "size", "mtime_ms")
    changed = files.join(had, ["file", "size", "mtime_ms"], "left_anti").orderBy("file")
    changed = stage(changed if most is None else changed.limit(most), "changed")
    paths = [r["path"] for r in changed.select("path").collect()]  # the names that a listing holds anyway
    if not paths:
        return {"scanned": 0, "new": 0, "known": 0, "redacted": 0}
    lines = read_lines(spark, root, paths)
    read = stage(lines.join(had.select("file", "lines"), "file", "left").where("line > coalesce(lines, 0)").drop("lines"), "tails")
    kinds = classify(lines).select("file", "kind").distinct()  # by their first lines, wherever the tail begins
    u = stage(units(parse_lines(read.join(kinds, "file"))), "tail-units")
    added, n = _add(u, out), u.count()
    done = added.agg(F.count("*").alias("n"), F.coalesce(F.sum("redacted"), F.lit(0)).alias("redacted")).first()
    if n == 0 and read.limit(1).count():
        raise RuntimeError("changed files gave no units: see the parsers")
    ends = lines.groupBy("file").agg(F.max("line").cast("long").alias("lines"))
    now = changed.join(ends, "file", "left").select("file", "size", "mtime_ms", F.coalesce("lines", F.lit(0)).cast("long").alias("lines"))
    write_version(had.join(now.select("file"), "file", "left_anti").unionByName(now), cursor, version)
    return {"scanned": len(paths), "new": done["n"], "known": n - done["n"], "redacted": int(done["redacted"])}
