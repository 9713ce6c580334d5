"""The index of notes kept over time: change detection by modification time, re-use of vectors, pruning, one writer."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from engramlake.functions import text as T
from engramlake.operators.ranking import numbered
from engramlake.session import stage
from engramlake.sources import notes as N

STALE_LOCK_MS = 3 * 60 * 60 * 1000
META = ["type", "status", "date", "tags"]


def changes(notes: DataFrame, stored: DataFrame | None) -> DataFrame:
    """The notes (rel, mtime_ms, ...) with `same`: whether the stored chunks are of this very modification time."""
    if stored is None:
        return notes.withColumn("same", F.lit(False))
    had = stored.groupBy("rel").agg(F.max("mtime_ms").alias("_mtime"))
    return notes.join(had, "rel", "left").withColumn("same", F.coalesce(F.col("_mtime") == F.col("mtime_ms"), F.lit(False))).drop("_mtime")


def refresh(notes: DataFrame, stored: DataFrame | None, embed: Callable[[Column], Column], dim: int | None = None, most: int = 900) -> DataFrame:
    """ord, rel, mtime_ms, META, start_line, text, vector, reused: the chunks of all notes (rel, content, mtime_ms) as they are.

    Chunks of unchanged notes keep their vectors, with metadata read anew; others are cut and embedded; what is gone from
    the notes goes. Stored vectors of another size than dim are no use: then all is embedded. ord is numbered afresh by path
    and line, so a re-used chunk stands where it stands now."""
    if stored is not None and dim is not None and stored.where(F.size("vector") != dim).limit(1).count():
        stored = None
    seen = stage(changes(notes, stored).withColumn("meta", T.front_matter(F.col("rel"), F.col("content"))), "notes-seen")
    cut = seen.where("not same").select("rel", "mtime_ms", "meta.*", F.explode(T.chunks(F.col("content"), most)).alias("chunk"))
    out = cut.select("rel", "mtime_ms", *META, "chunk.start_line", "chunk.text").withColumn("vector", embed(F.col("text")).cast("array<double>")).withColumn("reused", F.lit(False))
    if stored is not None:
        kept = seen.where("same").select("rel", "mtime_ms", "meta.*").join(stored.select("rel", "start_line", "text", F.col("vector").cast("array<double>").alias("vector")), "rel")
        out = out.unionByName(kept.select("rel", "mtime_ms", *META, "start_line", "text", "vector").withColumn("reused", F.lit(True)))
    return numbered(out, [F.asc("rel"), F.asc("start_line")], "ord")


def counts(stored: DataFrame | None, chunks: DataFrame) -> DataFrame:
    """what (files, reused, embedded, removed) and n, of a refresh."""
    of = chunks.agg(F.count_distinct("rel").alias("files"), F.count_if("reused").alias("reused"), F.count_if(~F.col("reused")).alias("embedded"))
    gone = stored.join(chunks.select("rel").distinct(), "rel", "left_anti").agg(F.count_distinct("rel").alias("removed")) if stored is not None else chunks.sparkSession.range(1).select(F.lit(0).alias("removed"))
    both = of.join(gone)  # one row each
    return both.select(F.explode(F.map_from_entries(F.array(*(F.struct(F.lit(c).alias("k"), F.col(c).cast("long").alias("v")) for c in ("files", "reused", "embedded", "removed")))))).toDF("what", "n")


def rebuild(spark: SparkSession, root: str, path: str, version: str, embed: Callable[[Column], Column], now_ms: int, dim: int | None = None, incremental: bool = True) -> DataFrame:
    """Refresh the index in path from the notes below root and write it as a new version; gives counts().

    No index is an empty one; one that can't be read stops the run, so that it isn't overwritten."""
    with writer_lock(spark, f"{path}/_lock", now_ms):
        stored = N.read_version(spark, path) if incremental and exists(spark, f"{path}/_current") else None
        chunks = stage(refresh(N.scan_notes(spark, root), stored, embed, dim), "index")
        done = stage(counts(stored, chunks), "index-counts")
        N.write_version(chunks, path, version)
    return done


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


@contextmanager
def writer_lock(spark: SparkSession, path: str, now_ms: int, stale_ms: int = STALE_LOCK_MS) -> Iterator[None]:
    """One writer at a time, by a file that is made only if it isn't there. A lock that is older than stale_ms is a crashed
    run's and is taken over."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(where.getParent())
    if not fs.createNewFile(where):
        if now_ms - fs.getFileStatus(where).getModificationTime() <= stale_ms:
            raise RuntimeError(f"another writer holds {path}")
        fs.delete(where, False)
        if not fs.createNewFile(where):
            raise RuntimeError(f"another writer holds {path}")
    try:
        yield
    finally:
        fs.delete(where, False)
