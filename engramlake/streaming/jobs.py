"""Incremental jobs with Structured Streaming: transcript ingest, access signals, edge state across rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from engramlake.functions import text as T
from engramlake.operators import graph
from engramlake.sources import transcripts

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def message_files(spark: SparkSession, root: str, schema: str, files: int | None = None) -> DataFrame:
    """Stream the JSON files of messages below root, so many files a batch at most."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).json(root)


def ingest_messages(messages: DataFrame, out: str, checkpoint: str):
    """Stream messages (file, line, kind, ts, role, text) into the shards in out; a unit that is there isn't added again,
    so a batch that runs again changes nothing. Only the shards that a batch's units belong to are read."""

    def add(batch: DataFrame, _: int) -> None:
        transcripts._add(transcripts.units(batch), out)

    return messages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def access_counts(spark: SparkSession, source: str, pattern: str, out: str, checkpoint: str, event_type: str = "click"):
    """Stream access events into partial counts (batch, user_id, access, last_ms); a batch replaces its own part."""
    events = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).parquet(source)

    def add(batch: DataFrame, no: int) -> None:
        hits = batch.where(F.col("event_type") == event_type).groupBy("user_id").agg(F.count("*").alias("access"), F.max(F.unix_millis("ts")).alias("last_ms"))
        hits.write.mode("overwrite").parquet(f"{out}/batch={no}")

    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(spark: SparkSession, source: str, pattern: str, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Streaming counts of events by window and type, with a watermark for late ones."""
    events = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).parquet(source)
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))


def reinforce_stream(links: DataFrame, out: str, checkpoint: str):
    """Each batch of links is a round: the graph in out moves on by it. Versions are kept by round, so a batch that runs
    again starts from the round before."""

    def step(batch: DataFrame, no: int) -> None:
        spark = batch.sparkSession
        prev = spark.read.parquet(f"{out}/round={no}") if no else spark.createDataFrame([], graph.EDGE + ", neural_score double")
        graph.reinforce(prev, batch, no + 1).write.mode("overwrite").parquet(f"{out}/round={no + 1}")

    return links.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def redacted(lines: DataFrame) -> DataFrame:
    """A stream's text with secrets replaced."""
    return lines.withColumn("_r", T.redact(F.col("text"))).withColumn("text", F.col("_r.text")).withColumn("redacted", F.col("_r.redacted")).drop("_r")
