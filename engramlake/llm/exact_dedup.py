"""Exact dedup against a persistent digest index, bucketed and sorted by digest.

The index is a Parquet table in buckets by digest, partitioned by batch: (digest, keep_id, copies, fresh, batch). A new
batch is grouped by digest (partial counts first, so a group of any size moves one row a task), anti-joined with the
index by a sort-merge join that reads the index without a shuffle, and appended: fresh rows for digests not met before,
count rows for the others. Only for the latter are the earlier batches' rows read again. A document stays if its digest
is fresh and it has the least doc_id of its batch's copies; in one batch that is the least doc_id of all.

Documents find their group by a join on the digest of rows of a few bytes. Groups that hold more than a HOT-th of the
rows, which are fewer than HOT by necessity, are broadcast instead, so that no task gets one of them whole.

Null texts count as empty. A null doc_id never stays before one that isn't null. Repeated rows (equal text and id) are
copies of each other: each says kept where its id stays; deduplicate() keeps the first of them by its place in the table. An empty table gives no rows. Columns besides doc_id and text
are not read; deduplicate() returns all columns.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from engramlake.session import new_folder, partitions, release, stage

SPACE = r"[\x20\x09-\x0D]+"
SCHEMA = "digest string, keep_id long, copies long, fresh boolean, batch string"
HOT = 1024


def digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the text with each run of white space as one space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ").cast("binary"), 256)


@dataclass
class DigestIndex:
    """An index in a folder of the shared store; it lasts as long as the folder. buckets: fixed when it is made."""

    spark: SparkSession
    folder: str
    buckets: int = 64

    def __post_init__(self) -> None:
        self.name = "digest_index_" + uuid.uuid5(uuid.NAMESPACE_URL, self.folder).hex
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({SCHEMA}) USING parquet PARTITIONED BY (batch) CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.folder}'")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, digests: DataFrame, batch: str) -> DataFrame:
        """Append a batch (digest, doc_id); returns its groups: digest, keep_id, group_size (with all earlier copies), fresh."""
        if self.table().where(F.col("batch") == batch).limit(1).count():
            raise ValueError(f"batch {batch} is in the index already")
        groups = digests.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("copies"))
        known = self.table().where("fresh").select("digest")
        fresh = groups.hint("merge").join(known.hint("merge"), "digest", "left_anti").withColumn("fresh", F.lit(True))
        again = groups.hint("merge").join(known.hint("merge"), "digest", "left_semi").withColumn("fresh", F.lit(False))
        rows = fresh.unionByName(again).select("digest", "keep_id", "copies", "fresh", F.lit(batch).alias("batch"))
        # A task holds whole buckets, so that each bucket gets one sorted file a batch.
        rows.repartition(self.buckets, "digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        mine = self.table().where(F.col("batch") == batch)
        new = mine.where("fresh").select("digest", "keep_id", F.col("copies").alias("group_size"), "fresh")
        met = self.table().hint("merge").join(mine.where("not fresh").select("digest").hint("merge"), "digest", "left_semi").groupBy("digest")
        met = met.agg(F.min(F.when(F.col("fresh"), F.col("keep_id"))).alias("keep_id"), F.sum("copies").alias("group_size")).withColumn("fresh", F.lit(False))
        return new.unionByName(met)


def new_index(spark: SparkSession) -> DigestIndex:
    return DigestIndex(spark, new_folder(spark, "digest-index"), max(8, partitions(spark)))


def decide(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, one row for each row of docs."""
    spark = docs.sparkSession
    digests = stage(docs.select("doc_id", digest(F.col("text")).alias("digest")), "digests")
    groups = stage((index or new_index(spark)).add(digests, batch or uuid.uuid4().hex), "digest-groups")
    large = F.col("group_size") > F.lit(digests.count() // HOT)
    hot = F.broadcast(groups.where(large & (F.col("group_size") > 1)))  # in one batch, fewer than HOT + 1
    rest = digests.join(hot.select("digest"), "digest", "left_anti").join(groups.where(~(large & (F.col("group_size") > 1))), "digest")
    found = digests.join(hot, "digest").unionByName(rest) if index is None else digests.join(groups, "digest")
    return found.select("doc_id", "keep_id", "group_size", (F.col("fresh") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), F.col("digest").alias("text_sha256"))


def deduplicate(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The documents that stay, with all their columns: one row of each group. docs must come from a written table, whose
    rows are numbered by where they stand in its files."""
    numbered = docs.withColumn("__el_row", F.monotonically_increasing_id())
    digests = stage(numbered.select(F.col("__el_row").alias("row"), "doc_id", digest(F.col("text")).alias("digest")), "digests")
    groups = (index or new_index(docs.sparkSession)).add(digests.select("digest", "doc_id"), uuid.uuid4().hex)
    first = digests.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    stays = first.join(groups.where("fresh"), "digest", "left_semi").select("first.row")
    # Rows that go are joined by their number, not by digest, so a large group is spread; where they are few, Spark
    # broadcasts them and the texts aren't moved.
    goes = stage(digests.select("row").join(stays, "row", "left_anti").select(F.col("row").alias("__el_row")), "digest-goes")
    release(digests)
    return numbered.join(goes, "__el_row", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


ORACLE = """
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) as h from documents),
g as (select h, min(doc_id) as keep_id, count(*)::bigint as group_size from d group by h)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, h as text_sha256 from d join g using (h)"""
