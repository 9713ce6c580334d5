"""The library's tables as views of the shared test tables, in Spark and in DuckDB SQL.

chunk: documents with the embedding of the same number, where there is one; decay_entry: clicks by user as accesses of the
note of the same number, or of the user's own note where there is none; units: conversations as transcript units. NOW is pinned, so that results don't change with the clock."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from engramlake.session import table

NOW = 1_717_200_000_000  # 2024-06-01
QUERY = "tion eron there"


def chunk(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(table(spark, sf, "documents"), table(spark, sf, "embeddings"))


def embedded(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of chunk with a vector. Most documents without one are left out before the join, so that their texts aren't
    shuffled: by a bit for each number's hash, 16 bits a vector in all; the join drops the others."""
    d, e = table(spark, sf, "documents"), table(spark, sf, "embeddings").where("embedding is not null")
    words = max(1, -(-e.count() // 4))
    bit = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(64 * words))
    place = lambda b: (b % 64).cast("int")
    marked = e.select(bit("vec_id").alias("b")).groupBy(F.floor(F.col("b") / 64).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("mask"))
    dense = spark.range(words).join(marked, "id", "left").select(F.struct("id", F.coalesce("mask", F.lit(0).cast("long")).alias("mask")).alias("w"))
    sieve = dense.agg(F.transform(F.array_sort(F.collect_list("w")), lambda w: w["mask"]).alias("masks")).scalar()
    may = F.getbit(F.get(sieve, F.floor(bit("doc_id") / 64).cast("int")), place(bit("doc_id"))) == 1
    return _chunks(d.where(may), e).where("vector is not null")


def _chunks(d: DataFrame, e: DataFrame) -> DataFrame:
    rel = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    return d.join(e, d.doc_id == e.vec_id, "left").select(
        F.col("doc_id").alias("ord"), rel.alias("rel"), F.lit(1).alias("start_line"), "text", F.col("embedding").cast("array<double>").alias("vector"), F.col("lang").alias("type"),
        F.lit("active").alias("status"), F.array("source").alias("tags"), F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") * 37 % 1500).cast("int")), "yyyy-MM-dd").alias("date"), "label",
    )


CHUNK = """chunk as (select doc_id as ord, source || '/' || doc_id as rel, 1 as start_line, text, embedding::double[] as vector, lang as type, 'active' as status, [source] as tags,
  strftime(date '2020-01-01' + (doc_id * 37 % 1500)::int, '%Y-%m-%d') as date, label from documents left join embeddings on doc_id = vec_id)"""


def entries(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where("event_type = 'click'").groupBy("user_id").agg(F.count("*").cast("int").alias("access"), F.unix_millis(F.max("ts").cast("timestamp")).alias("last_access_ms"))
    q = table(spark, sf, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    d = table(spark, sf, "documents").select("doc_id", "source")
    importance = F.when(F.col("quality") == 1, 0.9).when(F.col("quality") == 0, 0.2).otherwise(0.5)
    rel = F.coalesce(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")), F.concat(F.lit("user/"), F.col("user_id").cast("string")))
    return e.join(d, e.user_id == d.doc_id, "left").join(q, "doc_id", "left").select(rel.alias("rel"), "access", "last_access_ms", importance.alias("importance"))


ENTRIES = """entries as (select coalesce(d.source || '/' || d.doc_id, 'user/' || e.user_id) as rel, e.access, e.last_ms, case quality when 1 then 0.9 when 0 then 0.2 else 0.5 end::double as importance
  from (select user_id, count(*)::int as access, epoch_us(max(ts)) // 1000 as last_ms from events where event_type = 'click' group by 1) e left join documents d on d.doc_id = e.user_id
  left join (select doc_id, min(quality) as quality from labels group by 1) q on q.doc_id = d.doc_id)"""


def vector_of(spark: SparkSession, sf: str, vec_id: int = 0) -> list[float]:
    """The query vector: one row by its key."""
    return [float(x) for x in table(spark, sf, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]]


def messages(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    file = F.concat(F.lit("/threads/"), F.col("conv_id").cast("string"), F.lit(".jsonl"))
    return c.select(file.alias("file"), (F.col("turn") + 1).alias("line"), F.lit("thread").alias("kind"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 90).cast("int")), "yyyy-MM-dd").alias("ts"), "role", "text")
