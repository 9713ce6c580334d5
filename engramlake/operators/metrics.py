"""Ranking quality: recall, precision, MRR and nDCG of ranked lists against relevant ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F


def ir_metrics(ranked: DataFrame, relevant: DataFrame, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """query, k, recall, precision, mrr, ndcg. ranked: (query, id, rank from 1); relevant: (query, id).

    An id that is ranked twice counts where it is first. Without relevant ids recall and nDCG are 1, the others 0."""
    unique = ranked.groupBy("query", "id").agg(F.min("rank").alias("_r"))
    unique = unique.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("_r", "id")))
    rel = relevant.select("query", "id").where("id is not null").distinct()
    hits = unique.join(rel, ["query", "id"]).select("query", "rank")
    queries = ranked.select("query").union(relevant.select("query")).distinct()
    size = rel.groupBy("query").agg(F.count("*").alias("n"))
    best = hits.groupBy("query").agg(F.min("rank").alias("first"))
    k = F.explode(F.array(*map(F.lit, ks))).alias("k")
    grid = queries.select("query", k)
    at = grid.join(hits, "query").where("rank <= k").groupBy("query", "k").agg(F.count("*").alias("hits"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least("k", F.col("n").cast("int")))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    out = grid.join(size, "query", "left").join(best, "query", "left").join(at, ["query", "k"], "left").fillna(0, ["n", "hits", "dcg"])
    none = F.col("n") == 0
    return out.select(
        "query", "k",
        F.when(none, 1.0).otherwise(F.col("hits") / F.when(none, 1).otherwise(F.col("n"))).alias("recall"),
        (F.col("hits") / F.col("k")).alias("precision"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.when(none, 1.0).otherwise(F.col("dcg") / ideal).alias("ndcg"),
    )


def macro(metrics: DataFrame, *by: str) -> DataFrame:
    """Means over queries."""
    return metrics.groupBy(*by, "k").agg(*(F.avg(c).alias(c) for c in ("recall", "precision", "mrr", "ndcg")))
