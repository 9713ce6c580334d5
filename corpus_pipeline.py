"""Pipeline that makes training sequences of documents: see STAGES. Counted as part of the subpackage llm.

Each stage takes (spark, docs, sf_dir), docs being what the stage before has written and kept, and returns a DataFrame;
all but the last return the columns of documents. Null texts count as empty in every stage. Rows that repeat a kept
document wholly go in exact dedup; a document that the mix takes several times stands as many times in its result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from engramlake.llm import exact_dedup, mixing, packing, quality, queries, simhash
from engramlake.session import release, stage, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine predicts to be good."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the least doc_id."""
    return exact_dedup.deduplicate(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked near copies (five-word shingles, similarity 0.8 or more), the document with the least doc_id."""
    return simhash.near_deduplicate(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of at most 4096."""
    return packing.pack(packing.pieces(docs, queries.VOCABULARY))


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("simhash", simhash_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: A model is trained, so no SQL gives these rows; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result but the last written and read again; it goes when the next one is written
    (the last stage writes its pieces before it returns)."""
    docs, written = table(spark, sf_dir, "documents"), None
    for k, (name, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, f"pipeline-{name}")
        if written is not None:
            release(written)
        written = docs
    return docs
