"""The operators' queries over the shared tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from engramlake.llm import exact_dedup, html_text, licenses, mixing, packing, phrases, quality, records, simhash, warc
from engramlake.session import table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels and places of base phrases for every document."""
    return licenses.scan(table(spark, sf_dir, "documents")).drop("places")


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written as framed records in order of doc_id and read back."""
    return records.read(records.write(table(spark, sf_dir, "documents"), VOCABULARY)).drop("shard")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mix by source takes, and in which slot first."""
    return mixing.mix(table(spark, sf_dir, "documents")).drop("slots")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's group of equal texts and the one that stays."""
    return exact_dedup.decide(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, and their components."""
    return simhash.components(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives, normalised and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return phrases.compare(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens in sequences of at most 4096."""
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), VOCABULARY))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_token_records, op3_mixing, op4_exact_dedup, op5_simhash, op6_quality, op7_warc, op8_html_text, op9_phrase_fingerprints, op10_best_fit_packing)}
ORACLE = {"op1_license_scan": licenses.oracle(), "op3_mixing": mixing.ORACLE, "op4_exact_dedup": exact_dedup.ORACLE, "op7_warc": warc.ORACLE}
