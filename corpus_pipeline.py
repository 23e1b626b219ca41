"""A training corpus from raw documents: quality rules, near-dedup, substring dedup, pseudonyms, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of documents. ``run`` writes each stage as Parquet into the shared folder and reads
it again, so a lost executor costs one stage at most. Stages take whole texts of any length, empty tables
(and give empty ones), and columns of any names, which they carry along unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexitide.llm import minhash, packing, pii, quality, substring
from lexitide.llm.common import Scratch, temporary


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule. Null and empty texts have no words and go; repeated rows stay or go together."""
    return quality.keep(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more, that with the smallest doc_id.

    Of rows with equal doc_id one stays. Texts without words are linked with nothing and stay, as do rows
    without doc_id.
    """
    return minhash.drop_duplicates(docs, size=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the spans that an earlier document, or an earlier place, holds. Every row stays: a null text null, one that repeats wholly empty."""
    return substring.remove_repeats(docs).select(*docs.columns)


def hide_people(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms in place of personal data, under the session's key (pii.KEY_SETTING). Every row stays; null and empty texts do not change."""
    return pii.with_pseudonyms(docs, pii.key_of(spark)).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document with its place in a training sequence; a null or empty text is its closing id, a repeated row packs again."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("quality_rules", keep_good),
    ("minhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("pii_pseudonyms", hide_people),
    ("packing", pack_sequences),
]

#: Signatures and a tokeniser are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        with temporary():  # what a stage stored on its way goes once its result is stored
            docs = scratch.save(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
