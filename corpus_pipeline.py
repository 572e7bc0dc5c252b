"""From raw documents to packed sequences: five stages, each one operator of plumbline.llm.

Every stage but the last returns the columns of documents: language ID drops documents it can't assign (no text or no
letter) and fills in a missing label, exact dedup keeps one row a text, SimHash near-dedup (shingles of five words, two
bits or a similarity of 0.8) keeps one of each group, mixing repeats or leaves out documents by their source's target, and packing cuts and places
what is left. Stages take empty tables, nulls in any column and further columns, which they carry along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import exact_dedup, language_id, mixing, packing, simhash
from plumbline.llm.common import Scratch, packed


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = packed(docs).select(F.col("_row.text").alias("text"), "_row")
    known = language_id.identify(rows, language_id.fit(docs)).filter(F.col("lang_pred") != language_id.UND)
    lang = F.coalesce("_row.lang", "lang_pred").alias("lang")
    return known.select(*[lang if c == "lang" else F.col(f"_row.`{c}`") for c in docs.columns])


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, words=5, similarity=0.8)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_documents(docs)


STAGES = [
    ("language ID", language_stage),
    ("exact dedup", exact_stage),
    ("SimHash near-dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL has no trained classifier, fingerprints or packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared folder, and kept there until the next
    one is written."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.save(docs)
            scratch.keep(docs)
    return docs
