"""A corpus pipeline over `documents`: language ID, exact dedup, SimHash near-dedup, substring dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns the columns of
`documents`; the last returns where every piece of every document goes. Empty tables pass through, nulls in any column
are allowed, and rows are told apart by their texts: what a row shares its id with doesn't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.llm import exact_dedup, langid, near_texts, packing, substring_dedup
from cardloom.llm.shared import discard, scratch, staged

#: Documents go of whose letters a smaller share is in identified languages, one or several; clean documents have 1.
LEAST_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those mostly in scripts that no learned language has."""
    return langid.confident(docs, langid.fit(docs), least=LEAST_SHARE)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal documents, leaves one row: the one that `exact_groups` keeps."""
    return exact_dedup.deduped(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts that share at least 0.8 of their five-word shingles, leaves one row, of the smallest id."""
    return near_texts.near_deduped(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the words of repeated windows from the texts; `n_chars` follows."""
    out = substring_dedup.dedup_texts(docs)
    changed = F.col("n_removed") > 0
    columns = {"text": F.col("kept_text"), "n_chars": F.when(changed, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {"text": F.col("kept_text")}
    return out.withColumns(columns).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every piece of every document in a sequence."""
    return packing.packed(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("simhash", near),
    ("substring_dedup", substrings),
    ("packing", packed),
]

# Language models and the order-dependent packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each written as Parquet and read again by the next; what a stage leaves besides is deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with scratch() as made:
            docs = staged(stage(spark, docs, sf_dir))
            made.pop()
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
