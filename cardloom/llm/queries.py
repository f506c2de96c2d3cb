"""The queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cardloom.llm import bpe, count_rtree, exact_dedup, hamerly, langid, matroska, packing, prefix_trie, quality, simhash, substring_dedup, toxicity, warc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_digests(_documents(spark, sf_dir))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_documents(spark, sf_dir))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return quality.scored(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op5_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_digests(_documents(spark, sf_dir))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(_documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return toxicity.scored(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_documents(spark, sf_dir))


def op9_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.audited(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_documents(spark, sf_dir))


def op11_hamerly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamerly.clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_count_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_rtree.similarity_classes(_documents(spark, sf_dir))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_bpe": op2_bpe,
    "op3_packing": op3_packing,
    "op4_quality": op4_quality,
    "op5_matroska": op5_matroska,
    "op6_langid": op6_langid,
    "op7_toxicity": op7_toxicity,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_warc_fixity": op9_warc_fixity,
    "op10_simhash": op10_simhash,
    "op11_hamerly": op11_hamerly,
    "op12_count_rtree": op12_count_rtree,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES = {
    "op1_substring_dedup": substring_dedup.ORACLE_SQL,
    "op8_exact_dedup": exact_dedup.ORACLE_SQL,
    "op9_warc_fixity": warc.ORACLE_SQL,
    "op11_hamerly": hamerly.ORACLE_SQL,
    "op12_count_rtree": count_rtree.ORACLE_SQL,
    "op13_prefix_trie": prefix_trie.ORACLE_SQL,
}
