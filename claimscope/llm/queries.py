"""One whole-table query per operator, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.llm import bpe, conversations, hardneg, imi, langid, license, lm, packing, pii, quality, simhash, substring, warc
from claimscope.llm.common import table
from claimscope.llm.oracle import ORACLE  # noqa: F401  (part of the registration)

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op2_concat_cut_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, sf_dir, "documents"), WORD_BPE))


def op3_multi_index_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imi.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_subword_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.digests(pii.find(docs, pii.fit(docs)))


def op6_license_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"))


def op7_gph_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex().alias("fingerprint"), "component_id")


def op8_line_first_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "loss")


def op9_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.records(warc.round_trip(table(spark, sf_dir, "pages")))


def op10_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_BPE))


def op11_kronecker_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hardneg.mine(table(spark, sf_dir, "embeddings"), label=label)


def op12_four_russians_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations")), lost=F.col("lost"))


def op13_difference_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicate(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_backoff_lm, op2_concat_cut_packing, op3_multi_index_embeddings, op4_subword_langid, op5_boosted_pii, op6_license_compression, op7_gph_simhash, op8_line_first_quality, op9_warc_salvage, op10_forced_boundary_bpe,
    op11_kronecker_hard_negatives, op12_four_russians_repair, op13_difference_cover_dedup,
)}
