"""Corpus pipeline: documents to packed training sequences.

Stages, each on all rows its predecessor kept: language ID (documents whose
language is rejected go), quality rules (failing lines are removed, rejected
documents go), SimHash near-dedup (of each group the document with the
smallest id stays), personal data (selected spans are redacted), packing
(pieces of 2048-token sequences).

All stages but the last return the columns of ``documents`` (``doc_id, text,
lang, source, n_chars``; ``n_chars`` follows a changed text).  Further columns
of the input are not carried.  Rows are joined to an operator's decisions by a
row number of the stage's own input, so repeated and null ids are harmless: of
rows that repeat a kept id and fall in one group, one stays.  Null texts have
no language and go in the first stage; empty inputs give empty outputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.llm import langid, packing, pii, quality, simhash
from claimscope.llm.common import ship, table, written
from claimscope.llm.queries import WORD_BPE

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is accepted; the model is fitted on this
    stage's labelled rows that are not held out."""
    ship(spark)
    docs = docs.select(COLUMNS)
    model = langid.train(docs.where(~langid.held_out()))
    # The columns travel with the text, so the decision needs no join.
    return langid.predict(docs, model, carry=tuple(COLUMNS)).where("not rejected").select(COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that pass, without their failing lines."""
    judged = quality.judge(docs.select(F.struct(*COLUMNS).alias("row"), "text"), "row")
    # A filter would be pushed below the projection and judge every text again;
    # taking the kept rows out of an array is evaluated once.
    kept = judged.select(F.explode(F.filter(F.array(F.struct("row", "cleaned", "kept")), lambda x: x.kept)).alias("j"))
    kept = kept.select("j.row", "j.cleaned")
    return kept.select(
        "row.doc_id", F.col("cleaned").alias("text"), "row.lang", "row.source",
        F.when(F.col("cleaned") == F.col("row.text"), F.col("row.n_chars")).otherwise(F.length("cleaned")).cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component keep one document: the smallest id's."""
    ship(spark)
    rows = written(docs.select(COLUMNS).withColumn("__row", F.monotonically_increasing_id()), "dedup-input")
    # Ids first, row numbers among equal ids: the smallest (id, row) stays.
    keyed = rows.select(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__row").alias("key"), "text")
    found = simhash.near_duplicates(keyed, "key")
    keep = found.where("key = component_id").select(F.col("key.__row").alias("__row"))
    return rows.join(keep, "__row").select(COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Redact the selected spans in every text."""
    docs = docs.select(COLUMNS)
    found = pii.find(docs.select(F.struct(*COLUMNS).alias("row"), "text"), pii.fit(docs), "row")
    out = found.select("row", F.col("text").alias("__old"), pii.redacted(F.col("text"), F.col("spans")).alias("text"))
    same = F.col("text").eqNullSafe(F.col("__old"))
    return out.select("row.doc_id", "text", "row.lang", "row.source",
                      F.when(same, F.col("row.n_chars")).otherwise(F.length("text")).cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    ship(spark)
    return packing.digests(packing.pack(docs, WORD_BPE))


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("simhash_near_dedup", near_dedup),
          ("personal_data", personal_data), ("packing", pack)]

# The trained language model, the boosted trees and the tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read
    again before the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
