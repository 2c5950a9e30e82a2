"""The corpus pipeline: each stage takes (spark, docs, sf_dir); its result is written and read again as the next one's docs.

quality classifier (rejected documents go) -> MinHash near-duplicates (one document of each group stays) -> repeated substrings are cut
out of the texts -> sources are mixed to target weights (documents that are not drawn go) -> texts are encoded. Stages before the last
return the columns of documents, in no more partitions than their size is worth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.llm import bpe, minhash, mixing, quality, suffix
from cuemill.llm.common import cut_lineage, read_table, useful_partitions

PASSAGE_WORDS = 50


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs.select("doc_id", "text"), read_table(spark, sf_dir, "labels"))
    return model.score(docs, into="__score").filter(F.col("__score") >= quality.THRESHOLD).drop("__score").coalesce(useful_partitions(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of one id and one text are one document, of which the least row stays; rows that share an id but not a text all stay."""
    gone = minhash.components(docs.select("doc_id", "text")).filter("not kept").select("doc_id").distinct()
    text = F.sha2(F.col("text").cast("binary"), 256)
    rows = docs.join(gone, "doc_id", "left_anti").groupBy(F.col("doc_id").alias("__id"), text.alias("__text"))
    return rows.agg(F.min(F.struct(*docs.columns)).alias("__row")).select("__row.*").coalesce(useful_partitions(docs))


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over PASSAGE_WORDS words that repeat go, and repeated stretches of 400 bytes, whatever their words; of a character that
    a cut splits, the rest goes too. n_chars is counted anew."""
    out = suffix.remove_repeats(docs, words=PASSAGE_WORDS)
    valid = F.make_valid_utf8(F.col("kept").cast("string"))
    whole = F.when(F.col("text").contains("�"), valid).otherwise(F.replace(valid, F.lit("�"), F.lit("")))
    out = out.withColumn("text", F.when(F.size("repeats") > 0, whole).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    return out.select(docs.columns).coalesce(useful_partitions(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).filter("drawn").select(docs.columns).coalesce(useful_partitions(docs))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe.encode(docs, bpe.default_vocabulary(), step=3 << 19)  # beside what the stages before have left in the workers
    return coded.withColumn("n_tokens", F.size("token_ids").cast("long")).select("doc_id", "lang", "source", "n_tokens", "token_ids").coalesce(useful_partitions(docs))


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("suffix_dedup", suffix_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut_lineage(docs)
    return docs
