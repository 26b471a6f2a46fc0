"""A corpus pipeline over ``documents``: quality, near-dedup, personal data,
mixing and packing, each stage written and read again by the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import mixing, packing, pii, quality, simhash, tokens
from factloom.llm.common import crc_mod, table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 3) != 1)
    return quality.keep_good(docs, model)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that of the smallest id, then of the
    smallest digest of the text.

    Rows are told apart by id and text: two texts of one id are judged apart, and of
    rows equal in both one stays.  Rows of null id stay."""
    found = simhash.near_copies(docs, similarity=0.8)
    rows = written(found.groupBy("group", "id", "digest").agg(F.count("*").alias("n")), "pipeline-near-copies")
    first = rows.groupBy("group").agg(F.min(F.struct("id", "digest")).alias("first"))
    key = [F.col("id").alias("gone_id"), F.col("digest").alias("gone_digest")]
    same = (F.col("doc_id") == F.col("gone_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("gone_digest"))
    gone = rows.join(first, "group").where((F.col("id") != F.col("first.id")) | (F.col("digest") != F.col("first.digest"))).select(*key)
    kept = docs.join(gone, same, "left_anti")
    again = rows.where("n > 1").select(*key)
    if again.isEmpty():
        return kept
    one = kept.join(again, same, "left_semi").withColumn("__digest", F.xxhash64(F.col("text").cast("string"))).dropDuplicates(["doc_id", "__digest"])
    return kept.join(again, same, "left_anti").union(one.select(*docs.columns))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.mask(docs, pii.fit(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated, up to a quarter more, towards an even mixture."""
    sizes = written(tokens.count_tokens(docs, out="mixing_tokens").select("doc_id", "source", "mixing_tokens"), "pipeline-tokens")
    marked = docs.withColumn("mixing_tokens", F.when(F.length("text") > 0, 1).otherwise(0))
    return mixing.mix(marked, "mixing_tokens", evenness=0.5, most_passes=1.25, sizes=sizes).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return packing.pack(docs, capacity=2048).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality", quality_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Trained models have no SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
