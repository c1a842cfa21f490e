"""Cleaning and packing of a document corpus: five stages, each written as Parquet and read again as the next one's documents.

For every stage: rows of null id are judged by their text and stay unless their own text is rejected; null and empty texts have too few words for the
quality rules; very long texts are read whole; repeated rows are judged alike, and the near-duplicate stage keeps one of them; other columns of
any name go through; an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, jaccard, packing, quality, suffix_dedup
from ._spark import cut, join_measured, scratch_folder, unused


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rules and the risk-controlled rules keep, each by its own text and language; ties (repeated rows) are judged alike."""
    columns = docs.columns
    row = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "lang", "text")]
    one, two = unused("row_key", columns), unused("row_check", columns)
    keyed = docs.withColumns({name: F.xxhash64(F.lit(k), F.col("doc_id").isNull(), F.col("lang").isNull(), *row) for k, name in enumerate((one, two))})
    judged = quality.quality_rules(keyed.select("doc_id", "lang", "text", one, two), spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=(one, two))
    bad = cut(judged.where("not kept").select(one, two).distinct(), "rejected")
    return join_measured(keyed, bad, [one, two], "left_anti").select(columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more: the one of least id; null ids stay."""
    return jaccard.keep_one_per_group(docs).select(docs.columns)


def repeated_string_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the bytes that a 400-byte string occurring elsewhere covers; n_chars follows the text.

    A character that a cut has broken goes as a whole; a null text stays null.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    out = suffix_dedup.remove_repeats(docs, as_text=True, carry=others)
    made = {"doc_id": F.col("id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return out.select(*[(made[c] if c in made else F.col("carried").getField(c)).alias(c) for c in docs.columns])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    return decontam.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents with the sequence and place of each."""
    return packing.pack(docs, tokenizer=packing.default_tokenizer()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_strings", repeated_string_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The latent search can't be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{scratch_folder(spark)}/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
