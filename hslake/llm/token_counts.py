"""Token counts of documents through a cache of digests.

A text's key is the SHA-256 of its normalised content beside the digest of the tokenizer's file and library version. Normalising changes no count: for
tokenizers that drop white space every run of ASCII white space becomes one space, for others the text stays. Keys are joined to the counts
stored in the cache (a Parquet table in a shared folder, partitioned by version); only distinct texts that it lacks are encoded, and their counts
appended. A second run over the same texts encodes nothing.

Texts stay where they are read whenever they can: a digest that occurs once and isn't stored is encoded in the scan itself, of repeated ones the row of
least id is shuffled and one text kept by digest. What is broadcast for that (stored and repeated digests, or the missing ones) is measured; if
neither fits, texts travel once by digest, partially aggregated. A digest that holds over a thousandth of all rows gets its count by a
broadcast of at most 1,000 rows, so no task gathers a hot text's copies.

Null text: empty, no tokens. Empty and white texts are counted like others. Very long texts: whole, in slices that no token crosses. Repeated rows,
equal texts and null ids: every row gets its count. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _tokens
from ._spark import BROADCAST_BYTES, cut, measured, scratch_folder
from ._text import chunks

CACHE = "digest binary, n_tokens long, tokenizer string"
HOT_SHARE = 1000
#: Bytes of text whose distinct pieces are looked up together.
CHUNK = 1 << 22


def normalised(text, drops_white: bool):
    """A column of the text whose digest is the key."""
    return F.trim(F.regexp_replace(text, "[ \\t\\n\\x0B\\f\\r]+", " ")) if drops_white else text


def with_hot(rows: DataFrame, classes: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` joined to ``classes``, one row a key; classes of over a thousandth of all rows (1,000 at most) are broadcast, so that none meets in one task."""
    total = classes.agg(F.sum(size)).first()[0] or 0
    hot = cut(classes.where(F.col(size) * HOT_SHARE > total).drop(size), "hot")
    there = F.broadcast(hot)
    many = rows.join(there, key)
    return many.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(classes.where(F.col(size) * HOT_SHARE <= total).drop(size), key))


def encoded(texts: DataFrame, tokenizer: str) -> DataFrame:
    """(digest, n_tokens) of (digest, text)."""

    def run(batches):
        encoder = _tokens.encoder((tokenizer,))
        for chunk in chunks(batches, most=CHUNK):
            counts = encoder.counts_in(chunk.data, chunk.offsets)
            yield pa.RecordBatch.from_arrays([chunk.batch.column(0), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")


def missing_texts(keyed: DataFrame, known: DataFrame) -> DataFrame:
    """(digest, text): one text of every digest of ``known`` (digest, copies, least, n_tokens) whose count is null, from ``keyed`` (id, digest, text)."""
    missing = known.where("n_tokens is null")
    repeated = missing.where("copies > 1").select("digest", "least")
    other = known.where("n_tokens is not null or copies > 1").select("digest")
    if measured(other)[1] + measured(repeated)[1] <= BROADCAST_BYTES:
        once = keyed.join(F.broadcast(other), "digest", "left_anti").select("digest", "text")
        return once.union(_one_text(keyed, repeated))
    if measured(missing.select("digest", "least"))[1] <= BROADCAST_BYTES:
        return _one_text(keyed, missing.select("digest", "least"))
    every = keyed.groupBy("digest").agg(F.first("text").alias("text"))
    return every.join(missing.select("digest"), "digest", "left_semi")


def _one_text(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of least id of measured few digests; equal rows are combined before and after the shuffle."""
    least = F.broadcast(wanted.select(F.col("digest").alias("d"), "least"))
    return keyed.join(least, (F.col("digest") == F.col("d")) & F.col("id").eqNullSafe(F.col("least"))).groupBy("digest").agg(F.first("text").alias("text"))


def count_tokens(docs: DataFrame, *, cache: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; counts that ``cache``, a path that all executors share, lacks are added to it."""
    spark, version = docs.sparkSession, _tokens.version(tokenizer)
    drops_white = _tokens.open_kind(tokenizer).drops_white
    spark.createDataFrame([], CACHE).write.mode("append").partitionBy("tokenizer").parquet(cache)

    def stored() -> DataFrame:
        """Two jobs at once may have added the same digest; their counts are equal."""
        kept = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version)
        return kept.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = rows.select("id", F.unhex(F.sha2(normalised(F.col("text"), drops_white), 256)).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"), "text")
    keys = cut(keyed.drop("text"), "keys")
    classes = keys.groupBy("digest").agg(F.count("*").alias("copies"), F.min("id").alias("least"))
    known = cut(classes.join(stored(), "digest", "left"), "known")
    new = encoded(missing_texts(keyed, known), tokenizer)
    new.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    counts = known.select("digest", "copies").join(stored(), "digest")
    return with_hot(keys, cut(counts, "counts"), "digest", "copies").select("id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op12_token_counts(spark, sf_dir: str) -> DataFrame:
    """Every call has a cache of its own, so that no count is kept from another table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cache = f"{scratch_folder(spark)}/token-cache-{np.random.default_rng().integers(1 << 62):x}"
    return count_tokens(docs, cache=cache, tokenizer=default_tokenizer()).withColumnRenamed("id", "doc_id")


QUERIES = {"op12_token_counts": op12_token_counts}
ORACLES: dict[str, str] = {}
