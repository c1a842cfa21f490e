"""Structured Streaming jobs: report intake, duplicates, live counts, sessions and the versioned merge."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hslake.sources.shared import shared_folder

REPORT_SCHEMA = "id string, provider string, pid long, timestamp_us long, role string, success boolean, protocol string"
REPORT_BYTES = 2 << 20
#: How far the rows that end a replay lie ahead.
AHEAD_US = 30 * 86_400_000_000


def report_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New JSON report files of a folder, one report a file, up to 2 MiB each; larger ones are left out."""
    rows = spark.readStream.schema(REPORT_SCHEMA).option("multiLine", True).json(folder)
    return rows.where(F.col("_metadata.file_size") <= REPORT_BYTES).withColumn("at", F.timestamp_micros("timestamp_us"))


def validated(reports: DataFrame) -> DataFrame:
    """Adds the reasons why a report is refused; an empty list accepts it."""
    rules = [(F.col("id").isNull() | (F.col("id") == ""), "id is missing"), (~F.coalesce(F.col("pid").between(1, 4294967295), F.lit(False)), "pid is out of range"), (~F.coalesce(F.col("role").isin("Client", "Server"), F.lit(False)), "role is unknown"), (F.col("success").isNull(), "success is missing"), (F.col("timestamp_us").isNull(), "time is missing")]
    return reports.withColumn("reasons", F.filter(F.array(*[F.when(t, r) for t, r in rules]), lambda r: r.isNotNull()))


def deduplicated(reports: DataFrame, delay: str = "10 minutes") -> DataFrame:
    return reports.withWatermark("at", delay).dropDuplicatesWithinWatermark(["id"])


def windows(rows: DataFrame, at: str, width: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """(start_us, n) of each window once the watermark has passed it; with ``slide``, windows overlap and a row leaves them one by one."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    return rows.withWatermark(at, delay).groupBy(window.alias("w")).agg(F.count("*").alias("n")).select(F.unix_micros("w.start").alias("start_us"), "n")


def replayed(spark: SparkSession, rows: DataFrame, at_us: str, job, schema: str, slices: int = 2) -> DataFrame:
    """What a streaming ``job`` appends when ``rows`` arrive in slices of time, the query stopped and started again from its checkpoint after each of them.

    ``job`` gets the stream with ``at``, the time of ``at_us`` (microseconds). Rows far ahead of all others, with nulls beside their time, end the replay so that every window closes; what they
    lead to lies in the future and is left out by the caller's bound. An empty table gives no row. Slices are written by as many tasks as the table has.
    """
    folder = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    last = rows.agg(F.max(at_us)).first()[0]
    if last is None:
        return spark.createDataFrame([], schema)
    cuts = [int(c) for c in rows.approxQuantile(at_us, [k / slices for k in range(1, slices)], 0.01)]
    parts = [rows.where((F.lit(True) if low is None else F.col(at_us) >= low) & (F.lit(True) if high is None else F.col(at_us) < high)) for low, high in zip([None, *cuts], [*cuts, None])]
    ends = [spark.createDataFrame([(last + AHEAD_US + k,)], f"{at_us} long").select(*[F.col(at_us) if f.name == at_us else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema]) for k in range(2)]
    for part in parts + ends:
        part.write.mode("append").parquet(f"{folder}/rows")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/rows").withColumn("at", F.timestamp_micros(at_us))
        job(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out")


def live_counts(rows: DataFrame, at: str = "at", width: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    return rows.withWatermark(at, delay).groupBy(F.window(at, width)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sliding_counts(rows: DataFrame, at: str = "at", delay: str = "10 minutes") -> DataFrame:
    """Counts of the last hour, renewed each minute, so that a row's leaving shows."""
    return rows.withWatermark(at, delay).groupBy(F.window(at, "60 minutes", "1 minute")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(rows: DataFrame, keys: list[str], at: str = "at", gap: str = "120 seconds", delay: str = "10 minutes") -> DataFrame:
    """Rows of a key not more than ``gap`` apart; the last row's time, not the window's end, closes a session."""
    out = rows.withWatermark(at, delay).groupBy(*keys, F.session_window(at, gap)).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))
    return out.drop("session_window")


def merge_version(folder: str, key: list[str], order: str):
    """A ``foreachBatch`` function that writes version directories, the newest row of each key winning; a repeated batch id rewrites its own version."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("_v", F.lit(batch_id))
        if batch_id > 0:
            rows = rows.unionByName(spark.read.parquet(f"{folder}/v={batch_id - 1}").withColumn("_v", F.lit(batch_id - 1)))
        latest = rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in key]), F.struct(order, "_v")).alias("r"))
        latest.select(*key, "r.*").drop("_v").write.mode("overwrite").parquet(f"{folder}/v={batch_id}")

    return merge
