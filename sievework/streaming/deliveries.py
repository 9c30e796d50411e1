"""Findings as a stream: repeats dropped by key within the watermark, counts per window, and runs as micro-batches."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.shared import forget_later, shared_folder


def stream_of(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's files as a stream. Timestamps without zone become such with one, as watermarks need."""
    path = os.path.join(folder, f"{name}.parquet")
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    rows = reader.parquet(path) if os.path.isdir(path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    zoned = {f.name: F.col(f.name).cast("timestamp") for f in schema.fields if f.dataType.simpleString() == "timestamp_ntz"}
    return rows.withColumns(zoned)


def delivered_once(stream: DataFrame, key: str, when: str, delay: str) -> DataFrame:
    """The first delivery of each key; the state of a key is dropped when the watermark has passed."""
    return stream.withWatermark(when, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, when: str, window: str, delay: str, *keys: str) -> DataFrame:
    """Rows per window and key. With a watermark, late rows within ``delay`` still count and closed windows leave the
    state, so that it does not grow with the stream."""
    return stream.withWatermark(when, delay).groupBy(F.window(when, window).alias("_w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("_w.start").alias("window_start"), *keys, "n")


def bursts(stream: DataFrame, when: str, gap: str, delay: str, *keys: str) -> DataFrame:
    """Sessions of a key: rows that follow each other by less than ``gap``."""
    grouped = stream.withWatermark(when, delay).groupBy(F.session_window(when, gap).alias("_w"), *keys)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(F.col("_w.start").alias("burst_start"), F.col("_w.end").alias("burst_end"), *keys, "n")


def run_to_table(counted: DataFrame, label: str, mode: str = "complete") -> DataFrame:
    """Runs a query over all that is there now and returns its result as a table in the shared folder. In complete mode
    every batch replaces the table, so that windows which are still open are in it."""
    spark = counted.sparkSession
    base = f"{shared_folder(spark).rstrip('/')}/stream-{label}-{os.urandom(6).hex()}"
    forget_later(spark, base)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/out")

    query = counted.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/state").foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(counted.schema).parquet(f"{base}/out")


def stream_daily_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Findings per day and pillar, counted as a stream."""
    counted = windowed_counts(stream_of(spark, folder, "findings"), "emitted_at", "1 day", "30 days", "pillar")
    return run_to_table(counted, "daily").select(F.to_date("window_start").alias("day"), "pillar", "n")


def stream_bursts(spark: SparkSession, folder: str) -> DataFrame:
    """Bursts of findings per repository: with pauses under six hours."""
    counted = bursts(stream_of(spark, folder, "findings"), "emitted_at", "6 hours", "30 days", "repo")
    return run_to_table(counted, "bursts").groupBy("repo").agg(F.count(F.lit(1)).alias("n_bursts"), F.sum("n").alias("n_findings"), F.max("n").alias("largest"))


QUERIES = {"stream_daily_counts": stream_daily_counts, "stream_bursts": stream_bursts}
SQL = {
    "stream_daily_counts": "SELECT emitted_at::DATE AS day, pillar, count(*) AS n FROM findings GROUP BY ALL",
    "stream_bursts": """WITH l AS (SELECT repo, emitted_at, lag(emitted_at) OVER (PARTITION BY repo ORDER BY emitted_at) AS before FROM findings WHERE emitted_at IS NOT NULL),
        b AS (SELECT repo, sum(CASE WHEN before IS NULL OR emitted_at >= before + INTERVAL 6 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY repo ORDER BY emitted_at ROWS UNBOUNDED PRECEDING) AS burst FROM l),
        c AS (SELECT repo, burst, count(*) AS n FROM b GROUP BY ALL)
        SELECT repo, count(*) AS n_bursts, sum(n)::BIGINT AS n_findings, max(n) AS largest FROM c GROUP BY repo""",
}
