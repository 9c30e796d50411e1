"""Streams: repeats within the watermark, and counts equal to a batch."""

import datetime as dt

from pyspark.sql import functions as F

from sievework.streaming import deliveries as D


def table(spark, folder, n=40):
    start = dt.datetime(2025, 1, 1)
    rows = [(i % 25, "p" if i % 3 else None, start + dt.timedelta(hours=5 * (i % 25))) for i in range(n)]
    spark.createDataFrame(rows, "finding_id long, pillar string, emitted_at timestamp_ntz").write.parquet(f"{folder}/findings.parquet")


def test_windows_equal_batch(spark, tmp_path):
    table(spark, tmp_path)
    got = D.stream_daily_counts(spark, str(tmp_path))
    batch = spark.read.parquet(f"{tmp_path}/findings.parquet").groupBy(F.to_date("emitted_at").alias("day"), "pillar").agg(F.count(F.lit(1)).alias("n"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in batch.collect()}


def test_repeats_are_dropped(spark, tmp_path):
    table(spark, tmp_path)
    once = D.delivered_once(D.stream_of(spark, str(tmp_path), "findings"), "finding_id", "emitted_at", "30 days")
    assert D.run_to_table(once, "once", "append").count() == 25
