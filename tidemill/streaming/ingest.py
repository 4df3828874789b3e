"""Incremental forms of the batch operators with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.lake import upsert
from ..sources.payloads import parse_records_payload
from ..specs import TableSpec


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    """Landed payload files as they come, one row each."""
    return spark.readStream.format("text").option("wholetext", True).load(path).select(F.col("value").alias("payload"))


def ingest_records(spark: SparkSession, landing: str, spec: TableSpec, checkpoint: str) -> StreamingQuery:
    """Upsert whatever has landed since the last run, then stop.

    Sources send their last days again and again. Rows that the table has already, whether
    sent once more or in a batch that is run again after a failure, are left out by ``upsert``,
    so only months with news are rewritten; a revision wins over what came before it.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = parse_records_payload(batch).withColumn("ingest_seq", F.lit(number).cast("long")).persist()
        upsert(batch.sparkSession, rows, spec, ["ingest_seq", "ingested_at_utc"], unchanged=("ingest_seq", "ingested_at_utc"))
        rows.unpersist()

    return read_landing(spark, landing).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_buckets(stream: DataFrame, ts: str = "ts", value: str = "demand_mwh", late: str = "3 days") -> DataFrame:
    """Tumbling days by series; rows up to ``late`` behind still count."""
    by = stream.withWatermark(ts, late).groupBy("series_key", F.window(ts, "1 day"))
    return by.agg(F.avg(value).alias("mean"), F.count(value).alias("n")).select("series_key", F.col("window.start").alias("day"), "mean", "n")


def trailing_week(stream: DataFrame, ts: str = "ts", value: str = "demand_mwh", late: str = "3 days") -> DataFrame:
    """Sliding seven-day windows that move by a day, made of daily sums.

    Each row counts in one day; only the days, one row a series, enter seven windows. As a
    stream in append mode a week is told once the watermark has passed its end.
    """
    days = stream.withWatermark(ts, late).groupBy("series_key", F.window(ts, "1 day")).agg(F.sum(value).alias("total"), F.count(value).alias("n"))
    by = days.groupBy("series_key", F.window(F.window_time("window"), "7 days", "1 day"))
    mean = F.sum("total") / F.nullif(F.sum("n"), F.lit(0))
    return by.agg(mean.alias("mean"), F.sum("n").alias("n")).select("series_key", F.col("window.end").alias("until"), "mean", "n")
