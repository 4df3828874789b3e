"""The drift timeline kept as a table of day summaries, to which a run adds its new days.

A day's values fall into bins whose bounds the reference window sets. Counts of days can
be added, so what is stored once is never counted again: a run summarises the rows of new
days, and the timeline is read from the summaries. The reference's bins have a version;
summaries made with others are not mixed with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..specs import DETERMINISTIC, Thresholds
from . import drift
from .statistics import described


class OtherBins(ValueError):
    """The stored summaries were made with other bins; the timeline has to be begun anew."""


def _counts(scored: DataFrame, features: list[str]) -> DataFrame:
    return drift.counted_columns(scored, features, by_day=True).where(~F.col("column").isin(list(DETERMINISTIC)))


def begin(spark: SparkSession, path: str, reference: DataFrame, features: list[str], version: str, t: Thresholds = Thresholds()) -> None:
    """Fix the bins by the rows of the ``reference`` window and forget all days; ``version`` names these bins."""
    counts = _counts(reference.where("window = 'reference'"), features)
    plan = described(drift.without_days(counts), ["series_key"], t).select("series_key", "column", "levels", "edges")
    plan.withColumn("version", F.lit(version)).write.mode("overwrite").parquet(f"{path}/plan")
    plan = spark.read.parquet(f"{path}/plan")
    drift.reference_bins(counts, plan).write.mode("overwrite").parquet(f"{path}/reference")
    for name, shape in (("days", "series_key string, column string, bin int, n long, day date"), ("errors", "series_key string, window string, day_n long, mae double, day date")):
        spark.createDataFrame([], shape).write.mode("overwrite").parquet(f"{path}/{name}")


def extend(spark: SparkSession, path: str, scored: DataFrame, features: list[str], version: str) -> None:
    """Add the days of ``scored`` (whole days; one that is there already is replaced)."""
    plan = spark.read.parquet(f"{path}/plan")
    held = plan.select("version").first()
    if held is None or held["version"] != version:
        raise OtherBins(f"the summaries in {path} belong to bins {held and held['version']}, not {version}")
    for name, rows in (("days", drift.day_summary(_counts(scored, features), plan).drop("n_ref")), ("errors", drift.day_errors(scored))):
        rows.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{path}/{name}")


def read(spark: SparkSession, path: str, t: Thresholds = Thresholds(), days: int = 7) -> DataFrame:
    """The timeline of all days stored so far."""
    at = lambda name, shape: spark.read.schema(shape).parquet(f"{path}/{name}")
    summaries = at("days", "series_key string, column string, bin int, n long, day date")
    errors = at("errors", "series_key string, window string, day_n long, mae double, day date")
    return drift.timeline(summaries, errors, spark.read.parquet(f"{path}/reference"), t, days)
