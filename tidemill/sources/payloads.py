"""Landed JSON payloads to tidy rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import clean, lenient, parse_hour

RECORDS = "struct<response:struct<data:array<struct<period:string,respondent:string,value:string,`value-units`:string>>>>"
#: forecast variable in a payload -> column (fixed values)
FORECAST_VARIABLES = {
    "temperature_2m": "temperature_c",
    "relative_humidity_2m": "humidity_pct",
    "dew_point_2m": "dewpoint_c",
    "wind_speed_10m": "wind_kmh",
    "cloud_cover": "cloud_pct",
}
ARCHIVED_SUFFIX = "_previous_day1"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed file: ``payload``."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("payload"))


def records(pages: DataFrame, source: str = "api", ingested_at: Column | None = None) -> DataFrame:
    """Every record of the pages, with ``demand_mwh`` NULL where the value is no number."""
    rows = pages.select(F.inline(F.from_json("payload", RECORDS)["response"]["data"]))
    return rows.select(
        F.col("respondent"),
        parse_hour("period").alias("timestamp_utc"),
        lenient("value").alias("demand_mwh"),
        F.coalesce(F.col("value-units"), F.lit("megawatthours")).alias("units"),
        F.lit(source).alias("source"),
        (F.current_timestamp() if ingested_at is None else ingested_at).alias("ingested_at_utc"),
    )


def parse_records_payload(pages: DataFrame, source: str = "api", ingested_at: Column | None = None) -> DataFrame:
    """The records that hold a value. ``dropped_records`` counts the others."""
    return records(pages, source, ingested_at).where("demand_mwh is not null")


def dropped_records(pages: DataFrame) -> DataFrame:
    return records(pages).agg(F.count("*").alias("rows_read"), F.count_if(F.col("demand_mwh").isNull()).alias("rows_dropped"))


def _columnar(pages: DataFrame, names: dict[str, str]) -> DataFrame:
    """Parallel arrays under ``hourly`` to rows; an absent array gives NULLs, not no rows."""
    shape = "struct<hourly:struct<time:array<string>," + ",".join(f"`{n}`:array<double>" for n in names) + ">>"
    carried = [c for c in pages.columns if c != "payload"]
    h = F.from_json("payload", shape)["hourly"]
    zipped = F.arrays_zip(F.coalesce(h["time"], F.array().cast("array<string>")).alias("time"), *[F.coalesce(h[n], F.array().cast("array<double>")).alias(c) for n, c in names.items()])
    rows = pages.select(*carried, F.inline(zipped))
    return rows.select(*carried, parse_hour("time").alias("timestamp_utc"), *[clean(c).alias(c) for c in names.values()]).where("timestamp_utc is not null")


def parse_columnar_payload(pages: DataFrame, now: Column | None = None, source: str = "observed") -> DataFrame:
    """Observed temperature by site (``pages`` has a ``site`` column); hours up to ``now`` are observed."""
    rows = _columnar(pages, {"temperature_2m": "temperature_c"}).where("temperature_c is not null")
    return rows.withColumns({"is_observed": F.col("timestamp_utc") <= (F.current_timestamp() if now is None else now), "source": F.lit(source)})


def parse_forecast_payload(pages: DataFrame, archived: bool, source: str = "forecast") -> DataFrame:
    """Five forecast variables by site; rows without a temperature are dropped."""
    suffix = ARCHIVED_SUFFIX if archived else ""
    rows = _columnar(pages, {n + suffix: c for n, c in FORECAST_VARIABLES.items()}).where("temperature_c is not null")
    return rows.withColumns({"lead": F.lit("day1" if archived else "current"), "source": F.lit(source)})


def verify_entity(facets: DataFrame, code: str) -> DataFrame:
    """One row: ``found``, and ``near`` (sorted ids that contain the code or lie within it) where it is not."""
    i, c = F.upper("id"), F.lit(code.upper())
    near = F.contains(i, c) | F.contains(c, i)
    out = facets.agg(F.coalesce(F.bool_or(i == c), F.lit(False)).alias("found"), F.sort_array(F.collect_set(F.when(near, F.col("id")))).alias("near"))
    return out.withColumn("near", F.when(F.col("found"), F.array().cast("array<string>")).otherwise(F.col("near")))
