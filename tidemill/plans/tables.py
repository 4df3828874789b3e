"""Series, sites, payloads and scored rows derived from the given tables, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.core import clean
from ..operators.backtest import add_errors
from ..operators.design import lagged
from ..operators.drift import split_windows
from ..operators.panel import add_calendar, build_panel, hour_grid
from ..session import dealt, ensure_sizes, ensure_utc
from ..specs import SeriesSpec, Thresholds, WindowSpec

#: thirty days of events allow short lags only
HOURLY = SeriesSpec(lags=(24, 48), temperature_lag=48, season_lags=(24, 48, 72, 96), short_window=24, long_window=72, season=48, min_history=96, stride=12)
DAILY = SeriesSpec(step=24, lags=(168, 336), temperature_lag=168, season_lags=(168, 336, 504, 672), short_window=168, long_window=672, season=168, min_history=672, max_horizon=168, stride=24)
WINDOWS = WindowSpec(reference_days=200, current_days=200, stride=24)
LINES = Thresholds(min_samples=100)
SCORED_FEATURES = ("demand_lag_168h", "demand_lag_336h", "dayofweek")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ensure_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``site``, ``ts`` as a UTC time and ``hour_ts``."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withColumns({"site": F.col("event_type"), "hour_ts": F.date_trunc("hour", "ts"), "value": clean("value")})


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weight for each site that has one, by the sites the table holds (few, whatever the rows)."""
    sites = events(spark, sf_dir).select("site").distinct()
    order = F.array(*[F.lit(x) for x in (0.4, 0.3, 0.2, 0.1)])
    ranked = sites.withColumn("__n", F.row_number().over(Window.orderBy("site")) - 1)  # a handful of site names
    return ranked.select("site", F.get(order, F.col("__n")).alias("weight")).where("weight is not null")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_key, ts, demand_mwh): summed value by event type and hour."""
    return events(spark, sf_dir).groupBy(F.col("event_type").alias("series_key"), F.col("hour_ts").alias("ts")).agg(F.sum("value").alias("demand_mwh"))


def site_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, ts, five weather columns): averages, extremes and counts of the values by event type and hour."""
    return events(spark, sf_dir).groupBy("site", F.col("hour_ts").alias("ts")).agg(
        F.avg("value").alias("temperature_c"),
        F.max("value").alias("humidity_pct"),
        F.min("value").alias("dewpoint_c"),
        F.sum("value").alias("wind_kmh"),
        F.count("value").cast("double").alias("cloud_pct"),
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly panel of each event type with its own average as temperature and its maximum as forecast."""
    w = site_weather(spark, sf_dir)
    t = w.select(F.col("site").alias("series_key"), "ts", "temperature_c")
    f = w.select(F.col("site").alias("series_key"), "ts", F.col("humidity_pct").alias("fcst_temperature_c"))
    return build_panel(hourly(spark, sf_dir), t, f)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_key, ts, demand_mwh): shipped quantity by return flag and day."""
    li = table(spark, sf_dir, "lineitem")
    day = F.date_trunc("day", F.col("l_shipdate").cast("timestamp"))
    return li.groupBy(F.col("l_returnflag").alias("series_key"), day.alias("ts")).agg(F.sum("l_quantity").alias("demand_mwh"))


def daily_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily rows with two lags, the weekday and y."""
    d = daily(spark, sf_dir)
    grid = hour_grid(d, step=24).join(d, ["series_key", "ts"], "left")
    rows = add_calendar(lagged(grid, "demand_mwh", (168, 336), DAILY))
    return rows.select(
        "series_key",
        (F.col("ts") - F.expr("INTERVAL 1 DAY")).alias("origin_ts"),
        F.lit(24).alias("horizon_h"),
        F.col("ts").alias("target_ts"),
        F.col("demand_mwh_lag_168h").alias("demand_lag_168h"),
        F.col("demand_mwh_lag_336h").alias("demand_lag_336h"),
        "dayofweek",
        F.col("demand_mwh").alias("y"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily rows in windows, predicted by the value a week before."""
    split = split_windows(daily_design(spark, sf_dir), WINDOWS)
    return add_errors(split.where("window <> 'train'").withColumn("prediction", F.col("demand_lag_168h")))


def price_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items in two windows by ship date, with numeric columns."""
    li = table(spark, sf_dir, "lineitem")
    n = li.count()  # from the files' footers
    ensure_sizes(spark, n)
    li = dealt(li, n, "l_orderkey", "l_linenumber")
    window = F.when(F.col("l_shipdate") < F.lit("1998-06-01").cast("timestamp_ntz"), "reference").otherwise("current")
    return li.select("l_returnflag", window.alias("window"), "l_quantity", "l_extendedprice", "l_discount", "l_tax", F.col("l_linenumber").cast("double").alias("l_linenumber"))


def record_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of records: pages of at most a thousand events of a type and day, with an unreadable value where event_id is divisible by 7."""
    e = events(spark, sf_dir)
    value = F.when(F.col("event_id") % 7 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string"))
    record = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH").alias("period"), F.col("event_type").alias("respondent"), value.alias("value"))
    by_day = e.groupBy("event_type", F.to_date("ts").alias("day"), F.floor(F.col("event_id") / 1000).alias("page"))
    return by_day.agg(F.collect_list(record).alias("data")).select(F.to_json(F.struct(F.struct("data").alias("response"))).alias("payload"))


def columnar_pages(spark: SparkSession, sf_dir: str, suffix: str = "") -> DataFrame:
    """Payloads of parallel arrays: one per site and day (24 hours at most), without wind or cloud."""
    w = site_weather(spark, sf_dir)
    row = F.struct("ts", "temperature_c", "humidity_pct", "dewpoint_c")
    rows = w.groupBy("site", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_list(row)).alias("r"))
    at = lambda c: F.transform("r", lambda x: x[c])
    hourly_part = F.struct(
        F.transform("r", lambda x: F.date_format(x["ts"], "yyyy-MM-dd'T'HH:mm")).alias("time"),
        at("temperature_c").alias("temperature_2m" + suffix),
        at("humidity_pct").alias("relative_humidity_2m" + suffix),
        at("dewpoint_c").alias("dew_point_2m" + suffix),
    )
    return rows.select("site", F.to_json(F.struct(hourly_part.alias("hourly"))).alias("payload"))
