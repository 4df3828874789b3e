"""Design matrices in which every feature is known strictly before its origin.

Lags and windows are computed once over the gapless panel by window functions
that share one partitioning; a (target) and an (origin) join then place them, in
the stead of a self-join for each lag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import calendar, ceil_to, from_hours, holiday_flag, hours, published_at
from ..specs import CATEGORICAL, FORECAST_SOURCES, SeriesSpec
from .panel import hour_grid


def training_origins(panel: DataFrame, spec: SeriesSpec = SeriesSpec()) -> DataFrame:
    """(series_key, origin_ts): every ``stride`` hours, from enough history to a last whole horizon."""
    ends = panel.groupBy("series_key").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    first = hours(ceil_to(F.col("lo") + F.expr(f"INTERVAL {spec.min_history} HOURS"), "hour"))
    ends = ends.select("series_key", first.alias("a"), (hours("hi") - spec.max_horizon).alias("b")).where("a <= b")
    steps = ends.select("series_key", F.explode(F.sequence("a", "b", F.lit(spec.stride).cast("long"))).alias("h"))
    return steps.select("series_key", from_hours("h").alias("origin_ts"))


def rolling_before(panel: DataFrame, column: str, window: int, spec: SeriesSpec = SeriesSpec(), aggregates: tuple[str, ...] = ("mean", "std", "min", "max")) -> DataFrame:
    """Statistics of the ``window`` hours that end one step before each row; NULL below half a window of values."""
    frame = Window.partitionBy("series_key").orderBy(hours("ts")).rangeBetween(-window, -spec.step)
    enough = F.count(column).over(frame) >= max(2, window // spec.step // 2)
    how = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    return panel.withColumns({f"{column}_roll_{a}_{window}h": F.when(enough, how[a](column).over(frame)) for a in aggregates})


def lagged(panel: DataFrame, column: str, lags: tuple[int, ...], spec: SeriesSpec = SeriesSpec()) -> DataFrame:
    """``column`` at each row's time less each lag; the panel must be gapless."""
    order = Window.partitionBy("series_key").orderBy("ts")
    return panel.withColumns({f"{column}_lag_{k}h": F.lag(column, k // spec.step).over(order) for k in lags})


def season_mean(columns: list[Column]) -> Column:
    """Mean of those values that are there, NULL if none is."""
    held = F.filter(F.array(*columns), lambda x: x.isNotNull())
    return F.when(F.size(held) > 0, F.aggregate(held, F.lit(0.0), lambda a, x: a + x) / F.size(held))


def build_design_matrix(panel: DataFrame, origins: DataFrame, spec: SeriesSpec = SeriesSpec(), horizons: tuple[int, ...] | None = None) -> DataFrame:
    """One row per (series_key, origin_ts, horizon_h): target_ts, the features of ``spec``, and y."""
    horizons = horizons or spec.horizons
    keys = ["series_key", "ts"]
    measures = ["demand_mwh", "temperature_c", *FORECAST_SOURCES]
    measures = {c: (F.col(c) if c in panel.columns else F.lit(None).cast("double")).alias(c) for c in measures}
    # The grid runs past the last row, so targets still to come find their lags.
    grid = hour_grid(panel, step=spec.step, extend=spec.max_horizon).join(panel.select(*keys, *measures.values()), keys, "left")
    all_lags = tuple(sorted({*spec.lags, *spec.season_lags}))
    base = lagged(lagged(grid, "demand_mwh", all_lags, spec), "temperature_c", (spec.temperature_lag,), spec)
    base = rolling_before(base, "demand_mwh", spec.short_window, spec)
    base = rolling_before(base, "demand_mwh", spec.long_window, spec, ("mean",))
    base = rolling_before(base, "temperature_c", spec.short_window, spec, ("mean",))
    order = Window.partitionBy("series_key").orderBy("ts")
    base = base.withColumns({"demand_last": F.lag("demand_mwh", 1).over(order), "temp_last": F.lag("temperature_c", 1).over(order)})

    rows = origins.select("series_key", "origin_ts", F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon_h"))
    rows = rows.withColumn("target_ts", from_hours(hours("origin_ts") + F.col("horizon_h")))
    s, w = spec.short_window, spec.long_window
    at_origin = base.select(
        "series_key",
        F.col("ts").alias("origin_ts"),
        "demand_last",
        F.col(f"demand_mwh_roll_mean_{s}h").alias("demand_roll_mean_short"),
        F.col(f"demand_mwh_roll_std_{s}h").alias("demand_roll_std_short"),
        F.col(f"demand_mwh_roll_min_{s}h").alias("demand_roll_min_short"),
        F.col(f"demand_mwh_roll_max_{s}h").alias("demand_roll_max_short"),
        F.col(f"demand_mwh_roll_mean_{w}h").alias("demand_roll_mean_long"),
        "temp_last",
        F.col(f"temperature_c_roll_mean_{s}h").alias("temp_roll_mean_short"),
    )
    at_target = base.select(
        "series_key", F.col("ts").alias("target_ts"), *[f"demand_mwh_lag_{k}h" for k in all_lags], f"temperature_c_lag_{spec.temperature_lag}h", *FORECAST_SOURCES, F.col("demand_mwh").alias("y")
    )
    d = rows.join(at_origin, ["series_key", "origin_ts"], "left").join(at_target, ["series_key", "target_ts"], "left")
    # A lag may be read only if its hour lies strictly before the origin.
    known = lambda name, k: F.when(F.col("horizon_h") < k, F.col(name))
    published = published_at("target_ts", spec.published_hour) <= F.col("origin_ts")
    d = d.withColumns(
        {
            **{f"demand_lag_{k}h": known(f"demand_mwh_lag_{k}h", k) for k in spec.lags},
            "demand_same_season_mean": season_mean([known(f"demand_mwh_lag_{k}h", k) for k in spec.season_lags]),
            "temp_lag": known(f"temperature_c_lag_{spec.temperature_lag}h", spec.temperature_lag),
            **{name: F.when(published, F.col(c)) for c, name in FORECAST_SOURCES.items()},
        }
    )
    d = d.withColumn("temp_fcst_minus_lag", F.col("temp_fcst_target") - F.col("temp_lag"))
    d = holiday_flag(calendar(d, "target_ts"), "target_ts", spec.timezone)
    return d.select("series_key", "origin_ts", "target_ts", *spec.features, "y")


def feature_frame(design: DataFrame, spec: SeriesSpec = SeriesSpec(), columns: tuple[str, ...] | None = None) -> DataFrame:
    """Feature columns alone, the categorical ones as short integers."""
    return design.select(*[F.col(c).cast("short" if c in CATEGORICAL else "double").alias(c) for c in columns or spec.features])


def labelled(design: DataFrame) -> DataFrame:
    return design.where("y is not null")


def training_slice(design: DataFrame, cutoff: str | Column) -> DataFrame:
    """Labelled rows whose target lies strictly before ``cutoff``."""
    at = F.to_timestamp(F.lit(cutoff)) if isinstance(cutoff, str) else cutoff
    return labelled(design).where(F.col("target_ts") < at)


def fold_sizes(design: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """(series_key, cutoff, n): how many rows of its series each fold may train on, from running sums and no range join."""
    rows = labelled(design).groupBy("series_key", F.col("target_ts").alias("at")).agg(F.count("*").alias("k"))
    both = rows.select("series_key", "at", "k", F.lit(None).cast("timestamp").alias("cutoff")).unionByName(
        cutoffs.select("series_key", F.col("cutoff").alias("at"), F.lit(0).cast("long").alias("k"), "cutoff")
    )
    # At one time the cutoff comes first: a target at the cutoff is not before it.
    run = Window.partitionBy("series_key").orderBy("at", F.col("cutoff").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("n", F.sum("k").over(run)).where("cutoff is not null").select("series_key", "cutoff", "n")


def requested(design: DataFrame, asked: DataFrame) -> DataFrame:
    """The design's row for each asked (series_key, cutoff, horizon_h), its cutoff being the origin; missing where there is none."""
    rows = design.withColumnRenamed("origin_ts", "cutoff").drop("target_ts")
    return asked.join(rows, ["series_key", "cutoff", "horizon_h"], "left")
