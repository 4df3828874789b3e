"""Walk-forward backtests of any forecaster over many series at once."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.core import ceil_to, col, floor_to, from_hours, hours
from ..specs import SeriesSpec


class Forecaster(Protocol):
    """``history`` holds (series_key, cutoff, ts, demand_mwh) before each cutoff lazily joined on demand by the forecaster;
    ``asked`` has (series_key, cutoff, horizon_h, target_ts); the answer adds ``prediction``."""

    def __call__(self, series: DataFrame, asked: DataFrame) -> DataFrame: ...


def make_cutoffs(series: DataFrame, spec: SeriesSpec = SeriesSpec(), weeks: int = 8, min_history: int = 168) -> DataFrame:
    """(series_key, cutoff): daily at the cutoff hour over the last weeks, while a whole horizon follows."""
    at = F.expr(f"INTERVAL {spec.cutoff_hour} HOURS")
    ends = series.groupBy("series_key").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    late = floor_to(F.col("hi") - F.expr(f"INTERVAL {7 * weeks} DAYS"), "day") + at
    early = ceil_to(F.col("lo") + F.expr(f"INTERVAL {min_history} HOURS"), "day") + at
    ends = ends.select("series_key", hours(F.greatest(late, early)).alias("a"), (hours("hi") - spec.max_horizon).alias("b")).where("a <= b")
    days = ends.select("series_key", F.explode(F.sequence("a", "b", F.lit(24).cast("long"))).alias("h"))
    return days.select("series_key", from_hours("h").alias("cutoff"))


def history_before(df: DataFrame, cutoff: str | Column, ts: str = "ts") -> DataFrame:
    return df.where(F.col(ts) < (F.to_timestamp(F.lit(cutoff)) if isinstance(cutoff, str) else cutoff))


def folds(cutoffs: DataFrame, spec: SeriesSpec = SeriesSpec()) -> DataFrame:
    """Cutoffs by horizons, with the target of each."""
    rows = cutoffs.select("series_key", "cutoff", F.explode(F.array(*[F.lit(h) for h in spec.horizons])).alias("horizon_h"))
    return rows.withColumn("target_ts", from_hours(hours("cutoff") + F.col("horizon_h")))


def seasonal_naive(spec: SeriesSpec = SeriesSpec()) -> Forecaster:
    """The value one season before the target; it fails if that would reach the cutoff."""

    def forecast(series: DataFrame, asked: DataFrame) -> DataFrame:
        past = series.select("series_key", F.col("ts").alias("__ts"), F.col("demand_mwh").alias("__past"))
        source = from_hours(hours("target_ts") - spec.season)
        out = asked.withColumn("__ts", source)
        # assert_true is NULL where it holds, so coalescing it into the time keeps the check in the plan.
        guard = F.assert_true(F.col("__ts") < F.col("cutoff"), "a seasonal lag reaches the cutoff: the season is shorter than the horizon")
        out = out.withColumn("__ts", F.when(guard.isNull(), F.col("__ts")))
        return out.join(past, ["series_key", "__ts"], "left").withColumnRenamed("__past", "prediction").drop("__ts")

    return forecast


def per_series(predict: Callable[[pd.DataFrame, pd.DataFrame], pd.Series], span: int) -> Forecaster:
    """A model of its own for each series and cutoff.

    ``predict(history, asked)`` gets the rows (ts, demand_mwh) of the ``span`` hours before the
    cutoff, in order of time, and the rows to forecast (horizon_h, target_ts); it returns their
    predictions. A row serves only the cutoffs of the days that its span reaches, so it is
    copied to few of them however long the series is, and no group is larger than the span.
    """

    def forecast(series: DataFrame, asked: DataFrame) -> DataFrame:
        day = lambda c: F.floor(hours(c) / 24)
        cutoffs = asked.select("series_key", "cutoff", day("cutoff").alias("__day")).distinct()
        reach = F.sequence(day("ts"), day("ts") + -(-span // 24))
        near = series.select("series_key", "ts", "demand_mwh", F.explode(reach).alias("__day")).join(cutoffs, ["series_key", "__day"])
        near = near.where((F.col("ts") < F.col("cutoff")) & (hours("ts") >= hours("cutoff") - span))
        history = near.select(F.col("series_key").alias("__series"), F.col("cutoff").alias("__cutoff"), "ts", "demand_mwh")

        def one(held: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            rows["prediction"] = predict(held.sort_values("ts")[["ts", "demand_mwh"]], rows[["horizon_h", "target_ts"]]) if len(rows) else []
            return rows

        shape = StructType([*asked.schema.fields, StructField("prediction", DoubleType())])
        return history.groupBy("__series", "__cutoff").cogroup(asked.groupBy("series_key", "cutoff")).applyInPandas(one, shape)

    return forecast


def is_scorable(actual: str = "actual", prediction: str = "prediction") -> Column:
    return F.col(actual).isNotNull() & F.col(prediction).isNotNull() & (F.col(actual) != 0)


def add_errors(df: DataFrame, y: str = "y", prediction: str = "prediction") -> DataFrame:
    """error, abs_error and abs_pct_error, the last missing where y is 0."""
    e = F.col(prediction) - F.col(y)
    size = F.abs(F.col(y))
    return df.withColumns({"error": e, "abs_error": F.abs(e), "abs_pct_error": F.abs(e) / F.when(size != 0, size) * 100})


def fold_predictions(series: DataFrame, forecaster: Forecaster, spec: SeriesSpec = SeriesSpec(), cutoffs: DataFrame | None = None, **how) -> DataFrame:
    """Every fold's rows with ``fold_ok``: a fold with any row that can't be scored is out as a whole."""
    held = series.where("demand_mwh is not null")
    cutoffs = make_cutoffs(held, spec, **how) if cutoffs is None else cutoffs
    first = held.groupBy("series_key").agg(F.min("ts").alias("__first"))
    cutoffs = cutoffs.join(first, "series_key").where("cutoff > __first").drop("__first")
    asked = folds(cutoffs, spec)
    actual = held.select("series_key", F.col("ts").alias("target_ts"), F.col("demand_mwh").alias("actual"))
    rows = forecaster(held, asked).join(actual, ["series_key", "target_ts"], "left")
    w = Window.partitionBy("series_key", "cutoff")
    return rows.withColumn("fold_ok", F.min(F.coalesce(is_scorable(), F.lit(False)).cast("int")).over(w) == 1)


def walk_forward(series: DataFrame, forecaster: Forecaster, spec: SeriesSpec = SeriesSpec(), model: str = "model", **how) -> DataFrame:
    """Scored rows of whole folds: series_key, cutoff, horizon_h, target_ts, actual, prediction, errors, model."""
    rows = fold_predictions(series, forecaster, spec, **how).where("fold_ok").drop("fold_ok")
    return add_errors(rows, "actual").withColumn("model", F.lit(model))


def fold_report(rows: DataFrame) -> DataFrame:
    """Folds scored and skipped by series, and a warning where any is skipped."""
    per = rows.groupBy("series_key", "cutoff").agg(F.bool_and("fold_ok").alias("ok"))
    out = per.groupBy("series_key").agg(F.count_if("ok").alias("folds"), F.count_if(~F.col("ok")).alias("skipped"))
    text = F.format_string("%d of %d folds hold a row that cannot be scored and are left out", F.col("skipped"), F.col("skipped") + F.col("folds"))
    return out.withColumn("warning", F.when(F.col("skipped") > 0, text))


def first_warnings(report: DataFrame, n: int = 20) -> DataFrame:
    """The first warnings by series."""
    return report.where("warning is not null").orderBy("series_key").select("series_key", "warning").limit(n)


def require_folds(rows: DataFrame) -> DataFrame:
    """``rows``, or an error where there is no fold or none that can be scored."""
    n = rows.agg(F.count("*").alias("n"), F.count_if("fold_ok").alias("ok")).first()
    if not n["n"]:
        raise ValueError("no fold: the series are too short for one cutoff with a whole horizon")
    if not n["ok"]:
        raise ValueError("no fold can be scored: each has a missing or zero actual or no prediction")
    return rows


def backtest_metrics(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """mae, mape_pct, rmse, bias and n by horizon and overall (horizon_h NULL), in one pass by grouping sets."""
    by = by or ["model"]
    sets = [[*[F.col(c) for c in by], F.col("horizon_h")], [F.col(c) for c in by]]
    return scored.groupingSets(sets, *[F.col(c) for c in by], F.col("horizon_h")).agg(
        F.avg("abs_error").alias("mae"),
        F.avg("abs_pct_error").alias("mape_pct"),
        F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"),
        F.avg("error").alias("bias"),
        F.count("*").alias("n"),
    )


def compare_by_horizon(metrics: DataFrame, baseline: str, challenger: str) -> DataFrame:
    """Both models' metrics side by side, by horizon and overall, with their differences."""
    names = ["mae", "mape_pct", "rmse", "bias", "n"]
    one = lambda m, s: metrics.where(F.col("model") == m).select("horizon_h", *[F.col(c).alias(f"{c}_{s}") for c in names])
    a, b = one(baseline, "baseline"), one(challenger, "challenger").withColumnRenamed("horizon_h", "__h")
    both = a.join(b, F.col("horizon_h").eqNullSafe(F.col("__h"))).drop("__h")
    return both.withColumns({"mae_delta": F.col("mae_challenger") - F.col("mae_baseline"), "mape_delta_pp": F.col("mape_pct_challenger") - F.col("mape_pct_baseline")})


def compare(metrics: DataFrame, baseline: str, challenger: str) -> DataFrame:
    """One row: overall deltas, the delta in percent, horizons won, horizons compared."""
    t = compare_by_horizon(metrics, baseline, challenger)
    overall = lambda c: F.max(F.when(F.col("horizon_h").isNull(), F.col(c)))
    out = t.agg(
        overall("mae_baseline").alias("mae_baseline"),
        overall("mae_challenger").alias("mae_challenger"),
        overall("mae_delta").alias("mae_delta"),
        overall("mape_delta_pp").alias("mape_delta_pp"),
        F.count_if(F.col("horizon_h").isNotNull() & (F.col("mae_delta") < 0)).alias("horizons_won"),
        F.count("horizon_h").alias("horizons_total"),
    )
    base = F.col("mae_baseline")
    return out.withColumn("mae_delta_pct", F.col("mae_delta") / F.when(base != 0, base) * 100)


def metrics_long(metrics: DataFrame) -> DataFrame:
    """One row per (model, metric, step), the step being the horizon (-1 overall)."""
    wide = metrics.select("model", F.coalesce("horizon_h", F.lit(-1)).alias("step"), *[F.col(c).cast("double").alias(c) for c in ("mae", "mape_pct", "rmse", "bias", "n")])
    return wide.unpivot(["model", "step"], ["mae", "mape_pct", "rmse", "bias", "n"], "metric", "value")


def promotion(comparison: DataFrame) -> DataFrame:
    """``alias``: champion if the challenger's MAE is below the baseline's, else challenger."""
    return comparison.withColumn("alias", F.when(col("mae_challenger") < col("mae_baseline"), F.lit("champion")).otherwise(F.lit("challenger")))
