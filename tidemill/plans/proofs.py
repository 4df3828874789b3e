"""Registered queries on steps that other queries only pass through: folds, whole designs, trees, gates, labels, overrides."""

from __future__ import annotations

from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import bin_label, clean
from ..operators import backtest, design, drift, models, policy, timeline, trees
from ..operators import panel as pn
from ..operators import statistics as st
from ..sources.stage import Stages
from ..specs import FORECAST_SOURCES, Thresholds
from . import queries as q
from . import tables as tb
from .queries import DAY, HOURS, PRICES, STATS, h, query
from .tables import HOURLY, LINES, SCORED_FEATURES

# -- folds


@query(f"WITH {q._CUT} SELECT ct.series_key, {HOURS.format('cutoff')} AS cutoff_h, count(dm.target) AS n FROM ct LEFT JOIN (WITH {q._DM} SELECT series_key, target FROM dm WHERE y IS NOT NULL) dm ON dm.series_key = ct.series_key AND dm.target < ct.cutoff GROUP BY 1, 2")
def training_membership(spark: SparkSession, sf: str) -> DataFrame:
    n = design.fold_sizes(q._hourly_design(spark, sf), backtest.make_cutoffs(tb.hourly(spark, sf), HOURLY, **q._HOW))
    return n.select("series_key", h("cutoff", "cutoff_h"), "n")


@query(f"WITH {q._CUT} SELECT fo.series_key, {HOURS.format('cutoff')} AS cutoff_h, hz AS horizon_h, round(x.demand, 4) AS y FROM fo LEFT JOIN ob x ON x.series_key = fo.series_key AND x.ts = fo.target")
def requested_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The design's rows at every cutoff, as a walk forward asks for them."""
    p = tb.panel(spark, sf)
    asked = backtest.folds(backtest.make_cutoffs(tb.hourly(spark, sf), HOURLY, **q._HOW), HOURLY)
    rows = design.requested(models.cutoff_design(p, HOURLY, **q._HOW), asked)
    return rows.select("series_key", h("cutoff", "cutoff_h"), F.col("horizon_h").cast("long").alias("horizon_h"), q.r("y"))


def _same_hour_mean(history: pd.DataFrame, asked: pd.DataFrame) -> pd.Series:
    mean = history.groupby(history["ts"].dt.hour)["demand_mwh"].mean()
    return asked["target_ts"].dt.hour.map(mean)


@query(
    f"""WITH {q._CUT}, av AS (SELECT fo.series_key, cutoff, hz, avg(b.demand) AS prediction FROM fo JOIN ob b ON b.series_key = fo.series_key AND b.ts < cutoff AND b.ts >= cutoff - INTERVAL 96 HOUR AND hour(b.ts) = hour(target) GROUP BY ALL)
    SELECT fo.series_key, {HOURS.format('fo.cutoff')} AS cutoff_h, fo.hz AS horizon_h, round(prediction, 4) AS prediction FROM fo LEFT JOIN av USING (series_key, cutoff, hz)"""
)
def per_series_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """A model for each series and cutoff: the mean of the target's hour over the last four days."""
    s = tb.hourly(spark, sf)
    asked = backtest.folds(backtest.make_cutoffs(s, HOURLY, **q._HOW), HOURLY)
    rows = backtest.per_series(_same_hour_mean, 96)(s, asked)
    return rows.select("series_key", h("cutoff", "cutoff_h"), F.col("horizon_h").cast("long").alias("horizon_h"), q.r("prediction"))


@query(
    f"""WITH {q._CUT}, f AS (SELECT DISTINCT series_key, cutoff, fold_ok FROM ok), n AS (SELECT series_key, count(*) AS folds, count(*) FILTER (WHERE NOT fold_ok) AS skipped FROM f GROUP BY 1)
    SELECT series_key, skipped || ' of ' || folds || ' folds hold a row that cannot be scored and are left out' AS warning FROM n WHERE skipped > 0 ORDER BY series_key LIMIT 20"""
)
def first_warnings(spark: SparkSession, sf: str) -> DataFrame:
    """The first twenty warnings: the limit is the report's."""
    return backtest.first_warnings(backtest.fold_report(q._naive_rows(spark, sf)))


# -- the whole design


_NAMES = [*HOURLY.features, "y"]
_HOLIDAYS = q.SQL["holiday_flag"].split("SELECT CAST(o_orderdate AS DATE)")[0].removeprefix("WITH ")
_KNOWN = "date_trunc('day', target) - INTERVAL 1 DAY + INTERVAL 12 HOUR <= origin"
_TOLD = {
    "horizon_h": "CAST(hz AS DOUBLE)", "hour": "CAST(hour(target) AS DOUBLE)", "dayofweek": "CAST(isodow(target) - 1 AS DOUBLE)", "month": "CAST(month(target) AS DOUBLE)", "is_weekend": "CAST(isodow(target) >= 6 AS DOUBLE)",
    "is_holiday": "CAST(CAST(timezone('America/New_York', timezone('UTC', target)) AS DATE) IN (SELECT CAST(day AS DATE) FROM hd) AS DOUBLE)",
    "demand_lag_24h": "lag24", "demand_lag_48h": "lag48", "demand_same_season_mean": "CASE WHEN len(held) > 0 THEN list_sum(held) / len(held) END", "demand_last": "d1", "demand_roll_mean_short": "rm", "demand_roll_std_short": "rs",
    "demand_roll_min_short": "rn", "demand_roll_max_short": "rx", "demand_roll_mean_long": "rl", "temp_lag": "tl", "temp_last": "t1", "temp_roll_mean_short": "tm", "temp_fcst_target": "ft",
    "temp_fcst_spread_target": f"CASE WHEN {_KNOWN} THEN mx - mn END", "humidity_fcst_target": f"CASE WHEN {_KNOWN} THEN mx END", "dewpoint_fcst_target": f"CASE WHEN {_KNOWN} THEN mn END",
    "wind_fcst_target": f"CASE WHEN {_KNOWN} THEN sm END", "cloud_fcst_target": f"CASE WHEN {_KNOWN} THEN ct END", "temp_fcst_minus_lag": "ft - tl", "y": "y",
}


def whole_design(spark: SparkSession, sf: str) -> DataFrame:
    """The hourly design with all six forecast columns there."""
    w = tb.site_weather(spark, sf)
    held = {"fcst_temperature_c": F.col("humidity_pct"), "fcst_temperature_spread_c": F.col("humidity_pct") - F.col("dewpoint_c"), "fcst_humidity_pct": F.col("humidity_pct"), "fcst_dewpoint_c": F.col("dewpoint_c"), "fcst_wind_kmh": F.col("wind_kmh"), "fcst_cloud_pct": F.col("cloud_pct")}
    assert set(held) == set(FORECAST_SOURCES)
    forecast = w.select(F.col("site").alias("series_key"), "ts", *[c.alias(n) for n, c in held.items()])
    p = pn.build_panel(tb.hourly(spark, sf), w.select(F.col("site").alias("series_key"), "ts", "temperature_c"), forecast)
    return design.build_design_matrix(p, design.training_origins(p, HOURLY), HOURLY)


@query(
    f"""WITH {_HOLIDAYS}, {q._DM}, fc AS (SELECT event_type AS series_key, date_trunc('hour', ts) AS ts, max(value) AS mx, min(value) AS mn, sum(value) AS sm, CAST(count(value) AS DOUBLE) AS ct FROM events GROUP BY 1, 2)
    SELECT dz.series_key, {HOURS.format('origin')} AS origin_h, {HOURS.format('target')} AS target_h, {", ".join(f"{_TOLD[n]} AS {n}" for n in _NAMES)} FROM dz LEFT JOIN fc ON fc.series_key = dz.series_key AND fc.ts = dz.target"""
)
def design_features(spark: SparkSession, sf: str) -> DataFrame:
    """Every feature of every row, not rounded."""
    d = whole_design(spark, sf)
    return d.select("series_key", h("origin_ts", "origin_h"), h("target_ts", "target_h"), *[F.col(n).cast("double").alias(n) for n in _NAMES])


# -- trees

_HOUR, _LAST, _LAG, _WEEKEND = range(4)
_NIGHT = frozenset(map(float, (0, 1, 2, 3, 4, 5, 22, 23)))
FOREST = [
    (1.0, trees.Split(_HOUR, trees.Leaf(80.0), trees.Split(_LAST, trees.Leaf(100.0), trees.Leaf(140.0), line=150.0), values=_NIGHT, known=frozenset(map(float, range(24))))),
    (0.5, trees.Split(_LAG, trees.Leaf(-10.0), trees.Split(_WEEKEND, trees.Leaf(5.0), trees.Leaf(20.0), line=0.5), line=120.0)),
]
_FOREST_SQL = "CASE WHEN hour(target) IN (0, 1, 2, 3, 4, 5, 22, 23) THEN 80.0 WHEN coalesce(d1, -1) <= 150 THEN 100.0 ELSE 140.0 END + 0.5 * CASE WHEN coalesce(lag24, -1) <= 120 THEN -10.0 WHEN isodow(target) >= 6 THEN 20.0 ELSE 5.0 END"


def by_forest(rows: DataFrame) -> DataFrame:
    names = ("hour", "demand_last", "demand_lag_24h", "is_weekend")
    filled = rows.withColumns({f"__f_{n}": F.coalesce(F.col(n).cast("double"), F.lit(-1.0)) for n in names})
    return filled.withColumn("prediction", trees.prediction(FOREST, tuple(f"__f_{n}" for n in names)))


@query(f"WITH {q._DM} SELECT series_key, {HOURS.format('origin')} AS origin_h, hz AS horizon_h, CAST({_FOREST_SQL} AS DOUBLE) AS prediction, round(y, 4) AS actual FROM dm")
def forest_scoring(spark: SparkSession, sf: str) -> DataFrame:
    """Forecasts at every training origin by a forest of two trees, as column expressions."""
    p = tb.panel(spark, sf)
    f = models.forecast(p, by_forest, HOURLY, design.training_origins(p, HOURLY))
    return f.select("series_key", h("origin_ts", "origin_h"), F.col("horizon_h").cast("long").alias("horizon_h"), "prediction", q.r("actual"))


@query(
    f"""WITH {q.G}, la AS (SELECT series_key, max(ts) FILTER (WHERE demand IS NOT NULL) + INTERVAL 1 HOUR AS origin FROM p GROUP BY 1), oh AS (SELECT series_key, origin, hz, origin + hz * INTERVAL 1 HOUR AS target FROM la, (SELECT unnest(generate_series(1, 24)) AS hz)),
    x AS (SELECT oh.*, a.demand AS d1, CASE WHEN hz < 24 THEN b.demand END AS lag24 FROM oh LEFT JOIN p a ON a.series_key = oh.series_key AND a.ts = origin - INTERVAL 1 HOUR LEFT JOIN p b ON b.series_key = oh.series_key AND b.ts = target - INTERVAL 24 HOUR)
    SELECT series_key, {HOURS.format('target')} AS target_h, hz AS horizon_h, CAST({_FOREST_SQL} AS DOUBLE) AS prediction FROM x"""
)
def forward_forest(spark: SparkSession, sf: str) -> DataFrame:
    """The same one step after each series' last observed hour."""
    f = models.forecast(tb.panel(spark, sf), by_forest, HOURLY)
    return f.select("series_key", h("target_ts", "target_h"), F.col("horizon_h").cast("long").alias("horizon_h"), "prediction")


# -- statistics and verdicts


@query(f"WITH {PRICES}, {STATS} SELECT k AS l_returnflag, column_name AS column, CAST(i AS BIGINT) AS bin, '[' || CASE i WHEN 1 THEN '-inf' ELSE printf('%.4g', inner_edges[i - 1]) END || ', ' || CASE i WHEN nq - 1 THEN 'inf' ELSE printf('%.4g', inner_edges[i]) END || ')' AS label FROM (SELECT *, unnest(generate_series(1, nq - 1)) AS i FROM inn WHERE NOT categorical AND nq >= 2)")
def bin_labels(spark: SparkSession, sf: str) -> DataFrame:
    bins = st.histogram(q._prices(spark, sf), ["l_returnflag"]).where("not categorical")
    return bins.select("l_returnflag", "column", F.col("bin").cast("long").alias("bin"), bin_label("lo", "hi").alias("label"))


@query("SELECT l_returnflag, count(*) FILTER (WHERE l_discount >= 0.05) AS n, round(sum(CASE WHEN l_discount >= 0.05 THEN sqrt(l_discount - 0.05) END), 4) AS total FROM lineitem GROUP BY 1")
def clean_values(spark: SparkSession, sf: str) -> DataFrame:
    """Roots of negative numbers are NaN and leave as NULL."""
    x = tb.table(spark, sf, "lineitem").withColumn("x", clean(F.sqrt(F.col("l_discount").cast("double") - 0.05)))
    return x.groupBy("l_returnflag").agg(F.count("x").alias("n"), F.round(F.sum("x"), 4).alias("total"))


@query(f"WITH {PRICES}, {STATS} SELECT k AS l_returnflag, column_name AS column, CASE WHEN least(n_reference, n_current) < 10 THEN 'ok' WHEN psi >= 0.005 THEN 'alert' WHEN psi >= 0.002 THEN 'warn' WHEN ks_p < 0.001 THEN 'warn' ELSE 'ok' END AS severity FROM cmp")
def threshold_overrides(spark: SparkSession, sf: str) -> DataFrame:
    t = Thresholds.from_conf({"DRIFT_PSI_WARN": "0.002", "DRIFT_PSI_ALERT": "0.005", "DRIFT_KS_P_ALERT": "0.001", "DRIFT_MIN_SAMPLES": "10"})
    return st.compare_columns(q._prices(spark, sf), ["l_returnflag"], t).select("l_returnflag", "column", "severity")


@query(f"SELECT coalesce(bool_or(should_retrain), false) AS retrain FROM ({q.SQL['retrain_verdict']})")
def drift_gate(spark: SparkSession, sf: str) -> DataFrame:
    v = policy.evaluate(drift.drift_sections(tb.scored(spark, sf), list(SCORED_FEATURES), LINES), LINES)
    return spark.createDataFrame([(policy.drift_gate(v),)], "retrain boolean")


@query(q.SQL["drift_timeline"])
def timeline_by_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The timeline kept as day summaries: one run adds the older days, the next the newer ones."""
    t, names = replace(LINES, min_samples=5), list(SCORED_FEATURES)
    stages = Stages(spark, "timeline")
    scored = stages.put("scored", tb.scored(spark, sf))
    timeline.begin(spark, stages.path, scored, names, "1", t)
    newer = F.to_date("target_ts") >= F.lit("1998-06-01").cast("date")
    for part in (scored.where(~newer), scored.where(newer)):
        timeline.extend(spark, stages.path, part, names, "1")
    out = timeline.read(spark, stages.path, t)
    return out.select("series_key", "day", F.col("n").cast("long").alias("n"), q.r("target_psi", 6), q.r("prediction_psi", 6), q.r("feature_max_psi", 6))
