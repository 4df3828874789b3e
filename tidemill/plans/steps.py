"""Registered queries on single steps: slices, scans, unions, streams' batch forms, details of drift and verdicts."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import holiday_flag as flag
from ..operators import backtest, design, drift, models, panel, policy
from ..operators import statistics as st
from ..sources import lake
from ..specs import TableSpec
from ..streaming import ingest
from . import queries as q
from . import tables as tb
from .queries import DAY, HOURS, PERF, PRICES, SCORED_LONG, SECTIONS, STATS, WERR, h, query, r
from .tables import LINES, SCORED_FEATURES, WINDOWS

_CUTOFF = "1996-01-01"


@query(f"WITH {DAY} SELECT series_key, count(*) AS n, round(sum(demand), 2) AS demand FROM dd WHERE ts < TIMESTAMP '{_CUTOFF}' GROUP BY 1")
def history_before(spark: SparkSession, sf: str) -> DataFrame:
    rows = backtest.history_before(tb.daily(spark, sf), _CUTOFF)
    return rows.groupBy("series_key").agg(F.count("*").alias("n"), F.round(F.sum("demand_mwh"), 2).alias("demand"))


@query(f"WITH {DAY} SELECT series_key, {HOURS.format('ts')} AS h, round(demand, 4) AS y FROM pp WHERE demand IS NOT NULL AND ts < TIMESTAMP '{_CUTOFF}'")
def training_slice(spark: SparkSession, sf: str) -> DataFrame:
    return design.training_slice(tb.daily_design(spark, sf), _CUTOFF).select("series_key", h("target_ts"), r("y"))


@query(f"WITH {DAY} SELECT series_key, count(*) AS n FROM pp WHERE demand IS NOT NULL GROUP BY 1")
def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return design.labelled(tb.daily_design(spark, sf)).groupBy("series_key").agg(F.count("*").alias("n"))


@query(f"WITH {DAY} SELECT round(lag7, 4) AS demand_lag_168h, isodow(ts) - 1 AS dayofweek FROM pp")
def feature_frame(spark: SparkSession, sf: str) -> DataFrame:
    f = design.feature_frame(tb.daily_design(spark, sf), columns=("demand_lag_168h", "dayofweek"))
    return f.select(r("demand_lag_168h"), F.col("dayofweek").cast("long").alias("dayofweek"))


@query(f"WITH {q._DM} SELECT series_key, CAST(hz AS BIGINT) AS horizon_h, count(*) AS n, round(sum(y), 2) AS y FROM dm WHERE hz % 6 = 0 GROUP BY 1, 2")
def thin_by_modulus(spark: SparkSession, sf: str) -> DataFrame:
    rows = panel.thin_by_modulus(q._hourly_design(spark, sf), 6)
    return rows.groupBy("series_key", F.col("horizon_h").cast("long").alias("horizon_h")).agg(F.count("*").alias("n"), F.round(F.sum("y"), 2).alias("y"))


@query("SELECT c_custkey, c_acctbal > 0 AND coalesce(CASE c_custkey % 3 WHEN 1 THEN true WHEN 2 THEN false END, true) AS is_real FROM customer")
def provenance(spark: SparkSession, sf: str) -> DataFrame:
    """Runs without a champion, with one trained on real data and with one that was not."""
    c = tb.table(spark, sf, "customer")
    runs = c.withColumns({"panel_is_real": F.col("c_acctbal") > 0, "champion_is_real": F.when(F.col("c_custkey") % 3 == 1, True).when(F.col("c_custkey") % 3 == 2, False)})
    return panel.provenance(runs).select("c_custkey", "is_real")


@query(f"WITH {q._W} SELECT site, {HOURS.format('ts')} AS h, round(t, 4) AS temperature_c FROM sw WHERE ts <= TIMESTAMP '2024-01-15' AND site IN ('click', 'view')")
def load_temperature(spark: SparkSession, sf: str) -> DataFrame:
    w = tb.site_weather(spark, sf).withColumn("is_observed", F.col("ts") <= F.to_timestamp(F.lit("2024-01-15")))
    return panel.load_temperature(w, ["click", "view"], observed_only=True).select("site", h("ts"), r("temperature_c"))


@query(f"WITH {q.G}, s AS (SELECT *, ts >= max(ts) OVER (PARTITION BY series_key) - INTERVAL 5 DAY AS on_ FROM p) SELECT {HOURS.format('min(ts)')} AS h, count(*) AS rows_changed, CAST(1.2 AS DOUBLE) AS scale, CAST(5 AS DOUBLE) AS \"offset\", CAST(3 AS DOUBLE) AS temperature_offset FROM s WHERE on_")
def shift_spec(spark: SparkSession, sf: str) -> DataFrame:
    s = panel.inject_shift(tb.panel(spark, sf), last_days=5, scale=1.2, offset=5.0, temperature_offset=3.0)
    return panel.shift_spec(s, 1.2, 5.0, 3.0).select(h("start_ts"), "rows_changed", "scale", "offset", "temperature_offset")


@query(f"WITH {q.G} SELECT series_key, {HOURS.format('ts')} AS h, round(demand, 4) AS demand_mwh, round(temp, 4) AS temperature_c FROM p")
def resolve_panel(spark: SparkSession, sf: str) -> DataFrame:
    t = tb.site_weather(spark, sf).select(F.col("site").alias("series_key"), "ts", "temperature_c")
    return panel.resolve_panel(tb.hourly(spark, sf), t).select("series_key", h("ts"), r("demand_mwh"), r("temperature_c"))


@query(f"WITH {q.G} SELECT series_key, {HOURS.format('ts')} AS h, round(temp, 4) AS temperature_c, true AS had_any FROM p")
def drop_columns(spark: SparkSession, sf: str) -> DataFrame:
    p = tb.panel(spark, sf)
    kept, had = panel.drop_columns(p, ["absent", "demand_mwh", *[c for c in p.columns if c.startswith("fcst_")]])
    assert not {"demand_mwh", "fcst_temperature_c"} & set(kept.columns)
    return kept.select("series_key", h("ts"), r("temperature_c"), F.lit(had).alias("had_any"))


# -- lake and streams


def _orders(sf: str) -> TableSpec:
    return TableSpec("orders", ("o_orderkey",), "o_orderdate", f"{sf}/orders.parquet")


@query("SELECT o_orderkey, o_orderpriority FROM orders")
def read_dataset(spark: SparkSession, sf: str) -> DataFrame:
    spec = _orders(sf)
    return lake.read_dataset(spark, spec, spark.read.parquet(spec.path).schema, ["o_orderkey", "o_orderpriority"])


@query("SELECT count(*) AS n FROM orders")
def count_rows(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(lake.count_rows(spark, _orders(sf)),)], "n long")


@query("SELECT o_orderpriority, count(*) AS n, true AS is_real, 'a test' AS warning FROM orders GROUP BY 1")
def published_rows(spark: SparkSession, sf: str) -> DataFrame:
    counts = tb.table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return lake.published(counts, True, "a test").drop("generated_at_utc")


@query("SELECT event_type AS site, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1")
def union_sites(spark: SparkSession, sf: str) -> DataFrame:
    e = tb.events(spark, sf).select("site", "value")
    names = sorted(x[0] for x in e.select("site").distinct().collect())  # a handful of site names
    whole = lake.union_sites([e.where(F.col("site") == n) for n in names])
    return whole.groupBy("site").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))


@query(f"WITH {q.D} SELECT series_key, CAST(ts AS DATE) AS day, avg(demand) AS mean, count(demand) AS n FROM d GROUP BY 1, 2")
def daily_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """The stream's tumbling days on a table: watermarks have no effect there."""
    return ingest.daily_buckets(tb.hourly(spark, sf)).select("series_key", F.to_date("day").alias("day"), "mean", "n")


@query(f"WITH {q.D} SELECT series_key, CAST(ts AS DATE) + CAST(k AS INTEGER) AS until, avg(demand) AS mean, count(demand) AS n FROM d, (SELECT unnest(generate_series(1, 7)) AS k) GROUP BY 1, 2")
def trailing_week(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.trailing_week(tb.hourly(spark, sf)).select("series_key", F.to_date("until").alias("until"), "mean", "n")


@query(
    q.SQL["holiday_flag"].split("SELECT CAST(o_orderdate AS DATE)")[0]
    + ", lo AS (SELECT o_orderkey, CAST(timezone('America/New_York', timezone('UTC', CAST(o_orderdate AS TIMESTAMP))) AS DATE) AS day FROM orders) SELECT day, count(*) AS orders, CASE WHEN day IN (SELECT CAST(day AS DATE) FROM hd) THEN 1 ELSE 0 END AS is_holiday FROM lo GROUP BY 1"
)
def local_holiday(spark: SparkSession, sf: str) -> DataFrame:
    """Holidays by the local day of each order's instant, which is the day before at midnight UTC."""
    from ..functions.core import local_date

    o = tb.table(spark, sf, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp"))
    o = flag(o, "at", "America/New_York").withColumn("day", local_date("at", "America/New_York"))
    return o.groupBy("day").agg(F.count("*").alias("orders"), F.max("is_holiday").alias("is_holiday"))


# -- drift and verdicts


@query(f"WITH {PRICES}, {STATS} SELECT k AS l_returnflag, column_name AS column, CAST(bin AS BIGINT) AS bin, nr AS n_reference, nc AS n_current, round((a - e) * ln(a / e), 6) AS term FROM sh")
def psi_bins(spark: SparkSession, sf: str) -> DataFrame:
    p = st.psi(q._prices(spark, sf), ["l_returnflag"], detail=True)
    p = p.select("l_returnflag", "column", F.explode("psi_bins").alias("b"))
    return p.select("l_returnflag", "column", F.col("b.bin").cast("long").alias("bin"), "b.n_reference", "b.n_current", F.round("b.term", 6).alias("term"))


@query(f"WITH {DAY}, {SCORED_LONG}, {STATS} SELECT k AS series_key, column_name AS column, round(psi, 6) AS psi FROM cmp WHERE column_name NOT IN ('y', 'prediction') ORDER BY column_name = 'dayofweek', psi DESC, column_name, k LIMIT 7")
def ordered_features(spark: SparkSession, sf: str) -> DataFrame:
    """The seven worst, those that may vote first: the limit is the report's."""
    c = drift.distribution_drift(tb.scored(spark, sf), list(SCORED_FEATURES), LINES)
    return drift.ordered_features(c, top=7).select("series_key", "column", r("psi", 6))


@query(
    f"""WITH {DAY}, {SCORED_LONG}, {STATS}, {SECTIONS}, {PERF},
    al AS (SELECT k AS series_key, section, severity, 'psi' AS metric, max_psi AS value, CASE severity WHEN 'alert' THEN 0.2 ELSE 0.1 END AS threshold, CASE section WHEN 'feature' THEN 0 WHEN 'target' THEN 1 ELSE 2 END AS place FROM sv UNION ALL SELECT series_key, 'performance', severity, 'mae_degradation', mae_degradation, CASE severity WHEN 'alert' THEN 0.3 ELSE 0.15 END, 3 FROM pe)
    SELECT series_key, row_number() OVER (PARTITION BY series_key ORDER BY CASE severity WHEN 'alert' THEN 0 ELSE 1 END, place) - 1 AS place, section, severity, metric, round(value, 6) AS value, CAST(threshold AS DOUBLE) AS threshold FROM al WHERE severity <> 'ok'"""
)
def reasons(spark: SparkSession, sf: str) -> DataFrame:
    v = policy.evaluate(drift.drift_sections(tb.scored(spark, sf), list(SCORED_FEATURES), LINES), LINES)
    v = v.select("series_key", F.posexplode("reasons").alias("place", "x"))
    return v.select("series_key", F.col("place").cast("long").alias("place"), "x.section", "x.severity", "x.metric", F.round("x.value", 6).alias("value"), "x.threshold")


@query(f"WITH {DAY} SELECT series_key, count(*) FILTER (WHERE win = 'current') AS current_n, count(*) FILTER (WHERE win = 'current') >= 195 AS measurable, CASE WHEN count(*) FILTER (WHERE win = 'current') < 195 THEN 'R0_champion_is_current' ELSE 'R5_none' END AS rule FROM allw GROUP BY 1")
def champion_is_current(spark: SparkSession, sf: str) -> DataFrame:
    counts = drift.split_counts(drift.split_windows(tb.daily_design(spark, sf), WINDOWS))
    calm = counts.select("series_key", F.lit("target").alias("section"), F.lit("ok").alias("severity"), F.lit(False).alias("insufficient_data"), F.lit("psi").alias("metric"), F.lit(0.0).alias("value")).distinct()
    v = policy.champion_is_current(policy.evaluate(calm), counts, replace(LINES, min_samples=195))
    return v.select("series_key", "current_n", "measurable", "rule")


@query(
    f"WITH {DAY}, dy AS (SELECT series_key, CAST(target_ts AS DATE) AS day, avg(abs_error) AS mae FROM sc GROUP BY 1, 2), ro AS (SELECT series_key, day, avg(mae) OVER (PARTITION BY series_key ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS m FROM dy) SELECT series_key, round(max(m), 4) AS worst_mae_rolling, arg_max(day, m) AS worst_day FROM ro WHERE m IS NOT NULL GROUP BY 1"
)
def worst_day(spark: SparkSession, sf: str) -> DataFrame:
    return drift.worst_day(drift.rolling_error_series(tb.scored(spark, sf), LINES)).select("series_key", r("worst_mae_rolling"), "worst_day")


def _mean_of_train(train: DataFrame, rows: DataFrame) -> DataFrame:
    return rows.join(train.groupBy("series_key").agg(F.avg("y").alias("prediction")), "series_key")


@query(
    f"WITH {DAY}, me AS (SELECT series_key, avg(y) AS prediction FROM allw WHERE win = 'train' GROUP BY 1), sc2 AS (SELECT a.series_key, a.win, m.prediction - y AS error, abs(m.prediction - y) AS abs_error, abs(m.prediction - y) / nullif(abs(y), 0) * 100 AS pct FROM allw a JOIN me m USING (series_key) WHERE win <> 'train'), {WERR.replace('FROM sc ', 'FROM sc2 ')} SELECT series_key, win AS window, n, mae, mape_pct, rmse, bias FROM we"
)
def score_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Both windows scored by a model that saw the train rows only: their mean."""
    return drift.window_errors(drift.score_windows(drift.split_windows(tb.daily_design(spark, sf), WINDOWS), _mean_of_train))


@query(
    f"""WITH {DAY}, {SCORED_LONG}, {STATS}, cs AS (SELECT cn.k, cn.column_name, nr / greatest(sum(nr) OVER w, 1) AS p, nc / greatest(sum(nc) OVER w, 1) AS s FROM cn JOIN inn ON inn.k = cn.k AND inn.column_name = cn.column_name WHERE categorical WINDOW w AS (PARTITION BY cn.k, cn.column_name)),
    js AS (SELECT k, column_name, sqrt(greatest(0, sum((CASE WHEN p > 0 THEN p * log2(p / ((p + s) / 2)) ELSE 0 END + CASE WHEN s > 0 THEN s * log2(s / ((p + s) / 2)) ELSE 0 END) / 2))) AS js FROM cs GROUP BY 1, 2),
    dr AS (SELECT tot.k, CASE WHEN js.js IS NOT NULL THEN js.js > 0.1 ELSE kq.ks_p < 0.05 END AS drifted FROM tot LEFT JOIN kq ON kq.k = tot.k AND kq.column_name = tot.column_name LEFT JOIN js ON js.k = tot.k AND js.column_name = tot.column_name)
    SELECT k AS series_key, count(*) FILTER (WHERE drifted) AS drifted_columns, avg(CAST(drifted AS INT)) AS drifted_share, count(*) AS columns, 'measured' AS status FROM dr GROUP BY 1"""
)
def second_opinion(spark: SparkSession, sf: str) -> DataFrame:
    return drift.second_opinion(tb.scored(spark, sf), [*SCORED_FEATURES, "y", "prediction"], t=LINES)


@query(
    f"""WITH {DAY}, fh AS (SELECT series_key, target_ts, prediction AS forecast, y AS actual, 'scored' AS kind FROM (SELECT *, max(target_ts) OVER (PARTITION BY series_key) AS last_ts FROM sc) WHERE target_ts >= last_ts - INTERVAL 21 DAY),
    fw AS (SELECT series_key, target_ts + INTERVAL 7 DAY AS target_ts, y AS forecast, CAST(NULL AS DOUBLE) AS actual, 'live' AS kind FROM (SELECT *, max(target_ts) OVER (PARTITION BY series_key) AS last_ts FROM sc) WHERE target_ts > last_ts - INTERVAL 7 DAY),
    ch AS (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY target_ts DESC, kind) AS n FROM (SELECT * FROM fh UNION ALL SELECT * FROM fw)) SELECT series_key, CAST(target_ts AS DATE) AS day, round(forecast, 4) AS forecast, round(actual, 4) AS actual, kind FROM ch WHERE n <= 20"""
)
def chart_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The newest twenty of each series, scored and live: the limit is the chart's."""
    s = tb.scored(spark, sf)
    ends = s.groupBy("series_key").agg(F.max("target_ts").alias("last_ts"))
    week = F.expr("INTERVAL 7 DAYS")
    forward = s.join(ends, "series_key").where(F.col("target_ts") > F.col("last_ts") - week)
    forward = forward.select("series_key", (F.col("target_ts") + week).alias("target_ts"), F.col("y").alias("prediction"), F.lit(None).cast("double").alias("actual"))
    c = models.chart_rows(models.forecast_history(s), forward, last=20)
    return c.select("series_key", F.to_date("target_ts").alias("day"), r("forecast"), r("actual"), "kind")
