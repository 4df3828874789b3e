"""Registered queries, each over whole tables, and their SQL where SQL can say the same.

Doubles are rounded on both sides; times are given as whole hours since the epoch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import hours
from ..operators import backtest, design, drift, models, panel, policy
from ..operators import statistics as st
from ..sources import lake, payloads
from ..specs import TableSpec
from . import tables as tb
from .tables import DAILY, HOURLY, LINES, SCORED_FEATURES, WINDOWS

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r(c: str, places: int = 4):
    return F.round(F.col(c), places).alias(c)


def h(c: str, name: str = "h"):
    return hours(c).alias(name)


# -- fragments of SQL that several queries share

HOURS = "CAST(floor(epoch({}) / 3600) AS BIGINT)"
D = "d AS (SELECT event_type AS series_key, date_trunc('hour', ts) AS ts, sum(value) AS demand, avg(value) AS temp, max(value) AS fcst FROM events GROUP BY 1, 2)"
G = f"{D}, g AS (SELECT series_key, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM d GROUP BY 1), p AS (SELECT g.series_key, g.ts, d.demand, d.temp, d.fcst FROM g LEFT JOIN d ON g.series_key = d.series_key AND g.ts = d.ts)"
DAY = """dd AS (SELECT l_returnflag AS series_key, date_trunc('day', l_shipdate) AS ts, sum(l_quantity) AS demand FROM lineitem GROUP BY 1, 2),
gg AS (SELECT series_key, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM dd GROUP BY 1),
pp AS (SELECT gg.series_key, CAST(gg.ts AS TIMESTAMP) AS ts, dd.demand, lag(dd.demand, 7) OVER w AS lag7, lag(dd.demand, 14) OVER w AS lag14 FROM gg LEFT JOIN dd ON gg.series_key = dd.series_key AND gg.ts = dd.ts WINDOW w AS (PARTITION BY gg.series_key ORDER BY gg.ts)),
ends AS (SELECT series_key, max(ts) - INTERVAL 200 DAY AS cur FROM pp GROUP BY 1),
allw AS (SELECT pp.series_key, pp.ts AS target_ts, demand AS y, lag7, lag14, CAST(isodow(pp.ts) - 1 AS INTEGER) AS dow, CASE WHEN pp.ts >= cur THEN 'current' WHEN pp.ts >= cur - INTERVAL 200 DAY THEN 'reference' ELSE 'train' END AS win FROM pp JOIN ends USING (series_key) WHERE demand IS NOT NULL),
sc AS (SELECT *, lag7 AS prediction, lag7 - y AS error, abs(lag7 - y) AS abs_error, abs(lag7 - y) / nullif(abs(y), 0) * 100 AS pct FROM allw WHERE win <> 'train')"""
WERR = "we AS (SELECT series_key, win, count(error) AS n, round(avg(abs_error), 4) AS mae, round(avg(pct), 4) AS mape_pct, round(sqrt(avg(error * error)), 4) AS rmse, round(avg(error), 4) AS bias FROM sc GROUP BY 1, 2)"
#: PSI and KS of a long table lg (k, column_name, win, v)
STATS = """lv AS (SELECT k, column_name, count(DISTINCT v) AS n_levels FROM lg WHERE win = 'reference' GROUP BY 1, 2),
ed AS (SELECT k, column_name, list_sort(list_distinct(quantile_cont(v, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS q FROM lg WHERE win = 'reference' GROUP BY 1, 2),
inn AS (SELECT ed.k, ed.column_name, len(q) AS nq, n_levels <= 24 AS categorical, q[2:len(q)-1] AS inner_edges FROM ed JOIN lv ON ed.k = lv.k AND ed.column_name = lv.column_name),
lvs AS (SELECT k, column_name, v, row_number() OVER (PARTITION BY k, column_name ORDER BY v) AS bin FROM (SELECT DISTINCT k, column_name, v FROM lg WHERE win = 'reference')),
bn AS (SELECT lg.k, lg.column_name, lg.win, lg.v, CASE WHEN categorical THEN coalesce(lvs.bin, 0) ELSE len(list_filter(inner_edges, lambda e: e <= lg.v)) + 1 END AS bin FROM lg JOIN inn ON lg.k = inn.k AND lg.column_name = inn.column_name LEFT JOIN lvs ON lvs.k = lg.k AND lvs.column_name = lg.column_name AND lvs.v = lg.v),
bins AS (SELECT k, column_name, unnest(generate_series(CASE WHEN categorical THEN 0 ELSE 1 END, CASE WHEN categorical THEN (SELECT max(n_levels) FROM lv WHERE lv.k = inn.k AND lv.column_name = inn.column_name) ELSE nq - 1 END)) AS bin FROM inn WHERE categorical OR nq >= 2),
cn AS (SELECT bins.k, bins.column_name, bins.bin, count(*) FILTER (WHERE bn.win = 'reference') AS nr, count(*) FILTER (WHERE bn.win = 'current') AS nc FROM bins LEFT JOIN bn ON bn.k = bins.k AND bn.column_name = bins.column_name AND bn.bin = bins.bin GROUP BY 1, 2, 3),
sh AS (SELECT *, greatest(nr / greatest(sum(nr) OVER (PARTITION BY k, column_name), 1), 1e-6) AS e, greatest(nc / greatest(sum(nc) OVER (PARTITION BY k, column_name), 1), 1e-6) AS a FROM cn),
ps AS (SELECT k, column_name, sum((a - e) * ln(a / e)) AS psi FROM sh GROUP BY 1, 2),
tot AS (SELECT k, column_name, count(*) FILTER (WHERE win = 'reference') AS n_reference, count(*) FILTER (WHERE win = 'current') AS n_current FROM lg GROUP BY 1, 2),
vc AS (SELECT k, column_name, v, count(*) FILTER (WHERE win = 'reference') AS nr, count(*) FILTER (WHERE win = 'current') AS nc FROM lg GROUP BY 1, 2, 3),
cd AS (SELECT k, column_name, sum(nr) OVER w AS cr, sum(nc) OVER w AS cc FROM vc WINDOW w AS (PARTITION BY k, column_name ORDER BY v)),
ks AS (SELECT cd.k, cd.column_name, max(abs(cr / n_reference - cc / n_current)) AS ks_d FROM cd JOIN tot ON cd.k = tot.k AND cd.column_name = tot.column_name WHERE n_reference > 0 AND n_current > 0 GROUP BY 1, 2),
kp AS (SELECT ks.k, ks.column_name, ks_d, (sqrt(n_reference * n_current / (n_reference + n_current)) + 0.12 + 0.11 / sqrt(n_reference * n_current / (n_reference + n_current))) * ks_d AS lam FROM ks JOIN tot ON ks.k = tot.k AND ks.column_name = tot.column_name),
kq AS (SELECT k, column_name, ks_d, CASE WHEN ks_d <= 0 THEN 1.0 ELSE least(1.0, greatest(0.0, list_sum(list_transform(generate_series(1, 100), lambda i: 2.0 * (CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * lam * lam * i * i))))) END AS ks_p FROM kp),
cmp AS (SELECT tot.k, tot.column_name, n_reference, n_current, psi, ks_d, ks_p, least(n_reference, n_current) < 100 AS insufficient_data, CASE WHEN least(n_reference, n_current) < 100 THEN 'ok' WHEN psi >= 0.2 THEN 'alert' WHEN psi >= 0.1 THEN 'warn' WHEN ks_p < 0.01 THEN 'warn' ELSE 'ok' END AS severity FROM tot JOIN ps ON tot.k = ps.k AND tot.column_name = ps.column_name JOIN kq ON tot.k = kq.k AND tot.column_name = kq.column_name)"""
PRICES = """base AS (SELECT l_returnflag AS k, CASE WHEN l_shipdate < TIMESTAMP '1998-06-01' THEN 'reference' ELSE 'current' END AS win, l_quantity, l_extendedprice, l_discount, l_tax, CAST(l_linenumber AS DOUBLE) AS l_linenumber FROM lineitem),
lg AS (SELECT k, win, 'l_quantity' AS column_name, l_quantity AS v FROM base UNION ALL SELECT k, win, 'l_extendedprice', l_extendedprice FROM base UNION ALL SELECT k, win, 'l_discount', l_discount FROM base UNION ALL SELECT k, win, 'l_tax', l_tax FROM base UNION ALL SELECT k, win, 'l_linenumber', l_linenumber FROM base)"""
SCORED_LONG = """lg AS (SELECT series_key AS k, win, 'demand_lag_168h' AS column_name, lag7 AS v FROM sc WHERE lag7 IS NOT NULL UNION ALL SELECT series_key, win, 'demand_lag_336h', lag14 FROM sc WHERE lag14 IS NOT NULL UNION ALL SELECT series_key, win, 'dayofweek', CAST(dow AS DOUBLE) FROM sc UNION ALL SELECT series_key, win, 'y', y FROM sc UNION ALL SELECT series_key, win, 'prediction', prediction FROM sc WHERE prediction IS NOT NULL)"""
SECTIONS = """cs AS (SELECT *, CASE WHEN column_name = 'y' THEN 'target' WHEN column_name = 'prediction' THEN 'prediction' ELSE 'feature' END AS section, column_name <> 'dayofweek' AND NOT insufficient_data AS votes FROM cmp),
sr AS (SELECT k, section, count(*) FILTER (WHERE votes) AS columns_scored, count(*) FILTER (WHERE votes AND severity = 'alert') AS alerting, count(*) FILTER (WHERE votes AND severity = 'warn') AS warning, max(psi) FILTER (WHERE votes) AS max_psi, max(CASE severity WHEN 'alert' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) FILTER (WHERE votes) AS worst, bool_and(insufficient_data) AS insufficient_data FROM cs GROUP BY 1, 2),
sv AS (SELECT *, coalesce(alerting / nullif(columns_scored, 0), 0) AS drifted_share, CASE WHEN columns_scored = 0 THEN 'ok' WHEN columns_scored = 1 THEN CASE worst WHEN 2 THEN 'alert' WHEN 1 THEN 'warn' ELSE 'ok' END WHEN alerting / columns_scored >= 0.3 THEN 'alert' WHEN alerting > 0 OR warning > 0 THEN 'warn' ELSE 'ok' END AS severity FROM sr)"""
PERF = f"""{WERR}, pf AS (SELECT series_key, max(n) FILTER (WHERE win = 'reference') AS reference_n, max(n) FILTER (WHERE win = 'current') AS current_n, max(mae) FILTER (WHERE win = 'reference') AS reference_mae, max(mae) FILTER (WHERE win = 'current') AS current_mae, max(mape_pct) FILTER (WHERE win = 'reference') AS rp, max(mape_pct) FILTER (WHERE win = 'current') AS cp FROM we GROUP BY 1),
pd AS (SELECT *, current_mae / nullif(reference_mae, 0) - 1 AS mae_degradation, cp - rp AS mape_delta_pp FROM pf),
pv AS (SELECT *, least(coalesce(reference_n, 0), coalesce(current_n, 0)) < 100 OR mae_degradation IS NULL AS insufficient_data FROM pd),
pe AS (SELECT *, CASE WHEN insufficient_data THEN 'ok' WHEN mae_degradation >= 0.3 OR coalesce(mape_delta_pp, 0) >= 1.0 THEN 'alert' WHEN mae_degradation >= 0.15 OR coalesce(mape_delta_pp, 0) >= 0.5 THEN 'warn' ELSE 'ok' END AS severity FROM pv)"""


# -- panel


@query(f"WITH {G} SELECT series_key, {HOURS.format('ts')} AS h, round(demand, 4) AS demand_mwh FROM p")
def hour_grid(spark: SparkSession, sf: str) -> DataFrame:
    d = tb.hourly(spark, sf)
    return panel.hour_grid(d).join(d, ["series_key", "ts"], "left").select("series_key", h("ts"), r("demand_mwh"))


@query(f"SELECT event_type, {HOURS.format('ts')} AS h, arg_max(event_id, event_id) AS event_id, round(arg_max(value, event_id), 4) AS value FROM events GROUP BY 1, 2")
def keep_newest(spark: SparkSession, sf: str) -> DataFrame:
    e = tb.events(spark, sf).select("event_type", h("ts"), "event_id", "value")
    return lake.keep_newest(e, ["event_type", "h"], ["event_id"]).select("event_type", "h", "event_id", r("value"))


@query(f"SELECT upper(event_type) AS series_key, {HOURS.format('ts')} AS h, round(arg_max(value, event_id), 4) AS demand_mwh FROM events GROUP BY 1, 2")
def load_demand(spark: SparkSession, sf: str) -> DataFrame:
    e = tb.events(spark, sf).select(F.upper("event_type").alias("respondent"), F.col("hour_ts").alias("timestamp_utc"), F.col("value").alias("demand_mwh"), F.col("event_id").alias("ingested_at_utc"))
    return panel.load_demand(e).select("series_key", h("ts"), r("demand_mwh"))


@query(f"SELECT upper(event_type) AS series_key, {HOURS.format('ts')} AS h, round(arg_max(value, event_id), 4) AS demand_mwh FROM events WHERE lower(event_type) = 'click' GROUP BY 1, 2")
def load_demand_of_one(spark: SparkSession, sf: str) -> DataFrame:
    e = tb.events(spark, sf).select(F.upper("event_type").alias("respondent"), F.col("hour_ts").alias("timestamp_utc"), F.col("value").alias("demand_mwh"), F.col("event_id").alias("ingested_at_utc"))
    return panel.load_demand(e, "click").select("series_key", h("ts"), r("demand_mwh"))


_W = "wt AS (SELECT site, CASE n WHEN 1 THEN 0.4 WHEN 2 THEN 0.3 WHEN 3 THEN 0.2 WHEN 4 THEN 0.1 END AS weight FROM (SELECT site, row_number() OVER (ORDER BY site) AS n FROM (SELECT DISTINCT event_type AS site FROM events)) WHERE n <= 4), sw AS (SELECT event_type AS site, date_trunc('hour', ts) AS ts, avg(value) AS t, max(value) AS hu, min(value) AS dp, sum(value) AS wi, CAST(count(*) AS DOUBLE) AS cl FROM events GROUP BY 1, 2)"


@query(f"WITH {_W} SELECT {HOURS.format('ts')} AS h, sum(t * weight) / sum(weight) AS temperature_c FROM sw JOIN wt USING (site) GROUP BY ts")
def blend_by_site(spark: SparkSession, sf: str) -> DataFrame:
    b = panel.load_temperature_blend(tb.site_weather(spark, sf), tb.weights(spark, sf), ["ts"])
    return b.select(h("ts"), "temperature_c")  # not rounded: many values lie on a rounding tie


@query(f"WITH {_W} SELECT {HOURS.format('ts')} AS h, round(max(t) - min(t), 4) AS spread FROM sw GROUP BY ts")
def site_spread(spark: SparkSession, sf: str) -> DataFrame:
    return panel.site_spread(tb.site_weather(spark, sf), "temperature_c", ["ts"]).select(h("ts"), r("spread"))


@query(
    f"""WITH {_W}, b AS (SELECT ts, sum(t * weight) / sum(weight) AS a1, sum(hu * weight) / sum(weight) AS a2, sum(dp * weight) / sum(weight) AS a3, sum(wi * weight) / sum(weight) AS a4, sum(cl * weight) / sum(weight) AS a5 FROM sw JOIN wt USING (site) GROUP BY ts), s AS (SELECT ts, max(t) - min(t) AS a6 FROM sw GROUP BY ts)
    SELECT {HOURS.format('b.ts')} AS h, a1 AS fcst_temperature_c, a2 AS fcst_humidity_pct, a3 AS fcst_dewpoint_c, a4 AS fcst_wind_kmh, a5 AS fcst_cloud_pct, a6 AS fcst_temperature_spread_c FROM b JOIN s ON b.ts = s.ts"""
)
def load_weather_forecast(spark: SparkSession, sf: str) -> DataFrame:
    b = panel.load_weather_forecast(tb.site_weather(spark, sf), tb.weights(spark, sf), ["ts"])
    return b.select(h("ts"), *[c for c in b.columns if c != "ts"])


@query(f"WITH {G} SELECT series_key, {HOURS.format('ts')} AS h, hour(ts) AS hour, isodow(ts) - 1 AS dayofweek, month(ts) AS month, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM p")
def add_calendar(spark: SparkSession, sf: str) -> DataFrame:
    p = panel.add_calendar(panel.hour_grid(tb.hourly(spark, sf)))
    return p.select("series_key", h("ts"), *[F.col(c).cast("long").alias(c) for c in ("hour", "dayofweek", "month", "is_weekend")])


@query(f"WITH {G} SELECT count(*) AS rows, {HOURS.format('min(ts)')} AS first_h, {HOURS.format('max(ts)')} AS last_h, count(*) FILTER (WHERE demand IS NULL) AS missing_demand, count(temp) > 0 AS has_temperature, count(fcst) > 0 AS has_forecast FROM p")
def describe_panel(spark: SparkSession, sf: str) -> DataFrame:
    p = panel.describe_panel(tb.panel(spark, sf))
    return p.select("rows", h("first_ts", "first_h"), h("last_ts", "last_h"), "missing_demand", "has_temperature", "has_forecast")


@query(
    """WITH y AS (SELECT unnest(generate_series(1989, 2031)) AS y), fx AS (SELECT make_date(y, m, d) AS day FROM y, (VALUES (1, 1, 0), (6, 19, 2021), (7, 4, 0), (11, 11, 0), (12, 25, 0)) AS f(m, d, since) WHERE y >= since),
    ob AS (SELECT CASE isodow(day) WHEN 6 THEN day - 1 WHEN 7 THEN day + 1 ELSE day END AS day FROM fx),
    al AS (SELECT make_date(y, m, d) AS day, m FROM y, (VALUES (1), (2), (5), (9), (10), (11)) AS mm(m), (SELECT unnest(generate_series(1, 31)) AS d) WHERE d <= day(last_day(make_date(y, m, 1)))),
    fl AS (SELECT day FROM al WHERE (m = 1 AND isodow(day) = 1 AND day(day) BETWEEN 15 AND 21) OR (m = 2 AND isodow(day) = 1 AND day(day) BETWEEN 15 AND 21) OR (m = 5 AND isodow(day) = 1 AND day(day) >= 25) OR (m = 9 AND isodow(day) = 1 AND day(day) <= 7) OR (m = 10 AND isodow(day) = 1 AND day(day) BETWEEN 8 AND 14) OR (m = 11 AND isodow(day) = 4 AND day(day) BETWEEN 22 AND 28)),
    hd AS (SELECT day FROM ob UNION SELECT day FROM fl)
    SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS orders, CASE WHEN CAST(o_orderdate AS DATE) IN (SELECT CAST(day AS DATE) FROM hd) THEN 1 ELSE 0 END AS is_holiday FROM orders GROUP BY 1, 3"""
)
def holiday_flag(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.core import holiday_flag as flag

    days = tb.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("orders"))
    return flag(days.withColumn("noon", F.col("day").cast("timestamp") + F.expr("INTERVAL 12 HOURS")), "noon", "UTC").select("day", "orders", "is_holiday")


@query(
    f"WITH {G}, s AS (SELECT *, ts >= max(ts) OVER (PARTITION BY series_key) - INTERVAL 5 DAY AS injected FROM p) SELECT series_key, {HOURS.format('ts')} AS h, injected, round(CASE WHEN injected THEN demand * 1.2 + 5 ELSE demand END, 4) AS demand_mwh, round(CASE WHEN injected THEN temp + 3 ELSE temp END, 4) AS temperature_c FROM s"
)
def inject_shift(spark: SparkSession, sf: str) -> DataFrame:
    s = panel.inject_shift(tb.panel(spark, sf), last_days=5, scale=1.2, offset=5.0, temperature_offset=3.0)
    return s.select("series_key", h("ts"), "injected", r("demand_mwh"), r("temperature_c"))


@query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1996-01-01' GROUP BY 1")
def slice_window(spark: SparkSession, sf: str) -> DataFrame:
    li = tb.table(spark, sf, "lineitem").withColumn("ts", F.col("l_shipdate").cast("timestamp"))
    return panel.slice_window(li, "1995-01-01", "1995-12-31").groupBy("l_returnflag").agg(F.count("*").alias("n"))


# -- design


@query(f"WITH {G}, e AS (SELECT series_key, epoch(min(ts)) / 3600 + 96 AS a, epoch(max(ts)) / 3600 - 24 AS b FROM p GROUP BY 1) SELECT series_key, unnest(generate_series(CAST(a AS BIGINT), CAST(b AS BIGINT), 12)) AS h FROM e WHERE a <= b")
def training_origins(spark: SparkSession, sf: str) -> DataFrame:
    return design.training_origins(panel.hour_grid(tb.hourly(spark, sf)), HOURLY).select("series_key", h("origin_ts"))


_ROLL = "CASE WHEN count(demand) OVER w >= 12 THEN {} END"


@query(
    f"""WITH {G} SELECT series_key, {HOURS.format('ts')} AS h, round({_ROLL.format('avg(demand) OVER w')}, 4) AS demand_mwh_roll_mean_24h, round({_ROLL.format('stddev_samp(demand) OVER w')}, 4) AS demand_mwh_roll_std_24h, round({_ROLL.format('min(demand) OVER w')}, 4) AS demand_mwh_roll_min_24h, round({_ROLL.format('max(demand) OVER w')}, 4) AS demand_mwh_roll_max_24h
    FROM p WINDOW w AS (PARTITION BY series_key ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING)"""
)
def rolling_before(spark: SparkSession, sf: str) -> DataFrame:
    p = design.rolling_before(tb.panel(spark, sf), "demand_mwh", 24, HOURLY)
    return p.select("series_key", h("ts"), *[r(f"demand_mwh_roll_{a}_24h") for a in ("mean", "std", "min", "max")])


_SEASON = "(SELECT avg(x) FROM (SELECT unnest([CASE WHEN hz < 24 THEN l24 END, CASE WHEN hz < 48 THEN l48 END, l72, l96]) AS x))"
_DM = f"""{G}, wn AS (SELECT *, lag(demand, 24) OVER o AS l24, lag(demand, 48) OVER o AS l48, lag(demand, 72) OVER o AS l72, lag(demand, 96) OVER o AS l96, lag(temp, 48) OVER o AS t48, lag(demand) OVER o AS d1, lag(temp) OVER o AS t1,
 CASE WHEN count(demand) OVER s >= 12 THEN avg(demand) OVER s END AS rm, CASE WHEN count(demand) OVER s >= 12 THEN stddev_samp(demand) OVER s END AS rs, CASE WHEN count(demand) OVER s >= 12 THEN min(demand) OVER s END AS rn, CASE WHEN count(demand) OVER s >= 12 THEN max(demand) OVER s END AS rx,
 CASE WHEN count(demand) OVER l >= 36 THEN avg(demand) OVER l END AS rl, CASE WHEN count(temp) OVER s >= 12 THEN avg(temp) OVER s END AS tm
 FROM p WINDOW o AS (PARTITION BY series_key ORDER BY ts), s AS (PARTITION BY series_key ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING), l AS (PARTITION BY series_key ORDER BY ts RANGE BETWEEN INTERVAL 72 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING)),
 og AS (SELECT series_key, unnest(generate_series(min(ts) + INTERVAL 96 HOUR, max(ts) - INTERVAL 24 HOUR, INTERVAL 12 HOUR)) AS origin FROM p GROUP BY 1 HAVING min(ts) + INTERVAL 96 HOUR <= max(ts) - INTERVAL 24 HOUR),
 oh AS (SELECT series_key, origin, hz, origin + hz * INTERVAL 1 HOUR AS target FROM og, (SELECT unnest(generate_series(1, 24)) AS hz)),
 dm AS (SELECT oh.series_key, oh.origin, oh.hz, oh.target, CASE WHEN hz < 24 THEN t.l24 END AS lag24, CASE WHEN hz < 48 THEN t.l48 END AS lag48, t.l72, t.l96, CASE WHEN hz < 48 THEN t.t48 END AS tl, CASE WHEN date_trunc('day', oh.target) - INTERVAL 1 DAY + INTERVAL 12 HOUR <= oh.origin THEN t.fcst END AS ft, t.demand AS y, q.d1, q.t1, q.rm, q.rs, q.rn, q.rx, q.rl, q.tm FROM oh LEFT JOIN wn t ON t.series_key = oh.series_key AND t.ts = oh.target LEFT JOIN wn q ON q.series_key = oh.series_key AND q.ts = oh.origin),
 dz AS (SELECT *, list_filter([lag24, lag48, l72, l96], lambda x: x IS NOT NULL) AS held FROM dm)"""


def _hourly_design(spark: SparkSession, sf: str) -> DataFrame:
    p = tb.panel(spark, sf)
    return design.build_design_matrix(p, design.training_origins(p, HOURLY), HOURLY)


@query(
    f"""WITH {_DM} SELECT series_key, {HOURS.format('origin')} AS origin_h, hz AS horizon_h, hour(target) AS hour, isodow(target) - 1 AS dayofweek, CASE WHEN isodow(target) >= 6 THEN 1 ELSE 0 END AS is_weekend, round(lag24, 4) AS demand_lag_24h, round(lag48, 4) AS demand_lag_48h, round(CASE WHEN len(held) > 0 THEN list_sum(held) / len(held) END, 4) AS demand_same_season_mean, round(d1, 4) AS demand_last, round(rm, 4) AS demand_roll_mean_short, round(rs, 4) AS demand_roll_std_short, round(rn, 4) AS demand_roll_min_short, round(rx, 4) AS demand_roll_max_short, round(rl, 4) AS demand_roll_mean_long, round(tl, 4) AS temp_lag, round(t1, 4) AS temp_last, round(tm, 4) AS temp_roll_mean_short, round(ft, 4) AS temp_fcst_target, round(ft - tl, 4) AS temp_fcst_minus_lag, round(y, 4) AS y FROM dz"""
)
def design_matrix(spark: SparkSession, sf: str) -> DataFrame:
    d = _hourly_design(spark, sf)
    ints = [F.col(c).cast("long").alias(c) for c in ("horizon_h", "hour", "dayofweek", "is_weekend")]
    names = ["demand_lag_24h", "demand_lag_48h", "demand_same_season_mean", "demand_last", "demand_roll_mean_short", "demand_roll_std_short", "demand_roll_min_short", "demand_roll_max_short"]
    names += ["demand_roll_mean_long", "temp_lag", "temp_last", "temp_roll_mean_short", "temp_fcst_target", "temp_fcst_minus_lag", "y"]
    return d.select("series_key", h("origin_ts", "origin_h"), *ints, *[r(c) for c in names])


@query(f"WITH {_DM} SELECT series_key, {HOURS.format('origin')} AS origin_h, hz AS horizon_h, round(lag24, 4) AS demand_lag_24h, round(lag48, 4) AS demand_lag_48h FROM dm")
def lag_at_target(spark: SparkSession, sf: str) -> DataFrame:
    return _hourly_design(spark, sf).select("series_key", h("origin_ts", "origin_h"), F.col("horizon_h").cast("long").alias("horizon_h"), r("demand_lag_24h"), r("demand_lag_48h"))


@query(f"WITH {_DM} SELECT series_key, {HOURS.format('origin')} AS origin_h, hz AS horizon_h, round(CASE WHEN len(held) > 0 THEN list_sum(held) / len(held) END, 4) AS demand_same_season_mean FROM dz")
def same_season_mean(spark: SparkSession, sf: str) -> DataFrame:
    return _hourly_design(spark, sf).select("series_key", h("origin_ts", "origin_h"), F.col("horizon_h").cast("long").alias("horizon_h"), r("demand_same_season_mean"))


@query(f"WITH {_DM} SELECT series_key, {HOURS.format('target')} AS target_h, hz AS horizon_h, round(ft, 4) AS temp_fcst_target FROM dm")
def published_forecast_join(spark: SparkSession, sf: str) -> DataFrame:
    return _hourly_design(spark, sf).select("series_key", h("target_ts", "target_h"), F.col("horizon_h").cast("long").alias("horizon_h"), r("temp_fcst_target"))


# -- backtests

_CUT = f"""{G}, ob AS (SELECT series_key, ts, demand FROM p WHERE demand IS NOT NULL),
 e AS (SELECT series_key, min(ts) AS lo, max(ts) AS hi FROM ob GROUP BY 1),
 c0 AS (SELECT series_key, greatest(date_trunc('day', hi - INTERVAL 21 DAY) + INTERVAL 12 HOUR, date_trunc('day', lo + INTERVAL 48 HOUR) + CASE WHEN date_trunc('day', lo + INTERVAL 48 HOUR) = lo + INTERVAL 48 HOUR THEN INTERVAL 0 DAY ELSE INTERVAL 1 DAY END + INTERVAL 12 HOUR) AS a, hi - INTERVAL 24 HOUR AS b FROM e),
 ct AS (SELECT series_key, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS cutoff FROM c0 WHERE a <= b),
 fo AS (SELECT ct.series_key, cutoff, hz, cutoff + hz * INTERVAL 1 HOUR AS target FROM ct, (SELECT unnest(generate_series(1, 24)) AS hz)),
 pr AS (SELECT fo.*, x.demand AS actual, z.demand AS prediction FROM fo LEFT JOIN ob x ON x.series_key = fo.series_key AND x.ts = fo.target LEFT JOIN ob z ON z.series_key = fo.series_key AND z.ts = fo.target - INTERVAL 48 HOUR),
 ok AS (SELECT *, bool_and(actual IS NOT NULL AND prediction IS NOT NULL AND coalesce(actual, 0) <> 0) OVER (PARTITION BY series_key, cutoff) AS fold_ok FROM pr)"""
_HOW = {"weeks": 3, "min_history": 48}


@query(f"WITH {_CUT} SELECT series_key, {HOURS.format('cutoff')} AS h FROM ct")
def make_cutoffs(spark: SparkSession, sf: str) -> DataFrame:
    return backtest.make_cutoffs(tb.hourly(spark, sf), HOURLY, **_HOW).select("series_key", h("cutoff"))


def _naive_rows(spark: SparkSession, sf: str) -> DataFrame:
    return backtest.fold_predictions(tb.panel(spark, sf).select("series_key", "ts", "demand_mwh"), backtest.seasonal_naive(HOURLY), HOURLY, **_HOW)


@query(f"WITH {_CUT} SELECT series_key, {HOURS.format('cutoff')} AS cutoff_h, hz AS horizon_h, round(actual, 4) AS actual, round(prediction, 4) AS prediction FROM ok")
def seasonal_naive(spark: SparkSession, sf: str) -> DataFrame:
    return _naive_rows(spark, sf).select("series_key", h("cutoff", "cutoff_h"), F.col("horizon_h").cast("long").alias("horizon_h"), r("actual"), r("prediction"))


@query(f"WITH {_CUT}, f AS (SELECT DISTINCT series_key, cutoff, fold_ok FROM ok) SELECT series_key, count(*) FILTER (WHERE fold_ok) AS folds, count(*) FILTER (WHERE NOT fold_ok) AS skipped FROM f GROUP BY 1")
def fold_skip(spark: SparkSession, sf: str) -> DataFrame:
    return backtest.fold_report(_naive_rows(spark, sf)).select("series_key", "folds", "skipped")


# Daily walk-forward over shipped quantities: two baselines, a week and two weeks back.
_BT = """dd AS (SELECT l_returnflag AS series_key, date_trunc('day', l_shipdate) AS ts, sum(l_quantity) AS demand FROM lineitem GROUP BY 1, 2), e AS (SELECT series_key, min(ts) AS lo, max(ts) AS hi FROM dd GROUP BY 1),
 c0 AS (SELECT series_key, greatest(date_trunc('day', hi - INTERVAL 56 DAY), date_trunc('day', lo + INTERVAL 30 DAY)) AS a, hi - INTERVAL 7 DAY AS b FROM e), ct AS (SELECT series_key, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS cutoff FROM c0 WHERE a <= b),
 fo AS (SELECT series_key, cutoff, hz * 24 AS hz, cutoff + hz * INTERVAL 1 DAY AS target FROM ct, (SELECT unnest(generate_series(1, 6)) AS hz)),
 pr AS (SELECT m.model, fo.series_key, cutoff, hz, x.demand AS actual, z.demand AS prediction FROM fo CROSS JOIN (VALUES ('week', 7), ('fortnight', 14)) AS m(model, back) LEFT JOIN dd x ON x.series_key = fo.series_key AND x.ts = fo.target LEFT JOIN dd z ON z.series_key = fo.series_key AND z.ts = fo.target - m.back * INTERVAL 1 DAY),
 ok AS (SELECT *, bool_and(actual IS NOT NULL AND prediction IS NOT NULL AND coalesce(actual, 0) <> 0) OVER (PARTITION BY model, series_key, cutoff) AS fold_ok FROM pr),
 er AS (SELECT model, hz, prediction - actual AS e, actual FROM ok WHERE fold_ok),
 me AS (SELECT model, hz, avg(abs(e)) AS mae, avg(abs(e) / abs(actual) * 100) AS mape_pct, sqrt(avg(e * e)) AS rmse, avg(e) AS bias, count(*) AS n FROM er GROUP BY GROUPING SETS ((model, hz), (model)))"""


def _daily_metrics(spark: SparkSession, sf: str) -> DataFrame:
    from dataclasses import replace

    d = tb.daily(spark, sf)
    week = replace(DAILY, cutoff_hour=0, max_horizon=144)
    two = replace(week, season=336)
    rows = None
    # The cutoffs leave a week of targets, whatever the horizon that is scored.
    cuts = backtest.make_cutoffs(d, replace(week, max_horizon=168), weeks=8, min_history=720)
    for name, spec in (("week", week), ("fortnight", two)):
        one = backtest.walk_forward(d, backtest.seasonal_naive(spec), spec, name, cutoffs=cuts)
        rows = one if rows is None else rows.unionByName(one)
    return backtest.backtest_metrics(rows)


@query(f"WITH {_BT} SELECT model, CAST(hz AS BIGINT) AS horizon_h, round(mae, 4) AS mae, round(mape_pct, 4) AS mape_pct, round(rmse, 4) AS rmse, round(bias, 4) AS bias, n FROM me")
def backtest_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _daily_metrics(spark, sf).select("model", F.col("horizon_h").cast("long").alias("horizon_h"), r("mae"), r("mape_pct"), r("rmse"), r("bias"), "n")


@query(
    f"""WITH {_BT}, j AS (SELECT a.hz, a.mae AS ma, b.mae AS mb, a.mape_pct AS pa, b.mape_pct AS pb FROM me a JOIN me b ON a.hz IS NOT DISTINCT FROM b.hz WHERE a.model = 'fortnight' AND b.model = 'week')
    SELECT round(max(ma) FILTER (WHERE hz IS NULL), 4) AS mae_baseline, round(max(mb) FILTER (WHERE hz IS NULL), 4) AS mae_challenger, round(max(mb - ma) FILTER (WHERE hz IS NULL), 4) AS mae_delta, round(max((mb - ma) / ma * 100) FILTER (WHERE hz IS NULL), 4) AS mae_delta_pct, round(max(pb - pa) FILTER (WHERE hz IS NULL), 4) AS mape_delta_pp, count(*) FILTER (WHERE hz IS NOT NULL AND mb < ma) AS horizons_won, count(hz) AS horizons_total, CASE WHEN max(mb) FILTER (WHERE hz IS NULL) < max(ma) FILTER (WHERE hz IS NULL) THEN 'champion' ELSE 'challenger' END AS alias FROM j"""
)
def compare_models(spark: SparkSession, sf: str) -> DataFrame:
    c = backtest.promotion(backtest.compare(_daily_metrics(spark, sf), "fortnight", "week"))
    return c.select(*[r(x) for x in ("mae_baseline", "mae_challenger", "mae_delta", "mae_delta_pct", "mape_delta_pp")], "horizons_won", "horizons_total", "alias")


@query(f"WITH {_BT}, w AS (SELECT model, CAST(coalesce(hz, -1) AS BIGINT) AS step, mae, mape_pct, rmse, bias, CAST(n AS DOUBLE) AS n FROM me) SELECT model, step, metric, round(value, 4) AS value FROM (UNPIVOT w ON mae, mape_pct, rmse, bias, n INTO NAME metric VALUE value)")
def metrics_long(spark: SparkSession, sf: str) -> DataFrame:
    return backtest.metrics_long(_daily_metrics(spark, sf)).select("model", F.col("step").cast("long").alias("step"), "metric", r("value"))


# -- statistics

_PRICE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def _prices(spark: SparkSession, sf: str) -> DataFrame:
    return st.long_form(tb.price_columns(spark, sf), _PRICE_COLUMNS, ["l_returnflag"])


@query(f"WITH {PRICES} SELECT k AS l_returnflag, column_name AS column, round(e, 4) AS edge FROM (SELECT k, column_name, unnest(q[2:len(q)-1]) AS e FROM (SELECT k, column_name, list_sort(list_distinct(quantile_cont(v, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS q FROM lg WHERE win = 'reference' GROUP BY 1, 2))")
def quantile_edges(spark: SparkSession, sf: str) -> DataFrame:
    e = st.quantile_edges(_prices(spark, sf), ["l_returnflag"])
    return e.select("l_returnflag", "column", F.explode("edges").alias("edge")).where("abs(edge) < 1e300").select("l_returnflag", "column", r("edge"))


@query(f"WITH {PRICES}, {STATS} SELECT k AS l_returnflag, column_name AS column, CAST(bin AS BIGINT) AS bin, nr AS n_reference, nc AS n_current FROM cn")
def histogram(spark: SparkSession, sf: str) -> DataFrame:
    return st.histogram(_prices(spark, sf), ["l_returnflag"]).select("l_returnflag", "column", F.col("bin").cast("long").alias("bin"), "n_reference", "n_current")


@query(f"WITH {PRICES}, {STATS} SELECT cn.k AS l_returnflag, cn.column_name AS column, CAST(bin AS BIGINT) AS bin, nr AS n_reference, nc AS n_current FROM cn JOIN inn ON inn.k = cn.k AND inn.column_name = cn.column_name WHERE categorical")
def level_counts(spark: SparkSession, sf: str) -> DataFrame:
    return st.level_counts(_prices(spark, sf), ["l_returnflag"]).select("l_returnflag", "column", F.col("bin").cast("long").alias("bin"), "n_reference", "n_current")


_PSI_SQL = f"WITH {PRICES}, {STATS} SELECT ps.k AS l_returnflag, ps.column_name AS column, round(psi, 6) AS psi FROM ps JOIN inn ON inn.k = ps.k AND inn.column_name = ps.column_name WHERE "


@query(_PSI_SQL + "NOT categorical")
def psi_numeric(spark: SparkSession, sf: str) -> DataFrame:
    return st.psi(_prices(spark, sf), ["l_returnflag"]).where("not categorical").select("l_returnflag", "column", r("psi", 6))


@query(_PSI_SQL + "categorical")
def psi_categorical(spark: SparkSession, sf: str) -> DataFrame:
    return st.psi(_prices(spark, sf), ["l_returnflag"]).where("categorical").select("l_returnflag", "column", r("psi", 6))


@query(f"WITH {PRICES}, {STATS} SELECT k AS l_returnflag, column_name AS column, round(ks_d, 6) AS ks_d, round(ks_p, 6) AS ks_p FROM kq")
def ks_statistic(spark: SparkSession, sf: str) -> DataFrame:
    return st.ks(_prices(spark, sf), ["l_returnflag"], buckets=16).select("l_returnflag", "column", r("ks_d", 6), r("ks_p", 6))


def _summary_sql() -> str:
    parts = []
    for s in ("reference", "current"):
        f = f"FILTER (WHERE win = '{s}')"
        parts += [f"count(v) {f} AS {s}_n", f"round(avg(v) {f}, 4) AS {s}_mean", f"round(CASE WHEN count(v) {f} = 1 THEN 0 ELSE stddev_samp(v) {f} END, 4) AS {s}_std"]
        parts += [f"round(quantile_cont(v, {p}) {f}, 4) AS {s}_p{int(p * 100):02d}" for p in (0.05, 0.5, 0.95)]
    return f"WITH {PRICES}, s AS (SELECT k AS l_returnflag, column_name AS column, {', '.join(parts)} FROM lg GROUP BY 1, 2) SELECT *, round(current_mean - reference_mean, 4) AS mean_shift FROM s"


@query(_summary_sql())
def summarise(spark: SparkSession, sf: str) -> DataFrame:
    return st.summarise(_prices(spark, sf), ["l_returnflag"])


@query(f"WITH {DAY}, {SCORED_LONG}, {STATS} SELECT k AS series_key, column_name AS column, n_reference, n_current, round(psi, 6) AS psi, round(ks_d, 6) AS ks_d, insufficient_data, severity FROM cmp")
def compare_column(spark: SparkSession, sf: str) -> DataFrame:
    c = drift.distribution_drift(tb.scored(spark, sf), list(SCORED_FEATURES), LINES)
    return c.select("series_key", "column", "n_reference", "n_current", r("psi", 6), r("ks_d", 6), "insufficient_data", "severity")


# -- drift


@query(f"WITH {DAY} SELECT series_key, win AS window, count(*) AS n FROM allw GROUP BY 1, 2")
def split_counts(spark: SparkSession, sf: str) -> DataFrame:
    return drift.split_counts(drift.split_windows(tb.daily_design(spark, sf), WINDOWS))


@query(f"WITH {DAY}, {WERR} SELECT series_key, win AS window, n, mae, mape_pct, rmse, bias FROM we")
def window_errors(spark: SparkSession, sf: str) -> DataFrame:
    return drift.window_errors(tb.scored(spark, sf))


@query(f"WITH {DAY}, {PERF} SELECT series_key, reference_mae, current_mae, round(mae_degradation, 6) AS mae_degradation, round(mape_delta_pp, 6) AS mape_delta_pp, insufficient_data, severity, round(reference_mae * 1.3, 2) AS alert_line FROM pe")
def performance_drift(spark: SparkSession, sf: str) -> DataFrame:
    p = drift.performance_drift(tb.scored(spark, sf), LINES)
    return p.select("series_key", "reference_mae", "current_mae", r("mae_degradation", 6), r("mape_delta_pp", 6), "insufficient_data", "severity", "alert_line")


@query(
    f"WITH {DAY}, dy AS (SELECT series_key, CAST(target_ts AS DATE) AS day, avg(abs_error) AS mae, avg(pct) AS mape_pct, avg(error) AS bias, count(*) AS n, CASE WHEN bool_or(win = 'current') THEN 'current' ELSE 'reference' END AS window FROM sc GROUP BY 1, 2) SELECT series_key, day, round(mae, 4) AS mae, round(mape_pct, 4) AS mape_pct, round(bias, 4) AS bias, n, \"window\", round(avg(mae) OVER w, 4) AS mae_rolling, round(avg(mape_pct) OVER w, 4) AS mape_rolling FROM dy WINDOW w AS (PARTITION BY series_key ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"
)
def rolling_error_series(spark: SparkSession, sf: str) -> DataFrame:
    e = drift.rolling_error_series(tb.scored(spark, sf), LINES)
    return e.select("series_key", "day", r("mae"), r("mape_pct"), r("bias"), "n", "window", r("mae_rolling"), r("mape_rolling"))


@query(f"WITH {DAY}, {SCORED_LONG}, {STATS}, {SECTIONS} SELECT k AS series_key, section, columns_scored, alerting, warning, round(drifted_share, 6) AS drifted_share, round(max_psi, 6) AS max_psi, severity FROM sv")
def section_rollup(spark: SparkSession, sf: str) -> DataFrame:
    s = drift.section_rollup(drift.distribution_drift(tb.scored(spark, sf), list(SCORED_FEATURES), LINES), LINES)
    return s.select("series_key", "section", "columns_scored", "alerting", "warning", r("drifted_share", 6), r("max_psi", 6), "severity")


@query(
    f"""WITH {DAY}, {SCORED_LONG}, {STATS}, {SECTIONS}, {PERF},
    pivot_ AS (SELECT k, max(severity) FILTER (WHERE section = 'feature') AS f, max(severity) FILTER (WHERE section = 'target') AS t, max(severity) FILTER (WHERE section = 'prediction') AS p FROM sv GROUP BY 1),
    v AS (SELECT pivot_.k, f, t, p, pe.severity AS e, NOT pe.insufficient_data AND pe.severity = 'ok' AS clean, CAST(f = 'alert' AS INT) + CAST(t = 'alert' AS INT) + CAST(p = 'alert' AS INT) AS alerts FROM pivot_ JOIN pe ON pe.series_key = pivot_.k),
    u AS (SELECT *, CASE WHEN e = 'alert' THEN 'R1_performance_alert' WHEN alerts > 0 AND e = 'warn' THEN 'R2_distribution_alert_with_performance_warning' WHEN alerts >= 2 AND NOT clean THEN 'R3_multiple_distribution_alerts' WHEN alerts >= 2 THEN 'R3b_distribution_without_measured_harm' WHEN f <> 'ok' OR t <> 'ok' OR p <> 'ok' OR e <> 'ok' THEN 'R4_watch' ELSE 'R5_none' END AS rule FROM v)
    SELECT k AS series_key, rule, CASE WHEN 'alert' IN (f, t, p, e) THEN 'alert' WHEN 'warn' IN (f, t, p, e) THEN 'warn' ELSE 'ok' END AS severity, left(rule, 3) IN ('R1_', 'R2_', 'R3_') AS should_retrain, CAST((f <> 'ok')::INT + (t <> 'ok')::INT + (p <> 'ok')::INT + (e <> 'ok')::INT AS BIGINT) AS n_reasons FROM u"""
)
def retrain_verdict(spark: SparkSession, sf: str) -> DataFrame:
    v = policy.evaluate(drift.drift_sections(tb.scored(spark, sf), list(SCORED_FEATURES), LINES), LINES)
    return v.select("series_key", "rule", "severity", "should_retrain", F.size("reasons").cast("long").alias("n_reasons"))


@query(
    f"""WITH {DAY}, {SCORED_LONG.replace("UNION ALL SELECT series_key, win, 'dayofweek', CAST(dow AS DOUBLE) FROM sc ", "")}, {STATS},
    sd AS (SELECT series_key, CAST(target_ts AS DATE) AS day, lag7, lag14, y, prediction FROM sc), dl AS (SELECT series_key AS k, day, 'demand_lag_168h' AS column_name, lag7 AS v FROM sd WHERE lag7 IS NOT NULL UNION ALL SELECT series_key, day, 'demand_lag_336h', lag14 FROM sd WHERE lag14 IS NOT NULL UNION ALL SELECT series_key, day, 'y', y FROM sd UNION ALL SELECT series_key, day, 'prediction', prediction FROM sd WHERE prediction IS NOT NULL),
    db AS (SELECT dl.k, dl.column_name, dl.day, CASE WHEN categorical THEN coalesce(lvs.bin, 0) ELSE len(list_filter(inner_edges, lambda e: e <= dl.v)) + 1 END AS bin FROM dl JOIN inn ON dl.k = inn.k AND dl.column_name = inn.column_name LEFT JOIN lvs ON lvs.k = dl.k AND lvs.column_name = dl.column_name AND lvs.v = dl.v),
    dc AS (SELECT k, column_name, day, bin, count(*) AS n FROM db GROUP BY ALL), days AS (SELECT DISTINCT series_key AS k, day FROM sd),
    gr AS (SELECT days.k, days.day, bins.column_name, bins.bin, coalesce(sum(dc.n), 0) AS n FROM days JOIN bins ON bins.k = days.k LEFT JOIN dc ON dc.k = days.k AND dc.column_name = bins.column_name AND dc.bin = bins.bin AND dc.day > days.day - 7 AND dc.day <= days.day GROUP BY ALL),
    gs AS (SELECT gr.k, gr.column_name, gr.day, greatest(gr.n / greatest(sum(gr.n) OVER w, 1), 1e-6) AS a, greatest(coalesce(cn.nr, 0) / greatest(sum(coalesce(cn.nr, 0)) OVER w, 1), 1e-6) AS e FROM gr LEFT JOIN cn ON cn.k = gr.k AND cn.column_name = gr.column_name AND cn.bin = gr.bin WINDOW w AS (PARTITION BY gr.k, gr.column_name, gr.day)),
    gp AS (SELECT k, column_name, day, sum((a - e) * ln(a / e)) AS psi FROM gs GROUP BY ALL), nd AS (SELECT a.k, a.day, count(*) AS n FROM days a JOIN sd ON sd.series_key = a.k AND sd.day > a.day - 7 AND sd.day <= a.day GROUP BY ALL)
    SELECT gp.k AS series_key, gp.day, nd.n, round(max(psi) FILTER (WHERE column_name = 'y'), 6) AS target_psi, round(max(psi) FILTER (WHERE column_name = 'prediction'), 6) AS prediction_psi, round(max(psi) FILTER (WHERE column_name NOT IN ('y', 'prediction')), 6) AS feature_max_psi FROM gp JOIN nd ON nd.k = gp.k AND nd.day = gp.day WHERE nd.n >= 5 GROUP BY ALL"""
)
def drift_timeline(spark: SparkSession, sf: str) -> DataFrame:
    from dataclasses import replace

    t = drift.drift_timeline(tb.scored(spark, sf), list(SCORED_FEATURES), replace(LINES, min_samples=5))
    return t.select("series_key", "day", F.col("n").cast("long").alias("n"), r("target_psi", 6), r("prediction_psi", 6), r("feature_max_psi", 6))


@query(
    f"""WITH pr AS (SELECT * FROM (VALUES ('year apart', DATE '1996-01-01', DATE '1996-12-31', DATE '1997-01-01', DATE '1997-12-31'), ('halves', DATE '1996-01-01', DATE '1996-06-30', DATE '1996-07-01', DATE '1996-12-31')) AS t(pair, rs, re, cs, ce)),
    dd AS (SELECT l_returnflag, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
    lg AS (SELECT pair AS k, 'demand_mwh' AS column_name, 'reference' AS win, v FROM dd JOIN pr ON day >= rs AND day <= re UNION ALL SELECT pair, 'demand_mwh', 'current', v FROM dd JOIN pr ON day >= cs AND day <= ce), {STATS} SELECT k AS pair, n_reference, n_current, round(psi, 6) AS psi, round(ks_d, 6) AS ks_d, severity FROM cmp"""
)
def window_pair_sweep(spark: SparkSession, sf: str) -> DataFrame:
    rows = [("year apart", "1996-01-01", "1996-12-31", "1997-01-01", "1997-12-31"), ("halves", "1996-01-01", "1996-06-30", "1996-07-01", "1996-12-31")]
    pairs = spark.createDataFrame(rows, "pair string, a string, b string, c string, d string")
    pairs = pairs.select("pair", *[F.to_date(x).alias(n) for x, n in zip("abcd", ("reference_start", "reference_end", "current_start", "current_end"))])
    s = drift.window_pair_sweep(tb.daily(spark, sf), pairs, "demand_mwh", LINES)
    return s.select("pair", "n_reference", "n_current", r("psi", 6), r("ks_d", 6), "severity")


# -- lake

_OLD = "o AS (SELECT DISTINCT event_type, date_trunc('hour', ts) AS ts FROM events WHERE ts < TIMESTAMP '2024-01-20')"
_NEW = "n AS (SELECT DISTINCT event_type, date_trunc('hour', ts) AS ts FROM events WHERE ts >= TIMESTAMP '2024-01-17')"


def _lake(spark: SparkSession, sf: str) -> tuple[TableSpec, DataFrame, DataFrame]:
    e = tb.events(spark, sf).select("event_type", F.col("hour_ts").alias("timestamp_utc"), "value", "event_id")
    old = lake.keep_newest(e.where("timestamp_utc < '2024-01-20'"), ["event_type", "timestamp_utc"], ["event_id"])
    return TableSpec("demand", ("event_type", "timestamp_utc"), "timestamp_utc", ""), old, e.where("timestamp_utc >= '2024-01-17'")


@query(f"WITH {_OLD}, {_NEW} SELECT (SELECT count(*) FROM n) AS rows_received, (SELECT count(*) FROM n ANTI JOIN o ON n.event_type = o.event_type AND n.ts = o.ts) AS rows_added, (SELECT count(*) FROM n SEMI JOIN o ON n.event_type = o.event_type AND n.ts = o.ts) AS rows_updated, (SELECT count(*) FROM o) + (SELECT count(*) FROM n ANTI JOIN o ON n.event_type = o.event_type AND n.ts = o.ts) AS rows_total, (SELECT count(DISTINCT date_trunc('month', ts)) FROM n) AS partitions_touched")
def write_report(spark: SparkSession, sf: str) -> DataFrame:
    spec, old, new = _lake(spark, sf)
    return lake.write_report(old, new, spec, ["event_id"])


@query(f"SELECT event_type, {HOURS.format('ts')} AS h, max(event_id) AS event_id FROM events WHERE month(ts) IN (SELECT DISTINCT month(ts) FROM events WHERE ts >= TIMESTAMP '2024-01-17') GROUP BY 1, 2")
def upsert_merge(spark: SparkSession, sf: str) -> DataFrame:
    spec, old, new = _lake(spark, sf)
    return lake.merged(old, new, spec, ["event_id"]).select("event_type", h("timestamp_utc"), "event_id")


_LAST = f"k AS (SELECT DISTINCT o_orderpriority FROM orders), m AS (SELECT max(year(o_orderdate) * 100 + month(o_orderdate)) AS ym FROM orders), l AS (SELECT k.o_orderpriority, max(o.o_orderdate) AS last_ts FROM k LEFT JOIN (SELECT orders.* FROM orders, m WHERE year(o_orderdate) * 100 + month(o_orderdate) = ym) o ON o.o_orderpriority = k.o_orderpriority GROUP BY 1)"


def _last(spark: SparkSession, sf: str) -> DataFrame:
    o = tb.table(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    return lake.last_timestamp(o, "o_orderpriority", "o_orderdate")


@query(f"WITH {_LAST} SELECT o_orderpriority, {HOURS.format('last_ts')} AS h FROM l")
def last_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    return _last(spark, sf).select("o_orderpriority", h("last_ts"))


@query(f"WITH {_LAST} SELECT o_orderpriority, {HOURS.format(chr(99) + 'oalesce(last_ts - INTERVAL 3 DAY, TIMESTAMP ' + chr(39) + '2000-01-01' + chr(39) + ' - INTERVAL 730 DAY)')} AS start_h, {HOURS.format('TIMESTAMP ' + chr(39) + '2000-01-01' + chr(39))} AS end_h FROM l")
def delta_window(spark: SparkSession, sf: str) -> DataFrame:
    w = lake.delta_window(_last(spark, sf), F.to_timestamp(F.lit("2000-01-01")))
    return w.select("o_orderpriority", h("start_ts", "start_h"), h("end_ts", "end_h"))


@query(f"SELECT event_type, {HOURS.format('ts')} AS h, CASE WHEN bool_or(event_id % 2 = 0) THEN 'archive' ELSE 'recent' END AS leg FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1, 2")
def stitch_sources(spark: SparkSession, sf: str) -> DataFrame:
    e = tb.events(spark, sf).select("event_type", "hour_ts", (F.col("event_id") % 2 == 0).alias("even"))
    legs = [e.where(c).select("event_type", F.col("hour_ts").alias("timestamp_utc"), F.lit(n).alias("leg")).distinct() for c, n in (("not even", "recent"), ("even", "archive"))]
    s = lake.stitch_sources(*legs, ["event_type", "timestamp_utc"], F.to_timestamp(F.lit("2024-01-10")))
    return s.select("event_type", h("timestamp_utc"), "leg")


@query(f"WITH a AS (SELECT DISTINCT event_type, date_trunc('hour', ts) AS ts FROM events WHERE event_id % 2 = 0), c AS (SELECT DISTINCT event_type, date_trunc('hour', ts) AS ts FROM events WHERE event_id % 2 = 1 AND date_trunc('hour', ts) > TIMESTAMP '2024-01-15') SELECT event_type, {HOURS.format('ts')} AS h, 'day1' AS lead FROM a UNION ALL SELECT event_type, {HOURS.format('ts')}, 'current' FROM c ANTI JOIN a USING (event_type, ts)")
def stitch_forecast_sources(spark: SparkSession, sf: str) -> DataFrame:
    e = tb.events(spark, sf).select("event_type", F.col("hour_ts").alias("timestamp_utc"), (F.col("event_id") % 2 == 0).alias("even"))
    leg = lambda c, n: e.where(c).select("event_type", "timestamp_utc", F.lit(n).alias("lead")).distinct()
    s = lake.stitch_forecast_sources(leg("not even", "current"), leg("even", "day1"), F.to_timestamp(F.lit("2024-01-15")), ["event_type", "timestamp_utc"])
    return s.select("event_type", h("timestamp_utc"), "lead")


@query(f"SELECT event_type AS respondent, {HOURS.format('ts')} AS h, round(value, 6) AS demand_mwh FROM events WHERE event_id % 7 <> 0")
def parse_records_payload(spark: SparkSession, sf: str) -> DataFrame:
    rows = payloads.parse_records_payload(tb.record_pages(spark, sf))
    return rows.select("respondent", h("timestamp_utc"), r("demand_mwh", 6))


@query("SELECT count(*) AS rows_read, count(*) FILTER (WHERE event_id % 7 = 0) AS rows_dropped FROM events")
def dropped_records(spark: SparkSession, sf: str) -> DataFrame:
    return payloads.dropped_records(tb.record_pages(spark, sf))


@query(f"WITH w AS (SELECT event_type AS site, date_trunc('hour', ts) AS ts, avg(value) AS t FROM events GROUP BY 1, 2) SELECT site, {HOURS.format('ts')} AS h, round(t, 4) AS temperature_c, ts <= TIMESTAMP '2024-01-15' AS is_observed FROM w")
def parse_columnar_payload(spark: SparkSession, sf: str) -> DataFrame:
    rows = payloads.parse_columnar_payload(tb.columnar_pages(spark, sf), F.to_timestamp(F.lit("2024-01-15")))
    return rows.select("site", h("timestamp_utc"), r("temperature_c"), "is_observed")


@query(f"WITH w AS (SELECT event_type AS site, date_trunc('hour', ts) AS ts, avg(value) AS t, max(value) AS hu, min(value) AS dp FROM events GROUP BY 1, 2) SELECT site, {HOURS.format('ts')} AS h, round(t, 4) AS temperature_c, round(hu, 4) AS humidity_pct, round(dp, 4) AS dewpoint_c, CAST(NULL AS DOUBLE) AS wind_kmh, 'day1' AS lead FROM w")
def parse_forecast_payload(spark: SparkSession, sf: str) -> DataFrame:
    rows = payloads.parse_forecast_payload(tb.columnar_pages(spark, sf, payloads.ARCHIVED_SUFFIX), archived=True)
    return rows.select("site", h("timestamp_utc"), r("temperature_c"), r("humidity_pct"), r("dewpoint_c"), r("wind_kmh"), "lead")


@query("SELECT bool_or(upper(p_brand) = 'BRAND#1') AS found, CASE WHEN bool_or(upper(p_brand) = 'BRAND#1') THEN 0 ELSE count(DISTINCT p_brand) FILTER (WHERE contains(upper(p_brand), 'BRAND#1') OR contains('BRAND#1', upper(p_brand))) END AS n_near FROM part")
def verify_entity(spark: SparkSession, sf: str) -> DataFrame:
    v = payloads.verify_entity(tb.table(spark, sf, "part").select(F.col("p_brand").alias("id")), "brand#1")
    return v.select("found", F.size("near").cast("long").alias("n_near"))


# -- forecasts


@query(f"WITH {DAY} SELECT series_key, CAST(target_ts AS DATE) AS day, round(prediction, 4) AS forecast, round(error, 4) AS error FROM (SELECT *, max(target_ts) OVER (PARTITION BY series_key) AS last_ts FROM sc) WHERE target_ts >= last_ts - INTERVAL 21 DAY")
def forecast_history(spark: SparkSession, sf: str) -> DataFrame:
    f = models.forecast_history(tb.scored(spark, sf))
    return f.select("series_key", F.to_date("target_ts").alias("day"), r("forecast"), r("error"))


@query("WITH t AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) SELECT o_custkey AS name, o_orderkey AS version, CAST(epoch(o_orderdate) AS BIGINT) AS at FROM t WHERE n = 1")
def latest_version(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.registry import latest

    o = tb.table(spark, sf, "orders").select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("version"), F.col("o_orderdate").cast("timestamp").alias("assigned_at"))
    return latest(o, ["name"]).select("name", "version", F.unix_timestamp("assigned_at").alias("at"))


@query("SELECT o_orderkey, coalesce(o_orderdate < TIMESTAMP '1995-06-01', false) AS eligible FROM orders")
def monitoring_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    m = tb.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("train_data_end"))
    return policy.monitoring_eligible(m, F.to_timestamp(F.lit("1995-06-01"))).select("o_orderkey", "eligible")


_GBT = {"rounds": 5, "depth": 4}


@query()
def feature_importance(spark: SparkSession, sf: str) -> DataFrame:
    d = _hourly_design(spark, sf).persist()
    out = models.feature_importance(models.gbt_fit(d, HOURLY.features, **_GBT), HOURLY.features)
    d.unpersist()
    return out


@query()
def forecast_scoring(spark: SparkSession, sf: str) -> DataFrame:
    p = tb.panel(spark, sf)
    return models.forecast(p, models.gbt_fit(_hourly_design(spark, sf), HOURLY.features, **_GBT), HOURLY)


@query()
def walk_forward_gbt(spark: SparkSession, sf: str) -> DataFrame:
    p = tb.panel(spark, sf)
    d = models.cutoff_design(p, HOURLY, design.training_origins(p, HOURLY), **_HOW).persist()
    rows = backtest.walk_forward(p.select("series_key", "ts", "demand_mwh"), models.walk_forward_gbt(d, HOURLY, refit_every=11, **_GBT), HOURLY, "gbt", **_HOW)
    return backtest.backtest_metrics(rows)


def queries() -> dict:
    from . import proofs, steps  # noqa: F401  # register their own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """From raw rows to a verdict on every series: panel, lags, windows, drift sections, rules."""
    return retrain_verdict(spark, sf)
