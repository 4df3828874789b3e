"""Hand-computed values, mask boundaries, inclusive thresholds and rule tables."""

from __future__ import annotations

import datetime as dt
import math
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.functions import core
from tidemill.operators import backtest, design, drift, models, panel, policy, registry
from tidemill.operators import statistics as st
from tidemill.sources import lake, payloads
from tidemill.specs import FORECAST_SOURCES, SeriesSpec, TableSpec, Thresholds, WindowSpec
from tidemill.streaming import ingest

T0 = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)


def series(spark, values, key="s", start=T0, step=HOUR):
    rows = [(key, start + i * step, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_key string, ts timestamp, demand_mwh double")


def long(spark, reference, current):
    rows = [("k", "x", "reference", float(v)) for v in reference] + [("k", "x", "current", float(v)) for v in current]
    return spark.createDataFrame(rows, "series_key string, column string, window string, value double")


# -- functions


def test_clean_drops_what_is_not_finite(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (-float("inf"),), (1.5,), (None,)], "x double")
    assert [r[0] for r in df.select(core.clean("x")).collect()] == [None, None, None, 1.5, None]


def test_holidays_follow_the_calendar(spark):
    days = {str(r.holiday_date) for r in core.holidays(spark, 2020, 2026).collect()}
    # July 4 2026 is a Saturday; New Year 2022 was observed in 2021; Juneteenth begins in 2021.
    assert {"2026-07-03", "2021-12-31", "2024-11-28", "2024-01-15", "2024-05-27", "2021-06-18"} <= days
    assert "2026-07-04" not in days and "2020-06-19" not in days


def test_severity_lines_are_inclusive(spark):
    df = spark.createDataFrame([(0.0999,), (0.1,), (0.1999,), (0.2,)], "v double")
    assert [r[0] for r in df.select(core.severity("v", 0.1, 0.2)).collect()] == ["ok", "warn", "warn", "alert"]


def test_bin_labels_strip_zeros(spark):
    df = spark.createDataFrame([(0.5, float("inf")), (-float("inf"), 1234.56), (100.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(core.bin_label("a", "b")).collect()] == ["[0.5, inf)", "[-inf, 1235)", "[100, 2)"]


def test_threshold_overrides():
    assert Thresholds.from_conf({"DRIFT_PSI_WARN": "0.3", "DRIFT_MIN_SAMPLES": "5"}) == Thresholds(psi_warn=0.3, min_samples=5)


# -- statistics


def test_psi_of_two_levels(spark):
    out = st.psi(long(spark, [0] * 500 + [1] * 500, [0] * 250 + [1] * 750), ["series_key"]).first()
    want = (0.25 - 0.5) * math.log(0.25 / 0.5) + (0.75 - 0.5) * math.log(0.75 / 0.5)
    assert math.isclose(out.psi, want) and out.categorical


def test_psi_folds_unseen_levels_and_survives_empty_sides(spark):
    out = st.psi(long(spark, [0, 0, 1, 1], [0, 1, 7, 7]), ["series_key"]).first()
    e, a = np.array([1e-6, 0.5, 0.5]), np.array([0.5, 0.25, 0.25])
    assert math.isclose(out.psi, float(((a - e) * np.log(a / e)).sum()))
    none = st.psi(long(spark, [0, 1], []), ["series_key"]).first()
    assert (none.psi, none.psi_status) == (0.0, "degenerate")


def test_numeric_psi_and_ks_match_numpy(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=700), rng.normal(0.3, 1.2, size=500)
    df = long(spark, a, b)
    q = np.unique(np.quantile(a, np.arange(11) / 10))
    edges = np.r_[-np.inf, q[1:-1], np.inf]
    e, c = (np.maximum(np.histogram(x, edges)[0] / len(x), 1e-6) for x in (a, b))
    assert math.isclose(st.psi(df, ["series_key"]).first().psi, float(((c - e) * np.log(c / e)).sum()), rel_tol=1e-9)
    both = np.sort(np.r_[a, b])
    d = np.abs(np.searchsorted(np.sort(a), both, "right") / 700 - np.searchsorted(np.sort(b), both, "right") / 500).max()
    for buckets in (1, 7):
        assert math.isclose(st.ks(df, ["series_key"], buckets).first().ks_d, d, rel_tol=1e-12)
    lam = (math.sqrt(700 * 500 / 1200) + 0.12 + 0.11 / math.sqrt(700 * 500 / 1200)) * d
    p = sum(2 * (-1) ** (k - 1) * math.exp(-2 * lam * lam * k * k) for k in range(1, 101))
    assert math.isclose(st.ks(df, ["series_key"]).first().ks_p, p, rel_tol=1e-6, abs_tol=1e-12)


def test_few_samples_never_alarm(spark):
    c = st.compare_columns(long(spark, range(100), range(500, 600)), ["series_key"]).first()
    assert c.insufficient_data and c.severity == "ok" and c.psi > 1


def test_summary_of_one_value(spark):
    s = st.summarise(long(spark, [3], [5, 7]), ["series_key"]).first()
    assert (s.reference_std, s.current_mean, s.mean_shift) == (0.0, 6.0, 3.0)


# -- panel


def test_grid_makes_gaps_explicit(spark):
    s = series(spark, range(10)).where("hour(ts) not in (3, 4)")
    out = panel.build_panel(s).orderBy("ts").collect()
    assert len(out) == 10 and out[3].demand_mwh is None and out[3].fcst_wind_kmh is None and out[0].dayofweek == 0


def test_blend_renormalises_over_reporting_sites(spark):
    rows = [("a", T0, 10.0), ("b", T0, 20.0), ("x", T0, 99.0), ("a", T0 + HOUR, None), ("b", T0 + HOUR, 4.0), ("a", T0 + 2 * HOUR, None)]
    df = spark.createDataFrame(rows, "site string, ts timestamp, temperature_c double")
    w = spark.createDataFrame([("a", 0.75), ("b", 0.25)], "site string, weight double")
    out = {r.ts: r.temperature_c for r in panel.load_temperature_blend(df, w, ["ts"]).collect()}
    assert out == {T0: 12.5, T0 + HOUR: 4.0, T0 + 2 * HOUR: None}
    assert panel.site_spread(df, "temperature_c", ["ts"]).where(F.col("ts") == T0).first().spread == 89.0


def test_empty_demand_is_an_error(spark):
    with pytest.raises(ValueError):
        panel.resolve_panel(series(spark, []))


# -- design


SPEC = SeriesSpec(lags=(24,), temperature_lag=24, season_lags=(24, 48), short_window=4, long_window=8, min_history=48, stride=6)


def test_lags_are_masked_at_the_origin(spark):
    p = panel.build_panel(series(spark, range(100)))
    origin = spark.createDataFrame([("s", T0 + 60 * HOUR)], "series_key string, origin_ts timestamp")
    d = {r.horizon_h: r for r in design.build_design_matrix(p, origin, SPEC).collect()}
    assert d[23].demand_lag_24h == 59.0 and d[24].demand_lag_24h is None
    assert d[23].demand_same_season_mean == (59 + 35) / 2 and d[24].demand_same_season_mean == 36.0
    assert d[1].demand_last == 59.0 and d[1].demand_roll_mean_short == 57.5 and d[1].y == 61.0


def test_nothing_after_the_origin_is_read(spark):
    values = list(range(100))
    origin = spark.createDataFrame([("s", T0 + 60 * HOUR)], "series_key string, origin_ts timestamp")
    rows = []
    for poison in (0, 1e9):
        p = panel.build_panel(series(spark, [v if i < 60 else poison for i, v in enumerate(values)]))
        rows.append(sorted(tuple(r) for r in design.build_design_matrix(p, origin, SPEC).drop("y").collect()))
    assert rows[0] == rows[1]


def test_forecasts_count_from_noon_the_day_before(spark):
    n = 100
    f = spark.createDataFrame([("s", T0 + i * HOUR, float(i)) for i in range(n)], "series_key string, ts timestamp, fcst_temperature_c double")
    p = panel.build_panel(series(spark, range(n)), forecast=f)
    at = spark.createDataFrame([("s", T0 + 59 * HOUR), ("s", T0 + 60 * HOUR)], "series_key string, origin_ts timestamp")
    d = {(r.origin_ts, r.horizon_h): r.temp_fcst_target for r in design.build_design_matrix(p, at, SPEC).collect()}
    # The target lies on day 3; noon of day 2 is hour 60.
    assert d[T0 + 59 * HOUR, 14] is None and d[T0 + 60 * HOUR, 13] == 73.0
    assert set(FORECAST_SOURCES.values()) <= set(design.build_design_matrix(p, at, SPEC).columns)


def test_default_features_are_27():
    assert len(SeriesSpec().features) == 27


def test_future_targets_still_find_their_lags(spark):
    p = panel.build_panel(series(spark, range(80)))
    d = {r.horizon_h: r for r in design.build_design_matrix(p, models.latest_origins(p, SPEC), SPEC).collect()}
    assert d[20].demand_lag_24h == 76.0 and d[20].y is None


# -- backtest


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([("m", 1, 10.0, 20.0), ("m", 2, 10.0, 5.0)], "model string, horizon_h int, actual double, prediction double")
    m = {r.horizon_h: r for r in backtest.backtest_metrics(backtest.add_errors(df, "actual")).collect()}
    assert (m[None].mae, m[None].bias, m[None].mape_pct) == (7.5, 2.5, 75.0) and math.isclose(m[None].rmse, math.sqrt(62.5))
    assert m[1].n == 1 and m[2].bias == -5.0


def test_seasonal_naive_is_exact_on_a_periodic_series(spark):
    s = series(spark, [10 + (i % 168) for i in range(24 * 40)])
    rows = backtest.walk_forward(s, backtest.seasonal_naive(), weeks=2)
    m = backtest.backtest_metrics(rows).where("horizon_h is null").first()
    assert m.mae == 0.0 and m.n > 0


def test_a_season_that_reaches_the_cutoff_fails(spark):
    s = series(spark, [1.0] * 24 * 20)
    spec = SeriesSpec(season=12)
    with pytest.raises(Exception, match="season"):
        backtest.walk_forward(s, backtest.seasonal_naive(spec), spec, weeks=1).collect()


def test_one_bad_hour_drops_the_whole_fold(spark):
    values = [10 + (i % 168) for i in range(24 * 30)]
    values[24 * 28 + 15] = 0.0
    rows = backtest.fold_predictions(series(spark, values), backtest.seasonal_naive(), weeks=1).cache()
    report = backtest.fold_report(rows).first()
    assert report.skipped >= 1 and report.warning
    assert rows.where("not fold_ok").groupBy("cutoff").count().where("count <> 24").count() == 0
    with pytest.raises(ValueError):
        backtest.require_folds(rows.where("not fold_ok"))


def test_cutoffs_leave_a_whole_horizon(spark):
    c = [r.cutoff for r in backtest.make_cutoffs(series(spark, [1.0] * (24 * 20 + 13)), weeks=8).orderBy("cutoff").collect()]
    assert c[0] == T0 + 7 * 24 * HOUR + 12 * HOUR and c[-1] == T0 + 19 * 24 * HOUR + 12 * HOUR


# -- drift and policy


def scored(spark, ref, cur, n=240):
    rows = []
    for w, mae, day in (("reference", ref, 0), ("current", cur, 20)):
        for i in range(n):
            t = T0 + dt.timedelta(days=day) + i * HOUR
            e = mae if i % 2 else -mae
            rows.append(("s", t - HOUR, 1, t, w, 100.0 + i % 7, 100.0 + i % 7 + e))
    df = spark.createDataFrame(rows, "series_key string, origin_ts timestamp, horizon_h int, target_ts timestamp, window string, y double, prediction double")
    return backtest.add_errors(df)


@pytest.mark.parametrize(("cur", "want"), [(8.5, "ok"), (9.0, "warn"), (10.0, "alert")])
def test_performance_lines(spark, cur, want):
    t = Thresholds(mae_degradation_warn=0.125, mae_degradation_alert=0.25, mape_degradation_warn_pp=50, mape_degradation_alert_pp=99)
    p = drift.performance_drift(scored(spark, 8.0, cur), t).first()
    assert p.severity == want and p.alert_line == 10.0


def test_performance_of_few_rows_is_unknown(spark):
    p = drift.performance_drift(scored(spark, 10.0, 99.0, n=10)).first()
    assert p.insufficient_data and p.severity == "ok" and p.mae_degradation is not None


def sections(spark, f, t, p, e, measured=True):
    rows = [("s", n, v, False, 1.0) for n, v in (("feature", f), ("target", t), ("prediction", p))] + [("s", "performance", e, not measured, 0.1)]
    return spark.createDataFrame(rows, "series_key string, section string, severity string, insufficient_data boolean, value double")


@pytest.mark.parametrize(
    ("args", "rule", "action"),
    [
        (("ok", "ok", "ok", "alert"), "R1_performance_alert", "retrain"),
        (("alert", "ok", "ok", "warn"), "R2_distribution_alert_with_performance_warning", "retrain"),
        (("alert", "alert", "ok", "ok", False), "R3_multiple_distribution_alerts", "retrain"),
        (("alert", "alert", "ok", "ok", True), "R3b_distribution_without_measured_harm", "watch"),
        (("alert", "ok", "warn", "ok"), "R4_watch", "watch"),
        (("ok", "ok", "ok", "ok"), "R5_none", "none"),
    ],
)
def test_rules(spark, args, rule, action):
    v = policy.evaluate(sections(spark, *args)).first()
    assert (v.rule, v.action, v.should_retrain) == (rule, action, action == "retrain")
    assert [x.severity for x in v.reasons] == sorted((x.severity for x in v.reasons), key=["alert", "warn"].index)


def test_a_current_champion_is_not_judged(spark):
    v = policy.evaluate(sections(spark, "alert", "alert", "alert", "alert"))
    none = spark.createDataFrame([("s", "current", 5)], "series_key string, window string, n long")
    r = policy.champion_is_current(v, none).first()
    assert (r.rule, r.should_retrain, r.measurable) == ("R0_champion_is_current", False, False)
    assert not policy.drift_gate(policy.champion_is_current(v, none)) and policy.drift_gate(v)


def test_injected_shift_fires_and_the_control_stays_quiet(spark):
    rng = np.random.default_rng(2)
    values = 100 + rng.normal(size=24 * 60)
    # One row for each target: origins every 6 hours would count each four times and sharpen the KS test.
    spec = SeriesSpec(lags=(24,), season_lags=(24,), season=24, min_history=48, stride=24)

    def alarm(p):
        d = design.build_design_matrix(p, design.training_origins(p, spec), spec)
        s = drift.split_windows(d, WindowSpec())
        rows = backtest.add_errors(s.where("window <> 'train'").withColumn("prediction", F.lit(100.0)))
        c = drift.distribution_drift(rows, ["demand_lag_24h"])
        return {r.section: r.severity for r in drift.section_rollup(c).collect()}["target"], drift.drift_timeline(rows, ["demand_lag_24h"], Thresholds(min_samples=150)).count()

    p = panel.build_panel(series(spark, values))
    assert alarm(p)[0] == "ok"
    fired, points = alarm(panel.inject_shift(p, last_days=14, scale=1.1))
    assert fired == "alert" and points > 20


def test_windows_hold_their_first_row_and_not_the_next_ones(spark):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    rows = [("a", day(n), 1.0) for n in range(10)] + [("a", day(10), None)]
    design_rows = spark.createDataFrame(rows, "series_key string, target_ts timestamp, y double")
    got = {r.target_ts: r.window for r in drift.split_windows(design_rows, WindowSpec(3, 4)).collect()}
    # The end is day 10, though it has no label: current from day 6 on, reference from day 3 on.
    assert got == {day(n): "train" if n < 3 else "reference" if n < 6 else "current" for n in range(10)}
    anchored = {r.target_ts: r.window for r in drift.split_windows(design_rows, WindowSpec(3, 4), anchor="2024-01-09").collect()}
    assert anchored == {day(n): "train" if n < 5 else "reference" if n < 8 else "current" for n in range(10)}
    later = spark.createDataFrame([("a", day(12))], "series_key string, ts timestamp")
    assert drift.split_counts(drift.split_windows(design_rows, WindowSpec(3, 4), panel=later)).where("window = 'current'").first().n == 2


def test_empty_windows_are_told(spark):
    p = panel.build_panel(series(spark, [1.0] * 24 * 10))
    spec = SeriesSpec(lags=(24,), season_lags=(24,), min_history=24)
    d = design.build_design_matrix(p, design.training_origins(p, spec), spec)
    with pytest.raises(ValueError, match="train"):
        drift.split_windows(d, WindowSpec(14, 14), required=True)


# -- lake


def test_upsert_is_idempotent_and_touches_only_its_months(spark):
    spec = TableSpec("t", ("site", "ts"), "ts", tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/lake")
    rows = [("a", T0 + i * 24 * HOUR, float(i), 1) for i in range(60)]
    shape = "site string, ts timestamp, value double, seq long"
    first = lake.upsert(spark, spark.createDataFrame(rows, shape), spec, ["seq"])
    assert first == {"rows_received": 60, "rows_added": 60, "rows_updated": 0, "rows_total": 60, "partitions_touched": 2}
    late = [("a", T0 + 59 * 24 * HOUR, 7.0, 2), ("a", T0 + 59 * 24 * HOUR, 9.0, 3), ("a", T0 + 60 * 24 * HOUR, 1.0, 2)]
    for _ in range(2):
        again = lake.upsert(spark, spark.createDataFrame(late, shape), spec, ["seq"])
        assert again["rows_received"] == 2 and again["rows_total"] == 61
    assert again["rows_updated"] == 2
    df = spark.read.parquet(spec.path)
    assert df.count() == 61 and df.where(F.col("ts") == T0 + 59 * 24 * HOUR).first().value == 9.0
    assert lake.count_rows(spark, spec) == 61 and lake.count_rows(spark, TableSpec("n", ("a",), "ts", spec.path + "x")) == 0
    last = lake.last_timestamp(df, "site", "ts", spark.createDataFrame([("a",), ("b",)], "site string"))
    w = {r.site: r for r in lake.delta_window(last, F.to_timestamp(F.lit("2024-03-05"))).collect()}
    assert w["a"].start_ts == T0 + 57 * 24 * HOUR and w["b"].start_ts == dt.datetime(2022, 3, 6)


def test_records_payload(spark):
    page = '{"response":{"data":[{"period":"2024-01-01T05","respondent":"P","value":"7.5","value-units":"u"},{"period":"2024-01-01T06","respondent":"P","value":null},{"period":"2024-01-01T07","respondent":"P","value":8}]}}'
    d = spark.createDataFrame([(page,)], "payload string")
    got = payloads.parse_records_payload(d).orderBy("timestamp_utc").collect()
    assert [(r.timestamp_utc, r.demand_mwh, r.units) for r in got] == [(T0 + 5 * HOUR, 7.5, "u"), (T0 + 7 * HOUR, 8.0, "megawatthours")]
    assert tuple(payloads.dropped_records(d).first()) == (3, 1)


def test_columnar_payload_with_absent_variables(spark):
    page = '{"hourly":{"time":["2024-01-01T00:00","2024-01-01T01:00"],"temperature_2m_previous_day1":[1.5,null]}}'
    d = spark.createDataFrame([("a", page)], "site string, payload string")
    got = payloads.parse_forecast_payload(d, archived=True).collect()
    assert len(got) == 1 and (got[0].temperature_c, got[0].wind_kmh, got[0].lead) == (1.5, None, "day1")


def test_verify_entity(spark):
    d = spark.createDataFrame([("PJM",), ("PJM-E",), ("X",)], "id string")
    assert payloads.verify_entity(d, "pjm").first().found
    assert payloads.verify_entity(d, "pj").first().near == ["PJM", "PJM-E"]


def test_streamed_landing_is_upserted_once(spark):
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    import os

    os.makedirs(f"{base}/in")
    page = '{"response":{"data":[{"period":"2024-01-01T%02d","respondent":"P","value":"%d"}]}}'
    spec = TableSpec("d", ("respondent", "timestamp_utc"), "timestamp_utc", f"{base}/lake")
    for i, value in enumerate((1, 2)):
        with open(f"{base}/in/{i}.json", "w") as f:
            f.write(page % (5, value))
        ingest.ingest_records(spark, f"{base}/in", spec, f"{base}/check").awaitTermination()
    rows = spark.read.parquet(spec.path).collect()
    assert len(rows) == 1 and rows[0].demand_mwh == 2.0


# -- models


def test_gbt_forecast_registry_and_bounds(spark):
    rng = np.random.default_rng(0)
    values = [100 + 10 * math.sin(i / 24 * 2 * math.pi) + rng.normal() for i in range(24 * 12)]
    spec = SeriesSpec(lags=(24,), season_lags=(24, 48), temperature_lag=24, short_window=24, long_window=48, season=24, min_history=72, stride=12)
    p = panel.build_panel(series(spark, values)).cache()
    d = design.build_design_matrix(p, design.training_origins(p, spec), spec).cache()
    model = models.gbt_fit(d, spec.features, rounds=3, depth=3)
    f = models.forecast(p, model, spec).collect()
    assert len(f) == 24 and all(80 < r.prediction < 120 and r.actual is None for r in f)
    for bad in (T0 + 71 * HOUR, T0 + (24 * 12 + 1) * HOUR):
        with pytest.raises(ValueError):
            models.forecast(p, model, spec, spark.createDataFrame([("s", bad)], "series_key string, origin_ts timestamp"))
    assert 0 < models.feature_importance(model, spec.features).count() <= 12
    where = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    with pytest.raises(registry.NoChampion):
        registry.load_champion(spark, where, "m")
    for i in (1, 2):
        assert registry.register(spark, where, "m", model, "champion", {"mae": 1.0}, T0, True, "real", T0 + i * HOUR) == i
    loaded, row = registry.load_champion(spark, where, "m")
    assert row["version"] == 2 and len(loaded.stages) == len(model.stages)
    registry.assign_alias(spark, where, "m", 1, "champion", T0 + 9 * HOUR)
    assert registry.champion_row(spark, where, "m")["version"] == 1


def test_daily_monitor_names_its_tables(spark):
    from tidemill.plans.daily import daily_monitor

    rng = np.random.default_rng(6)
    values = [100 + 10 * math.sin(i / 24 * 2 * math.pi) + rng.normal() for i in range(24 * 24)]
    spec = SeriesSpec(lags=(24,), season_lags=(24, 48), temperature_lag=24, short_window=24, long_window=48, season=24, min_history=72, stride=12)
    p = panel.build_panel(series(spark, values)).cache()
    log = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/log"
    out = daily_monitor(p, spec, WindowSpec(7, 7), Thresholds(min_samples=50), run_log=log, rounds=2, depth=3)
    assert {"panel", "counts", "scored", "history", "forward", "errors", "sections", "timeline", "verdict"} <= set(out)
    v = out["verdict"].first()
    assert v.measurable and v.is_real and v.rule.startswith("R")
    assert out["forward"].count() == 24 and out["sections"].count() == 4
    assert {r.step for r in spark.read.parquet(log).collect()} == {"features", "score", "forecast", "monitor", "drift"}


def test_windows_are_anchored_where_training_ended(spark):
    """Two series with different training ends, one with too little after it, one without any."""
    from tidemill.plans.daily import window_starts

    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    keys = ("early", "late", "fresh", "none")
    rows = [(k, day(n), 1.0) for k in keys for n in range(60)]
    d = spark.createDataFrame(rows, "series_key string, target_ts timestamp, y double")
    p = d.select("series_key", F.col("target_ts").alias("ts"))
    trained = spark.createDataFrame([("early", day(20)), ("late", day(45)), ("fresh", day(58)), ("none", None)], "series_key string, train_data_end timestamp")
    got = {r.series_key: r for r in window_starts(d, p, WindowSpec(10, 10), Thresholds(min_samples=5), trained, True, "7").collect()}
    assert {k: r.current_start for k, r in got.items()} == {"early": day(20), "late": day(45), "fresh": day(49), "none": day(49)}
    assert {k: (r.measurable, r.rows_after) for k, r in got.items()} == {"early": (True, 40), "late": (True, 15), "fresh": (False, 2), "none": (True, 0)}
    assert all(r.source == "fitted_on_train_window" and r.champion_version == "7" for r in got.values())
    assert "in-sample" in got["late"].reason and "does not record" in got["none"].reason and "only 2 rows" in got["fresh"].drift_reason
    # On the calendar split a champion that stopped long before may score.
    old = spark.createDataFrame([("early", day(20))], "series_key string, train_data_end timestamp")
    one = {r.series_key: r for r in window_starts(d, p, WindowSpec(10, 10), Thresholds(min_samples=50), old, True).collect()}
    assert (one["early"].source, one["early"].measurable, one["late"].source) == ("registry", False, "fitted_on_train_window")


def test_a_fresh_champion_gives_r0_and_still_tells_errors(spark):
    from tidemill.plans.daily import daily_monitor

    rng = np.random.default_rng(6)
    values = [100 + 10 * math.sin(i / 24 * 2 * math.pi) + rng.normal() for i in range(24 * 24)]
    spec = SeriesSpec(lags=(24,), season_lags=(24, 48), temperature_lag=24, short_window=24, long_window=48, season=24, min_history=72, stride=24)
    p = panel.build_panel(series(spark, values)).cache()
    end = p.agg(F.max("ts")).first()[0]
    out = daily_monitor(p, spec, WindowSpec(7, 7), Thresholds(min_samples=50), train_data_end=end, rounds=1, depth=2)
    v = out["verdict"].first()
    assert (v.rule, v.measurable, v.should_retrain) == ("R0_champion_is_current", False, False)
    assert out["errors"].count() >= 13 and out["scoring_model"].first().source == "fitted_on_train_window"


def test_ablation_and_publish(spark, tmp_path):
    from tidemill.operators import models
    from tidemill.sources import lake

    rng = np.random.default_rng(7)
    spec = SeriesSpec(lags=(24,), season_lags=(24,), temperature_lag=24, short_window=24, long_window=48, season=24, min_history=72, stride=24, max_horizon=3)
    p = panel.build_panel(series(spark, (100 + rng.normal(size=24 * 12)).tolist())).cache()
    d = models.cutoff_design(p, spec, design.training_origins(p, spec))
    got = models.ablation(p, d, ("demand_last",), spec, rounds=1, depth=1).first()
    assert got.status == "measured" and got.mae_baseline > 0 and got.horizons_total == 3
    assert models.ablation(p, d, ("absent",), spec).first().status == "not measured"
    lake.publish(spark.range(3), f"file://{tmp_path}/out", False, "made up")
    rows = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert len(rows) == 3 and all((r.is_real, r.warning) == (False, "made up") and r.generated_at_utc for r in rows)
