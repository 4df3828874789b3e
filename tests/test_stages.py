"""Staged runs, selection of order statistics, months touched by upserts, streams, day summaries and compiled trees."""

from __future__ import annotations

import datetime as dt
import math
import os
import re
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.functions import core
from tidemill.operators import backtest, design, drift, models, panel, timeline, trees
from tidemill.operators import statistics as st
from tidemill.sources import lake
from tidemill.sources.stage import Stages
from tidemill.specs import SeriesSpec, TableSpec, Thresholds, WindowSpec
from tidemill.streaming import ingest

T0 = dt.datetime(2024, 1, 1)
HOUR, DAY = dt.timedelta(hours=1), dt.timedelta(days=1)
SPEC = SeriesSpec(lags=(24,), season_lags=(24, 48), temperature_lag=24, short_window=24, long_window=48, season=24, min_history=72, stride=24)


def folder() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def leaves(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().size()


def waves(spark, hours: dict[str, int]):
    rng = np.random.default_rng(6)
    rows = [(k, T0 + i * HOUR, 100 + 10 * math.sin(i / 24 * 2 * math.pi) + float(rng.normal())) for k, n in hours.items() for i in range(n)]
    return panel.build_panel(spark.createDataFrame(rows, "series_key string, ts timestamp, demand_mwh double"))


# -- the daily run


def test_the_monitor_writes_each_table_once_and_goes_on_without_short_series(spark):
    from tidemill.plans.daily import daily_monitor

    p = waves(spark, {"a": 24 * 24, "short": 24 * 5})
    out = daily_monitor(p, SPEC, WindowSpec(7, 7), Thresholds(min_samples=50), rounds=1, depth=2)
    assert all(leaves(out[k]) <= 20 for k in out)
    state = {r.series_key: (r.state, r.n_train > 0) for r in out["scoring_model"].collect()}
    assert state == {"a": ("measured", True), "short": ("not enough history", False)}
    v = {r.series_key: r for r in out["verdict"].collect()}
    assert v["short"].rule == "not_enough_history" and not v["short"].should_retrain and v["a"].rule != v["short"].rule
    # The same rows as the operators give without stages.
    scored = out["scored"].drop("generated_at_utc", "is_real", "warning").cache()
    t = Thresholds(min_samples=50)
    want = {(r.section, r.severity, r.value) for r in drift.drift_sections(scored, list(SPEC.features), t).collect()}
    assert {(r.section, r.severity, r.value) for r in out["sections"].collect()} == want
    held = out.stages.held
    assert not {"design", "panel_rows", "counted", "counted_by_day"} & set(held)
    out.close()
    with pytest.raises(Exception, match="exist|not found|PATH"):
        spark.read.parquet(f"{out.stages.path}/scored").count()


def test_a_run_without_any_history_is_an_error_and_leaves_nothing(spark, tmp_path):
    from tidemill.plans.daily import daily_monitor

    log = f"{folder()}/log"
    with pytest.raises(ValueError, match="not enough history"):
        daily_monitor(waves(spark, {"short": 24 * 5}), SPEC, WindowSpec(7, 7), run_log=log, rounds=1, depth=1)
    assert {(r.step, r.status) for r in spark.read.parquet(log).collect()} == {("features", "ok"), ("score", "failed")}


def test_nothing_since_training_is_nothing_to_monitor(spark):
    from tidemill.plans.daily import window_starts, window_states

    rows = [("s", T0 + n * DAY, 1.0) for n in range(60)]
    d = spark.createDataFrame(rows, "series_key string, target_ts timestamp, y double")
    p = d.select("series_key", F.col("target_ts").alias("ts"))
    trained = spark.createDataFrame([("s", T0 + 60 * DAY)], "series_key string, train_data_end timestamp")
    w = WindowSpec(10, 10)
    one = window_states(d, window_starts(d, p, w, Thresholds(min_samples=0), trained, True), w).first()
    assert (one.state, one.n_current) == ("nothing to monitor", 0)


def test_stages_are_dropped_and_closed(spark):
    s = Stages(spark, "test")
    a = s.put("a", spark.range(5))
    b = s.put("b", a.withColumn("x", F.col("id") * 2))
    s.drop("a", "absent")
    assert b.count() == 5 and leaves(b) == 1 and set(s.held) == {"b"}
    s.close()


# -- order statistics


def test_quantiles_of_a_million_values_come_from_no_single_task(spark):
    n = 1_000_000
    rows = spark.range(n).select(F.lit("s").alias("series_key"), F.lit("x").alias("column"), F.when(F.col("id") % 3 == 0, "current").otherwise("reference").alias("window"), (F.col("id") * 7919 % n / 7.0).alias("value"))
    x = (np.arange(n) * 7919 % n) / 7.0
    ref = x[np.arange(n) % 3 != 0]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    run = st.placed(st.counted(rows, ["series_key"]), ["series_key", "column"])
    most = run.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    # 16 ranges over 4 shuffle partitions: some hold more ranges than others, none nearly all.
    assert run.count() == n and most < 0.6 * n
    d = st.described(rows, ["series_key"]).first()
    assert np.array_equal(d.edges[1:-1], np.quantile(ref, np.arange(1, 10) / 10))
    assert (d.reference_p05, d.reference_p50, d.current_p95) == (*np.quantile(ref, [0.05, 0.5]), np.quantile(x[::3], 0.95))
    assert "percentile(" not in st.described(rows, ["series_key"])._jdf.queryExecution().optimizedPlan().toString()


def test_order_statistics_of_odd_columns(spark):
    rows = [("k", "one", "reference", 3.0), ("k", "same", "reference", 1.0), ("k", "same", "reference", 1.0), ("k", "same", "current", 1.0), ("k", "late", "current", 2.0)]
    df = spark.createDataFrame(rows, "series_key string, column string, window string, value double")
    d = {r.column: r for r in st.described(df, ["series_key"]).collect()}
    assert d["one"].reference_p50 == 3.0 and d["one"].current_p50 is None and d["one"].std_reference == 0.0
    assert d["same"].levels == [1.0] and d["same"].ks_d == 0.0
    assert d["late"].levels is None and d["late"].edges is None and d["late"].n_levels == 0
    assert {r.column for r in st.quantile_edges(df, ["series_key"]).collect()} == {"one", "same"}
    assert st.described(df.limit(0), ["series_key"]).count() == 0


def test_cumulated_counts_do_not_hang_on_the_order_of_rows(spark):
    """Each evaluation of the plan must cut a column at the same values, or its parts do not fit together."""
    n = 400_000
    rows = spark.range(n, numPartitions=16).select(F.lit("s").alias("series_key"), F.lit("x").alias("column"), F.when(F.xxhash64("id") % 2 == 0, "current").otherwise("reference").alias("window"), (F.col("id") * 7919 % n / 7.0).alias("value"))
    counts = st.counted(rows, ["series_key"])
    run = st.placed(counts, ["series_key", "column"])
    assert "percentile_approx" not in run._jdf.queryExecution().optimizedPlan().toString()
    got = run.orderBy("value").select("n_reference", "c_reference", "n_current", "c_current").toPandas()
    assert (got.n_reference.cumsum() == got.c_reference).all() and (got.n_current.cumsum() == got.c_current).all()
    cuts = [st._cuts(c, ["series_key", "column"], 16).first().cuts for c in (counts, counts.orderBy("value"), counts.orderBy(F.desc("value")))]
    assert len(cuts[0]) == 15 and cuts[0] == cuts[1] == cuts[2] and cuts[0] == sorted(set(cuts[0]))


def test_ranges_grow_with_the_values_and_find_every_one(spark, monkeypatch):
    monkeypatch.setattr(st, "SPARSE", 4)
    monkeypatch.setattr(st, "RANGE", 50)
    rows = [(k, "x", ("reference", "current")[i % 3 == 0], float((i * 37) % m) - m / 2) for k, m in (("none", 1), ("few", 9), ("many", 3000)) for i in range(2 * m)]
    counts = st.counted(spark.createDataFrame(rows, "series_key string, column string, window string, value double"), ["series_key"])
    cuts = {r.series_key: r.cuts for r in st._cuts(counts, ["series_key", "column"], 4).collect()}
    assert len(cuts["many"]) == 59 and len(cuts["few"]) <= 3 and len(cuts["none"]) <= 1
    for buckets in (1, 4, 100):
        got = st.placed(counts, ["series_key", "column"], buckets).orderBy("series_key", "value").toPandas()
        assert len(got) == 3010
        for s in ("reference", "current"):
            assert (got.groupby("series_key")[f"n_{s}"].cumsum() == got[f"c_{s}"]).all()
            assert (got.groupby("series_key")[f"n_{s}"].transform("sum") == got[f"all_{s}"]).all()


def test_labels_round_ties_to_the_even_digit(spark):
    x = [1234.5, 1235.5, 12345.0, 12355.0, 123.25, -1234.5, 2.5, 0.0, 99985.0, 1234.51, 1e15, 0.5, 31.25, 10.0625]
    got = spark.createDataFrame([(v,) for v in x], "x double").select(core.bin_label("x", F.lit(float("inf")))).collect()
    assert [r[0] for r in got] == [f"[{v:.4g}, inf)" for v in x]


def test_a_large_column_is_shuffled_by_its_ranges(spark):
    """Large tables are planned with a shuffle by column, and the join is broadcast once the cuts are known; the ranges must not stay by column."""
    text = lambda k: (F.col("id") % k).cast("string")
    rows = spark.range(1000).select(text(2).alias("series_key"), text(3).alias("column"), text(5).alias("window"), (F.col("id") / 7.0).alias("value"))
    sizes = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    try:
        plan = st.placed(st.counted(rows, ["series_key"]), ["series_key", "column"])._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        for k in sizes:
            spark.conf.unset(k)
    # The window that cumulates a range's values stands on a shuffle by range.
    at = next(i for i, line in enumerate(plan) if "Window [" in line and "value#" in line.split("ASC")[0] and "bucket#" in line)
    assert "bucket#" in next(line for line in plan[at:] if "Exchange" in line)


def _joins_by_column_alone(plan: str) -> list[str]:
    """Joins of counted values, by the plan, on a column's keys alone."""
    joins = [re.search(r"Join \[(.*?)\], \[", line) for line in plan.splitlines() if "Join [" in line]
    return [j[0] for j in joins if j and not re.search("bucket#|part#|bin#", j[1])]


@pytest.mark.parametrize("of", ["quantile_edges", "summarise", "histogram"])
def test_no_join_sorts_a_column_whole(spark, of):
    """Where joins are not broadcast, one by column alone leaves all its values to one task's sort."""
    rows = spark.range(1000).selectExpr("string(id % 2) series_key", "string(id % 3) column", "if(id % 5 < 2, 'current', 'reference') window", "id / 7.0D value")
    sizes = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    try:
        plan = getattr(st, of)(rows, ["series_key"])._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in sizes:
            spark.conf.unset(k)
    assert "SortMergeJoin" in plan and not _joins_by_column_alone(plan)


def test_no_task_counts_the_bins_of_a_column_whole(spark):
    """Values of a single column meet their bins range by range, and every one is counted."""
    n = 200_000
    rows = spark.range(n).select(F.lit("s").alias("series_key"), F.lit("x").alias("column"), F.when(F.col("id") % 3 == 0, "current").otherwise("reference").alias("window"), (F.col("id") * 7919 % n / 7.0).alias("value"))
    counts, group = st.counted(rows, ["series_key"]), ["series_key", "column"]
    sizes = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    met, _ = st.binned(st.ranged(counts, group), st.described(counts, ["series_key"]), ["series_key"])
    most = met.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    for k in sizes:
        spark.conf.unset(k)
    assert met.count() == n and most < 0.6 * n
    h = st.histogram(rows, ["series_key"]).agg(F.count("*"), F.sum("n_reference"), F.sum("n_current")).first()
    assert tuple(h) == (10, n - (n + 2) // 3, (n + 2) // 3)
    got = st.psi(rows, ["series_key"], detail=True).first()
    assert got.bins == 10 and sum(b.n_reference + b.n_current for b in got.psi_bins) == n


def test_sizes_that_a_user_has_chosen_stand(spark):
    from tidemill.session import SIZES, ensure_sizes

    other = spark.newSession()
    a, b = SIZES
    other.conf.set(a, "64m")
    ensure_sizes(other)
    assert other.conf.get(a) == "64m" and other.conf.get(b) == SIZES[b][1]


def test_a_row_group_is_not_counted_by_one_task(spark, monkeypatch):
    """One task reads a row group whole, however large; its values must be dealt out before they are counted."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from tidemill import session
    from tidemill.plans import queries, tables

    n, path = 40_000, folder()
    price = np.random.default_rng(8).permutation(n) / 7.0
    columns = {
        "l_orderkey": np.arange(n) // 4, "l_linenumber": np.arange(n) % 4, "l_quantity": np.ones(n), "l_extendedprice": price, "l_discount": np.zeros(n), "l_tax": np.zeros(n),
        "l_returnflag": ["N"] * n, "l_shipdate": np.full(n, np.datetime64("1995-01-01", "us")),
    }
    pq.write_table(pa.table(columns), f"{path}/lineitem.parquet", row_group_size=n)
    monkeypatch.setattr(session, "ROWS", 5000)
    other = spark.newSession()
    other.conf.set("spark.sql.shuffle.partitions", "4")
    rows = tables.price_columns(other, path)
    held = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) == n and len(held) == 8 and max(held) < 2 * 5000
    edges = sorted(r.edge for r in queries.quantile_edges(other, path).where("column = 'l_extendedprice'").collect())
    assert edges == [round(float(x), 4) for x in np.quantile(price, np.arange(1, 10) / 10)]
    # Rows alike but for their keys are dealt out, too.
    pq.write_table(pa.table(columns | {"l_extendedprice": np.ones(n)}), f"{path}/lineitem.parquet", row_group_size=n)
    held = [r["count"] for r in tables.price_columns(other, path).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) == n and max(held) < 2 * 5000


def test_shuffles_of_a_large_table_begin_with_more_parts(spark):
    from tidemill.session import _FIRST, ROWS, dealt, ensure_sizes

    other = spark.newSession()
    other.conf.set("spark.sql.shuffle.partitions", "12")
    for rows, parts in ((12 * ROWS, None), (12 * ROWS + 1, "13"), (72 * ROWS, "72"), (20 * ROWS, "72")):
        ensure_sizes(other, rows)
        assert other.conf.get(_FIRST, None) == parts
    few = other.range(10)
    assert dealt(few, ROWS, "id") is few and dealt(few, 10**9, "id").rdd.getNumPartitions() == 200


# -- upserts


def batch(spark, days, value=1.0, seq=1):
    return spark.createDataFrame([("a", T0 + n * DAY, value, seq) for n in days], "site string, ts timestamp, value double, seq long")


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_an_upsert_reads_and_rewrites_only_its_months(spark):
    spec = TableSpec("t", ("site", "ts"), "ts", folder() + "/lake")
    lake.upsert(spark, batch(spark, range(200)), spec, ["seq"])
    before = files(spec.path)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    assert lake.upsert(spark, batch(spark, [60, 61, 300], 2.0, 2), spec, ["seq"]) == {"rows_received": 3, "rows_added": 1, "rows_updated": 2, "rows_total": 201, "partitions_touched": 2}
    after = files(spec.path)
    assert {f.split("month=")[1].split("/")[0] for f in set(before) ^ set(after)} == {"3", "10"}
    old = spark.read.parquet(spec.path).where((F.col("year") * 100 + F.col("month")).isin([202403]))
    plan = old._jdf.queryExecution().executedPlan().toString()
    assert "202403" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_rows_that_say_nothing_new_rewrite_no_month(spark):
    spec = TableSpec("t", ("site", "ts"), "ts", folder() + "/lake")
    args = {"order": ["seq"], "unchanged": ("seq",)}
    assert lake.upsert(spark, batch(spark, range(60)), spec, **args)["partitions_rewritten"] == 2
    before = files(spec.path)
    again = lake.upsert(spark, batch(spark, range(20, 50), seq=2), spec, **args)
    assert (again["rows_received"], again["rows_updated"], again["partitions_rewritten"]) == (30, 30, 0) and files(spec.path) == before
    news = lake.upsert(spark, batch(spark, range(20, 50), seq=3).withColumn("value", F.when(F.dayofyear("ts") == 45, 9.0).otherwise(F.col("value"))), spec, **args)
    assert news["partitions_rewritten"] == 1 and news["rows_total"] == 60
    got = {r.ts: (r.value, r.seq) for r in spark.read.parquet(spec.path).collect()}
    assert got[T0 + 44 * DAY] == (9.0, 3) and got[T0 + 43 * DAY] == (1.0, 1)
    # A value that goes back to what it was is news too, and so is one that becomes null.
    assert lake.upsert(spark, batch(spark, [44], seq=4), spec, **args)["partitions_rewritten"] == 1
    assert lake.upsert(spark, batch(spark, [44], value=None, seq=5), spec, **args)["partitions_rewritten"] == 1


def test_totals_come_from_footers(spark):
    spec = TableSpec("t", ("site", "ts"), "ts", folder() + "/lake")
    lake.upsert(spark, batch(spark, range(100)), spec, ["seq"])
    with lake.footers(spark):
        plan = lake.month_counts(spark, spec)._jdf.queryExecution().executedPlan().toString()
        assert "PushedAggregation: [COUNT(*)]" in plan and "PushedGroupBy: [year, month]" in plan
    assert lake.count_rows(spark, spec) == 100
    assert "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList")
    last = {r.site: r.last_ts for r in lake.stored_last_timestamp(spark, spec, "site", spark.createDataFrame([("a",), ("b",)], "site string")).collect()}
    assert last == {"a": T0 + 99 * DAY, "b": None}


def test_first_warnings_are_by_series(spark):
    rows = spark.createDataFrame([(f"s{i:02d}", T0 + n * DAY, n > 0) for i in range(25) for n in range(3)], "series_key string, cutoff timestamp, fold_ok boolean")
    got = backtest.first_warnings(backtest.fold_report(rows)).collect()
    assert [r.series_key for r in got] == [f"s{i:02d}" for i in range(20)] and "1 of 3 folds" in got[0].warning


# -- streams


def test_a_stream_with_a_replay_a_revision_and_a_late_row(spark):
    base = folder()
    os.makedirs(f"{base}/in")
    spec = TableSpec("d", ("respondent", "timestamp_utc"), "timestamp_utc", f"{base}/lake")
    record = '{"period":"%s","respondent":"P","value":"%d"}'
    page = lambda rows: '{"response":{"data":[%s]}}' % ",".join(record % r for r in rows)
    first = [("2024-01-30T05", 1), ("2024-02-01T05", 2)]
    batches = [first, first, [("2024-02-01T05", 7), ("2024-01-30T05", 1)], [("2023-12-24T00", 5)]]
    written = []
    for i, rows in enumerate(batches):
        with open(f"{base}/in/{i}.json", "w") as f:
            f.write(page(rows))
        before = files(spec.path)
        ingest.ingest_records(spark, f"{base}/in", spec, f"{base}/check").awaitTermination()
        after = files(spec.path)
        written.append({f.split("year=")[1].rsplit("/", 1)[0] for f in set(after) - set(before)})
    assert written == [{"2024/month=1", "2024/month=2"}, set(), {"2024/month=2"}, {"2023/month=12"}]
    got = {str(r.timestamp_utc): r.demand_mwh for r in spark.read.parquet(spec.path).collect()}
    assert got == {"2024-01-30 05:00:00": 1.0, "2024-02-01 05:00:00": 7.0, "2023-12-24 00:00:00": 5.0}


@pytest.mark.parametrize(("form", "end"), [(ingest.daily_buckets, "day"), (ingest.trailing_week, "until")])
def test_windows_run_as_streams(spark, form, end):
    base = folder()
    rng = np.random.default_rng(3)
    rows = [("s", T0 + i * HOUR, float(rng.integers(100))) for i in range(24 * 20)]
    shape = "series_key string, ts timestamp, demand_mwh double"
    parts = [rows[:240], rows[240:], [("s", T0 + HOUR, 999.0)], [("s", T0 + 60 * DAY, 1.0)]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(f"{base}/in")
        os.utime(base)
        stream = form(spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(f"{base}/in"))
        q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start()
        q.awaitTermination()
        kept = [p["numRowsTotal"] for p in q.lastProgress["stateOperators"]]
        assert all(x <= 40 for x in kept), "the state holds days or weeks, never rows"
    dropped = sum(p["numRowsDroppedByWatermark"] for p in q.lastProgress["stateOperators"])
    want = form(spark.createDataFrame(rows, shape)).where(F.col(end) <= T0 + 20 * DAY).select("series_key", end, F.round("mean", 9).alias("mean"), "n")
    got = spark.read.parquet(f"{base}/out").where(F.col(end) <= T0 + 20 * DAY).select("series_key", end, F.round("mean", 9).alias("mean"), "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() >= 20
    assert dropped == 0 and got.where("mean > 500").count() == 0


# -- the timeline day by day


def scored_days(spark, first, last):
    rows = []
    for n in range(first, last):
        for i in range(60):
            t = T0 + n * DAY + dt.timedelta(minutes=i)
            rows.append(("s", t - HOUR, 1, t, "reference" if n < 20 else "current", float((i * 7 + n) % 50), float(i % 5), 20.0 + i % 9))
    df = spark.createDataFrame(rows, "series_key string, origin_ts timestamp, horizon_h int, target_ts timestamp, window string, f double, y double, prediction double")
    return backtest.add_errors(df)


def test_a_day_added_to_the_timeline_gives_the_whole_run(spark):
    path, t = folder() + "/timeline", Thresholds(min_samples=100)
    whole = scored_days(spark, 0, 40)
    timeline.begin(spark, path, whole, ["f"], "v1", t)
    timeline.extend(spark, path, scored_days(spark, 0, 39), ["f"], "v1")
    before = files(f"{path}/days")
    timeline.extend(spark, path, scored_days(spark, 39, 40), ["f"], "v1")
    new = set(files(f"{path}/days")) - set(before)
    assert new and all("day=2024-02-09" in f for f in new) and set(before) <= set(files(f"{path}/days"))
    order = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    want = drift.drift_timeline(whole, ["f"], t)
    got = timeline.read(spark, path, t)
    assert got.columns == want.columns and order(got) == order(want) and want.count() > 30
    # A day that comes again takes the place of what was there.
    timeline.extend(spark, path, scored_days(spark, 39, 40), ["f"], "v1")
    assert order(timeline.read(spark, path, t)) == order(want)
    with pytest.raises(timeline.OtherBins):
        timeline.extend(spark, path, whole, ["f"], "v2")


# -- trees as expressions


def test_compiled_trees_give_what_the_model_gives(spark):
    rng = np.random.default_rng(5)
    n = 100_000
    cols = {"hour": rng.integers(0, 24, n), "x": rng.normal(size=n), "z": rng.normal(size=n)}
    y = 10 * np.sin(cols["hour"]) + 3 * (cols["x"] > 0.3) + np.where(np.arange(n) % 11 == 0, 5.0, cols["z"])
    rows = [(int(h), float(x), None if i % 11 == 0 else float(z), float(v)) for i, (h, x, z, v) in enumerate(zip(cols["hour"], cols["x"], cols["z"], y))]
    df = spark.createDataFrame(rows, "hour int, x double, z double, y double").repartition(4).cache()
    names = ("hour", "x", "z")
    model = models.gbt_fit(df.where("hour <> 23").limit(5000), names, rounds=4, depth=4)
    got = models.gbt_predict(model, df)
    both = models.gbt_transform(model, got.withColumnRenamed("prediction", "mine"))
    assert both.agg(F.max(F.abs(F.col("mine") - F.col("prediction")))).first()[0] < 1e-9
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "UDF" not in plan and "Python" not in plan


def test_trees_by_hand(spark):
    forest = [(0.5, trees.Split(0, trees.Leaf(1.0), trees.Split(1, trees.Leaf(2.0), trees.Leaf(4.0), values=frozenset({1.0, 2.0}), known=frozenset({0.0, 1.0, 2.0})), line=10.0)), (1.0, trees.Leaf(0.25))]
    df = spark.createDataFrame([(10.0, 0), (11.0, 1), (11.0, 7)], "a double, b int")
    assert [r[0] for r in df.select(trees.prediction(forest, ("a", "b"))).collect()] == [0.75, 1.25, 2.25]


@pytest.mark.parametrize("up", [True, False])
def test_missing_values_find_the_side_that_fits_them(spark, up):
    """Whether x is there decides, and x itself does not; missing rows lie above or below the others."""
    rng = np.random.default_rng(8)
    rows = [(None if i % 4 == 0 else float(rng.normal()), float(rng.normal()), (50.0 if (i % 4 == 0) == up else 10.0)) for i in range(2000)]
    df = spark.createDataFrame(rows, "x double, z double, y double")
    model = models.gbt_fit(df, ("x", "z"), rounds=2, depth=2)
    assert model.stages[1].getInputCols() == ["__x_x", "__y_x", "__x_z"]
    assert models.gbt_predict(model, df).where("abs(prediction - y) > 1").count() == 0
    top = models.feature_importance(model, ("x", "z")).first()
    assert top.feature == "x" and top.share > 99
    # A middle level that only the missing rows have needs both sides of x: below 0 gives 10, above gives 90, missing 50.
    mid = spark.createDataFrame([(None if i % 3 == 0 else float(i % 3) - 1.5, 0.0, (50.0, 10.0, 90.0)[i % 3]) for i in range(900)], "x double, z double, y double")
    again = models.gbt_fit(mid, ("x", "z"), rounds=2, depth=2)
    assert models.gbt_predict(again, mid).where("abs(prediction - y) > 1").count() == 0


def test_refits_at_every_cutoff_equal_separate_fits(spark):
    p = waves(spark, {"a": 24 * 12}).cache()
    spec = SeriesSpec(lags=(24,), season_lags=(24,), temperature_lag=24, short_window=24, long_window=48, season=24, min_history=72, stride=24, max_horizon=3)
    d = models.cutoff_design(p, spec, design.training_origins(p, spec)).cache()
    s = p.select("series_key", "ts", "demand_mwh").where("demand_mwh is not null")
    cuts = backtest.make_cutoffs(s, spec, min_history=168)
    asked = backtest.folds(cuts, spec)
    got = {(r.cutoff, r.horizon_h): r.prediction for r in models.walk_forward_gbt(d, spec, refit_every=1, rounds=1, depth=2)(s, asked).collect()}
    times = sorted({k[0] for k in got})
    assert len(times) > 2
    for cutoff in (times[0], times[-1]):
        model = models.gbt_fit(design.training_slice(d, F.lit(cutoff)), spec.features, rounds=1, depth=2)
        alone = models.gbt_predict(model, d.where(F.col("origin_ts") == F.lit(cutoff)))
        assert {r.horizon_h: r.prediction for r in alone.collect()} == {k[1]: v for k, v in got.items() if k[0] == cutoff}


def test_a_model_for_each_series_sees_its_span_only(spark):
    s = spark.createDataFrame([(k, T0 + i * HOUR, float(i + 1000 * (k == "b"))) for k in "ab" for i in range(24 * 30)], "series_key string, ts timestamp, demand_mwh double")
    seen = lambda history, asked: asked["horizon_h"] * 0 + (len(history) + history["demand_mwh"].max() / 1e6)
    rows = backtest.walk_forward(s, backtest.per_series(seen, 100), SeriesSpec(), weeks=1)
    for r in rows.collect():
        last = (r.cutoff - T0) / HOUR - 1 + 1000 * (r.series_key == "b")
        assert math.isclose(r.prediction, 100 + last / 1e6)
    assert rows.select("series_key", "cutoff").distinct().count() > 10
    # The mean of the same hour over a week, as grouped pandas and as columns.
    mean = lambda history, asked: asked["target_ts"].dt.hour.map(history.groupby(history["ts"].dt.hour)["demand_mwh"].mean())
    got = backtest.walk_forward(s, backtest.per_series(mean, 168), SeriesSpec(), weeks=1)
    for r in got.collect():
        h = int((r.target_ts - T0) / HOUR)
        c = int((r.cutoff - T0) / HOUR)
        assert math.isclose(r.prediction, np.mean([x for x in range(c - 168, c) if x % 24 == h % 24]) + 1000 * (r.series_key == "b"))
