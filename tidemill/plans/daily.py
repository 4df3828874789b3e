"""The daily monitor: panel, scored windows, forecasts, drift and verdict as named tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift, models, policy
from ..operators.design import build_design_matrix, training_origins
from ..operators.panel import describe_panel
from ..sources.lake import published, timed_step, write_run_log
from ..sources.stage import Stages
from ..specs import SeriesSpec, Thresholds, WindowSpec


FITTED, REGISTRY = "fitted_on_train_window", "registry"


def window_starts(design: DataFrame, panel: DataFrame, w: WindowSpec, t: Thresholds, trained: DataFrame | None, has_champion: bool, version: str | None = None) -> DataFrame:
    """One row per series: where its current window starts, whether drift can be measured, which model scores and why.

    ``trained`` (series_key, train_data_end) tells where the champion's training data
    end; there the current window begins, for what came later is what the model has
    not seen. With fewer than ``min_samples`` labelled rows from there on nothing can be
    measured yet, and with no such time there is no boundary: both fall back to the
    calendar split, the last days of the panel. The champion itself scores only where
    its training data end before the reference starts.
    """
    days = lambda n: F.expr(f"INTERVAL {n} DAYS")
    ends = panel.groupBy("series_key").agg(F.max("ts").alias("end_ts"))
    if trained is None:
        out = ends.withColumns({"train_data_end": F.lit(None).cast("timestamp"), "rows_after": F.lit(0).cast("long")})
    else:
        out = ends.join(trained.select("series_key", F.col("train_data_end").cast("timestamp").alias("train_data_end")), "series_key", "left")
        after = design.where("y is not null").join(trained.select("series_key", "train_data_end"), "series_key").where("target_ts >= train_data_end")
        after = after.groupBy("series_key").agg(F.count("*").alias("rows_after"))
        out = out.join(after, "series_key", "left").withColumn("rows_after", F.coalesce("rows_after", F.lit(0).cast("long")))
    anchored = F.col("train_data_end").isNotNull()
    out = out.withColumn("measurable", ~anchored | (F.col("rows_after") >= t.min_samples))
    out = out.withColumn("current_start", F.when(anchored & F.col("measurable"), F.col("train_data_end")).otherwise(F.col("end_ts") - days(w.current_days)))
    out = out.withColumn("reference_start", F.col("current_start") - days(w.reference_days))
    safe = F.lit(has_champion) & F.coalesce(F.col("train_data_end") < F.col("reference_start"), F.lit(False))
    reason = (
        F.when(F.lit(not has_champion), F.lit("no champion is registered"))
        .when(~anchored, F.lit("the champion does not record where its training data end, so it may have seen the windows"))
        .when(safe, F.lit("the champion's training data end before the reference starts"))
        .otherwise(F.lit("the champion was trained on rows of the reference window, where its errors would be in-sample"))
    )
    out = out.withColumns({"source": F.when(safe, REGISTRY).otherwise(FITTED), "reason": reason, "champion_version": F.lit(version).cast("string")})
    few = F.format_string("only %d rows came after the champion's training data; %d are needed", F.col("rows_after"), F.lit(t.min_samples))
    return out.withColumn("drift_reason", F.when(~F.col("measurable"), few))


MEASURED, TOO_SHORT, NOTHING = "measured", "not enough history", "nothing to monitor"


def window_states(design: DataFrame, starts: DataFrame, w: WindowSpec) -> DataFrame:
    """``starts`` with n_train, n_reference, n_current (labelled rows) and ``state``.

    A series without train or reference rows, or without current ones on the calendar
    split, has ``not enough history``: it is reported and the others go on. Without rows
    since the champion's training there is ``nothing to monitor``.
    """
    at = starts.select("series_key", "current_start")
    split = drift.split_windows(design.join(at, "series_key"), w, anchor=F.col("current_start"))
    names = ("train", "reference", "current")
    n = split.groupBy("series_key").agg(*[F.count_if(F.col("window") == x).alias(f"n_{x}") for x in names])
    out = starts.join(n, "series_key", "left").fillna(0, [f"n_{x}" for x in names])
    short = (F.col("n_train") == 0) | (F.col("n_reference") == 0)
    empty = F.when(F.col("train_data_end").isNotNull() & F.col("measurable"), NOTHING).otherwise(TOO_SHORT)
    return out.withColumn("state", F.when(short, TOO_SHORT).when(F.col("n_current") == 0, empty).otherwise(MEASURED))


class Monitor(dict):
    """The named tables of one run; ``close`` deletes them once they have been read."""

    def __init__(self, stages: Stages) -> None:
        super().__init__()
        self.stages = stages

    def close(self) -> None:
        self.stages.close()


def daily_monitor(
    panel: DataFrame,
    spec: SeriesSpec = SeriesSpec(),
    windows: WindowSpec = WindowSpec(),
    t: Thresholds = Thresholds(),
    champion: PipelineModel | None = None,
    train_data_end: datetime | DataFrame | None = None,
    is_real: bool = True,
    run_log: str | None = None,
    champion_version: str | None = None,
    **how,
) -> Monitor:
    """Named results of one run: panel, scoring_model, counts, scored, history, forward, chart, errors, performance, sections, timeline, verdict.

    Windows and the model that scores them are told by ``window_starts``; a series that
    the champion may not score is scored by a model fitted on the train windows. Where
    nothing can be measured yet the verdict is R0, and accuracy is still told on the
    calendar split. ``train_data_end`` is one time or a table (series_key, train_data_end).
    A series too short for its windows is left out and has the rule ``not_enough_history``;
    with no series left there is an error.

    Each step writes its tables to the run's folder, so the design, the scored rows and the
    counted values are made once and later steps only scan them; what only steps read is
    deleted after the last of them. Steps are timed and, with ``run_log``, appended to a
    table, on failure too.
    """
    spark: SparkSession = panel.sparkSession
    log: list[tuple] = []
    stages = Stages(spark, "daily")
    out = Monitor(stages)

    def step(name, run):
        try:
            done, row = timed_step(name, run)
        except Exception as e:
            log.append(e.run_log_row)
            raise
        log.append(row)
        return done

    def features():
        rows = stages.put("panel_rows", panel)
        out["panel"] = stages.put("panel", describe_panel(rows))
        return rows, stages.put("design", build_design_matrix(rows, training_origins(rows, spec), spec))

    def score(rows, design):
        trained = train_data_end
        if isinstance(trained, datetime):
            trained = rows.select("series_key").distinct().withColumn("train_data_end", F.lit(trained).cast("timestamp"))
        starts = window_starts(design, rows, windows, t, trained, champion is not None, champion_version)
        starts = out["scoring_model"] = stages.put("scoring_model", window_states(design, starts, windows))
        at = starts.where(F.col("state") != TOO_SHORT).select("series_key", "current_start", "source")
        sources = {r["source"] for r in at.select("source").distinct().collect()}
        if not sources:
            raise ValueError(f"{TOO_SHORT}: no series has rows in its train and reference windows")
        split = drift.split_windows(design.join(at, "series_key"), windows, anchor=F.col("current_start")).drop("current_start")
        fitted = models.gbt_fit(split.where(f"window = 'train' and source = '{FITTED}'"), spec.features, **how) if FITTED in sources else champion
        pick = lambda source, model: drift.score_windows(split.where(f"source = '{source}'").drop("source"), lambda train, rows: models.gbt_predict(model, rows))
        scored = [pick(source, fitted if source == FITTED else champion) for source in sorted(sources)]
        out["scored"] = stages.put("scored", scored[0] if len(scored) == 1 else scored[0].unionByName(scored[1]))
        out["counts"] = stages.put("counts", drift.split_counts(out["scored"]))
        return champion or fitted

    def forecast(rows, model):
        out["history"] = stages.put("history", models.forecast_history(out["scored"], spec.max_horizon))
        out["forward"] = stages.put("forward", models.forecast(rows, model, spec))
        out["chart"] = stages.put("chart", models.chart_rows(out["history"], out["forward"]))

    def monitor():
        out["errors"] = stages.put("errors", drift.rolling_error_series(out["scored"], t))
        out["performance"] = stages.put("performance", drift.performance_drift(out["scored"], t))

    def judge():
        names = list(spec.features)
        by_day = stages.put("counted_by_day", drift.counted_columns(out["scored"], names, by_day=True))
        counts = stages.put("counted", drift.without_days(by_day))
        out["sections"] = stages.put("sections", drift.drift_sections(out["scored"], names, t, counts))
        out["timeline"] = stages.put("timeline", drift.drift_timeline(out["scored"], names, t, counts=by_day))
        starts = out["scoring_model"]
        after = F.when(F.col("measurable"), F.greatest("rows_after", F.lit(t.min_samples))).otherwise(F.col("rows_after"))
        after = F.when(F.col("state") == NOTHING, F.lit(0).cast("long")).otherwise(after)
        verdict = policy.champion_is_current(policy.evaluate(out["sections"], t), starts.select("series_key", F.lit("current").alias("window"), after.alias("n")), t)
        out["verdict"] = stages.put("verdict", policy.with_left_out(verdict, starts.where(F.col("state") == TOO_SHORT)))

    try:
        rows, design = step("features", features)
        model = step("score", lambda: score(rows, design))
        stages.drop("design")
        step("forecast", lambda: forecast(rows, model))
        step("monitor", monitor)
        step("drift", judge)
        stages.drop("panel_rows", "counted_by_day", "counted")
    except Exception:
        stages.close()
        raise
    finally:
        if run_log:
            write_run_log(spark, log, run_log)
    for k, v in out.items():
        out[k] = published(v, is_real, None)
    return out
