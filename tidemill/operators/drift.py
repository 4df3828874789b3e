"""Drift of inputs, target, predictions and accuracy, over any number of series.

Scored rows carry series_key, origin_ts, horizon_h, target_ts, the features, y,
prediction, the errors and ``window`` (train, reference or current).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import ks_p_value, psi_term, rank, severity, severity_of
from ..specs import DETERMINISTIC, Thresholds, WindowSpec
from .backtest import add_errors
from .statistics import SIDES, binned, compare_columns, counted, described, histogram, long_form, psi_detail

SECTIONS = ("feature", "target", "prediction", "performance")


def split_windows(design: DataFrame, w: WindowSpec = WindowSpec(), anchor: str | Column | None = None, required: bool = False, panel: DataFrame | None = None) -> DataFrame:
    """``window`` by target time: train < reference start <= reference < current start <= current.

    Without an anchor the current window begins ``current_days`` before the end of
    each series, which is its last time in ``panel`` or else its last target; with
    one (a time, or a column of the design) it begins there. Rows without a label
    are dropped. With ``required`` an empty window is an error, except the current
    one of an anchor (nothing to monitor yet).
    """
    held = design.where("y is not null")
    if anchor is None:
        ends = design.groupBy("series_key").agg(F.max("target_ts").alias("__end")) if panel is None else panel.groupBy("series_key").agg(F.max("ts").alias("__end"))
        out = held.join(ends, "series_key").withColumn("__current", F.col("__end") - F.expr(f"INTERVAL {w.current_days} DAYS")).drop("__end")
    else:
        out = held.withColumn("__current", F.to_timestamp(F.lit(anchor)) if isinstance(anchor, str) else anchor)
    start = F.col("__current") - F.expr(f"INTERVAL {w.reference_days} DAYS")
    label = F.when(F.col("target_ts") >= F.col("__current"), "current").when(F.col("target_ts") >= start, "reference").otherwise("train")
    out = out.withColumn("window", label).drop("__current")
    if required:
        have = {r[0] for r in out.select("window").distinct().collect()}
        need = {"train", "reference"} | (set() if anchor is not None else {"current"})
        if need - have:
            raise ValueError(f"empty windows: {', '.join(sorted(need - have))}")
    return out


def split_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("series_key", "window").agg(F.count("*").alias("n"))


def score_windows(split: DataFrame, predict) -> DataFrame:
    """Reference and current rows with the prediction of a model frozen on train rows, and the errors.

    ``predict(train, rows)`` fits on the first and adds ``prediction`` to the second.
    """
    rows = predict(split.where("window = 'train'"), split.where("window <> 'train'"))
    return add_errors(rows)


def window_errors(scored: DataFrame, keys: tuple[str, ...] = ("series_key",)) -> DataFrame:
    """n, mae, mape_pct, rmse and bias (4 places) of each window, each over the values it has."""
    return scored.groupBy(*keys, "window").agg(
        F.count("error").alias("n"),
        F.round(F.avg("abs_error"), 4).alias("mae"),
        F.round(F.avg("abs_pct_error"), 4).alias("mape_pct"),
        F.round(F.sqrt(F.avg(F.col("error") * F.col("error"))), 4).alias("rmse"),
        F.round(F.avg("error"), 4).alias("bias"),
    )


def daily_errors(scored: DataFrame) -> DataFrame:
    """By target day: mae, mape_pct, bias, n (all rows) and the later window that has rows that day."""
    days = scored.withColumn("day", F.to_date("target_ts"))
    return days.groupBy("series_key", "day").agg(
        F.avg("abs_error").alias("mae"),
        F.avg("abs_pct_error").alias("mape_pct"),
        F.avg("error").alias("bias"),
        F.count("*").alias("n"),
        F.when(F.max((F.col("window") == "current").cast("int")) == 1, "current").otherwise("reference").alias("window"),
    )


def rolling_error_series(scored: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """``daily_errors`` with the means of the last days present (not calendar days)."""
    n = max(1, t.rolling_window_hours // 24)
    w = Window.partitionBy("series_key").orderBy("day").rowsBetween(-(n - 1), 0)
    return daily_errors(scored).withColumns({"mae_rolling": F.avg("mae").over(w), "mape_rolling": F.avg("mape_pct").over(w)})


def worst_day(rolling: DataFrame) -> DataFrame:
    """The first day with the largest rolling error of each series."""
    return rolling.where("mae_rolling is not null").groupBy("series_key").agg(
        F.max("mae_rolling").alias("worst_mae_rolling"), F.max_by("day", F.struct("mae_rolling", -F.unix_date("day"))).alias("worst_day")
    )


def section_rollup(compared: DataFrame, t: Thresholds = Thresholds(), keys: tuple[str, ...] = ("series_key",)) -> DataFrame:
    """Columns to one row per section: counts, drifted share, worst PSI and its column, severity."""
    votes = ~F.col("deterministic") & ~F.col("insufficient_data")
    alerts, warns = votes & (F.col("severity") == "alert"), votes & (F.col("severity") == "warn")
    out = compared.groupBy(*keys, "section").agg(
        F.count_if(votes).alias("columns_scored"),
        F.count_if(alerts).alias("alerting"),
        F.count_if(warns).alias("warning"),
        F.sort_array(F.collect_list(F.when(~votes, F.col("column")))).alias("excluded"),
        F.max(F.when(votes, F.col("psi"))).alias("max_psi"),
        F.max_by(F.when(votes, F.col("column")), F.when(votes, F.col("psi"))).alias("max_psi_column"),
        F.max(F.when(votes, rank("severity"))).alias("__worst"),
        F.bool_and("insufficient_data").alias("insufficient_data"),
    )
    share = F.col("alerting") / F.when(F.col("columns_scored") > 0, F.col("columns_scored"))
    out = out.withColumn("drifted_share", F.coalesce(share, F.lit(0.0)))
    many = (
        F.when(F.col("drifted_share") >= t.drifted_share_alert, "alert")
        .when((F.col("alerting") > 0) | (F.col("drifted_share") >= t.drifted_share_warn) | (F.col("warning") > 0), "warn")
        .otherwise("ok")
    )
    found = F.when(F.col("columns_scored") == 0, F.lit("ok")).when(F.col("columns_scored") == 1, severity_of("__worst")).otherwise(many)
    return out.withColumn("severity", found).drop("__worst")


def counted_columns(scored: DataFrame, features: list[str], keys: tuple[str, ...] = ("series_key",), by_day: bool = False) -> DataFrame:
    """(keys, column, value, n_reference, n_current) of the features, y and prediction that are there; with ``by_day`` also day.

    The window labels become the two sides; train rows take no part. Everything that drift tells
    of distributions follows from this table.
    """
    wanted = [c for c in [*features, "y", "prediction"] if c in scored.columns]
    rows = scored.where("window in ('reference', 'current')").withColumn("day", F.to_date("target_ts")) if by_day else scored.where("window in ('reference', 'current')")
    by = ("day",) if by_day else ()
    return counted(long_form(rows, wanted, [*keys, *by]), [*keys], by)


def distribution_drift(scored: DataFrame, features: list[str], t: Thresholds = Thresholds(), keys: tuple[str, ...] = ("series_key",), detail: bool = False, counts: DataFrame | None = None) -> DataFrame:
    """Column comparisons of the feature, target and prediction sections, in one job.

    Columns that are absent are skipped. ``counts`` is what ``counted_columns`` gives, if that is there already.
    """
    out = compare_columns(counted_columns(scored, features, keys) if counts is None else counts, list(keys), t, DETERMINISTIC, detail)
    return out.withColumn("section", F.when(F.col("column") == "y", "target").when(F.col("column") == "prediction", "prediction").otherwise("feature"))


def ordered_features(compared: DataFrame, top: int | None = None) -> DataFrame:
    """Feature columns worst first, those that may vote before the others."""
    out = compared.where("section = 'feature'").orderBy(F.col("deterministic").asc(), F.col("psi").desc(), F.col("column"), *[F.col(c) for c in ("series_key",) if c in compared.columns])
    return out if top is None else out.limit(top)


def performance_drift(scored: DataFrame, t: Thresholds = Thresholds(), keys: tuple[str, ...] = ("series_key",)) -> DataFrame:
    """One row per series: both windows' rounded errors, their movement, severity, and whether it could be measured."""
    e = window_errors(scored.where("window in ('reference', 'current')"), keys)
    at = lambda c, s: F.max(F.when(F.col("window") == s, F.col(c))).alias(f"{s}_{c}")
    out = e.groupBy(*keys).agg(*[at(c, s) for s in ("reference", "current") for c in ("n", "mae", "mape_pct", "rmse", "bias")])
    base = F.col("reference_mae")
    ratio = F.col("current_mae") / F.when(base != 0, base) - 1
    out = out.withColumns({"mae_degradation": ratio, "mape_delta_pp": F.col("current_mape_pct") - F.col("reference_mape_pct")})
    few = (F.least(F.coalesce("reference_n", F.lit(0)), F.coalesce("current_n", F.lit(0))) < t.min_samples) | F.col("mae_degradation").isNull()
    worst = F.greatest(rank(severity("mae_degradation", t.mae_degradation_warn, t.mae_degradation_alert)), rank(severity("mape_delta_pp", t.mape_degradation_warn_pp, t.mape_degradation_alert_pp)))
    out = out.withColumns({"insufficient_data": few, "severity": F.when(few, F.lit("ok")).otherwise(severity_of(worst))})
    return out.withColumn("alert_line", alert_line("reference_mae", t))


def alert_line(reference_mae: str = "reference_mae", t: Thresholds = Thresholds()) -> Column:
    return F.round(F.col(reference_mae) * (1 + t.mae_degradation_alert), 2)


def drift_sections(scored: DataFrame, features: list[str], t: Thresholds = Thresholds(), counts: DataFrame | None = None) -> DataFrame:
    """Four rows per series: section, severity, insufficient_data, metric, value."""
    rolled = section_rollup(distribution_drift(scored, features, t, counts=counts), t)
    a = rolled.select("series_key", "section", "severity", "insufficient_data", F.lit("psi").alias("metric"), F.col("max_psi").alias("value"))
    p = performance_drift(scored, t)
    b = p.select("series_key", F.lit("performance").alias("section"), "severity", "insufficient_data", F.lit("mae_degradation").alias("metric"), F.col("mae_degradation").alias("value"))
    return a.unionByName(b)


def day_summary(counts: DataFrame, plan: DataFrame) -> DataFrame:
    """(series_key, column, day, bin, n, n_ref): how many of a day's values fall in each bin, and of these the reference's; sums of these tell any span of days.

    ``counts`` is ``counted_columns`` by day, ``plan`` what ``described`` gave for the reference.
    """
    rows, _ = binned(counts, plan, ["series_key"])
    return rows.groupBy("series_key", "column", "day", "bin").agg(F.sum(F.col("n_reference") + F.col("n_current")).alias("n"), F.sum("n_reference").alias("n_ref"))


def day_errors(scored: DataFrame) -> DataFrame:
    """(series_key, day, window, day_n, mae) of the reference and current rows."""
    return daily_errors(scored.where("window in ('reference', 'current')")).select("series_key", "day", "window", F.col("n").alias("day_n"), "mae")


def timeline(days: DataFrame, errors: DataFrame, reference: DataFrame, t: Thresholds = Thresholds(), span: int = 7) -> DataFrame:
    """The timeline from day summaries, ``day_errors``, and ``reference`` (series_key, column, bin, n_ref; a row for every bin)."""
    group = ["series_key", "column"]
    grid = errors.select("series_key", "day").join(reference, "series_key")
    dense = grid.join(days.select(*group, "day", "bin", "n"), [*group, "day", "bin"], "left").fillna(0, ["n"])
    trail = Window.partitionBy(*group, "bin").orderBy(F.unix_date("day")).rangeBetween(-(span - 1), 0)
    dense = dense.withColumn("n_cur", F.sum("n").over(trail))
    w = Window.partitionBy(*group, "day")
    share = lambda c: F.col(c) / F.greatest(F.sum(c).over(w), F.lit(1))
    terms = dense.withColumns({"s_ref": share("n_ref"), "s_cur": share("n_cur")}).withColumn("term", psi_term("s_ref", "s_cur"))
    per = terms.groupBy(*group, "day").agg(F.sum("term").alias("psi"))
    feature = ~F.col("column").isin("y", "prediction")
    psis = per.groupBy("series_key", "day").agg(
        F.max(F.when(F.col("column") == "y", F.col("psi"))).alias("target_psi"),
        F.max(F.when(F.col("column") == "prediction", F.col("psi"))).alias("prediction_psi"),
        F.max(F.when(feature, F.col("psi"))).alias("feature_max_psi"),
        F.max_by(F.when(feature, F.col("column")), F.when(feature, F.col("psi"))).alias("feature_max_column"),
    )
    frame = Window.partitionBy("series_key").orderBy(F.unix_date("day")).rangeBetween(-(span - 1), 0)
    by_day = errors.withColumn("n", F.sum("day_n").over(frame)).drop("day_n")
    return psis.join(by_day, ["series_key", "day"]).where(F.col("n") >= t.min_samples).select("series_key", "day", "window", "n", "target_psi", "prediction_psi", "feature_max_psi", "feature_max_column", "mae")


def reference_bins(counts: DataFrame, plan: DataFrame) -> DataFrame:
    """(series_key, column, bin, n_ref) with a row for every bin."""
    rows, bins = binned(counts, plan, ["series_key"])
    found = rows.groupBy("series_key", "column", "bin").agg(F.sum("n_reference").alias("n_ref"))
    return bins.select("series_key", "column", "bin").join(found, ["series_key", "column", "bin"], "left").fillna(0, ["n_ref"])


def without_days(counts: DataFrame) -> DataFrame:
    """``counted_columns`` by day, summed over the days."""
    return counts.groupBy("series_key", "column", "value").agg(*[F.sum(f"n_{s}").alias(f"n_{s}") for s in SIDES])


def drift_timeline(scored: DataFrame, features: list[str], t: Thresholds = Thresholds(), days: int = 7, counts: DataFrame | None = None) -> DataFrame:
    """Per day: PSI of the trailing calendar days against the whole reference, and that day's error.

    Daily counts per bin are laid on a dense (day, column, bin) grid and summed by a
    range frame, so no day rescans its window. ``counts`` is ``counted_columns`` by day.
    """
    counts = counted_columns(scored, features, by_day=True) if counts is None else counts
    counts = counts.where(~F.col("column").isin(list(DETERMINISTIC)))
    summary = day_summary(counts, described(without_days(counts), ["series_key"], t))
    # A bin that no day has adds nothing, so the bins that are there are enough.
    reference = summary.groupBy("series_key", "column", "bin").agg(F.sum("n_ref").alias("n_ref"))
    return timeline(summary, day_errors(scored), reference, t, days)


def window_pair_sweep(series: DataFrame, pairs: DataFrame, column: str, t: Thresholds = Thresholds(), ts: str = "ts") -> DataFrame:
    """Comparisons for named pairs of calendar ranges.

    ``pairs`` (pair, reference_start, reference_end, current_start, current_end; dates,
    ends included) is a short list of questions, each row of the series meeting it
    by a range condition.
    """
    span = pairs.select("pair", F.inline(F.array(
        F.struct(F.lit("reference").alias("window"), F.col("reference_start").alias("a"), F.col("reference_end").alias("b")),
        F.struct(F.lit("current").alias("window"), F.col("current_start").alias("a"), F.col("current_end").alias("b")),
    )))
    day = F.to_date(ts)
    rows = series.join(F.broadcast(span), (day >= F.col("a")) & (day <= F.col("b")))
    return compare_columns(long_form(rows, [column], ["pair"]), ["pair"], t)


def second_opinion(scored: DataFrame, columns: list[str], ks_alpha: float = 0.05, js_line: float = 0.1, t: Thresholds = Thresholds()) -> DataFrame:
    """An independent count of drifted columns: KS for numeric ones, Jensen-Shannon distance for categorical ones.

    It never feeds the verdict. ``status`` is ``measured``, or ``no data`` where neither test applies.
    """
    keys = ["series_key"]
    counts = counted(long_form(scored.where("window in ('reference', 'current')"), [c for c in columns if c in scored.columns], keys), keys)
    plan = described(counts, keys, t)
    terms = psi_detail(histogram(counts, keys, t, plan), keys).where("categorical")
    mid = (F.col("share_reference") + F.col("share_current")) / 2
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / mid)).otherwise(0.0)
    js = terms.groupBy("series_key", "column").agg(F.sqrt(F.greatest(F.lit(0.0), F.sum((part("share_reference") + part("share_current")) / 2))).alias("js"))
    both = plan.select(*keys, "column", ks_p_value("ks_d", "n_reference", "n_current").alias("ks_p")).join(js, ["series_key", "column"], "left")
    both = both.withColumn("drifted", F.when(F.col("js").isNotNull(), F.col("js") > js_line).otherwise(F.col("ks_p") < ks_alpha))
    return both.groupBy("series_key").agg(F.count_if("drifted").alias("drifted_columns"), F.avg(F.col("drifted").cast("int")).alias("drifted_share"), F.count("*").alias("columns")).withColumn(
        "status", F.when(F.col("columns") > 0, "measured").otherwise("no data")
    )
