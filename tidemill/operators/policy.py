"""From drift sections to a retrain verdict: column expressions, so thousands of series are judged at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import rank, severity_of
from ..specs import Thresholds
from .drift import SECTIONS

DISTRIBUTIONS = ("feature", "target", "prediction")
#: actions of the verdict (fixed values)
RETRAIN, WATCH, NONE = "retrain", "watch", "none"


def pivot_sections(sections: DataFrame) -> DataFrame:
    """One row per series: severity, measured flag and value of each section; an absent section is ok and not measured."""
    at = lambda c, s: F.max(F.when(F.col("section") == s, F.col(c)))
    aggs = []
    for s in SECTIONS:
        aggs += [
            F.coalesce(at("severity", s), F.lit("ok")).alias(f"{s}_severity"),
            F.coalesce(F.max(F.when(F.col("section") == s, ~F.coalesce("insufficient_data", F.lit(False)))), F.lit(False)).alias(f"{s}_measured"),
            at("value", s).alias(f"{s}_value"),
        ]
    return sections.groupBy("series_key").agg(*aggs)


def _reasons(t: Thresholds) -> Column:
    lines = {"psi": (t.psi_warn, t.psi_alert), "mae_degradation": (t.mae_degradation_warn, t.mae_degradation_alert)}
    out = []
    for place, s in enumerate(SECTIONS):
        metric = "mae_degradation" if s == "performance" else "psi"
        warn, alert = lines[metric]
        sev = F.col(f"{s}_severity")
        out.append(
            F.struct(
                (-rank(sev)).alias("order"),
                F.lit(place).alias("place"),
                F.lit(s).alias("section"),
                sev.alias("severity"),
                F.lit(metric).alias("metric"),
                F.col(f"{s}_value").cast("double").alias("value"),
                F.when(sev == "alert", F.lit(alert)).otherwise(F.lit(warn)).alias("threshold"),
            )
        )
    # Worst first, then in the order of the sections.
    held = F.array_sort(F.filter(F.array(*out), lambda r: r["severity"] != "ok"))
    return F.transform(held, lambda r: r.dropFields("order", "place"))


def evaluate(sections: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """should_retrain, action, severity, rule, signals and reasons for every series; the first rule that holds decides."""
    v = pivot_sections(sections)
    sev = {s: F.col(f"{s}_severity") for s in SECTIONS}
    alerts = sum(((sev[s] == "alert").cast("int") for s in DISTRIBUTIONS), F.lit(0))
    overall = F.greatest(*[rank(sev[s]) for s in SECTIONS])
    clean = F.col("performance_measured") & (sev["performance"] == "ok")
    rule = (
        F.when(sev["performance"] == "alert", "R1_performance_alert")
        .when((alerts > 0) & (sev["performance"] == "warn"), "R2_distribution_alert_with_performance_warning")
        .when((alerts >= 2) & ~clean, "R3_multiple_distribution_alerts")
        .when(alerts >= 2, "R3b_distribution_without_measured_harm")
        .when(overall > 0, "R4_watch")
        .otherwise("R5_none")
    )
    out = v.withColumns({"rule": rule, "severity": severity_of(overall), "signals": F.struct(*[sev[s].alias(s) for s in SECTIONS]), "reasons": _reasons(t)})
    action = F.when(F.col("rule").rlike("^R[123]_"), RETRAIN).when(F.col("rule").rlike("^R(3b|4)_"), WATCH).otherwise(NONE)
    out = out.withColumn("action", action).withColumn("should_retrain", F.col("action") == RETRAIN)
    return out.select("series_key", "should_retrain", "action", "severity", "rule", "signals", "reasons")


def champion_is_current(verdict: DataFrame, counts: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """R0: where too few current rows lie after the champion's training data, nothing can be measured and nothing is due.

    ``counts`` has (series_key, window, n); accuracy is then published on the calendar split.
    """
    current = counts.where("window = 'current'").select("series_key", F.col("n").alias("current_n"))
    out = verdict.join(current, "series_key", "left").withColumn("current_n", F.coalesce("current_n", F.lit(0)))
    few = F.col("current_n") < t.min_samples
    return out.withColumns(
        {
            "measurable": ~few,
            "rule": F.when(few, "R0_champion_is_current").otherwise(F.col("rule")),
            "action": F.when(few, NONE).otherwise(F.col("action")),
            "should_retrain": F.when(few, False).otherwise(F.col("should_retrain")),
        }
    )


def with_left_out(verdict: DataFrame, left_out: DataFrame) -> DataFrame:
    """``verdict`` and a row with the rule ``not_enough_history`` for each series_key of ``left_out``, of which nothing is due."""
    known = {"should_retrain": F.lit(False), "action": F.lit(NONE), "severity": F.lit("ok"), "rule": F.lit("not_enough_history"), "measurable": F.lit(False), "current_n": F.lit(0).cast("long")}
    return verdict.unionByName(left_out.select("series_key", *[c.alias(n) for n, c in known.items() if n in verdict.columns]), allowMissingColumns=True)


def monitoring_eligible(models: DataFrame, reference_start: str | Column = "reference_start") -> DataFrame:
    """``eligible``: the model's training data ends before the reference starts; an unknown end is not safe."""
    start = F.col(reference_start) if isinstance(reference_start, str) else reference_start
    return models.withColumn("eligible", F.coalesce(F.col("train_data_end") < start, F.lit(False)))


def drift_gate(verdict: DataFrame) -> bool:
    """True if any series is to be retrained."""
    return bool(verdict.agg(F.coalesce(F.bool_or("should_retrain"), F.lit(False))).first()[0])
