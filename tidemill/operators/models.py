"""Gradient-boosted forecasts with Spark ML: fit, walk forward, ablate, score, forecast."""

from __future__ import annotations

from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler, VectorIndexer
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.core import from_hours, hours
from ..specs import SeriesSpec
from . import trees
from .backtest import Forecaster, backtest_metrics, compare, make_cutoffs, walk_forward
from .design import build_design_matrix, labelled, requested, training_slice

def _fills(rows: DataFrame, features: tuple[str, ...]) -> tuple[list[str], str]:
    """(input columns, the SQL that makes them): a feature with missing values enters twice, these once below and once above all others.

    A tree that splits either copy sends the missing values to the side that fits them, and
    splits between values stand where they would without any missing. The fills lie one
    beyond the training rows' least and greatest value, so they cost one candidate split.
    """
    span = [x for c in features for x in (F.min(F.col(c).cast("double")), F.max(F.col(c).cast("double")), F.count_if(F.col(c).isNull()))]
    found = iter(rows.agg(*[x.alias(f"a{i}") for i, x in enumerate(span)]).first())
    names, made = [], []
    for c in features:
        low, high, missing = next(found), next(found), next(found)
        sides = {"x": (low or 0.0) - 1} | ({"y": high + 1} if missing and high is not None else {})
        for side, fill in sides.items():
            names.append(f"__{side}_{c}")
            made.append(f"coalesce(CAST(`{c}` AS DOUBLE), CAST('{fill!r}' AS DOUBLE)) AS `__{side}_{c}`")
    return names, f"SELECT *, {', '.join(made)} FROM __THIS__"


def gbt_fit(design: DataFrame, features: tuple[str, ...], rounds: int = 30, depth: int = 5, seed: int = 42) -> PipelineModel:
    """One model over all series and horizons, on absolute loss; hour, day and month are categories, missing values have a side of their own."""
    rows = labelled(design)
    names, sql = _fills(rows, features)
    stages = [
        SQLTransformer(statement=sql),
        VectorAssembler(inputCols=names, outputCol="__raw"),
        VectorIndexer(inputCol="__raw", outputCol="__features", maxCategories=24, handleInvalid="keep"),
        GBTRegressor(
            featuresCol="__features", labelCol="y", predictionCol="prediction", lossType="absolute", maxIter=rounds, maxDepth=depth, maxBins=64,
            subsamplingRate=0.9, featureSubsetStrategy="0.9", seed=seed,
        ),
    ]
    return Pipeline(stages=stages).fit(rows)


def gbt_predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` with ``prediction``, by the trees as column expressions."""
    filled = model.stages[0].transform(rows)
    names = tuple(model.stages[1].getInputCols())
    return filled.select(*rows.columns, trees.prediction(trees.of_model(model), names).alias("prediction"))


def gbt_transform(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """The same by the pipeline's own transform."""
    return model.transform(rows).select(*rows.columns, "prediction")


def frozen(features: tuple[str, ...], **how):
    """A ``predict(train, rows)`` for ``score_windows``."""
    return lambda train, rows: gbt_predict(gbt_fit(train, features, **how), rows)


def walk_forward_gbt(design: DataFrame, spec: SeriesSpec = SeriesSpec(), features: tuple[str, ...] | None = None, refit_every: int = 1, parallelism: int = 4, **how) -> Forecaster:
    """A forecaster that refits on rows whose target lies before the cutoff.

    ``refit_every`` counts cutoffs: 1 refits at each one, 7 reuses a model for a week,
    which was then fitted on older data only. The list of cutoff times is short (one a
    day), whatever the number of series, and their fits don't depend on each other, so
    ``parallelism`` of them run at a time, as in Spark ML's own cross-validation. Fits
    before any training row predict nothing.
    """
    features = features or spec.features

    def forecast(series: DataFrame, asked: DataFrame) -> DataFrame:
        times = sorted(r[0] for r in asked.select("cutoff").distinct().collect())
        rows = requested(design, asked)
        blocks = [times[i : i + refit_every] for i in range(0, len(times), refit_every)]
        held = labelled(design)
        first = held.agg(F.min("target_ts")).first()[0]

        def fitted(block: list) -> PipelineModel | None:
            return gbt_fit(training_slice(held, F.lit(block[0])), features, **how) if first is not None and first < block[0] else None

        with ThreadPool(max(1, min(parallelism, len(blocks)))) as pool:
            found = pool.map(inheritable_thread_target(design.sparkSession)(fitted), blocks)
        out = None
        for block, model in zip(blocks, found):
            part = rows.where((F.col("cutoff") >= F.lit(block[0])) & (F.col("cutoff") <= F.lit(block[-1])))
            got = part.withColumn("prediction", F.lit(None).cast("double")) if model is None else gbt_predict(model, part)
            got = got.select(*asked.columns, "prediction")
            out = got if out is None else out.unionByName(got)
        return asked.withColumn("prediction", F.lit(None).cast("double")) if out is None else out

    return forecast


def cutoff_design(panel: DataFrame, spec: SeriesSpec = SeriesSpec(), origins: DataFrame | None = None, **how) -> DataFrame:
    """The design at training origins and at every cutoff, for ``walk_forward_gbt``; worth caching."""
    cuts = make_cutoffs(panel.where("demand_mwh is not null"), spec, **how).withColumnRenamed("cutoff", "origin_ts")
    both = cuts if origins is None else origins.unionByName(cuts).distinct()
    return build_design_matrix(panel, both, spec)


def feature_importance(model: PipelineModel, features: tuple[str, ...], top: int = 12) -> DataFrame:
    """Shares in percent (2 places), largest first; both copies of a feature with missing values count as the one."""
    shares = dict.fromkeys(features, 0.0)
    for name, x in zip(model.stages[1].getInputCols(), model.stages[-1].featureImportances.toArray()):
        shares[name.split("_", 3)[3]] += float(x) * 100
    rows = SparkSession.getActiveSession().createDataFrame(list(shares.items()), "feature string, share double")
    return rows.withColumn("share", F.round("share", 2)).orderBy(F.col("share").desc(), "feature").limit(top)


def ablation(panel: DataFrame, design: DataFrame, without: tuple[str, ...], spec: SeriesSpec = SeriesSpec(), **how) -> DataFrame:
    """The same backtest with and without some features: errors, delta, and whether they helped.

    With none of them present the row says ``not measured``.
    """
    spark = design.sparkSession
    series = panel.select("series_key", "ts", "demand_mwh")
    full = tuple(c for c in spec.features if c in design.columns)
    rest = tuple(c for c in full if c not in without)
    if rest == full:
        return spark.createDataFrame([("not measured",)], "status string")
    score = lambda cols, name: walk_forward(series, walk_forward_gbt(design, spec, cols, **how), spec, name)
    both = score(rest, "without").unionByName(score(full, "with"))
    out = compare(backtest_metrics(both), "without", "with")
    return out.withColumns({"helped": F.col("mae_delta") < 0, "status": F.lit("measured")})


def check_origins(panel: DataFrame, origins: DataFrame, spec: SeriesSpec = SeriesSpec()) -> DataFrame:
    """``origins`` floored to the hour, or an error when one lies outside [first + history, last observed + one step]."""
    held = panel.where("demand_mwh is not null").groupBy("series_key").agg((hours(F.min("ts")) + spec.min_history).alias("a"), (hours(F.max("ts")) + spec.step).alias("b"))
    asked = origins.withColumn("origin_ts", F.date_trunc("hour", "origin_ts"))
    bad = asked.join(held, "series_key", "left").where("a is null or not floor(unix_timestamp(origin_ts) / 3600) between a and b").limit(1).collect()
    if bad:
        raise ValueError(f"origin {bad[0]['origin_ts']} of series {bad[0]['series_key']} lies outside what its history allows")
    return asked


def latest_origins(panel: DataFrame, spec: SeriesSpec = SeriesSpec()) -> DataFrame:
    """One step after each series' last observed row."""
    return panel.where("demand_mwh is not null").groupBy("series_key").agg(from_hours(hours(F.max("ts")) + spec.step).alias("origin_ts"))


def forecast(panel: DataFrame, model: PipelineModel | Callable[[DataFrame], DataFrame], spec: SeriesSpec = SeriesSpec(), origins: DataFrame | None = None, max_horizon: int | None = None) -> DataFrame:
    """Predictions at given origins (the latest, by default), with the actual where it has happened.

    ``model`` is a fitted pipeline, or whatever adds ``prediction`` to design rows.
    """
    top = spec.max_horizon if max_horizon is None else max_horizon
    if not 1 <= top <= spec.max_horizon:
        raise ValueError(f"the horizon must lie from 1 to {spec.max_horizon}")
    origins = latest_origins(panel, spec) if origins is None else check_origins(panel, origins, spec)
    rows = build_design_matrix(panel, origins, spec, tuple(h for h in spec.horizons if h <= top))
    scored = model(rows) if callable(model) else gbt_predict(model, rows)
    return scored.select("series_key", "origin_ts", "horizon_h", "target_ts", "prediction", F.col("y").alias("actual"))


def forecast_history(scored: DataFrame, max_horizon: int = 24, days: int = 21) -> DataFrame:
    """One forecast per target - the largest horizon, then the earliest origin - over each series' last days."""
    w = Window.partitionBy("series_key", "target_ts").orderBy(F.col("horizon_h").desc(), "origin_ts")
    one = scored.where(F.col("horizon_h") <= max_horizon).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return recent_tail(one, days).select("series_key", "target_ts", "origin_ts", "horizon_h", F.col("y").alias("actual"), F.col("prediction").alias("forecast"), (F.col("prediction") - F.col("y")).alias("error"))


def recent_tail(df: DataFrame, days: int = 21, ts: str = "target_ts") -> DataFrame:
    ends = df.groupBy("series_key").agg((F.max(ts) - F.expr(f"INTERVAL {days} DAYS")).alias("__from"))
    return df.join(ends, "series_key").where(F.col(ts) >= F.col("__from")).drop("__from")


def chart_rows(history: DataFrame, forward: DataFrame, last: int = 400) -> DataFrame:
    """The newest rows of history and forward forecasts together, labelled ``scored`` and ``live``."""
    a = history.select("series_key", "target_ts", "forecast", "actual", F.lit("scored").alias("kind"))
    b = forward.select("series_key", "target_ts", F.col("prediction").alias("forecast"), "actual", F.lit("live").alias("kind"))
    w = Window.partitionBy("series_key").orderBy(F.col("target_ts").desc(), "kind")
    return a.unionByName(b).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= last).drop("__n")
