"""Keyed parquet tables, partitioned by year and month: read, upsert, delta windows, publishing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..specs import TableSpec


def keep_newest(df: DataFrame, keys: list[str] | tuple[str, ...], order: list[str]) -> DataFrame:
    """One row per key: the last in ``order``.

    A window, not ``dropDuplicates``, which knows no order; hot keys are no risk,
    for rows of one key number only the times it was sent.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def _stored(spark: SparkSession, spec: TableSpec) -> DataFrame | None:
    try:
        return spark.read.parquet(spec.path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_dataset(spark: SparkSession, spec: TableSpec, schema: T.StructType, columns: list[str] | None = None) -> DataFrame:
    """The table (or an empty one), sorted by key; only ``columns`` are read."""
    df = _stored(spark, spec)
    df = spark.createDataFrame([], schema) if df is None else df
    return df.orderBy(*spec.keys).select(*(columns or schema.names))


def _parts(df: DataFrame, time_col: str) -> DataFrame:
    t = F.col(time_col)
    return df.withColumns({"year": F.year(t), "month": F.month(t)})


def merged(old: DataFrame, new: DataFrame, spec: TableSpec, order: list[str]) -> DataFrame:
    """Old rows and new ones, incoming winning on equal keys; only months that ``new`` touches."""
    new = _parts(keep_newest(new, spec.keys, order), spec.time_col)
    old = _parts(old, spec.time_col)
    touched = new.select("year", "month").distinct()
    both = old.join(touched, ["year", "month"], "left_semi").withColumn("__from", F.lit(0)).unionByName(new.withColumn("__from", F.lit(1)), allowMissingColumns=True)
    return keep_newest(both, spec.keys, ["__from"]).drop("__from")


def write_report(old: DataFrame, new: DataFrame, spec: TableSpec, order: list[str], total: int | None = None) -> DataFrame:
    """One row: rows_received (once deduplicated), rows_added, rows_updated (known keys, changed or not), rows_total, partitions_touched.

    Where the time is part of the key only the months that ``new`` touches are met with it.
    ``total`` is how many rows ``old`` has, if that is known from elsewhere.
    """
    fresh = _parts(keep_newest(new, spec.keys, order), spec.time_col)
    keys = list(spec.keys)
    known = _parts(old, spec.time_col)
    if spec.time_col in keys:
        known = known.join(fresh.select("year", "month").distinct(), ["year", "month"], "left_semi")
    known = known.select(*keys).distinct().withColumn("__known", F.lit(1))
    counted = fresh.join(known, keys, "left").agg(
        F.count("*").alias("rows_received"),
        F.count_if(F.col("__known").isNull()).alias("rows_added"),
        F.count("__known").alias("rows_updated"),
        F.count_distinct("year", "month").alias("partitions_touched"),
    )
    if total is None:
        # Both sides of this product are one row.
        counted = counted.join(F.broadcast(old.agg(F.count("*").alias("__old"))), F.lit(True))
    else:
        counted = counted.withColumn("__old", F.lit(total).cast("long"))
    return counted.select("rows_received", "rows_added", "rows_updated", (F.col("__old") + F.col("rows_added")).alias("rows_total"), "partitions_touched")


def _months(df: DataFrame) -> list[int]:
    """The months that a batch touches, as yyyymm: a short list, whatever the rows."""
    return sorted(r[0] for r in df.select(F.col("year") * 100 + F.col("month")).distinct().collect())


def changed(old: DataFrame, fresh: DataFrame, spec: TableSpec, ignore: tuple[str, ...]) -> DataFrame:
    """The rows of ``fresh`` that are new or differ from ``old`` in any column but those of ``ignore`` (when they came)."""
    keys = list(spec.keys)
    told = [c for c in fresh.columns if c not in {*keys, *ignore, "year", "month"}]
    digest = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in told]) if told else F.lit(0).cast("long")
    known = old.select(*keys, (digest if set(told) <= set(old.columns) else F.lit(None).cast("long")).alias("__old"), F.lit(1).alias("__known"))
    both = fresh.withColumn("__new", digest).join(known, keys, "left")
    return both.where("__known is null or not (__old <=> __new)").select(*fresh.columns)


def upsert(spark: SparkSession, new: DataFrame, spec: TableSpec, order: list[str], unchanged: tuple[str, ...] | None = None) -> dict:
    """Merge ``new`` into the table, rewriting only the months it touches; returns the report.

    Only these months are read, by a filter that prunes partitions (all, where the time is not
    part of the key), and the total comes from file footers. With ``unchanged`` (columns that
    only tell when a row came) rows that say what the table says already are left out before
    anything is written: a replayed or unrevised row rewrites no month. The report then has
    ``partitions_rewritten`` too. The table itself is the state that rows are compared with,
    so this holds across restarts and needs no bound on how late a revision may be.
    """
    fresh = _parts(keep_newest(new, spec.keys, order), spec.time_col).persist()
    try:
        stored = _stored(spark, spec)
        months = _months(fresh)
        if stored is None:
            old = _parts(new.limit(0), spec.time_col)
        elif spec.time_col in spec.keys:
            old = stored.where((F.col("year") * 100 + F.col("month")).isin(months or [0]))
        else:
            old = stored
        report = write_report(old.drop("year", "month"), fresh.drop("year", "month"), spec, order, count_rows(spark, spec)).first().asDict()
        if unchanged is not None:
            fresh_rows = changed(old, fresh, spec, unchanged)
            rewritten = _months(fresh_rows)
            report["partitions_rewritten"] = len(rewritten)
            old = old.where((F.col("year") * 100 + F.col("month")).isin(rewritten or [0]))
        else:
            fresh_rows, rewritten = fresh, months
        if rewritten:
            out = merged(old.drop("year", "month"), fresh_rows.drop("year", "month"), spec, order).repartition("year", "month").sortWithinPartitions(*spec.keys)
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month").parquet(spec.path)
    finally:
        fresh.unpersist()
    return report


@contextmanager
def footers(spark: SparkSession) -> Iterator[None]:
    """Parquet is read by the source that answers counts from file footers while this lasts."""
    asked = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}
    before = {k: spark.conf.get(k) for k in asked}
    try:
        for k, v in asked.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def month_counts(spark: SparkSession, spec: TableSpec) -> DataFrame:
    """(year, month, n) of a stored table; run it within ``footers`` and no data page is read."""
    return spark.read.parquet(spec.path).groupBy("year", "month").agg(F.count("*").alias("n"))


def count_rows(spark: SparkSession, spec: TableSpec) -> int:
    """How many rows the table has, from its files' footers."""
    with footers(spark):
        df = _stored(spark, spec)
        return 0 if df is None else df.agg(F.count("*")).first()[0]


def stored_last_timestamp(spark: SparkSession, spec: TableSpec, key: str, keys: DataFrame | None = None) -> DataFrame:
    """``last_timestamp`` of a stored table: the newest month comes from the footers and only its files are read."""
    with footers(spark):
        newest = month_counts(spark, spec).agg(F.max(F.struct("year", "month")).alias("m")).first()["m"]
    df = spark.read.parquet(spec.path)
    recent = df.where((F.col("year") == newest["year"]) & (F.col("month") == newest["month"])).groupBy(key).agg(F.max(spec.time_col).alias("last_ts"))
    names = df.select(key).distinct() if keys is None else keys.select(key)
    return names.join(recent, key, "left")


def last_timestamp(df: DataFrame, key: str, time_col: str, keys: DataFrame | None = None) -> DataFrame:
    """(key, last_ts): newest time in the newest month of the whole table; NULL for keys absent there.

    The newest month is a one-row result, taken first, so partitions are pruned.
    """
    months = df if {"year", "month"} <= set(df.columns) else _parts(df, time_col)
    newest = months.agg(F.max(F.col("year") * 100 + F.col("month"))).first()[0]
    recent = months.where(F.col("year") * 100 + F.col("month") == F.lit(newest)).groupBy(key).agg(F.max(time_col).alias("last_ts"))
    names = df.select(key).distinct() if keys is None else keys.select(key)
    return names.join(recent, key, "left")


def delta_window(last: DataFrame, now: Column, backfill_days: int = 730, lookback_days: int = 3) -> DataFrame:
    """``start_ts`` and ``end_ts`` to ask for, by key: a full backfill where nothing is known."""
    start = F.when(F.col("last_ts").isNull(), now - F.expr(f"INTERVAL {backfill_days} DAYS")).otherwise(F.col("last_ts") - F.expr(f"INTERVAL {lookback_days} DAYS"))
    return last.withColumns({"start_ts": start, "end_ts": now})


def stitch_sources(recent: DataFrame, archive: DataFrame, keys: list[str], start: Column | None = None, time_col: str = "timestamp_utc") -> DataFrame:
    """Both legs of a source; the archive wins where they overlap."""
    both = recent.withColumn("__leg", F.lit(0)).unionByName(archive.withColumn("__leg", F.lit(1)), allowMissingColumns=True)
    both = both if start is None else both.where(F.col(time_col) >= start)
    return keep_newest(both, keys, ["__leg"]).drop("__leg")


def stitch_forecast_sources(current: DataFrame, archived: DataFrame, now: Column, keys: list[str], time_col: str = "timestamp_utc") -> DataFrame:
    """The current run for the future only; the archived day-before run wins."""
    return stitch_sources(current.where(F.col(time_col) > now), archived, keys, time_col=time_col)


def union_sites(sites: list[DataFrame]) -> DataFrame:
    """All sites' rows for one write."""
    out = sites[0]
    for df in sites[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def published(df: DataFrame, is_real: bool, warning: str | None, generated_at: Column | None = None) -> DataFrame:
    return df.withColumns({"generated_at_utc": F.current_timestamp() if generated_at is None else generated_at, "is_real": F.lit(is_real), "warning": F.lit(warning).cast("string")})


def publish(df: DataFrame, path: str, is_real: bool, warning: str | None = None, fmt: str = "parquet") -> None:
    published(df, is_real, warning).write.mode("overwrite").format(fmt).save(path)


def timed_step(name: str, run: Callable[[], object], may_degrade: bool = False) -> tuple[object, tuple]:
    """(result, run-log row); a step that may degrade records its error, any other one's is raised with the row attached."""
    began = datetime.now()
    took = lambda: (datetime.now() - began).total_seconds()
    try:
        out = run()
    except Exception as e:
        row = (name, "degraded" if may_degrade else "failed", took(), str(e)[:500])
        if may_degrade:
            return None, row
        e.run_log_row = row
        raise
    return out, (name, "skipped" if out is None else "ok", took(), "")


def write_run_log(spark: SparkSession, rows: list[tuple], path: str) -> None:
    spark.createDataFrame(rows, "step string, status string, seconds double, detail string").write.mode("append").parquet(path)
