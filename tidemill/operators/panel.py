"""From stored rows to a gapless panel of many series.

A panel has one row per (series_key, ts); hours without a row are explicit NULLs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import calendar, clean, col, from_hours, hours
from ..sources.lake import keep_newest

FORECAST_COLUMNS = ("temperature_c", "humidity_pct", "dewpoint_c", "wind_kmh", "cloud_pct")


def load_demand(df: DataFrame, respondent: str | None = None, key: str = "respondent", time_col: str = "timestamp_utc", order: tuple[str, ...] = ("ingested_at_utc",)) -> DataFrame:
    """(series_key, ts, demand_mwh): one respondent whatever its case, or all; the last of equal times."""
    chosen = df if respondent is None else df.where(F.upper(key) == respondent.upper())
    chosen = keep_newest(chosen, [key, time_col], list(order))
    return chosen.select(F.col(key).alias("series_key"), F.col(time_col).cast("timestamp").alias("ts"), clean("demand_mwh").alias("demand_mwh"))


def load_temperature(df: DataFrame, sites: list[str] | None = None, observed_only: bool = False) -> DataFrame:
    out = df if sites is None else df.where(F.col("site").isin(sites))
    return out.where("is_observed") if observed_only else out


def add_calendar(df: DataFrame, ts: str = "ts") -> DataFrame:
    return calendar(df, ts)


def hour_grid(df: DataFrame, key: str = "series_key", ts: str = "ts", step: int = 1, extend: int = 0) -> DataFrame:
    """(key, ts) at every ``step`` hours from a series' first to its last time, and ``extend`` hours on."""
    ends = df.groupBy(key).agg(F.min(hours(ts)).alias("lo"), F.max(hours(ts)).alias("hi"))
    grid = ends.select(key, F.explode(F.sequence("lo", F.col("hi") + extend, F.lit(step).cast("long"))).alias("h"))
    return grid.select(key, from_hours("h").alias(ts))


def slice_window(df: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    """Days from ``start`` to ``end``, both whole."""
    return df.where((F.col(ts) >= F.to_timestamp(F.lit(start))) & (F.col(ts) < F.to_timestamp(F.lit(end)) + F.expr("INTERVAL 1 DAY")))


def blend_by_site(df: DataFrame, weights: DataFrame, columns: list[str], by: list[str], site: str = "site", order: list[str] | None = None) -> DataFrame:
    """Weighted means over sites, the weights renormalised over the sites that report each column.

    Sites without a weight add nothing; a value that no weighted site reports is
    NULL. All columns are blended in one aggregation. ``weights`` (site, weight)
    is a dimension with a row per site; Spark broadcasts it below its size limit
    and shuffles it above.
    """
    rows = df if order is None else keep_newest(df, [*by, site], order)
    joined = rows.join(weights.select(F.col(site), F.col("weight").cast("double")), site, "left").where("weight is not null")

    def blend(c: str) -> Column:
        x = clean(c)
        held = F.when(x.isNotNull(), F.col("weight"))
        total = F.sum(held)
        return (F.sum(x * held) / F.when(total != 0, total)).alias(c)

    return joined.groupBy(*by).agg(*[blend(c) for c in columns])


def site_spread(df: DataFrame, column: str, by: list[str], alias: str = "spread") -> DataFrame:
    """Largest less smallest value over sites; sites without a weight count too."""
    return df.groupBy(*by).agg((F.max(clean(column)) - F.min(clean(column))).alias(alias))


def load_temperature_blend(df: DataFrame, weights: DataFrame, by: list[str], sites: list[str] | None = None) -> DataFrame:
    return blend_by_site(load_temperature(df, sites), weights, ["temperature_c"], by)


def load_weather_forecast(df: DataFrame, weights: DataFrame, by: list[str]) -> DataFrame:
    """Five blended columns as ``fcst_*`` and the spread of temperature over sites."""
    blended = blend_by_site(df, weights, list(FORECAST_COLUMNS), by)
    blended = blended.select(*by, *[F.col(c).alias(f"fcst_{c}") for c in FORECAST_COLUMNS])
    return blended.join(site_spread(df, "temperature_c", by, "fcst_temperature_spread_c"), by, "left")


def build_panel(demand: DataFrame, temperature: DataFrame | None = None, forecast: DataFrame | None = None, step: int = 1) -> DataFrame:
    """Demand on its gapless grid, left-joined to weather, which never extends it, with the calendar.

    Sources that are absent give NULL columns, so the schema is always the same.
    All joins share the key (series_key, ts).
    """
    keys = ["series_key", "ts"]
    out = hour_grid(demand, step=step).join(demand.select(*keys, "demand_mwh"), keys, "left")
    names = ["temperature_c"]
    fcst = [f"fcst_{c}" for c in FORECAST_COLUMNS] + ["fcst_temperature_spread_c"]
    for source, columns in ((temperature, names), (forecast, fcst)):
        if source is None:
            out = out.withColumns({c: F.lit(None).cast("double") for c in columns})
        else:
            out = out.join(source.select(*keys, *[c for c in columns if c in source.columns]), keys, "left")
            out = out.withColumns({c: F.lit(None).cast("double") for c in columns if c not in source.columns})
    return add_calendar(out)


def resolve_panel(demand: DataFrame, temperature: DataFrame | None = None, forecast: DataFrame | None = None, step: int = 1) -> DataFrame:
    """``build_panel``, or an error where there is no demand."""
    if demand.isEmpty():
        raise ValueError("the demand table holds no rows: ingest it before building a panel")
    return build_panel(demand, temperature, forecast, step)


def describe_panel(panel: DataFrame) -> DataFrame:
    return panel.agg(
        F.count("*").alias("rows"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.count_if(F.col("demand_mwh").isNull()).alias("missing_demand"),
        (F.count("temperature_c") > 0).alias("has_temperature"),
        (F.count("fcst_temperature_c") > 0).alias("has_forecast"),
    )


def inject_shift(panel: DataFrame, start: str | Column | None = None, last_days: int | None = None, scale: float = 1.0, offset: float = 0.0, temperature_offset: float = 0.0) -> DataFrame:
    """A what-if: demand is scaled and moved, temperature moved, from ``start`` or in the last days of each series.

    ``injected`` marks changed rows. ``shift_spec`` tells what was done.
    """
    if start is not None:
        begin = F.to_timestamp(F.lit(start)) if isinstance(start, str) else start
        out = panel.withColumn("__start", begin)
    else:
        ends = panel.groupBy("series_key").agg((F.max("ts") - F.expr(f"INTERVAL {last_days} DAYS")).alias("__start"))
        out = panel.join(ends, "series_key")
    on = F.col("ts") >= F.col("__start")
    return out.withColumns(
        {
            "demand_mwh": F.when(on, F.col("demand_mwh") * scale + offset).otherwise(F.col("demand_mwh")),
            "temperature_c": F.when(on, F.col("temperature_c") + temperature_offset).otherwise(F.col("temperature_c")),
            "injected": on,
        }
    ).drop("__start")


def shift_spec(shifted: DataFrame, scale: float, offset: float, temperature_offset: float) -> DataFrame:
    """One row: the parameters, when the shift begins and how many rows it changed."""
    return shifted.where("injected").agg(F.min("ts").alias("start_ts"), F.count("*").alias("rows_changed")).withColumns(
        {"scale": F.lit(scale), "offset": F.lit(offset), "temperature_offset": F.lit(temperature_offset)}
    )


def thin_by_modulus(df: DataFrame, every: int, column: str = "horizon_h") -> DataFrame:
    return df.where(F.col(column) % every == 0)


def drop_columns(df: DataFrame, names: list[str]) -> tuple[DataFrame, bool]:
    """The frame without those of ``names`` it has, and whether it had any (else an ablation isn't measured)."""
    held = [c for c in names if c in df.columns]
    return df.drop(*held), bool(held)


def provenance(runs: DataFrame, panel_is_real: str | Column = "panel_is_real", champion_is_real: str | Column = "champion_is_real") -> DataFrame:
    """``is_real``: the panel is real, and so is what the champion was trained on, if there is one."""
    return runs.withColumn("is_real", F.coalesce(col(panel_is_real), F.lit(False)) & F.coalesce(col(champion_is_real), F.lit(True)))
