"""Model versions as an append-only table, with saved Spark ML models beside it."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "name string, version long, alias string, assigned_at timestamp, model_path string, is_real boolean, data_kind string, train_data_end timestamp, metrics string"


class NoChampion(LookupError):
    """No version holds the alias that was asked for."""


def _table(spark: SparkSession, path: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], SCHEMA)


def register(
    spark: SparkSession, path: str, name: str, model: PipelineModel, alias: str, metrics: dict, train_data_end: datetime | None, is_real: bool, data_kind: str, at: datetime
) -> int:
    """Append a version with its tags and save its model; the version number is returned."""
    known = _table(spark, f"{path}/versions").where(F.col("name") == name)
    version = (known.agg(F.max("version")).first()[0] or 0) + 1
    where = f"{path}/models/{name}/{version}"
    model.write().overwrite().save(where)
    row = (name, version, alias, at, where, is_real, data_kind, train_data_end, json.dumps(metrics, sort_keys=True))
    spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return version


def assign_alias(spark: SparkSession, path: str, name: str, version: int, alias: str, at: datetime) -> None:
    """Give a known version an alias from ``at`` on."""
    row = latest(_table(spark, f"{path}/versions").where((F.col("name") == name) & (F.col("version") == version)), ["name", "version"])
    out = row.withColumns({"alias": F.lit(alias), "assigned_at": F.lit(at).cast("timestamp")})
    out.coalesce(1).write.mode("append").parquet(f"{path}/versions")


def latest(versions: DataFrame, by: list[str]) -> DataFrame:
    """The newest assignment of each group: by time, then version."""
    held = [c for c in versions.columns if c not in by]
    top = versions.groupBy(*by).agg(F.max_by(F.struct(*held), F.struct("assigned_at", "version")).alias("r"))
    return top.select(*by, "r.*").select(*versions.columns)


def latest_version(versions: DataFrame) -> DataFrame:
    return versions.groupBy("name").agg(F.max("version").alias("version"))


def champion_row(spark: SparkSession, path: str, name: str, alias: str = "champion") -> dict:
    rows = latest(_table(spark, f"{path}/versions").where((F.col("name") == name) & (F.col("alias") == alias)), ["name", "alias"]).collect()
    if not rows:
        raise NoChampion(f"no version of {name} holds the alias {alias}")
    return rows[0].asDict()


def load_champion(spark: SparkSession, path: str, name: str, alias: str = "champion") -> tuple[PipelineModel, dict]:
    row = champion_row(spark, path, name, alias)
    return PipelineModel.load(row["model_path"]), row
