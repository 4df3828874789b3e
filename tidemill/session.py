"""Session defaults that the operators rely on."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession

#: times are UTC; the plan is adapted at run time, hot keys included
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}

#: Bytes a task reads, of tables and of shuffles, where the session has Spark's own (128 and 64 MB):
#: counted values lie some fourteen times as large in a hash table as in a compressed shuffle
SIZES = {
    "spark.sql.files.maxPartitionBytes": ("134217728b", "16m"),
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": ("67108864b", "16m"),
}

#: rows of a table whose values one task counts
ROWS = 500_000
#: Spark writes up to so many parts straight to files; of more, a task holds its rows in memory first
STREAMED = 200
_FIRST = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def get_session(name: str = "tidemill", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for k, v in {**DEFAULTS, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ensure_utc(spark: SparkSession) -> SparkSession:
    """Operators read and write UTC; a session in another zone is set right."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ensure_sizes(spark: SparkSession, rows: int = 0) -> SparkSession:
    """Tasks of bounded memory, however large the tables; sizes that a user has chosen stand.

    Shuffles begin with at least a part for each ``ROWS`` of ``rows``; small parts are merged again.
    """
    for k, (default, size) in SIZES.items():
        if spark.conf.get(k) == default:
            spark.conf.set(k, size)
    parts = ceil(rows / ROWS)
    if parts > int(spark.conf.get(_FIRST, None) or spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(_FIRST, str(parts))
    return spark


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """``df`` of so many rows dealt by ``by`` to tasks of about ``ROWS`` each.

    One task reads a row group of a file whole, however large; what it reads it would count, with
    every distinct value in its memory.
    """
    parts = min(ceil(rows / ROWS), STREAMED)
    return df.repartition(parts, *by) if parts > 1 else df
