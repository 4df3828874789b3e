"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE = "name string, part int, held binary"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.

    Only where that is unset and the master is local (tests, a laptop) a temporary
    folder is made and set: executors elsewhere could not see it.
    """
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        held = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", held)
        spark.sparkContext.setCheckpointDir(held)
    return held.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    This cuts the lineage with files that every executor can read, so the loss
    of an executor never recomputes what lies before this point.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemill-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialise`` wrote, once what was made from them is written."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete(df.sparkSession, folder)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_caches: dict[str, dict] = {}


def worker_cache(name: str) -> dict:
    """The table that the tasks of ``name`` keep from one to the next in a Python worker.

    Workers are used again by other operators' tasks, which let go of what is not theirs: a
    worker holds the table of one operator at a time.
    """
    for other in [k for k in _caches if k != name]:
        _caches.pop(other).clear()
    return _caches.setdefault(name, {})


BITMAP = (1 << 20, 1 << 27)


def in_bitmap(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The ``rows`` whose ``column`` is among ``keys`` (one column), and a few more, picked before any shuffle.

    A bitmap of hashed keys has 16 bits a key within the two bounds of ``BITMAP``: past
    the larger one (16 MB) more rows pass than need be. A join has the last word.
    """
    name = keys.columns[0]
    size = min(BITMAP[1], max(BITMAP[0], 1 << (16 * keys.count()).bit_length()))
    spread = lambda c: F.pmod(F.xxhash64(c), F.lit(size))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), spread(name).bitwiseAND(F.lit(63).cast("long")).cast("int"))
    words = keys.groupBy(F.shiftright(spread(name), 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()  # size / 64 rows at most
    table = np.zeros(size // 64, np.int64)
    table[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    shared = rows.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def held(at: pd.Series) -> pd.Series:
        x = at.to_numpy(np.int64)
        return pd.Series((shared.value.view(np.uint64)[x >> 6] >> (x & 63).astype(np.uint64)) & np.uint64(1) == 1)

    return rows.where(held(spread(column)))


def in_parts(name: str, table: np.ndarray, parts: int = 16) -> pd.DataFrame:
    """A table of counters (int64) as ``parts`` packed rows of TABLE."""
    cut = [(i, zstandard.compress(x.astype(np.int64).tobytes(), 1)) for i, x in enumerate(np.array_split(table, parts))]
    return pd.DataFrame({"name": name, "part": [i for i, _ in cut], "held": [x for _, x in cut]})


def added_up(tables: DataFrame) -> dict[str, np.ndarray]:
    """The sums of the tables of each name, on the driver: one table a name, whatever the number of tasks.

    Rows of one part are added as they stream in, so a task holds one array for each
    part it is dealt, however many tasks have counted.
    """

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for batch in batches:
            for name, part, held in zip(batch["name"], batch["part"], batch["held"]):
                x = np.frombuffer(zstandard.decompress(held), np.int64)
                total[name, part] = total[name, part] + x if (name, part) in total else x
        if total:
            rows = [(n, i, zstandard.compress(x.tobytes(), 1)) for (n, i), x in total.items()]
            yield pd.DataFrame(rows, columns=["name", "part", "held"])

    out: dict = {}
    for r in sorted(tables.repartition("name", "part").mapInPandas(add, TABLE).collect(), key=lambda r: (r["name"], r["part"])):
        out.setdefault(r["name"], []).append(np.frombuffer(zstandard.decompress(r["held"]), np.int64))
    return {n: np.concatenate(x) for n, x in out.items()}


def connected_components(vertices: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): smallest id reachable over the undirected ``edges`` (a, b).

    Only vertices that touch an edge take part in the rounds. A round gives each
    vertex the smallest label among its own and its neighbours', then jumps to
    the label's own label, so paths halve. ``vertices`` has a column ``id``.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = materialise(both, "edges")
    labels = materialise(
        both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("component")),
        "labels",
    )
    for _ in range(max_rounds):
        near = (
            both.join(labels.withColumnRenamed("id", "b"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("component").alias("near"))
        )
        stepped = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = stepped.select(F.col("id").alias("component"), F.col("component").alias("jumped"))
        new = materialise(
            stepped.join(jump, "component", "left").select("id", "old", F.least("component", F.coalesce("jumped", "component")).alias("component")),
            "labels",
        )
        release(labels)
        moved = new.where("old <> component").limit(1).count()
        labels = new.select("id", "component")
        if not moved:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    release(both)
    return vertices.select("id").join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
