"""Approximate nearest neighbours along shifted space-filling curves.

Vectors are projected to ten dimensions by several random rotations, shifted, and
ordered along a Hilbert curve each time. A curve's keys are range-partitioned into
blocks: a vector is shuffled to its block on each of the ``CURVES`` curves, a query to
its own and both neighbouring blocks, and no further. There distances are taken on the
original vectors in double precision, and each query's best of all blocks are merged.
The answer is the exact one among the rows that share or adjoin a block with the query
on any curve; nothing is left out on codes or by a count.

The index (rotations, block borders, cell size) is fitted on a bounded sample of
``SAMPLE_ROWS`` vectors; every vector is indexed. The number of blocks is fitted there
too: the largest of ``LADDER`` with which ``PROBES`` sampled vectors still meet ``RECALL``
of their ten nearest in the sample. In the whole table neighbours are nearer than in a
sample, so blocks of the same share of it hold no fewer of them. Vectors in clusters get
many small blocks and queries meet few rows; for vectors without structure no small
block holds the neighbours, blocks are wide, and work is that of a full search.

Blocks that hold more than ``GROUP_ROWS`` rows (of a common vector, say) are dealt by hash
into chunks of that size, which each query of the block visits; queries of a block beyond
``QUERY_ROWS`` are dealt into parts. So no task grows with a block.

Defined results. Vectors that are null, zero, or hold null or non-finite parts
take no part; nor do those of another width than the sample's most common one.
A null id takes no part. Equal ids count once for each distinct vector. Ties go to
the smaller id. Fewer candidates than asked for: all of them. Blocks hold some 64
sampled rows at least, so a table of fewer than 128 is one block and its search exact. An
empty table gives no rows. Other columns, whatever their names, are ignored. There are
no texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, release

CURVES, DIMS, BITS = 3, 10, 6
LADDER = (1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 96, 128, 192, 256)
SAMPLE_ROWS, GROUP_ROWS, QUERY_ROWS = 20_000, 8192, 8192
PROBES, RECALL = 400, 0.95
TAIL = 0.02  #: share of the sample at either end that doesn't count for the cell size


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (n, dims) below 2**bits, dims * bits below 64 (Skilling's transform)."""
    x = cells.T.astype(np.int64).copy()
    dims, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(dims):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), top
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def borders(keys: np.ndarray, blocks: int) -> np.ndarray:
    """Keys at which a new block begins."""
    order = np.sort(keys)
    return np.unique(order[[len(order) * i // blocks for i in range(1, blocks)]])


def neighbours(sample: np.ndarray, k: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the first ``PROBES`` distinct vectors of the sample, and of the k nearest distinct vectors to each."""
    rows = np.sort(np.unique(sample, axis=0, return_index=True)[1])
    x, probes = sample[rows], np.arange(min(PROBES, len(rows)))
    norm = (x * x).sum(1)
    d = norm[probes][:, None] + norm[None] - 2 * x[probes] @ x.T
    d[probes, probes] = np.inf
    k = min(k, len(rows) - 1)
    return rows[probes], rows[np.argsort(d, axis=1)[:, :k]]


class Index:
    """Rotations, shifts, block borders and cell size; its size doesn't depend on the input."""

    def __init__(self, sample: np.ndarray, seed: int = 7, curves: int = CURVES) -> None:
        rng = np.random.default_rng(seed)
        self.width = sample.shape[1]
        dims = min(DIMS, self.width)
        self.mean = np.median(sample, 0)
        self.turns = [np.linalg.qr(rng.normal(size=(self.width, self.width)))[0][:, :dims] for _ in range(curves)]
        # From quantiles, so that a few vectors far out don't push all others into one cell.
        lo, hi = np.quantile((sample - self.mean) @ self.turns[0], (TAIL, 1 - TAIL), axis=0)
        spread = float(np.sqrt(np.square(hi - lo).mean())) / (2 * NormalDist().inv_cdf(1 - TAIL))
        spread = max(1e-30, spread or float((sample - self.mean).std()))
        self.unit = 10 * spread / (1 << BITS)
        self.shift = rng.uniform(-0.5, 0.5, (curves, dims)) * 2 * spread
        keys = [self.keys(sample, c) for c in range(curves)]
        probes, near = neighbours(sample)
        for blocks in (n for n in LADDER[::-1] if n == 1 or n <= len(sample) // 64):
            self.borders = [borders(k, blocks) for k in keys]
            held = np.zeros(near.shape, bool)
            for k, cut in zip(keys, self.borders):
                at = np.searchsorted(cut, k, side="right")
                held |= np.abs(at[near] - at[probes][:, None]) <= 1
            if not held.size or held.mean() >= RECALL:
                break

    def keys(self, x: np.ndarray, c: int) -> np.ndarray:
        cells = np.floor(((x - self.mean) @ self.turns[c] + self.shift[c]) / self.unit) + (1 << (BITS - 1))
        return hilbert_keys(np.clip(cells, 0, (1 << BITS) - 1).astype(np.int64), BITS)

    def blocks(self, x: np.ndarray, c: int) -> np.ndarray:
        return np.searchsorted(self.borders[c], self.keys(x, c), side="right")


def _kind(vectors: DataFrame) -> str:
    return "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part."""
    # Floats stay what they are, all else becomes double.
    v = F.col("embedding") if _kind(vectors) == "<f4" else F.col("embedding").cast("array<double>")
    sound = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.where("vec_id is not null and embedding is not null").select("vec_id", v.alias("v")).where(sound)


FOUND = "query_id long, query long, vec_id long, row long, score double"


def _nearest(query: pd.DataFrame, rows: pd.DataFrame, k: int, kind: str) -> pd.DataFrame:
    """The k best of ``rows`` by exact distance for each query; ties to the smaller id."""
    names = [c.split()[0] for c in FOUND.split(", ")]
    if not len(query) or not len(rows):
        return pd.DataFrame({c: np.zeros(0, np.float64 if c == "score" else np.int64) for c in names})
    table = lambda pdf: np.frombuffer(b"".join(pdf["vec"]), kind).reshape(len(pdf), -1).astype(np.float64)
    y, x = table(rows), table(query)
    ids, own = rows["vec_id"].to_numpy(np.int64), rows["row"].to_numpy(np.int64)
    qs, asked = query["vec_id"].to_numpy(np.int64), query["row"].to_numpy(np.int64)
    found: list[tuple] = []
    with np.errstate(over="ignore", invalid="ignore"):
        norm = (y * y).sum(1)
        # What rounding may add to or take from a squared distance by the product below.
        slip = 4 * (y.shape[1] + 4) * np.finfo(np.float64).eps
        for at in range(0, len(qs), 256):
            part = x[at : at + 256]
            both = (part * part).sum(1)[:, None] + norm[None]
            d = both - 2 * part @ y.T
            for i in range(len(part)):
                near = np.flatnonzero(ids != qs[at + i])
                if len(near) > k:
                    row, err = d[i, near], slip * both[i, near]
                    # What is beyond the range of doubles (nan) stays as well.
                    near = near[~(row - err > np.partition(row + err, k - 1)[k - 1])]
                score = np.sqrt(np.square(y[near] - part[i]).sum(1))
                best = np.lexsort((ids[near], score))[:k]
                found.append((np.full(len(best), qs[at + i]), np.full(len(best), asked[at + i]), ids[near[best]], own[near[best]], score[best]))
    return pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*found)))))


def meetings(rows: DataFrame, every: int) -> tuple[DataFrame, DataFrame]:
    """Queries and candidates, each dealt to the (curve, block, chunk, part) in which they meet.

    ``rows`` holds vec_id, vec, row and its ``blocks``, one of each curve.
    """
    spark = rows.sparkSession
    asks = F.col("vec_id") % every == 0
    places = rows.select("vec_id", "vec", "row", F.posexplode("blocks").alias("curve", "block"))
    # At most CURVES times the last of LADDER counts.
    held = {(r.curve, r.block): r for r in places.groupBy("curve", "block").agg(F.count("*").alias("n"), F.count_if(asks).alias("asked")).collect()}
    deals = []
    for (curve, block), r in held.items():
        asked = sum(held[curve, b].asked for b in (block - 1, block, block + 1) if (curve, b) in held)
        if asked:
            deals.append((curve, block, -(-r.n // GROUP_ROWS), -(-asked // QUERY_ROWS)))
    deals = F.broadcast(spark.createDataFrame(deals, "curve int, block int, chunks int, parts int"))
    around = places.where(asks).withColumn("block", F.explode(F.array(*[F.col("block") + i for i in (-1, 0, 1)])))
    queries = around.join(deals, ["curve", "block"]).select(
        "vec_id", "vec", "row", "curve", "block", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
    )
    candidates = places.join(deals, ["curve", "block"]).select(
        "vec_id", "vec", "row", "curve", "block", F.pmod("row", F.col("chunks")).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    )
    # Columns of their own, for both sides come from one table.
    return queries.toDF(*queries.columns), candidates


def indexed(vectors: DataFrame) -> DataFrame | None:
    """vec_id, vec (bytes), row (a hash of both) and ``blocks`` of every vector that takes part; None if there is none."""
    spark, kind = vectors.sparkSession, _kind(vectors)
    data = materialise(usable(vectors).dropDuplicates(["vec_id", "v"]), "vectors")
    sample = data.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE_ROWS).select("v").toPandas()["v"]
    if not len(sample):
        release(data)
        return None
    width = Counter(len(v) for v in sample).most_common(1)[0][0]
    index = spark.sparkContext.broadcast(Index(np.array([v for v in sample if len(v) == width], dtype=np.float64)))

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = index.value
        for batch in batches:
            if len(batch):
                x = np.array(batch["v"].tolist(), dtype=np.float64)
                blocks = np.stack([ix.blocks(x, c) for c in range(len(ix.turns))], 1)
                yield pd.DataFrame({"vec_id": batch["vec_id"].to_numpy(), "vec": [v.astype(kind).tobytes() for v in x], "blocks": blocks.astype(np.int32).tolist()})

    rows = materialise(data.where(F.size("v") == width).mapInPandas(keyed, "vec_id long, vec binary, blocks array<int>"), "curves")
    release(data)
    return rows.withColumn("row", F.xxhash64("vec_id", "vec"))


def search(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) for queries whose vec_id is divisible by ``every``."""
    rows, kind = indexed(vectors), _kind(vectors)
    if rows is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries, candidates = meetings(rows, every)
    spot = ["curve", "block", "chunk", "part"]
    found = queries.groupBy(*spot).cogroup(candidates.groupBy(*spot)).applyInPandas(lambda q, r: _nearest(q, r, k, kind), FOUND)
    # A row found on several curves counts once.
    found = found.groupBy("query_id", "query", "vec_id", "row").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
