"""Resharding by minimum-cost flow: the fewest bytes that make shard sizes near equal.

Rows fall into blocks by hash; a block is what moves. From the bytes of the old
shards and the new capacities a transport problem is solved: supply is what an
old shard holds above its capacity, demand what a new shard lacks, a byte costs
one to move and nothing to stay. Its arcs (from, to, bytes) are the plan: whole
blocks, largest first, are sent along each arc while they fit it, and what whole
blocks can't express is levelled block by block. A block larger than an equal
share (one very long text) fixes its shard's capacity, and the others share the
rest equally. Only shards that give or receive blocks are rewritten.

Block sizes are the only thing that reaches the driver: at most ``MAX_BLOCKS``
rows. The old shard of a row is an input (``reshard``'s ``old``), and blocks come from
the old shard and the hash of the row's columns, so a table gives the same result
however it is partitioned. Defined results. A null text has no bytes (size 8). Rows
alike in everything are counted and spread by their count, so they lie in many blocks
and none takes another's place; equal texts are not kept together. An empty table
gives no rows, very long texts count with all their bytes, ties between blocks go to
the smaller number. Columns of other names only enter the hash; ``shard`` and ``slot``
are taken for the old layout and replaced by ``rewrite``.
"""

from __future__ import annotations

import bisect
import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import delete, materialise

OVERHEAD, OLD, NEW = 8, 16, 24
MIN_BLOCKS, MAX_BLOCKS, BLOCK_ROWS = 4096, 65536, 2000
COPIES, PART_ROWS = 10_000, 100_000
LAYOUT = ("shard", "slot")


def flow(held: list[int], capacity: list[int]) -> list[tuple[int, int, int]]:
    """(from, to, bytes): the transport of least cost where staying is free and any move costs its bytes.

    Successive shortest paths need no more than one pass here: every path from a
    surplus to a lack has the same cost, so any saturating flow is optimal.
    """
    over = [[i, h - c] for i, (h, c) in enumerate(zip(held, capacity)) if h > c]
    under = [[i, c - h] for i, (h, c) in enumerate(zip(held, capacity)) if h < c]
    moves, k = [], 0
    for i, more in over:
        while more and k < len(under):
            step = min(more, under[k][1])
            moves.append((i, under[k][0], step))
            more -= step
            under[k][1] -= step
            k += under[k][1] == 0
    return moves


def capacities(blocks: list[tuple[int, int, int]], shards: int) -> tuple[list[int], dict[int, int]]:
    """(bytes for each new shard, {block: shard} of the blocks that fill one alone)."""
    rest, free = sum(b for _, _, b in blocks), list(range(shards))
    alone: dict[int, int] = {}
    size: dict[int, int] = {}
    for k, s, b in sorted(blocks, key=lambda x: (-x[2], x[0])):
        if len(free) < 2 or b * len(free) <= rest:
            break
        at = s if s in free else free[-1]
        free.remove(at)
        alone[k], size[at] = at, b
        rest -= b
    # What doesn't divide goes to those that hold most already.
    held = [0] * shards
    for k, s, b in blocks:
        if k not in alone and s < shards:
            held[s] += b
    for i, at in enumerate(sorted(free, key=lambda i: (-held[i], i))):
        size[at] = rest // len(free) + (i < rest % len(free))
    return [size[i] for i in range(shards)], alone


def transfers(blocks: list[tuple[int, int, int]], shards: int) -> dict[int, int]:
    """block -> new shard, from (block, old shard, bytes)."""
    capacity, alone = capacities(blocks, shards)
    old = max(shards, max((s for _, s, _ in blocks), default=0) + 1)
    goal = capacity + [0] * (old - shards)
    held = [0] * old
    owner, of = {}, [[] for _ in range(old)]
    for k, s, b in sorted(blocks, key=lambda x: (-x[2], x[0])):
        owner[k] = alone.get(k, s)
        held[owner[k]] += b
        if k not in alone:
            of[s].append((k, b))
    arcs: dict[int, list[list[int]]] = {}
    for i, j, step in flow(held, goal):
        arcs.setdefault(i, []).append([step, j])

    def move(k: int, b: int, to: int) -> None:
        held[owner[k]] -= b
        held[to] += b
        owner[k] = to

    for i, out in arcs.items():
        stay = []
        for k, b in of[i]:
            arc = max(out)
            if b and b <= arc[0]:
                arc[0] -= b
                move(k, b, arc[1])
            else:
                stay.append((k, b))
        of[i] = stay
    size = {k: b for k, _, b in blocks}
    # A shard that closes gives what its arcs could not carry to whoever lacks most.
    lack = [(held[i] - goal[i], i) for i in range(shards)]
    heapq.heapify(lack)
    for i in range(shards, old):
        for k, b in of[i]:
            short, to = heapq.heappop(lack)
            move(k, b, to)
            heapq.heappush(lack, (short + b, to))
    # Level what is left: the largest block that narrows the gap between the fullest and the emptiest shard.
    inside: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for k, to in owner.items():
        if k not in alone:
            inside[to].append((size[k], k))
    for x in inside:
        x.sort()
    for _ in range(4 * len(owner)):
        over = [held[i] - goal[i] for i in range(shards)]
        a, z = max(range(shards), key=over.__getitem__), min(range(shards), key=over.__getitem__)
        at = bisect.bisect_left(inside[a], (over[a] - over[z], -1)) - 1
        if at < 0 or not inside[a][at][0]:
            break
        b, k = inside[a].pop(at)
        move(k, b, z)
        bisect.insort(inside[z], (b, k))
    return owner


def _facts(docs: DataFrame) -> dict:
    """What is known of a row: its size, its text's checksum, and the hash of all its columns but ``LAYOUT``."""
    text = F.coalesce("text", F.lit(""))
    # Maps and variants have no hash of their own.
    plain = lambda c, kind: F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kind or "variant" in kind else F.col(f"`{c}`")
    told = [plain(c, kind) for c, kind in sorted(docs.dtypes) if c not in LAYOUT]
    return {"size": (F.octet_length(text) + OVERHEAD).cast("long"), "crc": F.crc32(text), "key": F.xxhash64(*told)}


def by_id(shards: int = OLD) -> Column:
    """An old layout that the id alone decides."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")


def reshard(docs: DataFrame, old: Column, new: int = NEW) -> DataFrame:
    """doc_id, size, text_crc32, old_shard, shard, slot, key (hash of all columns); texts are read once and never shuffled.

    ``old`` tells the shard that a row lies in now: the ``shard`` column of a folder that was read, or ``by_id``.
    """
    spark = docs.sparkSession
    facts = _facts(docs)
    rows = docs.select("doc_id", facts["size"].alias("size"), facts["crc"].alias("text_crc32"), facts["key"].alias("key"), old.cast("int").alias("old_shard"))
    rows = materialise(rows.groupBy(*rows.columns).agg(F.count("*").alias("copies")), "sizes")
    known = rows.agg(F.sum("copies").alias("n"), F.max("old_shard").alias("last")).first()
    if not known["n"]:
        return rows.select("doc_id", "size", "text_crc32", "old_shard", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), "key")
    shards = known["last"] + 1
    per = max(1, min(MAX_BLOCKS, max(MIN_BLOCKS, known["n"] // BLOCK_ROWS)) // shards)
    # Rows alike in everything are numbered by their count, some thousands at a time, so no task writes them all.
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))).alias("from")
    parts = rows.select("*", part)
    parts = parts.where(F.col("copies") <= COPIES).unionByName(parts.where(F.col("copies") > COPIES).repartition("key", "from"))
    each = parts.select("*", F.explode(F.sequence("from", F.least(F.col("copies"), F.col("from") + COPIES) - 1)).alias("copy")).drop("from", "copies")
    rows = each.withColumn("block", F.col("old_shard") * per + F.pmod(F.xxhash64("key", "doc_id", "copy"), F.lit(per)).cast("int"))
    sizes = rows.groupBy("block").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).orderBy("block").collect()
    owner = transfers([(r["block"], r["block"] // per, r["bytes"]) for r in sizes], new)
    start, at = [], [0] * new
    for r in sizes:
        start.append((r["block"], owner[r["block"]], at[owner[r["block"]]]))
        at[owner[r["block"]]] += r["n"]
    table = F.broadcast(spark.createDataFrame(start, "block int, shard int, before long"))
    # A block is numbered in parts, so that its rows fit a task however many there are.
    salts = -(-max(r["n"] for r in sizes) // PART_ROWS)
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("copy", "key"), F.lit(salts)).cast("int"))
    counts = rows.groupBy("block", "salt").agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("block").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("block", "salt").orderBy("key", "doc_id", "copy"))
    placed = rows.withColumn("rank", rank - 1).join(counts.select("block", "salt", ahead.alias("ahead")), ["block", "salt"]).join(table, "block")
    return placed.select("doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("before") + F.col("ahead") + F.col("rank")).cast("long").alias("slot"), "key")


def rewrite(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Write the documents of every shard that a move touches as ``shard=K`` folders; other shards' files stay.

    ``placed`` is what ``reshard`` gave for ``docs``, whose columns ``shard`` and ``slot``, if there
    are any, are replaced. Rows that are equal in every column are one document that is
    written to each of its places, so it is met once and a common row is no hot group.
    """
    touched = placed.where("old_shard <> shard").select(F.explode(F.array("old_shard", "shard")).alias("__shard")).distinct()
    same = ["__id", "__key", "__size", "__crc"]
    chosen = placed.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.col("size").alias("__size"), F.col("text_crc32").alias("__crc"), F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    chosen = chosen.join(F.broadcast(touched), "__shard", "left_semi")
    kept = [c for c in docs.columns if c not in LAYOUT]
    whole = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__doc")
    one = docs.select(F.col("doc_id").alias("__id"), *[c.alias(f"__{k}") for k, c in _facts(docs).items()], whole).groupBy(*same).agg(F.first("__doc").alias("__doc"))
    one = one.withColumnsRenamed({c: f"{c}2" for c in same})
    met = F.col("__id").eqNullSafe(F.col("__id2"))
    for c in same[1:]:
        met &= F.col(c) == F.col(f"{c}2")
    out = chosen.join(one, met).select("__doc.*", F.col("__shard").alias("shard"), F.col("__slot").alias("slot"))
    out = out.repartition("shard", F.floor(F.col("slot") / PART_ROWS)).sortWithinPartitions("shard", "slot")
    # A shard that closes has no rows to overwrite it with; its folder goes once its rows are written elsewhere.
    closed = [r[0] for r in touched.join(placed.select(F.col("shard").alias("__shard")), "__shard", "left_anti").collect()]
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    for k in closed:
        delete(docs.sparkSession, f"{path}/shard={k}")
