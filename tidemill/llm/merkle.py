"""A Merkle manifest of a dataset: leaves, the root of each source, the root of all, and a proof for every row.

A leaf is the SHA-256 of a row's fields. Leaves of a source stand in order of their
ids; three neighbours are one parent's children, and so on until one node is left.
The sources' roots make the upper tree in the same way.

Slot pivot: conditional aggregates spread a parent's children into ``FANOUT`` columns.
The columns in a row, concatenated, hash to the parent; all but the own slot's are
a child's siblings. ``BAND`` levels share one exchange, for what lies below one
node ``BAND`` levels up (81 leaves at most) is dealt to one task as a group:

1. up: each band hashes its groups to one node, so the next band is 81 times smaller;
2. down: from the smallest band on, each group's members get their siblings within
   the group (the same aggregates as windows over a parent's children), then those
   that the group's node got one band above.

So rows are shuffled by (source, group) twice and no level is joined to all leaves.
Places in a source come from one range exchange on (source, id): a source that holds
a third of all rows spans many partitions, and each partition's rows are counted
from its own first row on plus what the partitions before it hold.

Defined results. Rows of one id in one source go in order of their leaves; rows
alike in every field have equal leaves and any order gives the same digests. Null
ids stand first and are never tampered with. A null source is a source of its own and the first
one; an empty name is another. A null field hashes as ``-``, an empty text as ``0:``.
A source of one row has its leaf for a subroot, a table of one source its subroot
for a root; with no siblings at all the proof is the hash of nothing. Very long
texts are hashed whole. An empty table gives no rows. Other columns take no part,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, release

FANOUT, BAND = 3, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_GROUP = FANOUT**BAND


def hashed(*parts: Column) -> Column:
    """H: lowercase hexadecimal SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(c: Column) -> Column:
    """How a field enters a leaf: ``-`` for null, else its length in bytes, a colon and its value."""
    value = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """doc_id, grp (the source, ordered, never null), leaf, and the leaf of the row whose text is ``tampered``."""
    own = [field(F.col(c)) for c in FIELDS]
    grp = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    return docs.select("doc_id", grp.alias("grp"), hashed(*own).alias("h"), hashed(*own[:-1], field(tampered)).alias("changed"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with pos (from 0) and n (how many there are) in each ``grp``, in the order of ``order``.

    Equal keys are told apart by their row, so no key is too common to be split.
    """
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")
    keys = ["grp", *order, "row"]
    # The number of a row is its partition's in the upper bits and its place there in the lower 33.
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    dealt = materialise(dealt.drop("row").withColumn("part", F.shiftright("at", 33)), "ordered")
    release(rows)
    # As many rows as groups plus partitions.
    runs = dealt.groupBy("grp", "part").agg(F.count("*").alias("k"), F.min("at").alias("first"))
    whole = Window.partitionBy("grp")
    runs = runs.withColumns({"n": F.sum("k").over(whole), "end": F.sum("k").over(whole.orderBy("part"))})
    runs = runs.select("grp", "part", "n", (F.col("first") - F.col("end") + F.col("k")).alias("shift"))
    out = materialise(dealt.join(runs, ["grp", "part"]).withColumn("pos", F.col("at") - F.col("shift")).drop("at", "part", "shift"), "numbered")
    release(dealt)
    return out


def _at(level: int) -> Column:
    """The place in its level of the node that a row lies below."""
    return F.floor(F.col("pos") / FANOUT**level) if level else F.col("pos")


def _several(level: int) -> Column:
    """Whether the group has more than one node ``level`` levels up, so that these are hashed once more."""
    return F.col("n") > FANOUT**level


def _slots(level: int, node: str) -> list[Column]:
    slot = F.pmod(_at(level), F.lit(FANOUT))
    return [F.max(F.when(slot == k, F.col(node))) for k in range(FANOUT)]


def _parent(level: int, slots: list[Column]) -> Column:
    """The hash of what stands in the slots, or the only node itself."""
    return F.when(_several(level), hashed(*[F.coalesce(c, F.lit("")) for c in slots])).otherwise(slots[0])


def collapsed(nodes: DataFrame) -> DataFrame:
    """grp, pos, n, h of the nodes one band up."""
    dealt = nodes.select("grp", F.floor(F.col("pos") / _GROUP).alias("group"), "pos", "n", "h").repartition("grp", "group")
    for level in range(BAND):
        # pos becomes the smallest place below the parent, which tells the parent's place just as well.
        up = F.floor(F.col("pos") / FANOUT ** (level + 1)).alias("up")
        names = [f"c{k}" for k in range(FANOUT)]
        dealt = dealt.groupBy("grp", "group", up, "n").agg(F.min("pos").alias("pos"), *[c.alias(name) for c, name in zip(_slots(level, "h"), names)])
        dealt = dealt.select("grp", "group", "n", "pos", _parent(level, [F.col(c) for c in names]).alias("h"))
    return dealt.select("grp", F.col("group").alias("pos"), F.ceil(F.col("n") / _GROUP).alias("n"), "h")


def siblings(nodes: DataFrame) -> DataFrame:
    """``nodes`` with path (left and right siblings, level by level up to the band's end) and the group's number."""
    group = F.floor(F.col("pos") / _GROUP)
    rows = nodes.withColumn("group", group).repartition("grp", "group").withColumn("node", F.col("h"))
    above = [f"up{k}" for k in range(BAND, 0, -1)]
    rows = rows.withColumns({f"up{k}": F.floor(F.col("pos") / FANOUT**k) for k in range(1, BAND + 1)})
    steps = []
    for level in range(BAND):
        # The windows' keys begin with those of the exchange and of the levels above, so neither is dealt or sorted anew.
        children = Window.partitionBy("grp", "group", *above[: BAND - level])
        rows = rows.withColumns({f"c{k}": c.over(children) for k, c in enumerate(_slots(level, "node"))})
        slot = F.pmod(_at(level), F.lit(FANOUT))
        side = lambda keep: F.concat(*[F.when(keep(k, slot), F.coalesce(f"c{k}", F.lit(""))).otherwise("") for k in range(FANOUT)])
        step = F.struct(side(lambda k, s: s > k).alias("left"), side(lambda k, s: s < k).alias("right"))
        rows = rows.withColumn(f"step{level}", F.when(_several(level), step))
        rows = rows.withColumn("node", _parent(level, [F.col(f"c{k}") for k in range(FANOUT)]))
        steps.append(f"step{level}")
    return rows.withColumn("path", F.array_compact(F.array(*steps))).drop("node", *above, *steps, *[f"c{k}" for k in range(FANOUT)])


def with_paths(nodes: DataFrame, levels: int, top: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``nodes`` (grp, pos, n, h and more) with what ``top`` gives each group, its path put after the own one.

    ``top`` takes the groups' roots (grp, h) and returns (grp, path and more).
    """
    if levels <= 0:
        return nodes.join(top(nodes.select("grp", "h")), "grp")
    up = materialise(collapsed(nodes), "nodes")
    more = with_paths(up, levels - BAND, top)
    more = more.drop("n", "h").withColumnsRenamed({"pos": "group", "path": "rest"})
    out = siblings(nodes).join(more, ["grp", "group"])
    return out.withColumn("path", F.concat("path", "rest")).drop("group", "rest")


def _levels(n: int) -> int:
    """Levels above ``n`` leaves."""
    levels = 0
    while FANOUT**levels < n:
        levels += 1
    return levels


def folded(node: Column, path: Column) -> Column:
    """The root that a node and its siblings lead to."""
    return F.aggregate(path, node, lambda acc, x: hashed(x["left"], acc, x["right"]))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, path, changed (the leaf of the ``tampered`` text, or the leaf itself).

    ``path`` holds the siblings (left, right) of each level from the leaf up to the root.
    """
    rows = numbered(leaves(docs, F.col("text") if tampered is None else tampered), ["doc_id", "h"])

    def whole(roots: DataFrame) -> DataFrame:
        roots = numbered(roots.select(F.lit(0).alias("grp"), F.col("grp").alias("source"), "h"), ["source"])
        first = lambda r: r.select("grp", F.col("h").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
        n = roots.agg(F.max("n")).first()[0] or 0
        found = with_paths(roots, _levels(n), first)
        return found.select(F.col("source").alias("grp"), F.col("h").alias("subroot"), "root", "path")

    n = rows.agg(F.max("n")).first()[0] or 0
    found = with_paths(rows, _levels(n), whole)
    return found.select("doc_id", F.col("h").alias("leaf"), "subroot", "root", "path", "changed")


def audited(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Rows whose id's CRC-32 is even lose the line ends of their text before they are
    verified against the proof of the whole.
    """
    even = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0
    found = manifest(docs, F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text")))
    proof = F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), "")
    found = found.withColumns({"proof_sha256": F.sha2(proof, 256), "folded_root": folded(F.col("changed"), F.col("path"))})
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
