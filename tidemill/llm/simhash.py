"""SimHash fingerprints of documents and exact multi-index hashing of those within a few bits.

1. A text's three-word shingles, repeats included, are hashed (XXH64, seed 42); a
   fingerprint bit is 1 if more than half of the hashes have it. Equal fingerprints
   are one class, so a group of copies is one row from here on.
2. A fingerprint is cut into two segments of 32 bits. Of ``RADIUS`` = 3 differing
   bits at most one falls into one of the segments, so two linked fingerprints are
   within one bit there: the table holds each fingerprint under each segment, and
   each fingerprint asks for the small ball around its segment, 33 values.
3. Where a segment's value is held by more than ``BUCKET`` fingerprints, what it has
   to answer is cut further: the other segment differs in three bits at most, so in
   one of its halves in one at most, and both the table's rows and the questions get
   that half's ball (17 values) into the key. A value asked for with 48 bits names
   fingerprints that differ in 16 bits at most. This is exact too; it only makes
   fewer rows meet.
4. Whoever meets is compared in full. Links join components.

Work grows with the fingerprints and with the links between different ones, not
with copies; a fingerprint has at most 43,744 others within three bits.

Defined results. Fewer than three words: the whole sequence is the one shingle. No
words or null text: fingerprint zero, linked like any other. Rows that repeat have
one fingerprint. A null id takes its class's component and names none; a component
with null ids only is null. Very long texts are hashed in pieces, to the same
fingerprint. An empty table gives no rows. Other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialise, release

SHINGLE, SEED, RADIUS = 3, 42, 3
BUCKET = 256
PIECE = 1 << 20
_SPACE = b" \t\n\v\f\r"


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    at = 0
    while at < len(data):
        end = at + PIECE
        while end < len(data) and data[end] not in _SPACE:
            end += 1
        yield data[at:end].lower().split()
        at = end


def fingerprint(data: bytes | None) -> int:
    """The unsigned 64-bit fingerprint of a UTF-8 text."""
    ones, total, tail = np.zeros(64, np.int64), 0, []
    for words in _pieces(data or b""):
        words = tail + words
        tail = words[-(SHINGLE - 1) :]
        found = [xxhash.xxh64_intdigest(x, SEED) for x in map(b" ".join, zip(*[words[k:] for k in range(SHINGLE)]))]
        bits = np.unpackbits(np.array(found, "<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(0, dtype=np.int64)
        total += len(found)
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(tail), SEED) if tail else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = np.array([fingerprint(x) for x in batch["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": fp.view(np.int64)})

    # Ids as text, for pandas would turn ids beside a null one into floats.
    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return named.mapInPandas(rows, "doc_id string, fp long").withColumn("doc_id", F.col("doc_id").cast("long"))


def ball(value: Column, bits: int) -> Column:
    """``value`` and all values of ``bits`` bits that differ from it in one."""
    flipped = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda k: value.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k)))
    return F.concat(F.array(value), flipped)


def _part(c: str, place: int, bits: int) -> Column:
    """The ``place``-th segment of ``bits`` bits."""
    return F.shiftrightunsigned(c, place * bits).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _halves(segment: str) -> Column:
    """(half, which, the other segment's value in that half) for both halves of the other segment."""
    other = F.lit(1) - F.col(segment)
    shift = lambda k: (other * 32 + 16 * k).cast("int")
    value = lambda k: F.call_function("shiftrightunsigned", F.col("fp"), shift(k)).bitwiseAND(F.lit(0xFFFF).cast("long"))
    return F.array(*[F.struct(F.lit(k).alias("half"), value(k).alias("value")) for k in (0, 1)])


def links(fps: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of the distinct ``fp`` that differ in 1 to ``RADIUS`` bits; a pair may come twice."""
    each = F.array(*[F.struct(F.lit(s).alias("segment"), _part("fp", s, 32).alias("key")) for s in (0, 1)])
    held = fps.select("fp", F.inline(each))
    crowded = materialise(held.groupBy("segment", "key").agg(F.count("*").alias("k")).where(F.col("k") > BUCKET).select("segment", "key"), "crowded")
    asked = held.select("fp", "segment", F.explode(ball(F.col("key"), 32)).alias("key"))
    near = (F.col("fp") < F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= RADIUS)
    named = F.col("fp").alias("other")

    plain = held.join(crowded, ["segment", "key"], "left_anti").select("segment", "key", named)
    met = asked.join(plain, ["segment", "key"]).where(near).select(F.col("fp").alias("a"), F.col("other").alias("b"))

    cut = ["segment", "key", "half", "value"]
    table = held.join(crowded, ["segment", "key"], "left_semi").select("segment", "key", named, F.inline(_halves("segment")))
    more = asked.join(crowded, ["segment", "key"], "left_semi").select("segment", "key", "fp", F.inline(_halves("segment")))
    more = more.select("fp", "segment", "key", "half", F.explode(ball(F.col("value"), 16)).alias("value"))
    return met.unionByName(more.join(table, cut).where(near).select(F.col("fp").alias("a"), F.col("other").alias("b")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id reachable by links)."""
    rows = materialise(fingerprints(docs), "fingerprints")
    fps = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    edges = materialise(links(fps.select("fp")), "links")
    ends = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct()
    labels = materialise(connected_components(ends, edges).withColumnRenamed("id", "fp"), "components")
    release(edges)
    # Least ids by component in two steps, for a component may hold a third of all classes.
    named = fps.join(labels, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = materialise(named.join(least, "component").select("fp", "component_id"), "named")
    release(fps, labels)
    return rows.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
