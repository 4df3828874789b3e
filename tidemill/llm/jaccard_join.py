"""Exact Jaccard similarity join of documents on word shingles, in metric-space style.

1. Each text becomes its set of distinct five-word shingles (64-bit hashes);
   equal sets are one class.
2. Pivots. A single shingle {s} is a pivot at distance 1 - 1/|x| from every set x
   that holds it and 1 from all others, so the nearest pivots of x are its own
   shingles; ties go to the rarer shingle. Whatever lies within distance 0.2 of x
   holds 0.8|x| of its shingles, hence one of the first |x| - ceil(0.8|x|) + 1
   pivots of x: x is replicated to just these pivots' Voronoi regions and no link
   is lost. A set at place i of its own order holds |x| - i shingles from there
   on, so two sets that first meet in a region share no more than the smaller rest
   allows: this window on the places leaves few pairs. (Document pivots alone can't
   part texts: unrelated texts are all at distance 1 from them.)
3. Rarity is counted, over all documents, by a grouped aggregation. First for a
   hash share ``SHARE`` of all shingles: each set holds those of the share (and
   more, if these are fewer than its pivots). A shingle of one document makes no
   region, so documents mostly of such shingles leave here. Then for all shingles
   of the sets that stay, which gives them their final order.
4. Regions join recursively. A region of more than ``REGION`` members takes one of
   them as document pivot p; the exact distance of every member to p is computed,
   members within 0.2 are linked and become one component, and the members are
   dealt into rings of width 0.2 around p. By the triangle inequality linked sets
   lie in the same or in adjoining rings, so each member is replicated to the next
   ring too, and the rings are the next level's regions. Regions of one component
   are done; ``LEVELS`` levels at most, for unlike texts are all at one distance.
5. What is left meets in its regions, large ones dealt into parts, only across
   components, and within the windows of sizes and places. Pairs are verified on
   whole sets; a bitmap of parities first refutes most that are unlike.

Components are exact that way. Links themselves are listed (``links``) and counted
(``join`` with ``count_links``) from all pairs that meet in a first-level region.
Exact means up to equal 64-bit hashes of different shingles or sets.

Defined results. Null or word-free text: an empty set, linked with nothing. Fewer
than five words: the sequence as one shingle. Very long texts are hashed in
pieces, to the same set. Rows that repeat are of one class; rows that share a
``doc_id`` but not a text are joined each on its own text. A null ``doc_id`` is
kept, links with nothing and has its own null component. Ties in rarity go by
hash. An empty table gives no rows. Other columns are ignored, whatever their
names (``keep_one`` carries them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, materialise, release, worker_cache

SHINGLE, NUM, DEN = 5, 80, 100
SHARE = 0.25
REGION, LEVELS, PART = 64, 2, 512
BITMAP = (1 << 20, 1 << 27)
ROWS = 1000
CHUNK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_STEP = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the radix and of its inverse, 0 to n."""
    if not _powers or len(_powers["up"]) <= n:
        for key, base in (("up", _R), ("down", _R_INV)):
            x = np.full(n + 1, base, np.uint64)
            x[0] = 1
            _powers[key] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _hash_words(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_SPACE[raw]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _power(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
    return _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _STEP[0])


def word_hashes(text: str | None) -> np.ndarray:
    """One 64-bit hash for each word of the text with A-Z lowered; long texts are read in pieces."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    if len(data) <= CHUNK:
        return _hash_words(data)
    out, at = [], 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        out.append(_hash_words(data[at:end]))
        at = end
    return np.concatenate(out)


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = max(1, len(w) - SHINGLE + 1)
    s = np.full(n, len(w) if len(w) < SHINGLE else SHINGLE, np.uint64)
    for j in range(min(SHINGLE, len(w))):
        s = _mix(s + w[j : j + n] * _STEP[j])
    s.sort()
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


def prefix_length(n: int) -> int:
    """How many first pivots of a set of n are enough to meet every set within the distance."""
    return n - -(-NUM * n // DEN) + 1


_CUT = np.uint64(int(SHARE * 2**64))


def bitmap(s: np.ndarray) -> bytes:
    """Parities of the set's counts in hash blocks, two to four blocks a shingle.

    Differing bits of two bitmaps never exceed the symmetric difference.
    """
    blocks = 1 << max(6, (2 * len(s) - 1).bit_length())
    at = (s & np.uint64(blocks - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=blocks).astype(np.uint8) & 1, bitorder="little").tobytes()


def apart_at_least(x: bytes, y: bytes) -> int:
    """A lower bound of the symmetric difference from two bitmaps; the longer is folded to the shorter."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _slices(batches) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield batch[at : at + ROWS]


def _fingerprint(s: np.ndarray) -> int:
    at = np.arange(len(s), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    with np.errstate(over="ignore"):
        return int(_mix(_mix(s * at).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s))).astype(np.int64)[0])


def shingled(docs: DataFrame) -> DataFrame:
    """doc_id, same (hash of the text), n, id (of the whole set), held.

    ``held`` are the set's first shingles by hash: those of the share, or as many as it has pivots if these are more.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_cache("jaccard")
        for batch in _slices(batches):
            n, ids, held = [], [], []
            for text in batch["text"]:
                s = shingle_set(text)
                n.append(len(s))
                ids.append(_fingerprint(s) if len(s) else 0)
                held.append(s[: max(int(np.searchsorted(s, _CUT)), prefix_length(len(s)))].astype(np.int64) if len(s) else [])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "same": batch["same"], "n": n, "id": ids, "held": held})

    # Ids as text, for pandas would turn ids beside a null one into floats.
    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("same"), "text")
    return named.mapInPandas(rows, "doc_id string, same long, n long, id long, held array<long>").withColumn("doc_id", F.col("doc_id").cast("long"))


def anchored(heads: DataFrame, cut: int | None) -> DataFrame:
    """(region, id, n, place, members): each class in the regions of its first pivots, where these have several members.

    ``heads`` has id, n and ``held``: the set's first shingles by hash, which are all below ``cut`` (all at all
    if None) and as many as it has pivots at least. Below ``cut`` counts are exact, so order goes by them.
    """
    each = heads.select("id", F.posexplode("held").alias("k", "token"))
    # Partial sums before the shuffle make a common shingle cost no more than a rare one.
    counts = materialise(each.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "counts")
    counted = F.lit(True) if cut is None else (F.col("token") >= 0) & (F.col("token") < F.lit(cut))
    low = F.size("held") if cut is None else F.size(F.filter("held", lambda x: (x >= 0) & (x < cut)))
    rows = each.join(counts, "token").withColumn("counted", counted).join(heads.select("id", "n", low.alias("low")), "id")
    # Shingles of one document come first; the others below the cut follow by count, those beyond it by hash.
    own = Window.partitionBy("id")
    order = own.orderBy(F.desc("counted"), F.when(F.col("counted"), F.col("df")), "token")
    single = F.col("low") - F.sum(F.col("counted").cast("int")).over(own)
    place = F.when(F.col("counted"), single + F.row_number().over(order) - 1).otherwise(F.col("k")).cast("int")
    pivots = F.col("n") - F.ceil(F.col("n") * NUM / DEN) + 1
    first = rows.select(F.col("token").alias("region"), "id", "n", place.alias("place")).where(F.col("place") < pivots)
    first = materialise(first, "anchors")
    size = first.groupBy("region").agg(F.count("*").alias("members")).where("members > 1")
    regions = materialise(first.join(size, "region"), "regions")
    release(counts, first)
    return regions


def whole_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, n, held, bits) of the classes in ``ids`` (id, doc_id), and of a few more; ``held`` is the whole set.

    A bitmap of document ids picks the texts to hash, so texts aren't shuffled; it has
    16 bits an id, within the two bounds of ``BITMAP``: past the larger one (16 MB),
    more texts are hashed than need be, which changes no result.
    """
    size = min(BITMAP[1], max(BITMAP[0], 1 << (16 * ids.count()).bit_length()))
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(size))
    held = ids.select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, int(pmod(xxhash64(doc_id), {size}) & 63))").alias("bit"))
    words = held.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()  # size / 64 rows at most
    table = np.zeros(size // 64, np.int64)
    table[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = shared.value.view(np.uint64)
        for batch in batches:
            at = batch["bit"].to_numpy(np.int64)
            hit = (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            for part in _slices([batch[hit == 1]]):
                sets = [s for s in map(shingle_set, part["text"]) if len(s)]
                yield pd.DataFrame({"id": [_fingerprint(s) for s in sets], "n": [len(s) for s in sets], "held": [s.view(np.int64) for s in sets], "bits": [bitmap(s) for s in sets]})

    chosen = docs.where("doc_id is not null").select("text", bit.alias("bit"))
    return chosen.mapInPandas(rows, "id long, n long, held array<long>, bits binary")


def _apart(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([apart_at_least(x, y) for x, y in zip(a, b)], dtype="int64")


def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b)], dtype="int64")


def _beside(pairs: DataFrame, sets: DataFrame, what: str) -> DataFrame:
    """``pairs`` (a, b, ...) with the column ``what`` of both ends, as x and y; only rows that a pair asks for are shuffled."""
    asked = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    rows = sets.select("id", what).join(asked, "id", "left_semi")
    side = lambda c, to: rows.select(F.col("id").alias(c), F.col(what).alias(to))
    return pairs.join(side("b", "y"), "b").join(side("a", "x"), "a")


def measured(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """(a, b, na, nb) with the size of the intersection and whether the two are linked."""
    rows = _beside(pairs, sets, "held").withColumn("inter", F.pandas_udf(_common, "long")("x", "y")).drop("x", "y")
    return materialise(rows.withColumn("linked", F.col("inter") * DEN >= NUM * (F.col("na") + F.col("nb") - F.col("inter"))), name)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The linked ones of (a, b, na, nb), as (a, b)."""
    pairs = materialise(pairs, "pairs")
    # |x sym y| > (1-t)/(1+t) (|x|+|y|) rules a link out.
    fits = F.col("gap") * (DEN + NUM) <= (DEN - NUM) * (F.col("na") + F.col("nb"))
    light = materialise(_beside(pairs, sets, "bits").withColumn("gap", F.pandas_udf(_apart, "long")("x", "y")).drop("x", "y").where(fits).drop("gap"), "pairs")
    found = measured(light, sets, "verified")
    release(pairs, light)
    return found.where("linked").select("a", "b")


def prepared(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with n and id, regions, sets of the classes in them)."""
    whole = materialise(shingled(docs), "shingled")
    rows = materialise(whole.select("doc_id", "same", "n", "id"), "rows")
    # Equal sets are dropped before the shuffle too, so a large group of copies sends one row a task.
    heads = materialise(whole.where("n > 0 and doc_id is not null").select("id", "n", "held").dropDuplicates(["id"]), "heads")
    release(whole)
    near = anchored(heads, int(_CUT))
    inside = near.select("id").distinct()
    named = rows.where("n > 0 and doc_id is not null").groupBy("id").agg(F.min("doc_id").alias("doc_id")).join(inside, "id", "left_semi")
    named = materialise(named, "named")
    release(heads, near)
    sets = materialise(whole_sets(docs, named).join(named.select("id"), "id", "left_semi").dropDuplicates(["id"]), "sets")
    release(named)
    return rows, anchored(sets, None), sets


def _with_component(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("component", F.col("id"))
    return members.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """``labels`` (id, component) of all classes that a link has touched, once ``links`` (a, b) have joined components."""
    edges = links.select("a", "b")
    if labels is not None:
        side = lambda c: labels.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
        edges = edges.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    edges = materialise(edges.where("a <> b").distinct(), "joins")
    if not edges.limit(1).count():
        return labels
    ends = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct()
    new = materialise(connected_components(ends, edges), "joined")
    if labels is None:
        return new
    step = new.select(F.col("id").alias("component"), F.col("component").alias("joined"))
    old = labels.join(step, "component", "left").select("id", F.coalesce("joined", "component").alias("component"))
    return materialise(old.unionByName(new.join(labels, "id", "left_anti")), "labels")


def _near_sizes(x: str, y: str) -> Column:
    return (F.col(x) * DEN >= F.col(y) * NUM) & (F.col(y) * DEN >= F.col(x) * NUM)


def components(regions: DataFrame, sets: DataFrame) -> DataFrame | None:
    """(id, component) of the classes that have a link; pairs within one component are not tested, so this lists no links."""
    regions = regions.withColumn("guest", F.lit(0))
    labels, left = None, regions.where(F.col("members") <= REGION).drop("members")
    live = regions.where(F.col("members") > REGION).drop("members")
    for level in range(LEVELS):
        # The fewer rarer shingles a set has, the nearer it is to the others of the region.
        middle = F.min(F.struct(F.col("place") / F.col("n"), F.xxhash64("id"), "id", "n"))
        heads = _with_component(live, labels).groupBy("region")
        heads = heads.agg(middle.alias("p"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.bit_and("guest").alias("guests"), F.count("*").alias("members"))
        heads = heads.where("lo <> hi and guests = 0").select("region", F.col("p.id").alias("a"), F.col("p.n").alias("na"), "members")
        named = materialise(live.join(heads, "region"), "live")
        left = left.unionByName(named.where(F.col("members") <= REGION).select(*left.columns))
        # The pivot meets all others now, so it goes no further.
        live = named.where((F.col("members") > REGION) & (F.col("id") != F.col("a")))
        if not live.limit(1).count():
            break
        far = measured(live.select("a", F.col("id").alias("b"), "na", F.col("n").alias("nb")).distinct(), sets, "distances")
        labels = _merged(labels, far.where("linked"))
        # The ring's number in whole numbers: a distance of just 0.2, 0.4, ... must not round down.
        ring = F.expr(f"((na + nb - 2 * inter) * {DEN}) div ((na + nb - inter) * {DEN - NUM})").cast("int")
        dealt = live.join(far.select("a", F.col("b").alias("id"), ring.alias("ring")), ["a", "id"])
        # Two guests of one level meet where both are at home, so a bit for each level tells such pairs.
        home, next_door = F.struct("ring", "guest"), F.struct((F.col("ring") + 1).alias("ring"), F.col("guest").bitwiseOR(F.lit(1 << level)).alias("guest"))
        dealt = dealt.select("region", "id", "n", "place", F.inline(F.array(home, next_door)))
        live = materialise(dealt.select(F.xxhash64("region", F.lit(level), "ring").alias("region"), "id", "n", "place", "guest"), "rings")
    else:
        left = left.unionByName(live)
    return _merged(labels, verified(_open_pairs(left, labels), sets))


def _open_pairs(members: DataFrame, labels: DataFrame | None, across: bool = True) -> DataFrame:
    """(a, b, na, nb), a < b: pairs that meet in a region within the windows of sizes and places, across components only.

    A region's main component isn't met with itself. Large regions are dealt into
    parts of about ``PART`` members, and a task meets two parts.
    """
    named = _with_component(members, labels)
    if across:
        held = named.groupBy("region", "component").agg(F.count("*").alias("k")).groupBy("region")
        held = held.agg(F.max(F.struct("k", "component"))["component"].alias("main"), F.sum("k").alias("size"), F.count("*").alias("several")).where("several > 1")
        outside = F.col("component") != F.col("main")
        apart = F.expr("component <> component2 and (component2 = main or id < id2) and guest & guest2 = 0")
    else:
        held = named.groupBy("region").agg(F.count("*").alias("size"), F.lit(None).cast("long").alias("main"))
        outside, apart = F.lit(True), F.expr("id < id2")
    named = materialise(named.join(held.select("region", "main", F.ceil(F.col("size") / PART).cast("int").alias("parts")), "region"), "open")
    part, every = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    one = named.where(outside).select("region", "main", "id", "n", "place", "guest", "component", part.alias("p"), every.alias("q"))
    two = named.select("region", F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("place").alias("place2"), F.col("guest").alias("guest2"), F.col("component").alias("component2"), part.alias("q"), every.alias("p"))
    # From the first shared shingle on, the smaller rest bounds what the two share: 0.8 / 1.8 of both sizes for a link.
    room = F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2")) * (DEN + NUM) >= (F.col("n") + F.col("n2")) * NUM
    met = one.join(two, ["region", "p", "q"]).where(apart).where(_near_sizes("n", "n2")).where(room)
    swap = F.col("id") < F.col("id2")
    pick = lambda x, y: F.when(swap, F.col(x)).otherwise(F.col(y))
    return met.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"), pick("n", "n2").alias("na"), pick("n2", "n").alias("nb")).distinct()


def _links(regions: DataFrame, sets: DataFrame) -> DataFrame:
    """As many rows as there are links, so a group of near copies costs its square here."""
    return verified(_open_pairs(regions.drop("members").withColumn("guest", F.lit(0)), None, across=False), sets)


def links(docs: DataFrame) -> DataFrame:
    """(a, b), a < b: every pair of classes within the distance, each class named by its smallest doc_id."""
    rows, regions, sets = prepared(docs)
    least = rows.where("n > 0 and doc_id is not null").groupBy("id").agg(F.min("doc_id").alias("least"))
    side = lambda c: least.select(F.col("id").alias(c), F.col("least").alias(f"l{c}"))
    return _links(regions, sets).join(side("a"), "a").join(side("b"), "b").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"))


def _joined(docs: DataFrame, count_links: bool = False) -> DataFrame:
    """doc_id, same, n, label, class_id, component_id (and n_links).

    ``label`` is the component itself; its name, the smallest doc_id, may be another's too where ids repeat.
    """
    rows, regions, sets = prepared(docs)
    labels = components(regions, sets)
    classes = rows.where("n > 0 and doc_id is not null").groupBy("id").agg(F.min("doc_id").alias("class_id"))
    if labels is None:
        classes = classes.withColumns({"component_id": F.col("class_id"), "label": F.col("id")})
    else:
        touched = materialise(labels.join(classes, "id"), "touched")
        least = touched.groupBy("component").agg(F.min("class_id").alias("component_id"))
        found = touched.join(least, "component").select("id", "component_id", F.col("component").alias("label"))
        classes = classes.join(found, "id", "left").withColumns({"component_id": F.coalesce("component_id", "class_id"), "label": F.coalesce("label", "id")})
    if count_links:
        pairs = _links(regions, sets)
        ends = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("n_links"))
        classes = classes.join(ends, "id", "left")
    classes = materialise(classes, "classes")
    release(regions, sets)
    # Without an id no class can be named; without words the document stands alone.
    own = F.col("doc_id").isNull() | (F.col("n") == 0)
    n_links = [F.when(own, F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links")] if count_links else []
    name = lambda c: F.when(own, F.col("doc_id")).otherwise(F.col(c)).alias(c)
    return rows.join(classes, "id", "left").select("doc_id", "same", "n", "label", name("class_id"), name("component_id"), *n_links)


def join(docs: DataFrame, count_links: bool = False) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id; with ``count_links`` also n_links of the class with other classes.

    Components don't need the pairs within them; counting links lists and verifies them all.
    """
    return _joined(docs, count_links).drop("same", "label").withColumnRenamed("n", "n_shingles")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with one of each component kept (its smallest doc_id); all columns as they came.

    Of rows alike in that doc_id and text the smallest by their other columns is
    kept; rows without an id all stay, and so does each document without words.
    """
    out = _joined(docs).where("doc_id is not null")
    chosen = out.where("n > 0").groupBy("label").agg(F.min(F.struct("doc_id", "same")).alias("k")).select("k.doc_id", "k.same")
    chosen = chosen.unionByName(out.where("n = 0").select("doc_id", "same")).distinct()
    chosen = chosen.select(F.col("doc_id").alias("__id"), F.col("same").alias("__same"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__same"))
    kept = whole.join(materialise(chosen, "chosen"), ["__id", "__same"], "left_semi")
    kept = kept.groupBy("__id", "__same").agg(F.min_by("__doc", F.to_json("__doc", {"ignoreNullFields": "false"})).alias("__doc")).select("__doc.*")
    return kept.unionByName(docs.where("doc_id is null"))
