"""Ranked lexical search with hashed max-sketches: bounds for every document, exact scores for the few that may rank.

1. Index. Each document's impacts fold into a sketch: a term's frequency goes to
   ``HASHES`` hashed coordinates and each coordinate keeps its maximum. (The impact of a
   term grows with its frequency, and what else enters it is one number a document,
   so the maximum of frequencies is the maximum of impacts.) A sketch has at least
   ``WIDTH`` coordinates a distinct term up to 16 million, one byte each, and is stored
   compressed (some three bytes a term). The index doesn't depend on the queries. A
   rare term's weight is many times a common one's, so a shared coordinate must be
   rare: six hashes over 32 coordinates make it one in 30,000.
2. Bounds. A term can't occur more often than the least of its coordinates says, so
   one batched lookup of all query terms gives an upper bound of every document's
   score for every item. Where no coordinate is shared the bound is the score.
3. Threshold. ``SEEDS`` documents of the highest bounds of each item are scored
   exactly; the ``TOP``-th best of them is the item's threshold. (There are more seeds
   than ranks, for one high bound without a score would leave the item no threshold.)
4. Rescoring. Whoever's bound reaches the threshold is scored exactly on its whole
   text, in descending order of bounds: a task stops with an item once its own
   ``TOP`` scores are above what the next bound allows. Results are exact.

Queries are taken in blocks of ``BLOCK`` items; a block's terms and weights are what
is broadcast. Documents aren't shuffled: a bitmap of hashed ids of at most 16 MB
picks the texts to read again, and each task's result is ``TOP`` rows an item at most.

Defined results. A null text has no terms and never ranks. Rows that repeat rank
each; ties go to the smaller doc_id, null ids last. Items of one id are one item with
the terms of all; an item without terms, or whose terms no document holds, gives no
rows. Very long texts are scored whole. Empty tables give no rows. Other columns
take no part.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_bitmap, materialise, release

TOP, SEEDS, BLOCK = 50, 100, 1000
HASHES, WIDTH, SIZES = 6, 32, (64, 1 << 24)
ANY = 255  # a frequency of that or more: no limit is assumed
ROWS = 256
PIECE = 1 << 22
_DELIMITERS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TABLE = bytes(32 if b in _DELIMITERS else b for b in bytes(range(256)).lower())


def term_counts(data: bytes | None) -> Counter:
    """How often each term stands in a UTF-8 text; only A-Z are lowered."""
    out: Counter = Counter()
    at, data = 0, data or b""
    while at < len(data):
        end = at + PIECE
        while end < len(data) and data[end] not in _DELIMITERS:
            end += 1
        out.update(data[at:end].translate(_TABLE).split())
        at = end
    return out


def places(hashes: np.ndarray, size: int) -> np.ndarray:
    """The coordinates (HASHES, terms) of hashed terms in a sketch of ``size``, a power of two."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return np.array([((hashes + np.uint64(j) * step) & np.uint64(size - 1)).astype(np.int64) for j in range(HASHES)])


def term_hashes(terms) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(t) for t in terms], np.uint64)


def sketch(counts: Counter) -> np.ndarray:
    size = min(SIZES[1], max(SIZES[0], 1 << (WIDTH * max(1, len(counts)) - 1).bit_length()))
    out = np.zeros(size, np.uint8)
    tf = np.minimum(np.fromiter(counts.values(), np.int64, len(counts)), ANY).astype(np.uint8)
    for at in places(term_hashes(counts), size):
        np.maximum.at(out, at, tf)
    return out


def most(sketched: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """No term occurs more often than this (ANY: no limit is known)."""
    return sketched[places(hashes, len(sketched))].min(0)


def impact(tf: np.ndarray, m: np.ndarray, held: np.ndarray | None = None) -> np.ndarray:
    """The part of a score that a term's weight is multiplied with; where ``held`` is ANY, more than any frequency gives."""
    out = (1_000_000_000 * tf) // (1000 * tf + 20 * m)
    return out if held is None else np.where(held == ANY, 1_000_000, out)


def length_norm(n: int, documents: int, terms: int) -> int:
    return 100 - 50 + (50 * n * documents) // terms


def indexed(docs: DataFrame) -> DataFrame:
    """doc_id, same (hash of the text), n (terms), sketch: one row for each document."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(1)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch[at : at + ROWS]
                n, held = [], []
                for data in part["text"]:
                    counts = term_counts(data)
                    n.append(counts.total())
                    held.append(pack.compress(sketch(counts).tobytes()) if counts else b"")
                yield pd.DataFrame({"doc_id": part["doc_id"], "same": part["same"], "n": n, "sketch": held})

    text = F.col("text").cast("string")
    # Ids as text, for pandas would turn ids beside a null one into floats.
    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64(text).alias("same"), text.cast("binary").alias("text"))
    return named.mapInPandas(rows, "doc_id string, same long, n long, sketch binary")


class Queries:
    """A block of items: distinct terms, and for each term the items that hold it."""

    def __init__(self, items: list[tuple[int | None, set[bytes]]]) -> None:
        self.items = [i for i, _ in items]
        terms = sorted(set().union(*[t for _, t in items]))
        self.number = {t: k for k, t in enumerate(terms)}
        pairs = sorted((self.number[t], k) for k, (_, held) in enumerate(items) for t in held)
        self.of = np.array([k for _, k in pairs], np.int64)
        self.start = np.searchsorted(np.array([t for t, _ in pairs], np.int64), np.arange(len(terms) + 1))
        self.hashes = term_hashes(terms)
        self.weight = np.zeros(len(terms), np.int64)

    def totals(self, row: np.ndarray, term: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
        """(rows, items): sums of weight times value over each item's terms; whole numbers below 2^53."""
        count = self.start[term + 1] - self.start[term]
        each = np.repeat(np.arange(len(term)), count)
        item = self.of[np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.start[term], count)]
        at = row[each] * len(self.items) + item
        sums = np.bincount(at, (self.weight[term] * value)[each].astype(np.float64), rows * len(self.items))
        return sums.reshape(rows, len(self.items)).astype(np.int64)


def blocks(items: DataFrame) -> Iterator[Queries]:
    """The queries, ``BLOCK`` at a time."""
    rows = items.select("item_id", F.col("text").cast("string").cast("binary").alias("text"))
    held: dict[int | None, set[bytes]] = {}
    for r in rows.orderBy("item_id").toLocalIterator():
        if r["item_id"] not in held and len(held) == BLOCK:
            yield Queries(list(held.items()))
            held = {}
        held.setdefault(r["item_id"], set()).update(term_counts(r["text"]))
    if held:
        yield Queries(list(held.items()))


def frequencies(docs: DataFrame, queries: Queries) -> np.ndarray:
    """How many documents hold each of the queries' terms, counted over all of them."""
    shared, size = docs.sparkSession.sparkContext.broadcast(queries.number), len(queries.number)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, total = shared.value, np.zeros(size, np.int64)
        for batch in batches:
            for data in batch["text"]:
                total[[k for t in term_counts(data) if (k := number.get(t)) is not None]] += 1
        at = np.flatnonzero(total)
        yield pd.DataFrame({"term": at, "df": total[at]})

    found = docs.select(F.col("text").cast("string").cast("binary").alias("text")).mapInPandas(rows, "term long, df long")
    out = np.zeros(size, np.int64)
    for r in found.groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[r["term"]] = r["df"]
    shared.unpersist()
    return out


def _norms(n, documents: int, terms: int) -> np.ndarray:
    return np.array([length_norm(int(x), documents, terms) for x in n], np.int64)


def _bounds(part: pd.DataFrame, queries: Queries, m: np.ndarray) -> np.ndarray:
    """(rows, items): no document scores more."""
    unpack, row, term, held = zstandard.ZstdDecompressor(), [], [], []
    alive = np.flatnonzero(queries.weight)
    hashes = queries.hashes[alive]
    for k, packed in enumerate(part["sketch"]):
        top = most(np.frombuffer(unpack.decompress(packed), np.uint8), hashes)
        at = np.flatnonzero(top)
        row.append(np.full(len(at), k))
        term.append(alive[at])
        held.append(top[at])
    row, term, held = (np.concatenate(x) for x in (row, term, held))
    return queries.totals(row, term, impact(held.astype(np.int64), m[row], held), len(part))


class _Highest:
    """The ``TOP`` highest bounds of each item among the rows seen, and what is known of these rows."""

    def __init__(self, items: int) -> None:
        self.bound, self.row, self.known, self.seen = np.zeros((0, items), np.int64), np.zeros((0, items), np.int64), {}, 0

    def add(self, part: pd.DataFrame, bound: np.ndarray) -> None:
        number = np.arange(self.seen, self.seen + len(part))
        bound = np.concatenate([self.bound, bound])
        row = np.concatenate([self.row, np.broadcast_to(number[:, None], (len(part), bound.shape[1]))])
        if len(bound) > TOP:
            at = np.argpartition(-bound, TOP - 1, axis=0)[:TOP]
            bound, row = np.take_along_axis(bound, at, 0), np.take_along_axis(row, at, 0)
        self.bound, self.row = bound, row
        facts = [part[c].to_numpy() for c in ("doc_id", "same", "n")]
        kept = np.unique(row)
        new = kept[kept >= self.seen]
        self.known = {k: self.known[k] for k in kept[kept < self.seen].tolist()} | {k: tuple(x[k - self.seen] for x in facts) for k in new.tolist()}
        self.seen += len(part)

    def rows(self) -> pd.DataFrame:
        at, item = np.nonzero(self.bound)
        facts = [(*self.known[k], i, b) for k, i, b in zip(self.row[at, item].tolist(), item.tolist(), self.bound[at, item].tolist())]
        return pd.DataFrame(facts, columns=["doc_id", "same", "n", "item", "bound"])


_FOUND = "doc_id string, same long, n long, item int, bound long"


def bounded(index: DataFrame, queries: Queries, documents: int, terms: int, lines: np.ndarray | None = None) -> DataFrame:
    """(doc_id, same, n, item, bound): with ``lines`` whatever reaches its item's line, else each task's ``TOP`` of each item."""
    shared = index.sparkSession.sparkContext.broadcast((queries, lines))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries, lines = shared.value
        best = _Highest(len(queries.items))
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch[at : at + ROWS]
                bound = _bounds(part, queries, _norms(part["n"], documents, terms))
                if lines is None:
                    best.add(part, bound)
                else:
                    k, item = np.nonzero((bound >= lines) & (bound > 0))
                    yield pd.DataFrame({**{c: part[c].to_numpy()[k] for c in ("doc_id", "same", "n")}, "item": item, "bound": bound[k, item]})
        if lines is None:
            yield best.rows()

    return index.where("n > 0").mapInPandas(rows, _FOUND)


def rescored(docs: DataFrame, found: DataFrame, queries: Queries, documents: int, terms: int) -> DataFrame:
    """(doc_id, copies, item, score) of what ``found`` (a written table of bounds) names and may rank.

    Rows alike in id and text are scored once. A task takes its documents in
    descending order of their bounds and leaves out whatever can't come under its
    own ``TOP`` of an item.
    """
    key = ["doc_id", "same"]
    one = found.groupBy(*key, "n", "item", "bound").agg(F.count("*").alias("copies"))
    asked = one.groupBy(*key, "n", "copies").agg(F.collect_list("item").alias("items"), F.collect_list("bound").alias("bounds"), F.max("bound").alias("lead"))
    asked = asked.withColumnsRenamed({c: f"__{c}" for c in key})
    text = F.col("text").cast("string")
    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64(text).alias("same"), text.cast("binary").alias("text"))
    texts = in_bitmap(named, "same", found.select("same")).groupBy(*key).agg(F.first("text").alias("text"))
    both = asked.join(texts, F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("same") == F.col("__same")))
    both = both.select("doc_id", "n", "copies", "items", "bounds", "text", "lead").sortWithinPartitions(F.desc("lead"))
    shared = docs.sparkSession.sparkContext.broadcast(queries)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries = shared.value
        best: list[list] = [[] for _ in queries.items]
        for batch in batches:
            m = _norms(batch["n"], documents, terms)
            for k, (d, copies, items, bounds, data) in enumerate(zip(batch["doc_id"], batch["copies"], batch["items"], batch["bounds"], batch["text"])):
                low = np.array([best[i][0][0] if len(best[i]) == TOP else 0 for i in items])
                open_ = np.asarray(items)[np.asarray(bounds) >= low]
                if not len(open_):
                    continue
                counts = [(t, tf) for word, tf in term_counts(data).items() if (t := queries.number.get(word)) is not None]
                term, tf = np.array(counts, np.int64).reshape(-1, 2).T
                total = queries.totals(np.zeros(len(term), np.int64), term, impact(tf, m[k : k + 1]), 1)[0]
                for i in open_:
                    if total[i] > 0:
                        # Of equal scores the larger id leaves first, null ids before all.
                        new = (int(total[i]), d is not None, -int(d or 0), int(copies))
                        (heapq.heappushpop if len(best[i]) == TOP else heapq.heappush)(best[i], new)
        found = [(str(-d) if known else None, copies, i, score) for i, x in enumerate(best) for score, known, d, copies in x]
        yield pd.DataFrame(found, columns=["doc_id", "copies", "item", "score"])

    return both.mapInPandas(rows, "doc_id string, copies long, item int, score long")


def _best(rows: DataFrame, by: list, top: int) -> DataFrame:
    """The first ``top`` of each item; tasks drop what can't rank before anything is shuffled."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*by))).where(F.col("rank") <= top)


def ranked(docs: DataFrame, index: DataFrame, queries: Queries, documents: int, terms: int) -> DataFrame:
    """item, rank, doc_id, score of one block of queries."""
    df = frequencies(docs, queries)
    queries.weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) if x else 0 for x in df], np.int64)
    first = materialise(bounded(index, queries, documents, terms), "bounds")
    seeds = materialise(_best(first, [F.desc("bound"), "same", F.col("doc_id").cast("long")], SEEDS).drop("rank"), "seeds")
    order = [F.desc("score"), F.col("doc_id").cast("long").asc_nulls_last()]
    scored = materialise(rescored(docs, seeds, queries, documents, terms), "scores")
    lines = np.ones(len(queries.items), np.int64)
    each = scored.select("item", "score", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(TOP).cast("long"))))).drop("col")
    for r in _best(each, [F.desc("score")], TOP).where(F.col("rank") == TOP).toLocalIterator():
        lines[r["item"]] = r["score"]
    release(first, seeds, scored)
    found = materialise(bounded(index, queries, documents, terms, lines), "candidates")
    scored = materialise(rescored(docs, found, queries, documents, terms), "scores")
    release(found)
    each = scored.select("item", "doc_id", "score", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(TOP).cast("long")))))
    return materialise(_best(each, order, TOP).select("item", "rank", F.col("doc_id").cast("long").alias("doc_id"), "score"), "ranked")


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score: the ``TOP`` documents of each item with a score above 0."""
    spark = docs.sparkSession
    index = materialise(indexed(docs), "index")
    known = index.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("terms")).first()
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for queries in blocks(items) if known["documents"] else ():
        found = ranked(docs, index, queries, known["documents"], known["terms"])
        names = spark.createDataFrame(list(enumerate(queries.items)), "item int, item_id long")
        out = out.unionByName(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    release(index)
    return out
