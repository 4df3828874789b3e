"""Best-two-fit packing of tokenised documents into sequences of bounded length.

Bins are filled greedily (largest piece that fits, again and again); then the
smallest piece of a bin is replaced by two unpacked pieces if these fit its gap,
widened by that piece, more tightly. The choice depends on lengths alone, so the
plan is made on the histogram of lengths (at most ``limit`` numbers at any input
size): a filled pattern repeats while every length it uses lasts. Spark then
numbers the pieces of each length - in salted groups, so equal lengths may be any
share of the rows - and joins them to the plan.

Defined results. A null text is empty and becomes the lone end token. Rows that
repeat are packed each on their own. A null ``doc_id`` is packed like any other. A
text of any length is cut into pieces of ``limit`` ids. Pieces of one length are
interchangeable, so ties need no rule. An empty table gives no rows. ``tokenised``
ignores other columns, whatever their names; ``pack`` carries them.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, worker_cache

LIMIT, END = 2048, 0
CACHE = 1_000_000
GROUP_ROWS = 20_000

#: a run of letters that lower-casing and composition leave alone or map one to one, then ASCII marks
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
_CHUNK = re.compile(r"[^ \t\n\r]+")


class _Ids(dict):
    """chunk -> its ids as bytes. Tokens never span white space, so chunks are independent."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.cores: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, chunks: set[str]) -> None:
        """Encode unseen chunks, the plain ones' letters in one call."""
        if len(self) + len(chunks) > CACHE:
            self.clear()
        if len(self.cores) > CACHE:
            self.cores.clear()
        plain = {c: m.groups() for c in chunks if (m := _PLAIN.fullmatch(c))}
        # Marks with < or | could meet letters in a special token's spelling.
        plain = {c: (core.lower(), marks) for c, (core, marks) in plain.items() if "<" not in marks and "|" not in marks}
        fresh = list({core for core, _ in plain.values() if core not in self.cores})
        for i in range(0, len(fresh), 5000):
            part = fresh[i : i + 5000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(part):
                start = 0
                data = ids.tobytes()
                for core, end in zip(part, cut.tolist()):
                    self.cores[core] = data[4 * start : 4 * end]
                    start = end
            else:  # a word with an inner end: encode one by one
                self.cores.update((core, self.ids(core)) for core in part)
        for chunk in chunks:
            if chunk in plain:
                core, marks = plain[chunk]
                self[chunk] = self.cores[core] + (self.mark(marks) if marks else b"")
            else:
                self[chunk] = self.ids(chunk)

    def mark(self, marks: str) -> bytes:
        if marks not in self.cores:
            self.cores[marks] = self.ids(marks)
        return self.cores[marks]

    def __missing__(self, chunk: str) -> bytes:
        self.learn({chunk})
        return self[chunk]


def encode(text: str | None, path: str) -> bytes:
    """Little-endian 32-bit ids of a whole text, as the tokenizer gives them, with the end id."""
    held = worker_cache("packing")
    cache = held[path] if path in held else held.setdefault(path, _Ids(path))
    chunks = _CHUNK.findall(text or "")
    unseen = {c for c in chunks if c not in cache}
    if unseen:
        cache.learn(unseen)
    return b"".join(map(cache.__getitem__, chunks)) + END.to_bytes(4, "little")


def tokenised(docs: DataFrame, path: str, limit: int = LIMIT, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids)."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                data = encode(text, path)
                for k, at in enumerate(range(0, len(data), 4 * limit)):
                    part = data[at : at + 4 * limit]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<u4").astype(np.int64) if with_ids else None))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
            yield out if with_ids else out.drop(columns="ids")

    shape = "doc_id string, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    # As text, for pandas would turn ids beside a null one into floats.
    out = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(pieces, shape)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def fill(left: list[int], lengths: list[int], limit: int, two_fit: bool = True) -> list[int]:
    """One bin from the counts ``left`` by length; ``lengths`` are those with any left, ascending."""
    held: list[int] = []
    used: dict[int, int] = {}
    gap = limit
    free = lambda x: left[x] - used.get(x, 0)
    top = len(lengths)
    while True:
        i = min(top, bisect.bisect_right(lengths, gap)) - 1
        while i >= 0 and free(lengths[i]) <= 0:
            i -= 1
        if i < 0:
            break
        x = lengths[i]
        n = min(gap // x, free(x))
        held += [x] * n
        used[x] = used.get(x, 0) + n
        gap -= n * x
        top = i + 1
    if two_fit and gap and len(held) > 1:
        small = held[-1]
        wide, best, pair = gap + small, small, None
        lo, hi = 0, bisect.bisect_right(lengths, wide - 1) - 1
        while lo <= hi:
            a, b = lengths[lo], lengths[hi]
            if a + b > wide or free(b) < 1:
                hi -= 1
            elif free(a) < 1 or (lo == hi and free(a) < 2):
                lo += 1
            else:
                if a + b > best:
                    best, pair = a + b, (b, a)
                    if best == wide:
                        break
                lo += 1
        if pair:
            held[-1:] = pair
    return held


def plan(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from rank, to rank, first sequence, per sequence, offset) rows that place every piece.

    Replacing can cost a sequence when few pieces are left to choose from. Then it
    ends earlier: half the sequences of the greedy fill, a quarter and so on, until
    it costs none.
    """
    rows, n = _plan(histogram, limit, sum(histogram.values()))
    m = _plan(histogram, limit, 0)[1]
    replaced = m
    while n > m:
        replaced //= 2
        rows, n = _plan(histogram, limit, replaced)
    return rows


def _plan(histogram: dict[int, int], limit: int, replaced: int) -> tuple[list, int]:
    """The plan and its number of sequences, if the first ``replaced`` of them replace their smallest piece."""
    left = [0] * (limit + 1)
    for x, n in histogram.items():
        left[x] = n
    lengths = sorted(x for x, n in histogram.items() if n)
    taken = [0] * (limit + 1)
    rows, sequence = [], 0
    while lengths:
        held = fill(left, lengths, limit, sequence < replaced)
        need: dict[int, int] = {}
        for x in held:
            need[x] = need.get(x, 0) + 1
        times = min(left[x] // n for x, n in need.items())
        if sequence < replaced:
            times = min(times, replaced - sequence)
        offset = 0
        for x, n in sorted(need.items(), reverse=True):
            rows.append((x, taken[x], taken[x] + n * times, sequence, n, offset))
            taken[x] += n * times
            left[x] -= n * times
            offset += n * x
            if not left[x]:
                lengths.remove(x)
        sequence += times
    return rows, sequence


def pack(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``pieces`` (length from 1 to ``limit``, other columns) with sequence_id and offset, which replace columns of these names."""
    spark = pieces.sparkSession
    pieces = materialise(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    # Rows of the plan: fewer than a few for each length and pattern, whatever the number of pieces.
    placed = F.broadcast(spark.createDataFrame(plan(counts, limit), "__length long, __lo long, __hi long, __first long, __each long, __at long"))
    salts = max(1, -(-max(counts.values()) // GROUP_ROWS))
    # The row's own number parts pieces that are alike in everything; the table is written, so it stays what it is.
    salted = pieces.withColumn("__row", F.monotonically_increasing_id()).withColumn("__salt", F.pmod(F.xxhash64("__row"), F.lit(salts)))
    group = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    group = group.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).select("length", "__salt", "__before")
    rank = Window.partitionBy("length", "__salt").orderBy("__row")
    ranked = salted.withColumn("__rank", F.row_number().over(rank) - 1).join(group, ["length", "__salt"]).withColumn("__rank", F.col("__rank") + F.col("__before"))
    out = ranked.join(placed, (F.col("length") == F.col("__length")) & (F.col("__rank") >= F.col("__lo")) & (F.col("__rank") < F.col("__hi")))
    step = F.col("__rank") - F.col("__lo")
    return out.select(
        *[F.col(f"`{c}`") for c in pieces.columns if c not in ("sequence_id", "offset")],
        (F.col("__first") + F.floor(step / F.col("__each"))).cast("long").alias("sequence_id"),
        (F.col("__at") + F.pmod(step, F.col("__each")) * F.col("length")).cast("long").alias("offset"),
    )
