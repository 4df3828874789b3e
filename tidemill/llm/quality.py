"""Quality by weak supervision, in DataFrame functions only.

Eight rules each vote that a document is good (1), bad (-1) or abstain (0).
Expectation-maximisation estimates, without labels, how often each rule votes
what on good and on bad documents; a document is kept on its posterior
probability of being good, not on passing every rule. EM needs only how many
documents show each vote pattern (at most 3**8 rows, whatever the input).

Defined results. A null text has no words and fails the base rules. Ids are only
carried. Rows that repeat count as often as they stand. With no documents the
prior alone decides nothing, for there is nothing to decide. Texts of any length
are measured whole. An empty table gives no rows. Equal texts get equal results.
Columns of other names are carried by ``keep_good`` and ignored by ``label_quality``.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

WORD = r"[^\x20\x09-\x0D]+"
MIN_WORDS, MAX_REPEAT = 50, 50
RULES = ("length", "symbols", "word_size", "lines", "repeats", "stop_words", "capitals", "sentences")
ROUNDS = 100
BITS = 24  #: of a window's number that hold its position; the others hold its hash
#: frequent function words of four languages (fixed values)
STOP_WORDS = "the of and to in is that it for with as was on be by die der das und ist von den mit nicht ein le la les de des et un une est pour que en el los las y del se por con no su".split()


def _repeat_words(words: Column, n: Column) -> Column:
    """Words covered by three-word windows that stand twice or more.

    Each window becomes one number, 39 bits of hash above ``BITS`` of position, so a
    sort brings equal windows together; neighbours that agree are compared word
    by word. Where two windows of one hash differ, or positions need more bits, the
    windows' own words are sorted instead, so the count is exact for every text.
    Covered words follow from the sorted positions of such windows.
    """
    at = lambda p: F.get(words, p)
    code = lambda i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(at(i), at(i + 1), at(i + 2)), BITS + 1), BITS).bitwiseOR(i.cast("long"))
    windows = F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), code))).otherwise(F.array().cast("array<long>"))
    place = lambda x: x.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")

    def same(x: Column, y: Column) -> Column:
        p, q = place(x), place(y)
        return (F.shiftright(x, BITS) == F.shiftright(y, BITS)) & (at(p) == at(q)) & (at(p + 1) == at(q + 1)) & (at(p + 2) == at(q + 2))

    def twice(held: Column) -> Column:
        return F.filter(held, lambda x, i: F.coalesce(same(x, F.get(held, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(held, i + 1)), F.lit(False)))

    def plain() -> Column:
        """Places by the words themselves, which hold no blanks."""
        rows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.concat_ws(" ", at(i), at(i + 1), at(i + 2)).alias("w"), i.alias("i")))
        rows = F.sort_array(rows)
        like = lambda x, y: F.coalesce(x["w"] == y["w"], F.lit(False))
        return F.sort_array(F.transform(F.filter(rows, lambda x, i: like(x, F.get(rows, i - 1)) | like(x, F.get(rows, i + 1))), lambda x: x["i"]))

    def places(held: Column) -> Column:
        clash = F.exists(F.transform(held, lambda x, i: (F.shiftright(x, BITS) == F.shiftright(F.get(held, i + 1), BITS)) & ~same(x, F.get(held, i + 1))), lambda x: F.coalesce(x, F.lit(False)))
        return F.when((n >= 3) & ((n >= 1 << BITS) | clash), plain()).otherwise(F.sort_array(F.transform(twice(held), place)))

    def covered(found: Column) -> Column:
        gaps = F.transform(found, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(found, i + 1) - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    return windows, places, covered


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the base measures (long) and ``votes`` (array of -1, 0, 1 by RULES)."""
    keep = docs.columns
    d = docs.withColumn("__text", F.coalesce("text", F.lit("")))
    d = d.withColumn("__words", F.regexp_extract_all("__text", F.lit(WORD), F.lit(0)))
    d = d.withColumn("n_words", F.size("__words").cast("long"))
    windows, places, covered = _repeat_words(F.col("__words"), F.size("__words"))
    d = d.withColumn("__windows", windows).withColumn("__found", places(F.col("__windows")))
    d = d.withColumn("__lines", F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumns(
        {
            "word_chars": (F.length("__text") - F.regexp_count("__text", F.lit(r"[\x20\x09-\x0D]"))).cast("long"),
            "n_symbols": F.regexp_count("__text", F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": covered(F.col("__found")),
            "n_capitals": F.regexp_count("__text", F.lit("[A-Z]")).cast("long"),
            "n_stops": F.regexp_count("__text", F.lit(r"[.?]")).cast("long"),
            "n_shouts": F.regexp_count("__text", F.lit("!")).cast("long"),
            "n_common": F.size(F.array_intersect("__words", F.array(*[F.lit(w) for w in STOP_WORDS]))).cast("long"),
        }
    )
    n = F.greatest(F.col("n_words"), F.lit(1).cast("long"))
    share = lambda c, of=n: F.col(c) / of

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    size = share("word_chars")
    votes = [
        vote(F.col("n_words") < MIN_WORDS, F.col("n_words") >= 80),
        vote(share("n_symbols") > 0.2, share("n_symbols") <= 0.02),
        vote((size < 2.5) | (size > 11), (size >= 3) & (size <= 9)),
        vote(F.col("n_dup_lines") * 10 > F.col("n_lines") * 3, (F.col("n_dup_lines") == 0) & (F.col("n_lines") >= 2)),
        vote(share("n_repeat_words") > 0.3, share("n_repeat_words") < 0.1),
        vote(F.col("n_common") < 2, (F.col("n_common") >= 5) | (F.col("n_common") * 20 >= F.col("n_words"))),
        vote(F.col("n_capitals") > 0.4 * F.col("word_chars"), F.col("n_capitals") < 0.15 * F.col("word_chars")),
        vote((share("n_shouts") > 0.2) | (F.col("n_stops") == 0), (share("n_stops") > 0.01) & (share("n_stops") < 0.4)),
    ]
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    d = d.withColumn("votes", F.array(*votes))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return d.withColumn("base_failed", failed).select(*[F.col(c) for c in keep if c not in (*measures, "votes", "base_failed")], *measures, "votes", "base_failed")


def accuracies(patterns: Counter) -> tuple[float, dict]:
    """(log prior odds, {(rule, vote): log odds of good}) by expectation-maximisation over vote patterns."""
    if not patterns:
        return 0.0, {}
    rules = range(len(RULES))
    # A document starts as good if nearly all rules say so; a bad vote is rare and starts heavy.
    start = lambda v: 1 / (1 + math.exp(-(v.count(1) - (len(RULES) - 1.5) - 3 * v.count(-1))))
    good = {v: start(v) for v in patterns}
    prior, odds = 0.0, {}
    for _ in range(ROUNDS):
        a = sum(n * good[v] for v, n in patterns.items())
        b = sum(n * (1 - good[v]) for v, n in patterns.items())
        # A share of the rows stands behind each estimate, so the smoothing is the same at every size.
        extra = 0.001 * (a + b)
        prior = math.log((a + extra) / (b + extra))
        odds = {}
        for r in rules:
            for x in (-1, 0, 1):
                ga = sum(n * good[v] for v, n in patterns.items() if v[r] == x)
                gb = sum(n * (1 - good[v]) for v, n in patterns.items() if v[r] == x)
                odds[r, x] = math.log((ga + extra) / (a + 3 * extra)) - math.log((gb + extra) / (b + 3 * extra))
        new = {v: 1 / (1 + math.exp(-max(-30.0, min(30.0, prior + sum(odds[r, v[r]] for r in rules))))) for v in patterns}
        if max((abs(new[v] - good[v]) for v in patterns), default=0) < 1e-9:
            break
        good = new
    return prior, odds


def posterior(metrics: DataFrame) -> Column:
    """The probability that a document is good, as an expression over ``votes``."""
    rows = metrics.groupBy("votes").agg(F.count("*").alias("n")).collect()  # 3 ** 8 patterns at most
    prior, odds = accuracies(Counter({tuple(r["votes"]): r["n"] for r in sorted(rows, key=lambda r: tuple(r["votes"]))}))
    z = F.lit(prior)
    for r in range(len(RULES)):
        v = F.get("votes", F.lit(r))
        z = z + F.when(v < 0, odds.get((r, -1), 0.0)).when(v > 0, odds.get((r, 1), 0.0)).otherwise(odds.get((r, 0), 0.0))
    return 1 / (1 + F.exp(-z))


def label_quality(docs: DataFrame) -> DataFrame:
    """doc_id, the base measures, base_failed, kept, quality."""
    m = materialise(measured(docs.select("doc_id", "text")).drop("text"), "quality")
    return m.withColumn("quality", posterior(m)).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5)).drop("votes")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns."""
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), "text")
    # Measured once and written with the documents; the votes are then read twice.
    m = materialise(measured(inner).select("__doc", "votes", "base_failed"), "votes")
    return m.where(~F.col("base_failed") & (posterior(m) >= 0.5)).select("__doc.*")
