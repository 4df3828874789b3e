"""Toxicity scores behind noisy-channel deobfuscation.

1. A character language model: counts of three characters (64 classes, so a table
   of fixed size) over all documents, gathered by Spark.
2. Deobfuscation. A token that may be disguised - digits or signs among letters,
   letters repeated, single letters set apart - becomes a lattice: each position
   offers what it may stand for, at a channel cost. Viterbi under the language
   model picks the reading. Tokens that can be read one way only are left alone.
3. Scoring. Restored words give features (the word and its first letters); each
   feature's log odds come from document counts of labelled rows, combined by
   Spark. A word's evidence is its best feature's; a document's are its strongest
   words. A logistic model, fitted on leave-one-out evidence of a bounded sample
   of labelled rows (``FIT_ROWS``), turns them into a probability.

Learning uses labelled rows outside the held-out fold (crc32 of the id's text
mod 4 is 2). Labels, language, source and id are never inputs of a score.

Defined results. Null or empty text: scored as a text without words. A null id is
not held out. Labels that disagree on one id: the larger. No usable labels: every
score is 0. Rows that repeat are scored alike. Texts and tokens of any length are
read whole, in time linear in their length. An empty table gives no rows. Ties between
readings go to the larger string. Other columns, whatever their names, are ignored
(``drop_toxic`` carries them).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TABLE, added_up, in_parts, worker_cache

FIT_ROWS = 40_000  #: labelled documents that the classifier is fitted on, at most
CALIBRATION_ROWS = 20_000  #: of these, whose evidence the logistic model sees
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
BUCKETS = 1 << 18
PREFIXES = (3, 4, 5, 6)
STRENGTH = 6.0
CACHE = 20_000  #: readings of disguised tokens past which a task begins anew
SLICE = 1 << 20  #: characters of texts whose words are looked up together
LONG = 64  #: bytes of a word whose features are found with those of many others
TOP = 3

#: what a sign may stand for (fixed values)
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "*": "aeiou", "(": "c",
}
CHANNEL, COLLAPSE = -1.0, -0.5
EDGE = "!\"#%&'()*+,-./:;<=>?[\\]^`{|}~"  #: signs that _BARE takes off at either end
_BARE = re.compile(r"^[^\w@$]+|[^\w$]+$")
_SPACED = re.compile(r"(?<![\w@$])(?:[^\W_][ .\-_*]{1,2}){2,}[^\W_](?!\w)")
#: the end of every run that _SPACED finds, and little else: looked for first, as most texts hold none
_APART = re.compile(r"[ .\-_*][^\W_][ .\-_*]{1,2}[^\W_](?![^\W_])")
_REPEAT = re.compile(r"([^\W\d_])\1\1")
_LETTER = re.compile(r"[^\W\d_]")
_SIGN = re.compile(r"[0-9@$!|+*(]")


def _classes() -> np.ndarray:
    """Byte -> one of 64 classes: letters, digits, signs, the border between words, and folded high bytes."""
    out = np.zeros(256, np.int64)  # 0: border
    for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789@$!|+*("):
        out[ord(c)] = i + 1
    out[ord("A") : ord("Z") + 1] = out[ord("a") : ord("z") + 1]
    out[128:] = 44 + np.arange(128) % 20
    return out


CLASSES = _classes()
KINDS = bytes(CLASSES.tolist())  #: the same, for bytes.translate


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, out >> 1 ^ np.uint32(0xEDB88320), out >> 1)
    return out


CRC = _crc_table()  #: zlib's crc32, a byte at a time


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of class triples over every byte of every text."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_cache("toxicity")
        held = np.zeros(1 << 18, np.int64)
        codes: list[np.ndarray] = []
        n = 0

        def add() -> None:
            held[:] += np.bincount(np.concatenate(codes), minlength=1 << 18)
            codes.clear()

        for batch in batches:
            for text in batch["text"]:
                data = (text or "").encode("utf-8", "surrogatepass")
                for at in range(0, len(data), 1 << 20):
                    c = CLASSES[np.frombuffer(b"  " + data[max(0, at - 2) : at + (1 << 20)] + b" ", np.uint8)]
                    c = c[2:] if at else c
                    if len(c) > 2:
                        codes.append((c[:-2] << 12) | (c[1:-1] << 6) | c[2:])
                        n += len(c)
                    # The table is as long as many texts together, so these are counted at once.
                    if n > 1 << 18:
                        add()
                        n = 0
        if codes:
            add()
        if held.any():
            yield in_parts("triples", held)

    return added_up(docs.select("text").mapInPandas(count, TABLE)).get("triples", np.zeros(1 << 18, np.int64))


def language_model(counts: np.ndarray) -> np.ndarray:
    """log P(third | first two)."""
    c = counts.reshape(4096, 64) + 0.05
    return np.log(c / c.sum(1, keepdims=True)).astype(np.float32).reshape(-1)


class Restorer:
    """Reads disguised tokens by Viterbi over their lattice."""

    def __init__(self, model: np.ndarray) -> None:
        self.model = model
        self.held = memoryview(np.ascontiguousarray(model))  # gives plain floats
        self.read: dict[str, list[str]] = {}

    def lattice(self, token: str) -> Iterator[list[tuple[str, float]]]:
        i = 0
        while i < len(token):
            c, j = token[i], i
            while j < len(token) and token[j] == c:
                j += 1
            run = j - i
            if run >= 3 and _LETTER.match(c):
                yield [(c, COLLAPSE), (c + c, COLLAPSE), (c * min(run, 4), 0.0)]
            else:
                for _ in range(run):
                    yield [(c, 0.0)] + [(x, CHANNEL) for x in LEET.get(c, "")]
            i = j

    def best(self, token: str) -> tuple[str, float]:
        """The likeliest reading and its log probability with both borders.

        A state is the last two classes; it holds (the reading before, its last part),
        not a growing string, so the work is linear in the token's length.
        """
        held = self.held
        states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        for slot in chain(self.lattice(token), [[(" ", 0.0)]]):
            ways = [(out, cost, out.encode("utf-8", "surrogatepass").translate(KINDS)) for out, cost in slot]
            new: dict[int, tuple[float, tuple | None]] = {}
            for state, (score, said) in states.items():
                for out, cost, kinds in ways:
                    key, s = state, score + cost
                    for z in kinds:
                        triple = key << 6 | z
                        s += held[triple]
                        key = triple & 4095
                    if key not in new or s > new[key][0]:
                        new[key] = (s, (said, out))
            states = new
        score = max(s for s, _ in states.values())
        return max(self.reading(said) for s, said in states.values() if s == score).strip(), score

    @staticmethod
    def reading(said: tuple | None) -> str:
        out = []
        while said:
            said, last = said
            out.append(last)
        return "".join(reversed(out))

    def token(self, token: str) -> str:
        if _REPEAT.search(token) or (_SIGN.search(token) and _LETTER.search(token)):
            return self.best(token)[0]
        return token

    def spaced(self, run: str) -> str:
        """Letters set apart, joined where that is likelier than letters on their own; an outer one may stay alone."""
        letters = [c for c in run if c.isalnum()]
        alone = [self.best(c)[1] for c in letters]
        found = ("", sum(alone))
        for i in (0, 1):
            for j in (len(letters), len(letters) - 1):
                if j - i > 2:
                    joined, score = self.best("".join(letters[i:j]))
                    score += sum(alone[:i]) + sum(alone[j:])
                    if score > found[1]:
                        found = (joined, score)
        return found[0]

    def words(self, text: str) -> set[str]:
        """The distinct restored words of a text, lower-cased; longer letter runs are read as well."""
        return self.words_of([text.lower()])[0]

    def words_of(self, texts: list[str]) -> list[set[str]]:
        """``words`` of each of some lower-cased texts. A chunk that several hold is looked at once."""
        each = [chunks(t) for t in texts]
        others = disguised(set().union(*each))
        if len(self.read) > CACHE:
            self.read.clear()
        for c in others - self.read.keys():
            self.read[c] = self.chunk(c)
        for text, words in zip(texts, each):
            if found := words & others:
                words -= found
                words.update(chain.from_iterable(self.read[c] for c in found))
            for run in runs(text):
                words.update(parts(self.spaced(run)))
        return each

    def chunk(self, chunk: str) -> list[str]:
        """The words of one run of characters without blanks."""
        bare = chunk if chunk.isalpha() else _BARE.sub("", chunk)
        if bare.isalpha() and not _REPEAT.search(bare):
            return [bare]
        return parts(self.token(bare)) if bare else []


def chunks(text: str) -> set[str]:
    """The distinct runs of characters without blanks, without the signs around them."""
    return {c.strip(EDGE) for c in set(text.split())}


def disguised(those: set[str]) -> set[str]:
    """The chunks that may not be one word as it stands: all but letters alone, none three times in a row."""
    plain = [c for c in those if c.isalpha()]
    at = np.frombuffer(" ".join(plain).encode("utf-32-le"), np.uint32)
    thrice = np.flatnonzero((at[2:] == at[1:-1]) & (at[1:-1] == at[:-2]))
    return those.difference(plain) | {plain[i] for i in np.cumsum(at == 32)[thrice].tolist()}


def slices(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """The texts in lower case, in lists of about SLICE characters."""
    held: list[str] = []
    n = 0
    for text in texts:
        held.append((text or "").lower())
        n += len(held[-1])
        if n >= SLICE:
            yield held
            held, n = [], 0
    if held:
        yield held


def runs(text: str) -> list[str]:
    """The runs of letters set apart."""
    return [m.group() for m in _SPACED.finditer(text)] if _APART.search(text) else []


def parts(text: str) -> list[str]:
    return [p for p in re.split(r"[\W_]+", text) if p]


def features(word: str) -> list[int]:
    names = [word + "$"] + [word[:n] for n in PREFIXES if len(word) >= n]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in names]


def features_of(words: list[str]) -> np.ndarray:
    """``features`` of each of many words, a row a word; the first stands again where a word is too short for others."""
    coded = [w.encode("utf-8", "surrogatepass") + b"$" for w in words]
    size = np.fromiter(map(len, coded), np.int64, len(coded))
    out = np.full((len(coded), 1 + len(PREFIXES)), -1, np.int64)
    for i in np.flatnonzero(size > LONG).tolist():
        at = features(words[i])
        out[i, : len(at)] = at
    order = np.argsort(-size, kind="stable")
    order = order[size[order] <= LONG]  # long words first, so that those with a further byte stand in front
    start, size = (np.cumsum(size) - size)[order], size[order]
    data = np.frombuffer(b"".join(coded), np.uint8)
    crc, chars = np.full(len(order), 0xFFFFFFFF, np.uint32), np.zeros(len(order), np.int64)
    for j in range(size[0] if len(size) else 0):
        n = int(np.searchsorted(-size, -j))
        byte, held = data[start[:n] + j], crc[:n]
        begins = (byte & 0xC0) != 0x80
        if j <= 4 * PREFIXES[-1]:
            for k, length in enumerate(PREFIXES, 1):
                at = np.flatnonzero(begins & (chars[:n] == length))
                out[order[at], k] = (held[at] ^ 0xFFFFFFFF) % BUCKETS
        chars[:n] += begins
        crc[:n] = CRC[(held ^ byte) & 0xFF] ^ held >> 8
    out[order, 0] = (crc ^ 0xFFFFFFFF) % BUCKETS
    return np.where(out < 0, out[:, :1], out)


def rows_of(each: list[set[str]]) -> Iterator[np.ndarray]:
    """The rows of ``features_of`` of the words of each of some texts."""
    words = list(set().union(*each))
    table, index = features_of(words), {w: i for i, w in enumerate(words)}
    for found in each:
        yield table[np.fromiter(map(index.__getitem__, found), np.int64, len(found))]


def evidence(bad, seen, base: float):
    """Log odds of a feature against the base rate, shrunk towards it."""
    rate = (bad + STRENGTH * base) / (seen + STRENGTH)
    return np.log(rate / (1 - rate)) - np.log(base / (1 - base))


def summary(weights: list[float]) -> np.ndarray:
    """A document's evidence: its strongest words, how many are strong, how many there are."""
    strong = [w for w in weights if w > 2.0]
    top = sorted(strong if len(strong) >= TOP else weights, reverse=True)[:TOP] + [0.0] * TOP
    return np.array([1.0, *[max(0.0, x) for x in top[:TOP]], np.log1p(len(strong)), np.log1p(len(weights))])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights on ``x`` whose first column is 1; columns are centred, so the ridge leaves the base rate alone."""
    mean = np.r_[0.0, x[:, 1:].mean(0)]
    x = x - mean
    w, hold = np.zeros(x.shape[1]), ridge * np.r_[1e-6, np.ones(x.shape[1] - 1)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(hold)
        step = np.linalg.solve(h, x.T @ (y - p) - hold * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    w[0] -= mean @ w
    return w


class Scorer:
    def __init__(self, model, bad, seen, base, weights) -> None:
        self.restorer, self.base, self.weights = Restorer(model), base, weights
        self.table = evidence(bad, seen, base) if base else None

    def scores(self, texts: Iterable[str | None]) -> Iterator[float]:
        if self.table is None:
            yield from (0.0 for _ in texts)
            return
        for some in slices(texts):
            each = self.restorer.words_of(some)
            words = list(set().union(*each))
            known = dict(zip(words, self.table[features_of(words)].max(1).tolist()))
            for found in each:
                z = float(summary(list(map(known.__getitem__, found))) @ self.weights)
                yield float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def _fold(c: str):
    return F.pmod(F.crc32(F.col(c).cast("string")), F.lit(FOLDS))


def held_out(c: str = "doc_id"):
    return F.coalesce(_fold(c) == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """Language model, feature counts, base rate and weights; all of fixed size."""
    spark = docs.sparkSession
    model = language_model(trigram_counts(docs))
    sample = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS).toPandas()
    nothing = {"model": model, "bad": None, "seen": None, "base": 0.0, "weights": None}
    if not len(sample):
        return nothing
    shared = spark.sparkContext.broadcast(model)
    # FIT_ROWS rows of two numbers at most.
    known = F.broadcast(spark.createDataFrame([(int(a), int(b)) for a, b in sample.itertuples(index=False)], "doc_id long, label int"))
    rows = docs.select("doc_id", "text").join(known, "doc_id")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = Restorer(shared.value)
        bad, seen, n = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64), [0, 0]
        for batch in batches:
            labels = iter(batch["label"])
            for at, label in ((np.unique(rows), next(labels)) for some in slices(batch["text"]) for rows in rows_of(read.words_of(some))):
                seen[at] += 1
                n[1] += 1
                if label:
                    bad[at] += 1
                    n[0] += 1
        if n[1]:
            yield pd.concat([in_parts("bad", bad), in_parts("seen", seen), in_parts("n", np.array(n), 1)])

    got = added_up(rows.mapInPandas(count, TABLE))
    if not got:
        return nothing
    bad, seen = got["bad"], got["seen"]
    n_bad, n = got["n"].tolist()
    base = (n_bad + 0.5) / (n + 1)
    tables = spark.sparkContext.broadcast((bad, seen, base))

    def leave_one_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = Restorer(shared.value)
        bad, seen, base = tables.value
        for batch in batches:
            out, labels = [], iter(batch["label"])
            for at, label in ((rows, next(labels)) for some in slices(batch["text"]) for rows in rows_of(read.words_of(some))):
                each = evidence(bad[at] - (label > 0), seen[at] - 1, base)
                out.append(summary(each.max(1).tolist()).tolist())
            yield pd.DataFrame({"x": out, "label": batch["label"]})

    part = min(1.0, CALIBRATION_ROWS / max(1, len(sample)))
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1000)) < int(1000 * part))
    seen_rows = chosen.mapInPandas(leave_one_out, "x array<double>, label int").toPandas()  # about CALIBRATION_ROWS rows of six numbers
    if not len(seen_rows):
        return nothing
    x = np.array(seen_rows["x"].tolist())
    order = np.lexsort([*x.T, seen_rows["label"].to_numpy()])  # the same sums whatever the partitions' order
    weights = fit_logistic(x[order], (seen_rows["label"].to_numpy()[order] > 0).astype(float))
    return {"model": model, "bad": bad, "seen": seen, "base": base, "weights": weights}


def scored(docs: DataFrame, fitted: dict) -> DataFrame:
    """``docs`` with ``__score``."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        worker_cache("toxicity")
        scorer = Scorer(**shared.value)
        for texts in batches:
            yield pd.Series(list(scorer.scores(texts)), dtype="float64")

    return docs.withColumn("__score", score("text"))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the score does not reject, with their own columns."""
    return scored(docs, fit(docs, labels)).where(F.col("__score") < THRESHOLD).drop("__score")
