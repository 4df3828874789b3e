"""Learned operators against recomputation: every reading of a token, every count, EM over documents."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from tidemill.llm import quality, toxicity

DOC = "doc_id long, text string"


def readings(token):
    """(reading, channel cost) of every way to read a short token."""
    slots = []
    for m in re.finditer(r"(?s)(.)\1*", token):
        c, run = m.group(1), len(m.group())
        if run >= 3 and c.isalpha():
            slots.append([(c, toxicity.COLLAPSE), (2 * c, toxicity.COLLAPSE), (min(run, 4) * c, 0.0)])
        else:
            slots += run * [[(c, 0.0)] + [(x, toxicity.CHANNEL) for x in toxicity.LEET.get(c, "")]]
    for way in itertools.product(*slots):
        yield "".join(x for x, _ in way), sum(cost for _, cost in way)


def likelihood(model, reading):
    data = [0, 0, *(int(toxicity.CLASSES[b]) for b in reading.encode()), int(toxicity.CLASSES[32])]
    return sum(float(model[(x << 12) | (y << 6) | z]) for x, y, z in zip(data, data[1:], data[2:]))


@pytest.mark.parametrize("seed", range(4))
def test_viterbi_finds_the_best_of_all_readings(seed):
    rng = random.Random(seed)
    counts = np.random.default_rng(seed).integers(0, 50, 1 << 18)
    read = toxicity.Restorer(toxicity.language_model(counts))
    tokens = ["".join(rng.choice("abiot014*$|!é") * rng.choice((1, 1, 1, 2, 3, 5)) for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    for token in [t for t in tokens if t.count("*") < 4 and len(t) < 14]:
        scores: dict = {}
        for reading, cost in readings(token):
            score = cost + likelihood(read.model, reading)
            scores[reading] = max(score, scores.get(reading, -math.inf))
        found, score = read.best(token)
        assert math.isclose(score, max(scores.values()), abs_tol=1e-6), token
        assert math.isclose(scores[found], score, abs_tol=1e-6), token


def test_counts_of_classes_and_features_match_a_recount(spark):
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(30))) for _ in range(200)] + [None, "", "Été g0rp gorrrrp", "x" * 5000]
    d = spark.createDataFrame(list(enumerate(texts)) + [(None, "w1")], DOC).repartition(5)
    rows = [(i, rng.randrange(2)) for i in range(210)] + [(3, 1), (None, 1), (5, None)]
    got = toxicity.fit(d, spark.createDataFrame(rows, "doc_id long, toxic int"))
    counts = np.zeros(1 << 18, np.int64)
    for t in texts + ["w1"]:
        c = [0, 0, *(int(toxicity.CLASSES[b]) for b in (t or "").encode()), 0]
        for x, y, z in zip(c, c[1:], c[2:]):
            counts[(x << 12) | (y << 6) | z] += bool(t)
    assert np.array_equal(toxicity.trigram_counts(d), counts)
    assert np.array_equal(got["model"], toxicity.language_model(counts))
    marks: dict = {}
    for i, toxic in rows:
        if i is not None and toxic is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            marks[i] = max(toxic, marks.get(i, 0))
    read = toxicity.Restorer(got["model"])
    bad, seen, n = np.zeros(toxicity.BUCKETS, int), np.zeros(toxicity.BUCKETS, int), [0, 0]
    for i, toxic in marks.items():
        if i < len(texts):
            for at in {f for w in read.words(texts[i] or "") for f in toxicity.features(w)}:
                seen[at] += 1
                bad[at] += toxic
            n[0] += toxic
            n[1] += 1
    assert np.array_equal(got["bad"], bad) and np.array_equal(got["seen"], seen)
    assert got["base"] == (n[0] + 0.5) / (n[1] + 1)


def brute_em(votes):
    """The probability of each document (a row of votes) to be good, by EM over all documents."""
    shown = np.stack([votes == x for x in (-1, 0, 1)], 2).astype(float)  # document, rule, vote
    good = 1 / (1 + np.exp(-((votes == 1).sum(1) - (votes.shape[1] - 1.5) - 3 * (votes == -1).sum(1))))
    for _ in range(quality.ROUNDS):
        sides = []
        for weight in (good, 1 - good):
            extra = 0.001 * len(votes)
            seen = (shown * weight[:, None, None]).sum(0)
            sides.append((weight.sum() + extra, (seen + extra) / (weight.sum() + 3 * extra)))
        (a, p), (b, q) = sides
        z = math.log(a / b) + (shown * np.log(p / q)).sum((1, 2))
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return 1 / (1 + np.exp(-z))


def test_kept_documents_match_em_over_documents(spark):
    rng = random.Random(9)
    texts: list = [None, "", "one"]
    for i in range(300):
        n, words = rng.choice((20, 60, 150)), rng.choice((6, 60, 400))
        text = [rng.choice(("the", "of", "and", "in")) if rng.random() < 0.3 else f"w{rng.randrange(words)}" for _ in range(n)]
        if i % 5 == 0:
            text = [rng.choice(("#$%", "!!!", "LOUD")) if rng.random() < 0.5 else w for w in text]
        texts.append(rng.choice((". ", "\n", " ")).join(" ".join(text[k : k + 8]) for k in range(0, n, 8)))
    texts += texts[10:40]
    d = spark.createDataFrame(list(enumerate(texts)), DOC)
    got = {r.doc_id: r for r in quality.label_quality(d).collect()}
    held = {r.doc_id: r for r in quality.measured(d).collect()}
    want = brute_em(np.array([held[i].votes for i in range(len(texts))]))
    assert np.allclose([got[i].quality for i in range(len(texts))], want, atol=1e-6)
    kept = [not held[i].base_failed and want[i] >= 0.5 for i in range(len(texts))]
    assert [got[i].kept for i in range(len(texts))] == kept
    assert 20 < sum(kept) < len(texts) - 20
    assert sorted(r.doc_id for r in quality.keep_good(d).collect()) == [i for i, k in enumerate(kept) if k]
