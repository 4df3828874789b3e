"""Words of many texts are looked up together: the same scores as word by word, in fewer steps."""

from __future__ import annotations

import random
import sys

import numpy as np

from tidemill.llm import toxicity


def fitted(seed=1):
    rng = np.random.default_rng(seed)
    seen = rng.integers(0, 40, toxicity.BUCKETS)
    bad = np.minimum(seen, rng.integers(0, 12, toxicity.BUCKETS))
    model = toxicity.language_model(rng.integers(0, 50, 1 << 18))
    return {"model": model, "bad": bad, "seen": seen, "base": 0.1, "weights": np.array([-4.0, 1.5, 1.0, 0.7, 0.6, -0.4])}


def odd_texts(n, seed=4):
    rng = random.Random(seed)
    bits = ["a", "b", "é", "4", "²", "_", "@", "$", "word", "aaa", "g0rp", "İß", "漢字", "\ud800", "Ünter", "x" * 70, "'", "!!", "."]
    ends = [" ", "  ", ".", "-", "_", "*", "- ", "\n", "\x1c", "", ""]
    return [None, ""] + ["".join(rng.choice(bits) + rng.choice(ends) for _ in range(rng.randrange(40))) for _ in range(n)]


def one_by_one(got, text):
    """The score from each word's features alone."""
    table, read, text = toxicity.evidence(got["bad"], got["seen"], got["base"]), toxicity.Restorer(got["model"]), (text or "").lower()
    words = {w for c in text.split() for w in read.chunk(c)}
    for m in toxicity._SPACED.finditer(text):
        words.update(toxicity.parts(read.spaced(m.group())))
    weights = [max(table[i] for i in toxicity.features(w)) for w in words]
    top = sorted([max(0.0, w) for w in weights], reverse=True)[: toxicity.TOP]
    x = [1.0, *top, *[0.0] * (toxicity.TOP - len(top)), np.log1p(sum(w > 2.0 for w in weights)), np.log1p(len(weights))]
    return 1 / (1 + np.exp(-np.clip(np.dot(x, got["weights"]), -30, 30)))


def test_scores_follow_from_each_word_alone(monkeypatch):
    got, texts = fitted(), odd_texts(600)
    expected = [one_by_one(got, t) for t in texts]
    for size, kept in ((1, 0), (300, 5), (1 << 20, 20_000)):
        monkeypatch.setattr(toxicity, "SLICE", size)
        monkeypatch.setattr(toxicity, "CACHE", kept)
        assert np.allclose(list(toxicity.Scorer(**got).scores(texts)), expected, rtol=0, atol=1e-12)


def test_features_of_many_words_are_those_of_each():
    words = sorted({w for t in odd_texts(300) for w in toxicity.Restorer(fitted()["model"]).words(t or "")} | {"a$b", "$", "", "漢" * 22, "é" * 63, "é" * 31 + "x"})
    for word, row in zip(words, toxicity.features_of(words).tolist()):
        found = toxicity.features(word)
        assert row == found + found[:1] * (1 + len(toxicity.PREFIXES) - len(found)), word
    assert toxicity.features_of([]).shape == (0, 1 + len(toxicity.PREFIXES))


def test_a_new_word_costs_few_steps():
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnop", k=9)) for _ in range(300)) for _ in range(20)]
    got, calls = toxicity.Scorer(**fitted()), 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        scores = list(got.scores(texts)) if hasattr(got, "scores") else [got.score(t) for t in texts]
    finally:
        sys.setprofile(None)
    assert len(scores) == 20
    assert calls < 8 * 300 * 20  # 5.8 a word; 29 when each was read and hashed on its own
