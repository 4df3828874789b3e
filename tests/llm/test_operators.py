"""The training-data operators against brute force on small rows, odd ones among them."""

from __future__ import annotations

import itertools
import json
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import ann, chat, html_extract, jaccard_join, license_scan, packing, quality, sentencepiece_codec, sharding, toxicity
from tidemill.llm.license_texts import WHOLE
from tidemill.llm.queries import tokenizer_path

DOC = "doc_id long, text string, lang string, source string, n_chars long, n_words long, size long, label string"


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, 7, "x") for i, t in zip(ids, texts)], DOC)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# -- licence scan


def test_licence_scan_finds_every_base_place(spark):
    texts = [
        None,
        "",
        "nothing here",
        "CC BY, cc-by; the GNU General  Public LICENSE. All rights\nreserved all rights reserved",
        "general public",
        "x " * 3000 + "Licensed under the Apache License, Version 2.0.",
        "Permission is hereby granted, free of charge, to any other person obtaining a copy of this software and associated documentation files",
    ]
    got = {r.doc_id: r for r in license_scan.scan(docs(spark, texts)).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, t in enumerate(texts):
        words = word.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        places = [(p, label) for label, phrase in license_scan.BASE.items() for p in range(len(words)) if words[p : p + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert r.first_word == (min(places)[0] if places else None)
        assert r.last_word == (max(places)[0] if places else None)
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert 0 <= r.score <= 1
    assert got[5].labels == "apache-2.0" and got[5].score == 1.0
    assert got[6].labels == "mit"  # a word more, so the votes lie on two diagonals


def test_licence_scan_keeps_repeats_and_null_ids(spark):
    d = docs(spark, ["cc by me", "cc by me", "cc by me", "other"], [1, 1, None, 1])
    rows = sorted(((r.doc_id or -1, r.n_base) for r in license_scan.scan(d).collect()))
    assert rows == [(-1, 1), (1, 0), (1, 1), (1, 1)]
    assert license_scan.scan(d.limit(0)).count() == 0


def test_licence_scan_reads_whole_texts(spark):
    rng = random.Random(3)
    want = {"mit": "mit", "isc": "isc", "bsd-3-clause": "bsd,bsd-3-clause", "zlib": "zlib", "unlicense": "unlicense"}
    assert want.keys() == WHOLE.keys()
    texts, labels = [], []
    for name, text in WHOLE.items():
        words = text.split()
        damaged = words[:40] + ["so", "to", "say"] + words[40:]
        damaged[70:72] = ["foreign"]
        half = words[len(words) // 2 :]
        texts += [text, f"{prose(rng, 500)} {' '.join(damaged)} {prose(rng, 500)}", " ".join(half), " ".join(sorted(words))]
        labels += [want[name], want[name], None, None]
    got = {r.doc_id: r for r in license_scan.scan(docs(spark, texts)).collect()}
    for i, label in enumerate(labels):
        if label is not None:
            assert got[i].labels == label, texts[i][:80]
        else:
            assert not WHOLE.keys() & set(got[i].labels.split(",")), texts[i][:80]
    assert got[0].score == 1.0 and 0.75 <= got[1].score <= 1.0


# -- sentencepiece


def brute_viterbi(codec, text):
    best = [(0.0, [])]
    pieces = {p: i for i, p in codec.text.items()}
    for end in range(1, len(text) + 1):
        found = [(best[a][0] + codec.scores[pieces[text[a:end]]], best[a][1] + [pieces[text[a:end]]]) for a in range(max(0, end - 48), end) if text[a:end] in pieces]
        if not found:
            ids, s = codec.fallback(text[end - 1])
            found = [(best[end - 1][0] + s, best[end - 1][1] + list(ids))]
        best.append(max(found, key=lambda x: x[0]))
    return best[-1]


def test_sentencepiece_is_the_best_segmentation_and_round_trips(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    c = sentencepiece_codec.codec(path)
    for text in ("hello world", "Ünïcode ✓ 漢字", "aaaaabbbb  two blanks", " leading", "\n\tlines\n"):
        ids = np.frombuffer(c.encode(text), "<u4")
        want, _ = brute_viterbi(c, "▁" + text.replace(" ", "▁"))
        assert math.isclose(float(c.scores[ids].sum()), want, rel_tol=1e-9)
        assert c.decode(c.encode(text)) == text
    d = docs(spark, [None, "", "plain text", "plain text", "x" * 50_000])
    enc = sentencepiece_codec.encode(d, path)
    back = {r.doc_id: r for r in sentencepiece_codec.decode(enc, path).collect()}
    assert all(r.round_trip for r in back.values())
    assert [back[i].decoded for i in range(4)] == ["", "", "plain text", "plain text"]
    assert back[0].n_ids == 0


# -- toxicity


def toxic_corpus(n=400):
    rng = random.Random(3)
    texts, marks = [], []
    for i in range(n):
        words = prose(rng, 40).split()
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                words[rng.randrange(40)] = rng.choice(["gorplax", "zimbat", "flurgle"])
        texts.append(" ".join(words))
        marks.append(int(bad))
    return texts, marks


def test_toxicity_learns_and_reads_through_disguise(spark):
    texts, marks = toxic_corpus()
    d = docs(spark, texts + [None, "", "you g0rpl4x w1 w2", "you gorrrrplax w1 w2", "a g o r p l a x w2", "w1 w2 2024 3.5"])
    labels = spark.createDataFrame([(i, 1, m) for i, m in enumerate(marks)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(d, labels).collect()}
    for i, m in enumerate(marks):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    held = [i for i in range(len(marks)) if got[i].held_out]
    assert sum(got[i].predicted == marks[i] for i in held) >= 0.97 * len(held)
    n = len(texts)
    assert [got[n + k].predicted for k in range(6)] == [0, 0, 1, 1, 1, 0]
    assert all(0 <= r.score <= 1 for r in got.values())


def test_toxicity_reads_disguised_words_in_long_tokens(spark):
    texts, marks = toxic_corpus()
    clean = ",".join(f"w{i}" for i in range(30))
    extra = [f"{clean},g0rpl4x,z1mbat,{clean}", "g" + "o" * 80 + "rplax w1 w2", f"http://w1.w2/{'w3/' * 30}fl$rgle/g0rpl4x", clean]
    labels = spark.createDataFrame([(i, 1, m) for i, m in enumerate(marks)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.score_documents(docs(spark, texts + extra), labels).collect()}
    assert [got[len(texts) + k] for k in range(4)] == [1, 1, 1, 0]


def test_toxicity_viterbi_is_linear():
    import time

    read, took = toxicity.Restorer(np.zeros(1 << 18, np.float32)), []
    for n in (5_000, 20_000):
        began = time.process_time()
        assert read.best("a0" * n)[0] == "a0" * n
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0]


def test_toxicity_without_labels_scores_nothing(spark):
    d = docs(spark, ["a b", None])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.score_documents(d, none).collect()] == [0.0, 0.0]
    assert toxicity.drop_toxic(d, none).columns == d.columns
    assert toxicity.score_documents(d.limit(0), none).count() == 0


# -- quality rules


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, lines = set(), [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_measures_match_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", "one", "a b", "a b c", "a b c a b c", "x x x x x", "l1\nl1\n\n \nl1", "é#ü $5 %", "a a a b a a a", prose(rng, 300, 4), prose(rng, 120, 30)]
    texts += ["\t\x0bq\x0c r\r\n", "same line here\n" * 30, "🙂 🙂🙂 | <b>"]
    got = {r.doc_id: r for r in quality.label_quality(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], brute_quality(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality.keep_good(docs(spark, texts)).columns == docs(spark, texts).columns
    assert quality.label_quality(docs(spark, texts).limit(0)).count() == 0


def test_quality_counts_repeats_exactly_without_the_hash(spark, monkeypatch):
    """With positions of three bits or hashes of none every window is compared by its words."""
    rng = random.Random(6)
    texts = [prose(rng, n, v) for n in (3, 7, 8, 9, 40, 200) for v in (2, 5, 60)] + ["a b c", "a b c a b c a b", None]
    for bits in (3, 60):
        monkeypatch.setattr(quality, "BITS", bits)
        got = {r.doc_id: r.n_repeat_words for r in quality.label_quality(docs(spark, texts)).collect()}
        assert [got[i] for i in range(len(texts))] == [brute_quality(t)[4] for t in texts]


def test_quality_em_parts_good_from_bad():
    from collections import Counter

    good, bad = (1,) * 8, (1, -1, 0, 1, 1, 1, -1, -1)
    prior, odds = quality.accuracies(Counter({good: 900, bad: 100}))
    z = lambda v: prior + sum(odds[k, x] for k, x in enumerate(v))
    assert z(good) > 0 > z(bad)


# -- packing


def best_fit_decreasing(lengths, limit):
    gaps: list[int] = []
    for x in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= x]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - x)
        else:
            gaps.append(limit - x)
    return len(gaps)


def test_packing_places_every_token_once(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    rng = random.Random(1)
    texts = [None, "", "Hello, WORLD! it's 3.14", "a <|endoftext|> b", "É é ß İstanbul Σας", prose(rng, 3000)] + [prose(rng, rng.randrange(5, 400)) for _ in range(60)] * 2
    pieces = packing.tokenised(docs(spark, texts), path, with_ids=True)
    tok = Tokenizer.from_file(path)
    whole: dict = {}
    for r in pieces.collect():
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        whole.setdefault(r.doc_id, []).append((r.piece, r.start, list(r.ids)))
    for i, t in enumerate(texts):
        parts = sorted(whole[i])
        assert [x for p in parts for x in p[2]] == tok.encode(t or "", add_special_tokens=False).ids + [0]
        assert all(len(p[2]) == 2048 for p in parts[:-1])
    packed = packing.pack(packing.tokenised(docs(spark, texts), path)).collect()
    bins: dict = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= best_fit_decreasing([r.length for r in packed], 2048)
    assert packing.pack(packing.tokenised(docs(spark, texts).limit(0), path)).count() == 0


def test_replacing_never_costs_a_sequence():
    rng = random.Random(8)
    fewer = 0
    for _ in range(400):
        histogram: dict[int, int] = {}
        for _ in range(rng.randrange(1, 40)):
            x = rng.randrange(1, 60)
            histogram[x] = histogram.get(x, 0) + 1
        greedy = packing._plan(histogram, 60, 0)[1]
        rows = packing.plan(histogram, 60)
        used: dict[int, int] = {}
        places: dict[int, list] = {}
        for x, lo, hi, first, each, at in rows:
            for r in range(lo, hi):
                places.setdefault(x, []).append(r)
                q = first + (r - lo) // each
                used[q] = used.get(q, 0) + x
        assert {x: sorted(r) for x, r in places.items()} == {x: list(range(n)) for x, n in histogram.items()}
        assert max(used.values()) <= 60 and sorted(used) == list(range(len(used)))
        assert len(used) <= greedy
        fewer += packing._plan(histogram, 60, sum(histogram.values()))[1] > greedy
    assert fewer  # cases in which replacing had to end early


def test_best_two_fit_replaces_the_smallest():
    left = [0] * 11
    for x in (7, 2, 1):
        left[x] += 1
    left[2] += 0
    # 7 then 2 leaves 1, which 1 fills.
    assert sorted(packing.fill(left, [1, 2, 7], 10)) == [1, 2, 7]
    left = [0] * 11
    left[6] = left[3] = 1
    left[2] = 2
    # 6 and 3 leave 1; two twos fit the widened gap exactly.
    assert sorted(packing.fill(left, [2, 3, 6], 10)) == [2, 2, 6]


# -- html


def test_html_keeps_the_article_and_nothing_else(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><p>Site head</p></header><nav><ul><li>Menu</li></ul></nav>
    <div class="ad">Buy this now, a long advert that goes on and on for many words indeed.</div><article><h1>Head &amp; tail</h1><p>First   long paragraph with <b>bold</b> text
    that runs on for a while so that it is clearly content.<p>No.</p><script>var x="<p>no</p>"</script></article>
    <section id="comments"><p>Reader comment, quite long, with a lot of words in it to look like text.</p></section><footer>&copy; foot</footer></body></html>"""
    want = "Head & tail\nFirst long paragraph with bold text that runs on for a while so that it is clearly content.\nNo."
    d = spark.createDataFrame([(1, "u", page, "z"), (2, None, None, "z"), (3, "u", "", "z"), (None, "u", "plain & simple", "z"), (4, "u", "<p>a<p>b<div>c", "z")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_extract.extract_pages(d).collect()}
    assert got[1].text == want and got[1].n_chars == len(want)
    assert (got[2].text, got[3].text, got[None].text, got[4].text) == ("", "", "plain & simple", "a\nb\nc")


def test_html_articles_come_back_whatever_the_class_names():
    """Pages made around known articles: furniture with many class names, hints inside the article, bad declarations."""
    rng = random.Random(5)
    sentence = lambda n: prose(rng, n, 3000).capitalize() + "."
    names = ["sidebar", "site-footer", "ad", "ad-slot-3", "cookie-banner", "newsletter-signup", "related-posts", "share-buttons", "comment-list", "nav-main", "breadcrumbs", "social-links"]
    inner = ["share-price", "section-header", "related-work", "promo-history", "comment-on-law", "banner-making", "header-files"]
    for _ in range(60):
        title, blocks = sentence(5), [sentence(rng.randrange(25, 80)) for _ in range(rng.randrange(3, 8))]
        body = [f"<h1 class='{rng.choice(inner)}'>{title}</h1>"]
        for b in blocks:
            body.append(rng.choice([f"<p>{b}", f"<p>{b}</p>", f"<div class='{rng.choice(inner)}'>{b}</div>", f"<![if !IE]><p class='x'>{b}</p><![endif]>"]))
            if rng.random() < 0.4:
                body.append(f"<div class='{rng.choice(names)}'><p>{sentence(rng.randrange(3, 40))}</p></div>")
        around = lambda: f"<div id='{rng.choice(names)}'><p>{sentence(rng.randrange(3, 30))}</p></div>"
        page = f"<html><body><nav><a href='/'>Home</a></nav>{around()}<article>{''.join(body)}</article>{around()}<footer>&copy; 2020 us</footer></body></html>"
        assert html_extract.extract(page) == "\n".join([title, *blocks])


def test_html_loses_no_text_and_finds_none_where_none_is():
    assert html_extract.extract("<p>hello world text</p><![foo[ x ]]><p>after text stays</p>") == "hello world text\nafter text stays"
    assert html_extract.extract("<nav><a>x</a></nav><div>© 2020 Home About</div>") == ""
    assert html_extract.extract("<font>" * 20_000 + "a<p>b" * 200).count("a") == 200
    long = " ".join(f"w{i}" for i in range(200_000))
    assert html_extract.extract(f"<article><p>{long}</p></article>") == long


# -- jaccard join


def brute_components(texts):
    sets = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            label[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def test_jaccard_components_match_brute_force(spark):
    rng = random.Random(11)
    texts = [None, "", "  \t", "two words", "Two WORDS", "a b c d e", "a b c d e f"]
    shared = prose(rng, 60, 10_000)
    for _ in range(12):
        base = prose(rng, rng.randrange(30, 250), 10_000).split()
        for k in range(rng.randrange(2, 7)):
            words = list(base)
            for _ in range(rng.randrange(0, 1 + len(words) // 30)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(words[rng.randrange(0, 3) :]))
    texts += [prose(rng, 40, 10_000) + " " + shared for _ in range(12)] + [shared] * 3
    # A chain: neighbours are near, ends are not.
    chain = prose(rng, 200, 10_000).split()
    for k in range(8):
        texts.append(" ".join(chain[6 * k : 6 * k + 150]))
    order = list(range(len(texts)))
    got = {r.doc_id: r for r in jaccard_join.join(docs(spark, texts, order)).collect()}
    want, sizes = brute_components(texts)
    assert [got[i].n_shingles for i in order] == sizes
    assert [got[i].component_id for i in order] == want
    kept = jaccard_join.keep_one(docs(spark, texts, order))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))
    assert kept.columns == docs(spark, texts, order).columns


def test_jaccard_links_within_a_component_are_counted(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PART", 4)
    rng = random.Random(21)
    base = prose(rng, 300, 10_000).split()
    texts = [" ".join(base[: 290 + k]) for k in range(10)] + [prose(rng, 80, 10_000)] * 2 + [None]
    # A chain: neighbours are near, ends are not.
    chain = prose(rng, 200, 10_000).split()
    texts += [" ".join(chain[8 * k : 8 * k + 150]) for k in range(6)]
    words = [t.split() if t else [] for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in words]
    first = [sets.index(x) for x in sets]
    want = {(a, b) for a, b in itertools.combinations(sorted(set(first)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    d = docs(spark, texts)
    assert {(r.a, r.b) for r in jaccard_join.links(d).collect()} == want
    got = {r.doc_id: r.n_links for r in jaccard_join.join(d, count_links=True).collect()}
    assert [got[i] for i in range(len(texts))] == [sum(first[i] in p for p in want) for i in range(len(texts))]
    assert "n_links" not in jaccard_join.join(d).columns


def test_jaccard_levels_rings_and_parts_match_brute_force(spark, monkeypatch):
    """Tiny regions and parts, so that every level, ring and part does work; one common line in all, two large unlike groups."""
    for name, value in (("REGION", 3), ("PART", 4), ("LEVELS", 3)):
        monkeypatch.setattr(jaccard_join, name, value)
    rng = random.Random(33)
    line = prose(rng, 12, 10_000)
    texts = []
    for _ in range(2):
        base = prose(rng, 120, 10_000).split()
        for k in range(25):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 4, 8])):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(words) + " " + line)
    texts += [prose(rng, rng.randrange(5, 60), 10_000) + " " + line for _ in range(20)]
    # Distances of just 0.2 and more about one text, for the rings' borders.
    words = prose(rng, 104, 10_000).split()
    texts += [" ".join(words[:k]) for k in (104, 84, 68, 56, 45, 44, 37, 31, 24, 20)]
    got = {r.doc_id: r.component_id for r in jaccard_join.join(docs(spark, texts)).collect()}
    want, _ = brute_components(texts)
    assert [got[i] for i in range(len(texts))] == want


def test_jaccard_open_pairs_skip_two_guests_and_small_rests(spark):
    rows = [(7, 1, 20, 0, 0), (7, 2, 20, 0, 1), (7, 3, 20, 0, 1), (7, 4, 20, 9, 0), (7, 5, 10, 0, 0)]
    members = spark.createDataFrame(rows, "region long, id long, n long, place int, guest int")
    pairs = sorted((r.a, r.b) for r in jaccard_join._open_pairs(members, None).collect())
    assert pairs == [(1, 2), (1, 3)]  # 2 and 3 meet at home, 4 holds too few from there on, 5 is too small


def test_jaccard_odd_rows(spark):
    d = docs(spark, ["a b c d e f", "a b c d e f", "a b c d e f", None], [5, 5, None, 7])
    rows = sorted((r.doc_id or -1, r.component_id or -1) for r in jaccard_join.join(d).collect())
    assert rows == [(-1, -1), (5, 5), (5, 5), (7, 7)]
    assert jaccard_join.join(d.limit(0)).count() == 0


def test_parity_bitmaps_never_exceed_the_difference():
    rng = np.random.default_rng(0)
    for size in (1, 3, 40, 200, 900):
        a, b = (np.unique(rng.integers(0, 3 * size, size).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        b = b[: rng.integers(1, len(b) + 1)]
        gap = jaccard_join.apart_at_least(jaccard_join.bitmap(a), jaccard_join.bitmap(b))
        assert gap <= len(np.setxor1d(a, b))


def test_jaccard_keeps_one_row_of_repeated_ids_whatever_the_order(spark):
    """Rows of one id with different texts stand for themselves; of rows alike the smallest stays."""
    rows = [(1, "a b c d e f", "de", "s"), (1, "a b c d e f", "en", "s"), (1, "other words that stand here", "en", "s"), (2, "a b c d e f", "aa", "s"), (3, "", "en", "s")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want = {(1, "a b c d e f", "de"), (1, "other words that stand here", "en"), (3, "", "en")}
    for frame in (d, d.orderBy(F.desc("lang")).repartition(3)):
        assert {(r.doc_id, r.text, r.lang) for r in jaccard_join.keep_one(frame).collect()} == want


def test_long_texts_hash_the_same_in_pieces(monkeypatch):
    text = prose(random.Random(2), 5000)
    whole = jaccard_join.shingle_set(text)
    monkeypatch.setattr(jaccard_join, "CHUNK", 1000)
    assert np.array_equal(whole, jaccard_join.shingle_set(text))


# -- nearest neighbours


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1200, 16)).astype(np.float32)
    x[300] = x[200]
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(1200)]
    rows += [(5000, None, 0), (5100, [0.0] * 16, 0), (5200, [float("nan")] * 16, 0), (None, [1.0] * 16, 0), (5300, [None] * 16, 0)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    x = x.astype(np.float64)
    hits = total = 0
    for q in range(0, 1200, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(1200), d))[:10]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 11))
        assert all(math.isclose(r.score, d[r.vec_id], rel_tol=1e-12) for r in mine)
        hits += len({r.vec_id for r in mine} & set(want))
        total += 10
    assert hits >= 0.9 * total
    assert {r.query_id for r in got} == set(range(0, 1200, 100))
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert ann.search(empty).count() == 0


def test_nearest_neighbours_in_groups_of_near_copies(spark):
    """Above the size of one block, with near copies that no code tells apart and one vector far out."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(20_000, 64))
    x[:2000] = x[0] + 0.008 * rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[19_999] *= 1000
    x = x.astype(np.float32)
    got = ann.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), every=500).collect()
    x = x.astype(np.float64)
    recall = []
    for q in range(0, 20_000, 500):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 11))
        assert all(math.isclose(r.score, d[r.vec_id], rel_tol=1e-12) for r in mine)
        recall.append(len({r.vec_id for r in mine} & set(np.argsort(d)[:10].tolist())) / 10)
    print("recall@10: near copies", np.mean(recall[:10]), "others", np.mean(recall[10:]))
    assert np.mean(recall[:10]) >= 0.9 and np.mean(recall[10:]) >= 0.9


@pytest.mark.parametrize("clusters", [0, 300])
def test_queries_meet_their_blocks_only(spark, clusters):
    """Distances fall where vectors lie in clusters; recall holds with and without."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 32))
    if clusters:
        x = rng.normal(size=(clusters, 32))[rng.integers(0, clusters, 6000)] + 0.1 * x
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    queries, candidates = ann.meetings(ann.indexed(d), 100)
    spot = ["curve", "block", "chunk", "part"]
    met = queries.groupBy(spot).count().join(candidates.groupBy(spot).agg(F.count("*").alias("rows")), spot).agg(F.sum(F.col("count") * F.col("rows"))).first()[0]
    got: dict = {}
    for r in ann.search(d).collect():
        got.setdefault(r.query_id, []).append(r)
    recall = []
    for q in range(0, 6000, 100):
        far = np.sqrt(np.square(x - x[q]).sum(1))
        far[q] = np.inf
        assert [r.rank for r in sorted(got[q], key=lambda r: r.rank)] == list(range(1, 11))
        assert all(r.score == far[r.vec_id] for r in got[q])
        recall.append(len({r.vec_id for r in got[q]} & set(np.argsort(far)[:10].tolist())) / 10)
    print("clusters", clusters, "share of a full search", met / (60 * 6000), "recall@10", np.mean(recall))
    assert np.mean(recall) >= 0.9
    assert not clusters or met < 0.4 * 60 * 6000


def test_a_common_vector_is_dealt_over_chunks(spark, monkeypatch):
    """A third of all rows are one vector, some rows repeat, one id has several vectors; nothing is lost."""
    monkeypatch.setattr(ann, "GROUP_ROWS", 50)
    monkeypatch.setattr(ann, "QUERY_ROWS", 3)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 8))
    x[::3] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1, x[1].tolist())] * 40 + [(1, x[2].tolist())]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    _, candidates = ann.meetings(ann.indexed(d), 10)
    sizes = candidates.groupBy("curve", "block", "chunk", "part").count()
    assert sizes.agg(F.max("count")).first()[0] < 100
    got: dict = {}
    for r in ann.search(d, every=10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == set(range(0, 900, 10))
    for q in range(0, 900, 30):
        want = [i for i in range(0, 900, 3) if i != q][:10]
        assert [(r.vec_id, r.score) for r in got[q]] == [(i, 0.0) for i in want]
    for q in got:
        assert len({(r.vec_id, r.score) for r in got[q]}) == 10
    none = d.where("vec_id % 10 <> 0")
    assert ann.search(none, every=10).count() == 0


def test_hilbert_neighbours_are_adjacent():
    cells = np.array(list(itertools.product(range(8), repeat=2)))
    order = cells[np.argsort(ann.hilbert_keys(cells, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


# -- sharding


def test_transfers_move_as_few_as_any_level_assignment():
    """Blocks of one byte: every assignment is tried, and the fewest moved bytes among level ones are met."""
    rng = random.Random(1)
    for old, new in ((3, 2), (2, 3), (3, 3), (2, 2), (1, 3)):
        for _ in range(40):
            blocks = [(k, rng.randrange(old), 1) for k in range(rng.randrange(1, 8))]
            owner = sharding.transfers(blocks, new)
            level = lambda held: max(held.count(i) for i in range(new)) - min(held.count(i) for i in range(new)) <= 1
            assert level([owner[k] for k, _, _ in blocks])
            best = min(sum(a != s for a, (_, s, _) in zip(held, blocks)) for held in itertools.product(range(new), repeat=len(blocks)) if level(held))
            assert sum(owner[k] != s for k, s, _ in blocks) == best


def test_transfers_level_around_one_huge_block():
    rng = random.Random(2)
    blocks = [(k, k % 16, rng.randrange(80, 120)) for k in range(4096)] + [(4096, 3, 200_000)]
    owner = sharding.transfers(blocks, 24)
    held = [0] * 24
    for k, _, b in blocks:
        held[owner[k]] += b
    assert sorted(held)[-1] == 200_000 and sorted(held)[-2] - sorted(held)[0] < 120
    capacity, alone = sharding.capacities(blocks, 24)
    before = [0] * 24
    for k, s, b in blocks:
        before[alone.get(k, s)] += b
    least = sum(x[2] for x in sharding.flow(before, capacity))
    assert sum(b for k, s, b in blocks if owner[k] != s) < 1.03 * least + sum(b for k, s, b in blocks if k in alone and alone[k] != s)


def test_rows_alike_are_spread_and_written_once(spark, tmp_path):
    """A third of the rows are one row, null in id and text; the touched shards hold each row as often as it stands."""
    d = docs(spark, ["a text", None, "b text " * 9] * 200, [1, None, 3] * 200)
    d = d.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(16)).cast("int"))
    placed = sharding.reshard(d, F.col("shard"))
    where = placed.collect()
    sizes = [sum(r.size for r in where if r.shard == i) for i in range(24)]
    assert max(sizes) - min(sizes) <= 75 and len({r.shard for r in where if r.doc_id is None}) > 12
    sharding.rewrite(d, placed, f"file://{tmp_path}/out")
    touched = {k for r in where if r.old_shard != r.shard for k in (r.old_shard, r.shard)}
    rows = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert sorted((r.shard, r.slot) for r in rows) == sorted((r.shard, r.slot) for r in where if r.shard in touched)


def test_sharding_is_even_gapless_and_moves_little(spark):
    rng = random.Random(8)
    texts = [None, "", "é"] + [prose(rng, rng.randrange(1, 60)) for _ in range(3000)] + ["same"] * 500
    got = sharding.reshard(docs(spark, texts), sharding.by_id()).collect()
    assert len(got) == len(texts)
    bytes_of, slots, moved = {}, {}, 0
    for r in got:
        t = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(t) + 8, zlib.crc32(t))
        bytes_of[r.shard] = bytes_of.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
        moved += r.size * (r.shard != r.old_shard)
    assert set(bytes_of) == set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(bytes_of.values()) / 24
    assert max(abs(b - mean) for b in bytes_of.values()) < 0.05 * mean
    # Sixteen even shards give a third of what they hold to eight new ones.
    assert moved < 0.4 * mean * 24
    assert sharding.reshard(docs(spark, texts).limit(0), sharding.by_id()).count() == 0


def test_rewrite_writes_null_and_repeated_ids_once(spark, tmp_path):
    rng = random.Random(9)
    texts = [prose(rng, rng.randrange(1, 60)) for _ in range(1500)] + ["same"] * 5 + [None, ""] * 3
    ids = [None if i % 7 == 0 else i // 3 for i in range(1500)] + [4, 4, 4, None, None] + [None, None, 4, 4, 4, 4]
    d = docs(spark, texts, ids)
    placed = sharding.reshard(d, sharding.by_id())
    sharding.rewrite(d, placed, f"file://{tmp_path}/out")
    where = placed.collect()
    touched = {k for r in where if r.old_shard != r.shard for k in (r.old_shard, r.shard)}
    want = sorted((r.shard, r.slot, -1 if r.doc_id is None else r.doc_id, r.text_crc32) for r in where if r.shard in touched)
    out = spark.read.parquet(f"file://{tmp_path}/out")
    assert out.columns == [*d.columns, "slot", "shard"]
    rows = out.collect()
    assert sorted((r.shard, r.slot, -1 if r.doc_id is None else r.doc_id, zlib.crc32((r.text or "").encode())) for r in rows) == want
    if touched == set(range(24)):
        assert sorted((str(r.doc_id), str(r.text)) for r in rows) == sorted((str(i), str(t)) for i, t in zip(ids, texts))


def test_flow_moves_just_the_surplus():
    moves = sharding.flow([10, 4, 0], [5, 5, 4])
    assert sum(m[2] for m in moves) == 5 and {m[0] for m in moves} == {0}


# -- chat


def test_chat_links_calls_to_results(spark):
    rows = [
        (1, 0, "system", '{"tools":[{"name":"f","required":["a"],"properties":{"a":"int","b":"int"}}]}'),
        (1, 1, "user", 'say "hi"\n'),
        (1, 2, "assistant", '{"tool_calls":[{"id":"x","name":"f","arguments":{"a":1}},{"id":"y","name":"f","arguments":{"c":1}},{"id":"z","name":"g","arguments":{}}],"content":"wait"}'),
        (1, 3, "tool", '{"tool_call_id":"x","content":"42"}'),
        (1, 4, "tool", '{"tool_call_id":"lost","content":"?"}'),
        (2, 0, "tool", '{"tool_call_id":"late","content":"early"}'),
        (2, 1, "assistant", '{"tool_calls":[{"id":"late","name":"f","arguments":{}}]}'),
        (None, 0, None, None),
    ]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_turns(d).orderBy("conv_id", "order_key").collect()
    one = [r for r in got if r.conv_id == 1]
    (asked,) = [r for r in one if r.role == "assistant"]
    calls = {c.call_id: (c.linked, c.valid) for c in asked.calls}
    assert (asked.linked, asked.valid) == (False, False)
    assert asked.message == (
        '{"content":"wait","role":"assistant","tool_calls":[{"arguments":{"a":1},"id":"x","name":"f"},'
        '{"arguments":{"c":1},"id":"y","name":"f"},{"arguments":{},"id":"z","name":"g"}]}'
    )
    assert calls == {"x": (True, True), "y": (False, False), "z": (False, False)}
    assert {r.call_id: r.linked for r in one if r.role == "tool"} == {"x": True, "lost": False}
    assert one[1].message == '{"content":"say \\"hi\\"\\n","role":"user"}'
    assert [r.role for r in got if r.conv_id == 2] == ["assistant", "tool"]
    none = [r for r in got if r.conv_id is None]
    assert none[0].message == '{"content":"","role":"user"}'


def test_chat_links_match_a_brute_force_linker(spark):
    """Made conversations with repeated ids, lost results, negative turns and tools declared twice."""
    rng = random.Random(8)
    rows = []
    for conv in [None, *range(12)]:
        for turn in range(-4, 14):
            kind = rng.choice(["assistant", "tool", "user", "system"])
            if kind == "assistant":
                calls = [{"id": f"c{rng.randrange(6)}", "name": rng.choice("fgh"), "arguments": {rng.choice("ab"): rng.choice([1, "x"])}} for _ in range(rng.randrange(1, 4))]
                text = json.dumps({"tool_calls": calls})
            elif kind == "tool":
                text = json.dumps({"tool_call_id": f"c{rng.randrange(8)}", "content": "r"})
            elif kind == "system":
                text = json.dumps({"tools": [{"name": rng.choice("fg"), "required": ["a"], "properties": {"a": rng.choice(["int", "string"])}}]})
            else:
                text = "hello"
            rows.append((conv, turn, kind, text))
    want = []
    for conv in {r[0] for r in rows}:
        here = [(t, k, json.loads(x)) for c, t, k, x in rows if c == conv and k != "user"]
        kits: dict = {}
        for _, k, x in here:
            for tool in x["tools"] if k == "system" else []:
                kits.setdefault(tool["name"], tool)
        first: dict = {}
        for t, k, x in here:
            for at, call in enumerate(x["tool_calls"] if k == "assistant" else []):
                first.setdefault(call["id"], (t, at))
        asked = {x["tool_call_id"] for _, k, x in here if k == "tool"}
        for t, k, x in here:
            if k == "assistant":
                for at, call in enumerate(x["tool_calls"]):
                    kit, args = kits.get(call["name"]), call["arguments"]
                    kinds = {"int": int, "string": str}
                    valid = kit is not None and set(args) == {"a"} and isinstance(args["a"], kinds[kit["properties"]["a"]])
                    want.append((conv, t, "assistant", call["id"], first[call["id"]] == (t, at) and call["id"] in asked, valid))
            elif k == "tool":
                want.append((conv, t, "tool", x["tool_call_id"], x["tool_call_id"] in first, None))
    rng.shuffle(rows)
    out = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    got = [(r.conv_id, r.turn, r.role, r.call_id, r.linked, None) for r in out if r.role == "tool"]
    got += [(r.conv_id, r.turn, r.role, *c) for r in out for c in r.calls or []]
    assert len(out) == len(rows)
    for r in out:
        if r.calls:
            assert (r.linked, r.valid) == (all(c.linked for c in r.calls), all(c.valid for c in r.calls))
            assert [c["id"] for c in json.loads(r.message)["tool_calls"]] == [c.call_id for c in r.calls]
    assert sorted(map(str, got)) == sorted(map(str, want))
    # A result comes after its call, and all else in the order of turns.
    for conv in {r.conv_id for r in out}:
        mine = sorted((r for r in out if r.conv_id == conv), key=lambda r: r.order_key)
        place = {}
        for i, r in enumerate(mine):
            place |= {c.call_id: i for c in r.calls or [] if c.linked}
        assert all(place[r.call_id] < i for i, r in enumerate(mine) if r.role == "tool" and r.linked)
        plain = [r.turn for r in mine if r.role == "user"]
        assert plain == sorted(plain)


def test_chat_checks_types_and_sorts_arguments(spark):
    kit = {
        "tools": [
            {"name": "f", "required": ["a"], "properties": {"a": "int", "s": {"type": "string"}, "o": {"type": ["object", "null"]}, "l": "list", "n": "number", "w": "date"}},
            {"name": "free"},
        ]
    }
    cases = [
        ("f", {"a": 1}, '{"a":1}', True),
        ("f", {"a": "text"}, '{"a":"text"}', False),
        ("f", {"a": 1.5}, '{"a":1.5}', False),
        ("f", {"s": "x", "a": 2}, '{"a":2,"s":"x"}', True),
        ("f", {"s": 3, "a": 2}, '{"a":2,"s":3}', False),
        ("f", {"o": {"z": [{"y": None, "b": True}], "c": "é"}, "a": 2}, '{"a":2,"o":{"c":"é","z":[{"b":true,"y":null}]}}', True),
        ("f", {"o": None, "a": 2, "w": "2020", "n": 1, "l": []}, '{"a":2,"l":[],"n":1,"o":null,"w":"2020"}', True),
        ("f", {"a": 2, "l": {}}, '{"a":2,"l":{}}', False),
        ("f", '{ "s": "q",  "a": 7 }', '{"a":7,"s":"q"}', True),
        ("f", 'say "a"', '"say \\"a\\""', False),
        ("f", '{"a":1} x', '"{\\"a\\":1} x"', False),
        ("f", '{"a":1}] x [1', '"{\\"a\\":1}] x [1"', False),
        ("f", '{"a":1},{"a":2}', '"{\\"a\\":1},{\\"a\\":2}"', False),
        ("f", "", '""', False),
        ("f", [1, 2], "[1,2]", False),
        ("f", None, "null", False),
        ("free", {"b": 1, "a": "x"}, '{"a":"x","b":1}', True),
    ]
    calls = [{"id": str(i), "name": n, "arguments": a} for i, (n, a, _, _) in enumerate(cases)]
    rows = [(1, 0, "system", json.dumps(kit)), (1, 1, "assistant", json.dumps({"tool_calls": calls}))]
    (r,) = [r for r in chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect() if r.calls]
    told = ",".join(f'{{"arguments":{want},"id":"{i}","name":"{name}"}}' for i, (name, _, want, _) in enumerate(cases))
    assert r.message == f'{{"content":"","role":"assistant","tool_calls":[{told}]}}'
    assert json.loads(r.message) and [c.call_id for c in r.calls] == [str(i) for i in range(len(cases))]
    assert [c.valid for c in r.calls] == [valid for *_, valid in cases]


def test_chat_odd_rows(spark, monkeypatch):
    """Empty tables, a very long text, a turn that repeats often, columns whose names clash."""
    monkeypatch.setattr(chat, "COPIES", 7)
    shape = "conv_id long, turn long, role string, text string, message int, call_id int, calls int, key int, copies int, piece int, said int"
    assert chat.format_turns(spark.createDataFrame([], shape)).count() == 0
    ask = json.dumps({"content": "é" * 300_000, "tool_calls": [{"id": "x", "name": "f", "arguments": {}}, {"id": None, "name": None, "arguments": None}]}, ensure_ascii=False)
    rows = [(1, 1, "assistant", ask)] * 40 + [(1, 1, "assistant", ask.replace("é", "e")), (1, None, "tool", '{"tool_call_id":"x","content":"' + "y" * 200_000 + '"}'), (None, 3, "user", "a" * 500_000)]
    rows += [(2, 1, "assistant", '{"tool_calls":[]}'), (2, 1, "assistant", "[]"), (2, 2, "tool", None)]
    got = chat.format_turns(spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6, 7) for r in rows], shape)).collect()
    assert len(got) == len(rows)
    asked = [r for r in got if r.calls]
    assert len(asked) == 41 and len({r.message for r in asked}) == 2
    assert all([tuple(c) for c in r.calls] == [("x", True, False), (None, False, False)] for r in asked)
    assert json.loads(asked[0].message)["tool_calls"][1] == {"arguments": None, "id": "", "name": ""}
    assert [len(json.loads(r.message)["content"]) for r in got if r.conv_id == 1 and r.role == "tool"] == [200_000]
    assert {r.message for r in got if r.conv_id == 2 and r.role == "assistant"} == {'{"content":"{\\"tool_calls\\":[]}","role":"assistant"}', '{"content":"[]","role":"assistant"}'}


@pytest.mark.parametrize("name", ["op1_license_scan", "op4_quality_rules", "op9_sharding", "op10_chat_formatting"])
def test_native_queries_have_no_python(spark, name):
    from tidemill.llm.queries import queries

    plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
