"""Merkle manifests, fingerprints and ranked search against brute force; resharding, packing and pages of odd rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemill.llm import html_extract, jaccard_join, lexical, merkle, packing, sharding, simhash
from tidemill.llm.common import in_bitmap

from test_operators import docs, prose

# -- manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(nodes):
    """(root, the siblings of each leaf level by level, as (left, right))."""
    paths, place, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        runs = [level[i : i + 3] for i in range(0, len(level), 3)]
        for k, p in enumerate(place):
            run, at = runs[p // 3], p % 3
            paths[k].append(("".join(run[:at]), "".join(run[at + 1 :])))
            place[k] = p // 3
        level = [sha(*run) for run in runs]
    return level[0], paths


def brute_manifest(rows):
    """Rows (doc_id, source, lang, n_chars, text) -> sorted results."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by = defaultdict(list)
    for r in rows:
        even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        changed = r[4].replace("\n", "") if even and r[4] is not None else r[4]
        by[r[1]].append((r[0], sha(*map(field, r)), sha(*map(field, (*r[:4], changed)))))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {s: brute_tree([x[1] for x in by[s]]) for s in order}
    root, upper = brute_tree([trees[s][0] for s in order])
    out = []
    for s, up in zip(order, upper):
        for (doc_id, leaf, changed), low in zip(by[s], trees[s][1]):
            h = changed
            for left, right in [*low, *up]:
                h = sha(left, h, right)
            out.append((doc_id, leaf, trees[s][0], root, sha(*itertools.chain(*low, *up)), h, h == root))
    return sorted(out, key=str)


SHAPE = "doc_id long, source string, lang string, n_chars long, text string"


def made(spark, rows, shape=SHAPE):
    return spark.createDataFrame(rows, shape)


def test_manifest_matches_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for source, n in (("hot", 400), ("one", 1), ("two", 2), ("three", 3), ("four", 4), ("é", 10), ("", 5), (None, 7), ("eighty-one", 81), ("eighty-two", 82)):
        for _ in range(n):
            text = rng.choice([None, "", "a\nb", "no end", "\n\n", prose(rng, 20) + "\n", "ß\nü"])
            rows.append((rng.randrange(10_000), source, rng.choice(["en", None, ""]), rng.choice([None, 0, 5]), text))
    rows += [(None, "two", "en", 1, "x\ny"), *[(77, "hot", "en", 3, "twin\n")] * 30, (5, "hot", "en", 3, "a\n" * 200_000)]
    got = merkle.audited(made(spark, rows).repartition(5))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_manifest(rows)


@pytest.mark.parametrize("rows", [[(3, "s", None, None, "a\n")], [(1, None, "", 0, None)], [(i, f"s{i}", "x", i, "t") for i in range(10)]])
def test_manifest_of_few_rows(spark, rows):
    assert sorted(map(tuple, merkle.audited(made(spark, rows)).collect()), key=str) == brute_manifest(rows)


def test_manifest_of_nothing_and_of_clashing_columns(spark):
    assert merkle.audited(made(spark, [])).count() == 0
    rows = [(i, "s", "x", i, f"t{i}\n") for i in range(200)]
    d = made(spark, rows)
    for name in ("leaf", "h", "pos", "n", "grp", "path", "row", "at", "part", "group"):
        d = d.withColumn(name, F.lit("clash"))
    assert sorted(map(tuple, merkle.audited(d).collect()), key=str) == brute_manifest(rows)


def test_one_changed_row_shows_in_its_own_proof_only(spark):
    rows = [(i, "s", "x", i, f"t{i}") for i in range(100)]
    d = made(spark, rows)
    found = merkle.manifest(d, F.when(F.col("doc_id") == 42, F.lit("forged")).otherwise(F.col("text")))
    bad = found.where(merkle.folded(F.col("changed"), F.col("path")) != F.col("root")).collect()
    assert [r.doc_id for r in bad] == [42]


# -- fingerprints


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, ids):
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(range(len(fps)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 3:
            x, y = find(a), find(b)
            label[max(x, y)] = min(x, y)
    least: dict = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [least.get(find(k)) for k in range(len(fps))]


def test_fingerprints_and_components_match_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", " \n", "One", "one", "two words", "A b c", "a B c", "a b c d"]
    for _ in range(12):
        words = prose(rng, rng.randrange(30, 300)).split()
        for _ in range(8):
            near = list(words)
            for _ in range(rng.randrange(3)):
                near[rng.randrange(len(near))] = "changed"
            texts.append(rng.choice([" ", "\n", "\t"]).join(near))
    texts += [texts[20]] * 20 + ["Ünïcode WORDS here\x0bthere"]
    ids = [None if i % 17 == 16 else 3 * i for i in range(len(texts))]
    want_fp = [brute_fingerprint(t) for t in texts]
    assert [simhash.fingerprint((t or "").encode()) for t in texts] == want_fp
    got = simhash.near_duplicates(docs(spark, texts, ids).withColumn("fp", F.lit(1)).withColumn("component", F.lit(1))).collect()
    want = zip(ids, [f"{x:016x}" for x in want_fp], brute_components(want_fp, ids))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_long_texts_have_the_same_fingerprint_in_pieces(monkeypatch):
    text = " ".join(f"w{i * i % 977}" for i in range(5000)).encode()
    whole = simhash.fingerprint(text)
    for size in (1, 7, 1000):
        monkeypatch.setattr(simhash, "PIECE", size)
        assert simhash.fingerprint(text) == whole


@pytest.mark.parametrize("bucket", [256, 2, 0])
def test_links_are_all_found_in_crowded_segments(spark, monkeypatch, bucket):
    """Groups that share one half, all halves apart by a bit, and random ones, whatever counts as crowded."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(100)}
    for _ in range(4):
        middle = rng.getrandbits(64)
        for _ in range(40):
            x = middle
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.choice([rng.randrange(64), rng.randrange(32), 32 + rng.randrange(16)])
            fps.add(x)
    fps |= {0, 1, (1 << 64) - 1, (1 << 64) - 8}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    want = {(a, b) for a, b in itertools.permutations(signed, 2) if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3}
    assert got == want and len(want) > 100


# -- search


def brute_search(texts, ids, items, top=50):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    counts = [Counter(words(t)) for t in texts]
    n = [sum(c.values()) for c in counts]
    big_n, big_l = sum(x > 0 for x in n), sum(n)
    df = Counter(t for c in counts for t in c)
    terms = defaultdict(set)
    for i, t in items:
        terms[i] |= set(words(t))
    out = []
    for item, held in terms.items():
        rows = []
        for c, k, d in zip(counts, n, ids):
            m = 100 - 50 + (50 * k * big_n) // big_l if big_l else 0
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in held if t in c)
            if score > 0:
                rows.append((-score, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out, key=str)


def benchmark(spark, items):
    return spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank long")


@pytest.mark.parametrize(("width", "block"), [(32, 1000), (1, 3)])
def test_search_matches_brute_force(spark, monkeypatch, width, block):
    """Also with sketches so small that nearly all bounds are loose, and with the queries in many blocks."""
    monkeypatch.setattr(lexical, "WIDTH", width)
    monkeypatch.setattr(lexical, "SIZES", (1 if width == 1 else 64, 1 << 24))
    monkeypatch.setattr(lexical, "BLOCK", block)
    rng = random.Random(4)
    texts = [prose(rng, rng.randrange(1, 120), 300) for _ in range(400)] + ["W1 w1, w1! w2"] * 70 + [None, "", "?!", "Ünï-cødé w3 a1b2", "w5 " * 400, "w7 w8 " * 3000]
    ids = [None if i % 31 == 30 else (i * 7) % 500 for i in range(len(texts))]
    items = [(k, prose(rng, 12, 300)) for k in range(6)] + [(9, "w1 w1 w2"), (10, None), (11, "absent words only"), (12, "Ünï cødé, A1B2"), (12, "w3"), (13, "w5 w7"), (14, "")]
    got = lexical.search(docs(spark, texts, ids).repartition(3), benchmark(spark, items))
    assert sorted(map(tuple, got.collect()), key=str) == brute_search(texts, ids, items)


def test_search_of_empty_tables(spark):
    some = benchmark(spark, [(1, "w1")])
    assert lexical.search(docs(spark, []), some).count() == 0
    assert lexical.search(docs(spark, [None, "..."]), some).count() == 0
    assert lexical.search(docs(spark, ["w1"]), some.limit(0)).count() == 0
    assert lexical.search(docs(spark, ["w1"]), some).collect()[0].rank == 1


def test_no_bound_lies_below_the_frequency():
    rng = random.Random(5)
    for n in (1, 10, 400):
        counts = Counter({f"t{k}".encode(): rng.choice([1, 2, 254, 255, 4000]) for k in range(n)})
        top = lexical.most(lexical.sketch(counts), lexical.term_hashes(counts))
        assert all(t == lexical.ANY or t >= c for t, c in zip(top.tolist(), counts.values()))
        m = np.array([150])
        assert all(lexical.impact(np.array([t]), m, np.array([t]))[0] >= lexical.impact(np.array([c]), m)[0] for t, c in zip(top.astype(int).tolist(), counts.values()))


def test_long_texts_count_the_same_in_pieces(monkeypatch):
    text = " ".join(f"Word{i % 97}, x{i % 13}" for i in range(3000)).encode()
    whole = lexical.term_counts(text)
    monkeypatch.setattr(lexical, "PIECE", 11)
    assert lexical.term_counts(text) == whole


def test_bitmaps_lose_no_key(spark):
    rows = spark.range(5000).withColumn("x", F.col("id") * 3)
    keys = spark.range(0, 15000, 30).select("id")
    got = {r.x for r in in_bitmap(rows, "x", keys).collect()}
    assert {r.id for r in keys.collect()} <= got and len(got) < 700


# -- resharding a layout that is there


def layout(got):
    return sorted((r.doc_id, r.size, r.text_crc32, r.old_shard, r.shard, r.slot) for r in got.collect())


def test_resharding_doesn_t_depend_on_partitions(spark):
    rng = random.Random(8)
    d = docs(spark, [prose(rng, rng.randrange(1, 60)) for _ in range(800)] + ["twin"] * 40, [*range(800), *[5] * 40])
    want = layout(sharding.reshard(d, sharding.by_id()))
    assert layout(sharding.reshard(d.repartition(3), sharding.by_id())) == want


def test_a_written_layout_is_resharded_in_place(spark, tmp_path):
    rng = random.Random(9)
    path = f"file://{tmp_path}/table"
    d = docs(spark, [prose(rng, 40) for _ in range(900)])
    # Shards 0 to 7 are level; 8 is about to close.
    first = sharding.reshard(d, F.lit(0), 8)
    sharding.rewrite(d, first, path)
    extra = docs(spark, [prose(rng, 40) for _ in range(100)], range(1000, 1100))
    extra.withColumns({"slot": F.col("doc_id") - 1000, "shard": F.lit(8)}).write.mode("append").partitionBy("shard").parquet(path)
    table = spark.read.parquet(path)
    placed = sharding.reshard(table, F.col("shard"), 8)
    touched = {k for r in placed.collect() if r.old_shard != r.shard for k in (r.old_shard, r.shard)}
    before = {f: os.stat(f).st_mtime_ns for k in range(9) for f in map(str, tmp_path.glob(f"table/shard={k}/*.parquet"))}
    sharding.rewrite(table, placed, path)
    after = {f: os.stat(f).st_mtime_ns for k in range(9) for f in map(str, tmp_path.glob(f"table/shard={k}/*.parquet"))}
    same = {int(re.search(r"shard=(\d+)", f)[1]) for f in before if after.get(f) == before[f]}
    assert same == set(range(9)) - touched
    out = spark.read.parquet(path).where("shard < 8")
    assert sorted((r.doc_id, r.text) for r in out.collect()) == sorted((r.doc_id, r.text) for r in d.union(extra).collect())


def test_resharding_takes_maps_and_its_own_column_names(spark, tmp_path):
    d = docs(spark, ["a", "b", None] * 20, [1, 2, None] * 20).withColumns({"shard": F.lit(3), "slot": F.lit(1), "m": F.create_map(F.lit("k"), F.col("doc_id")), "block": F.lit(1), "copy": F.lit(1), "key": F.lit("x")})
    placed = sharding.reshard(d, F.col("shard"))
    assert placed.count() == 60
    sharding.rewrite(d, placed, f"file://{tmp_path}/out")
    out = spark.read.parquet(f"file://{tmp_path}/out")
    assert out.where("key = 'x'").count() == sum(1 for r in placed.collect() if r.shard in {s for q in placed.collect() if q.old_shard != q.shard for s in (q.old_shard, q.shard)})


# -- packing


def test_packing_splits_equal_pieces_and_takes_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 10)
    names = ["first", "each", "lo", "hi", "at", "sequence_id", "offset", "__x"]
    pieces = spark.range(300).select(F.lit(None).cast("long").alias("doc_id"), F.lit(100).cast("long").alias("length"), *[F.lit(7).alias(n) for n in names])
    got = packing.pack(pieces)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    rows = got.collect()
    assert "__row" in plan and set(got.columns) == {"doc_id", "length", *names}
    used = Counter(r.sequence_id for r in rows)
    assert len(rows) == 300 and max(used.values()) <= 20 and len(used) == 15
    assert {(r.sequence_id, r.offset) for r in rows} == {(s, 100 * k) for s in used for k in range(20)}


# -- pages


def test_hidden_elements_inside_a_line_leave_it_whole():
    """Pages made of known blocks, with scripts, hidden spans, pictures and buttons inside, and blocks that begin like furniture."""
    rng = random.Random(6)
    starts = ["Copyright law is an old field of study and", "Share prices rose while", "Cookies are baked in", "Comment is free said", "Menu engineering is", "© is a sign that", "Reply letters were"]
    inline = ["<script>var a = '<p>x</p>';</script>", "<span hidden>no</span>", "<svg><text>no</text></svg>", "<noscript>no</noscript>", "<button>no</button>", "<span style='display:none'>no</span>", "<i aria-hidden='true'>no</i>", "<style>p{}</style>"]
    for wrap in ("<article>%s</article>", "<div>%s</div>", "%s"):
        for _ in range(30):
            blocks, html = [], []
            for _ in range(rng.randrange(2, 6)):
                words = (rng.choice(starts) + " " + prose(rng, rng.randrange(20, 60))).split()
                blocks.append(" ".join(words))
                at = rng.randrange(1, len(words))
                html.append(f"<p>{' '.join(words[:at])} {rng.choice(inline)}{' '.join(words[at:])}</p>")
            assert html_extract.extract("<html><body><nav><a href='/'>Home</a></nav>" + wrap % "\n".join(html) + "<footer>© 2020 us</footer></body></html>") == "\n".join(blocks)
    assert html_extract.extract("<p>one two<script>x</script>three four</p>") == "one twothree four"


# -- one of each group


def test_unlinked_texts_that_share_an_id_all_stay(spark):
    rows = [(1, "a b c d e f"), (1, "other words that stand here"), (2, "x y z w q r"), (None, "a b c d e f"), (2, "a b c d e f"), (2, "")]
    d = docs(spark, [t for _, t in rows], [i for i, _ in rows])
    want = [(1, "a b c d e f"), (1, "other words that stand here"), (2, ""), (2, "x y z w q r"), (None, "a b c d e f")]
    assert sorted(((r.doc_id, r.text) for r in jaccard_join.keep_one(d).collect()), key=str) == sorted(want, key=str)
