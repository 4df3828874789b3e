"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, html_extract, jaccard_join, lexical, license_scan, merkle, packing, quality, sentencepiece_codec, sharding, simhash, toxicity
from .common import read_table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read_table(spark, sf_dir, "documents")).drop("spans")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), with_ids=False)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.label_quality(read_table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenised(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return packing.pack(pieces)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(read_table(spark, sf_dir, "pages"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(read_table(spark, sf_dir, "documents")).drop("class_id", "n_links")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read_table(spark, sf_dir, "embeddings"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.reshard(read_table(spark, sf_dir, "documents"), sharding.by_id())
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_turns(read_table(spark, sf_dir, "conversations"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audited(read_table(spark, sf_dir, "documents"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    ops = [op1_license_scan, op2_sentencepiece, op3_toxicity, op4_quality_rules, op5_best_fit_packing, op6_html_extraction]
    ops += [op7_jaccard_join, op8_nearest_neighbours, op9_sharding, op10_chat_formatting]
    ops += [op11_merkle_manifest, op12_simhash, op13_lexical_search, pipeline]
    return {f.__name__: f for f in ops}


def _license_sql() -> str:
    rows = [f"({tid}, '{label}', {base}, {n}, {tpos}, '{a}', '{b}')" for tid, label, base, n, tpos, a, b in license_scan.template_rows()]
    return f"""WITH t(tid, label, base, n_grams, tpos, t0, t1) AS (VALUES {", ".join(rows)}),
    w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
    g AS (SELECT rid, unnest(words[1:len(words) - 1]) AS w0, unnest(words[2:]) AS w1, unnest(generate_series(0, len(words) - 2)) AS pos FROM w WHERE len(words) > 1),
    v AS (SELECT rid, tid, label, base, n_grams, pos - tpos AS diagonal, list_distinct(list(tpos)) AS held, min(pos) AS lo, max(pos) AS hi FROM g JOIN t ON w0 = t0 AND w1 = t1 GROUP BY ALL),
    k AS (SELECT * FROM v WHERE (base AND len(held) = n_grams) OR (NOT base AND len(held) >= least(2, n_grams))),
    m AS (SELECT *, CASE WHEN base OR coalesce(diagonal - lag(diagonal) OVER o > {license_scan.SLACK}, true) THEN 1 ELSE 0 END AS apart FROM k WINDOW o AS (PARTITION BY rid, tid ORDER BY diagonal)),
    s AS (SELECT *, sum(apart) OVER (PARTITION BY rid, tid ORDER BY diagonal) AS span FROM m),
    z AS (SELECT rid, tid, label, base, n_grams, span, len(list_distinct(flatten(list(held)))) / n_grams AS cover, min(lo) AS lo, max(hi) AS hi FROM s GROUP BY rid, tid, label, base, n_grams, span),
    f AS (SELECT * FROM z WHERE base OR (cover >= {license_scan.MIN_COVER} AND hi - lo + 1 <= 2 * n_grams + {license_scan.SLACK})),
    e AS (SELECT rid, count(*) FILTER (WHERE base) AS n_base, min(lo) FILTER (WHERE base) AS first_word, max(lo) FILTER (WHERE base) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score FROM f GROUP BY rid)
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score FROM w LEFT JOIN e USING (rid)"""


def _jaccard_sql() -> str:
    return """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
    s AS (SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ') ELSE array_to_string(words[i:i + 4], ' ') END AS x FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(1, len(words) - 4))) AS i FROM w WHERE len(words) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT doc_id AS id, doc_id AS seen FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.seen)
    SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, m.c AS component_id FROM documents LEFT JOIN n ON n.doc_id = documents.doc_id JOIN (SELECT id, min(seen) AS c FROM r GROUP BY 1) m ON m.id = documents.doc_id"""


def _merkle_sql() -> str:
    """The same tree level by level; each level's hashes stand beside every leaf. 24 levels are more than any table here has."""
    levels = 24
    value = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    fields = " || ".join(value(c) for c in ("doc_id", "source", "lang", "n_chars"))

    def tree(name: str, leaves: str) -> str:
        """CTEs from ``leaves`` (grp, pos, n, h) to ``{name}nodes`` (lvl, grp, pos, n, h)."""
        return f"""{name}nodes(lvl, grp, pos, n, h) AS (SELECT 0, grp, pos, n, h FROM {leaves} UNION ALL
        SELECT lvl, grp, pos, n, sha256(string_agg(h, '' ORDER BY kid)) FROM (SELECT lvl + 1 AS lvl, grp, pos // 3 AS pos, (n + 2) // 3 AS n, pos AS kid, h FROM {name}nodes WHERE n > 1 AND lvl < {levels}) GROUP BY lvl, grp, pos, n)"""

    def sides(name: str) -> str:
        """Left and right siblings of each node that has a parent."""
        return f"""{name}sides AS (SELECT lvl, grp, pos, coalesce(string_agg(h, '' ORDER BY pos) OVER (l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lhs, coalesce(string_agg(h, '' ORDER BY pos) OVER (l ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rhs FROM {name}nodes WHERE n > 1 WINDOW l AS (PARTITION BY lvl, grp, pos // 3 ORDER BY pos))"""

    def fold(name: str, start: str) -> str:
        """What a tampered leaf and its siblings hash to, level by level, and the siblings so far."""
        return f"""{name}fold(rid, lvl, grp, pos, n, h, proof) AS ({start} UNION ALL
        SELECT f.rid, f.lvl + 1, f.grp, f.pos // 3, (f.n + 2) // 3, sha256(s.lhs || f.h || s.rhs), f.proof || s.lhs || s.rhs FROM {name}fold f JOIN {name}sides s ON s.lvl = f.lvl AND s.grp = f.grp AND s.pos = f.pos)"""

    return f"""WITH RECURSIVE tab AS (SELECT list_transform(generate_series(0, 255), lambda i: list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END))) AS t),
    doc AS (SELECT row_number() OVER () AS rid, coalesce('s' || source, '') AS grp, doc_id, sha256({fields} || {value("text")}) AS h,
      xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 2 = 0 AS even,
      sha256({fields} || {value("replace(text, chr(10), '')")}) AS changed FROM documents, tab),
    leaf AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM doc),
    {tree("a", "leaf")}, {sides("a")},
    tops AS (SELECT grp AS source, h AS subroot, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n, 0 AS grp, h FROM anodes WHERE n = 1),
    {tree("b", "tops")}, {sides("b")},
    {fold("a", "SELECT rid, 0, grp, pos, n, CASE WHEN even THEN changed ELSE h END, '' FROM leaf")},
    {fold("b", "SELECT f.rid, 0, t.grp, t.pos, t.n, f.h, f.proof FROM afold f JOIN tops t ON f.n = 1 AND t.source = f.grp")},
    root AS (SELECT h AS root FROM bnodes WHERE n = 1)
    SELECT doc_id, leaf.h AS leaf, subroot, root, sha256(proof) AS proof_sha256, f.h AS folded_root, f.h = root AS verified FROM leaf JOIN tops ON tops.source = leaf.grp JOIN (SELECT * FROM bfold WHERE n = 1) f USING (rid), root"""


def _lexical_sql() -> str:
    terms = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {terms} AS words FROM documents),
    q AS (SELECT DISTINCT item_id, unnest({terms}) AS term FROM benchmark),
    s AS (SELECT count(*) FILTER (WHERE len(words) > 0) AS nd, CAST(sum(len(words)) AS BIGINT) AS nt FROM d),
    t AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(words) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(nd) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, s GROUP BY term),
    m AS (SELECT rid, doc_id, 100 - 50 + (50 * len(words) * nd) // nt AS m FROM d, s),
    x AS (SELECT item_id, rid, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM t JOIN w USING (term) JOIN m USING (rid) JOIN q USING (term) GROUP BY ALL)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM x JOIN m USING (rid) WHERE score > 0 QUALIFY rank <= 50"""


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": _license_sql(), "op7_jaccard_join": _jaccard_sql(), "op11_merkle_manifest": _merkle_sql(), "op13_lexical_search": _lexical_sql()}
