"""The pipeline's stages on the smallest tables."""

from __future__ import annotations

import re

import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def test_filters_keep_whole_documents_and_columns(stages):
    whole = {tuple(r) for r in stages[0].collect()}
    for before, after in zip(stages[:3], stages[1:4]):
        assert after.columns == stages[0].columns
        rows = {tuple(r) for r in after.collect()}
        assert rows and rows <= {tuple(r) for r in before.collect()} <= whole


def test_no_two_kept_documents_are_near(stages):
    sets = []
    for r in stages[3].collect():
        w = re.findall(rb"[^\x20\x09-\x0D]+", r.text.encode().lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    for i, a in enumerate(sets):
        for b in sets[:i]:
            assert 100 * len(a & b) < 80 * len(a | b)


def test_every_kept_document_is_packed(stages):
    packed = stages[4].collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in stages[3].collect()}
    used: dict = {}
    for r in packed:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 2048
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "jaccard_join", "best_fit_packing"]


def test_odd_rows_go_through_every_stage(spark, tmp_path):
    """Null ids and texts, repeated ids with other texts, repeated rows, clashing columns; and nothing at all."""
    from pyspark.sql import functions as F

    given = spark.read.parquet(f"{SF}/documents.parquet")
    good = [r.text for r in given.where("length(text) between 400 and 3000").orderBy("doc_id").limit(40).collect()]
    rows = [(i if i % 9 else None, t, "en", "s", len(t)) for i, t in enumerate(good)]
    rows += [(1, good[20] + " and then some more words of its own", "en", "s", 1), (1, good[1], "en", "s", len(good[1])), (None, None, None, None, None), (77, None, "en", None, 0), (78, "", "en", "s", 0), (79, good[2], None, "s", 9)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("label", "same", "n", "score", "component_id", "length", "first"):
        odd = odd.withColumn(name, F.lit("clash"))
    for name, docs in (("odd", odd), ("none", odd.limit(0))):
        folder = f"file://{tmp_path}/{name}"
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    whole = {str(tuple(r)) for r in odd.collect()}
    docs = spark.read.parquet(f"file://{tmp_path}/odd/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, docs, f"file://{tmp_path}/odd").cache()
        kept = [str(tuple(r)) for r in after.collect()]
        assert after.columns == odd.columns and set(kept) <= whole
        docs = after
    rows = docs.collect()
    assert sum(r.doc_id is None for r in rows) >= 2
    named = [(r.doc_id, r.text) for r in rows if r.doc_id is not None]
    assert len(named) == len(set(named)) and len({t for _, t in named}) == len(named)
    packed = corpus_pipeline.run(spark, f"file://{tmp_path}/odd").collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in rows}
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/none").count() == 0
