"""A corpus from raw documents to packed sequences, one written table per stage.

Stages take and return whole rows; the last gives a row for each piece of a document.

- toxicity drops documents that the classifier rejects. Null and empty texts stay.
- quality_rules drops documents that the rules' posterior rejects, which include all of
  under 50 words, and so null and empty texts.
- jaccard_join keeps one document of each group of near copies (of one text, the
  smallest doc_id; rows alike in id and text are one). Rows without an id and documents
  without words all stay, and so do documents that share an id but are not near.
- best_fit_packing cuts documents into pieces and places each once. A null id stays null.

Very long texts are read whole by each stage. Ties go to the smaller id or, where ids
repeat, to the smaller row. Columns of other names, whatever these are, are carried up to
the last stage. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import jaccard_join, packing, quality, toxicity
from tidemill.llm.common import read_table, release, shared_dir
from tidemill.llm.queries import tokenizer_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.tokenised(docs, tokenizer_path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality_rules", quality_stage),
    ("jaccard_join", jaccard_stage),
    ("best_fit_packing", packing_stage),
]

#: A fitted classifier, expectation-maximisation and a tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to the documents; each stage's result is written to the shared folder, read again by the next one and then deleted."""
    docs, before = read_table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/tidemill-stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        release(*before)
        docs = spark.read.parquet(path)
        before = [docs]
    return docs
