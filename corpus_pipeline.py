"""A corpus pipeline of four stages, each written as Parquet and reread as the next one's documents.

Every stage works on all rows its predecessor kept.  The first three return the columns of
`documents`; the last returns the packing.  Stages with null ids, null texts, empty tables or extra
columns follow the rules of the operator that they call.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from harborline.llm import ngram_join, packing, quality_classifier, quality_rules
from harborline.llm.common import let_go, shared_dir, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier scores under its threshold go."""
    s = quality_classifier.Settings()
    model = quality_classifier.fit(docs, quality_classifier.training_labels(table(spark, sf_dir, "labels")), s)
    return quality_classifier.filter_texts(docs, model, s)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that fail the base rules or the likelihood ratio go."""
    s = quality_rules.Settings()
    return quality_rules.filter_texts(docs, quality_rules.ratios_of(docs, table(spark, sf_dir, "labels"), s), s)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: one of its smallest id."""
    return ngram_join.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows and their places in sequences."""
    return packing.packed(docs)


STAGES = [
    ("quality_classifier", classify),
    ("quality_rules", rules),
    ("ngram_jaccard_join", near_duplicates),
    ("best_fit_packing", pack),
]
#: The stages fit models and find components, which SQL can't express; tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, through tables in the shared folder."""
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        gc.collect()
        let_go()  # what the stage held on the driver
    return docs
