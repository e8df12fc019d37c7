"""Corpus pipeline: quality, near duplicates, benchmark passages, PII, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is
written and read again before the next one; what was read is deleted then.

Cases that all stages share: a null or empty text is a text without words; repeated rows
and rows without a doc_id go through like others; extra columns stay to the last stage but
one; an empty table gives an empty result; a very long text is taken whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codebrook.llm import decontamination, line_quality, ngram_join, packing, pii
from codebrook.llm.common import bounded_batches, delete, held_out, shared_dir, table, transient, unused
from codebrook.llm.registry import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches 0.5; learns from labels that are not held out.

    Equal texts get equal scores, so repeated rows stay or go together; without labels of
    both kinds all documents score 0.5 and stay.
    """
    bounded_batches(spark)
    model = line_quality.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    (name,) = unused(docs.columns, "_quality")
    return line_quality.score(docs, model, name).where(F.col(name) >= 0.5).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each class of documents linked at 0.8 on 5-word shingles.

    Documents without words link with nothing and stay; a row without a doc_id stays where
    no other document is linked with it.
    """
    bounded_batches(spark)
    return ngram_join.representatives(docs, n=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; all of them where it is empty."""
    bounded_batches(spark)
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with surrogates for personal data and secrets.

    No row goes, and texts without entities stay as they are; the key is the session's.
    """
    bounded_batches(spark)
    return pii.checked(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences; an empty text is the closing token."""
    bounded_batches(spark)
    return packing.best_fit(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("pii", private),
    ("best_fit_packing", packed),
]
#: SQL cannot express the classifier, the alignment or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result goes to the shared folder as Parquet, the last one stays."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        with transient(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:
            delete(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
