"""From raw documents to token ids: five stages, each on what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as
Parquet into the shared folder and reads it again. All stages but the last return the columns of
documents. SQL can't express the trained classifier, the redaction or the encoding, so there is no
``ORACLE_SQL``; ``tests/llm`` hold every stage against a plain Python version. Stages follow each other in the
same executors and Python workers, so they ask Spark for small batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trialweave.llm import decontaminate, ngram_join, pieces, pii, quality_classifier
from trialweave.llm.exchange import read_table, small_batches, stored
from trialweave.llm.queries import vocabulary_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    small_batches(spark)
    return quality_classifier.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of near copies."""
    small_batches(spark)
    return ngram_join.drop_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    small_batches(spark)
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    small_batches(spark)
    return pii.redact(docs, length="n_chars")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as piece ids."""
    small_batches(spark)
    return pieces.encode(docs, vocabulary_path())


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("SentencePiece encoding", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
