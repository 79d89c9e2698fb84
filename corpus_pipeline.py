"""A corpus pipeline of five of the training-data operators.

Each stage reads the documents that the one before kept: junk goes, texts of no known language go, one document of
each group of near copies stays, secrets are masked, and what is left is packed into sequences.

Edge cases, stage by stage. Quality rules: null and empty texts go; rows of a null doc_id and repeated rows are judged one
by one. Language ID: the same rows are judged one by one; texts without a letter go; without labels every text goes. Near
duplicates: of rows with one doc_id one stays, rows of a null doc_id all stay, ties go to the smallest doc_id. Secret
scans: every row stays, one by one. Packing: rows with one doc_id follow each other, a null doc_id comes first. Very long
texts are processed whole; columns besides those of documents are carried through to the packing; an empty table passes
through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strideline.llm import entry, langid, neardup, packing, quality, secret_scan
from strideline.llm.common import delete, new_path

#: A text whose language is less sure than this is rejected.
MIN_LANGUAGE_SCORE = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their group's adaptive thresholds."""
    return quality.apply_quality(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network, trained on their labelled part, can tell."""
    model = langid.train(docs.filter(langid.fold() != 1))
    return langid.tell(docs, model).filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that of smallest doc_id."""
    return neardup.deduplicate(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    return secret_scan.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    return packing.pack(docs, entry.vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("packing", pack),
]

#: Trained models and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again. A stage's rows go when the next
    one's are written; those that packing reads stay."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            delete(spark, last)
        docs, last = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
