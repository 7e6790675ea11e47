"""Corpus cleaning pipeline: stages over documents, each working on all that its predecessor kept.

1. language ID: documents that it rejects go (null texts, texts without a letter, texts far from every centroid).
2. n-gram Jaccard join: five-word shingles, similarity of 0.8 or more; the smallest doc_id of each group stays.
3. benchmark decontamination: documents that leak a benchmark item go.
4. secret scans: every secret is replaced by a mark, and n_chars follows.
5. best-fit packing: the rest in bins of 2048 words; the result has a row for each piece.

All but the last return the columns of documents. Nulls, empty tables, repeated rows and extra columns are handled as
the stages' operators say; a row without doc_id passes stage 2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm._shared import bounded_batches, materialize, table
from tessella.llm.decontaminate import drop_leaks
from tessella.llm.jaccard_join import keep_one_of_each
from tessella.llm.language_id import fit_languages, keep_identified
from tessella.llm.packing import pack_documents
from tessella.llm.secrets import fit_field, redact_secrets


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return keep_identified(docs, fit_languages(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_secrets(docs, fit_field(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("packing", packing),
]

#: No stage but the third can be stated in SQL; tests hold each against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a Parquet table that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
