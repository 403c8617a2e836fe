"""A training-corpus pipeline: five stages over the documents table.

Each stage works on all that its predecessor kept, and its decisions take effect: the quality classifier
drops what it rejects, of each near-duplicate class the document with the least id stays, documents with a confirmed
benchmark passage go, personal data is replaced by placeholders, and what is left is encoded.
Nulls, empty texts, repeated rows and empty tables are handled as each operator's module says; extra columns
are kept by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm.corpus import bounded, table
from lodestrata.llm.parity_join import one_of_each
from lodestrata.llm.piece_lattice import sampled_pieces
from lodestrata.llm.pii_bootstrap import redacted
from lodestrata.llm.quality_fm import keep_good
from lodestrata.llm.store import written
from lodestrata.llm.template_decon import decontaminated


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return redacted(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return sampled_pieces(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("SentencePiece encoding", encoding),
]

#: SQL cannot express a fitted model or sampled encodings; tests/llm holds the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result but the last is written, so no stage runs twice."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
