"""The corpus pipeline: quality, near-duplicates, decontamination, secrets, packing.

Each stage reads what the one before wrote; run() does the same from the table of documents.

All stages but the last return the columns of documents, extra ones too, whatever their names. Null text stays null
(and is scored, packed and compared as an empty text would be, that is with nothing). Rows without a doc_id stay in
every stage that does not reject their text. Repeated rows: near_dedup keeps one of rows that are equal in doc_id and text.
Very long texts are read whole. Empty tables give empty tables; without labelled positives all documents are
accepted, without items nothing is cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm.bpe import vocabulary_path
from factloom.llm.common import table, written
from factloom.llm.decontamination import decontaminate
from factloom.llm.near_dedup import CORPUS, first_of_each
from factloom.llm.packing import pack
from factloom.llm.quality import accepted
from factloom.llm.secrets import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Each row is judged by its own text; ties at the cut are accepted."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (at least 80 per cent of their five-word shingles) the smallest doc_id stays.

    Documents without words link with nothing and stay. Rows that share a doc_id stay or go together.
    """
    return first_of_each(docs, CORPUS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; documents that mostly consist of them go. Null texts and null items hold none."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, one for each stretch that any of them covers. No row goes."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences. Each row is packed once; an empty text is its closing id alone."""
    return pack(docs, vocabulary_path())


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]

#: Tokenisation and the classifier are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
