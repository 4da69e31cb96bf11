"""Documents to token ids: five stages, each an operator of ``sediment.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all that the stage before
kept. All but the last return the columns of ``docs`` as they were. Stages handle nulls, empty and very
long texts, repeated rows, empty tables and extra columns as their operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sediment.llm import bpe, classifier, decontam, secrets, shingles
from sediment.llm.common import stored, table
from sediment.llm.queries import tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier learnt from the labels doesn't reject."""
    return classifier.accepted(docs, *classifier.fit(docs, table(spark, sf_dir, "labels")))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of exact and near copies (five-word shingles, similarity 0.8 or more).

    Candidates by SimHash fingerprints first, then by shared shingles, as most near copies differ in more bits than
    the grids reach; all are verified on whole sets.
    """
    return shingles.distinct_documents(docs, shingle=5)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that stand in benchmark windows; those mostly made of them go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret span replaced by a mark."""
    return secrets.redact(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (little-endian unsigned 32-bit integers), with digests of ids and decoded text."""
    return bpe.bpe_encode(docs, tokenizer_path(), with_text=False, with_ids=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("simhash near-dedup", simhash_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_redaction),
    ("bpe encoding and decoding", bpe_encoding),
]

#: The classifier, the fingerprints and the ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k}")
    return docs
