"""The training-data pipeline over a table of documents, stage by stage.

Each stage takes what its predecessor kept and returns documents with the same columns; the last one
returns a row for every document of the mix with the digests of its encoding. A document that the mix
repeats comes as often as it is repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clausegrid.llm import bpe, mixing, ngram_join, quality, secret_scan
from clausegrid.llm.common import alone, table
from clausegrid.llm.queries import VOCABULARY


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that fail the base rules or lie far from the rest of their language and source go."""
    return quality.good_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents similar at 0.8 on 5-word shingles the one of the least id stays."""
    return ngram_join.one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets found in the texts are masked; all documents stay."""
    return secret_scan.redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it, whole documents only."""
    return mixing.mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and the digests of the ids and of the text decoded from them."""
    return bpe.round_trip(docs, VOCABULARY, ("doc_id", "source"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scans),
    ("mixing sources", source_mix),
    ("BPE encoding", encoding),
]

#: Concentration steps, forests and token merges are not SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read by the next.

    What a stage stores on its way is removed when its result is written.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = alone(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
