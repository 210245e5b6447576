"""A corpus from raw documents: quality, near-duplicates, secrets, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents that go on, with the same columns; the last gives the packed sequences.

Defined results: null and empty texts are kept by the quality stage, are near-duplicates of each other, hold no secret, and add no word to the mix, so they
are not among the sequences. Repeated rows are one document from the second stage on. Null ids, languages and sources are values like any other. An empty table gives no sequences.
Columns beside id, text, language and source pass, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cytolake.llm import mixing, ngram_quality, packing, secrets, simhash
from cytolake.llm.common import fresh_path, materialize, scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model of trusted text does not reject."""
    return ngram_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id; near means what the operator's contract says (three-word shingles, two bits)."""
    return simhash.survivors(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked."""
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once for each time it takes them."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    return packing.pack(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("secret_scan", secret_scan),
    ("mix_sources", mixture),
    ("best_fit_packing", packed),
]

#: The stages hash, train and tokenise beyond what SQL can express; tests/llm holds run() over whole tables against plain Python, stage by stage.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        with scratch(spark):  # a stage's own tables go once its documents are written
            docs = materialize(stage(spark, docs, sf_dir), name, path)
    return STAGES[-1][1](spark, docs, sf_dir)
