"""From raw documents to packed training sequences, in four stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one before it kept;
``run`` writes each stage's rows as Parquet in the shared folder and reads them again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimcheck.llm import jaccard, mixing, packing, simhash, toxicity
from claimcheck.llm.common import stored, table
from claimcheck.session import ship_package


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go.

    The model is fitted on those labelled documents that are there, held-out fold aside.
    Null and empty texts stay; without labels, or of one class only, all stay whose class is
    not mostly toxic.  Columns are those of ``docs``, whatever they are called.
    """
    ship_package(spark)
    return toxicity.accepted(docs, toxicity.trained(spark, docs, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays.

    Near-duplicates have SimHash fingerprints that differ in at most four bits, or share at
    least 0.8 of the union of their shingles of five words; links of both kinds form the groups.
    Texts without words are copies of each other.  Rows that repeat an id are one document;
    rows without an id stay.
    """
    ship_package(spark)
    return simhash.deduplicated(docs, jaccard.near_duplicates(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say: the shares of tokens by quality meet the targets.

    A document of rate 1.2 is there once or twice, one of rate 0.6 once or not at all; a text
    without words follows its bins like any other.  Copies of a row are equal rows.
    """
    ship_package(spark)
    return mixing.resampled(docs, table(spark, sf_dir, "labels"), mixing.QUALITY)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in training sequences; repeated rows are packed each on its own."""
    ship_package(spark)
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", clean),
    ("simhash", near_duplicates),
    ("mixing", mixture),
    ("packing", sequences),
]

#: SQL has neither the models nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the whole table of documents."""
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        rows = stored(stage(spark, rows, sf_dir), f"pipeline-{name}")
    return rows
