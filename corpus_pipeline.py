"""The corpus pipeline: quality, language, near-duplicates, packing. Each stage is written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import langid, packing, quality, similar
from spanloom.llm.base import materialize, table
from spanloom.llm.tokens import vocabulary_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled rows of sf_dir, doesn't reject."""
    return quality.keep_good(docs, quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found, by a model trained on the documents of sf_dir."""
    return langid.keep_known(docs, langid.fit(table(spark, sf_dir, "documents")))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: links at a Jaccard similarity of 0.8 of shingles of five words."""
    return similar.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    return packing.pack(docs, vocabulary_path("word_bpe_49k.json"))


STAGES = [("quality", good_quality), ("language", known_language), ("near-duplicates", one_of_near_duplicates), ("packing", packed)]
#: No stage but the first two could be told in SQL, and those rest on trained models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return materialize(STAGES[-1][1](spark, docs, sf_dir), "pipeline-packing")
