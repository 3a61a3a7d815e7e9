"""A cleaning pipeline over documents: each stage applies one corpus operator to all its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, line_dedup, packing, quality_rules, similar_texts
from tidemark.llm.common import table, written
from tidemark.llm.queries import BYTE_BPE

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go; the others stay as they are."""
    return quality_rules.keep_good(docs)


def first_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that ten or more documents share only the first occurrence stays, so no content is lost as a whole.

    Every document stays, if need be with an empty text; n_chars follows the text.
    """
    cut = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, keep_first=True))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles at a similarity of 0.8 or more."""
    return similar_texts.one_of_each(docs)


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents, packed into sequences."""
    return packing.pack_documents(docs, BYTE_BPE)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", good_documents),
    ("line_dedup", first_lines),
    ("near_dedup", one_of_each),
    ("decontamination", unleaked),
    ("packing", packed),
]

#: packing needs a tokenizer, which SQL lacks; tests compare run() with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
