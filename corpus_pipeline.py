"""Corpus pipeline: language ID, exact dedup, near dedup, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one
before kept; its result is written as Parquet and read again. All stages but
the last return the columns of ``documents``; extra columns are dropped at the
start. The last returns a row per document of the mix with its place in a
batch. Null and empty texts go with the first stage (no language); rows with a
null id, source or language stay and count as any other; of repeated rows the
second stage keeps one; texts are handled whole, however long. A stage's result must be written before the next stage starts.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from basketry.llm.common import dropped, recording, saved, table
from basketry.llm.exact_dedup import one_of_equal
from basketry.llm.language_id import accepted_documents
from basketry.llm.mixing import mixed_rows
from basketry.llm.ngram_join import one_of_each
from basketry.llm.packing import pack

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

_tables: list[DataFrame] = []  # written for the stage in hand


def _stage(function):
    """The tables of the stage before go when the next one starts: by then its
    result has been written."""
    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _tables:
            dropped(_tables.pop())
        with recording(_tables):
            return function(spark, docs, sf_dir)
    return run_stage


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; the rest go (see ``identify``)."""
    return accepted_documents(docs.select(*COLUMNS))


@_stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the smallest id."""
    return one_of_equal(docs.select(*COLUMNS))


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component linked at 0.8 on five-word shingles."""
    return one_of_each(docs, k=5, num=80, den=100).select(*COLUMNS)


@_stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, in the order of the schedule's slots within a file: a
    row for every pass that takes words of a document, with those words as its
    text (the whole text unless the source's target ends within the document)."""
    return mixed_rows(docs.select(*COLUMNS))


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and token-budget batches of the mix."""
    return pack(docs)


STAGES = [("language ID", language_id), ("exact dedup", exact), ("n-gram Jaccard join", near),
          ("source mixing", mixed), ("packing", packing)]

# Language ID and hash-ordered mixing are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
