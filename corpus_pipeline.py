"""Cleaning and packing of a text corpus in stages; each is written as Parquet and reread as the next one's docs.

Every stage works on all that its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftwood.llm.common import SETTINGS, Workspace, table
from driftwood.llm.decontaminate import keep_clean
from driftwood.llm.neardup import keep_one_of_each
from driftwood.llm.packing import pack
from driftwood.llm.quality import keep_good
from driftwood.llm.repeats import remove_repeats


def _bounded(spark: SparkSession) -> SparkSession:
    """The session, set to small Arrow batches: the pipeline is an application of its own."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores under its threshold go. Null and empty texts are scored as no passages are."""
    return keep_good(docs, table(_bounded(spark), sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id, and one row of it. Null and empty
    texts, and those without words, are no copies and stay."""
    _bounded(spark)
    return keep_one_of_each(docs)


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 51 words (and 200 bytes) or of 400 bytes that repeat across or within documents are cut out of the texts. A
    document of which nothing is left goes; null and empty texts stay."""
    _bounded(spark)
    return remove_repeats(docs, length=200, words=51)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of ten words of a benchmark item go. Null and empty texts stay."""
    return keep_clean(docs, table(_bounded(spark), sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document in a token sequence. A null or empty text is the end id alone."""
    _bounded(spark)
    return pack(docs)


STAGES = [("quality_classifier", quality_filter), ("minhash_near_dedup", near_dedup), ("suffix_array_dedup", repeat_dedup), ("benchmark_decontamination", decontamination), ("sum_of_squares_packing", packing)]
#: A trained model, sketches and a tokenizer are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, work = table(spark, sf_dir, "documents"), Workspace(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = work.save(stage(spark, docs, sf_dir), name)
        if k:
            work.drop(STAGES[k - 1][0])
    return docs
