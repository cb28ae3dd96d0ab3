"""Corpus pipeline: language, near duplicates, repeated passages, benchmark leaks, packing."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freightgraph.functions.scratch import delete, discarded, shared_dir
from freightgraph.llm.chunk_dedup import dedup_substrings
from freightgraph.llm.decontaminate import contaminated
from freightgraph.llm.language_id import UNKNOWN, LanguageModel, identify_languages
from freightgraph.llm.near_dedup import drop_near_duplicates
from freightgraph.llm.packing import pack_documents
from freightgraph.llm.registry import fold, tokenizer_paths

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Texts travel to Python in Arrow batches of this size, not Spark's 64 MB, for every stage of the session.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Python workers, which Spark keeps for the next task, give memory back when it is free.
WORKERS = {"MALLOC_TRIM_THRESHOLD_": "131072", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def bounded(stage: Stage) -> Stage:
    """The stage with small Arrow batches and thrifty workers, so that two tasks and their Python workers fit into a small executor."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
        for name, value in WORKERS.items():
            spark.sparkContext.environment.setdefault(name, value)
        return stage(spark, docs, sf_dir)

    return run_stage


@bounded
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no language: null texts and texts without letters.

    Rows are judged one by one, repeated ones too; an empty table gives an empty result.
    """
    model = LanguageModel.fit(docs.where(fold() != 0))
    judged = identify_languages(docs, model, keep=("text", "lang", "source", "n_chars"))
    return judged.where(F.col("lang_pred") != UNKNOWN).select(*COLUMNS)


@bounded
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that with the smallest id; every link is checked on the whole shingle sets.

    Null and empty texts are one group. Of rows that repeat id and text one stays; rows with one id and
    different texts are judged each. A null id counts as the largest. Long texts are compared whole, an
    empty table gives an empty result, and further columns are left out.
    """
    return drop_near_duplicates(docs).select(*COLUMNS)


@bounded
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document has; documents that were repeats throughout go.

    Documents with a null or blank text go, too. Repeated rows of one id are one holder; rows with a
    null id keep their text. An empty table gives an empty result.
    """
    cut = dedup_substrings(docs)
    return cut.where(F.length(F.trim("text")) > 0).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@bounded
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item.

    Null and empty texts hold none, and neither do rows with a null id, which stay; all rows of an id
    go if one of them holds an item. Long texts are searched whole; an empty table of documents or
    items drops nothing.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = contaminated(docs, items).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*COLUMNS)


@bounded
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of every document that is left.

    A null or empty text has its end mark alone; repeated rows are packed each, long texts whole; an
    empty table gives an empty result.
    """
    return pack_documents(docs, *tokenizer_paths())


STAGES = [
    ("language", language), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup),
    ("decontamination", decontamination), ("packing", packing),
]

#: The tokenizer, fingerprints and digests are not SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet to the shared folder and read again.

    A stage's intermediate tables are deleted when its result is written, and so are the results of all stages
    but the last at the end, where the session gets its own batch size back.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    batch = spark.conf.get(BATCH_SETTING)
    try:
        for name, stage in STAGES:
            with discarded(spark):
                stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
        for name, _ in STAGES[:-1]:
            delete(spark, f"{folder}/{name}")
    finally:
        spark.conf.set(BATCH_SETTING, batch)
    return docs
