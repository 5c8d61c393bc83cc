"""From documents to a training mix: five stages, each one operator over all that the last one kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.llm.common import scratch, shared_dir
from streamloom.llm.decontaminate import decontaminated
from streamloom.llm.lang_id import identify
from streamloom.llm.line_dedup import line_dedup
from streamloom.llm.minhash import deduplicated
from streamloom.llm.mixing import fair_queue

#: Predictions below this posterior count as no language.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: those without letters, or of no clear language.
    Null and empty texts go too; a label in ``lang`` that disagrees is no reason to go."""
    found = identify(docs)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("doc.*")


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from all documents but the first; every document stays, with n_chars anew."""
    kept = line_dedup(docs)
    text = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return kept.select(*[text.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the smallest id stays.
    Documents without a word are in no group and stay."""
    return deduplicated(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The schedule of the mix, by virtual finish time: each document's turns and the words of each.
    Documents that the mix ends before have one turn without words."""
    queue = fair_queue(docs)
    return queue.select("doc.doc_id", "doc.source", "size", "source_size", "target", "epoch", "finish", "words", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_deduplication),
    ("near_dedup", near_deduplication),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Language ID and edit distances have no SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again. What a stage writes
    on its way goes when it is done."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    home = f"{shared_dir(spark)}/streamloom/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{home}/{name}")
        docs = spark.read.parquet(f"{home}/{name}")
    return docs
