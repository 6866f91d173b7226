"""A training-corpus pipeline over ``documents``: five stages, each written as Parquet and read again.

Every stage works on all rows that the one before kept, and all but the last return the columns of
``documents``. The last stage returns each remaining document's token count and digests.

Null texts, and texts without a letter, have no language and go in the first stage, as do empty ones. Null
doc_ids and languages are kept as they are. Rows that repeat doc_id and text are one document: they
keep the same lines, and one of them stays. Rows with one doc_id, or none, and different texts are documents of
their own in every stage. Other columns pass every stage, whatever their
names. An empty table gives an empty result. Very long texts are handled whole.

Near duplicates and encoding send texts to Python in batches of ``BATCH``: by Spark's default of 64 MB two tasks would hold
several hundred MB of them outside the executor's heap. ``run`` begins with the session's own value, also where stages were called
alone before and have left theirs, and puts back what it found.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm import bpe_codec, decontaminate, jaccard_join, language_id, line_dedup
from panelloom.llm.common import released, shared_folder

#: Bytes of a batch, the setting that bounds it, and where a stage leaves the session's own value.
BATCH, BATCH_BYTES, OWN_BYTES = "4m", "spark.sql.execution.arrow.maxBytesPerBatch", "corpus_pipeline.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Batches of ``BATCH`` from now on: a stage's rows are read after it has returned."""
    if (own := spark.conf.get(BATCH_BYTES)) != BATCH:
        spark.conf.set(OWN_BYTES, own)
        spark.conf.set(BATCH_BYTES, BATCH)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with confidence; the others go."""
    return language_id.kept(docs, language_id.learn(docs))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of two or more full lines that occur earlier; a document of which nothing remains goes."""
    report = "line_dedup"
    while report in map(str.lower, docs.columns):
        report += "_"
    cut = line_dedup.without_passages(docs, report)
    changed = F.col(f"{report}.removed_lines") > 0
    cut = cut.filter(~changed | F.col("text").rlike(r"\S"))
    return cut.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop(report)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates: five-word shingles, similarity 0.8."""
    small_batches(spark)
    return jaccard_join.one_of_each(docs, n=5, percent=80)


def remove_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of each document's ids and of what they decode to."""
    small_batches(spark)
    return bpe_codec.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language", identify_language),
    ("lines", remove_repeated_lines),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", remove_benchmark_leaks),
    ("encoding", encode),
]

#: Trained models and token merges are beyond SQL; tests/llm/test_pipeline.py holds every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read by the next."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = spark.conf.get(BATCH_BYTES)
    if before == BATCH:
        spark.conf.set(BATCH_BYTES, spark.conf.get(OWN_BYTES, before))
    try:
        for name, stage in STAGES:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            released(spark)
    finally:
        spark.conf.set(BATCH_BYTES, before)
    return docs
