"""The thin queries opN_<name> over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm import bpe_codec, decontaminate, filter_audit, jaccard_join, language_id, line_dedup, lm_scoring, packing, quality_rules, sharding, source_divergence, suffix_dedup, token_counts
from panelloom.llm.common import documents


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(_remainder(7) == 2, F.lit(False))
    return lm_scoring.scored(docs, *lm_scoring.fit(docs.filter(~held_out)))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(documents(spark, sf_dir), shards=16)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.passage_report(documents(spark, sf_dir))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(documents(spark, sf_dir))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(documents(spark, sf_dir), n=4, percent=85)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(_remainder(4) == 2, F.lit(False))
    found = language_id.identified(docs, language_id.learn(docs.filter(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergences(documents(spark, sf_dir), least=3, ranks=200)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end=2)


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_token_counts, op3_decontaminate, op4_sharding, op5_line_dedup, op6_suffix_dedup, op7_jaccard_join, op8_quality_rules, op9_language_id, op10_byte_bpe, op11_source_divergence, op12_filter_audit, op13_packing)}
SQL: dict[str, str] = {"op5_line_dedup": line_dedup.PASSAGE_SQL, "op11_source_divergence": source_divergence.SQL, "op12_filter_audit": filter_audit.SQL}
