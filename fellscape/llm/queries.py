"""Registered queries of the text operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from fellscape.llm import (chat, decontaminate, digests, hardneg, katz, licenses, linededup, mixing, periodic, quality, reputation,
                           sharding, simhash, toxicity)
from fellscape.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


@query("op1_quality_rules", quality.sql())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.drop("n_lines").withColumn("broken", F.concat_ws(",", "broken"))


@query("op2_url_reputation", reputation.SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reputation.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


@query("op3_simhash_near_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents"))


@query("op4_systematic_mixing", mixing.SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


@query("op5_aligned_line_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.without_repeats(table(spark, sf_dir, "documents"))


@query("op6_template_decontamination")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_chat_repair")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(table(spark, sf_dir, "conversations"))


@query("op8_katz_scores")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_hypergeometric_shards")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


@query("op11_rare_word_licenses")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.of_licenses(licenses.scan(table(spark, sf_dir, "documents")), licenses.BASE_SCORE)


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.of_runs(periodic.mark(digests.with_planted_runs(table(spark, sf_dir, "documents"))))


@query("op13_zone_map_negatives", hardneg.SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL is not None:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
