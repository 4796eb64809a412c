"""Registered queries of the corpus operators and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm import backoff, decontaminate, htmlmain, langid, linededup, mixing, oracles, quality, simhash, toxicity, urlfilter
from trawl.llm.base import read


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(read(spark, sf_dir, "documents"), spark)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select("doc_id", *counts, "base_failed", "kept")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(read(spark, sf_dir, "documents"), spark)
    rounded = [F.round(c, 6).alias(c) for c in ("weight", "probability")]
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", *rounded, "kept")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(urlfilter.RULES, "host string, path string, verdict string")
    return urlfilter.filter_urls(read(spark, sf_dir, "pages"), rules)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = backoff.score(read(spark, sf_dir, "documents"), spark)
    mean = F.when(F.col("n_words") > 0, F.round(F.col("score") / F.col("n_words"), 5))
    return out.select("doc_id", "n_words", F.round("score", 5).alias("score"), mean.alias("mean_score"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = langid.identify(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlmain.extract(read(spark, sf_dir, "pages"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), spark)
    return found.groupBy("doc_id", "item_id").agg(F.round(F.max("similarity"), 9).alias("similarity"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(read(spark, sf_dir, "documents"), spark)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(read(spark, sf_dir, "documents"), spark)
    return out.select("doc_id", "n_lines", "n_kept", "text")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_toxicity": op2_toxicity,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_language_id": op4_language_id,
    "op5_source_mixing": op5_source_mixing,
    "op6_url_filters": op6_url_filters,
    "op7_html_extraction": op7_html_extraction,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_line_dedup": op10_line_dedup,
    "pipeline": pipeline,
}
ORACLES = {"op1_quality_rules": oracles.QUALITY, "op3_lm_scoring": oracles.BACKOFF, "op5_source_mixing": oracles.MIXING, "op6_url_filters": oracles.URLS, "op8_benchmark_decontamination": oracles.DECONTAMINATION}
