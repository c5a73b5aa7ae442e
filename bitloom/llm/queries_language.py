"""Queries p8_."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm import language
from bitloom.sources import read_table


def _identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), read_table(spark, sf_dir, "languages"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.label_faults(_identified(spark, sf_dir))


def p8_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's main language, all its languages, and the confidence of the main one (mean over its passages)."""
    mine = F.filter("segments", lambda s: s["running"] & (s["lang"] == F.col("main_lang")))
    mean = F.aggregate(mine, F.lit(0.0), lambda a, s: a + s["confidence"]) / F.nullif(F.size(mine), F.lit(0))
    return _identified(spark, sf_dir).select("doc_id", F.col("code").alias("labelled"), F.col("main_lang").alias("lang"), F.array_join("text_langs", ",").alias("langs"), mean.alias("confidence"))


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each passage of running text with its place, language and confidence."""
    rows = _identified(spark, sf_dir).select("doc_id", F.explode("segments").alias("s")).where("s.running")
    return rows.select("doc_id", "s.start", "s.stop", "s.lang", "s.confidence")


QUERIES = {"p8_found": p8_found, "p8_documents": p8_documents, "p8_segments": p8_segments}
