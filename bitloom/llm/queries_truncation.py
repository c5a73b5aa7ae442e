"""Queries p5_."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm import truncation
from bitloom.sources import read_table


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read_table(spark, sf_dir, "metadata_items").where("meta_class = 'MpegAudioMetadata' and meta_key in ('title', 'comment')")
    items = items.select(F.col("item_id").alias("row_id"), "source_id", "volume_id", F.col("meta_key").alias("kind"), F.col("meta_key").alias("field"), "value")
    owners = read_table(spark, sf_dir, "sources").groupBy("source_id").agg(F.min("volume_id").alias("volume_id"))
    games = read_table(spark, sf_dir, "field_rows").where("path = '/header/game_title'").select(F.col("field_id").alias("row_id"), "source_id", F.lit("game").alias("kind"), F.lit("game_title").alias("field"), "value")
    return items.unionByName(games.join(owners, "source_id", "left").select(items.columns))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.find_truncated(_rows(spark, sf_dir)).where("cut").select("row_id")


def p5_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of the table with its verdict: the near-copy that it is aligned with, the edits between them and how that copy goes on, or
    what its closing word tells; null where it has neither."""
    return truncation.find_truncated(_rows(spark, sf_dir)).select("row_id", "field", "value", "cut", "why", "how", "edits", "copy")


def p5_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cut value with the reason."""
    return truncation.find_truncated(_rows(spark, sf_dir)).where("cut").select("row_id", "field", "value", "why")


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut values per volume and field."""
    found = truncation.find_truncated(_rows(spark, sf_dir))
    return found.groupBy("volume_id", "field").agg(F.count("*").alias("n_values"), F.count_if("cut").alias("n_cut"), F.round(F.avg(F.col("cut").cast("double")), 6).alias("rate"))


QUERIES = {"p5_found": p5_found, "p5_method": p5_method, "p5_values": p5_values, "p5_rates": p5_rates}
