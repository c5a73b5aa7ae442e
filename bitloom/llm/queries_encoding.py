"""Queries p4_."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm import encoding
from bitloom.sources import read_table

CASES = "(meta_class = 'MpegAudioMetadata' and meta_key in ('title', 'author')) or (meta_class = 'PngMetadata' and meta_key = 'comment')"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read_table(spark, sf_dir, "metadata_items").where(CASES)
    return encoding.find_garbled(items.groupBy("item_id").agg(F.min("value").alias("value")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).where("garbled").select("item_id")


def p4_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item's verdict by the models alone: the likeliest chain's gain, the margin, and the text if the gain is beyond it."""
    judged, accepted = _judged(spark, sf_dir), F.col("gain") >= F.col("margin")
    return judged.select("item_id", "value", F.round("gain", 3).alias("gain"), "margin", accepted.alias("garbled"), F.when(accepted, F.col("chain")).alias("chain"), F.when(accepted, F.col("restored")).otherwise(F.col("value")).alias("restored"))


def p4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each garbled value, the chain that restores it, its gain in bits and the restored text."""
    return _judged(spark, sf_dir).where("garbled").select("item_id", "value", "chain", F.round("gain", 3).alias("gain"), "restored")


QUERIES = {"p4_method": p4_method, "p4_found": p4_found, "p4_restored": p4_restored}
