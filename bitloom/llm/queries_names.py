"""Queries p2_."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm import encoding, names
from bitloom.sources import checkpoint, read_table

CASES = "(meta_class = 'MpegAudioMetadata' and meta_key in ('author', 'producer')) or (meta_class = 'AsfMetadata' and meta_key = 'author')"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item once, with its text as written and with wrong decoding undone."""
    items = read_table(spark, sf_dir, "metadata_items").where(CASES).groupBy("item_id").agg(F.min("value").alias("value"))
    return checkpoint(encoding.find_garbled(items).select("item_id", "value", "restored"))


def p2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item with the agents that it names, exact spellings too."""
    items, agents = _items(spark, sf_dir), read_table(spark, sf_dir, "agents")
    links = names.link_names(items, agents, "restored").withColumnRenamed("value", "restored")
    return items.join(links, "restored").select("item_id", "value", "agent_id", "distance").distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = read_table(spark, sf_dir, "agents").select(F.col("agent_name").alias("value")).distinct()
    return p2_links(spark, sf_dir).join(exact, "value", "left_anti").select("item_id", "agent_id").distinct()


QUERIES = {"p2_found": p2_found, "p2_links": p2_links}
