"""Queries p6_ and p7_."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm import mixing, packing, tokens
from bitloom.sources import checkpoint, read_table


def _sized(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Each document once with its size, cluster (its family: members are copies of one another) and quality weight.

    The weight is the share of the record's particulars that are filled in; sizes are written to the shared folder, so
    texts are tokenised once.
    """
    docs = read_table(spark, sf_dir, "documents")
    filled = sum(F.when(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""), 1).otherwise(0) for c in ("lang", "kind_code", "n_claims", "pub_number"))
    return checkpoint(docs.select("doc_id", "source", F.col("family_id").alias("cluster"), ((filled + 1) / 5.0).alias("weight"), tokens.token_count(F.col("text"), path).alias("tokens")))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's container, or containers if it exceeds the capacity, for each capacity."""
    sized = _sized(spark, sf_dir)
    capacities = {r["pack_id"]: r["capacity_tokens"] for r in read_table(spark, sf_dir, "pack_sizes").collect()}
    return packing.pack(sized, capacities, sized.count())


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and unused share of each capacity."""
    sizes = read_table(spark, sf_dir, "pack_sizes")
    used = p6_containers(spark, sf_dir).groupBy("pack_id", "container_id").agg(F.sum("tokens").alias("tokens")).groupBy("pack_id").agg(F.count("*").alias("n_containers"), F.sum("tokens").alias("tokens"))
    return sizes.join(used, "pack_id").withColumn("unused", F.round(1 - F.col("tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each mix uses each document."""
    return mixing.mix(_sized(spark, sf_dir), read_table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every source in every mix."""
    return mixing.shares(p7_mix(spark, sf_dir), read_table(spark, sf_dir, "mix_targets"))


QUERIES = {"p6_containers": p6_containers, "p6_fill": p6_fill, "p7_mix": p7_mix, "p7_shares": p7_shares}
