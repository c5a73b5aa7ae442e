"""Sources mixed to target weights by weighted sampling with exponential keys.

A mix is as large as its sources allow within their repeats. Of each source all documents are taken for as many complete
epochs as its share needs; the rest of its share is filled in the order of Efraimidis-Spirakis keys -ln(u)/w. Prefix sums run over
buckets of keys first and then within buckets, so that no source is ever ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Key buckets of a source.
BUCKETS = 4096


def sampling_key(seed: Column, weight: Column) -> Column:
    """-ln(u)/w with u drawn by a hash of ``seed``: small keys come first, heavy documents tend to have small ones."""
    u = (F.pmod(F.xxhash64(seed), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def mix(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, source, doc_id, tokens, copies): how often each mix uses each document.

    ``documents``: doc_id, source, tokens, weight (over 0); ``targets``: mix_id, source, target_share, max_repeats, a small
    fixed table. Documents without source or tokens are in no mix; sources of a mix that have no documents, or a share of
    0 or null, contribute nothing; null repeats count as one. Copies never exceed the repeats.
    """
    usable = documents.where("source is not null and tokens > 0").select("doc_id", "source", "tokens", F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(1e-6)).alias("weight"))
    wanted = targets.where("target_share > 0").select("mix_id", "source", "target_share", F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("repeats"))
    sums = usable.groupBy("source").agg(F.sum("tokens").alias("held"))
    plan = wanted.join(sums, "source").withColumn("size", F.min(F.col("held") * F.col("repeats") / F.col("target_share")).over(W.partitionBy("mix_id")))
    plan = plan.withColumn("budget", F.least(F.col("size") * F.col("target_share"), (F.col("held") * F.col("repeats")).cast("double")))
    plan = plan.withColumn("epochs", F.least(F.floor(F.col("budget") / F.col("held") + 1e-9), F.col("repeats")))
    plan = plan.select("mix_id", "source", "epochs", F.when(F.col("epochs") < F.col("repeats"), F.col("budget") - F.col("epochs") * F.col("held")).otherwise(0.0).alias("rest"))
    keyed = usable.join(F.broadcast(plan), "source")  # targets are a fixed few rows
    keyed = keyed.withColumn("key", sampling_key(F.concat_ws(":", "mix_id", "doc_id"), F.col("weight")))
    keyed = keyed.withColumn("bucket", F.floor(F.col("key") / (1 + F.col("key")) * BUCKETS).cast("int"))
    before = keyed.groupBy("mix_id", "source", "bucket").agg(F.sum("tokens").alias("in_bucket"))
    before = before.withColumn("before", F.sum("in_bucket").over(W.partitionBy("mix_id", "source").orderBy("bucket")) - F.col("in_bucket"))
    placed = keyed.join(before.drop("in_bucket"), ["mix_id", "source", "bucket"])
    inside = F.sum("tokens").over(W.partitionBy("mix_id", "source", "bucket").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("tokens")
    picked = F.col("before") + inside + F.col("tokens") / 2 <= F.col("rest")
    return placed.withColumn("copies", (F.col("epochs") + F.when(picked, 1).otherwise(0)).cast("int")).where("copies > 0").select("mix_id", "source", "doc_id", "tokens", "copies")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, source, target_share, max_repeats, n_documents, used_tokens, actual_share, most_copies, reason) for every target.

    ``reason`` tells why a target has no tokens ('no documents', 'no share'), whose share the other sources of its mix then have; null
    where it has some.
    """
    sums = mixed.groupBy("mix_id", "source").agg(F.count("*").alias("n_documents"), F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.max("copies").alias("most_copies"))
    out = targets.join(sums, ["mix_id", "source"], "left").fillna(0, ["n_documents", "used_tokens", "most_copies"])
    total = F.sum("used_tokens").over(W.partitionBy("mix_id"))
    reason = F.when(F.coalesce(F.col("target_share"), F.lit(0.0)) <= 0, "no share").when(F.col("used_tokens") == 0, "no documents")
    return out.withColumn("reason", reason).withColumn("actual_share", F.when(total > 0, F.round(F.col("used_tokens") / total, 6)).otherwise(0.0))
