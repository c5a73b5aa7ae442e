"""The metadata registry: ranked keys, validated and de-duplicated values, and their exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.functions.text import LONGEST, normalize_newline, normalize_string, truncate
from bitloom.operators.registry import REGISTRY


def clean(value: Column) -> Column:
    """A value as the registry keeps it: trimmed, newlines normal, cut at 300; null if nothing is left."""
    text = truncate(normalize_newline(normalize_string(value)), LONGEST)
    return F.when(text != "", text)


def fold(values: Column) -> Column:
    """Ordered values without repeats; a value that begins with a kept one replaces it, one that a kept one begins with is dropped."""
    kept = F.aggregate(
        values,
        F.array().cast("array<string>"),
        lambda acc, v: F.when(v.isNull() | F.exists(acc, lambda a: a.startswith(v)), acc)
        .when(F.exists(acc, lambda a: v.startswith(a)), F.transform(acc, lambda a: F.when(v.startswith(a), v).otherwise(a)))
        .otherwise(F.array_append(acc, v)),
    )
    return F.array_distinct(kept)


def registered(items: DataFrame) -> DataFrame:
    """(source_id, meta_key, priority, kept): the folded values of each key of each source."""
    once = items.dropDuplicates(["item_id"]).withColumn("value", clean(F.col("value"))).where("value is not null")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "item_id", "value"))), lambda x: x["value"])
    return once.groupBy("source_id", "meta_key").agg(F.min("priority").alias("priority"), fold(ordered).alias("kept"))


def level_priority(level: int) -> int:
    """Highest priority that a report of level 1 to 9 shows."""
    return min(max(level * 100 + 99, 100), 999)


def quality_limit(quality: float) -> int | None:
    """Entries that an archive reports at a quality of 0 to 1; None is all."""
    return 0 if quality <= 0 else None if quality >= 1 else 1 + int(10 * quality)


def plain_text(items: DataFrame, level: int = 9) -> DataFrame:
    """(source_id, report): "- key: value" lines by priority, key and number."""
    once = items.dropDuplicates(["item_id"]).withColumn("value", clean(F.col("value"))).where((F.col("value").isNotNull()) & (F.col("priority") <= level_priority(level)))
    line = F.concat(F.lit("- "), "meta_key", F.lit(": "), "value")
    # ties of priority in the order of registration; keys that aren't registered come last, by name
    place = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, (k, *_) in enumerate(REGISTRY) for x in (k, i)]), F.col("meta_key")), F.lit(len(REGISTRY)))
    sorted_ = F.array_sort(F.collect_list(F.struct("priority", place.alias("place"), "meta_key", "item_id", line.alias("line"))))
    return once.groupBy("source_id").agg(F.array_join(F.transform(sorted_, lambda x: x["line"]), "\n").alias("report"))


def dictionary(items: DataFrame) -> DataFrame:
    """(source_id, group_name, meta_key, value): the last value of each key wins."""
    once = items.dropDuplicates(["item_id"]).where("value is not null")
    return once.groupBy("source_id", "group_name", "meta_key").agg(F.max_by("value", F.struct("ord", "item_id")).alias("value"))
