"""Field rows chosen by place, type and size; reads over extents, cues, group numbers, look-ups of metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Types of fields that hold text and whole numbers.
TEXTS = ("CString", "String", "PascalString8", "PascalString16", "PascalString32", "UnixLine", "Character")
INTEGERS = ("Bit", "Bits", "UInt8", "UInt16", "UInt24", "UInt32", "UInt64", "Int8", "Int16", "Int24", "Int32", "Int64", "Enum")
#: Width of the pages over which reads and extents meet: an extent is listed once for each it touches.
PAGE = 1 << 20


def by_index(fields: DataFrame, index: int) -> DataFrame:
    """The field at a place of each field set, counted from 0; a negative place is none's."""
    return fields.where(F.lit(index >= 0) & (F.col("ordinal") == index))


def first_fields(fields: DataFrame, n: int) -> DataFrame:
    """The first ``n`` fields of each field set."""
    return fields.where(F.col("ordinal") < n)


def is_text(field_type: Column) -> Column:
    return field_type.isin(*TEXTS)


def is_integer(field_type: Column) -> Column:
    return field_type.isin(*INTEGERS)


def has_bits(data: Column, n: int | Column) -> Column:
    """Whether a content has at least ``n`` bits; null for null."""
    return F.octet_length(data) * 8 >= n


def numbered_groups(rows: DataFrame, keys: list[str], base: str, order: list[str]) -> DataFrame:
    """``rows`` with group: ``base`` and a number from 1 in order within ``keys`` and base, as "audio[1]"."""
    i = F.row_number().over(W.partitionBy(*keys, base).orderBy(*order))
    return rows.withColumn("group", F.concat(F.col(base), F.lit("["), i.cast("string"), F.lit("]")))


def get(items: DataFrame, key: str, default: str | None = None, index: int = 0) -> DataFrame:
    """(source_id, value): the ``index``-th value of ``key`` of every source in ``items``, ``default`` where it has none."""
    values = F.array_sort(F.array_agg(F.when((F.col("meta_key") == key) & F.col("value").isNotNull(), F.struct("ord", "item_id", "value"))))
    return items.dropDuplicates(["item_id"]).groupBy("source_id").agg(F.coalesce(F.try_element_at(values, F.lit(index + 1))["value"], F.lit(default)).alias("value"))


def read_extents(reads: DataFrame, extents: DataFrame, key: str, page: int = PAGE) -> DataFrame:
    """(key, at, n, piece_at, source_at, size): the pieces of each read (key, at, n) in the extents (key, logical, size, source) of its stream.

    An interval join made an equi-join: both sides are listed by the pages they touch, and a pair counts on the first page they share.
    Reads beyond the extents get the pieces there are; empty extents and reads give none.
    """
    pages = lambda at, n: F.explode(F.sequence(F.floor(at / page), F.floor((at + n - 1) / page)))
    asked = reads.where("n > 0").select(key, "at", "n", pages(F.col("at"), F.col("n")).alias("_page"))
    held = extents.where("size > 0").select(key, "logical", F.col("size").alias("_size"), "source", pages(F.col("logical"), F.col("size")).alias("_page"))
    low = F.greatest("at", "logical")
    high = F.least(F.col("at") + F.col("n"), F.col("logical") + F.col("_size"))
    met = asked.join(held, [key, "_page"]).where((high > low) & (F.floor(low / page) == F.col("_page")))
    return met.select(key, "at", "n", low.alias("piece_at"), (F.col("source") + low - F.col("logical")).alias("source_at"), (high - low).alias("size"))


def cue_blocks(cues: DataFrame, clusters: DataFrame, blocks: DataFrame) -> DataFrame:
    """(stream, time, track, block): the block that each cue (stream, time, track, cluster_at) points to, by its cluster's address (stream,
    cluster_at, cluster, timecode), then by track and time relative to the cluster in blocks (stream, cluster, track, relative, block); null for none."""
    placed = cues.join(clusters, ["stream", "cluster_at"], "left").withColumn("relative", F.col("time") - F.col("timecode"))
    return placed.join(blocks, ["stream", "cluster", "track", "relative"], "left").select("stream", "time", "track", "block")
