"""The field table: rows addressed in bits, found by path, address or text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bitloom.sources.tables import checkpoint


def lines(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line: key, ordinal, path, address (bytes), size (bytes, with the line end but for the last), value.

    Null texts give no row, an empty text one empty line. A running sum within a text would need a shuffle of all texts as
    a window; here each Arrow batch is split and summed in place, column by column, and nothing moves.
    """
    rows = documents.where(F.col(text).isNotNull()).select(key, F.col(text).alias("value"))
    kind = rows.schema[key].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = pc.split_pattern(batch.column(1), "\n")
            count = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
            value = parts.flatten()
            size = pc.binary_length(value).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            stop = np.cumsum(count)
            size[stop - 1] -= 1
            total, first = np.cumsum(size), np.repeat(stop - count, count)
            address = total - size - (total - size)[first] if len(size) else size
            ordinal = np.arange(len(size), dtype=np.int64) - first if len(size) else size
            keys = batch.column(0).take(pa.array(np.repeat(np.arange(len(count)), count)))
            yield pa.RecordBatch.from_arrays([keys, pa.array(ordinal.astype(np.int32)), pa.array(address), pa.array(size), value], names=[key, "ordinal", "address", "size", "value"])

    out = rows.mapInArrow(split, f"`{key}` {kind}, ordinal int, address long, size long, value string")
    return out.select(key, "ordinal", F.concat(F.lit("/line["), "ordinal", F.lit("]")).alias("path"), "address", "size", "value")


def grep(fields: DataFrame, pattern: str | None, case: bool = False, value: str = "value") -> DataFrame:
    """Rows whose value holds ``pattern``; without a pattern all that aren't empty."""
    v = F.col(value)
    kept = fields.where((v.isNotNull()) & (v != ""))
    if not pattern:
        return kept
    return kept.where(v.contains(pattern) if case else F.lower(v).contains(pattern.lower()))


def address_text(bits: Column) -> Column:
    """Bytes, and the bit after a dot if the address isn't a whole byte."""
    byte = F.floor(bits / 8).cast("string")
    return F.when(bits % 8 == 0, byte).otherwise(F.concat(byte, F.lit("."), (bits % 8).cast("string")))


def by_path(fields: DataFrame, path: str) -> DataFrame:
    """Rows at a path, which may climb with .. and stand still with . relative to the root."""
    parts: list[str] = []
    for p in path.split("/"):
        if p and set(p) == {"."}:
            del parts[max(0, len(parts) - (len(p) - 1)) :]
        elif p:
            parts.append(p)
    return fields.where(F.col("path") == "/" + "/".join(parts))


def base_name(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\[\d+\]$", "")


def numbered(fields: DataFrame, keys: list[str], base: Column, order: str) -> DataFrame:
    """``fields`` with idx: the number of a row among those of its parent that share its base name, from 0."""
    return fields.withColumn("base", base).withColumn("idx", F.row_number().over(W.partitionBy(*keys, "base").orderBy(order)) - 1)


def containing(probes: DataFrame, fields: DataFrame, page_bits: int = 4096) -> DataFrame:
    """For each probe (source_id, probe_bits) the innermost field that covers the address; probes without one stay, with nulls.

    Fields are listed under every page that they touch, so the range join is an equi-join on (source, page) with a bounded
    remainder; of the fields that cover an address the smallest, then the latest, is innermost.
    """
    sized = fields.where("size_bits > 0").select("source_id", "path", "address_bits", "size_bits")
    pages = F.sequence(F.floor(F.col("address_bits") / page_bits), F.floor((F.col("address_bits") + F.col("size_bits") - 1) / page_bits))
    paged = sized.withColumn("page", F.explode(pages))
    asked = probes.withColumn("page", F.floor(F.col("probe_bits") / page_bits))
    hits = asked.join(paged, ["source_id", "page"]).where("probe_bits >= address_bits and probe_bits < address_bits + size_bits")
    best = hits.groupBy("source_id", "probe_bits").agg(F.min(F.struct("size_bits", (-F.col("address_bits")).alias("later"), "path")).alias("b"))
    return probes.join(best, ["source_id", "probe_bits"], "left").select("source_id", "probe_bits", F.col("b.path").alias("path"))


def gaps(blocks: DataFrame, key: str, address: str, size: str, ranges: DataFrame) -> DataFrame:
    """(key, gap_start, gap_size): stretches of each key's range that no block covers, also before the first and after the last.

    ``ranges`` (key, start, length): what is to be covered; a key without blocks is one gap, blocks of other keys count for nothing.
    Overlapping and repeated blocks count once; blocks without an address or size count as none.
    """
    ends = ranges.select(key, F.col("start").cast("bigint").alias("_from"), (F.col("start") + F.col("length")).cast("bigint").alias("_to"))
    rows = blocks.select(key, F.col(address).cast("bigint").alias("_a"), F.col(size).cast("bigint").alias("_s")).where("_a is not null and _s is not null").join(ends, key)
    # the end of the range stands as an empty block behind all others
    rows = rows.withColumn("_last", F.lit(0)).unionByName(ends.select(key, F.col("_to").alias("_a"), F.lit(0).cast("bigint").alias("_s"), "_from", "_to", F.lit(1).alias("_last")))
    reach = F.max(F.col("_a") + F.col("_s")).over(W.partitionBy(key).orderBy("_last", "_a", "_s").rowsBetween(W.unboundedPreceding, -1))
    reach = F.greatest(F.coalesce(reach, F.col("_from")), F.col("_from"))
    return rows.withColumn("_reach", reach).where(F.col("_a") > F.col("_reach")).select(key, F.col("_reach").alias("gap_start"), (F.col("_a") - F.col("_reach")).alias("gap_size"))


def depths(rows: DataFrame, keys: list[str], node: str, parent: str, root: str = "/") -> DataFrame:
    """(keys, node, depth) of every row whose chain of parents leads to ``root``; 1 right below it.

    Pointer doubling: every round joins the chains with themselves, so a chain of n links takes log2(n) rounds, each written to
    the checkpoint folder. Rows on a cycle, and below a missing parent, have no depth and give no row; repeated rows fold to one.
    """
    way = checkpoint(rows.select(*keys, F.col(node).alias("_n"), F.col(parent).alias("_p")).where("_n is not null").distinct().withColumn("_d", F.lit(1).cast("bigint")))
    rounds = max(1, way.count()).bit_length() + 1
    for _ in range(rounds):
        if way.where(F.col("_p") != root).isEmpty():
            break
        up = way.select(*keys, F.col("_n").alias("_p"), F.col("_p").alias("_pp"), F.col("_d").alias("_dd"))
        met = way.where(F.col("_p") != root).join(up, [*keys, "_p"])
        way = checkpoint(way.where(F.col("_p") == root).unionByName(met.select(*keys, "_n", F.col("_pp").alias("_p"), (F.col("_d") + F.col("_dd")).alias("_d"))))
    return way.where(F.col("_p") == root).select(*keys, F.col("_n").alias(node), F.col("_d").cast("int").alias("depth"))


def overlay(base: DataFrame, changes: DataFrame, deleted: DataFrame, inserted: DataFrame, keys: list[str]) -> DataFrame:
    """Edited rows: deletions out, changed values in, insertions (after ``ordinal``) between, addresses counted anew."""
    kept = base.join(deleted.select(*keys, "ordinal"), [*keys, "ordinal"], "left_anti")
    new = changes.select(*keys, "ordinal", F.col("value").alias("new_value"))
    kept = kept.join(new, [*keys, "ordinal"], "left").select(*keys, F.col("ordinal").cast("double").alias("place"), F.coalesce("new_value", "value").alias("value"))
    both = kept.unionByName(inserted.select(*keys, (F.col("ordinal") + 0.5).alias("place"), "value"))
    order = W.partitionBy(*keys).orderBy("place")
    both = both.withColumn("ordinal", (F.row_number().over(order) - 1).cast("int")).withColumn("size", (F.octet_length("value") + 1).cast("bigint"))
    before = W.partitionBy(*keys).orderBy("ordinal").rowsBetween(W.unboundedPreceding, -1)
    return both.select(*keys, "ordinal", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("bigint").alias("address"), "value")


def join_ordered(rows: DataFrame, keys: list[str], order: str, value: str, glue: str = "") -> DataFrame:
    """Fragments of each key put together in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"])
    return rows.groupBy(*keys).agg(F.array_join(parts, glue).alias("joined"), F.count("*").alias("n_parts"))
