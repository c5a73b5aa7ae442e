"""Statistics over bytes, and patterns found in them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def histogram(rows: DataFrame, keys: list[str], data: Column) -> DataFrame:
    """(keys, byte, n): how often each byte value occurs, counted per key and batch before the shuffle; null and empty contents have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums: dict[tuple, np.ndarray] = {}
            names = list(zip(*[batch[k] for k in keys])) if keys else [()] * len(batch)
            for name, content in zip(names, batch["_data"]):
                if content:
                    counts = np.bincount(np.frombuffer(content, dtype=np.uint8), minlength=256)
                    sums[name] = sums[name] + counts if name in sums else counts
            out = [(*name, int(b), int(counts[b])) for name, counts in sums.items() for b in np.flatnonzero(counts)]
            yield pd.DataFrame(out, columns=[*keys, "byte", "n"])

    schema = T.StructType([*rows.select(*keys).schema.fields, T.StructField("byte", T.IntegerType()), T.StructField("n", T.LongType())])
    return rows.select(*keys, data.alias("_data")).mapInPandas(run, schema).groupBy(*keys, "byte").agg(F.sum("n").alias("n"))


def entropy(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_bytes, entropy): bits per byte of a histogram."""
    sums = counts.groupBy(*keys).agg(F.sum("n").alias("n_bytes"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return sums.select(*keys, "n_bytes", F.round(F.log2("n_bytes") - F.col("s") / F.col("n_bytes"), 6).alias("entropy"))


def byte_sum(data: Column) -> Column:
    """Sum of the byte values."""
    return F.aggregate(F.regexp_extract_all(F.hex(data), F.lit("(..)"), 1), F.lit(0).cast("bigint"), lambda a, h: a + F.conv(h, 16, 10).cast("bigint"))


def carve(rows: DataFrame, keys: list[str], text: Column, patterns: dict[str, str]) -> DataFrame:
    """(keys, pattern, hits): non-overlapping matches of each pattern in each row."""
    counts = F.array(*[F.struct(F.lit(name).alias("pattern"), F.regexp_count(text, F.lit(p)).alias("hits")) for name, p in sorted(patterns.items())])
    return rows.select(*keys, F.inline(counts))


def slices(rows: DataFrame, keys: list[str], text: Column, size: int, overlap: int = 0) -> DataFrame:
    """Windows of ``size`` characters, each with ``overlap`` of the next, so that a match across an edge isn't missed."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size))
    return rows.select(*keys, text.alias("_t"), F.posexplode(starts).alias("slice_no", "start")).select(*keys, "slice_no", "start", F.substr("_t", F.col("start") + 1, F.lit(size + overlap)).alias("part"))
