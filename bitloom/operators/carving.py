"""Embedded files found in contents by magic numbers, checked by their headers, with their sizes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.operators.detect import FORMATS
from bitloom.operators.validate import content_size, valid

CARVED_SCHEMA = "id long, offset long, size long, format string, name string"


def carve_one(data: bytes, formats: tuple[str, ...] | None = None) -> list[tuple[int, int | None, str]]:
    """(offset, size, format) of embedded files, first to last.

    All magic numbers are looked for at once over the whole content, so none is missed at an edge. A hit counts if its header is valid
    (:mod:`bitloom.operators.validate`) and its size, if told, fits; what lies inside a file of known size isn't looked at.
    """
    wanted = [(n, bytes.fromhex(m), o) for n, _, _, _, m, o in FORMATS if m and (formats is None or n in formats)]
    by_magic: dict[bytes, tuple[str, int]] = {}
    for n, m, o in sorted(wanted, key=lambda x: (-len(x[1]), x[0])):
        by_magic.setdefault(m, (n, o))
    if not by_magic:
        return []
    union, out, free = re.compile(b"|".join(re.escape(m) for m in by_magic), re.DOTALL), [], 0
    at = 0
    while (hit := union.search(data, at)) is not None:
        name, offset = by_magic[hit.group()]
        start, at = hit.start() - offset, hit.start() + 1
        if start < free or not valid(data, name, start):
            continue
        size = content_size(data, name, start)
        if size is not None and size > len(data) - start:
            continue
        out.append((start, size, name))
        free = start + (size or len(hit.group()))
        at = max(at, free)
    return out


def carve_files(contents: DataFrame, formats: tuple[str, ...] | None = None) -> DataFrame:
    """(id, offset, size, format, name) for every file embedded in ``contents`` (id, content); null contents hold none.

    Names number the files of a content from 1; a size of null means that the end isn't told by the format.
    """
    ends = {n: "." + e.split()[0] for n, _, e, *_ in FORMATS}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, o, s, n, f"file-{k:04d}{ends[n]}") for i, c in zip(b["id"], b["content"]) for k, (o, s, n) in enumerate(carve_one(bytes(c), formats), 1)]
            yield pd.DataFrame(rows, columns=["id", "offset", "size", "format", "name"]).astype({"size": "Int64"})

    return contents.where("content is not null").select("id", "content").mapInPandas(run, CARVED_SCHEMA)


def statistics(carved: DataFrame) -> DataFrame:
    """(format, hits, valid): carved files and those with a known size."""
    return carved.groupBy("format").agg(F.count("*").alias("hits"), F.count("size").alias("valid")).orderBy(F.desc("hits"), "format")
