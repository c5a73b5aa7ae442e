"""Contents written anew without their metadata, and with fields replaced."""

from __future__ import annotations

import re
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from bitloom.sources.formats import parse_one

# Format, parts that are dropped (by the first part of the path).
DROPPED = {
    "png": re.compile(r"^/(text\[\d+\]|time)/"), "jpeg": re.compile(r"^/(comment|exif|photoshop|adobe)\[\d+\]/"), "mpeg_audio": re.compile(r"^/(id3v1|id3v2)/"),
    "au": re.compile(r"^/info$"), "wav": re.compile(r"^/(info|nb_sample)/"),
    "avi": re.compile(r"^/info/"),
}


def _tar_entry(header: bytearray) -> None:
    for at, size in ((108, 8), (116, 8)):  # owner and group
        header[at : at + size] = b"0000000\0"
    header[136:148] = b"00000000000\0"
    for at in (265, 297):  # their names
        header[at : at + 32] = bytes(32)
    header[148:156] = b" " * 8
    header[148:156] = b"%06o\0 " % sum(header)


def strip_one(data: bytes, name: str) -> tuple[bytes, int]:
    """(content without metadata, bits removed or blanked); contents that can't be read to their end are left alone."""
    fields = parse_one(data, name) if name in DROPPED or name == "tar" else []
    if not fields or fields[-1][0] == "/raw[0]":
        return data, 0
    if name == "tar":
        out, removed = bytearray(data), 0
        for path, address, _, _ in fields:
            if re.fullmatch(r"/file\[\d+\]/name", path):
                entry = bytearray(out[address // 8 : address // 8 + 512])
                _tar_entry(entry)
                out[address // 8 : address // 8 + 512] = entry
                removed += (8 + 8 + 12 + 32 + 32) * 8
        return bytes(out), removed
    unused = {p.rsplit("/", 1)[0] for p, _, _, v in fields if name in ("wav", "avi") and p.endswith("/tag") and v == "JUNK"}
    drop = [(a // 8, (a + s) // 8) for p, a, s, _ in fields if DROPPED[name].match(p) or p.rsplit("/", 1)[0] in unused]
    if not drop:
        return data, 0
    kept, at = [], 0
    for a, b in sorted(drop):
        kept.append(data[at:a])
        at = max(at, b)
    out = bytearray(b"".join([*kept, data[at:]]))
    if name == "au":  # the sound starts right after the fixed header
        struct.pack_into(">I", out, 4, 24)
    if name in ("wav", "avi"):
        struct.pack_into("<I", out, 4, len(out) - 8)
    return bytes(out), (len(data) - len(out)) * 8


def stripped(content: Column, name: Column) -> Column:
    """Struct (content, removed_bits) of each content without its metadata; null stays null."""

    def run(contents: pd.Series, names: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if c is None else strip_one(bytes(c), n) for c, n in zip(contents, names)]
        return pd.DataFrame({"content": [c for c, _ in rows], "removed_bits": pd.array([n for _, n in rows], dtype="Int64")})

    return F.pandas_udf(run, "content binary, removed_bits long")(content, name)


def write_bits(data: bytes, address: int, size: int, value: int) -> bytes:
    """``data`` with ``size`` bits at bit ``address`` set to ``value``, most significant first; ValueError if it doesn't fit."""
    if not 0 <= value < 1 << size or address < 0 or address + size > len(data) * 8:
        raise ValueError("the value or the place doesn't fit")
    shift = len(data) * 8 - address - size
    whole = int.from_bytes(data, "big")
    return (whole & ~((1 << size) - 1 << shift) | value << shift).to_bytes(len(data), "big")
