"""Strings inside bytes: terminated, length-prefixed and fixed ones. Sizes include terminators and prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bitloom.functions.bits import BIG, bytes_to_int, read_bytes


def _latin(data: Column) -> Column:
    return F.decode(data, "ISO-8859-1")


def terminated(data: Column, at: Column, end: str = "\0", charset: str = "ISO-8859-1") -> Column:
    """Struct (value, size) of the string from byte ``at`` to the terminator; null where there is none.

    The search runs over the bytes as Latin-1, so that positions are bytes.
    """
    rest = F.substr(data, at + 1)
    n = F.locate(end, _latin(rest))
    return F.when(n > 0, F.struct(F.decode(F.substr(rest, F.lit(1), n - 1), charset).alias("value"), n.alias("size")))


def pascal(data: Column, at: Column, prefix: int = 1, endian: str = BIG, charset: str = "ISO-8859-1") -> Column:
    """Struct (value, size) of a string behind its length in ``prefix`` bytes; null where the bytes don't reach."""
    n = bytes_to_int(F.substr(data, at + 1, F.lit(prefix)), endian).cast("int")
    whole = F.octet_length(data) >= at + prefix + n
    return F.when(whole, F.struct(F.decode(read_bytes(data, at + prefix, n), charset).alias("value"), (n + prefix).alias("size")))


def fixed(data: Column, at: int, size: int, strip: bool = True, charset: str = "ISO-8859-1") -> Column:
    """A string of ``size`` bytes, without NULs and spaces at its end if ``strip``."""
    text = F.decode(read_bytes(data, at, size), charset)
    return F.regexp_replace(text, "[\\x00 ]+$", "") if strip else text


def all_pattern(data: Column, byte: int = 0, most: int = 4096) -> Column:
    """Whether the first ``most`` bytes are all ``byte``, as padding is; true for empty, null for null."""
    return F.hex(F.substring(data, 1, most)).rlike(f"^({byte:02X})*$")
