"""Values of fields: floats in bytes, durations, addresses, sorted arrays, and how they are shown."""

from __future__ import annotations

import math
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from bitloom.functions.bits import byte_pairs
from bitloom.functions.human import _fixed
from bitloom.functions.text import printable


def float_of(raw: bytes | None, size: int, endian: str) -> float | None:
    """A float of 32, 64 or 80 bits; None unless there are as many bytes."""
    if raw is None or len(raw) != size // 8:
        return None
    if size != 80:
        return struct.unpack((">" if endian == "big" else "<") + ("f" if size == 32 else "d"), raw)[0]
    word = int.from_bytes(raw, endian)
    exponent, mantissa = word >> 64 & 0x7FFF, word & (1 << 64) - 1
    if exponent == 0x7FFF:
        value = math.inf if mantissa << 1 & (1 << 64) - 1 == 0 else math.nan
    else:
        try:
            value = math.ldexp(mantissa, exponent - 16383 - 63)
        except OverflowError:
            value = math.inf
    return -value if word >> 79 else value


def floats(data: Column, size: int = 64, endian: str = "big") -> Column:
    """Floats of 32, 64 or 80 bits from bytes, in Arrow batches; null for null and for another number of bytes."""

    def run(contents: pd.Series) -> pd.Series:
        return pd.Series([float_of(c, size, endian) for c in contents], dtype="float64")

    return F.pandas_udf(run, "double")(data)


def duration_win64(ticks: Column) -> Column:
    """Tenths of a microsecond as whole microseconds; null below 0."""
    return F.when(ticks >= 0, F.call_function("div", ticks, F.lit(10)))


def duration_ms_win64(millis: Column) -> Column:
    """Milliseconds as microseconds; null below 0."""
    return F.when(millis >= 0, millis.cast("bigint") * 1000)


def seconds(micros: Column) -> Column:
    """Microseconds as seconds with fractions."""
    return micros / F.lit(1e6)


def human_datetime(value: Column, strip_microsecond: bool = True) -> Column:
    """A timestamp with a blank between date and time, without its fraction unless asked for."""
    whole = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
    micros = F.date_format(value, "SSSSSS")
    return whole if strip_microsecond else F.when(micros == "000000", whole).otherwise(F.concat_ws(".", whole, micros))


def frame_rate(value: Column, divisor: int = 1) -> Column:
    return F.concat(_fixed(value, divisor, 1), F.lit(" fps"))


def compression_rate(value: Column, divisor: int = 1) -> Column:
    return F.concat(_fixed(value, divisor, 1), F.lit("x"))


def altitude(value: Column, divisor: int = 1) -> Column:
    return F.concat(_fixed(value, divisor, 1), F.lit(" meters"))


def pixels(value: Column) -> Column:
    return F.concat(value.cast("string"), F.lit(" pixels"))


def dpi(value: Column) -> Column:
    return F.concat(value.cast("string"), F.lit(" DPI"))


def timezone_name(hours: Column) -> Column:
    """The name of a zone that is so many whole hours ahead of UTC: UTC for none, else as +0200."""
    return F.when(hours == 0, "UTC").otherwise(F.concat(F.when(hours < 0, "-").otherwise("+"), F.lpad(F.abs(hours).cast("string"), 2, "0"), F.lit("00")))


def join_path(path: Column, name: Column) -> Column:
    """The path of a field within a field set."""
    return F.when(path == "/", F.concat(path, name)).otherwise(F.concat(path, F.lit("/"), name))


def mac_address(data: Column) -> Column:
    """Six bytes as pairs of digits with colons."""
    return F.when(F.octet_length(data) == 6, F.lower(F.array_join(byte_pairs(data), ":")))


def ipv4_address(data: Column) -> Column:
    return F.when(F.octet_length(data) == 4, F.array_join(F.transform(byte_pairs(data), lambda x: F.conv(x, 16, 10)), "."))


def ipv6_address(data: Column) -> Column:
    """Sixteen bytes as eight groups of four digits."""
    return F.when(F.octet_length(data) == 16, F.lower(F.array_join(F.regexp_extract_all(F.hex(data), F.lit("(....)"), 1), ":")))


def lower_bound(values: Column, value: Column) -> Column:
    """How many of ascending ``values`` are below ``value``: the place where it would be put."""
    return F.size(F.filter(values, lambda x: x < value))


def binary_search(values: Column, value: Column) -> Column:
    """The place of ``value`` in ascending ``values``, from 0; null if it isn't there."""
    return F.nullif(F.array_position(values, value), F.lit(0)).cast("int") - 1


def create_dict(entries: Column, key: Column, part: str) -> Column:
    """The member ``part`` of the map ``entries``' structs at ``key``; null for unknown keys."""
    return F.try_element_at(entries, key)[part]


def displayed(value: Column, most: int = 40) -> Column:
    """A text field as it is shown: quoted, cut at ``most`` characters, with escapes."""
    text = printable(value, "ISO-8859-1")
    text = F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("(...)"))).otherwise(text)
    return F.when(text == "", F.lit("")).otherwise(F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('\\"')), F.lit('"')))
