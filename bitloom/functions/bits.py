"""Integers, bytes and bit texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BIG, LITTLE, MIDDLE = "big", "little", "middle"


def byte_pairs(data: Column) -> Column:
    """The bytes of ``data`` as two-digit hex texts, in order."""
    return F.regexp_extract_all(F.hex(data), F.lit("(..)"), 1)


def reverse_bytes_hex(data: Column) -> Column:
    """Hex of ``data`` with its bytes in reverse order (never by reversing the binary itself, which keeps characters whole)."""
    return F.array_join(F.reverse(byte_pairs(data)), "")


def middle_bytes_hex(data: Column) -> Column:
    """Hex of ``data`` with the bytes of every 16-bit word swapped."""
    return F.regexp_replace(F.hex(data), "(..)(..)", "$2$1")


def bytes_to_int(data: Column, endian: str = BIG) -> Column:
    """Unsigned integer of up to eight bytes, as decimal(20,0); null for null and empty."""
    text = {BIG: F.hex(data), LITTLE: reverse_bytes_hex(data), MIDDLE: middle_bytes_hex(data)}[endian]
    return F.when(F.length(data) > 0, F.conv(text, 16, 10).cast("decimal(20,0)"))


def signed(value: Column, bits: int) -> Column:
    """Two's complement reading of an unsigned integer of ``bits`` bits."""
    return F.when(value >= F.lit(2 ** (bits - 1)).cast("decimal(20,0)"), value - F.lit(2**bits).cast("decimal(21,0)")).otherwise(value)


def int_to_hex(value: Column, size: int, endian: str = BIG) -> Column:
    """``size`` bytes of a non-negative integer as hex."""
    text = F.lpad(F.hex(value), 2 * size, "0")
    return text if endian == BIG else F.array_join(F.reverse(F.regexp_extract_all(text, F.lit("(..)"), 1)), "")


def read_bits(data: Column, address: int, size: int) -> Column:
    """``size`` (up to 56) bits at bit ``address``, most significant first; null beyond the end."""
    first, shift = address // 8 + 1, address % 8
    n = (shift + size + 7) // 8
    window = F.substring(data, first, n)
    value = F.conv(F.hex(window), 16, 10).cast("bigint")
    return F.when(F.length(window) == n, F.shiftright(value, n * 8 - shift - size).bitwiseAND(F.lit((1 << size) - 1)))


def read_bytes(data: Column, offset: int | Column, size: int | Column) -> Column:
    """``size`` bytes from byte ``offset``."""
    return F.substr(data, F.lit(offset) + 1 if isinstance(offset, int) else offset + 1, F.lit(size) if isinstance(size, int) else size)


def find_bytes(data: Column, needle: bytes, start: int = 0) -> Column:
    """Byte offset of the first ``needle`` in ``data`` from ``start`` on; null where there is none. An empty needle is found at once."""
    # as Latin-1, so that characters are bytes
    at = F.call_function("locate", F.lit(needle.decode("latin-1")), F.decode(data, "ISO-8859-1"), F.lit(start + 1))
    return F.when(at > 0, at - 1)


def swap16(value: Column) -> Column:
    return F.shiftleft(value.bitwiseAND(0xFF), 8).bitwiseOR(F.shiftright(value, 8).bitwiseAND(0xFF))


def swap32(value: Column) -> Column:
    part = lambda k: F.shiftright(value, 8 * k).bitwiseAND(0xFF)
    return F.shiftleft(part(0), 24).bitwiseOR(F.shiftleft(part(1), 16)).bitwiseOR(F.shiftleft(part(2), 8)).bitwiseOR(part(3))


def needed_bits(value: Column) -> Column:
    """Number of bits needed to store ``value``; 1 for 0."""
    return F.length(F.bin(value))


def bit_text(value: Column, size: int, msb_first: bool = True) -> Column:
    text = F.lpad(F.bin(value), size, "0")
    return text if msb_first else F.reverse(text)


def text_to_int(text: Column, endian: str = BIG) -> Column:
    """A text of binary digits as an integer."""
    return F.conv(text if endian == BIG else F.reverse(text), 2, 10).cast("bigint")


def octal_to_int(text: Column) -> Column:
    """Octal digits as an integer; 0 for anything else."""
    digits = F.trim(F.regexp_replace(text, "[ \\x00]", ""))
    return F.when(digits.rlike("^[0-7]+$"), F.conv(digits, 8, 10).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def hexadecimal(value: Column, bits: int) -> Column:
    """0x and as many lower-case digits as ``bits`` bits take."""
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(value)), -(-bits // 4), "0"))


def hex_bytes(data: Column, glue: str = " ") -> Column:
    return F.lower(F.array_join(byte_pairs(data), glue))


def padding_size(value: Column, align: int) -> Column:
    return F.pmod(-value, F.lit(align))


def align_value(value: Column, align: int) -> Column:
    return value + padding_size(value, align)
