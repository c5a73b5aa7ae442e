"""Numbers that count from an epoch, as timestamps without zone; null out of range."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds from each epoch to 1970-01-01.
MAC_OFFSET, WIN_OFFSET, UUID_OFFSET = 2_082_844_800, 11_644_473_600, 12_219_292_800


def _micros(value: Column) -> Column:
    # counted on the calendar without zone, whatever the session's zone is
    return F.timestamp_add("MICROSECOND", value.cast("bigint"), F.expr("timestamp_ntz'1970-01-01'"))


def unix(value: Column) -> Column:
    """Seconds since 1970; 0 to 2147483647."""
    return F.when(value.between(0, 2**31 - 1), _micros(value * 1_000_000))


def mac32(value: Column) -> Column:
    """Seconds since 1904; 0 to 2^32-1."""
    return F.when(value.between(0, 2**32 - 1), _micros((value - MAC_OFFSET) * 1_000_000))


def win64(value: Column) -> Column:
    """Tenths of a microsecond since 1601."""
    return F.when(value >= 0, _micros(F.call_function("div", value, F.lit(10)) - F.lit(WIN_OFFSET * 1_000_000)))


def uuid60(value: Column) -> Column:
    """Tenths of a microsecond since 1582-10-15."""
    return F.when(value >= 0, _micros(F.call_function("div", value, F.lit(10)) - F.lit(UUID_OFFSET * 1_000_000)))


def msdos32(date: Column, time: Column) -> Column:
    """Packed date and time words: years since 1980, two-second steps; month or day 0 reads as 1."""
    year, month, day = F.shiftright(date, 9) + 1980, F.greatest(F.shiftright(date, 5).bitwiseAND(15), F.lit(1)), F.greatest(date.bitwiseAND(31), F.lit(1))
    text = F.format_string("%04d-%02d-%02d %02d:%02d:%02d", year, month, day, F.shiftright(time, 11), F.shiftright(time, 5).bitwiseAND(63), time.bitwiseAND(31) * 2)
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")


# Names of the months, by their first three letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_DAY, _MONTH, _FULL = "(?:mon|tue|wed|thu|fri|sat|sun)", "(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)", "(january|february|march|april|may|june|july|august|september|october|november|december)"
_CLOCK = "([0-9]{1,2})~([0-9]{2})~([0-9]{1,2})"
#: Written forms after runs of - / . : and space have become ~, and which group holds year, month, day, hour, minute, second (0: none).
FORMS = (
    ("([0-9]{4})", (1, 0, 0, 0, 0, 0)),
    ("([0-9]{4})~([01][0-9])~([0-9]{2})", (1, 2, 3, 0, 0, 0)),
    (f"([0-9]{{4}})~([01][0-9])~([0-9]{{2}})~{_CLOCK}", (1, 2, 3, 4, 5, 6)),
    (f"([01]?[0-9])~([0-9]{{2}})~([0-9]{{4}})~{_CLOCK}", (3, 1, 2, 4, 5, 6)),
    (f"{_DAY},~([0-9]{{1,2}})~{_MONTH}~([0-9]{{4}})~{_CLOCK}", (3, 2, 1, 4, 5, 6)),
    (f"{_DAY}~{_MONTH}~([0-9]{{1,2}})~{_CLOCK}~([0-9]{{4}})", (6, 1, 2, 3, 4, 5)),
    (f"{_FULL}~([0-9]{{4}})", (2, 1, 0, 0, 0, 0)),
)


def _normal(value: Column) -> Column:
    # a sign before an offset of four digits at the end stays
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), r"\s+([+-][0-9]{4})$", "@$1"), r"(?<!@)[-/.: ]+", "~")


def utc_offset(value: Column) -> Column:
    """Whole hours of the offset that a written time ends with (+0200); null without one."""
    return F.regexp_extract(_normal(value), "@([+-][0-9]{2})00$", 1).try_cast("int")


def parse_datetime(value: Column) -> Column:
    """The written forms: year, Y-M-D, Y-M-D h:m:s, M-D-Y h:m:s (any of - / . : between), "Thu, 19 Jul 2007 09:03:57",
    "Sun Feb 24 15:51:09 2002", "February 2007", each also with an offset behind, which doesn't move the clock (see
    :func:`utc_offset`); null for others and for impossible dates."""
    text = F.regexp_replace(_normal(value), "@[+-][0-9]{2}00$", "")
    out = []
    for form, places in FORMS:
        part = [F.regexp_extract(text, f"^{form}$", g) if g else None for g in places]
        month = part[1] if part[1] is None else F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(part[1], 1, 3)).cast("int"), F.lit(0)), part[1].try_cast("int"))
        numbers = [part[0].try_cast("int"), F.lit(1) if month is None else month, *[F.lit(d) if x is None else x.try_cast("int") for x, d in zip(part[2:], (1, 0, 0, 0))]]
        out.append(F.when(text.rlike(f"^{form}$"), F.try_to_timestamp(F.format_string("%04d-%02d-%02d %02d:%02d:%02d", *numbers), F.lit("yyyy-MM-dd HH:mm:ss"))))
    return F.coalesce(*out).cast("timestamp_ntz")
