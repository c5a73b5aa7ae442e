"""Timestamps in many notations, precisions and zones as one UTC second.

A value is parsed once, in Arrow batches, into a wall-clock time and a zone; conversion by the offset history of the zone,
estimation and pairing are built-in expressions. A zone that nobody wrote down is estimated (:func:`estimate_zones`): local times are aligned with
instants of the same source and with ingestion times, and the offset history with the fewest violations is chosen.
"""

from __future__ import annotations

import calendar
import datetime
import re
import zoneinfo
from functools import reduce
from importlib import resources
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names (English, German, French; the first three letters suffice where they are unique).
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9,
    "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
    "januar": 1, "jänner": 1, "februar": 2, "märz": 3, "mai": 5, "juni": 6, "juli": 7, "oktober": 10, "dezember": 12,
    "mär": 3, "okt": 10, "dez": 12,
    "janvier": 1, "février": 2, "mars": 3, "avril": 4, "juin": 6, "juillet": 7, "août": 8, "septembre": 9, "octobre": 10,
    "novembre": 11, "décembre": 12, "janv": 1, "févr": 2, "avr": 4, "juil": 7, "déc": 12,
}

# Zone abbreviations and their offsets from UTC in minutes.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "met": 60, "mest": 120,
    "eet": 120, "eest": 180, "msk": 180, "ist": 330, "npt": 345, "jst": 540, "kst": 540, "awst": 480, "acst": 570,
    "acdt": 630, "aest": 600, "aedt": 660, "lhst": 630, "lhdt": 660, "nzst": 720, "nzdt": 780, "nst": -210, "ndt": -150,
    "ast": -240, "adt": -180, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480,
    "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
}

#: Seconds from 1970 back to the epochs 1904 and 1601.
MAC_EPOCH, WIN_EPOCH = 2_082_844_800, 11_644_473_600
#: Local and UTC clocks differ by less than this, in seconds.
WIDEST = 15 * 3600
QUARTER = 900

_CLOCK = r"(?P<h>\d{1,2}):(?P<i>\d\d):(?P<s>\d\d)(?:[.,]\d+)?"
_ZONE = r"\s*(?P<z>z|[+-]\d\d:?\d\d|[a-z]{2,5}|[a-z]+(?:/[a-z0-9_+-]+)+)?"
_HALF = r"(?:\s*(?P<p>[ap])\.?m\.?)?"
_WEEKDAY = r"(?:[a-z]{3,9}\.?,?\s+)"
#: Notations, matched against trimmed lower case. Groups a and b: day and month in the order the volume names.
PATTERNS = (
    rf"(?P<y>\d{{4}})[-:/.](?P<m>\d{{1,2}})[-:/.](?P<d>\d{{1,2}})(?:t|\s+){_CLOCK}{_ZONE}",
    rf"(?P<y>\d{{4}})(?P<m>\d\d)(?P<d>\d\d)t?(?P<h>\d\d)(?P<i>\d\d)(?P<s>\d\d)(?:[.,]\d+)?{_ZONE}",
    rf"(?P<a>\d{{1,2}})[-/.](?P<b>\d{{1,2}})[-/.](?P<y>\d{{4}})[,t]?\s*{_CLOCK}{_HALF}{_ZONE}",
    rf"{_WEEKDAY}?(?P<d>\d{{1,2}})\.?\s+(?P<n>[^\W\d_]{{3,9}})\.?,?\s+(?P<y>\d{{4}}),?\s+(?:à\s+|um\s+|at\s+)?{_CLOCK}(?:\s+uhr)?{_ZONE}",
    rf"{_WEEKDAY}?(?P<n>[^\W\d_]{{3,9}})\.?\s+(?P<d>\d{{1,2}}),?\s+(?P<y>\d{{4}}),?\s+(?:at\s+)?{_CLOCK}{_HALF}{_ZONE}",
    rf"{_WEEKDAY}(?P<n>[^\W\d_]{{3,9}})\s+(?P<d>\d{{1,2}})\s+{_CLOCK}{_ZONE}\s+(?P<y>\d{{4}})",
)
#: Longer values are no dates.
LONGEST = 200


def known_zone(name: Column) -> Column:
    """``name`` where it is a zone of the IANA database, else null."""
    return F.when(name.isin(*sorted(zoneinfo.available_timezones())), name)


def iana_histories() -> dict[str, list[str]]:
    """One zone per history of the IANA database -> all names of that history (the same transitions and rules).

    The first name in order stands for a history. Names without a region other than UTC are old aliases, left out.
    """
    groups: dict[bytes, list[str]] = {}
    for name in sorted(x for x in zoneinfo.available_timezones() if x == "UTC" or "/" in x and not x.startswith("SystemV/")):
        file = next((f for root in zoneinfo.TZPATH if (f := Path(root, name)).is_file()), None)
        data = file.read_bytes() if file else (resources.files("tzdata") / "zoneinfo" / name).read_bytes()
        groups.setdefault(data, []).append(name)
    return {names[0]: names for names in groups.values()}


def parse_one(value: str | None, month_first: bool, compiled: list[re.Pattern], zones: dict[str, str]) -> tuple[int | None, int | None, str | None, int | None]:
    """(local, offset, zone, utc) of a written date and time in seconds; all None for what denotes no second.

    ``utc`` is set for bare numbers, offset or zone where the value names one, ``local`` are the seconds of the wall
    clock since 1970-01-01. Null, empty, partial, impossible and over-long values denote nothing.
    """
    nothing = (None, None, None, None)
    text = (value or "").strip(" \t\r\n\v\f\0").lower()
    if not text or len(text) > LONGEST:
        return nothing
    match = next((m for p in compiled if (m := p.fullmatch(text))), None)
    if match is None:
        if not (text.isascii() and text.isdigit()):
            return nothing
        n = int(text)
        if 9 <= len(text) <= 10:
            return (None, None, None, n if n < 2**31 else n - MAC_EPOCH) if n < 2**32 else nothing
        return (None, None, None, n // 1000 if len(text) <= 14 else n // 10_000_000 - WIN_EPOCH) if len(text) in (12, 13, 17, 18) else nothing
    g = match.groupdict()
    if "a" in g:
        month, day = (g["a"], g["b"]) if month_first else (g["b"], g["a"])
    else:
        month, day = g.get("m") or MONTHS.get(g["n"]), g["d"]
    hour = int(g["h"])
    if g.get("p"):
        if not 1 <= hour <= 12:
            return nothing
        hour = hour % 12 + 12 * (g["p"] == "p")
    try:
        local = calendar.timegm(datetime.datetime(int(g["y"]), int(month or 0), int(day), hour, int(g["i"]), int(g["s"])).timetuple())
    except ValueError:
        return nothing
    z = g.get("z")
    if not z:
        return local, None, None, None
    if z[0] in "+-":
        hours, minutes = int(z[1:3]), int(z[-2:])
        return (local, (-1 if z[0] == "-" else 1) * (hours * 3600 + minutes * 60), None, None) if hours <= 14 and minutes <= 59 else nothing
    if z in ABBREVIATIONS:
        return local, ABBREVIATIONS[z] * 60, None, None
    return (local, None, zones[z], None) if z in zones else nothing


def _parsed(value: pd.Series, date_order: pd.Series) -> pd.DataFrame:
    """:func:`parse_one` over Arrow batches: a dozen alternative notations in one built-in expression outgrow generated code."""
    compiled = [re.compile(p) for p in PATTERNS]
    zones = {x.lower(): x for x in zoneinfo.available_timezones() if "/" in x}
    rows = [parse_one(v, isinstance(o, str) and o.upper() == "MDY", compiled, zones) for v, o in zip(value, date_order)]
    out = pd.DataFrame(rows, columns=["_local", "_offset", "_named", "_utc"], dtype=object)
    return out.astype({"_local": "Int64", "_offset": "Int64", "_utc": "Int64"})


def offset_at(utc_s: Column, zone: Column) -> Column:
    """Seconds that ``zone``'s clocks are ahead of UTC at ``utc_s``."""
    return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(utc_s), zone)) - utc_s


def with_utc(df: DataFrame, local: str, zone: str, out: str) -> DataFrame:
    """``df`` with ``out``: the one UTC second at which the zone's clocks showed ``local``; null where they skipped it or
    showed it twice.

    The offsets a day before and a day after are the only ones in question; each is kept if it leads back to the local time.
    """
    c, z = F.col(local), F.col(zone)
    df = df.withColumns({"_one": c - offset_at(c - 86400, z), "_two": c - offset_at(c + 86400, z)})
    df = df.withColumns({x: F.when(F.col(x) + offset_at(F.col(x), z) == c, F.col(x)) for x in ("_one", "_two")})
    return df.withColumn(out, F.when(F.col("_one") != F.col("_two"), None).otherwise(F.coalesce("_one", "_two"))).drop("_one", "_two")


def normalise_timestamps(df: DataFrame, value: str = "value", zone: str = "tz_name", date_order: str = "date_order") -> DataFrame:
    """``df`` with ``utc_s`` (long, UTC seconds; null: denotes nothing), ``local_s`` and ``has_zone``.

    Nulls, empty and very long texts give null; rows are kept as they are, repeated ones too. The zone column applies
    only to values that name none; a null or unknown zone leaves such a value undetermined.
    """
    df = df.withColumn("_at", F.pandas_udf(_parsed, "_local long, _offset long, _named string, _utc long").asNondeterministic()(F.col(value), F.col(date_order)))
    df = df.withColumns({x: F.col(f"_at.{x}") for x in ("_local", "_offset", "_named", "_utc")}).drop("_at")
    df = with_utc(df.withColumn("_zone", F.coalesce(F.col("_named"), known_zone(F.col(zone)))), "_local", "_zone", "_by_zone")
    has_zone = F.col("_utc").isNotNull() | F.col("_offset").isNotNull() | F.col("_named").isNotNull()
    df = df.withColumns({"utc_s": F.coalesce(F.col("_utc"), F.col("_local") - F.col("_offset"), F.col("_by_zone")), "local_s": F.col("_local"), "has_zone": has_zone})
    return df.drop("_local", "_offset", "_named", "_utc", "_zone", "_by_zone")


def msdos_values(fields: DataFrame) -> DataFrame:
    """One row (row_id, source_id, value) per DateTimeMSDOS32 field set, its bit fields put together as a written date.

    The sets and their children meet in one aggregation by (source_id, path of the set); repeated rows fold away in it.
    All bits zero (not set), a missing or unreadable child, and month or day 0 give a null value.
    """
    own = F.col("field_type") == "DateTimeMSDOS32"
    name = F.element_at(F.split("path", "/"), -1)
    rows = fields.where(own | F.col("path").rlike("/(day|month|year|hour|minute|second)$")).select(
        "source_id",
        F.when(own, F.col("path")).otherwise(F.col("parent_path")).alias("set_path"),
        F.when(own, F.col("field_id")).alias("row_id"),
        *[F.when(~own & (name == x), F.trim(F.col("value")).try_cast("int")).alias(x) for x in ("year", "month", "day", "hour", "minute", "second")],
    )
    one = rows.groupBy("source_id", "set_path").agg(F.collect_set("row_id").alias("ids"), *[F.max(x).alias(x) for x in ("year", "month", "day", "hour", "minute", "second")])
    text = F.format_string("%04d-%02d-%02d %02d:%02d:%02d", F.col("year") + 1980, "month", "day", "hour", "minute", F.col("second") * 2)
    known = reduce(lambda a, b: a & b, [F.col(x).isNotNull() for x in ("year", "month", "day", "hour", "minute", "second")])
    return one.select(F.explode("ids").alias("row_id"), "source_id", F.when(known, text).alias("value"))


def estimate_zones(events: DataFrame, candidates: list[str]) -> DataFrame:
    """Per volume the zone whose offset history violates the fewest alignments, as (volume_id, zone, violations, aligned).

    ``events``: volume_id, source_id, local_s (null for instants), utc_s, has_zone, ingest_s. A local time is aligned with
    every instant of its source whose distance is a possible offset (a multiple of a quarter of an hour under 15 hours):
    a history that gives another offset then is violated; so is one that puts a local time after its ingestion. Both
    are counted per volume and quarter of an hour before the candidates are applied, so the candidates multiply
    counts, not rows. Ties go to the more often aligned, then to the name. ``candidates`` are bounded by the IANA list.
    """
    day = 86400
    local = events.where(~F.col("has_zone") & F.col("local_s").isNotNull())
    ends = events.where(F.col("has_zone") & F.col("utc_s").isNotNull()).groupBy("source_id", "utc_s").agg(F.count("*").alias("n_b"))
    ends = ends.select("source_id", "utc_s", "n_b", F.pmod("utc_s", F.lit(QUARTER)).alias("phase"), F.explode(F.array(*[F.floor(F.col("utc_s") / day) + i for i in (-1, 0, 1)])).alias("day"))
    starts = local.groupBy("volume_id", "source_id", "local_s").agg(F.count("*").alias("n_a"))
    starts = starts.select("*", F.pmod("local_s", F.lit(QUARTER)).alias("phase"), F.floor(F.col("local_s") / day).alias("day"))
    pairs = starts.join(ends, ["source_id", "phase", "day"]).where(F.abs(F.col("local_s") - F.col("utc_s")) < WIDEST)
    seen = pairs.groupBy("volume_id", (F.col("utc_s") - F.col("phase")).alias("at_s"), (F.col("local_s") - F.col("utc_s")).alias("offset_s")).agg(F.sum(F.col("n_a") * F.col("n_b")).alias("n"))
    late = local.where(F.col("local_s") - F.col("ingest_s") > -WIDEST).groupBy("volume_id", (F.col("local_s") - F.pmod("local_s", F.lit(QUARTER))).alias("at_s"), (F.floor((F.col("local_s") - F.col("ingest_s")) / QUARTER) * QUARTER).cast("long").alias("offset_s")).agg(F.count("*").alias("n"))
    both = seen.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))
    tried = both.withColumn("zone", F.explode(F.array(*[F.lit(x) for x in candidates]))) if candidates else both.withColumn("zone", F.lit(None).cast("string")).limit(0)
    offset = offset_at(F.col("at_s"), F.col("zone"))
    scored = tried.groupBy("volume_id", "zone").agg(
        F.sum(F.when(F.col("late"), F.when(offset < F.col("offset_s"), F.col("n")).otherwise(0)).otherwise(F.when(offset != F.col("offset_s"), F.col("n")).otherwise(0))).alias("violations"),
        F.sum(F.when(~F.col("late") & (offset == F.col("offset_s")), F.col("n")).otherwise(0)).alias("aligned"),
    )
    best = scored.groupBy("volume_id").agg(F.min(F.struct("violations", (-F.col("aligned")).alias("less"), "zone")).alias("b"))
    return best.select("volume_id", F.col("b.zone").alias("zone"), F.col("b.violations").alias("violations"), (-F.col("b.less")).alias("aligned"))


def by_estimated_zone(events: DataFrame, candidates: list[str]) -> DataFrame:
    """``events`` with estimated_zone and with utc_s by it: values that name a zone or count from an epoch keep their second, others
    are converted by what :func:`estimate_zones` finds for their volume (null where it finds none)."""
    zones = estimate_zones(events, candidates).select("volume_id", F.col("zone").alias("estimated_zone"))
    out = with_utc(events.join(zones, "volume_id", "left"), "local_s", "estimated_zone", "_by")
    return out.withColumn("utc_s", F.when(F.col("has_zone"), F.col("utc_s")).otherwise(F.col("_by"))).drop("_by")


def same_second_pairs(events: DataFrame) -> DataFrame:
    """(row_lo, row_hi) of distinct row ids of one source and one UTC second; an equi-join, undetermined rows give none."""
    known = events.where(F.col("utc_s").isNotNull() & F.col("source_id").isNotNull()).select("source_id", "utc_s", "row_id")
    other = known.select("source_id", "utc_s", F.col("row_id").alias("row_hi"))
    return known.withColumnRenamed("row_id", "row_lo").join(other, ["source_id", "utc_s"]).where(F.col("row_lo") < F.col("row_hi")).select("row_lo", "row_hi")
