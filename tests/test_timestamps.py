import datetime as dt
import re
import zoneinfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bitloom.operators import timestamps as T

COMPILED, ZONES = [re.compile(p) for p in T.PATTERNS], {x.lower(): x for x in zoneinfo.available_timezones() if "/" in x}


def utc(*a):
    return int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp())


LOCAL = utc(2014, 3, 23, 2, 19, 26)


@pytest.mark.parametrize(
    ("value", "month_first", "expected"),
    [
        ("2014-03-23 02:19:26", False, (LOCAL, None, None, None)),
        (" 2014:03:23 02:19:26 ", False, (LOCAL, None, None, None)),
        ("2014-03-23T02:19:26.123456Z", False, (LOCAL, 0, None, None)),
        ("20140323T021926Z", False, (LOCAL, 0, None, None)),
        ("2014-03-23 02:19:26+0545", False, (LOCAL, 20700, None, None)),
        ("2014-03-23 02:19:26-03:30", False, (LOCAL, -12600, None, None)),
        ("2014-03-23 02:19:26 CEST", False, (LOCAL, 7200, None, None)),
        ("2014-03-23 02:19:26 Europe/Paris", False, (LOCAL, None, "Europe/Paris", None)),
        ("23 mars 2014 à 02:19:26", False, (LOCAL, None, None, None)),
        ("23. März 2014, 02:19:26 Uhr", False, (LOCAL, None, None, None)),
        ("March 23, 2014 02:19:26", False, (LOCAL, None, None, None)),
        ("Sun, 23 Mar 2014 02:19:26 +0100", False, (LOCAL, 3600, None, None)),
        ("Sun Mar 23 02:19:26 2014", False, (LOCAL, None, None, None)),
        ("03/23/2014 2:19:26 AM", True, (LOCAL, None, None, None)),
        ("23/03/2014 2:19:26 PM", False, (LOCAL + 43200, None, None, None)),
        ("23/03/2014 12:19:26 AM", False, (LOCAL - 7200, None, None, None)),
        ("1395541166", False, (None, None, None, 1395541166)),
        ("3478386000", False, (None, None, None, 3478386000 - T.MAC_EPOCH)),
        ("1395541166999", False, (None, None, None, 1395541166)),
        ("130400147661234567", False, (None, None, None, 13040014766 - T.WIN_EPOCH)),
        *[(x, False, (None,) * 4) for x in (None, "", " ", "2014", "2014-03-23", "March 2014", "0000:00:00 00:00:00", "2014-13-23 02:19:26", "2014-03-23 25:61:00", "31/02/2014 01:00:00", "unknown", "2014-03-23 02:19:26 XYZ", "13/03/2014 13:00:00 PM", "9" * 500, "x" * 100_000)],
        ("03/23/2014 02:19:26", False, (None,) * 4),
    ],
)
def test_parse_one(value, month_first, expected):
    assert T.parse_one(value, month_first, COMPILED, ZONES) == expected


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_parse_never_fails(value):
    assert len(T.parse_one(value, True, COMPILED, ZONES)) == 4


def rows(spark, values, zone="Europe/Paris", order="DMY"):
    return spark.createDataFrame([(i, 1, 1, v, zone, order) for i, v in enumerate(values)], "row_id long, source_id long, volume_id int, value string, tz_name string, date_order string")


def test_clock_changes(spark):
    got = {r["value"]: r["utc_s"] for r in T.normalise_timestamps(rows(spark, ["2014-03-30 02:30:00", "2014-10-26 02:30:00", "2014-10-26 02:30:00 CET", "2014-03-30 03:00:00", "2014-10-26 03:00:00"])).collect()}
    assert got["2014-03-30 02:30:00"] is None and got["2014-10-26 02:30:00"] is None
    assert got["2014-10-26 02:30:00 CET"] == utc(2014, 10, 26, 1, 30)
    assert got["2014-03-30 03:00:00"] == utc(2014, 3, 30, 1) and got["2014-10-26 03:00:00"] == utc(2014, 10, 26, 2)


@pytest.mark.parametrize("zone", ["Australia/Lord_Howe", "America/New_York", "Asia/Kathmandu", "Pacific/Auckland", "Europe/London"])
def test_local_times_against_zoneinfo(spark, zone):
    z, start = zoneinfo.ZoneInfo(zone), dt.datetime(2015, 3, 1)
    local = [start + dt.timedelta(minutes=37 * i) for i in range(0, 15000, 7)]
    got = {r["value"]: r["utc_s"] for r in T.normalise_timestamps(rows(spark, [str(x) for x in local], zone)).collect()}
    for x in local:
        both = {x.replace(tzinfo=z, fold=f).timestamp() for f in (0, 1)}
        real = {t for t in both if dt.datetime.fromtimestamp(t, z).replace(tzinfo=None) == x}
        assert got[str(x)] == (next(iter(real)) if len(real) == 1 else None), x


def test_nulls_empty_and_clashing_columns(spark):
    df = rows(spark, [None, "", "2014-03-23 02:19:26Z"]).withColumn("utc_s", F.lit("mine")).withColumn("other", F.lit(1))
    got = T.normalise_timestamps(df).orderBy("row_id").collect()
    assert [r["utc_s"] for r in got] == [None, None, LOCAL] and got[0]["other"] == 1
    assert T.normalise_timestamps(rows(spark, ["2014-03-23 02:19:26"], None)).first()["utc_s"] is None
    assert T.normalise_timestamps(rows(spark, ["2014-03-23 02:19:26"], "No/Where")).first()["utc_s"] is None
    assert T.normalise_timestamps(df.limit(0)).count() == 0


def test_pairs_against_brute_force(spark):
    data = [(i, i % 3, None if i % 5 == 0 else i % 4) for i in range(40)]
    df = spark.createDataFrame(data, "row_id long, source_id long, utc_s long")
    expected = {(a, b) for a, s, u in data for b, t, v in data if a < b and s == t and u is not None and u == v}
    assert {tuple(r) for r in T.same_second_pairs(df).collect()} == expected


def test_msdos(spark):
    names = ["day", "month", "year", "second", "minute", "hour"]
    sets = {1: ([23, 3, 34, 13, 19, 2], "2014-03-23 02:19:26"), 2: ([0] * 6, "1980-00-00 00:00:00"), 3: ([1, 1, None, 0, 0, 0], None)}
    data = []
    for k, (values, _) in sets.items():
        data += [(k * 10, 1, f"/file[{k}]/timestamp", f"/file[{k}]", "DateTimeMSDOS32", None)]
        data += [(k * 10 + i + 1, 1, f"/file[{k}]/timestamp/{n}", f"/file[{k}]/timestamp", "Bits", None if v is None else str(v)) for i, (n, v) in enumerate(zip(names, values))]
    df = spark.createDataFrame(data * 2, "field_id long, source_id long, path string, parent_path string, field_type string, value string")
    assert {r["row_id"]: r["value"] for r in T.msdos_values(df).collect()} == {k * 10: v for k, (_, v) in sets.items()}


def test_estimated_zone(spark):
    z, data = zoneinfo.ZoneInfo("America/New_York"), []
    for i in range(40):
        t = utc(2015, 1, 5) + i * 9 * 86400
        local = t + int(dt.datetime.fromtimestamp(t, z).utcoffset().total_seconds())
        data += [(1, i, local, None, False, t + 10**8), (1, i, None, t, True, t + 10**8)]
    df = spark.createDataFrame(data, "volume_id int, source_id long, local_s long, utc_s long, has_zone boolean, ingest_s long")
    got = T.estimate_zones(df, ["Europe/Paris", "America/New_York", "America/Phoenix", "UTC"]).collect()
    assert [(r["volume_id"], r["zone"], r["violations"]) for r in got] == [(1, "America/New_York", 0)]
    assert T.estimate_zones(df.limit(0), ["UTC"]).count() == 0


def test_rows_by_estimated_zone(spark):
    """A zone that nobody wrote down is found among the IANA histories, and every dated row gets its second by it."""
    histories = T.iana_histories()
    assert len(histories) > 200 and sum("America/New_York" in x for x in histories.values()) == 1
    z, data = zoneinfo.ZoneInfo("Asia/Kathmandu"), []
    for i in range(40):
        t = utc(2015, 1, 5) + i * 9 * 86400
        local = t + int(dt.datetime.fromtimestamp(t, z).utcoffset().total_seconds())
        data += [(2 * i, 1, i, local, None, False, t + 10**8), (2 * i + 1, 1, i, None, t, True, t + 10**8)]
    data += [(99, 2, 99, utc(2015, 1, 5), None, False, utc(2016, 1, 5)), (100, 2, 100, None, 5, True, 10**9)]
    df = spark.createDataFrame(data, "row_id long, volume_id int, source_id long, local_s long, utc_s long, has_zone boolean, ingest_s long")
    got = {r["row_id"]: r for r in T.by_estimated_zone(df, sorted(histories)).collect()}
    assert len(got) == len(data) and all(got[2 * i]["utc_s"] == got[2 * i + 1]["utc_s"] for i in range(40))
    assert "Asia/Kathmandu" in histories[got[0]["estimated_zone"]]
    assert got[99]["utc_s"] is None and got[99]["estimated_zone"] is None and got[100]["utc_s"] == 5
