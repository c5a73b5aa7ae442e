import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bitloom.functions import bits, epochs, human, text
from bitloom.operators import detect, metadata


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column).first()[0]


def test_bytes_and_bits(spark):
    data = bytes([0x80, 0xFF, 0xC3, 0xA9])
    df = spark.createDataFrame([(data,)], "b binary")
    b = F.col("b")
    r = df.select(bits.bytes_to_int(b).alias("big"), bits.bytes_to_int(b, bits.LITTLE).alias("little"), bits.bytes_to_int(b, bits.MIDDLE).alias("middle"), bits.read_bits(b, 5, 6).alias("six"), bits.read_bits(b, 30, 6).alias("beyond"), bits.hex_bytes(b).alias("h")).first()
    assert (int(r["big"]), int(r["little"])) == (int.from_bytes(data, "big"), int.from_bytes(data, "little"))
    assert int(r["middle"]) == 0xFF80A9C3 and r["six"] == (int.from_bytes(data, "big") >> (32 - 11)) & 63 and r["beyond"] is None and r["h"] == "80 ff c3 a9"
    big = spark.createDataFrame([(b"\xff" * 8,), (b"",), (None,)], "b binary").select(bits.bytes_to_int(b).alias("v")).collect()
    assert [None if x["v"] is None else int(x["v"]) for x in big] == [2**64 - 1, None, None]
    assert one(spark, bits.swap16(F.lit(0x1234))) == 0x3412 and one(spark, bits.swap32(F.lit(0x12345678).cast("bigint"))) == 0x78563412
    assert one(spark, bits.needed_bits(F.lit(0))) == 1 and one(spark, bits.text_to_int(F.lit("110"))) == 6


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 10**13) | st.integers(2**50, 2**53), min_size=5, max_size=40))
def test_human_forms_against_python(spark, values):
    def size(v):
        if v < 10000:
            return f"{v} bytes"
        for k, u in enumerate(("KB", "MB", "GB", "TB"), 1):
            if v < 1024 ** (k + 1):
                return f"{v / 1024**k:.1f} {u}"
        return f"{v // 1024**4} TB"

    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    for r in df.select("v", human.file_size(F.col("v")).alias("s")).collect():
        assert r["s"] == size(r["v"])


def test_durations_and_modes(spark):
    assert one(spark, human.duration_ms(F.lit(0).cast("bigint"))) == "0 ms"
    assert one(spark, human.duration_ms(F.lit(90061001).cast("bigint"))) == "1 days 1 hours 1 min"
    assert one(spark, human.unix_attributes(F.lit(0o644))) == "-rw-r--r-- (644)"
    assert one(spark, human.unix_attributes(F.lit(0o40755))) == "drwxr-xr-x (40755)"


def test_epochs(spark):
    assert one(spark, epochs.unix(F.lit(0).cast("bigint"))) == dt.datetime(1970, 1, 1)
    assert one(spark, epochs.unix(F.lit(2**31).cast("bigint"))) is None
    assert one(spark, epochs.mac32(F.lit(0).cast("bigint"))) == dt.datetime(1904, 1, 1)
    assert one(spark, epochs.parse_datetime(F.lit("Thu, 19-07-2007"))) is None
    assert one(spark, epochs.parse_datetime(F.lit("2007/07/19 10:11:12"))) == dt.datetime(2007, 7, 19, 10, 11, 12)


def test_text(spark):
    assert one(spark, text.printable(F.lit("a\nb\x01\x07"))) == "a\\nb\\1\\a"
    assert one(spark, text.normalize_newline(F.lit("a\r\n\r\nb"))) == "a\nb"
    for raw, name in ((b"abc", "ASCII"), (b"\xef\xbb\xbfa", "UTF-8"), ("é".encode(), "UTF-8"), (b"\xff\xfea\0", "UTF-16-LE"), (b"\xe9a", "ISO-8859-1")):
        assert one(spark, text.charset(F.col("b")), b=bytearray(raw)) == name


def test_fold(spark):
    got = lambda *v: one(spark, metadata.fold(F.col("v")), v=list(v))
    assert got("abc", "abcd", "x", "abc", "x") == ["abcd", "x"]
    assert got("b", "a", None) == ["b", "a"]
    assert metadata.quality_limit(0) == 0 and metadata.quality_limit(0.5) == 6 and metadata.quality_limit(1) is None


def test_detect(spark):
    df = spark.createDataFrame([("a.MP3",), ("b",), (None,), ("x.tar.gz",)], "filename string")
    assert [r["guess"] for r in detect.by_extension(df).collect()] == ["mpeg_audio", None, None, "gzip"]


def test_published_examples(spark):
    """Values that the forms are known by."""
    ms = lambda v: one(spark, human.duration_ms(F.lit(v).cast("bigint")))
    assert [ms(v) for v in (213, 4213, 6402309)] == ["213 ms", "4 sec 213 ms", "1 hours 46 min 42 sec"] and one(spark, human.duration_ns(F.lit(60417893))) == "60.42 ms"
    assert one(spark, human.unix_attributes(F.lit(0o2755))) == "-rwxr-sr-x (2755)" and one(spark, human.unix_attributes(F.lit(0o44))).endswith("(44)")
    assert one(spark, human.file_size(F.lit(256960).cast("bigint"))) == "250.9 KB" and one(spark, human.file_size(F.lit(2**51))) == "2048 TB" and one(spark, human.bit_size(F.lit(3 * 10**15))) == "3000 Tbit"
    guess = lambda h: one(spark, text.charset(F.unhex(F.lit(h))))
    assert [guess(h) for h in ("616263", "efbbbf61", "616263c3a9", "a820342e30", "e96ce9", "31303020a4", "b8eae4eff3e7", "ff")] == ["ASCII", "UTF-8", "UTF-8", "MacRoman", "ISO-8859-1", "ISO-8859-15", "ISO-8859-7", None]
    show = lambda v, *a: one(spark, text.printable(F.lit(v), *a))
    assert show("\0\x03\x0a\x10 \x7f") == "\\0\\3\\n\\x10 \\x7f" and show("âgé", "ASCII") == "\\xe2g\\xe9" and show("€", "ISO-8859-1") == "\\u20ac" and show("âgé", "ISO-8859-1", '"') == '"âgé"'
    assert show("", "UTF-8", '"') == "(empty)" and show("a'b", "UTF-8", "'") == "'a\\'b'" and show('a"b', "UTF-8", "'") == "'a\"b'" and show("a\x011") == "a\\x011"
    when = lambda v: one(spark, epochs.parse_datetime(F.lit(v)))
    assert when("2000") == dt.datetime(2000, 1, 1) and when("2004-01-02 18:10:45") == dt.datetime(2004, 1, 2, 18, 10, 45) and when("February 2007") == dt.datetime(2007, 2, 1)
    assert when("Thu, 19 Jul 2007 09:03:57 +0200") == dt.datetime(2007, 7, 19, 9, 3, 57) and when("Sun Feb 24 15:51:09 2002") == dt.datetime(2002, 2, 24, 15, 51, 9) and when("2007-02-30") is None
    assert one(spark, epochs.utc_offset(F.lit("Thu, 19 Jul 2007 09:03:57 -0300"))) == -3 and one(spark, epochs.utc_offset(F.lit("2004-01-02"))) is None
    odd = (11_644_473_600 * 10**7) + 6_710_013
    assert one(spark, epochs.win64(F.lit(odd))) == dt.datetime(1970, 1, 1, 0, 0, 0, 671001)
    assert one(spark, bits.find_bytes(F.lit(b"\xff\x00ab\xffab"), b"ab", 3)) == 5 and one(spark, bits.find_bytes(F.lit(b"xyz"), b"ab")) is None
