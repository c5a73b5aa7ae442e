import math

from pyspark.sql import functions as F

from bitloom.functions import values as V
from bitloom.operators import selection as S
from bitloom.operators import validate
from bitloom.sources.sinks import write_files
from tests.test_formats import CASES


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_floats():
    assert V.float_of(bytes.fromhex("3fff8000000000000000"), 80, "big") == 1.0 and V.float_of(bytes.fromhex("c000c90fdaa22168c235"), 80, "big") == -math.pi
    assert V.float_of(b"\0" * 10, 80, "little") == 0.0 and V.float_of(bytes.fromhex("7fff8000000000000000"), 80, "big") == math.inf and math.isnan(V.float_of(bytes.fromhex("7fffc000000000000000"), 80, "big"))
    assert V.float_of(b"\0\0\x80?", 32, "little") == 1.0 and V.float_of(None, 64, "big") is None and V.float_of(b"123", 32, "big") is None


def test_shown(spark):
    assert one(spark, V.displayed(F.lit('say "hi"\n'))) == '"say \\"hi\\"\\n"' and one(spark, V.displayed(F.lit("x" * 50))) == '"' + "x" * 40 + '(...)"' and one(spark, V.displayed(F.lit(""))) == ""
    assert one(spark, V.human_datetime(F.expr("timestamp_ntz'2004-01-02 18:10:45.5'"))) == "2004-01-02 18:10:45" and one(spark, V.human_datetime(F.expr("timestamp_ntz'2004-01-02 18:10:45.5'"), False)) == "2004-01-02 18:10:45.500000"
    assert one(spark, V.ipv4_address(F.lit(b"\x7f\0\0\1"))) == "127.0.0.1" and one(spark, V.mac_address(F.lit(b"abc"))) is None and one(spark, V.binary_search(F.array(F.lit(0), F.lit(4), F.lit(5)), F.lit(5))) == 2


def test_reads_over_extents(spark):
    extents = spark.createDataFrame([("s", 0, 10, 100), ("s", 10, 0, 5), ("s", 10, 90, 500), ("t", 0, 5, 0)], "k string, logical long, size long, source long")
    reads = spark.createDataFrame([("s", 5, 20), ("s", 95, 50), ("s", 0, 0), ("u", 0, 5)], "k string, at long, n long")
    got = {tuple(r) for r in S.read_extents(reads, extents, "k", 8).collect()}
    assert got == {("s", 5, 20, 5, 105, 5), ("s", 5, 20, 10, 500, 15), ("s", 95, 50, 95, 585, 5)}


def test_files_are_written_whole(spark, tmp_path):
    rows = [("a.bin", bytearray(b"one")), ("sub/../../b.bin", bytearray(b"")), (None, bytearray(b"x")), ("c", None)]
    write_files(spark.createDataFrame(rows, "name string, content binary"), str(tmp_path))
    assert {str(p.relative_to(tmp_path)): p.read_bytes() for p in tmp_path.rglob("*") if p.is_file()} == {"a.bin": b"one", "sub/b.bin": b""}


def test_valid_headers():
    for name, (content, *_) in CASES.items():
        if name in validate.VALID:
            assert validate.valid(b"??" + content, name, 2), name
            assert not validate.valid(content[:6], name) and not validate.valid(b"", name), name
    assert not validate.valid(b"anything", "unknown format")
