import io
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from bitloom.operators import carving, editing, extract
from bitloom.sources import formats as S
from tests.test_formats import CASES


def image():
    rng, parts, where = random.Random(7), [], []
    for name in ("png", "zip", "wav", "bmp", "png", "au"):
        filler = bytes(rng.randrange(1, 250) for _ in range(65_536 - 20 if name == "wav" else 700)).replace(b"PK", b"pk").replace(b"BM", b"bm").replace(b"MZ", b"mz")
        parts.append(filler)
        where.append((sum(map(len, parts)), len(CASES[name][0]), name))
        parts.append(CASES[name][0])
    return b"".join(parts), where


def test_carves_planted_files_also_across_slices(spark):
    data, where = image()
    names = ("png", "zip", "wav", "bmp", "au")
    assert carving.carve_one(data, names) == where
    df = spark.createDataFrame([(1, bytearray(data)), (2, None), (3, bytearray(b""))], "id long, content binary")
    got = carving.carve_files(df, names).orderBy("offset").collect()
    assert [(r["offset"], r["size"], r["format"]) for r in got] == where and got[0]["name"] == "file-0001.png"
    assert {r["format"]: r["hits"] for r in carving.statistics(carving.carve_files(df, names)).collect()} == {"png": 2, "zip": 1, "wav": 1, "bmp": 1, "au": 1}
    assert carving.carve_one(data[: where[0][0] + 60], ("png",)) == [(700, None, "png")]  # cut off: its end isn't told
    assert carving.carve_one(data[: where[0][0] + 8], ("png",)) == []


def test_png_without_text():
    data = CASES["png"][0]
    out, removed = editing.strip_one(data, "png")
    paths = [p for p, *_ in S.parse_one(out, "png")]
    assert removed == (len(data) - len(out)) * 8 > 0 and not any("text" in p for p in paths) and "/header/width" in paths and "/end/crc32" in paths
    assert editing.strip_one(out, "png") == (out, 0)
    assert editing.strip_one(data[:40], "png") == (data[:40], 0)


def test_tar_without_owners():
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w", format=tarfile.USTAR_FORMAT) as f:
        info = tarfile.TarInfo("a.txt")
        info.size, info.uid, info.uname, info.mtime = 3, 500, "someone", 10**9
        f.addfile(info, io.BytesIO(b"abc"))
    out, removed = editing.strip_one(buffer.getvalue(), "tar")
    member = tarfile.open(fileobj=io.BytesIO(out)).getmembers()[0]  # reading checks the sum
    assert (member.name, member.uid, member.uname, member.mtime, member.size) == ("a.txt", 0, "", 0, 3) and removed > 0


def test_au_keeps_its_sound():
    out, removed = editing.strip_one(CASES["au"][0], "au")
    assert removed == 32 and out.endswith(b"abcd") and {p: v for p, _, _, v in S.parse_one(out, "au")}["/data_ofs"] == "24"


def test_bits():
    assert editing.write_bits(b"\xff\xff\xff\xfe", 21, 3, 6) == b"\xff\xff\xfe\xfe"
    for bad in ((0, 3, 8), (30, 3, 1), (0, 1, -1)):
        with pytest.raises(ValueError):
            editing.write_bits(b"\xff\xff\xff\xfe", *bad)


def test_metadata_of_contents(spark):
    names = ("png", "wav", "tar", "zip")
    df = spark.createDataFrame([(i, bytearray(CASES[n][0])) for i, n in enumerate(names)], "id long, content binary")
    rows = extract.metadata_rows(S.parse(df))
    got = {(r["format"], r["group_name"], r["meta_key"]): r["value"] for r in rows.collect()}
    assert got["png", "Common", "width"] == "331" and got["png", "Common", "comment"] == "a dog" and got["wav", "Common", "sample_rate"] == "22050"
    assert got["tar", "file[1]", "filename"] == "b.txt" and got["zip", "file[0]", "file_size"] == "250"
    more = {r["id"]: r for r in extract.derived(rows, df.selectExpr("id", "length(content) as size")).collect()}
    assert more[1]["bit_rate"] == 2 * 22050 * 16 and abs(more[1]["duration_s"] - 400 / 88200) < 1e-9 and more[2]["compression_rate"] == 1005 / len(CASES["tar"][0])
    out = df.select(editing.stripped(F.col("content"), F.lit("png")).alias("s"))
    assert out.where("s.removed_bits > 0").count() == 1


def test_random_bytes_hold_no_files():
    noise = random.Random(3).randbytes(8 << 20)
    assert carving.carve_one(noise) == []
    false = b"MZ" + bytes(80) + b"BM\x05\0\0\0" + b"PK\x03\x04" + b"\xff" * 30 + b"\xff\xd8\xff" + b"ID3\xff\xff"
    for name, (content, *_) in CASES.items():
        if name != "zlib":
            got = carving.carve_one(false + content + false + noise[:1000])
            assert (len(false), len(content), name) in got, (name, got)
