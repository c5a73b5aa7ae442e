import bz2
import gzip
import io
import struct
import tarfile
import wave
import zipfile
import zlib

import pytest

from bitloom.sources import formats as S


def png():
    chunk = lambda tag, body: struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 331, 7, 8, 2, 0, 0, 0)) + chunk(b"tEXt", b"Title\0a dog") + chunk(b"IDAT", zlib.compress(b"x" * 50)) + chunk(b"IEND", b"")


def wav():
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(22050)
        w.writeframes(b"\0" * 400)
    return out.getvalue()


def tar():
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as f:
        for name, body in (("a.txt", b"hello"), ("b.txt", b"x" * 1000)):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            f.addfile(info, io.BytesIO(body))
    return out.getvalue()


def zip_():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as f:
        f.writestr("a.txt", "hello" * 50)
        f.writestr("b/ü.txt", "x")
    return out.getvalue()


CASES = {
    "png": (png(), {"/header/width": "331", "/text[0]/text": "a dog", "/end/tag": "IEND"}),
    "wav": (wav(), {"/format/sample_per_sec": "22050", "/format/nb_channel": "2"}),
    "tar": (tar(), {"/file[0]/name": "a.txt", "/file[0]/size": "5", "/file[1]/size": "1000"}),
    "zip": (zip_(), {"/file[0]/filename": "a.txt", "/file[1]/filename": "b/ü.txt", "/file[0]/uncompressed_size": "250"}),
    "gzip": (gzip.compress(b"hello", mtime=0), {"/size": "5", "/mtime": "0"}),
    "zlib": (zlib.compress(b"hello"), {"/checksum": hex(zlib.adler32(b"hello"))}),
    "au": (struct.pack(">4sIIIII", b".snd", 28, 4, 1, 8000, 1) + b"info" + b"abcd", {"/sample_rate": "8000", "/info": "info"}),
    "bmp": (struct.pack("<2sIIIIIiHHIIIIII", b"BM", 58, 0, 54, 40, 3, 2, 1, 24, 0, 4, 0, 0, 0, 0) + b"abcd", {"/header/width": "3", "/header/bpp": "24"}),
    "gif": (b"GIF89a" + struct.pack("<HHBBB", 5, 6, 0, 0, 0) + b";", {"/screen/width": "5"}),
}


@pytest.mark.parametrize("name", CASES)
def test_fields(name):
    data, expected = CASES[name]
    got = S.parse_one(data, name)
    values = {p: v for p, _, _, v in got}
    assert {k: values.get(k) for k in expected} == expected
    at = 0
    for _, address, size, _ in got:  # fields follow each other and cover the content
        assert address == at
        at += size
    assert at == len(data) * 8


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("part", [0.1, 0.5, 0.9])
def test_truncated_contents_keep_what_was_read(name, part):
    data = CASES[name][0]
    got = S.parse_one(data[: int(len(data) * part)], name)
    assert not got or got[-1][1] + max(got[-1][2], 0) <= len(data) * 8


def test_parse_detects_by_magic(spark):
    rows = [(i, d) for i, (n, (d, _)) in enumerate(CASES.items()) if n != "zlib"] + [(99, b"nothing known"), (100, None), (101, b"")]
    got = {r["format"] for r in S.parse(spark.createDataFrame(rows, "id long, content binary")).select("format").distinct().collect()}
    assert got == set(CASES) - {"zlib"}


def test_inflate():
    for method, pack in (("gzip", gzip.compress), ("zlib", zlib.compress), ("bzip2", bz2.compress)):
        assert S.inflate(pack(b"abc"), method) == b"abc"
        assert S.inflate(b"broken", method) is None
