"""Readers of binary formats: content to field rows (path, address_bits, size_bits, value).

Each reader is a small walk over fixed headers; a content that breaks off gives the fields read so far and a last row
``raw[0]`` for what is left. Readers run over Arrow batches; unknown formats give no rows.
"""

from __future__ import annotations

import bz2
import struct
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.operators.detect import magic_format

FIELD_SCHEMA = "id long, format string, path string, address_bits long, size_bits long, value string"
Field = tuple[str, int, int, str | None]


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, path: str, size: int, form: str | None = None, show: Callable = str) -> tuple[Field, object]:
        if size < 0 or self.at + size > len(self.data):
            raise EOFError
        raw = self.data[self.at : self.at + size]
        value = struct.unpack(form, raw)[0] if form else raw
        field = (path, self.at * 8, size * 8, show(value))
        self.at += size
        return field, value

    def text_until(self, path: str, end: bytes = b"\0") -> tuple[Field, str]:
        stop = self.data.index(end, self.at) if end in self.data[self.at :] else None
        if stop is None:
            raise EOFError
        field = (path, self.at * 8, (stop + len(end) - self.at) * 8, text := self.data[self.at : stop].decode("latin-1"))
        self.at = stop + len(end)
        return field, text


def _hex(v) -> str:
    return v.hex() if isinstance(v, bytes) else hex(v)


def _latin(v: bytes) -> str:
    return v.decode("latin-1").rstrip("\0 ")


def read_gzip(r: _Reader) -> Iterator[Field]:
    yield r.take("/signature", 2, None, _hex)[0]
    f, method = r.take("/compression", 1, "B")
    yield f
    f, flags = r.take("/flags", 1, "B")
    yield f
    yield r.take("/mtime", 4, "<I")[0]
    yield r.take("/extra_flags", 1, "B")[0]
    yield r.take("/os", 1, "B")[0]
    if flags & 4:
        f, n = r.take("/extra_length", 2, "<H")
        yield f
        yield r.take("/extra", n, None, _hex)[0]
    if flags & 8:
        yield r.text_until("/filename")[0]
    if flags & 16:
        yield r.text_until("/comment")[0]
    if flags & 2:
        yield r.take("/hdr_crc16", 2, "<H", _hex)[0]
    yield ("/file", r.at * 8, (len(r.data) - 8 - r.at) * 8, None)
    r.at = max(r.at, len(r.data) - 8)
    yield r.take("/crc32", 4, "<I", _hex)[0]
    yield r.take("/size", 4, "<I")[0]


def read_zlib(r: _Reader) -> Iterator[Field]:
    f, cmf = r.take("/compression_info", 1, "B")
    yield f
    yield r.take("/flags", 1, "B")[0]
    yield ("/data", r.at * 8, (len(r.data) - 4 - r.at) * 8, None)
    r.at = len(r.data) - 4
    yield r.take("/checksum", 4, ">I", _hex)[0]


def _octal(v: bytes) -> str:
    text = v.replace(b"\0", b"").strip()
    return str(int(text, 8)) if text and not text.strip(b"01234567") else "0"


def read_tar(r: _Reader) -> Iterator[Field]:
    i = 0
    while r.at + 512 <= len(r.data) and r.data[r.at]:
        p = f"/file[{i}]"
        size = 0
        for name, n, show in (("name", 100, _latin), ("mode", 8, _octal), ("uid", 8, _octal), ("gid", 8, _octal), ("size", 12, _octal), ("mtime", 12, _octal), ("check_sum", 8, _octal), ("type", 1, _latin), ("lname", 100, _latin), ("magic", 8, _latin), ("uname", 32, _latin), ("gname", 32, _latin), ("devmajor", 8, _octal), ("devminor", 8, _octal), ("header_padding", 167, lambda v: None)):
            f, v = r.take(f"{p}/{name}", n, None, show)
            size = int(f[3]) if name == "size" else size
            yield f
        if size:
            yield r.take(f"{p}/content", size, None, lambda v: None)[0]
            if pad := -size % 512:
                yield r.take(f"{p}/padding", pad, None, lambda v: None)[0]
        i += 1
    yield ("/terminator", r.at * 8, (len(r.data) - r.at) * 8, None)
    r.at = len(r.data)


def read_zip(r: _Reader) -> Iterator[Field]:
    counts = {"file": 0, "central_directory": 0}
    while r.at + 4 <= len(r.data):
        sig = r.data[r.at : r.at + 4]
        if sig == b"PK\x03\x04":
            p = f"/file[{counts['file']}]"
            counts["file"] += 1
            got = {}
            for name, n, form in (("header", 4, None), ("version_needed", 2, "<H"), ("flags", 2, "<H"), ("compression", 2, "<H"), ("last_mod", 4, "<I"), ("crc32", 4, "<I"), ("compressed_size", 4, "<I"), ("uncompressed_size", 4, "<I"), ("filename_length", 2, "<H"), ("extra_length", 2, "<H")):
                f, got[name] = r.take(f"{p}/{name}", n, form, _hex if name in ("header", "crc32") else str)
                yield f
            charset = "utf-8" if got["flags"] & 0x800 else "iso-8859-15"
            yield r.take(f"{p}/filename", got["filename_length"], None, lambda v: v.decode(charset, "replace"))[0]
            if got["extra_length"]:
                yield r.take(f"{p}/extra", got["extra_length"], None, _hex)[0]
            if got["compressed_size"]:
                yield r.take(f"{p}/{'data' if got['compression'] == 0 else 'compressed_data'}", got["compressed_size"], None, lambda v: None)[0]
        elif sig == b"PK\x01\x02":
            p = f"/central_directory[{counts['central_directory']}]"
            counts["central_directory"] += 1
            yield r.take(f"{p}/header", 4, None, _hex)[0]
            yield r.take(f"{p}/fixed", 24, None, _hex)[0]
            f, n = r.take(f"{p}/filename_length", 2, "<H")
            yield f
            f, extra = r.take(f"{p}/extra_length", 2, "<H")
            yield f
            f, comment = r.take(f"{p}/comment_length", 2, "<H")
            yield f
            yield r.take(f"{p}/attributes", 12, None, _hex)[0]
            yield r.take(f"{p}/filename", n, None, _latin)[0]
            for name, size in (("extra", extra), ("comment", comment)):
                if size:
                    yield r.take(f"{p}/{name}", size, None, _hex)[0]
        elif sig == b"PK\x05\x06":
            yield r.take("/end_central_directory", 22, None, _hex)[0]
        else:
            raise EOFError


def read_png(r: _Reader) -> Iterator[Field]:
    yield r.take("/id", 8, None, _hex)[0]
    names = {b"IHDR": "header", b"tIME": "time", b"PLTE": "palette", b"pHYs": "physical", b"gAMA": "gamma", b"IEND": "end", b"tEXt": "text", b"IDAT": "data"}
    counts: dict[str, int] = {}
    while r.at < len(r.data):
        size, tag = struct.unpack(">I4s", r.data[r.at : r.at + 8]) if r.at + 8 <= len(r.data) else (0, b"")
        if not tag:
            raise EOFError
        name = names.get(tag, "chunk")
        if name in ("text", "data", "chunk"):
            counts[name] = counts.get(name, -1) + 1
            name = f"{name}[{counts[name]}]"
        yield r.take(f"/{name}/size", 4, ">I")[0]
        yield r.take(f"/{name}/tag", 4, None, _latin)[0]
        if tag == b"IHDR" and size == 13:
            for part, n, form in (("width", 4, ">I"), ("height", 4, ">I"), ("bits", 1, "B"), ("color_type", 1, "B"), ("compression", 1, "B"), ("filter", 1, "B"), ("interlace", 1, "B")):
                yield r.take(f"/{name}/{part}", n, form)[0]
        elif tag == b"tEXt":
            body = r.data[r.at : r.at + size]
            key = body.split(b"\0")[0]
            yield r.take(f"/{name}/keyword", len(key) + 1, None, _latin)[0]
            yield r.take(f"/{name}/text", size - len(key) - 1, None, _latin)[0]
        elif size:
            yield r.take(f"/{name}/content", size, None, lambda v: None)[0]
        yield r.take(f"/{name}/crc32", 4, ">I", _hex)[0]


def read_riff(r: _Reader) -> Iterator[Field]:
    yield r.take("/signature", 4, None, _latin)[0]
    f, size = r.take("/filesize", 4, "<I")
    yield f
    yield r.take("/type", 4, None, _latin)[0]
    i = 0
    while r.at + 8 <= min(len(r.data), size + 8):
        tag = r.data[r.at : r.at + 4]
        name = {b"fmt ": "format", b"data": "audio_data", b"fact": "nb_sample"}.get(tag, "info" if tag == b"LIST" and r.data[r.at + 8 : r.at + 12] == b"INFO" else f"chunk[{i}]")
        i += name.startswith("chunk")
        yield r.take(f"/{name}/tag", 4, None, _latin)[0]
        f, n = r.take(f"/{name}/size", 4, "<I")
        yield f
        if tag == b"fmt " and n >= 16:
            for part, w, form in (("codec", 2, "<H"), ("nb_channel", 2, "<H"), ("sample_per_sec", 4, "<I"), ("byte_per_sec", 4, "<I"), ("block_align", 2, "<H"), ("bit_per_sample", 2, "<H")):
                yield r.take(f"/{name}/{part}", w, form)[0]
            n -= 16
        elif tag == b"fact" and n >= 4:
            yield r.take(f"/{name}/nb_sample", 4, "<I")[0]
            n -= 4
        elif tag == b"LIST" and n >= 4 and r.data[r.at : r.at + 4] == b"INFO":
            end, k = r.at + n, 0
            yield r.take(f"/{name}/subtag", 4, None, _latin)[0]
            while r.at + 8 <= end:
                q = f"/{name}/field[{k}]"
                yield r.take(f"{q}/tag", 4, None, _latin)[0]
                f, w = r.take(f"{q}/size", 4, "<I")
                yield f
                yield r.take(f"{q}/content", min(w, end - r.at), None, _latin)[0]
                if w % 2 and r.at < end:
                    yield r.take(f"{q}/padding", 1, None, lambda v: None)[0]
                k += 1
            n = end - r.at + n % 2
            if n and r.at + n <= len(r.data):
                yield r.take(f"/{name}/padding", n, None, lambda v: None)[0]
            n = 0
        if n:
            yield r.take(f"/{name}/content", n + n % 2 if r.at + n + n % 2 <= len(r.data) else n, None, lambda v: None)[0]


def read_au(r: _Reader) -> Iterator[Field]:
    yield r.take("/signature", 4, None, _latin)[0]
    f, start = r.take("/data_ofs", 4, ">I")
    yield f
    f, size = r.take("/data_size", 4, ">I")
    yield f
    for part in ("codec", "sample_rate", "channels"):
        yield r.take(f"/{part}", 4, ">I")[0]
    if start > r.at:
        yield r.take("/info", start - r.at, None, _latin)[0]
    yield ("/audio_data", r.at * 8, min(size, len(r.data) - r.at) * 8, None)
    r.at = min(r.at + size, len(r.data))


def read_bmp(r: _Reader) -> Iterator[Field]:
    for part, n, form in (("signature", 2, None), ("file_size", 4, "<I"), ("reserved", 4, "<I")):
        yield r.take(f"/{part}", n, form, _latin if form is None else str)[0]
    f, start = r.take("/data_start", 4, "<I")
    yield f
    f, head = r.take("/header/header_size", 4, "<I")
    yield f
    if head >= 40:
        for part, n, form in (("width", 4, "<I"), ("height", 4, "<i"), ("nb_plan", 2, "<H"), ("bpp", 2, "<H"), ("compression", 4, "<I"), ("image_size", 4, "<I"), ("horizontal_dpi", 4, "<I"), ("vertical_dpi", 4, "<I"), ("used_colors", 4, "<I"), ("important_color", 4, "<I")):
            yield r.take(f"/header/{part}", n, form)[0]
    if start > r.at:
        yield r.take("/palette", start - r.at, None, lambda v: None)[0]
    yield ("/pixels", r.at * 8, (len(r.data) - r.at) * 8, None)
    r.at = len(r.data)


def read_gif(r: _Reader) -> Iterator[Field]:
    yield r.take("/magic", 6, None, _latin)[0]
    for part, n, form in (("screen/width", 2, "<H"), ("screen/height", 2, "<H")):
        yield r.take(f"/{part}", n, form)[0]
    f, flags = r.take("/screen/flags", 1, "B")
    yield f
    yield r.take("/screen/background", 1, "B")[0]
    yield r.take("/screen/pixel_ratio", 1, "B")[0]
    if flags & 0x80:
        yield r.take("/color_map", 3 * 2 ** ((flags & 7) + 1), None, lambda v: None)[0]
    yield ("/blocks", r.at * 8, (len(r.data) - r.at) * 8, None)
    r.at = len(r.data)


READERS: dict[str, Callable[[_Reader], Iterator[Field]]] = {
    "gzip": read_gzip, "zlib": read_zlib, "tar": read_tar, "zip": read_zip, "png": read_png, "wav": read_riff, "avi": read_riff,
    "au": read_au, "bmp": read_bmp, "gif": read_gif, "gif87": read_gif,
}


def parse_one(data: bytes, name: str) -> list[Field]:
    """The fields of one content; what can't be read ends in ``/raw[0]``."""
    r, out = _Reader(data), []
    try:
        for field in READERS[name](r):
            if field[2] < 0:
                break
            out.append(field)
    except (EOFError, struct.error, ValueError, IndexError):
        pass
    if r.at < len(data):
        out.append(("/raw[0]", r.at * 8, (len(data) - r.at) * 8, None))
    return out


def parse(contents: DataFrame, format_column: str | None = None) -> DataFrame:
    """Field rows of ``contents`` (id, content binary); formats are told by their magic numbers unless a column names them."""
    named = contents.where("content is not null").select("id", "content", (F.col(format_column) if format_column else magic_format(F.col("content"))).alias("format"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, f, *field) for i, c, f in zip(b["id"], b["content"], b["format"]) if f in READERS for field in parse_one(bytes(c), f)]
            yield pd.DataFrame(rows, columns=["id", "format", "path", "address_bits", "size_bits", "value"])

    return named.where(F.col("format").isin(*READERS)).mapInPandas(run, FIELD_SCHEMA)


def inflate(data: bytes, method: str) -> bytes | None:
    """``data`` decompressed (gzip, zlib, deflate, bzip2), None if it is broken."""
    try:
        return bz2.decompress(data) if method == "bzip2" else zlib.decompress(data, {"gzip": 31, "zlib": 15, "deflate": -15}[method])
    except (zlib.error, OSError, ValueError, EOFError):
        return None


def inflated(column, method: str):
    """Column of binary contents, decompressed in Arrow batches."""

    def run(contents: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else inflate(bytes(c), method) for c in contents], dtype=object)

    return F.pandas_udf(run, "binary")(column)


def files(spark, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """Files as (path, modificationTime, length, content), by Spark's binary source; content is read only where it is used."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)


from bitloom.sources import more_formats  # noqa: E402, F401  (adds its readers)
