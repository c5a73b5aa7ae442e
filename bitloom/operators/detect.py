"""Formats told by extension and by magic numbers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.functions.text import extension
from bitloom.operators.validate import valid

# Id, category, extensions, MIME type, magic (hex), offset of the magic in bytes.
FORMATS = [
    ("gzip", "archive", "gz tgz", "application/x-gzip", "1f8b08", 0), ("zip", "archive", "zip jar docx odt", "application/zip", "504b0304", 0),
    ("tar", "archive", "tar", "application/x-tar", "7573746172", 257), ("bzip2", "archive", "bz2 tbz2", "application/x-bzip2", "425a68", 0),
    ("7zip", "archive", "7z", "application/x-7z-compressed", "377abcaf271c", 0), ("cab", "archive", "cab", "application/vnd.ms-cab-compressed", "4d534346", 0),
    ("rar", "archive", "rar", "application/x-rar-compressed", "526172211a07", 0), ("png", "image", "png", "image/png", "89504e470d0a1a0a", 0),
    ("gif", "image", "gif", "image/gif", "474946383961", 0), ("gif87", "image", "gif", "image/gif", "474946383761", 0), ("jpeg", "image", "jpg jpeg", "image/jpeg", "ffd8ff", 0),
    ("bmp", "image", "bmp dib", "image/x-ms-bmp", "424d", 0), ("tiff", "image", "tif tiff", "image/tiff", "49492a00", 0), ("tiff_be", "image", "tif tiff", "image/tiff", "4d4d002a", 0),
    ("psd", "image", "psd", "image/psd", "38425053", 0), ("xcf", "image", "xcf", "image/x-xcf", "67696d702078636620", 0), ("wav", "audio", "wav", "audio/x-wav", "57415645", 8),
    ("avi", "video", "avi", "video/x-msvideo", "41564920", 8), ("au", "audio", "au snd", "audio/basic", "2e736e64", 0), ("ogg", "container", "ogg ogv oga", "application/ogg", "4f676753", 0),
    ("flac", "audio", "flac", "audio/x-flac", "664c6143", 0), ("mpeg_audio", "audio", "mp3 mp2", "audio/mpeg", "494433", 0), ("mkv", "container", "mkv mka webm", "video/x-matroska", "1a45dfa3", 0),
    ("mp4", "container", "mp4 mov m4a", "video/mp4", "66747970", 4), ("asf", "container", "asf wma wmv", "video/x-ms-asf", "3026b2758e66cf11", 0), ("flv", "video", "flv", "video/x-flv", "464c5601", 0),
    ("elf", "program", "so o", "application/x-executable", "7f454c46", 0), ("exe", "program", "exe dll", "application/x-dosexec", "4d5a", 0), ("java_class", "program", "class", "application/java-vm", "cafebabe", 0),
    ("ole2", "misc", "doc xls ppt", "application/msword", "d0cf11e0a1b11ae1", 0), ("pdf", "misc", "pdf", "application/pdf", "255044462d", 0), ("pcap", "network", "pcap cap", "application/vnd.tcpdump.pcap", "d4c3b2a1", 0),
    ("nds", "program", "nds", "application/x-nintendo-ds-rom", "", 0), ("sqlite", "misc", "db sqlite", "application/x-sqlite3", "53514c69746520666f726d6174203300", 0), ("midi", "audio", "mid midi", "audio/midi", "4d546864", 0),
]


def formats(spark: SparkSession) -> DataFrame:
    """The dimension of formats."""
    return spark.createDataFrame(FORMATS, "format string, category string, extensions string, mime_type string, magic string, offset int")


def by_extension(files: DataFrame, filename: str = "filename") -> DataFrame:
    """``files`` with guess: the first format (by name) that claims the extension, null for none; a literal map, no join."""
    claims: dict[str, str] = {}
    for name, _, ext, *_ in sorted(FORMATS):
        for e in ext.split():
            claims.setdefault(f".{e}", name)
    return files.withColumn("guess", F.element_at(F.create_map(*[F.lit(x) for kv in sorted(claims.items()) for x in kv]), extension(F.col(filename))))


def magic_format(data: Column) -> Column:
    """The format whose magic number ``data`` has: the longest magic wins, then the name; null for none."""
    ranked = sorted((f for f in FORMATS if f[4]), key=lambda f: (-len(f[4]), f[0]))
    head = F.lower(F.hex(F.substring(data, 1, 300)))
    out = None
    for name, _, _, _, magic, offset in ranked:
        hit = F.substring(head, 2 * offset + 1, len(magic)) == magic
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def validated(contents: DataFrame) -> DataFrame:
    """``contents`` (id, content) with guess: the first format, by the order of :func:`magic_format`, whose magic number and header hold;
    null for none and for null contents."""
    ranked = sorted((f for f in FORMATS if f[4]), key=lambda f: (-len(f[4]), f[0]))
    magics = [(name, bytes.fromhex(magic), offset) for name, _, _, _, magic, offset in ranked]

    def run(contents: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else next((n for n, m, o in magics if c[o : o + len(m)] == m and valid(c, n)), None) for c in contents], dtype=object)

    return contents.withColumn("guess", F.pandas_udf(run, "string")("content"))
