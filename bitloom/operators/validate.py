"""Whether the bytes from a place on are a content of a format, and how many belong to it: checks of headers beyond the magic number.

Everything reads in place, by offset; nothing copies what follows a hit.
"""

from __future__ import annotations

import bz2
import re
import struct
import zlib
from collections.abc import Callable

#: Bytes handed to a decompressor at once when a compressed content's end is looked for.
PIECE = 1 << 16


def _at(data: bytes, at: int, form: str) -> tuple:
    return struct.unpack_from(form, data, at)


def _png(d: bytes, at: int) -> bool:
    size, tag, width, height = _at(d, at + 8, ">I4sII")
    return size == 13 and tag == b"IHDR" and width > 0 < height and zlib.crc32(d[at + 12 : at + 29]) == _at(d, at + 29, ">I")[0]


def _gif(d: bytes, at: int) -> bool:
    width, height, flags = _at(d, at + 6, "<HHB")
    block = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    return width > 0 < height and d[block] in (0x21, 0x2C, 0x3B)


def _jpeg(d: bytes, at: int) -> bool:
    marker, size = _at(d, at + 3, ">BH")
    return (0xC0 <= marker <= 0xFE and marker not in (0xD8, 0xD9)) and size >= 2 and d[at + 4 + size] == 0xFF


def _bmp(d: bytes, at: int) -> bool:
    size, reserved, start, head = _at(d, at + 2, "<IIII")
    # Sizes of the header's versions, bits a pixel.
    planes, bits = _at(d, at + 22, "<HH") if head == 12 else _at(d, at + 26, "<HH")
    return reserved == 0 and head in (12, 40, 52, 56, 64, 108, 124) and planes == 1 and bits in (1, 2, 4, 8, 16, 24, 32) and 14 + head <= start <= size


def _tiff(d: bytes, at: int) -> bool:
    e = "<" if d[at : at + 2] == b"II" else ">"
    place = _at(d, at + 4, f"{e}I")[0]
    n, tag, kind = _at(d, at + place, f"{e}HHH")
    return place >= 8 and 0 < n < 500 and 1 <= kind <= 13 and tag >= 254


def _zip(d: bytes, at: int) -> bool:
    version, _, method = _at(d, at + 4, "<HHH")
    # Methods of compression.
    return version <= 63 and method in (0, 1, 6, 8, 9, 12, 14, 93, 95, 96, 98, 99) and 0 < _at(d, at + 26, "<H")[0] < 1024


def _tar(d: bytes, at: int) -> bool:
    head = d[at : at + 512]
    written = head[148:156].strip(b" \0")
    return len(head) == 512 and bool(re.fullmatch(rb"[0-7]+", written)) and int(written, 8) == sum(head) - sum(head[148:156]) + 8 * 32


def _au(d: bytes, at: int) -> bool:
    start, _, codec, rate, channels = _at(d, at + 4, ">IIIII")
    return 24 <= start < 65536 and 1 <= codec <= 27 and 1000 <= rate <= 192000 and 1 <= channels <= 16


def _id3(d: bytes, at: int) -> bool:
    major, minor, flags, *size = _at(d, at + 3, "BBB4B")
    return 2 <= major <= 4 and minor < 255 and flags & 0x0F == 0 and all(x < 128 for x in size)


def _exe(d: bytes, at: int) -> bool:
    place = _at(d, at + 60, "<I")[0]
    return 64 <= place < 1 << 20 and d[at + place : at + place + 4] in (b"PE\0\0",) or d[at + place : at + place + 2] == b"NE" and 64 <= place < 4096 and d[at + place + 2] in (4, 5, 6)


def _mp4(d: bytes, at: int) -> bool:
    size = _at(d, at, ">I")[0]
    return 16 <= size <= 512 and size % 4 == 0 and bool(re.fullmatch(rb"[\x20-\x7e]{4}", d[at + 8 : at + 12]))


def _sqlite(d: bytes, at: int) -> bool:
    page = _at(d, at + 16, ">H")[0]
    return page == 1 or 512 <= page and page & (page - 1) == 0


VALID: dict[str, Callable[[bytes, int], bool]] = {
    "png": _png, "gif": _gif, "gif87": _gif, "jpeg": _jpeg, "bmp": _bmp, "tiff": _tiff, "tiff_be": _tiff, "zip": _zip, "tar": _tar, "au": _au, "mpeg_audio": _id3, "exe": _exe,
    "mp4": _mp4, "sqlite": _sqlite,
    "gzip": lambda d, at: d[at + 2] == 8 and d[at + 3] & 0xE0 == 0 and (d[at + 9] <= 13 or d[at + 9] == 255),
    "bzip2": lambda d, at: 49 <= d[at + 3] <= 57 and d[at + 4 : at + 10] in (bytes.fromhex("314159265359"), bytes.fromhex("177245385090")),
    "7zip": lambda d, at: d[at + 6] == 0 and zlib.crc32(d[at + 12 : at + 32]) == _at(d, at + 8, "<I")[0],
    "cab": lambda d, at: d[at + 24 : at + 26] == b"\x03\x01" and _at(d, at + 8, "<I")[0] >= 36,
    "rar": lambda d, at: d[at + 6] in (0, 1),
    "wav": lambda d, at: d[at : at + 4] == b"RIFF" and _at(d, at + 4, "<I")[0] >= 4,
    "avi": lambda d, at: d[at : at + 4] == b"RIFF" and _at(d, at + 4, "<I")[0] >= 4,
    "ogg": lambda d, at: d[at + 4] == 0 and d[at + 5] < 8,
    "flac": lambda d, at: d[at + 4] & 127 == 0 and d[at + 5 : at + 8] == b"\0\0\x22",
    "midi": lambda d, at: _at(d, at + 4, ">I")[0] == 6 and _at(d, at + 8, ">H")[0] <= 2 and _at(d, at + 10, ">H")[0] >= 1,
    "mkv": lambda d, at: any(x in d[at : at + 64] for x in (b"matroska", b"webm")),
    "asf": lambda d, at: d[at : at + 16] == bytes.fromhex("3026b2758e66cf11a6d900aa0062ce6c"),
    "flv": lambda d, at: d[at + 3] == 1 and d[at + 4] & 0xFA == 0 and _at(d, at + 5, ">I")[0] == 9,
    "elf": lambda d, at: d[at + 4] in (1, 2) and d[at + 5] in (1, 2) and d[at + 6] == 1,
    "java_class": lambda d, at: 45 <= _at(d, at + 6, ">H")[0] <= 80 and _at(d, at + 4, ">H")[0] in (0, 3, 65535) and _at(d, at + 8, ">H")[0] > 1,
    "ole2": lambda d, at: d[at + 28 : at + 30] == b"\xfe\xff" and _at(d, at + 30, "<H")[0] in (9, 12),
    "pdf": lambda d, at: bool(re.match(rb"[12]\.\d", d[at + 5 : at + 8])),
    "pcap": lambda d, at: _at(d, at + 4, "<HH") == (2, 4) and _at(d, at + 20, "<I")[0] < 512,
    "psd": lambda d, at: _at(d, at + 4, ">H")[0] in (1, 2) and d[at + 6 : at + 12] == bytes(6) and 1 <= _at(d, at + 12, ">H")[0] <= 56,
    "xcf": lambda d, at: d[at + 9 : at + 13] == b"file" or d[at + 9 : at + 10] == b"v",
}


def valid(data: bytes, name: str, at: int = 0) -> bool:
    """Whether ``data`` from ``at`` on begins as contents of this format do; False for what breaks off, and for unknown formats."""
    try:
        return name in VALID and VALID[name](data, at)
    except (struct.error, IndexError):
        return False


def _end_of_png(d: bytes, at: int) -> int | None:
    place = at + 8
    while place + 12 <= len(d):
        size, tag = _at(d, place, ">I4s")
        place += 12 + size
        if tag == b"IEND":
            return place
    return None


def _end_of_tar(d: bytes, at: int) -> int | None:
    place = at
    while place + 512 <= len(d) and d[place] and _tar(d, place):
        digits = d[place + 124 : place + 136].strip(b" \0")
        place += 512 + -(-int(digits or b"0", 8) // 512) * 512 if re.fullmatch(rb"[0-7]*", digits) else 512
    end = place
    while end + 512 <= len(d) and end < place + 20 * 512 and not any(d[end : end + 512]):  # the terminator fills a record of 20 blocks
        end += 512
    return end if place > at and end > place else None


def _end_of_gif(d: bytes, at: int) -> int | None:
    flags, place = d[at + 10], at + 13
    place += 3 << ((flags & 7) + 1) if flags & 0x80 else 0
    while d[place] != 0x3B:
        if d[place] == 0x2C:
            local = d[place + 9]
            place += 11 + (3 << ((local & 7) + 1) if local & 0x80 else 0)
        elif d[place] == 0x21:
            place += 2
        else:
            return None
        while d[place]:
            place += d[place] + 1
        place += 1
    return place + 1


def _end_of_jpeg(d: bytes, at: int) -> int | None:
    place = at + 2
    while d[place] == 0xFF:
        marker = d[place + 1]
        if marker == 0xD9:
            return place + 2
        place += 2 + _at(d, place + 2, ">H")[0]
        while marker == 0xDA:  # scan data up to a marker that isn't part of it
            place = d.find(b"\xff", place)
            if place < 0:
                return None
            if d[place + 1] and not 0xD0 <= d[place + 1] <= 0xD7:
                break
            place += 2
    return None


def _end_of_ogg(d: bytes, at: int) -> int | None:
    place = at
    while d[place : place + 4] == b"OggS":
        last, n = d[place + 5] & 4, d[place + 26]
        place += 27 + n + sum(d[place + 27 : place + 27 + n])
        if last:
            return place
    return None


def _end_of_midi(d: bytes, at: int) -> int | None:
    place = at + 14
    for _ in range(_at(d, at + 10, ">H")[0]):
        if d[place : place + 4] != b"MTrk":
            return None
        place += 8 + _at(d, place + 4, ">I")[0]
    return place


def _end_of_zip(d: bytes, at: int) -> int | None:
    end = d.find(b"PK\x05\x06", at)
    return end + 22 + _at(d, end + 20, "<H")[0] if end >= 0 else None


def _end_of_packed(decompressor: Callable) -> Callable[[bytes, int], int | None]:
    def end(d: bytes, at: int) -> int | None:
        unpack, place = decompressor(), at
        try:
            while place < len(d) and not unpack.eof:
                unpack.decompress(d[place : place + PIECE])
                place += PIECE
        except (zlib.error, OSError, ValueError):
            return None
        return min(place, len(d)) - len(unpack.unused_data) if unpack.eof else None

    return end


def _end_of_mp4(d: bytes, at: int) -> int | None:
    place = at
    while place + 8 <= len(d) and re.fullmatch(rb"[a-zA-Z0-9 ]{4}", d[place + 4 : place + 8]):
        size = _at(d, place, ">I")[0]
        size = _at(d, place + 8, ">Q")[0] if size == 1 else size
        if size < 8 or place + size > len(d):
            break
        place += size
    return place if place > at else None


END: dict[str, Callable[[bytes, int], int | None]] = {
    "png": _end_of_png, "tar": _end_of_tar, "gif": _end_of_gif, "gif87": _end_of_gif, "jpeg": _end_of_jpeg, "ogg": _end_of_ogg, "midi": _end_of_midi, "zip": _end_of_zip, "mp4": _end_of_mp4,
    "gzip": _end_of_packed(lambda: zlib.decompressobj(31)), "bzip2": _end_of_packed(bz2.BZ2Decompressor),
    "bmp": lambda d, at: at + _at(d, at + 2, "<I")[0], "wav": lambda d, at: at + 8 + _at(d, at + 4, "<I")[0], "avi": lambda d, at: at + 8 + _at(d, at + 4, "<I")[0],
    "au": lambda d, at: at + sum(_at(d, at + 4, ">II")) if _at(d, at + 8, ">I")[0] != 0xFFFFFFFF else None, "cab": lambda d, at: at + _at(d, at + 8, "<I")[0],
    "7zip": lambda d, at: at + 32 + sum(_at(d, at + 12, "<QQ")), "sqlite": lambda d, at: at + (_at(d, at + 16, ">H")[0] if _at(d, at + 16, ">H")[0] != 1 else 65536) * _at(d, at + 28, ">I")[0],
}


def content_size(data: bytes, name: str, at: int = 0) -> int | None:
    """Bytes that a valid content of this format takes from ``at`` on; None if its end isn't told, or it breaks off before."""
    try:
        end = END[name](data, at) if name in END else None
    except (struct.error, IndexError):
        return None
    return end - at if end is not None and end > at else None
