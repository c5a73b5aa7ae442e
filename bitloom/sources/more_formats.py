"""Readers of further formats, after their public specifications; see :mod:`bitloom.sources.formats`."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from bitloom.sources.formats import READERS, Field, _hex, _latin, _Reader

#: Deepest nesting that recursive formats are followed to.
DEEPEST = 32


def _nothing(v: object) -> None:
    return None


def _table(r: _Reader, prefix: str, parts: str, endian: str = "<") -> Iterator[tuple[Field, object]]:
    """Fields written as "name:code" with struct's codes, or "name:4s" for text and "name:4x" for hex."""
    for part in parts.split():
        name, code = part.split(":")
        if code[-1] in "sx":
            yield r.take(f"{prefix}/{name}", int(code[:-1]), None, _latin if code[-1] == "s" else _hex)
        else:
            yield r.take(f"{prefix}/{name}", struct.calcsize(code), endian + code)


def _fields(r: _Reader, prefix: str, parts: str, endian: str = "<") -> Iterator[Field]:
    for f, _ in _table(r, prefix, parts, endian):
        yield f


def read_jpeg(r: _Reader) -> Iterator[Field]:
    yield r.take("/start_image", 2, None, _hex)[0]
    # Names of markers
    names = {0xC0: "start_frame", 0xC2: "start_frame", 0xC4: "huffman", 0xDB: "quantization", 0xDA: "start_scan", 0xE0: "app0", 0xE1: "exif", 0xED: "photoshop", 0xEE: "adobe", 0xFE: "comment", 0xDD: "restart_interval"}
    counts: dict[str, int] = {}
    while r.at + 2 <= len(r.data):
        marker = r.data[r.at + 1]
        if r.data[r.at] != 0xFF:
            raise EOFError
        if marker == 0xD9:
            yield r.take("/end_image", 2, None, _hex)[0]
            return
        name = names.get(marker, "chunk")
        counts[name] = counts.get(name, -1) + 1
        p = f"/{name}[{counts[name]}]"
        yield r.take(f"{p}/marker", 2, None, _hex)[0]
        f, size = r.take(f"{p}/size", 2, ">H")
        yield f
        if name == "start_frame" and size >= 8:
            yield from _fields(r, p, "precision:B height:H width:H nr_components:B", ">")
            yield r.take(f"{p}/components", size - 8, None, _hex)[0]
        elif name == "comment":
            yield r.take(f"{p}/text", size - 2, None, _latin)[0]
        elif size > 2:
            yield r.take(f"{p}/content", size - 2, None, _nothing)[0]
        if name == "start_scan":
            at = r.at
            while at + 1 < len(r.data) and not (r.data[at] == 0xFF and r.data[at + 1] not in (0, *range(0xD0, 0xD8))):
                at = r.data.find(b"\xff", at + 1) if r.data.find(b"\xff", at + 1) >= 0 else len(r.data)
            yield r.take(f"/image_data[{counts['start_scan']}]", min(at, len(r.data)) - r.at, None, _nothing)[0]


def read_tiff(r: _Reader) -> Iterator[Field]:
    f, order = r.take("/endian", 2, None, _latin)
    yield f
    e = "<" if order == b"II" else ">"
    yield r.take("/version", 2, f"{e}H")[0]
    f, at = r.take("/img_dir_ofs", 4, f"{e}I")
    yield f
    sizes, seen, i = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}, set(), 0
    # Common tags
    tags = {256: "ImageWidth", 257: "ImageLength", 258: "BitsPerSample", 259: "Compression", 270: "ImageDescription", 271: "Make", 272: "Model", 274: "Orientation", 282: "XResolution", 305: "Software", 306: "DateTime", 315: "Artist"}
    while at and at not in seen and at + 2 <= len(r.data):  # an offset that comes again ends the list
        seen.add(at)
        r.at = at
        f, n = r.take(f"/ifd[{i}]/count", 2, f"{e}H")
        yield f
        for k in range(n):
            start = r.at
            f, tag = r.take(f"/ifd[{i}]/entry[{k}]/tag", 2, f"{e}H", lambda v: tags.get(v, str(v)))
            yield f
            f, kind = r.take(f"/ifd[{i}]/entry[{k}]/type", 2, f"{e}H")
            yield f
            f, count = r.take(f"/ifd[{i}]/entry[{k}]/count", 4, f"{e}I")
            yield f
            size = sizes.get(kind, 1) * count
            offset = struct.unpack(f"{e}I", r.data[r.at : r.at + 4])[0] if r.at + 4 <= len(r.data) else 0
            where = r.at if size <= 4 else offset
            raw = r.data[where : where + size]
            value = _latin(raw) if kind == 2 else str(struct.unpack(f"{e}{'H' if kind == 3 else 'I'}", raw)[0]) if kind in (3, 4) and count == 1 and len(raw) == size else None
            yield (f"/ifd[{i}]/entry[{k}]/value", where * 8, size * 8, value)
            r.at = start + 12
        f, at = r.take(f"/ifd[{i}]/next", 4, f"{e}I")
        yield f
        i += 1
    r.at = len(r.data)


def read_ogg(r: _Reader) -> Iterator[Field]:
    i = 0
    while r.at < len(r.data):
        if r.data[r.at : r.at + 4] != b"OggS":
            raise EOFError
        p = f"/page[{i}]"
        yield from _fields(r, p, "capture_pattern:4s stream_structure_version:B flags:B abs_granule_pos:q serial:I page_no:I checksum:I")
        f, n = r.take(f"{p}/lacing_size", 1, "B")
        yield f
        f, lacing = r.take(f"{p}/lacing", n, None, _hex)
        yield f
        total, start = sum(lacing), r.at
        if r.data[start : start + 7] == b"\x03vorbis" and start + total <= len(r.data):
            yield r.take(f"{p}/vorbis_comment/header", 7, None, _nothing)[0]
            yield from _comments(r, f"{p}/vorbis_comment", start + total)
        elif r.data[start : start + 7] == b"\x01vorbis" and total >= 30:
            yield r.take(f"{p}/vorbis_hdr/header", 7, None, _nothing)[0]
            yield from _fields(r, f"{p}/vorbis_hdr", "vorbis_version:I audio_channels:B audio_sample_rate:I bitrate_maximum:I bitrate_nominal:I bitrate_minimum:I")
            yield r.take(f"{p}/vorbis_hdr/rest", start + total - r.at, None, _nothing)[0]
        elif total:
            yield r.take(f"{p}/segments", total, None, _nothing)[0]
        i += 1


def read_flac(r: _Reader) -> Iterator[Field]:
    yield r.take("/signature", 4, None, _latin)[0]
    i, last = 0, False
    while not last:
        p = f"/metadata[{i}]"
        f, head = r.take(f"{p}/type", 1, "B", lambda v: str(v & 0x7F))
        yield f
        last = head >= 0x80
        f, size = r.take(f"{p}/size", 3, None, lambda v: str(int.from_bytes(v, "big")))
        yield f
        n = int.from_bytes(size, "big")
        if head & 0x7F == 0 and n == 34:
            yield from _fields(r, p, "min_block:H max_block:H min_frame:3x max_frame:3x", ">")
            f, packed = r.take(f"{p}/packed", 8, ">Q")
            yield f
            at = r.at * 8 - 64
            yield (f"{p}/sample_rate", at, 20, str(packed >> 44))
            yield (f"{p}/nb_channel", at + 20, 3, str((packed >> 41 & 7) + 1))
            yield (f"{p}/bits_per_sample", at + 23, 5, str((packed >> 36 & 31) + 1))
            yield (f"{p}/total_samples", at + 28, 36, str(packed & (1 << 36) - 1))
            yield r.take(f"{p}/md5", 16, None, _hex)[0]
        elif head & 0x7F == 4:
            yield from _comments(r, p, r.at + n)
        elif n:
            yield r.take(f"{p}/content", n, None, _nothing)[0]
        i += 1
    yield ("/frames", r.at * 8, (len(r.data) - r.at) * 8, None)
    r.at = len(r.data)


def _comments(r: _Reader, prefix: str, end: int) -> Iterator[Field]:
    """Vorbis comments: the vendor, then pairs of tag and value; what is left up to ``end`` is padding."""
    utf8 = lambda v: v.decode("utf-8", "replace")
    f, n = r.take(f"{prefix}/vendor_length", 4, "<I")
    yield f
    yield r.take(f"{prefix}/vendor", n, None, utf8)[0]
    f, count = r.take(f"{prefix}/count", 4, "<I")
    yield f
    for i in range(count):
        f, n = r.take(f"{prefix}/comment[{i}]/size", 4, "<I")
        yield f
        name = r.data[r.at : r.at + n].split(b"=")[0]
        if len(name) == n or r.at + n > end:
            raise EOFError
        yield r.take(f"{prefix}/comment[{i}]/tag", len(name), None, lambda v: utf8(v).upper())[0]
        yield r.take(f"{prefix}/comment[{i}]/equals", 1, None, _nothing)[0]
        yield r.take(f"{prefix}/comment[{i}]/content", n - len(name) - 1, None, utf8)[0]
    if end > r.at:
        yield r.take(f"{prefix}/padding", end - r.at, None, _nothing)[0]


def _syncsafe(v: bytes) -> int:
    return v[0] << 21 | v[1] << 14 | v[2] << 7 | v[3]


def read_id3(r: _Reader) -> Iterator[Field]:
    p = "/id3v2"
    yield from _fields(r, p, "header:3s major:B minor:B flags:B")
    major = r.data[3]
    f, size = r.take(f"{p}/size", 4, None, lambda v: str(_syncsafe(v)))
    yield f
    end, i = r.at + _syncsafe(size), 0
    codecs = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}
    head = 6 if major == 2 else 10
    while r.at + head <= min(end, len(r.data)) and r.data[r.at]:
        q = f"{p}/field[{i}]"
        f, tag = r.take(f"{q}/tag", 3 if major == 2 else 4, None, _latin)
        yield f
        f, raw = r.take(f"{q}/size", 3 if major == 2 else 4, None, lambda v: str(_syncsafe(v) if major == 4 else int.from_bytes(v, "big")))
        yield f
        n = int(f[3])
        if major > 2:
            yield r.take(f"{q}/flags", 2, None, _hex)[0]
        if n:
            # comments have a language and a short description before the text
            show = lambda v: v[1:].decode(codecs.get(v[0], "latin-1"), "replace").strip("\0") if tag[:1] == b"T" else v[4:].decode(codecs.get(v[0], "latin-1"), "replace").lstrip("\ufeff").split("\0")[-1].lstrip("\ufeff") if tag in (b"COMM", b"COM") else None
            yield r.take(f"{q}/content", n, None, show)[0]
        i += 1
    if end > r.at:
        yield r.take(f"{p}/padding", end - r.at, None, _nothing)[0]
    tail = 128 if r.data[-128:-125] == b"TAG" and len(r.data) - r.at >= 128 else 0
    if len(r.data) - tail > r.at:
        yield from _mpeg_frame(r, len(r.data) - tail)
        yield ("/frames", r.at * 8, (len(r.data) - tail - r.at) * 8, None)
    r.at = len(r.data) - tail
    if tail:
        yield from _fields(r, "/id3v1", "signature:3s song:30s author:30s album:30s year:4s comment:30s genre:B")


# Kbit a second of layer III, by index, for MPEG 1 and for 2 and 2.5; samples a second of MPEG 1.
LAYER3_1 = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
LAYER3_2 = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
SAMPLE_RATES = (44100, 48000, 32000)


def _mpeg_frame(r: _Reader, end: int) -> Iterator[Field]:
    """The header of the first frame of layer III, if the sound starts with one, as fields of ``/frames/frame[0]``; its bytes stay unread."""
    if end - r.at < 4:
        return
    word = int.from_bytes(r.data[r.at : r.at + 4], "big")
    version, layer, rate, sample, mode = word >> 19 & 3, word >> 17 & 3, word >> 12 & 15, word >> 10 & 3, word >> 6 & 3
    if word >> 21 != 0x7FF or version == 1 or layer != 1 or rate in (0, 15) or sample == 3:
        return
    at = r.at * 8
    p = "/frames/frame[0]"
    kbit = (LAYER3_1 if version == 3 else LAYER3_2)[rate]
    yield (f"{p}/version", at + 11, 2, {3: "1", 2: "2", 0: "2.5"}[version])
    yield (f"{p}/bit_rate", at + 16, 4, str(kbit * 1000))
    yield (f"{p}/sampling_rate", at + 20, 2, str(SAMPLE_RATES[sample] >> {3: 0, 2: 1, 0: 2}[version]))
    yield (f"{p}/nb_channel", at + 24, 2, "1" if mode == 3 else "2")


#: Atoms of MP4 that hold atoms.
NESTING = frozenset("moov trak mdia minf stbl udta edts dinf moof traf mvex ilst".split())


def read_mp4(r: _Reader) -> Iterator[Field]:
    def atoms(end: int, prefix: str, depth: int) -> Iterator[Field]:
        i = 0
        while r.at + 8 <= end:
            start, p = r.at, f"{prefix}/atom[{i}]"
            f, size = r.take(f"{p}/size", 4, ">I")
            yield f
            f, tag = r.take(f"{p}/tag", 4, None, _latin)
            yield f
            if size == 1:
                f, size = r.take(f"{p}/size64", 8, ">Q")
                yield f
            stop = end if size == 0 else min(start + size, end)
            if stop < r.at:
                raise EOFError
            if tag.decode("latin-1") in NESTING and depth < DEEPEST:
                yield from atoms(stop, p, depth + 1)
            elif tag == b"ftyp" and stop - r.at >= 8:
                yield from _fields(r, p, "brand:4s version:I", ">")
            elif tag == b"meta" and stop - r.at >= 4:
                yield r.take(f"{p}/version", 4, ">I")[0]
                yield from atoms(stop, p, depth + 1)
            elif tag == b"mvhd" and stop - r.at >= 20 and r.data[r.at] == 0:
                yield from _fields(r, p, "version:I creation_date:I lastmod_date:I time_scale:I duration:I", ">")
            elif prefix.endswith("/ilst") or r.data[r.at + 4 : r.at + 8] == b"data" and stop - r.at >= 16:
                yield from _fields(r, p, "item_size:I item_tag:4s item_type:I locale:I", ">")
                yield r.take(f"{p}/content", stop - r.at, None, lambda v: v.decode("utf-8", "replace"))[0]
            if stop > r.at:
                yield r.take(f"{p}/data", stop - r.at, None, _nothing)[0]
            i += 1

    yield from atoms(len(r.data), "", 0)


# Names of container elements by id; those in capitals first hold elements.
EBML = {
    0x1A45DFA3: "EBML", 0x18538067: "Segment", 0x1549A966: "Info", 0x1654AE6B: "Tracks", 0xAE: "TrackEntry", 0x1F43B675: "Cluster", 0xA0: "BlockGroup", 0x1254C367: "Tags", 0x7373: "Tag",
    0x67C8: "SimpleTag", 0xE0: "Video", 0xE1: "Audio", 0x1C53BB6B: "Cues", 0x114D9B74: "SeekHead",
    0x4282: "DocType", 0x2AD7B1: "TimecodeScale", 0x4489: "Duration", 0x4D80: "MuxingApp", 0x5741: "WritingApp", 0xD7: "TrackNumber", 0x73C5: "TrackUID", 0x83: "TrackType", 0x86: "CodecID",
    0x22B59C: "Language", 0x536E: "Name", 0xB0: "PixelWidth", 0xBA: "PixelHeight", 0xB5: "SamplingFrequency", 0x9F: "Channels", 0xE7: "Timecode", 0xA3: "SimpleBlock", 0x45A3: "TagName", 0x4487: "TagString",
    0x7BA9: "Title",
}
_EBML_SETS = frozenset("EBML Segment Info Tracks TrackEntry Cluster BlockGroup Tags Tag SimpleTag Video Audio".split())
_EBML_TEXT = frozenset("DocType MuxingApp WritingApp CodecID Language Name TagName TagString Title".split())
_EBML_FLOAT = frozenset(("Duration", "SamplingFrequency"))


def read_mkv(r: _Reader) -> Iterator[Field]:
    def vint(path: str, keep: bool) -> tuple[Field, int, bool]:
        if r.at >= len(r.data) or not r.data[r.at]:
            raise EOFError
        n = 9 - r.data[r.at].bit_length()
        f, raw = r.take(path, n, None, _hex)
        value = int.from_bytes(raw, "big")
        bare = value & (1 << 7 * n) - 1
        return f, value if keep else bare, not keep and bare == (1 << 7 * n) - 1

    def show(name: str, v: bytes) -> str | None:
        if name in _EBML_TEXT:
            return v.decode("utf-8", "replace").rstrip("\0")
        if name in _EBML_FLOAT and len(v) in (4, 8):
            return str(struct.unpack(">f" if len(v) == 4 else ">d", v)[0])
        return str(int.from_bytes(v, "big")) if len(v) <= 8 and name in EBML.values() else None

    def elements(end: int, prefix: str, depth: int) -> Iterator[Field]:
        counts: dict[str, int] = {}
        while r.at < end:
            f, ident, _ = vint(f"{prefix}/id", True)
            name = EBML.get(ident, "unknown")
            counts[name] = counts.get(name, -1) + 1
            p = f"{prefix}/{name}[{counts[name]}]"
            yield (f"{p}/id", *f[1:])
            f, size, unknown = vint(f"{p}/size", False)
            yield (f[0], f[1], f[2], None if unknown else str(size))
            stop = end if unknown else min(r.at + size, end)
            if name in _EBML_SETS and depth < DEEPEST:
                yield from elements(stop, p, depth + 1)
            elif stop > r.at:
                yield r.take(f"{p}/value", stop - r.at, None, lambda v, name=name: show(name, v))[0]

    yield from elements(len(r.data), "", 0)


def read_flv(r: _Reader) -> Iterator[Field]:
    yield from _fields(r, "/header", "signature:3s version:B flags:B data_offset:I", ">")
    i = 0
    yield r.take("/prev_size[0]", 4, ">I")[0]
    while r.at + 11 <= len(r.data):
        p = f"/chunk[{i}]"
        yield r.take(f"{p}/tag", 1, "B")[0]
        f, size = r.take(f"{p}/size", 3, None, lambda v: str(int.from_bytes(v, "big")))
        yield f
        yield r.take(f"{p}/timestamp", 4, None, lambda v: str(v[3] << 24 | int.from_bytes(v[:3], "big")))[0]
        yield r.take(f"{p}/stream_id", 3, None, _hex)[0]
        if n := int.from_bytes(size, "big"):
            yield r.take(f"{p}/content", n, None, _nothing)[0]
        i += 1
        yield r.take(f"/prev_size[{i}]", 4, ">I")[0]


def read_pcap(r: _Reader) -> Iterator[Field]:
    e = ">" if r.data[:4] == b"\xa1\xb2\xc3\xd4" else "<"
    yield from _fields(r, "", "id:4x maj_ver:H min_ver:H this_zone:I sigfigs:I snap_len:I link_type:I", e)
    i = 0
    while r.at < len(r.data):
        p = f"/packet[{i}]"
        yield from _fields(r, p, "ts_epoch:I ts_nanosec:I", e)
        f, n = r.take(f"{p}/caplen", 4, f"{e}I")
        yield f
        yield r.take(f"{p}/len", 4, f"{e}I")[0]
        if n:
            yield r.take(f"{p}/data", n, None, _nothing)[0]
        i += 1


def read_elf(r: _Reader) -> Iterator[Field]:
    yield from _fields(r, "/header", "signature:4x class:B endian:B file_version:B osabi_ident:B pad:8x")
    e, word = "<" if r.data[5] == 1 else ">", "Q" if r.data[4] == 2 else "I"
    yield from _fields(r, "/header", f"type:H machine:H version:I entry:{word} phoff:{word} shoff:{word} flags:I ehsize:H phentsize:H phnum:H shentsize:H shnum:H shstrndx:H", e)
    yield ("/body", r.at * 8, (len(r.data) - r.at) * 8, None)
    r.at = len(r.data)


def read_exe(r: _Reader) -> Iterator[Field]:
    yield from _fields(r, "/msdos", "header:2s size_mod_512:H size_div_512:H reloc_entries:H code_offset:H needed_memory:H max_memory:H init_ss:H init_sp:H checksum:H init_ip:H init_cs:H reloc_offset:H overlay:H reserved:32x")
    f, at = r.take("/msdos/next_offset", 4, "<I")
    yield f
    if r.at <= at and r.data[at : at + 4] == b"PE\0\0":
        if at > r.at:
            yield r.take("/msdos/code", at - r.at, None, _nothing)[0]
        yield from _fields(r, "/pe_header", "header:4x cpu:H nb_section:H creation_date:I ptr_to_sym:I nb_symbols:I opt_hdr_size:H characteristics:H")
    yield ("/body", r.at * 8, (len(r.data) - r.at) * 8, None)
    r.at = len(r.data)


def read_java_class(r: _Reader) -> Iterator[Field]:
    yield from _fields(r, "", "magic:4x minor_version:H major_version:H", ">")
    f, n = r.take("/constant_pool_count", 2, ">H")
    yield f
    sizes, i = {3: 4, 4: 4, 5: 8, 6: 8, 7: 2, 8: 2, 9: 4, 10: 4, 11: 4, 12: 4, 15: 3, 16: 2, 17: 4, 18: 4, 19: 2, 20: 2}, 1
    while i < n:
        p = f"/constant_pool[{i}]"
        f, tag = r.take(f"{p}/tag", 1, "B")
        yield f
        if tag == 1:
            f, size = r.take(f"{p}/length", 2, ">H")
            yield f
            if size:
                yield r.take(f"{p}/bytes", size, None, lambda v: v.decode("utf-8", "replace"))[0]
        elif tag in sizes:
            yield r.take(f"{p}/value", sizes[tag], None, _hex)[0]
        else:
            raise EOFError
        i += 2 if tag in (5, 6) else 1
    yield ("/body", r.at * 8, (len(r.data) - r.at) * 8, None)
    r.at = len(r.data)


def read_midi(r: _Reader) -> Iterator[Field]:
    yield from _fields(r, "", "signature:4s header_size:I file_format:H nb_track:H delta_time:H", ">")
    i = 0
    while r.at + 8 <= len(r.data):
        yield r.take(f"/track[{i}]/marker", 4, None, _latin)[0]
        f, n = r.take(f"/track[{i}]/size", 4, ">I")
        yield f
        if n:
            yield r.take(f"/track[{i}]/events", n, None, _nothing)[0]
        i += 1


def read_cab(r: _Reader) -> Iterator[Field]:
    got = {}
    for f, v in _table(r, "", "magic:4s hdr_checksum:I filesize:I fld_checksum:I off_file:I files_checksum:I minor_version:B major_version:B folder_count:H file_count:H flags:H setid:H number:H"):
        got[f[0][1:]] = v
        yield f
    if got["flags"] & 4:
        raise EOFError
    for i in range(got["folder_count"]):
        yield from _fields(r, f"/folder[{i}]", "offset:I data_blocks:H compression:H")
    if got["off_file"] > r.at:
        yield r.take("/gap", got["off_file"] - r.at, None, _nothing)[0]
    for i in range(got["file_count"]):
        yield from _fields(r, f"/file[{i}]", "filesize:I folder_offset:I folder_index:H date:H time:H attributes:H")
        yield r.text_until(f"/file[{i}]/filename")[0]
    yield ("/folder_data", r.at * 8, (len(r.data) - r.at) * 8, None)
    r.at = len(r.data)


def read_bzip2(r: _Reader) -> Iterator[Field]:
    yield from _fields(r, "", "id:2s version:1s blocksize:1s")
    yield ("/file", r.at * 8, (len(r.data) - r.at) * 8, None)
    r.at = len(r.data)


def read_ole2(r: _Reader) -> Iterator[Field]:
    yield from _fields(r, "/header", "id:8x guid:16x ver_min:H ver_maj:H endian:2x bb_shift:H sb_shift:H reserved:6x csectdir:I bb_count:I bb_start:I transaction:I threshold:I sb_start:I sb_count:I db_start:I db_count:I")
    yield ("/sectors", r.at * 8, (len(r.data) - r.at) * 8, None)
    r.at = len(r.data)


READERS |= {
    "jpeg": read_jpeg, "tiff": read_tiff, "tiff_be": read_tiff, "ogg": read_ogg, "flac": read_flac, "mpeg_audio": read_id3, "mp4": read_mp4, "mkv": read_mkv, "flv": read_flv,
    "pcap": read_pcap, "elf": read_elf, "exe": read_exe, "java_class": read_java_class, "midi": read_midi, "cab": read_cab, "bzip2": read_bzip2, "ole2": read_ole2,
}
