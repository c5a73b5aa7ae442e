import struct

import pytest

from bitloom.sources import formats as S


def ebml(ident: bytes, body: bytes) -> bytes:
    return ident + struct.pack(">Q", 1 << 56 | len(body)) + body


def atom(tag: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body) + 8) + tag + body


MKV = ebml(b"\x1a\x45\xdf\xa3", ebml(b"\x42\x82", b"matroska")) + ebml(b"\x18\x53\x80\x67", ebml(b"\x15\x49\xa9\x66", ebml(b"\x44\x89", struct.pack(">d", 12.5))) + ebml(b"\x16\x54\xae\x6b", ebml(b"\xae", ebml(b"\xd7", b"\x03"))))
PAGE = b"OggS" + struct.pack("<BBqIIIB", 0, 2, 0, 7, 0, 0, 2) + bytes([3, 2]) + b"abcde"
FLAC = b"fLaC" + bytes([0x80]) + (34).to_bytes(3, "big") + struct.pack(">HH", 16, 16) + bytes(6) + ((44100 << 44) | (1 << 41) | (15 << 36) | 999).to_bytes(8, "big") + bytes(16) + b"frames"
FRAME = b"TIT2" + (6).to_bytes(4, "big") + b"\0\0" + b"\0title"
ID3 = b"ID3\x03\0\0" + bytes([0, 0, 0, len(FRAME) + 4]) + FRAME + bytes(4) + b"\xff\xfb" * 10 + b"TAG" + b"song".ljust(30, b"\0") + bytes(94) + b"\x05"
TIFF = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 2) + struct.pack("<HHII", 256, 3, 1, 640) + struct.pack("<HHII", 305, 2, 5, 38) + struct.pack("<I", 8) + b"soft\0"
JPEG = b"\xff\xd8" + b"\xff\xfe\0\x06text" + b"\xff\xc0\0\x0b\x08" + struct.pack(">HHB", 20, 30, 1) + b"\1\x11\0" + b"\xff\xda\0\x03\0" + b"scan\xff\0data" + b"\xff\xd9"
PCAP = b"\xd4\xc3\xb2\xa1" + struct.pack("<HHIIII", 2, 4, 0, 0, 65535, 1) + struct.pack("<IIII", 100, 5, 3, 3) + b"abc"
CASES = {
    "mkv": (MKV, {"/EBML[0]/DocType[0]/value": "matroska", "/Segment[0]/Info[0]/Duration[0]/value": "12.5", "/Segment[0]/Tracks[0]/TrackEntry[0]/TrackNumber[0]/value": "3"}),
    "ogg": (PAGE * 2, {"/page[1]/serial": "7", "/page[0]/lacing_size": "2"}),
    "flac": (FLAC, {"/metadata[0]/sample_rate": "44100", "/metadata[0]/nb_channel": "2", "/metadata[0]/bits_per_sample": "16", "/metadata[0]/total_samples": "999"}),
    "mpeg_audio": (ID3, {"/id3v2/field[0]/content": "title", "/id3v1/song": "song", "/id3v1/genre": "5"}),
    "mp4": (atom(b"ftyp", b"isom" + bytes(4)) + atom(b"moov", atom(b"trak", atom(b"tkhd", b"x"))), {"/atom[0]/brand": "isom", "/atom[1]/atom[0]/atom[0]/tag": "tkhd"}),
    "tiff": (TIFF, {"/ifd[0]/entry[0]/value": "640", "/ifd[0]/entry[1]/value": "soft", "/ifd[0]/entry[0]/tag": "ImageWidth"}),
    "jpeg": (JPEG, {"/comment[0]/text": "text", "/start_frame[0]/width": "30", "/start_frame[0]/height": "20", "/end_image": "ffd9"}),
    "pcap": (PCAP, {"/packet[0]/caplen": "3", "/link_type": "1"}),
    "flv": (b"FLV\x01\x05" + struct.pack(">I", 9) + bytes(4) + bytes([9]) + (3).to_bytes(3, "big") + bytes(7) + b"abc" + struct.pack(">I", 14), {"/chunk[0]/tag": "9", "/chunk[0]/size": "3", "/prev_size[1]": "14"}),
    "elf": (b"\x7fELF\x02\x01\x01" + bytes(9) + struct.pack("<HHIQQQIHHHHHH", 2, 62, 1, 4096, 64, 0, 0, 64, 56, 1, 64, 0, 0) + b"body", {"/header/machine": "62", "/header/entry": "4096"}),
    "exe": (b"MZ" + bytes(26) + bytes(32) + struct.pack("<I", 66) + b"xx" + b"PE\0\0" + struct.pack("<HHIIIHH", 332, 3, 77, 0, 0, 0, 0) + b"rest", {"/pe_header/nb_section": "3", "/pe_header/creation_date": "77"}),
    "java_class": (b"\xca\xfe\xba\xbe" + struct.pack(">HHH", 0, 52, 2) + b"\x01\0\x02hi" + b"tail", {"/major_version": "52", "/constant_pool[1]/bytes": "hi"}),
    "midi": (b"MThd" + struct.pack(">IHHH", 6, 1, 1, 96) + b"MTrk" + struct.pack(">I", 4) + b"\0\xff\x2f\0", {"/nb_track": "1", "/track[0]/size": "4"}),
    "cab": (b"MSCF" + struct.pack("<IIIIIBBHHHHH", 0, 80, 0, 44, 0, 3, 1, 1, 1, 0, 0, 0) + struct.pack("<IHH", 70, 1, 0) + struct.pack("<IIHHHH", 5, 0, 0, 0, 0, 32) + b"a.txt\0data", {"/file[0]/filename": "a.txt", "/file[0]/filesize": "5"}),
    "bzip2": (b"BZh9rest", {"/blocksize": "9"}),
    "ole2": (bytes.fromhex("d0cf11e0a1b11ae1") + bytes(16) + struct.pack("<HH", 62, 3) + b"\xfe\xff" + bytes(200), {"/header/ver_maj": "3"}),
}


@pytest.mark.parametrize("name", CASES)
def test_fields(name):
    data, expected = CASES[name]
    got = {p: v for p, _, _, v in S.parse_one(data, name)}
    assert {k: got.get(k) for k in expected} == expected
    assert "/raw[0]" not in got


@pytest.mark.parametrize("name", S.READERS)
def test_random_and_cut_contents_end(name):
    import random

    rng = random.Random(42)
    for data in [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 7, 64, 500)] + [CASES[name][0][:n] for n in range(0, len(CASES[name][0]), 3) if name in CASES] if name in CASES else []:
        for _, address, size, _ in S.parse_one(data, name):
            assert address >= 0


def comments(*pairs: str) -> bytes:
    body = struct.pack("<I", 4) + b"made" + struct.pack("<I", len(pairs))
    return body + b"".join(struct.pack("<I", len(p.encode())) + p.encode() for p in pairs)


def test_tagged_metadata(spark):
    """Tags of eight containers name the same keys; broken and unknown ones give none."""
    from bitloom.operators.extract import metadata_rows

    def frame(tag, text):
        return tag + (len(text) + 1).to_bytes(4, "big") + b"\0\0\3" + text

    def chunk(tag, body):
        return tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)

    frames = frame(b"TIT2", "Tïtle".encode()) + frame(b"TPE1", b"Someone") + frame(b"TXXX", b"x") + b"COMM" + (9).to_bytes(4, "big") + b"\0\0\3eng\0note"
    mp3 = b"ID3\x03\0\0" + bytes([0, 0, 0, len(frames)]) + frames + b"\xff\xfb\x90\x00" + bytes(60)
    vorbis = comments("title=Tïtle", "ARTIST=Someone", "UNKNOWN=x")
    flac = b"fLaC" + bytes([0x84]) + len(vorbis).to_bytes(3, "big") + vorbis + b"frames"
    body = b"\x03vorbis" + vorbis + b"\1"
    ogg = b"OggS" + struct.pack("<BBqIIIB", 0, 2, 0, 7, 0, 0, 1) + bytes([len(body)]) + body
    info = b"INFO" + chunk(b"INAM", b"Title\0") + chunk(b"ISFT", b"Soft")
    wav = b"RIFF" + struct.pack("<I", 4 + 24 + 8 + len(info)) + b"WAVE" + chunk(b"fmt ", struct.pack("<HHIIHH", 1, 1, 8000, 8000, 1, 8)) + chunk(b"LIST", info)
    item = atom("©nam".encode("latin-1"), atom(b"data", struct.pack(">II", 1, 0) + "Tïtle".encode()))
    mp4 = atom(b"ftyp", b"isom" + bytes(4)) + atom(b"moov", atom(b"udta", atom(b"meta", bytes(4) + atom(b"ilst", item))))
    tag = ebml(b"\x67\xc8", ebml(b"\x45\xa3", b"TITLE") + ebml(b"\x44\x87", "Tïtle".encode()))
    mkv = ebml(b"\x1a\x45\xdf\xa3", ebml(b"\x42\x82", b"matroska")) + ebml(b"\x18\x53\x80\x67", ebml(b"\x12\x54\xc3\x67", ebml(b"\x73\x73", tag)))
    contents = [mp3, flac, ogg, wav, mp4, mkv, TIFF, mp3[:30], flac[:30], b""]
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(contents)] + [(99, None)], "id long, content binary")
    got = {}
    for r in metadata_rows(S.parse(df)).collect():
        got.setdefault(r["id"], {})[r["meta_key"]] = r["value"]
    assert got[0] == {"title": "Tïtle", "author": "Someone", "comment": "note", "bit_rate": "128000", "sample_rate": "44100", "nb_channel": "2"}
    assert got[1] == got[2] == {"title": "Tïtle", "artist": "Someone", "producer": "made"}
    assert got[3]["title"] == "Title" and got[3]["producer"] == "Soft" and got[3]["sample_rate"] == "8000"
    assert got[4] == {"title": "Tïtle"} and got[5] == {"title": "Tïtle"} and got[6]["width"] == "640" and got[6]["producer"] == "soft"
    assert 99 not in got and 9 not in got


def test_riff_keeps_what_it_does_not_know():
    from bitloom.operators.editing import strip_one

    def chunk(tag, body):
        return tag + struct.pack("<I", len(body)) + body

    parts = [chunk(b"fmt ", struct.pack("<HHIIHH", 1, 1, 8000, 8000, 1, 8)), chunk(b"cue ", b"keep"), chunk(b"JUNK", b"away"), chunk(b"LIST", b"INFO" + chunk(b"INAM", b"Name")), chunk(b"data", b"12345678")]
    wav = b"RIFF" + struct.pack("<I", 4 + sum(map(len, parts))) + b"WAVE" + b"".join(parts)
    out, removed = strip_one(wav, "wav")
    assert b"cue " in out and b"12345678" in out and b"away" not in out and b"Name" not in out and removed == (12 + 24) * 8
    assert struct.unpack("<I", out[4:8])[0] == len(out) - 8 and strip_one(out, "wav") == (out, 0)
