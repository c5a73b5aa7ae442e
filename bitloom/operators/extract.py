"""Metadata taken from field rows: which field of which format gives which key, and what follows from several of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Format, path (a regular expression), key.
RULES = [
    ("png", r"^/header/width$", "width"), ("png", r"^/header/height$", "height"), ("png", r"^/header/bits$", "bits_per_pixel"), ("png", r"^/text\[\d+\]/text$", "comment"),
    ("bmp", r"^/header/width$", "width"), ("bmp", r"^/header/height$", "height"), ("bmp", r"^/header/bpp$", "bits_per_pixel"), ("gif", r"^/screen/width$", "width"), ("gif", r"^/screen/height$", "height"),
    ("jpeg", r"^/start_frame\[\d+\]/width$", "width"), ("jpeg", r"^/start_frame\[\d+\]/height$", "height"), ("jpeg", r"^/comment\[\d+\]/text$", "comment"),
    ("wav", r"^/format/nb_channel$", "nb_channel"), ("wav", r"^/format/sample_per_sec$", "sample_rate"), ("wav", r"^/format/bit_per_sample$", "bits_per_sample"), ("wav", r"^/format/byte_per_sec$", "byte_rate"), ("wav", r"^/audio_data/size$", "data_size"),
    ("au", r"^/sample_rate$", "sample_rate"), ("au", r"^/channels$", "nb_channel"), ("au", r"^/info$", "comment"), ("flac", r"^/metadata\[0\]/sample_rate$", "sample_rate"), ("flac", r"^/metadata\[0\]/nb_channel$", "nb_channel"), ("flac", r"^/metadata\[0\]/bits_per_sample$", "bits_per_sample"),
    ("mpeg_audio", r"^/id3v1/song$", "title"), ("mpeg_audio", r"^/id3v1/author$", "author"), ("mpeg_audio", r"^/id3v1/album$", "album"), ("mpeg_audio", r"^/id3v1/comment$", "comment"),
    ("gzip", r"^/filename$", "filename"), ("gzip", r"^/size$", "file_size"), ("gzip", r"^/comment$", "comment"), ("tar", r"^/file\[\d+\]/name$", "filename"), ("tar", r"^/file\[\d+\]/size$", "file_size"),
    ("zip", r"^/file\[\d+\]/filename$", "filename"), ("zip", r"^/file\[\d+\]/uncompressed_size$", "file_size"), ("zip", r"^/file\[\d+\]/compressed_size$", "compressed_size"), ("cab", r"^/file\[\d+\]/filename$", "filename"), ("cab", r"^/file\[\d+\]/filesize$", "file_size"),
    ("mkv", r"^/Segment\[\d+\]/Info\[\d+\]/Title\[\d+\]/value$", "title"), ("mkv", r"^/Segment\[\d+\]/Info\[\d+\]/MuxingApp\[\d+\]/value$", "producer"), ("mkv", r"/Video\[\d+\]/PixelWidth\[\d+\]/value$", "width"), ("mkv", r"/Video\[\d+\]/PixelHeight\[\d+\]/value$", "height"), ("mkv", r"/Audio\[\d+\]/SamplingFrequency\[\d+\]/value$", "sample_rate"),
    ("mpeg_audio", r"^/frames/frame\[0\]/bit_rate$", "bit_rate"), ("mpeg_audio", r"^/frames/frame\[0\]/sampling_rate$", "sample_rate"), ("mpeg_audio", r"^/frames/frame\[0\]/nb_channel$", "nb_channel"),
    ("ogg", r"^/page\[\d+\]/vorbis_hdr/audio_sample_rate$", "sample_rate"), ("ogg", r"^/page\[\d+\]/vorbis_hdr/audio_channels$", "nb_channel"), ("ogg", r"/vendor$", "producer"), ("flac", r"/vendor$", "producer"),
    ("midi", r"^/nb_track$", "nb_track"), ("exe", r"^/pe_header/creation_date$", "creation_date"),
]


# Format, names of tags, key.
TAGS = [
    ("mpeg_audio", "TIT2 TT2", "title"), ("mpeg_audio", "TPE1 TP1", "author"), ("mpeg_audio", "TALB TAL", "album"), ("mpeg_audio", "TCOM TCM", "music_composer"), ("mpeg_audio", "TCON TCO", "music_genre"),
    ("mpeg_audio", "TRCK TRK", "track_number"), ("mpeg_audio", "TYER TYE TDRC TDRL", "creation_date"), ("mpeg_audio", "TCOP TCR", "copyright"), ("mpeg_audio", "TENC TEN TSSE", "producer"), ("mpeg_audio", "TPUB", "organization"),
    ("mpeg_audio", "TLAN", "language"), ("mpeg_audio", "COMM COM", "comment"),
    ("flac ogg", "TITLE", "title"), ("flac ogg", "ARTIST", "artist"), ("flac ogg", "ALBUM", "album"), ("flac ogg", "TRACKNUMBER", "track_number"), ("flac ogg", "TRACKTOTAL", "track_total"), ("flac ogg", "ENCODER ENCODED-BY", "producer"),
    ("flac ogg", "DATE", "creation_date"), ("flac ogg", "GENRE", "music_genre"), ("flac ogg", "COMMENT DESCRIPTION", "comment"), ("flac ogg", "COPYRIGHT LICENSE", "copyright"), ("flac ogg", "ORGANIZATION", "organization"), ("flac ogg", "LOCATION", "location"),
    ("wav avi", "INAM", "title"), ("wav avi", "IART", "artist"), ("wav avi", "ICMT", "comment"), ("wav avi", "ICOP", "copyright"), ("wav avi", "IENG", "author"), ("wav avi", "ISFT", "producer"), ("wav avi", "ICRD IDIT", "creation_date"), ("wav avi", "IGNR", "music_genre"),
    ("mp4", "\u00a9nam", "title"), ("mp4", "\u00a9ART", "artist"), ("mp4", "\u00a9alb", "album"), ("mp4", "\u00a9day", "creation_date"), ("mp4", "\u00a9too", "producer"), ("mp4", "\u00a9cmt", "comment"), ("mp4", "\u00a9wrt", "music_composer"), ("mp4", "\u00a9gen", "music_genre"), ("mp4", "cprt", "copyright"),
    ("tiff tiff_be", "ImageWidth", "width"), ("tiff tiff_be", "ImageLength", "height"), ("tiff tiff_be", "BitsPerSample", "bits_per_pixel"), ("tiff tiff_be", "Make", "camera_manufacturer"), ("tiff tiff_be", "Model", "camera_model"),
    ("tiff tiff_be", "Software", "producer"), ("tiff tiff_be", "DateTime", "creation_date"), ("tiff tiff_be", "Artist", "author"), ("tiff tiff_be", "ImageDescription", "comment"), ("tiff tiff_be", "Orientation", "image_orientation"), ("tiff tiff_be", "Compression", "compression"),
    ("mkv", "TITLE", "title"), ("mkv", "ARTIST", "artist"), ("mkv", "ENCODER", "producer"), ("mkv", "COPYRIGHT", "copyright"), ("mkv", "COMMENT", "comment"), ("mkv", "DATE_RELEASED DATE_RECORDED", "creation_date"), ("mkv", "GENRE", "music_genre"), ("mkv", "URL", "url"),
]


def tagged_rows(fields: DataFrame) -> DataFrame:
    """(id, format, group_name, meta_key, ord, value) of values that stand beside the tag that names them, by the tags' names.

    A tag and its value meet in one aggregation by their field set; tags without a key, and null and empty values, give none.
    """
    keys = [x for formats, tags, k in TAGS for f in formats.split() for t in tags.split() for x in (f"{f} {t}", k)]
    name, place = F.element_at(F.split("path", "/"), -1), F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    name = F.when(F.col("format") == "mkv", F.when(name == "value", F.regexp_extract("path", r"/(TagName|TagString)\[0\]/value$", 1))).otherwise(name)
    place = F.when(F.col("format") == "mkv", F.regexp_replace("path", r"/(TagName|TagString)\[0\]/value$", "")).otherwise(place)
    rows = fields.where(F.col("format").isin(*{f for formats, *_ in TAGS for f in formats.split()})).select("id", "format", "address_bits", "value", name.alias("name"), place.alias("place"))
    rows = rows.where(F.col("name").isin("tag", "content", "value", "TagName", "TagString"))
    one = rows.groupBy("id", "format", "place").agg(F.max(F.when(F.col("name").isin("tag", "TagName"), F.col("value"))).alias("tag"), F.max(F.when(F.col("name").isin("content", "value", "TagString"), F.struct("value", "address_bits"))).alias("v"))
    key = F.element_at(F.create_map(*map(F.lit, keys)), F.concat_ws(" ", "format", "tag"))
    return one.select("id", "format", F.lit("Common").alias("group_name"), key.alias("meta_key"), F.col("v.address_bits").alias("ord"), F.col("v.value").alias("value")).where("meta_key is not null and value <> ''")


def metadata_rows(fields: DataFrame) -> DataFrame:
    """(id, format, group_name, meta_key, ord, value) from field rows, by path and by tag; archive members are groups of their own.

    Rules are expressions over the field rows, so nothing is read again; null and empty values give none.
    """
    return path_rows(fields).unionByName(tagged_rows(fields))


def path_rows(fields: DataFrame) -> DataFrame:
    """:func:`metadata_rows` by :data:`RULES`."""
    key = F.lit(None).cast("string")
    for name, path, k in reversed(RULES):
        key = F.when((F.col("format") == name) & F.col("path").rlike(path), k).otherwise(key)
    member = F.regexp_extract("path", r"^/(file\[\d+\])/", 1)
    rows = fields.withColumn("meta_key", key).where("meta_key is not null and value is not null and value <> ''")
    return rows.select("id", "format", F.when(member != "", member).otherwise("Common").alias("group_name"), "meta_key", F.col("address_bits").alias("ord"), "value")


def derived(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(id, duration_s, bit_rate, compression_rate) from metadata rows and (id, size): what several values tell together."""
    number = lambda k: F.max(F.when(F.col("meta_key") == k, F.col("value").try_cast("double"))).alias(k)
    keys = ("width", "height", "bits_per_pixel", "nb_channel", "sample_rate", "bits_per_sample", "byte_rate", "data_size")
    total = F.sum(F.when(F.col("meta_key") == "file_size", F.col("value").try_cast("double"))).alias("unpacked")
    one = rows.where("group_name = 'Common' or meta_key = 'file_size'").groupBy("id").agg(*map(number, keys), total).join(sizes, "id")
    pixels = F.col("width") * F.col("height") * F.coalesce("bits_per_pixel", F.lit(24.0)) / 8
    return one.select(
        "id", F.try_divide("data_size", "byte_rate").alias("duration_s"), (F.col("nb_channel") * F.col("sample_rate") * F.col("bits_per_sample")).alias("bit_rate"),
        F.try_divide(F.coalesce("unpacked", pixels), "size").alias("compression_rate"),
    )
