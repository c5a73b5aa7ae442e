"""The registry of metadata keys: rank, label, kind of value and the range that a value must lie in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Key, priority, label, kind, least, most. In order of registration, which settles ties of priority.
REGISTRY = [
    ("title", 100, "Title", "text", None, None), ("artist", 101, "Artist", "text", None, None), ("author", 102, "Author", "text", None, None), ("music_composer", 103, "Music composer", "text", None, None),
    ("album", 200, "Album", "text", None, None), ("duration", 201, "Duration", "duration", None, None), ("nb_page", 202, "Nb page", "any", 1, 20000), ("music_genre", 203, "Music genre", "text", None, None),
    ("language", 204, "Language", "language", None, None), ("track_number", 205, "Track number", "integer", 1, 999), ("track_total", 206, "Track total", "integer", 1, 999),
    ("organization", 210, "Organization", "text", None, None), ("version", 220, "Version", "any", None, None), ("width", 301, "Image width", "integer", 1, 20000), ("height", 302, "Image height", "integer", 1, 20000),
    ("nb_channel", 303, "Channel", "integer", 1, 8), ("sample_rate", 304, "Sample rate", "number", 1000, 192000), ("bits_per_sample", 305, "Bits/sample", "integer", 1, 64),
    ("image_orientation", 306, "Image orientation", "any", None, None), ("nb_colors", 307, "Number of colors", "integer", 1, 16777216), ("bits_per_pixel", 308, "Bits/pixel", "integer", 1, 256),
    ("filename", 309, "File name", "text", None, None), ("file_size", 310, "File size", "integer", None, None), ("pixel_format", 311, "Pixel format", "any", None, None), ("compr_size", 312, "Compressed file size", "integer", None, None),
    ("compr_rate", 313, "Compression rate", "number", 0.001, 1000), ("width_dpi", 320, "Image DPI width", "integer", 1, 10000), ("height_dpi", 321, "Image DPI height", "integer", 1, 10000),
    ("file_attr", 400, "File attributes", "any", None, None), ("file_type", 401, "File type", "any", None, None), ("subtitle_author", 402, "Subtitle author", "text", None, None),
    ("creation_date", 500, "Creation date", "date", None, None), ("last_modification", 501, "Last modification", "date", None, None), ("latitude", 510, "Latitude", "float", None, None),
    ("longitude", 511, "Longitude", "float", None, None), ("altitude", 512, "Altitude", "float", None, None), ("location", 530, "Location", "text", None, None), ("city", 531, "City", "text", None, None),
    ("country", 532, "Country", "text", None, None), ("charset", 540, "Charset", "text", None, None), ("font_weight", 550, "Font weight", "any", None, None), ("camera_aperture", 520, "Camera aperture", "any", None, None),
    ("camera_focal", 521, "Camera focal", "any", None, None), ("camera_exposure", 522, "Camera exposure", "any", None, None), ("camera_brightness", 530, "Camera brightness", "any", None, None),
    ("camera_model", 531, "Camera model", "text", None, None), ("camera_manufacturer", 532, "Camera manufacturer", "text", None, None), ("compression", 600, "Compression", "any", None, None),
    ("copyright", 601, "Copyright", "text", None, None), ("url", 602, "URL", "text", None, None), ("frame_rate", 603, "Frame rate", "number", 1, 150), ("bit_rate", 604, "Bit rate", "number", 1, 524288000),
    ("aspect_ratio", 604, "Aspect ratio", "number", None, None), ("thumbnail_size", 604, "Thumbnail size", "number", None, None), ("iso_speed_ratings", 800, "ISO speed rating", "any", None, None),
    ("exif_version", 801, "EXIF version", "any", None, None), ("date_time_original", 802, "Date-time original", "date", None, None), ("date_time_digitized", 803, "Date-time digitized", "date", None, None),
    ("compressed_bits_per_pixel", 804, "Compressed bits per pixel", "number", None, None), ("shutter_speed_value", 805, "Shutter speed", "number", None, None), ("aperture_value", 806, "Aperture", "any", None, None),
    ("exposure_bias_value", 807, "Exposure bias", "any", None, None), ("focal_length", 808, "Focal length", "any", None, None), ("flashpix_version", 809, "Flashpix version", "any", None, None),
    ("focal_plane_x_resolution", 810, "Focal plane width", "any", None, None), ("focal_plane_y_resolution", 811, "Focal plane height", "float", None, None), ("focal_length_in_35mm_film", 812, "Focal length in 35mm film", "any", None, None),
    ("os", 900, "OS", "text", None, None), ("producer", 901, "Producer", "text", None, None), ("comment", 902, "Comment", "text", None, None), ("format_version", 950, "Format version", "text", None, None),
    ("mime_type", 951, "MIME type", "text", None, None), ("endian", 952, "Endianness", "text", None, None),
]
NUMERIC = ("integer", "number", "float")


def registry(spark: SparkSession) -> DataFrame:
    """The dimension of keys with the order of registration."""
    rows = [(i, k, p, label, kind, None if a is None else float(a), None if b is None else float(b)) for i, (k, p, label, kind, a, b) in enumerate(REGISTRY)]
    return spark.createDataFrame(rows, "registered int, meta_key string, priority int, label string, kind string, least double, most double")


def _map(values: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def label(key: Column) -> Column:
    """The label of a key, the key itself if it isn't registered."""
    return F.coalesce(_map({k: t for k, _, t, *_ in REGISTRY}, key), key)


def accepted(key: Column, value: Column) -> Column:
    """Whether a value is of its key's kind and in its range; keys that aren't registered accept nothing, null is never accepted."""
    kind = _map({k: kind for k, _, _, kind, _, _ in REGISTRY}, key)
    number = value.try_cast("double")
    least = _map({k: float(a) for k, *_, a, b in REGISTRY if a is not None}, key)
    most = _map({k: float(b) for k, *_, a, b in REGISTRY if b is not None}, key)
    whole = (kind != "integer") | (number == F.floor(number))
    fits = (least.isNull() | (number >= least)) & (most.isNull() | (number <= most))
    numeric = kind.isin(*NUMERIC) | least.isNotNull()
    return F.coalesce(kind.isNotNull() & value.isNotNull() & F.when(numeric, number.isNotNull() & whole & fits).otherwise(True), F.lit(False))
