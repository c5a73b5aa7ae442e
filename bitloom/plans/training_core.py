"""Queries p1_ and p3_ over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.operators import nested, timestamps
from bitloom.sources import read_table


def _seconds(column: str) -> Column:
    """Seconds since 1970 of a timestamp without zone, in UTC."""
    return F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01'"), F.col(column))


def date_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dated row once: row_id, source_id, volume_id, value, ingest_s, tz_name, date_order, and its UTC second.

    The volumes table is fixed in size (240 rows); whether it is broadcast is left to its measured size.
    """
    items = read_table(spark, sf_dir, "metadata_items").where(F.col("meta_key").isin("creation_date", "last_modification"))
    items = items.select(F.col("item_id").alias("row_id"), "source_id", "volume_id", "value", _seconds("received_at").alias("ingest_s"))
    items = items.groupBy("row_id").agg(F.min(F.struct("ingest_s", "source_id", "volume_id", "value")).alias("m")).select("row_id", "m.source_id", "m.volume_id", "m.value", "m.ingest_s")
    owners = read_table(spark, sf_dir, "sources").groupBy("source_id").agg(F.min("volume_id").alias("volume_id"), F.min(_seconds("ingested_at")).alias("ingest_s"))
    fields = timestamps.msdos_values(read_table(spark, sf_dir, "field_rows")).join(owners, "source_id", "left").select("row_id", "source_id", "volume_id", "value", "ingest_s")
    volumes = read_table(spark, sf_dir, "volumes").select("volume_id", "tz_name", "date_order")
    return timestamps.normalise_timestamps(items.unionByName(fields).join(volumes, "volume_id", "left"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.same_second_pairs(date_events(spark, sf_dir))


def p1_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dated row with its UTC time by its volume's estimated zone, which the written zones have no part in."""
    found = timestamps.by_estimated_zone(date_events(spark, sf_dir), sorted(timestamps.iana_histories()))
    return found.select("row_id", "source_id", "volume_id", "value", "estimated_zone", F.timestamp_add("SECOND", F.col("utc_s"), F.expr("timestamp_ntz'1970-01-01'")).alias("utc_time"))


def p1_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dated row with its UTC time, null where it denotes nothing."""
    return date_events(spark, sf_dir).select("row_id", "source_id", "value", F.timestamp_add("SECOND", F.col("utc_s"), F.expr("timestamp_ntz'1970-01-01'")).alias("utc_time"))


def flat_records(spark: SparkSession, sf_dir: str, keep_body: bool = True) -> DataFrame:
    return nested.flatten(nested.label_nodes(read_table(spark, sf_dir, "container_records"), keep_body=keep_body))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_records(spark, sf_dir, keep_body=False).select("record_id", "path", "parent_path")


def p3_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per schema path: rows, records and the longest label."""
    return flat_records(spark, sf_dir, keep_body=False).groupBy("schema_path").agg(F.count("*").alias("n_rows"), F.countDistinct("record_id").alias("n_records"), F.max_by("label", F.struct(F.length("label"), "label")).alias("longest_label"))


def p3_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat rows of every schema path: each object's own members by their path within it, and the link to its parent."""
    flat = nested.flatten(nested.label_nodes(read_table(spark, sf_dir, "container_records"), keep_body=False, keep_members=True))
    return flat.select("record_id", "schema_path", "label", "parent_label", "ordinal", "path", "parent_path", "members")


def _table(spark: SparkSession, sf_dir: str, name: str, columns: dict[str, str]) -> DataFrame:
    """The rows of one repeating name: ``columns`` (column: member), and all members."""
    rows = p3_rows(spark, sf_dir).where(F.element_at(F.split("schema_path", "/"), -1) == name)
    return rows.select("record_id", "path", "parent_path", *[F.col("members")[m].alias(c) for c, m in columns.items()], "members")


def p3_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "page", {x: x for x in ("capture_pattern", "serial", "page_no", "lacing_size", "abs_granule_pos", "first_page", "last_page", "lacing")})


def p3_descr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "descr", {"tag": "tag", "size_of_instance": "sizeOfInstance", "es_id": "ES_ID", "url": "URL", "data": "data"})


def p3_track_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.table_of(
        flat_records(spark, sf_dir),
        "TrackEntry",
        {"track_number": "$.TrackNumber.unsigned", "track_uid": "$.TrackUID.unsigned", "track_type": "$.TrackType.enum", "language": "$.Language.string", "codec": "$.CodecID.string", "name": "$.Name.unicode"},
    )


QUERIES = {
    "p1_found": p1_found, "p1_method": p1_method, "p1_normalised": p1_normalised,
    "p3_found": p3_found, "p3_tables": p3_tables, "p3_track_entries": p3_track_entries,
    "p3_rows": p3_rows, "p3_page": p3_page, "p3_descr": p3_descr,
}

SQL: dict[str, str] = {}
