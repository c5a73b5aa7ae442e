"""Queries of the field, metadata, search and function operators over the test tables, each with its SQL."""

from __future__ import annotations

import gzip
import io
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bitloom.functions import bits, epochs, human, strings, text
from bitloom.operators import bytestats, detect, fields, metadata
from bitloom.operators.registry import REGISTRY
from bitloom.sources import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

LINES_SQL = """
lines as (select doc_id, unnest(string_split(text, chr(10))) as value, generate_subscripts(string_split(text, chr(10)), 1) - 1 as ordinal from documents where text is not null),
sized as (select *, strlen(value) + (case when ordinal < max(ordinal) over (partition by doc_id) then 1 else 0 end) as size from lines),
addressed as (select doc_id, ordinal, '/line[' || ordinal || ']' as path, cast(coalesce(sum(size) over (partition by doc_id order by ordinal rows between unbounded preceding and 1 preceding), 0) as bigint) as address, cast(size as bigint) as size, value from sized)
"""
ITEMS_SQL = "items as (select distinct item_id, source_id, meta_class, group_name, meta_key, ord, priority, value from metadata_items)"
FIELDS_SQL = "f as (select distinct field_id, source_id, path, parent_path, ordinal, field_type, address_bits, size_bits, value, display, description from field_rows)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _lines(s, d, having=None):
    """Lines of the documents, of those whose text has ``having`` (in lower case) if given."""
    rows = read_table(s, d, "documents").select("doc_id", "text")
    return fields.lines(rows if having is None else rows.where(F.lower("text").contains(having)))


def _fields(s, d):
    return read_table(s, d, "field_rows").drop("child_names").distinct()


# -- field table


@query(f"with {LINES_SQL} select doc_id, path, address, value from addressed where lower(value) like '%claim%'")
def grep_lines(s, d):
    return fields.grep(_lines(s, d, "claim"), "claim").select("doc_id", "path", "address", "value")


@query(f"with {LINES_SQL} select doc_id || ':' || address || ':' || path || ':' || value as line from addressed where contains(value, 'CLAIMS')")
def grep_output(s, d):
    return fields.grep(_lines(s, d, "claims"), "CLAIMS", case=True).select(F.concat_ws(":", "doc_id", "address", "path", "value").alias("line"))


@query(f"with {ITEMS_SQL} select item_id, meta_key, value from items where contains(lower(value), 'wind')")
def grep_case_insensitive(s, d):
    return fields.grep(read_table(s, d, "metadata_items"), "Wind").select("item_id", "meta_key", "value").distinct()


@query(f"with {ITEMS_SQL} select meta_class, count(*) as n from items where value is not null and value <> '' group by 1")
def grep_all(s, d):
    rows = read_table(s, d, "metadata_items").select("item_id", "meta_class", "value").dropDuplicates(["item_id"])
    return fields.grep(rows, None).groupBy("meta_class").agg(F.count("*").alias("n"))


@query(f"with {FIELDS_SQL} select source_id, ordinal, repeat(' ', 2 * (len(string_split(path, '/')) - 2)) || string_split(path, '/')[-1] || ': ' || coalesce(display, value, '') || ' (' || case when size_bits % 8 = 0 then (size_bits // 8) || 'B' else size_bits || 'b' end || ')' as line from f")
def list_tree(s, d):
    depth = F.size(F.split("path", "/")) - 2
    size = F.when(F.col("size_bits") % 8 == 0, F.concat(F.expr("size_bits div 8"), F.lit("B"))).otherwise(F.concat("size_bits", F.lit("b")))
    name = F.element_at(F.split("path", "/"), -1)
    return _fields(s, d).select("source_id", "ordinal", F.concat(F.repeat(F.lit(" "), 2 * depth), name, F.lit(": "), F.coalesce("display", "value", F.lit("")), F.lit(" ("), size, F.lit(")")).alias("line"))


@query(f"with {FIELDS_SQL} select source_id, value, display from f where path = '/header/width'")
def field_path_lookup(s, d):
    return fields.by_path(_fields(s, d), "/header/game_title/../width").select("source_id", "value", "display")


@query("select event_id, cast(json_extract_string(props, '$.k') as int) as k from events where json_extract_string(props, '$.k') is not null")
def json_path_lookup(s, d):
    return read_table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")).where("k is not null")


@query(f"with {FIELDS_SQL} select source_id, path, regexp_replace(string_split(path, '/')[-1], '\\[[0-9]+\\]$', '') as base, row_number() over (partition by source_id, parent_path, regexp_replace(string_split(path, '/')[-1], '\\[[0-9]+\\]$', '') order by ordinal) - 1 as idx from f")
def array_index_names(s, d):
    return fields.numbered(_fields(s, d), ["source_id", "parent_path"], fields.base_name(F.col("path")), "ordinal").select("source_id", "path", "base", F.col("idx").cast("bigint").alias("idx"))


@query(f"with {FIELDS_SQL} select source_id, parent_path, cast(sum(size_bits) as bigint) as bits, count(*) as n_fields from f group by 1, 2")
def field_sizes_by_parent(s, d):
    return _fields(s, d).groupBy("source_id", "parent_path").agg(F.sum("size_bits").alias("bits"), F.count("*").alias("n_fields"))


@query(f"""with {FIELDS_SQL}, p as (select distinct source_id, address_bits + 3 as probe_bits from f where field_type in ('CString', 'String')),
hits as (select p.source_id, probe_bits, path, row_number() over (partition by p.source_id, probe_bits order by size_bits, -address_bits, path) as rn from p join f on f.source_id = p.source_id and size_bits > 0 and probe_bits >= address_bits and probe_bits < address_bits + size_bits)
select p.source_id, p.probe_bits, h.path from p left join hits h on h.source_id = p.source_id and h.probe_bits = p.probe_bits and rn = 1""")
def asof_field_by_address(s, d):
    f = _fields(s, d)
    probes = f.where("field_type in ('CString', 'String')").select("source_id", (F.col("address_bits") + 3).alias("probe_bits")).distinct()
    return fields.containing(probes, f)


@query(f"with {FIELDS_SQL} select c.source_id, c.path, p.field_type as parent_type from f c join f p on p.source_id = c.source_id and p.path = c.parent_path")
def link_self_join(s, d):
    f = _fields(s, d)
    parent = f.select("source_id", F.col("path").alias("parent_path"), F.col("field_type").alias("parent_type"))
    return f.join(parent, ["source_id", "parent_path"]).select("source_id", "path", "parent_type")


@query(f"""with recursive {FIELDS_SQL}, walk as (select source_id, path, 1 as depth from f where parent_path = '/' union all select f.source_id, f.path, depth + 1 from f join walk on walk.source_id = f.source_id and f.parent_path = walk.path)
select source_id, path, depth from walk""")
def chain_traversal(s, d):
    return fields.depths(_fields(s, d), ["source_id"], "path", "parent_path")


@query("select distinct source_id from sources where source_id not in (select source_id from field_rows) and source_id in (select source_id from metadata_items where meta_key = 'title')")
def anti_semi_fields(s, d):
    titles = read_table(s, d, "metadata_items").where("meta_key = 'title'")
    return read_table(s, d, "sources").select("source_id").distinct().join(read_table(s, d, "field_rows"), "source_id", "left_anti").join(titles, "source_id", "left_semi")


@query(f"""with {FIELDS_SQL}, ends as (select source_id, min(filesize) * 8 as stop from sources group by 1),
b as (select f.source_id, address_bits as a, size_bits as n, 0 as last from f join ends on ends.source_id = f.source_id where parent_path = '/' and address_bits is not null and size_bits is not null union all select source_id, stop, 0, 1 from ends),
r as (select source_id, a, greatest(coalesce(max(a + n) over (partition by source_id order by last, a, n rows between unbounded preceding and 1 preceding), 0), 0) as reach from b)
select source_id, cast(reach as bigint) as gap_start, cast(a - reach as bigint) as gap_size from r where a > reach""")
def gap_finder(s, d):
    whole = read_table(s, d, "sources").groupBy("source_id").agg((F.min("filesize") * 8).alias("length")).withColumn("start", F.lit(0))
    return fields.gaps(_fields(s, d).where("parent_path = '/'"), "source_id", "address_bits", "size_bits", whole)


@query(f"with {ITEMS_SQL} select source_id, meta_key, string_agg(value, '|' order by ord, item_id) as joined, count(*) as n_parts from items where meta_key = 'creation_date' and value is not null group by 1, 2")
def fragment_reassemble(s, d):
    rows = read_table(s, d, "metadata_items").where("meta_key = 'creation_date' and value is not null").dropDuplicates(["item_id"])
    return fields.join_ordered(rows.withColumn("place", F.struct("ord", "item_id")), ["source_id", "meta_key"], "place", "value", "|")


@query(f"""with {LINES_SQL}, kept as (select doc_id, cast(ordinal as double) as place, case when ordinal = 1 then '> ' || value else value end as value from addressed where ordinal <> 0),
both_ as (select * from kept union all select doc_id, 1.5, 'inserted' from addressed where ordinal = 1), r as (select doc_id, row_number() over (partition by doc_id order by place) - 1 as ordinal, value from both_)
select doc_id, cast(ordinal as int) as ordinal, cast(coalesce(sum(strlen(value) + 1) over (partition by doc_id order by ordinal rows between unbounded preceding and 1 preceding), 0) as bigint) as address, value from r""")
def edit_overlay(s, d):
    base = _lines(s, d).select("doc_id", "ordinal", "value")
    second = base.where("ordinal = 1")
    return fields.overlay(base, second.withColumn("value", F.concat(F.lit("> "), "value")), base.where("ordinal = 0"), second.withColumn("value", F.lit("inserted")), ["doc_id"])


@query(f"with {FIELDS_SQL} select source_id, cast(sum(size_bits) as bigint) as bits, cast(sum(case when path like '/file%/timestamp%' and field_type = 'DateTimeMSDOS32' then size_bits else 0 end) as bigint) as removed_bits from f where field_type in ('CString', 'String', 'UInt8', 'UInt32', 'DateTimeMSDOS32') group by 1")
def strip_fields(s, d):
    leaf = _fields(s, d).where(F.col("field_type").isin("CString", "String", "UInt8", "UInt32", "DateTimeMSDOS32"))
    stripped = F.col("path").rlike(r"^/file.*/timestamp") & (F.col("field_type") == "DateTimeMSDOS32")
    return leaf.groupBy("source_id").agg(F.sum("size_bits").alias("bits"), F.sum(F.when(stripped, F.col("size_bits")).otherwise(0)).alias("removed_bits"))


# -- detection, search, bytes


@query("select distinct source_id, filename, case regexp_extract(lower(filename), '(\\.[^./]+)$', 1) when '.mp3' then 'mpeg_audio' when '.tif' then 'tiff' when '.tiff' then 'tiff' when '.cab' then 'cab' when '.nds' then 'nds' when '.mkv' then 'mkv' when '.ogg' then 'ogg' when '.png' then 'png' when '.tar' then 'tar' when '.gz' then 'gzip' when '.mp4' then 'mp4' when '.asf' then 'asf' when '.wma' then 'asf' when '.zip' then 'zip' end as guess from sources")
def detect_by_extension(s, d):
    return detect.by_extension(read_table(s, d, "sources").select("source_id", "filename").distinct())


_MAGIC = [f for f in detect.FORMATS if f[4]]


@query(f"select distinct source_id, case source_id % {len(_MAGIC)} {' '.join(f'when {i} then {chr(39)}{f[0]}{chr(39)}' for i, f in enumerate(_MAGIC))} end as guess from sources")
def detect_by_magic(s, d):
    """Contents that begin with each format's magic number at its place."""
    heads = F.array(*[F.lit("2e" * f[5] + f[4]) for f in _MAGIC])
    content = F.unhex(F.concat(F.element_at(heads, (F.col("source_id") % len(_MAGIC) + 1).cast("int")), F.lit("2e2e2e")))
    return read_table(s, d, "sources").select("source_id").distinct().select("source_id", detect.magic_format(content).alias("guess"))


@query("select byte, count(*) as n from (select ('0x' || substr(h, i, 2))::int as byte from (select hex(encode(coalesce(value, ''))) as h from metadata_items) t, lateral (select unnest(generate_series(1, length(h) - 1, 2)) as i) u) group by 1")
def byte_histogram(s, d):
    return bytestats.histogram(read_table(s, d, "metadata_items").select(F.coalesce("value", F.lit("")).alias("value")), [], F.encode("value", "UTF-8"))


@query("""with b as (select record_id, unnest(regexp_extract_all(hex(encode(body)), '..')) as h from (select distinct record_id, body from container_records where body <> '') x), c as (select record_id, h, count(*) as n from b group by 1, 2)
select record_id, cast(sum(n) as bigint) as n_bytes, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) as entropy from c group by 1""")
def shannon_entropy(s, d):
    rows = read_table(s, d, "container_records").where("body <> ''").select("record_id", "body").distinct()
    return bytestats.entropy(bytestats.histogram(rows, ["record_id"], F.encode("body", "UTF-8")), ["record_id"])


@query("select doc_id, md5(text) as md5, sha256(text) as sha256 from documents")
def digests(s, d):
    return read_table(s, d, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))


@query()
def crc32_checksum(s, d):
    return read_table(s, d, "documents").select("doc_id", F.crc32("text").alias("crc32"))


@query("select doc_id, cast(list_sum([('0x' || x)::int for x in regexp_extract_all(substr(hex(encode(text)), 1, 1024), '..')]) as bigint) as byte_sum from documents")
def tar_checksum_bytes(s, d):
    return read_table(s, d, "documents").select("doc_id", bytestats.byte_sum(F.substring(F.encode("text", "UTF-8"), 1, 512)).alias("byte_sum"))


@query("select doc_id, 'numeral' as pattern, len(regexp_extract_all(text, '\\([0-9]+\\)')) as hits from documents union all select doc_id, 'paragraph' as pattern, len(regexp_extract_all(text, '\\[[0-9]{4}\\]')) as hits from documents union all select doc_id, 'unit', len(regexp_extract_all(text, '[0-9.]+ mm')) from documents")
def carve_patterns(s, d):
    return bytestats.carve(read_table(s, d, "documents"), ["doc_id"], F.col("text"), {"numeral": r"\([0-9]+\)", "paragraph": r"\[[0-9]{4}\]", "unit": r"[0-9.]+ mm"}).withColumn("hits", F.col("hits").cast("bigint"))


@query("select pattern, cast(sum(hits) as bigint) as hits, count(*) filter (hits > 0) as valid from (select 'numeral' as pattern, len(regexp_extract_all(text, '\\([0-9]+\\)')) as hits from documents union all select 'unit', len(regexp_extract_all(text, '[0-9.]+ mm')) from documents) t group by 1")
def carve_stats(s, d):
    hits = bytestats.carve(read_table(s, d, "documents"), ["doc_id"], F.col("text"), {"numeral": r"\([0-9]+\)", "unit": r"[0-9.]+ mm"})
    return hits.groupBy("pattern").agg(F.sum("hits").alias("hits"), F.count_if(F.col("hits") > 0).alias("valid"))


@query("select 'gif' as format, 2 * count(distinct source_id) as hits, 2 * count(distinct source_id) as valid from sources union all select 'wav', count(distinct source_id), count(distinct source_id) from sources")
def carved_file_stats(s, d):
    from bitloom.operators import carving

    return carving.statistics(carving.carve_files(_mixed_images(s, d).select("id", F.concat("gif", "wav", "gif").alias("content"))))


@query("select doc_id, i // 1024 as slice_no, length(substr(text, i + 1, 1024 + 16)) as n from (select doc_id, text, unnest(generate_series(0, greatest(length(text) - 1, 0), 1024)) as i from documents)")
def carve_slices(s, d):
    parts = bytestats.slices(read_table(s, d, "documents"), ["doc_id"], F.col("text"), 1024, 16)
    return parts.select("doc_id", F.col("slice_no").cast("bigint").alias("slice_no"), F.length("part").cast("bigint").alias("n"))


@query("select doc_id, case when contains(text, 'mm') then strlen(split_part(text, 'mm', 1)) else -1 end as address from documents")
def find_bytes(s, d):
    return read_table(s, d, "documents").select("doc_id", F.coalesce(bits.find_bytes(F.encode("text", "UTF-8"), b"mm"), F.lit(-1)).cast("bigint").alias("address"))


@query("select doc_id, lower(substr(hex(encode(text)), 21, 64)) as part from documents")
def sub_range_scan(s, d):
    return read_table(s, d, "documents").select("doc_id", F.lower(F.hex(bits.read_bytes(F.encode("text", "UTF-8"), 10, 32))).alias("part"))


@query("select doc_id, regexp_extract(text, '(ABSTRACT|RIASSUNTO|RESUMEN|DESCRIPTION|Fe2O3|claim [0-9]+)', 1) as first_match, len(regexp_extract_all(text, '(ABSTRACT|RIASSUNTO|RESUMEN|DESCRIPTION|Fe2O3|claim [0-9]+)')) as n from documents")
def regex_union(s, d):
    from bitloom.functions.regexalg import parse, union

    pattern = union([parse(p) for p in ("ABSTRACT", "RIASSUNTO", "RESUMEN", "DESCRIPTION", "Fe2O3", "claim [0-9]+")]).text()
    return read_table(s, d, "documents").select("doc_id", F.regexp_extract("text", f"({pattern})", 1).alias("first_match"), F.regexp_count("text", F.lit(pattern)).cast("bigint").alias("n"))


# -- aggregates and windows


@query("select l_returnflag, min(l_quantity) as least, max(l_quantity) as most, cast(sum(l_quantity) as bigint) as total, round(avg(l_quantity), 6) as mean, count(*) as n from lineitem group by 1")
def benchmark_stat(s, d):
    q = F.col("l_quantity")
    return read_table(s, d, "lineitem").groupBy("l_returnflag").agg(F.min(q).alias("least"), F.max(q).alias("most"), F.sum(q).cast("bigint").alias("total"), F.round(F.avg(q), 6).alias("mean"), F.count("*").alias("n"))


@query("select user_id, round(avg(value), 6) as mean from (select user_id, value, row_number() over (partition by user_id order by ts, event_id) as i from events) where i > 3 and i <= 253 group by 1")
def vbr_mean(s, d):
    i = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return read_table(s, d, "events").withColumn("i", i).where("i > 3 and i <= 253").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean"))


@query("with t(quality, least) as (values (1, 500), (2, 300), (3, 200), (4, 100), (5, 0)), s as (select l_suppkey, cast(sum(l_quantity) as bigint) as total from lineitem group by 1) select l_suppkey, total, min(quality) as quality from s join t on total >= least * 10 group by 1, 2")
def threshold_lookup(s, d):
    total = F.col("total")
    quality = F.when(total >= 5000, 1).when(total >= 3000, 2).when(total >= 2000, 3).when(total >= 1000, 4).otherwise(5)
    return read_table(s, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").cast("bigint").alias("total")).withColumn("quality", quality)


@query("""with r as (select user_id, event_id, ts, value / nullif(epoch(ts) - epoch(lag(ts) over w), 0) as rate from events window w as (partition by user_id order by ts, event_id))
select user_id, event_id, case when count(rate) over v >= 3 then round(avg(rate) over v, 6) end as mean_rate from r window v as (partition by user_id order by ts, event_id rows between 19 preceding and current row)""")
def data_rate_moving_avg(s, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    r = read_table(s, d, "events").withColumn("at", at).withColumn("rate", F.col("value") / F.nullif(F.col("at") - F.lag("at").over(w), F.lit(0.0)))
    v = w.rowsBetween(-19, 0)
    return r.select("user_id", "event_id", F.when(F.count("rate").over(v) >= 3, F.round(F.avg("rate").over(v), 6)).alias("mean_rate"))


@query("select event_id, user_id, epoch_us(ts) - first_value(epoch_us(ts)) over (partition by user_id order by ts, event_id) as delta_us from events")
def packet_delta(s, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return read_table(s, d, "events").select("event_id", "user_id", (us - F.first(us).over(W.partitionBy("user_id").orderBy("ts", "event_id"))).alias("delta_us"))


@query(f"with {LINES_SQL} select doc_id, ordinal, round(100.0 * (address + size) / greatest(sum(size) over (partition by doc_id), 1), 4) as percent from addressed")
def progress_percent(s, d):
    total = F.sum("size").over(W.partitionBy("doc_id"))
    return _lines(s, d).select("doc_id", F.col("ordinal").cast("bigint").alias("ordinal"), F.round(100.0 * (F.col("address") + F.col("size")) / F.greatest(total, F.lit(1)), 4).alias("percent"))


@query("select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def event_windows(s, d):
    from bitloom.streaming.events import windowed

    return windowed(read_table(s, d, "events"), "1 hour").withColumn("total", F.round("total", 4))


# -- metadata


@query(f"with {ITEMS_SQL}, c as (select source_id, group_name, meta_key, value, row_number() over (partition by source_id, group_name, meta_key order by ord desc, item_id desc) as rn from items where value is not null) select source_id, group_name, meta_key, value from c where rn = 1")
def metadata_dict_last_wins(s, d):
    return metadata.dictionary(read_table(s, d, "metadata_items"))


@query("with items as (select distinct item_id, source_id, meta_key, priority, trim(value, chr(32) || chr(9) || chr(11) || chr(10) || chr(13)) as value from metadata_items), c as (select *, case when length(value) > 300 then substr(value, 1, 300) || '(...)' else value end as v from items where value <> '') select source_id, string_agg('- ' || meta_key || ': ' || v, chr(10) order by priority, coalesce(list_position(" + str([k for k, *_ in REGISTRY]) + ", meta_key), 999), meta_key, item_id) as report from c where priority <= 499 group by 1")
def metadata_priority_report(s, d):
    return metadata.plain_text(read_table(s, d, "metadata_items"), 4)


@query()
def metadata_dedup_prefix(s, d):
    return metadata.registered(read_table(s, d, "metadata_items")).select("source_id", "meta_key", "priority", F.array_join("kept", "|").alias("kept"), F.size("kept").alias("n"))


@query("""with i as (select source_id, max(case when meta_key = 'width' then try_cast(value as bigint) end) as width, max(case when meta_key = 'height' then try_cast(value as bigint) end) as height, max(case when meta_key = 'bits_per_pixel' then try_cast(value as bigint) end) as bpp from metadata_items group by 1)
select i.source_id, round(width * height * coalesce(bpp, 24) / 8.0 / filesize, 6) as ratio from i join (select source_id, min(filesize) as filesize from sources group by 1) s on s.source_id = i.source_id where width is not null and height is not null and filesize > 0""")
def compression_ratio(s, d):
    from bitloom.operators.extract import derived

    whole = F.col("value").try_cast("bigint").cast("string").alias("value")
    items = read_table(s, d, "metadata_items").where(F.col("meta_key").isin("width", "height", "bits_per_pixel")).select(F.col("source_id").alias("id"), F.lit("Common").alias("group_name"), "meta_key", whole)
    sizes = read_table(s, d, "sources").groupBy(F.col("source_id").alias("id")).agg(F.min("filesize").alias("size")).where("size > 0")
    return derived(items, sizes).where("compression_rate is not null").select(F.col("id").alias("source_id"), F.round("compression_rate", 6).alias("ratio"))


@query("select item_id, min(try_cast(value as double)) as n from metadata_items where meta_key = 'sample_rate' and try_cast(value as double) between 1 and 192000 group by 1")
def filter_number(s, d):
    return read_table(s, d, "metadata_items").where("meta_key = 'sample_rate'").groupBy("item_id").agg(F.min(F.col("value").try_cast("double")).alias("n")).where("n between 1 and 192000")


@query("select o_orderkey from orders where o_orderdate between timestamp '1996-01-01' and timestamp '1997-12-31'")
def filter_datetime(s, d):
    return read_table(s, d, "orders").where("o_orderdate between timestamp_ntz'1996-01-01' and timestamp_ntz'1997-12-31'").select("o_orderkey")


@query(f"with {ITEMS_SQL}, r as (select source_id, item_id, meta_key, row_number() over (partition by source_id order by priority, item_id) as i from items) select source_id, item_id, meta_key from r where i <= 6")
def quality_limit(s, d):
    rows = read_table(s, d, "metadata_items").dropDuplicates(["item_id"])
    i = F.row_number().over(W.partitionBy("source_id").orderBy("priority", "item_id"))
    return rows.withColumn("i", i).where(F.col("i") <= metadata.quality_limit(0.5)).select("source_id", "item_id", "meta_key")


@query("select p_partkey, p_retailprice from part order by p_retailprice desc, p_partkey limit 20")
def sort_topk(s, d):
    return read_table(s, d, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(20)


@query("select distinct lang from documents where lang is not null except select lang from languages")
def set_minus(s, d):
    return read_table(s, d, "documents").where("lang is not null").select("lang").distinct().join(read_table(s, d, "languages"), "lang", "left_anti")


@query("select meta_key as name from metadata_items union select field_type from field_rows")
def set_union(s, d):
    return read_table(s, d, "metadata_items").select(F.col("meta_key").alias("name")).distinct().union(read_table(s, d, "field_rows").select("field_type").distinct()).distinct()


@query("select o_orderkey, case o_orderstatus when 'O' then 'open' when 'F' then 'finished' else o_orderstatus end as status from orders")
def enum_decode(s, d):
    labels = F.create_map(*[F.lit(x) for x in ("O", "open", "F", "finished")])
    return read_table(s, d, "orders").select("o_orderkey", F.coalesce(F.element_at(labels, F.col("o_orderstatus")), "o_orderstatus").alias("status"))


@query(f"""with {ITEMS_SQL}, r(k, least, most, whole) as (values ('track_number', 1, 999, true), ('width', 1, 20000, true), ('height', 1, 20000, true), ('nb_channel', 1, 8, true), ('sample_rate', 1000, 192000, false), ('bits_per_pixel', 1, 256, true), ('bit_rate', 1, 524288000, false), ('file_size', null, null, true)),
j as (select *, try_cast(value as double) as x from items left join r on r.k = meta_key)
select meta_key, count(*) as n, count(*) filter (value is not null and (k is null or (x is not null and (not whole or x = floor(x)) and (least is null or x between least and most)))) as valid from j group by 1""")
def metadata_validated(s, d):
    from bitloom.operators.registry import accepted

    rows = read_table(s, d, "metadata_items").select("item_id", "meta_key", "value").dropDuplicates(["item_id"])
    return rows.groupBy("meta_key").agg(F.count("*").alias("n"), F.count_if(accepted(F.col("meta_key"), F.col("value"))).alias("valid"))


# -- functions


@query("select doc_id, regexp_replace(regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g'), chr(10) || '+', chr(10), 'g') as value from documents")
def normalize_newline(s, d):
    return read_table(s, d, "documents").select("doc_id", text.normalize_newline(F.col("text")).alias("value"))


@query(f"with {ITEMS_SQL} select item_id, trim(value, chr(32) || chr(9) || chr(11) || chr(10) || chr(13)) as value from items where value is not null")
def normalize_string(s, d):
    return read_table(s, d, "metadata_items").where("value is not null").select("item_id", text.normalize_string(F.col("value")).alias("value")).distinct()


@query("select doc_id, case when length(text) > 300 then substr(text, 1, 300) || '(...)' else text end as value from documents")
def truncate_300(s, d):
    return read_table(s, d, "documents").select("doc_id", text.truncate(F.col("text")).alias("value"))


@query(r"select doc_id, replace(replace(replace(text, chr(10), '\n'), chr(13), '\r'), chr(9), '\t') || '\0\3\n\x10 \x7f' as value from documents")
def make_printable(s, d):
    return read_table(s, d, "documents").select("doc_id", text.printable(F.concat("text", F.lit("\0\x03\x0a\x10 \x7f"))).alias("value"))


@query(f"with {ITEMS_SQL} select item_id, regexp_replace(value, '([\\]\\[^.+*?{{}}|()\\\\$])', '\\\\\\1', 'g') as value from items where value is not null and meta_key = 'title'")
def escape_regex(s, d):
    return read_table(s, d, "metadata_items").where("value is not null and meta_key = 'title'").select("item_id", text.escape_regex(F.col("value")).alias("value")).distinct()


@query("select p_partkey, case p_partkey % 8 when 0 then 'ASCII' when 1 then 'UTF-8' when 2 then 'UTF-8' when 3 then 'MacRoman' when 4 then 'ISO-8859-1' when 5 then 'ISO-8859-15' when 6 then 'ISO-8859-7' end as charset from part")
def charset_guess(s, d):
    # bytes beyond ASCII that tell each charset; the last ones tell none
    tails = F.array(*[F.lit(x) for x in ("", "c3a9", "efbbbf61", "a8", "e96ce9", "a4", "b8eae4eff3e7", "ff81")])
    k = (F.col("p_partkey") % 8).cast("int")
    tail = F.element_at(tails, k + 1)
    data = F.unhex(F.when(k == 2, F.concat(tail, F.hex(F.encode("p_partkey", "UTF-8")))).otherwise(F.concat(F.hex(F.encode(F.col("p_partkey").cast("string"), "UTF-8")), tail)))
    return read_table(s, d, "part").select("p_partkey", text.charset(data).alias("charset"))


@query("select distinct source_id, case when filesize < 10000 then filesize || ' bytes' when filesize < 1048576 then printf('%.1f KB', filesize / 1024.0::double) when filesize < 1073741824 then printf('%.1f MB', filesize / 1048576.0::double) else printf('%.1f GB', filesize / 1073741824.0::double) end as size from sources")
def human_filesize(s, d):
    return read_table(s, d, "sources").select("source_id", human.file_size(F.col("filesize")).alias("size")).distinct()


@query("select l_orderkey, l_linenumber, case when v < 1000 then v || ' bits' when v < 1000000 then printf('%.1f Kbit', v / 1000.0::double) else printf('%.1f Mbit', v / 1000000.0::double) end || '/sec' as rate from (select l_orderkey, l_linenumber, cast(l_quantity as bigint) * 4096 as v from lineitem)")
def human_bitrate(s, d):
    v = F.col("l_quantity").cast("bigint") * 4096
    return read_table(s, d, "lineitem").select("l_orderkey", "l_linenumber", human.bit_rate(v).alias("rate"))


@query("select p_partkey, case when v < 1000 then v || ' Hz' when v < 1000000 then printf('%.1f kHz', v / 1000.0::double) else printf('%.1f MHz', v / 1000000.0::double) end as frequency from (select p_partkey, p_size * 4096 as v from part)")
def human_frequency(s, d):
    return read_table(s, d, "part").select("p_partkey", human.frequency((F.col("p_size") * 4096).cast("bigint")).alias("frequency"))


@query("""with p as (select event_id, event_id * 86413777 as v from events), u as (select event_id, v, v // 31536000000 as y, v % 31536000000 // 86400000 as d, v % 86400000 // 3600000 as h, v % 3600000 // 60000 as m, v % 60000 // 1000 as sec, v % 1000 as ms from p)
select event_id, case when v = 0 then '0 ms' else array_to_string(list_filter([case when y > 0 then y || ' years' end, case when d > 0 then d || ' days' end, case when h > 0 then h || ' hours' end, case when m > 0 then m || ' min' end, case when sec > 0 then sec || ' sec' end, case when ms > 0 then ms || ' ms' end], lambda x: x is not null)[1:3], ' ') end as duration from u""")
def human_duration(s, d):
    return read_table(s, d, "events").select("event_id", human.duration_ms(F.col("event_id") * 86413777).alias("duration"))


@query("""with m as (select p_partkey, (p_partkey * 131) % 4096 as v from part), b as (select p_partkey, v, lpad(right(bin(v), 12), 12, '0') as t from m)
select p_partkey, '-' || case when t[4] = '1' then 'r' else '-' end || case when t[5] = '1' then 'w' else '-' end || case when t[1] = '1' then case when t[6] = '1' then 's' else 'S' end when t[6] = '1' then 'x' else '-' end
|| case when t[7] = '1' then 'r' else '-' end || case when t[8] = '1' then 'w' else '-' end || case when t[2] = '1' then case when t[9] = '1' then 's' else 'S' end when t[9] = '1' then 'x' else '-' end
|| case when t[10] = '1' then 'r' else '-' end || case when t[11] = '1' then 'w' else '-' end || case when t[3] = '1' then case when t[12] = '1' then 't' else 'T' end when t[12] = '1' then 'x' else '-' end
|| ' (' || to_base(v, 8) || ')' as mode from b""")
def unix_attributes(s, d):
    return read_table(s, d, "part").select("p_partkey", human.unix_attributes((F.col("p_partkey") * 131) % 4096).alias("mode"))


@query("""select o_orderkey, '0x' || lpad(lower(hex(o_orderkey)), 8, '0') as hexa, lower(lpad(hex(o_orderkey), 8, '0')) as raw_big, cast(length(bin(o_orderkey)) as int) as needed, lpad(bin(o_orderkey), 32, '0') as bit_text,
((o_orderkey & 255) << 24) | (((o_orderkey >> 8) & 255) << 16) | (((o_orderkey >> 16) & 255) << 8) | ((o_orderkey >> 24) & 255) as swapped, (o_orderkey >> 3) & 31 as five_bits from orders""")
def bit_functions(s, d):
    k = F.col("o_orderkey")
    raw = F.unhex(bits.int_to_hex(k, 4))
    return read_table(s, d, "orders").select(
        "o_orderkey", bits.hexadecimal(k, 32).alias("hexa"), F.lower(bits.int_to_hex(k, 4)).alias("raw_big"), bits.needed_bits(k).alias("needed"), bits.bit_text(k, 32).alias("bit_text"),
        bits.swap32(k.cast("bigint")).alias("swapped"), bits.read_bits(raw, 24, 5).alias("five_bits"),
    )


@query("select p_partkey, (8 - p_size % 8) % 8 as padding, p_size + (8 - p_size % 8) % 8 as aligned, cast(try_cast('0' as bigint) as bigint) as bad_octal, cast(p_size % 8 as bigint) as octal from part")
def padding_align(s, d):
    v = F.col("p_size")
    octal = bits.octal_to_int(F.concat((v % 8).cast("string"), F.lit(" ")))
    return read_table(s, d, "part").select("p_partkey", bits.padding_size(v, 8).alias("padding"), bits.align_value(v, 8).alias("aligned"), bits.octal_to_int(F.lit("9x")).alias("bad_octal"), octal.alias("octal"))


@query("""select o_orderkey, o_orderdate as unix_time, o_orderdate as mac_time, o_orderdate + to_microseconds(o_orderkey * 7919 % 1000000) as win_time, o_orderdate + to_microseconds(o_orderkey * 7919 % 1000000) as uuid_time from orders""")
def epochs_roundtrip(s, d):
    unix = F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01'"), F.col("o_orderdate"))
    ticks = (F.col("o_orderkey").cast("bigint") * 7919 % 1_000_000) * 10 + F.col("o_orderkey") % 10  # tenths of a microsecond, odd ones too
    return read_table(s, d, "orders").select(
        "o_orderkey", epochs.unix(unix).alias("unix_time"), epochs.mac32(unix + epochs.MAC_OFFSET).alias("mac_time"),
        epochs.win64((unix + epochs.WIN_OFFSET) * 10_000_000 + ticks).alias("win_time"), epochs.uuid60((unix + epochs.UUID_OFFSET) * 10_000_000 + ticks).alias("uuid_time"),
    )


@query("select o_orderkey, make_timestamp(year(o_orderdate), month(o_orderdate), day(o_orderdate), 13, 37, 42.0) as at from orders where year(o_orderdate) >= 1980")
def epoch_msdos(s, d):
    t = F.col("o_orderdate")
    date = F.shiftleft(F.year(t) - 1980, 9).bitwiseOR(F.shiftleft(F.month(t), 5)).bitwiseOR(F.dayofmonth(t))
    return read_table(s, d, "orders").where(F.year(t) >= 1980).select("o_orderkey", epochs.msdos32(date, F.lit(13 << 11 | 37 << 5 | 21)).alias("at"))


@query("""select o_orderkey, o_orderdate as iso, o_orderdate as us, date_trunc('day', o_orderdate) as day_only, date_trunc('year', o_orderdate) as year_only, o_orderdate as mail, cast(o_orderkey % 12 as int) as mail_offset, o_orderdate as riff, date_trunc('month', o_orderdate) as month_only, null::timestamp as other from orders""")
def parse_datetime(s, d):
    t = F.col("o_orderdate")
    form = lambda f: epochs.parse_datetime(F.date_format(t, f))
    mail = F.concat(F.date_format(t, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +"), F.lpad((F.col("o_orderkey") % 12).cast("string"), 2, "0"), F.lit("00"))
    return read_table(s, d, "orders").select(
        "o_orderkey", form("yyyy/MM/dd HH:mm:ss").alias("iso"), form("MM-dd-yyyy HH:mm:ss").alias("us"), form("yyyy.MM.dd").alias("day_only"), form("yyyy").alias("year_only"),
        epochs.parse_datetime(mail).alias("mail"), epochs.utc_offset(mail).alias("mail_offset"), form("EEE MMM d HH:mm:ss yyyy").alias("riff"), form("MMMM yyyy").alias("month_only"), form("d MMMM yyyy").alias("other"),
    )


@query("select p_partkey, round(case when p_size % 2 = 0 then 1 else -1 end * (p_size + (p_partkey % 60) / 60.0 + (p_partkey % 7) / 3600.0), 9) as degrees from part")
def gps_degrees(s, d):
    hemisphere = F.when(F.col("p_size") % 2 == 0, "N").otherwise("S")
    return read_table(s, d, "part").select("p_partkey", F.round(human.degrees(F.col("p_size"), F.col("p_partkey") % 60, F.col("p_partkey") % 7, hemisphere), 9).alias("degrees"))


# -- formats


@query("select doc_id, text as value from documents")
def inflate_roundtrip(s, d):
    from bitloom.sources.formats import inflated

    def pack(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else gzip.compress(t.encode(), 1, mtime=0) for t in texts], dtype=object)

    packed = read_table(s, d, "documents").select("doc_id", F.pandas_udf(pack, "binary")("text").alias("content"))
    return packed.select("doc_id", F.decode(inflated(F.col("content"), "gzip"), "UTF-8").alias("value"))


@query("select doc_id, 'tar' as format, 'doc_' || doc_id || '.txt' as name, strlen(text) as size from documents union all select doc_id, 'zip', 'doc_' || doc_id || '.txt', strlen(text) from documents")
def archive_members(s, d):
    from bitloom.sources.formats import parse

    def pack(keys: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for k, t in zip(keys, texts):
            raw, buffer = (t or "").encode(), io.BytesIO()
            if k % 2:
                with tarfile.open(fileobj=buffer, mode="w", format=tarfile.USTAR_FORMAT) as f:
                    info = tarfile.TarInfo(f"doc_{k // 2}.txt")
                    info.size = len(raw)
                    f.addfile(info, io.BytesIO(raw))
            else:
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as f:
                    f.writestr(f"doc_{k // 2}.txt", raw)
            out.append(buffer.getvalue())
        return pd.Series(out, dtype=object)

    twice = read_table(s, d, "documents").select(F.explode(F.array(F.col("doc_id") * 2, F.col("doc_id") * 2 + 1)).alias("id"), "text")
    rows = parse(twice.select("id", F.pandas_udf(pack, "binary")("id", "text").alias("content")))
    value = lambda *names: F.max(F.when(F.regexp_extract("path", r"^/file\[0\]/(\w+)$", 1).isin(*names), F.col("value")))
    members = rows.groupBy("id", "format").agg(value("name", "filename").alias("name"), value("size", "uncompressed_size").cast("bigint").alias("size"))
    return members.select(F.floor(F.col("id") / 2).cast("bigint").alias("doc_id"), "format", "name", "size")


def _png(width: int, title: str) -> bytes:
    chunk = lambda tag, body: struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, 7, 8, 2, 0, 0, 0)) + chunk(b"tEXt", b"Title\0" + title.encode("latin-1")) + chunk(b"IEND", b"")


def _pictures(s, d):
    """A picture per source, with its name as a text."""

    def draw(keys: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([_png(k % 1000 + 1, n) for k, n in zip(keys, names)], dtype=object)

    rows = read_table(s, d, "sources").groupBy("source_id").agg(F.min("filename").alias("filename"))
    return rows.select(F.col("source_id").alias("id"), "filename", F.pandas_udf(draw, "binary")("source_id", "filename").alias("content"))


@query("select distinct source_id as id, (source_id % 1000 + 1)::varchar as width, filename as comment from sources")
def png_metadata(s, d):
    from bitloom.operators.extract import metadata_rows
    from bitloom.sources.formats import parse

    rows = metadata_rows(parse(_pictures(s, d).select("id", "content")))
    value = lambda k: F.max(F.when(F.col("meta_key") == k, F.col("value"))).alias(k)
    return rows.groupBy("id").agg(value("width"), value("comment"))


@query("select distinct source_id as id, (12 + 6 + length(filename)) * 8 as removed_bits from sources")
def strip_png(s, d):
    from bitloom.operators.editing import stripped

    return _pictures(s, d).select("id", stripped(F.col("content"), F.lit("png")).alias("s")).select("id", "s.removed_bits")


def _mixed_images(s, d):
    """A picture, a sound and a tiny picture per source."""
    gif = b"GIF89a" + struct.pack("<HHBBB", 3, 2, 0, 0, 0) + b";"
    wav = b"RIFF" + struct.pack("<I", 44) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", 8) + b"8 bytes."
    return _pictures(s, d).withColumns({"gif": F.lit(gif), "wav": F.lit(wav)})


@query("""with s as (select distinct source_id as id, source_id % 97 as k, 8 + 25 + 12 + 6 + length(filename) + 12 as n from sources)
select id, k + 6 as "offset", n as size, 'file-0001.png' as name from s union all select id, k + n + 12, 52, 'file-0002.wav' from s union all select id, k + n + 70, 14, 'file-0003.gif' from s""")
def carve_embedded(s, d):
    """Files of several formats among magic numbers that begin none, all formats searched for."""
    from bitloom.operators.carving import carve_files

    filler, false = F.encode(F.repeat(F.lit("."), (F.col("id") % 97).cast("int")), "UTF-8"), F.lit(b"BM4!MZ")
    content = F.concat(filler, false, "content", false, "wav", false, "gif", filler)
    return carve_files(_mixed_images(s, d).select("id", content.alias("content"))).select("id", "offset", "size", "name")


# -- strings, exports, sessions


@query("select doc_id, coalesce(lang, '') as lang, strlen(coalesce(lang, '')) + 1 as size, coalesce(pub_number, '') as pub_number, strlen(coalesce(pub_number, '')) + 2 as pascal_size from documents")
def string_fields(s, d):
    lang, number = F.encode(F.coalesce("lang", F.lit("")), "UTF-8"), F.encode(F.coalesce("pub_number", F.lit("")), "UTF-8")
    data = F.concat(lang, F.lit(b"\0"), F.unhex(bits.int_to_hex(F.octet_length(number), 2)), number)
    rows = read_table(s, d, "documents").select("doc_id", data.alias("b")).withColumn("c", strings.terminated(F.col("b"), F.lit(0), charset="UTF-8"))
    rows = rows.withColumn("p", strings.pascal(F.col("b"), F.col("c.size"), 2, charset="UTF-8"))
    return rows.select("doc_id", F.col("c.value").alias("lang"), F.col("c.size").cast("bigint").alias("size"), F.col("p.value").alias("pub_number"), F.col("p.size").cast("bigint").alias("pascal_size"))


@query("select p_partkey, p_size % 2 = 0 as padding from part")
def padding_check(s, d):
    data = F.concat(F.unhex(F.lit("00" * 64)), F.when(F.col("p_size") % 2 == 0, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("01"))))
    return read_table(s, d, "part").select("p_partkey", strings.all_pattern(data).alias("padding"))


@query(f"with {ITEMS_SQL} select source_id, string_agg(meta_key || '=' || coalesce(value, ''), '; ' order by priority, item_id) as line, count(*) as n_total, count(*) filter (value is not null and value <> '') as n_valid from items group by 1")
def csv_export(s, d):
    once = read_table(s, d, "metadata_items").dropDuplicates(["item_id"])
    cell = F.concat("meta_key", F.lit("="), F.coalesce("value", F.lit("")))
    cells = F.transform(F.array_sort(F.collect_list(F.struct("priority", "item_id", cell.alias("c")))), lambda x: x["c"])
    return once.groupBy("source_id").agg(F.array_join(cells, "; ").alias("line"), F.count("*").alias("n_total"), F.count_if(F.col("value").isNotNull() & (F.col("value") != "")).alias("n_valid"))


@query("""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '30 minutes' then 0 else 1 end as new from events),
n as (select user_id, ts, sum(new) over (partition by user_id order by ts rows between unbounded preceding and current row) as s from g)
select user_id, min(ts) as session_start, max(ts) + interval '30 minutes' as session_end, count(*) as n from n group by user_id, s""")
def event_sessions(s, d):
    from bitloom.streaming.events import sessions

    return sessions(read_table(s, d, "events"), "30 minutes")


@query("select event_id, case when v < 1000 then v || ' nsec' when v < 1000000 then printf('%.2f usec', v / 1000.0::double) else printf('%.2f ms', v / 1000000.0::double) end as duration from (select event_id, (event_id * 7919 * 1024) % 1000000000 as v from events) t")
def human_duration_ns(s, d):
    v = (F.col("event_id") * 7919 * 1024) % 1_000_000_000
    return read_table(s, d, "events").select("event_id", human.duration_ns(v).alias("duration"))


@query("select source_id as id, unnest(list_distinct(['gzip', 'zlib', 'bzip2'])) as method, strlen(filename) as size from (select distinct source_id, filename from sources)")
def inflate_methods(s, d):
    import bz2

    from bitloom.sources.formats import inflated

    pack = {"gzip": gzip.compress, "zlib": zlib.compress, "bzip2": bz2.compress}
    rows = read_table(s, d, "sources").select(F.col("source_id").alias("id"), "filename").distinct()
    parts = []
    for name, f in sorted(pack.items()):

        def squeeze(texts: pd.Series, f=f) -> pd.Series:
            return pd.Series([f(t.encode()) for t in texts], dtype=object)

        packed = rows.select("id", F.pandas_udf(squeeze, "binary", F.PandasUDFType.SCALAR)("filename").alias("content"))
        parts.append(packed.select("id", F.lit(name).alias("method"), F.octet_length(inflated(F.col("content"), name)).cast("bigint").alias("size")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
