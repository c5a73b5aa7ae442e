"""Further queries of the field, value and format operators over the test tables, each with its SQL."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F

from bitloom.functions import human, values
from bitloom.operators import detect, selection
from bitloom.plans.catalog import FIELDS_SQL, ITEMS_SQL, QUERIES, SQL, _fields, query
from bitloom.sources import read_table

__all__ = ["QUERIES", "SQL"]


@query("select p_partkey, p_retailprice::double as f64, p_retailprice::float::double as f32, p_size::double as f80 from part")
def float_fields(s, d):
    def pack(form: str):
        def run(v: pd.Series) -> pd.Series:
            return pd.Series([struct.pack(form, x) for x in v], dtype=object)

        return F.pandas_udf(run, "binary")

    def pack80(v: pd.Series) -> pd.Series:
        # a whole number as a float of 80 bits, in little endian: mantissa with its first bit set, exponent
        return pd.Series([(int(x) << 64 - int(x).bit_length()).to_bytes(8, "little") + struct.pack("<H", 16382 + int(x).bit_length()) for x in v], dtype=object)

    price = F.col("p_retailprice").cast("double")
    rows = read_table(s, d, "part").select("p_partkey", pack(">d")(price).alias("a"), pack("<f")(price).alias("b"), F.pandas_udf(pack80, "binary")("p_size").alias("c"))
    return rows.select("p_partkey", values.floats(F.col("a")).alias("f64"), values.floats(F.col("b"), 32, "little").alias("f32"), values.floats(F.col("c"), 80, "little").alias("f80"))


@query("select o_orderkey, o_orderkey * 7919 as micros, o_orderkey * 7919 / 1e6 as secs, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as shown from orders")
def durations_and_dates(s, d):
    micros = values.duration_win64(F.col("o_orderkey").cast("bigint") * 79190 + 7)
    return read_table(s, d, "orders").select("o_orderkey", micros.alias("micros"), values.seconds(micros).alias("secs"), values.human_datetime(F.col("o_orderdate")).alias("shown"))


@query("select p_partkey, printf('%.1f fps', p_size / 4.0::double) as fps, printf('%.1fx', p_size / 2.0::double) as rate, printf('%.1f meters', p_size::double) as altitude, p_size || ' pixels' as pixels, p_size || ' DPI' as dpi, case p_size % 3 when 0 then 'UTC' when 1 then '-0100' else '+0200' end as zone, case when p_size % 2 = 1 then 'mono' else 'stereo' end as channels from part")
def human_values(s, d):
    v = F.col("p_size")
    zone = F.when(v % 3 == 0, 0).when(v % 3 == 1, -1).otherwise(2)
    return read_table(s, d, "part").select(
        "p_partkey", values.frame_rate(v, 4).alias("fps"), values.compression_rate(v, 2).alias("rate"), values.altitude(v).alias("altitude"), values.pixels(v).alias("pixels"), values.dpi(v).alias("dpi"),
        values.timezone_name(zone).alias("zone"), human.channels(F.when(v % 2 == 1, 1).otherwise(2)).alias("channels"),
    )


@query("""select o_orderkey, '0a:00:' || h[1:2] || ':' || h[3:4] || ':' || h[5:6] || ':' || h[7:8] as mac, (o_orderkey >> 24) || '.' || ((o_orderkey >> 16) & 255) || '.' || ((o_orderkey >> 8) & 255) || '.' || (o_orderkey & 255) as ipv4,
'fe80:0000:0000:0000:0000:0000:' || h[1:4] || ':' || h[5:8] as ipv6, '/a/' || o_orderkey as path from (select o_orderkey, lower(lpad(hex(o_orderkey), 8, '0')) as h from orders)""")
def network_addresses(s, d):
    h = F.lpad(F.hex("o_orderkey"), 8, "0")
    return read_table(s, d, "orders").select(
        "o_orderkey", values.mac_address(F.unhex(F.concat(F.lit("0A00"), h))).alias("mac"), values.ipv4_address(F.unhex(h)).alias("ipv4"),
        values.ipv6_address(F.unhex(F.concat(F.lit("FE80" + "0" * 20), h))).alias("ipv6"), values.join_path(values.join_path(F.lit("/"), F.lit("a")), F.col("o_orderkey").cast("string")).alias("path"),
    )


@query("select p_partkey, len(list_filter([5, 10, 20, 35], lambda x: x < p_size)) as bound, case p_size when 5 then 0 when 10 then 1 when 20 then 2 when 35 then 3 end as place, case p_size when 1 then 'one' when 2 then 'two' end as word from part")
def array_search(s, d):
    known, v = F.array(*map(F.lit, (5, 10, 20, 35))), F.col("p_size").cast("int")
    words = F.create_map(*[x for k, w in ((1, "one"), (2, "two")) for x in (F.lit(k), F.struct(F.lit(w).alias("word")))])
    return read_table(s, d, "part").select("p_partkey", values.lower_bound(known, v).cast("bigint").alias("bound"), values.binary_search(known, v).alias("place"), values.create_dict(words, v, "word").alias("word"))


@query(f"with {FIELDS_SQL} select source_id, path, field_type in ('CString', 'String') as is_text, ordinal = 1 as second from f where ordinal < 3 and size_bits >= 16")
def field_selection(s, d):
    rows = selection.first_fields(_fields(s, d), 3).where("size_bits >= 16")
    second = selection.by_index(rows, 1).select("source_id", "path", F.lit(True).alias("second")).distinct()
    return rows.join(second, ["source_id", "path"], "left").select("source_id", "path", selection.is_text(F.col("field_type")).alias("is_text"), F.coalesce("second", F.lit(False)).alias("second"))


@query(f"with {ITEMS_SQL} select item_id, group_name || '[' || row_number() over (partition by source_id, group_name order by ord, item_id) || ']' as \"group\" from items")
def group_counter(s, d):
    return selection.numbered_groups(read_table(s, d, "metadata_items").dropDuplicates(["item_id"]), ["source_id"], "group_name", ["ord", "item_id"]).select("item_id", "group")


@query(f"with {ITEMS_SQL}, r as (select source_id, value, row_number() over (partition by source_id order by ord, item_id) as i from items where meta_key = 'title' and value is not null) select s.source_id, coalesce(r.value, 'untitled') as value from (select distinct source_id from items) s left join r on r.source_id = s.source_id and i = 1")
def metadata_get(s, d):
    return selection.get(read_table(s, d, "metadata_items"), "title", "untitled")


@query("select * from (values " + ", ".join(f"('{c}', '{' '.join(sorted({e for f in detect.FORMATS if f[1] == c for e in f[2].split()}))}')" for c in sorted({f[1] for f in detect.FORMATS})) + ") t(category, extensions)")
def extensions_distinct(s, d):
    rows = detect.formats(s).select("category", F.explode(F.split("extensions", " ")).alias("e"))
    return rows.groupBy("category").agg(F.array_join(F.array_sort(F.collect_set("e")), " ").alias("extensions"))


@query("""with l as (select l_orderkey, l_linenumber, sum(l_quantity::bigint)::bigint as size from lineitem group by 1, 2), e as (select *, coalesce(sum(size) over (partition by l_orderkey order by l_linenumber rows between unbounded preceding and 1 preceding), 0)::bigint as logical from l)
select l_orderkey as stream, greatest(10, logical) as piece_at, l_linenumber * 1000 + greatest(10, logical) - logical as source_at, least(40, logical + size) - greatest(10, logical) as size from e where least(40, logical + size) > greatest(10, logical)""")
def read_extents(s, d):
    from pyspark.sql import Window as W

    before = F.coalesce(F.sum("size").over(W.partitionBy("l_orderkey").orderBy("l_linenumber").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    lines = read_table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("size"))
    extents = lines.select(F.col("l_orderkey").alias("stream"), before.alias("logical"), "size", (F.col("l_linenumber").cast("bigint") * 1000).alias("source"))
    reads = lines.select(F.col("l_orderkey").alias("stream")).distinct().withColumns({"at": F.lit(10).cast("bigint"), "n": F.lit(30).cast("bigint")})
    return selection.read_extents(reads, extents, "stream", 16).select("stream", "piece_at", "source_at", "size")


@query("select l_orderkey as stream, l_linenumber::bigint + 100 as \"time\", l_linenumber::bigint % 2 as track, case when l_linenumber % 3 <> 0 then min(l_suppkey) end as block from lineitem group by l_orderkey, l_linenumber")
def cue_join(s, d):
    lines = read_table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("stream"), F.col("l_linenumber").cast("bigint").alias("i")).agg(F.min("l_suppkey").alias("l_suppkey"))
    cues = lines.select("stream", (F.col("i") + 100).alias("time"), (F.col("i") % 2).alias("track"), F.lit(7).alias("cluster_at"))
    clusters = lines.select("stream", F.lit(7).alias("cluster_at"), F.lit("c").alias("cluster"), F.lit(100).cast("bigint").alias("timecode")).distinct()
    blocks = lines.where("i % 3 <> 0").select("stream", F.lit("c").alias("cluster"), (F.col("i") % 2).alias("track"), F.col("i").alias("relative"), F.col("l_suppkey").alias("block"))
    return selection.cue_blocks(cues, clusters, blocks)


def _tagged(key: int, name: str) -> bytes:
    """A sound whose title is ``name``: by turns with frames, comments or information chunks."""
    raw = name.encode()
    if key % 3 == 0:
        frame = b"TIT2" + (len(raw) + 1).to_bytes(4, "big") + b"\0\0\3" + raw
        n = len(frame)
        return b"ID3\3\0\0" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + frame
    if key % 3 == 1:
        entry = b"TITLE=" + raw
        body = struct.pack("<I", 0) + struct.pack("<I", 1) + struct.pack("<I", len(entry)) + entry
        return b"fLaC" + bytes([0x84]) + len(body).to_bytes(3, "big") + body
    info = b"INFOINAM" + struct.pack("<I", len(raw)) + raw + b"\0" * (len(raw) % 2)
    return b"RIFF" + struct.pack("<I", len(info) + 12) + b"WAVELIST" + struct.pack("<I", len(info)) + info


def _sounds(s, d):
    def run(keys: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([_tagged(k, n) for k, n in zip(keys, names)], dtype=object)

    rows = read_table(s, d, "sources").groupBy("source_id").agg(F.min("filename").alias("filename"))
    return rows.select(F.col("source_id").alias("id"), F.pandas_udf(run, "binary")("source_id", "filename").alias("content"))


@query("select source_id as id, case source_id % 3 when 0 then 'mpeg_audio' when 1 then 'flac' else 'wav' end as format, 'title' as meta_key, min(filename) as value from sources group by source_id")
def tagged_metadata(s, d):
    from bitloom.operators.extract import metadata_rows
    from bitloom.sources.formats import parse

    return metadata_rows(parse(_sounds(s, d))).select("id", "format", "meta_key", "value")


@query("select source_id as id, case when source_id % 2 = 0 then case source_id % 3 when 0 then 'mpeg_audio' when 2 then 'wav' end end as guess from (select distinct source_id from sources)")
def validated_detection(s, d):
    """Every other content has its magic number only; of the others, those that begin with comments instead of stream information are invalid."""
    broken = F.when(F.col("id") % 2 == 0, F.col("content")).otherwise(F.concat(F.substring("content", 1, 3), F.lit(b"\xff" * 40)))
    return detect.validated(_sounds(s, d).select("id", broken.alias("content"))).select("id", "guess")


