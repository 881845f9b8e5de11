"""Queries over packet payloads, control packets and units: written, read back and put together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tributary.plans.registry import FILE, query
from tributary.sources import containers as K
from tributary.sources import payloads as P
from tributary.sources import rtcp as RC
from tributary.sources import tables as S


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "events")


@query("""with e as (select floor(event_id / 4) as g, event_id, event_type, event_id % 4 as i from events), n as (select g, count(*) as n from e group by g)
select cast(g as bigint) as g, cast(i as int) as idx, event_type as data, g % 3 = 1 and i = 0 as continues_previous, g % 3 = 0 and i = n - 1 as continues_next, n < 4 and i = n - 1 as inferred from e join n using (g)""")
def rtp_payload_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four events a payload, as elements."""
    g = F.floor(F.col("event_id") / 4)
    rows = _events(spark, sf_dir).groupBy(g.alias("g")).agg(F.array_sort(F.collect_list(F.struct("event_id", F.encode("event_type", "utf-8").alias("d")))).alias("e"))
    coded = rows.select("g", P.payload_bytes(F.transform("e", lambda x: x["d"]), F.col("g") % 3 == 1, F.col("g") % 3 == 0, F.lit(False)).alias("content"))
    return P.payload_elements(coded).select("g", "idx", F.decode("data", "utf-8").alias("data"), "continues_previous", "continues_next", "inferred")


@query("select v, case when v & 7 = 0 and v & 136 <> 136 then v & 128 <> 0 end as continues_previous, case when v & 7 = 0 and v & 136 <> 136 then v & 64 <> 0 end as continues_next, case when v & 7 = 0 and v & 136 <> 136 then cast((v >> 4) & 3 as bigint) end as elements, case when v & 7 = 0 and v & 136 <> 136 then v & 8 <> 0 end as new_sequence from (select distinct event_id % 256 as v from events)")
def rtp_aggregation_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select((F.col("event_id") % 256).alias("v")).distinct()
    return rows.select("v", *[c.alias(k) for k, c in P.aggregation_header(F.col("v")).items()])


def _fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of each source as fragments in packets with consecutive numbers."""
    docs = S.table(spark, sf_dir, "documents").select("source", "doc_id", F.encode("text", "utf-8").alias("data"))
    rows = P.fragmented(docs, "data", 1200, F.col("doc_id") % 5 == 0)
    return rows.withColumn("ext_seq", F.row_number().over(Window.partitionBy("source").orderBy("doc_id", "part")) - 1)


FRAGMENTS = """with d as (select source, doc_id, text, greatest(cast(ceil(octet_length(encode(text)) / 1199) as bigint), 1) as n from documents),
p as (select *, cast(sum(n) over (partition by source order by doc_id) as bigint) - n as first from d) """


@query(FRAGMENTS + "select source, first as first_seq, first + n - 1 as last_seq, n as fragments, doc_id % 5 = 0 as new_sequence, md5(text) as digest from p")
def rtp_depacketize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in fragments over packets, put together again."""
    units = P.reassembled(_fragments(spark, sf_dir), "source")
    return units.filter("complete").select("source", F.col("first_seq").cast("long").alias("first_seq"), F.col("last_seq").cast("long").alias("last_seq"), "fragments", "new_sequence", F.md5("data").alias("digest"))


@query(FRAGMENTS + ", s as (select *, list_filter(range(first, first + n), lambda x: x % 13 <> 5) as kept from p) select source, first as first_seq, n as fragments, md5(text) as digest from s where len(kept) = n")
def rtp_depacketize_after_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of packets some of which are lost, the units that are whole; a unit that lost a packet is none."""
    units = P.reassembled(_fragments(spark, sf_dir).filter("ext_seq % 13 <> 5"), "source")
    return units.filter("complete").select("source", F.col("first_seq").cast("long").alias("first_seq"), "fragments", F.md5("data").alias("digest"))


@query("select o_custkey, count(*) as units, sum(octet_length(encode(o_orderpriority || repeat('x', cast(o_orderkey % 900 as int))))) as bytes, md5(string_agg(o_orderpriority || repeat('x', cast(o_orderkey % 900 as int)), '' order by o_orderkey)) as digest from orders group by o_custkey")
def rtp_packetizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of a customer as the units of a picture, packed, and put together again."""
    unit = F.encode(F.concat("o_orderpriority", F.repeat(F.lit("x"), (F.col("o_orderkey") % 900).cast("int"))), "utf-8")
    pictures = S.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", unit.alias("u")))), lambda x: x["u"]).alias("units"))
    packets = P.packed(pictures, "units", 1200, 40, 40)
    units = P.reassembled(packets.withColumnRenamed("packet", "ext_seq"), "o_custkey")
    listed = F.array_sort(F.collect_list(F.struct("unit", F.hex("data").alias("d"))))
    rows = units.filter("complete").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("units"), F.sum(F.octet_length("data")).alias("bytes"), listed.alias("l"))
    return rows.select("o_custkey", "units", "bytes", F.md5(F.unhex(F.array_join(F.transform("l", lambda x: x["d"]), ""))).alias("digest"))


@query("with " + S.PACKETS + " select event_id, ssrc + 1000 as ssrc, cast(event_id % 65536 as int) as seq, cast(seq as int) as original_seq, event_type as payload from pk")
def rtx_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets wrapped for sending again, and unwrapped."""
    i = F.col("event_id")
    coded = S.packets(spark, sf_dir).select("event_id", K.rtx_bytes(F.lit(97), i % 65536, i * 3000 % 4294967296, F.col("ssrc") + 1000, F.col("seq"), F.encode("event_type", "utf-8"), i % 5 == 0).alias("content"))
    number, payload = K.rtx_original(F.col("payload"))
    return K.rtp_packets(coded).select("event_id", "ssrc", "seq", number.alias("original_seq"), F.decode(payload, "utf-8").alias("payload"))


@query("""select event_id, event_type as payload, cast(event_id % 4 as int) as sources, cast(event_id % 4095 as bigint) as minimum, cast(event_id * 7 % 4096 as bigint) as maximum, cast(event_id * 13 % 65536 as bigint) as transport_seq, event_id % 3 = 0 as has_mid from events""")
def rtp_header_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets with sources, padding and extensions, which are looked up by id and read."""
    i, rows = F.col("event_id"), _events(spark, sf_dir)
    element = lambda n, b: F.struct(F.lit(n).alias("id"), b.alias("payload"))
    delay = P.extension_bytes("playout_delay", {"minimum": i % 4095, "maximum": i * 7 % 4096})
    number = P.extension_bytes("transport_sequence", {"seq": i * 13 % 65536})
    elements = F.concat(F.array(element(5, delay), element(2, number)), F.when(i % 3 == 0, F.array(element(9, F.encode(F.lit("mid"), "utf-8")))).otherwise(F.array().cast("array<struct<id:int,payload:binary>>")))
    sources = F.filter(F.array(*[F.lit(k).cast("long") for k in (0, 1, 2)]), lambda k: k < i % 4)
    coded = rows.select("event_id", K.rtp_packet_bytes(i % 2 == 0, F.lit(98), i % 65536, i, F.lit(7), F.encode("event_type", "utf-8"), sources, elements, (i % 5).cast("int")).alias("content"))
    found = K.rtp_packets(coded)
    at = lambda n: K.extension(F.col("extensions"), F.col("profile"), n)
    d = P.extension_values("playout_delay", at(5))
    return found.select("event_id", F.decode("payload", "utf-8").alias("payload"), F.size("csrc").alias("sources"), d["minimum"].alias("minimum"), d["maximum"].alias("maximum"), P.extension_values("transport_sequence", at(2))["seq"].alias("transport_seq"), at(9).isNotNull().alias("has_mid"))


def _value(name: str, bits: int) -> str:
    return f"(event_id * {sum(map(ord, name))}) % {1 << bits}"


def _of(kind: str) -> str:
    return "[" + ", ".join(f"cast({_value(n, b)} as bigint)" for n, b in P.EXTENSIONS[kind]) + "]"


@query("select event_id, kind, array_to_string(v, ',') as fields from (" + " union all ".join(f"select event_id, '{k}' as kind, {_of(k)} as v from events" for k in P.EXTENSIONS) + ")")
def rtp_extension_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All header extensions, written and read back."""
    out = None
    for kind, fields in P.EXTENSIONS.items():
        coded = _events(spark, sf_dir).select("event_id", P.extension_bytes(kind, {n: F.expr(_value(n, b)) for n, b in fields}).alias("b"))
        found = P.extension_values(kind, F.col("b"))
        part = coded.select("event_id", F.lit(kind).alias("kind"), F.concat_ws(",", *[found[n].cast("string") for n, _ in fields]).alias("fields"))
        out = part if out is None else out.unionByName(part)
    return out


REPORT = "event_id % 200 as fraction_lost, event_id % 1000 - 500 as lost, event_id * 17 as highest, event_id * 3 as jitter"


@query(f"""select event_id, type, ssrc, block, cast(fraction_lost as int) as fraction_lost, cast(lost as int) as lost, highest, jitter, octets from (
 select event_id, cast(200 as int) as type, user_id as ssrc, cast(unnest(range(event_id % 4)) as int) as block, {REPORT}, cast(event_id * 5 as bigint) as octets from events
 union all select event_id, 201, user_id, cast(unnest(range(event_id % 4)) as int), {REPORT}, null from events)""")
def rtcp_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sender and receiver reports in one datagram, read back by report block."""
    i = F.col("event_id")
    block = lambda k: F.struct((i + k).alias("ssrc"), (i % 200).alias("fraction_lost"), (i % 1000 - 500).alias("lost"), (i * 17).alias("highest"), (i * 3).alias("jitter"), F.lit(1).alias("lsr"), F.lit(2).alias("delay"))
    blocks = F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda k: k < i % 4), block)
    both = F.concat(RC.sender_report(F.col("user_id"), i, i * 2, i * 3, i * 4, i * 5, blocks), RC.receiver_report(F.col("user_id"), blocks))
    found = RC.rtcp_packets(_events(spark, sf_dir).select("event_id", both.alias("content")))
    return found.select("event_id", "type", "ssrc", F.posexplode("reports").alias("block", "r"), F.col("sender.octets").alias("octets")).select("event_id", "type", "ssrc", "block", "r.fraction_lost", "r.lost", "r.highest", "r.jitter", "octets")


@query("""select event_id, user_id as ssrc, 'user' || user_id || '@x' as name, event_type as tool, [user_id, event_id]::varchar as leaving, case when event_id % 2 = 0 then 'gone ' || event_type end as reason from events""")
def rtcp_description_bye(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source descriptions and goodbyes in one datagram, read back."""
    item = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    chunk = F.struct(F.col("user_id").alias("ssrc"), F.array(item(1, F.concat(F.lit("user"), "user_id", F.lit("@x"))), item(6, F.col("event_type"))).alias("items"))
    leave = RC.bye(F.array("user_id", "event_id"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("gone "), "event_type")))
    found = RC.rtcp_packets(_events(spark, sf_dir).select("event_id", F.concat(RC.source_description(F.array(chunk)), leave).alias("content")))
    rows = found.groupBy("event_id").agg(F.max("chunks").alias("c"), F.max("sources").alias("s"), F.max("reason").alias("reason"))
    return rows.select("event_id", F.col("c")[0]["ssrc"].alias("ssrc"), F.col("c")[0]["items"][0]["text"].alias("name"), F.col("c")[0]["items"][1]["text"].alias("tool"), F.concat(F.lit("["), F.array_join(F.transform("s", lambda x: x.cast("string")), ", "), F.lit("]")).alias("leaving"), "reason")


def _feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    refresh = F.struct(F.lit(7).cast("long").alias("ssrc"), (i % 256).alias("seq"), (i % 8).alias("target_temporal"), (i % 4).alias("target_spatial"), (i % 3).alias("current_temporal"), (i % 2).alias("current_spatial"))
    intra = F.struct(F.lit(9).cast("long").alias("ssrc"), (i % 256).alias("seq"))
    content = F.when(i % 5 == 0, RC.picture_loss(F.lit(1), i)).when(i % 5 == 1, RC.full_intra(F.array(intra), F.lit(1))).when(i % 5 == 2, RC.layer_refresh(F.array(refresh), F.lit(1))).when(i % 5 == 3, RC.estimated_bitrate(i * 1000, F.array(F.lit(4), i), F.lit(1))).otherwise(RC.nack_bytes(F.array(F.struct((i % 65536).alias("pid"), (i * 3 % 65536).alias("mask"))), F.lit(1), i))
    return RC.rtcp_packets(_events(spark, sf_dir).select("event_id", "user_id", content.alias("content")))


@query("""select event_id, cast(case event_id % 5 when 4 then 205 else 206 end as int) as type, case event_id % 5 when 1 then event_id % 256 end as intra_seq, case event_id % 5 when 2 then (event_id % 8) * 10 + event_id % 4 end as layers,
case event_id % 5 when 3 then event_id * 1000 >> greatest(length(format('{:b}', event_id * 1000)) - 18, 0) << greatest(length(format('{:b}', event_id * 1000)) - 18, 0) end as bitrate, case event_id % 5 when 4 then event_id % 65536 end as pid from events""")
def rtcp_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picture loss, full-intra and layer-refresh requests, bitrate estimates and loss pairs, read back."""
    return _feedback(spark, sf_dir).select("event_id", "type", F.get("full_intra", F.lit(0))["seq"].alias("intra_seq"), (F.get("refresh", F.lit(0))["target_temporal"] * 10 + F.get("refresh", F.lit(0))["target_spatial"]).alias("layers"), F.col("remb.bitrate").alias("bitrate"), F.get("nacks", F.lit(0))["pid"].alias("pid"))


@query("select user_id, bool_or(event_id % 5 < 3) as key_frame from events group by user_id")
def key_frame_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RC.needs_key_frame(_feedback(spark, sf_dir), ["user_id"])


@query("select user_id, cast(max(event_id % 4 * 8 + event_id % 8) // 8 as int) as target_spatial, cast(max(event_id % 4 * 8 + event_id % 8) % 8 as int) as target_temporal from events where event_id % 5 = 2 group by user_id")
def layer_refresh_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RC.refresh_target(_feedback(spark, sf_dir), ["user_id"])


@query("""select event_id, cast(event_id % 65536 as int) as base_seq, cast(i as int) as i, cast(case when (event_id + i) % 3 = 0 then null when (event_id + i) % 7 = 0 then -(event_id % 900) - 1 else (event_id * 31 + i) % 400 end as int) as tick
from (select event_id, unnest(range(event_id % 20 + 1)) as i from events)""")
def twcc_packet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transport feedback packets of one-byte, two-byte and missing ticks, read back."""
    e = F.col("event_id")
    tick = lambda i: F.when((e + i) % 3 == 0, F.lit(None).cast("long")).when((e + i) % 7 == 0, -(e % 900) - 1).otherwise((e * 31 + i) % 400)
    ticks = F.transform(F.sequence(F.lit(0).cast("long"), e % 20), tick)
    coded = _events(spark, sf_dir).select("event_id", RC.transport_feedback(e % 65536, e, e % 256, ticks, F.lit(1), F.lit(2)).alias("content"))
    return RC.rtcp_packets(coded).select("event_id", F.col("twcc.base_seq").alias("base_seq"), F.posexplode("twcc.ticks").alias("i", "tick"))


@query(f"""with {S.UNITS}, k as (select *, sum(case when type = 2 then 1 else 0 end) over (partition by user_id order by event_id) as td, sum(case when type = 2 then 1 else 0 end) over (partition by user_id) as tds from ob)
select user_id, cast(greatest(td - 1, 0) as int) as temporal_unit, count(*) as units from k group by 1, 2""")
def temporal_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams with delimiters, read into temporal units."""
    begun = F.sum(F.when(F.col("type") == 2, 1).otherwise(0)).over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = S.units(spark, sf_dir).select("user_id", "event_id", "type", "t", "s", F.encode("event_type", "utf-8").alias("payload"), F.greatest(begun - 1, F.lit(0)).alias("unit"))
    parts = K.segmented_units(rows, ["user_id"], "unit", F.octet_length("payload").cast("long") + 8, FILE)
    found = K.low_overhead_units(K.low_overhead_stream(parts, ["user_id", "segment", "first_unit"], "event_id")).filter("error is null")
    return found.groupBy("user_id", (F.col("first_unit") + F.col("temporal_unit")).alias("temporal_unit")).agg(F.count(F.lit(1)).alias("units"))


@query(f"with {S.UNITS} select event_id, cast(type as int) as type, cast(t as int) as temporal_id, cast(s as int) as spatial_id, event_type as payload from ob")
def unit_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units without a size get one, and are read as a low-overhead stream."""
    rows = S.units(spark, sf_dir).select("event_id", K.resized(K.unit_bytes(F.col("type"), F.col("t"), F.col("s"), F.encode("event_type", "utf-8"), sized=False)).alias("content"))
    return K.low_overhead_units(rows).select("event_id", "type", "temporal_id", "spatial_id", F.decode("payload", "utf-8").alias("payload"))


@query("with " + S.PACKETS + " select ssrc, ext_seq, last_value(case when ext_seq % 9 = 0 then event_id end ignore nulls) over (partition by ssrc order by ext_seq rows between unbounded preceding and current row) as current from rx")
def descriptor_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The template structure that holds for each packet, of those that carry one."""
    rows = S.received(spark, sf_dir).withColumn("structure", F.when(F.col("ext_seq") % 9 == 0, F.col("event_id")))
    return P.current_structure(rows, "ssrc", "ext_seq", "structure").select("ssrc", "ext_seq", "current")
