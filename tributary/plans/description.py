"""Queries over session-description lines: sound and faulty ones, picked by event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions import sdp as D
from tributary.operators import descriptions as N
from tributary.plans.registry import query
from tributary.sources import tables as S

FMTP = [
    "profile=0;level-idx=5;tier=0", "Profile=1; LEVEL-IDX=8", "profile=0;profile=1", "profile=1;junk", "profile=7", "level-idx=x", "", " ; ;tier=0", "tier=0;foo=bar", "profile=+2", "level-idx=32", " tier = 0 ; profile = 2",
    "level-idx=9;tier=1", "level-idx=4;tier=1", "level-idx=20", "tier=", "level-idx=31;tier=1;profile=1", "=3", "profile=1=2",
]
EXTMAP = ["a=extmap:1 urn:x", "extmap:1 urn:x", "A=EXTMAP:2/SendOnly urn:y a b", "a=extmap:0 urn:x", "a=extmap:256 urn:x", "a=extmap:3/up urn:x", "a=extmap:4", " a=extmap:255/inactive  urn:z ", "a=extmap:x urn:x"]
RID = [
    "a=rid:hi send pt=97,98;max-width=1280;max-height=720;max-fps=30", "a=rid:lo recv max-width=320;max-br=100000", "rid:hi send", "a=rid:h! send", "a=rid:a both", "a=rid:a send max-width=0", "a=rid:a send max-width=5;max-width=6", "a=rid:a send max-foo=5",
    "a=rid:m_1 SEND max-pps=9216000;max-fs=921600;max-fps", "a=rid:a send pt=", "a=rid:a", "a=rid:a send pt=97;;max-height=480",
]
SIMULCAST = ["a=simulcast:send a;b,~c recv d", "a=simulcast:recv x", "a=simulcast:send a send b", "a=simulcast:send a;;b", "a=simulcast:up a", "a=simulcast:send", "a=simulcast:SEND ~q", "a=simulcast:send a, recv b"]

def _literal(line: str) -> str:
    return "'" + line.replace("\n", "' || chr(10) || '") + "'"


def _sql(lines: list[str]) -> str:
    return f"(select event_id, ([{', '.join(map(_literal, lines))}])[event_id % {len(lines)} + 1] as line from events)"


def _rows(spark: SparkSession, sf_dir: str, lines: list[str]) -> DataFrame:
    line: Column = F.element_at(F.array(*map(F.lit, lines)), (F.col("event_id") % len(lines) + 1).cast("int"))
    return S.table(spark, sf_dir, "events").select("event_id", line.alias("line"))


def _columns(found: dict[str, Column]) -> list[Column]:
    return [v.alias(k) for k, v in found.items()]


_PARTS = "list_filter(list_transform(string_split(line, ';'), lambda x: trim(x)), lambda x: x <> '')"
_KEYS = "list_transform(p, lambda x: lower(trim(string_split(x, '=')[1])))"


def _of(name: str, default: int) -> str:
    value = f"regexp_extract(list_filter(p, lambda x: lower(trim(string_split(x, '=')[1])) = '{name}')[1], '^[^=]*=\\s*([+-]?[0-9]+)\\s*$', 1)"
    return f"case when not list_contains(k, '{name}') then {default} else try_cast(nullif(replace({value}, '+', ''), '') as int) end"


FMTP_SQL = f""", p as (select event_id, line, {_PARTS} as p from l), k as (select *, {_KEYS} as k from p),
v as (select event_id, p, k, {_of('profile', 0)} as a, {_of('level-idx', 5)} as b, {_of('tier', 0)} as c from k),
o as (select event_id, a, b, c, coalesce(len(list_filter(p, lambda x: strpos(x, '=') = 0)) = 0 and len(list_filter(k, lambda x: x in ('profile', 'level-idx', 'tier'))) = len(list_distinct(list_filter(k, lambda x: x in ('profile', 'level-idx', 'tier'))))
  and a between 0 and 2 and b between 0 and 31 and b not in {D.UNDEFINED_LEVELS} and c between 0 and 1 and (b > 7 or c = 0), false) as ok from v) """


@query(f"with l as {_sql(FMTP)}{FMTP_SQL} select event_id, case when ok then a end as profile, case when ok then b end as level_idx, case when ok then c end as tier, ok from o")
def sdp_fmtp_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, FMTP)
    return rows.select("event_id", *_columns(D.fmtp(F.col("line"))))


@query(f"""with r as {_sql(FMTP)}, l as (select event_id, trim(line) as line from r){FMTP_SQL}, n as (select o.*, trim(line) <> '' and event_id % 150 <= 127 as good, event_id % 150 as pt from o join l using (event_id))
select event_id, case when ok and good then cast(pt as varchar) end as payload_type, case when ok and good then a end as profile, case when ok and good then b end as level_idx, case when ok and good then c end as tier, ok and good as ok from n""")
def sdp_fmtp_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters behind a payload type; types beyond 127 and empty lists are faults."""
    rows = _rows(spark, sf_dir, FMTP).withColumn("line", F.concat(F.lit("A=fmtp:"), F.col("event_id") % 150, F.lit("  "), "line"))
    return rows.select("event_id", *_columns(D.fmtp_attribute(F.col("line"))))


@query(f"""with l as {_sql(EXTMAP)}, m as (select event_id, regexp_extract(line, '(?i)^\\s*(?:a=extmap:)?\\s*([0-9]+)(/([A-Za-z]+))?\\s+(\\S+)\\s*(.*?)\\s*$', ['n', 's', 'd', 'u', 'r']) as m from l),
o as (select event_id, try_cast(m.n as int) as n, lower(m.d) as d, m.u as u, m.r as r from m), k as (select *, coalesce(n between 1 and 255 and d in ('', 'sendonly', 'recvonly', 'sendrecv', 'inactive'), false) as ok from o)
select event_id, case when ok then n end as id, case when ok then d end as direction, case when ok then u end as uri, case when ok then r end as attributes, ok from k""")
def sdp_extmap_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, EXTMAP).select("event_id", *_columns(D.extmap(F.col("line"))))


def _limit(name: str) -> str:
    return f"coalesce(try_cast(nullif(regexp_extract(line, '[; ]{name}=([0-9]+)(;|$)', 1), '') as int), 0)"


RID_SQL = f"""with l as {_sql(RID)}, m as (select event_id, line, regexp_extract(line, '(?i)^a=rid:([A-Za-z0-9_-]+) (send|recv)( (.*))?$', ['n', 'd', 's', 'r']) as m,
 list_filter(string_split(regexp_extract(line, '^\\S+ \\S+ (.*)$', 1), ';'), lambda x: x <> '') as p from l), k as (select *, list_transform(p, lambda x: string_split(x, '=')[1]) as k from m),
o as (select *, m.n <> '' and len(k) = len(list_distinct(k)) and len(list_filter(k, lambda x: x not in ('pt', {', '.join(repr(r) for r in D.RESTRICTIONS)}))) = 0 and len(list_filter(p, lambda x: x like '%=' or x like '%=0')) = 0 as ok from k) """


@query(RID_SQL + "select event_id, case when ok then m.n end as id, case when ok then lower(m.d) end as direction, case when ok then regexp_extract(line, '[; ]pt=([^;]+)', 1) end as payload_types, "
       + ", ".join(f"case when ok then {_limit(r)} end as {r.replace('-', '_')}" for r in D.RESTRICTIONS) + ", ok from o")
def sdp_rid_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.rid(F.col("line"))
    return _rows(spark, sf_dir, RID).select("event_id", *_columns(found | {"payload_types": F.array_join(found["payload_types"], ",")}))


@query(RID_SQL + f""", w as (select event_id, ok, (event_id % 90) * 16 as w, (event_id % 50) * 16 as h, event_id % 61 as f, {', '.join(f"{_limit(r)} as {r[4:]}" for r in D.RESTRICTIONS)} from o)
select event_id, w > 0 and h > 0 and f > 0 and (width = 0 or w <= width) and (height = 0 or h <= height) and (fps = 0 or f <= fps) and (fs = 0 or w * h <= fs) and (pps = 0 or w * h * f <= pps) and (br = 0 or event_id * 10 <= br) as fits from w where ok and w > 0 and h > 0 and f > 0""")
def sdp_rid_allows(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, found = F.col("event_id"), D.rid(F.col("line"))
    rows = _rows(spark, sf_dir, RID).select("event_id", *_columns(found)).filter("ok")
    limits = {k: F.col(k) for k in found}
    return rows.select("event_id", D.rid_allows(limits, i % 90 * 16, i % 50 * 16, i % 61, i * 10).alias("fits")).filter("fits is not null")


@query(f"""with l as {_sql(SIMULCAST)}, m as (select event_id, trim(regexp_replace(line, '^a=simulcast:', '')) as line from l), f as (select event_id, string_split(line, ' ') as f from m),
d as (select event_id, f, len(f) in (2, 4) and len(list_filter([f[1], f[3]], lambda x: lower(x) not in ('send', 'recv'))) = 0 and (len(f) = 2 or lower(f[1]) <> lower(f[3])) and len(list_filter([f[2], f[4]], lambda x: not regexp_full_match(x, '~?[A-Za-z0-9_-]+([;,]~?[A-Za-z0-9_-]+)*'))) = 0 as ok from f)
select event_id, case when ok then case when lower(f[1]) = 'send' then f[2] when lower(f[3]) = 'send' then f[4] end end as sent, case when ok then case when lower(f[1]) = 'recv' then f[2] when lower(f[3]) = 'recv' then f[4] end end as received, ok from d""")
def sdp_simulcast_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.simulcast_directions(F.col("line"))

    def told(streams: Column) -> Column:
        return F.array_join(F.transform(streams, lambda s: F.array_join(F.transform(s, lambda x: F.concat(F.when(x["paused"], "~").otherwise(""), x["rid"])), ",")), ";")

    return _rows(spark, sf_dir, SIMULCAST).select("event_id", told(found["sent"]).alias("sent"), told(found["received"]).alias("received"), found["ok"].alias("ok"))


def _text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A description for each event: directions, ports, payload types, parameters and all kinds of lines vary, and some have faults."""
    e = F.col("event_id")
    pt, other = (96 + e % 20).cast("string"), (96 + (e + 7) % 20).cast("string")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))
    some = lambda when, text: F.when(when, text)
    lines = [
        F.lit("v=0"), some(e % 4 == 1, F.lit("a=inactive")), F.concat(pick(["m=video ", "M=video ", "m=audio "], F.floor(e / 3)), pick(["9", "0", "9/2", "00/2"], F.floor(e / 5)), F.lit(" RTP "), other, F.lit(" "), pt), some(e % 3 != 1, pick(["a=sendonly", "a=recvonly", "A=SendRecv", "a=inactive"], e)),
        F.concat(F.lit("a=rtpmap:"), F.when(e % 11 == 0, "95").otherwise(pt), F.lit(" "), pick(["AV1/90000", "av1/90000", "VP8/90000", "AV1/90000"], F.floor(e / 2))), some(e % 3 > 0, F.concat(F.lit("a=fmtp:"), pt, F.lit(" profile="), F.floor(e / 7) % 4, F.lit(";level-idx="), e % 13)),
        F.concat(F.lit("a=rtcp-fb:"), F.when(e % 5 == 0, "*").otherwise(pt), F.lit(" "), pick(["nack pli", "NACK  PLI", "nack", "ccm fir"], F.floor(e / 6))), F.concat(F.lit("a=extmap:"), e % 260, pick(["", "/sendonly", "/recvonly", "/up"], F.floor(e / 9)), F.lit(" urn:x")),
        F.concat(F.lit("a=rid:hi send pt="), F.when(e % 6 == 0, "1").otherwise(pt), F.lit(";max-width="), e % 2000), some(e % 9 == 0, F.lit("a=rid:hi send")), F.concat(F.lit("a=rid:lo recv max-height="), 1 + e % 1000), F.concat(F.lit("a=simulcast:"), pick(["send hi recv lo", "recv lo", "send lo", "send hi;;lo"], F.floor(e / 4))),
        some(e % 13 == 0, F.concat(F.lit("m=video 9 RTP "), pt, F.lit("\na=rtpmap:"), pt, F.lit(" AV1/90000")))]
    return S.table(spark, sf_dir, "events").select("event_id", F.concat_ws("\r\n", *lines).alias("text"))


_TEXT = """select event_id, concat_ws(chr(13) || chr(10), 'v=0', case when event_id % 4 = 1 then 'a=inactive' end,
 (['m=video ', 'M=video ', 'm=audio '])[event_id // 3 % 3 + 1] || (['9', '0', '9/2', '00/2'])[event_id // 5 % 4 + 1] || ' RTP ' || (96 + (event_id + 7) % 20) || ' ' || (96 + event_id % 20), case when event_id % 3 <> 1 then (['a=sendonly', 'a=recvonly', 'A=SendRecv', 'a=inactive'])[event_id % 4 + 1] end,
 'a=rtpmap:' || case when event_id % 11 = 0 then '95' else (96 + event_id % 20)::varchar end || ' ' || (['AV1/90000', 'av1/90000', 'VP8/90000', 'AV1/90000'])[event_id // 2 % 4 + 1], case when event_id % 3 > 0 then 'a=fmtp:' || (96 + event_id % 20) || ' profile=' || (event_id // 7 % 4) || ';level-idx=' || (event_id % 13) end,
 'a=rtcp-fb:' || case when event_id % 5 = 0 then '*' else (96 + event_id % 20)::varchar end || ' ' || (['nack pli', 'NACK  PLI', 'nack', 'ccm fir'])[event_id // 6 % 4 + 1], 'a=extmap:' || (event_id % 260) || (['', '/sendonly', '/recvonly', '/up'])[event_id // 9 % 4 + 1] || ' urn:x',
 'a=rid:hi send pt=' || case when event_id % 6 = 0 then '1' else (96 + event_id % 20)::varchar end || ';max-width=' || (event_id % 2000), case when event_id % 9 = 0 then 'a=rid:hi send' end, 'a=rid:lo recv max-height=' || (1 + event_id % 1000), 'a=simulcast:' || (['send hi recv lo', 'recv lo', 'send lo', 'send hi;;lo'])[event_id // 4 % 4 + 1],
 case when event_id % 13 = 0 then 'm=video 9 RTP ' || (96 + event_id % 20) || chr(10) || 'a=rtpmap:' || (96 + event_id % 20) || ' AV1/90000' end) as text from events"""

#: The rows of each section's lines, read by patterns: what a line says is read from its text.
SDP_SQL = rf"""with d as ({_TEXT}), l as (select event_id, n, trim(replace(lower(x), chr(13), '')) as line from (select event_id, unnest(string_split(text, chr(10))) as x, unnest(range(len(string_split(text, chr(10))))) as n from d)),
s as (select *, count(*) filter (line like 'm=%') over (partition by event_id order by n) as section from l),
outer_ as (select event_id, arg_max(line, n) as d from s where section = 0 and line in ('a=sendrecv', 'a=sendonly', 'a=recvonly', 'a=inactive') group by 1),
head as (select event_id, section, regexp_extract(line, '^m=(\S+)', 1) as media, not regexp_matches(line, '^m=\S+ 0+(/\S*)?\s') as open, string_split(regexp_extract(line, '^m=\S+\s+\S+\s+\S+\s+(.*)$', 1), ' ') as types from s where line like 'm=%'),
dir as (select event_id, section, arg_max(line, n) as d from s where section > 0 and line in ('a=sendrecv', 'a=sendonly', 'a=recvonly', 'a=inactive') group by 1, 2),
base as (select h.*, substr(coalesce(dir.d, outer_.d, 'a=sendrecv'), 3) as direction from head h left join dir using (event_id, section) left join outer_ using (event_id)),
fm as (select event_id, section, n, regexp_extract(line, '^a=fmtp:(\d+)', 1) as pt, try_cast(regexp_extract(line, 'profile=(\d+)', 1) as int) as profile, try_cast(regexp_extract(line, 'level-idx=(\d+)', 1) as int) as level from s where line like 'a=fmtp:%'),
fmtp as (select *, profile <= 2 and level not in (2, 3, 6, 7, 10, 11) as ok from fm),
pts as (select b.event_id, b.section, b.direction, m.pt, b.types from base b join (select event_id, section, regexp_extract(line, '^a=rtpmap:(\d+) av1/90000$', 1) as pt from s where regexp_matches(line, '^a=rtpmap:\d+ av1/90000$')) m using (event_id, section)
 where media = 'video' and open and list_contains(b.types, m.pt) and not exists (select 1 from fmtp f where f.event_id = b.event_id and f.section = b.section and f.pt = m.pt and not f.ok)),
caps as (select p.*, coalesce(f.profile, 0) as profile, coalesce(f.level, 5) as level from pts p left join fmtp f on f.event_id = p.event_id and f.section = p.section and f.pt = p.pt),
fb as (select event_id, section, regexp_extract(line, '^a=rtcp-fb:(\S+)', 1) as pt from s where regexp_matches(line, '^a=rtcp-fb:\S+\s+nack\s+pli$')),
ext as (select * from (select event_id, section, cast(regexp_extract(line, '^a=extmap:(\d+)', 1) as int) as id, regexp_extract(line, '^a=extmap:\d+/?(\S*) ', 1) as d from s where line like 'a=extmap:% urn:x') where id between 1 and 255 and d in ('', 'sendonly', 'recvonly')),
rid as (select * from (select event_id, section, regexp_extract(line, '^a=rid:(\S+)', 1) as rid, regexp_extract(line, '^a=rid:\S+ (\S+)', 1) as d, nullif(regexp_extract(line, 'pt=(\d+)', 1), '') as pt, cast(coalesce(nullif(regexp_extract(line, 'max-width=(\d+)', 1), ''), '-1') as int) as w, cast(coalesce(nullif(regexp_extract(line, 'max-height=(\d+)', 1), ''), '-1') as int) as h from s where line like 'a=rid:%') where w <> 0 and h <> 0),
kept as (select r.*, count(*) over (partition by r.event_id, r.section, r.rid) as same from rid r join base b using (event_id, section) where r.pt is null or list_contains(b.types, r.pt)),
sim as (select event_id, section, nullif(regexp_extract(line, 'send (\S+)', 1), '') as send, nullif(regexp_extract(line, 'recv (\S+)', 1), '') as recv from s where line like 'a=simulcast:%' and line not like '%;;%'),
x as (select c.*, exists (select 1 from fb where fb.event_id = c.event_id and fb.section = c.section and fb.pt in ('*', c.pt)) as fed, (select min(id) from ext where ext.event_id = c.event_id and ext.section = c.section and case when ext.d = '' then c.direction else ext.d end in ('sendrecv', 'recvonly')) as ext_id,
 exists (select 1 from sim join kept k on k.event_id = sim.event_id and k.section = sim.section and k.same = 1 and ((k.rid = sim.send and k.d = 'send') or (k.rid = sim.recv and k.d = 'recv')) where sim.event_id = c.event_id and sim.section = c.section and (k.pt is null or k.pt = c.pt)) as casts,
 case when exists (select 1 from sim where sim.event_id = c.event_id and sim.section = c.section and send is not null)
  then exists (select 1 from sim join kept k on k.event_id = sim.event_id and k.section = sim.section and k.same = 1 and k.rid = sim.send and k.d = 'send' where sim.event_id = c.event_id and sim.section = c.section and (k.pt is null or k.pt = c.pt) and (k.w < 0 or c.event_id % 1500 + 1 <= k.w))
  else not exists (select 1 from kept k where k.event_id = c.event_id and k.section = c.section and k.same = 1 and k.d = 'send' and (k.pt is null or k.pt = c.pt)) or exists (select 1 from kept k where k.event_id = c.event_id and k.section = c.section and k.same = 1 and k.d = 'send' and (k.pt is null or k.pt = c.pt) and (k.w < 0 or c.event_id % 1500 + 1 <= k.w)) end as frames from caps c),
o as (select event_id, bool_or(direction <> 'inactive') as negotiates, bool_or(direction in ('sendrecv', 'recvonly')) as receives, bool_or(direction in ('sendrecv', 'recvonly') and profile >= 1 and level >= 5) as receives_params, bool_or(direction in ('sendrecv', 'sendonly') and fed) as sends_feedback,
 arg_min(case when direction in ('sendrecv', 'recvonly') then ext_id end, section) filter (direction in ('sendrecv', 'recvonly') and ext_id is not null) as extension_id, bool_or(direction <> 'inactive' and casts) as casts, bool_or(direction in ('sendrecv', 'sendonly') and frames) as sends_frame from x group by 1)
select event_id, coalesce(negotiates, false) as negotiates, coalesce(receives, false) as receives, coalesce(receives_params, false) as receives_params, coalesce(sends_feedback, false) as sends_feedback, extension_id, coalesce(casts, false) as casts, coalesce(sends_frame, false) as sends_frame from (select distinct event_id from base) left join o using (event_id)"""


@query(SDP_SQL)
def sdp_negotiates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which descriptions bind the codec, for which side, with which parameters, feedback, extension, simulcast and frame size."""
    # the table is one file, and parsing is most of the work: deal the rows to all cores first
    found = N.sections(_text(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism), "event_id", "text")
    checks = {"negotiates": ("active", N.bound()), "receives": ("receive", N.bound()), "receives_params": ("receive", N.params(1, 5, 0)), "sends_feedback": ("send", N.feedback(" nack PLI")), "casts": ("active", N.simulcast()), "sends_frame": ("send", N.frame(F.col("id") % 1500 + 1, 1, 30, "send"))}
    return N.negotiated(found, checks, {"extension_id": ("urn:x", "receive")}).withColumnRenamed("id", "event_id")


@query("select event_id, 'a=rtpmap:' || (96 + event_id % 32) || ' AV1/90000' || chr(10) || 'a=fmtp:' || (96 + event_id % 32) || ' profile=' || (event_id % 3) || '; level-idx=' || (event_id % 20) || '; tier=0' as lines from events")
def sdp_emit(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return S.table(spark, sf_dir, "events").select("event_id", D.attribute_lines(96 + i % 32, i % 3, i % 20, F.lit(0)).alias("lines"))


@query("""with m as (select event_id, ([ 'AV1/90000', 'av1/90000', 'VP8/90000', 'AV1/48000', 'AV1', 'AV1/90000/2'])[event_id % 6 + 1] as e, event_id % 140 as pt from events)
select event_id, case when pt <= 127 and event_id % 6 < 4 then cast(pt as int) end as payload_type, pt <= 127 and event_id % 6 < 2 as binds from m""")
def sdp_rtpmap_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in ("AV1/90000", "av1/90000", "VP8/90000", "AV1/48000", "AV1", "AV1/90000/2")])
    line = F.concat(F.lit("a=rtpmap:"), F.col("event_id") % 140, F.lit(" "), F.element_at(kinds, (F.col("event_id") % 6 + 1).cast("int")))
    return S.table(spark, sf_dir, "events").select("event_id", D.rtpmap(line)["payload_type"].alias("payload_type"), D.binds_codec(line).alias("binds"))


@query("""select event_id, case when event_id % 260 between 1 and 255 and event_id % 7 < 6 then 'a=extmap:' || (event_id % 260) || (['', '/sendonly', '/recvonly', '/sendrecv', '/inactive', '/sendonly', '/up'])[event_id % 7 + 1] || ' urn:' || event_type || case when event_id % 2 = 0 then ' a b' else '' end end as extension,
case when event_id % 140 <= 127 or event_id % 5 = 0 then 'a=rtcp-fb:' || case when event_id % 5 = 0 then '*' else (event_id % 140)::varchar end || (case when event_id % 3 = 2 then null else ([' nack pli', ' ccm fir'])[event_id % 3 + 1] end) end as feedback,
case when event_id % 8 > 0 then 'a=rid:r' || event_id || (case when event_id % 2 = 0 then ' send' else ' recv' end) || case when event_id % 3 + event_id % 5 + event_id % 4 = 0 then '' else ' ' || concat_ws(';', case when event_id % 3 > 0 then 'pt=' || array_to_string(list_transform(range(event_id % 3), lambda i: 97 + i), ',') end, case when event_id % 5 > 0 then 'max-width=' || (event_id % 5 * 160) end, case when event_id % 4 > 0 then 'max-br=' || (event_id % 4 * 1000) end) end end as rid,
case when event_id % 6 > 0 then 'a=simulcast:send ' || case when event_id % 2 = 0 then '~' else '' end || 'a' || event_id || case when event_id % 3 = 0 then ';b,c' else '' end || case when event_id % 4 = 0 then ' recv d' else '' end end as simulcast from events""")
def sdp_emit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension, feedback, restriction and simulcast lines written; those that aren't sound are null."""
    e = F.col("event_id")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))
    types = F.transform(F.filter(F.array(F.lit(0), F.lit(1)), lambda i: i < e % 3), lambda i: (97 + i).cast("string"))
    alternative = lambda name, paused: F.struct(name.alias("rid"), paused.alias("paused"))
    none = F.array().cast("array<array<struct<rid:string,paused:boolean>>>")
    first = F.array(F.array(alternative(F.when(e % 6 == 0, "a b").otherwise(F.concat(F.lit("a"), e)), e % 2 == 0)))
    sent = F.when(e % 3 == 0, F.concat(first, F.array(F.array(alternative(F.lit("b"), F.lit(False)), alternative(F.lit("c"), F.lit(False)))))).otherwise(first)
    received = F.when(e % 4 == 0, F.array(F.array(alternative(F.lit("d"), F.lit(False))))).otherwise(none)
    name = F.when(e % 8 == 0, "r!").otherwise(F.concat(F.lit("r"), e))
    return S.table(spark, sf_dir, "events").select(
        "event_id", N.extmap_line(e % 260, F.concat(F.lit("urn:"), "event_type"), pick(["", "SendOnly", "recvonly", "sendrecv", "inactive", " sendonly", "up"], e), F.when(e % 2 == 0, " a b").otherwise("")).alias("extension"),
        N.feedback_line(F.when(e % 5 == 0, "*").otherwise((e % 140).cast("string")), pick(["NACK  pli", "ccm fir ", "a\nb"], e)).alias("feedback"),
        N.rid_line(name, F.when(e % 2 == 0, "SEND").otherwise("recv"), types, {"max-width": e % 5 * 160, "max-br": e % 4 * 1000}).alias("rid"), N.simulcast_line(sent, received).alias("simulcast"))
