"""Session descriptions by rows: a row for each line, parsed once, and a row for each media section; any number of checks in one pass.

A section's maps, parameters, feedback, extensions, restrictions and simulcast lines meet by payload type and by
restriction id. Lines with a fault count for nothing, but parameters with a fault rule their payload type out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions import sdp as D

#: What of a section's direction lets it take part: at all, as a receiver's offer, as a sender's answer.
SIDES = {"active": ("sendrecv", "sendonly", "recvonly"), "receive": ("sendrecv", "recvonly"), "send": ("sendrecv", "sendonly")}
#: The direction of restrictions that bind a side.
RID_SIDES = {"receive": "recv", "send": "send"}

#: A check on a payload type of a section: true, false, or null for no.
Check = Callable[[Column], Column]


def _clean(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"[\r\t\x0b\x0c]", " "))


def _lines(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, section, outer, n, line): the lines of each media section in lower case; ``outer`` is the session's direction."""
    parts = rows.select(F.col(id_col).alias("id"), F.split(F.concat(F.lit("\n"), F.lower(F.col(text_col))), r"\n(?=[ \t\r]*m=)").alias("parts"))
    session = F.transform(F.split(F.get("parts", F.lit(0)), "\n"), _clean)
    outer = F.coalesce(F.try_element_at(F.filter(session, lambda x: x.isin(*[f"a={d}" for d in D.DIRECTIONS])), F.lit(-1)), F.lit("a=sendrecv"))
    sections = parts.withColumn("outer", outer).select("id", "outer", F.posexplode(F.slice("parts", F.lit(2), F.greatest(F.size("parts"), F.lit(1)))).alias("section", "body"))
    return sections.select("id", "section", "outer", F.posexplode(F.split("body", "\n")).alias("n", "line")).withColumn("line", _clean(F.col("line")))


def sections(rows: DataFrame, id_col: str, text_col: str, codec: str = "AV1", clock: int = 90_000) -> DataFrame:
    """A row for each media section of each description: media, open, types, direction, and lists of what its lines say.

    A null description has no sections. Descriptions are told apart by their id, which must differ.
    """
    line, n = F.col("line"), F.col("n")

    def of(name: str) -> Column:
        return line.startswith(f"a={name}:")

    media = D._fields(F.regexp_replace(line, "^m=", ""))
    whole = F.size(media) >= 4
    m = F.struct(F.when(whole, F.get(media, 0)).alias("media"), F.coalesce(whole & F.substring_index(F.get(media, 1), "/", 1).rlike("[^0]"), F.lit(False)).alias("open"), F.slice(media, 4, F.greatest(F.size(media), F.lit(1))).alias("types"))
    feedback, limits = D._fields(D._rest(line, "rtcp-fb")), D._LIMITS
    number = F.get(D._fields(D._rest(line, "fmtp")), 0)
    read = _lines(rows, id_col, text_col).select(
        "id", "section", "outer", "n", F.when((n == 0) & line.startswith("m="), m).alias("m"), F.when(line.isin(*[f"a={d}" for d in D.DIRECTIONS]), line).alias("direction"),
        F.when(of("rtpmap"), D.rtpmap_struct(line)).alias("p"), F.when(of("fmtp"), number).alias("number"), F.when(of("fmtp"), D.fmtp_struct(line)).alias("f"),
        F.when(of("rtcp-fb") & (F.size(feedback) >= 2), F.struct(F.get(feedback, 0).alias("pt"), F.array_join(F.slice(feedback, 2, F.size(feedback)), " ").alias("value"))).alias("feedback"),
        F.when(of("extmap"), D.extmap_struct(line)).alias("x"), F.when(of("rid"), D.rid_struct(line)).alias("r"), F.when(of("simulcast"), D.simulcast_struct(line)).alias("s"))
    parsed = read.select(
        "id", "section", "outer", "n", "m", "direction", F.when((F.upper("p.codec") == codec) & (F.col("p.clock") == clock), F.col("p.payload_type").cast("string")).alias("map"), F.when(F.col("number").isNotNull(), F.struct("n", F.col("number").alias("pt"), F.col("f.ok").alias("ok"), "f.profile", "f.level_idx", "f.tier")).alias("fmtp"), "feedback",
        F.when(F.col("x.ok"), F.struct("n", "x.id", "x.direction", "x.uri")).alias("extension"), F.when(F.col("r.ok"), F.struct("n", "r.id", "r.direction", F.col("r.payload_types").alias("types"), *[F.col(f"r.{k}") for k in limits])).alias("rid"),
        F.when(F.col("s.ok"), F.struct(F.col("s.sent").alias("send"), F.col("s.received").alias("recv"))).alias("simulcast"))
    listed = ("map", "fmtp", "feedback", "extension", "rid", "simulcast")
    out = parsed.groupBy("id", "section").agg(F.first("outer").alias("outer"), F.max("m").alias("m"), F.max_by("direction", F.when(F.col("direction").isNotNull(), n)).alias("direction"), *[F.collect_list(c).alias(c) for c in listed])
    types = F.col("m.types")
    # restrictions on none of the section's payload types count for nothing
    kept = F.filter("rid", lambda r: (F.size(r["types"]) == 0) | F.arrays_overlap(r["types"], types))
    own = F.filter("fmtp", lambda f: F.array_contains(types, f["pt"]))
    bound = F.filter(F.array_distinct("map"), lambda p: F.array_contains(types, p) & ~F.exists(own, lambda f: (f["pt"] == p) & ~f["ok"]))
    return out.select("id", "section", F.col("m.media").alias("media"), F.col("m.open").alias("open"), F.substring(F.coalesce("direction", "outer"), 3, 20).alias("direction"), bound.alias("bound"), F.array_sort(own).alias("fmtp"), "feedback", F.array_sort("extension").alias("extension"), F.array_sort(kept).alias("rid"), "simulcast")


# --- checks ----------------------------------------------------------------------------------------


def bound() -> Check:
    """The codec is bound."""
    return lambda p: F.lit(True)


def params(profile: Column | int, level: Column | int, tier: Column | int) -> Check:
    """The parameters of the payload type, or the defaults, admit a stream."""
    column = lambda x: x if isinstance(x, Column) else F.lit(x)
    stream = {"profile": column(profile), "level_idx": column(level), "tier": column(tier)}
    sound = stream["profile"].between(0, 2) & stream["level_idx"].between(0, 31) & ~stream["level_idx"].isin(*D.UNDEFINED_LEVELS) & stream["tier"].between(0, 1) & ((stream["level_idx"] > 7) | (stream["tier"] == 0))

    def check(p: Column) -> Column:
        given = F.try_element_at(F.filter("fmtp", lambda f: f["pt"] == p), F.lit(-1))
        own = {k: F.coalesce(given[k], F.lit(d)) for k, d in (("profile", 0), ("level_idx", 5), ("tier", 0))}
        return sound & D.allows(own, stream)

    return check


def feedback(value: str) -> Check:
    """A feedback is declared for the payload type or for all."""
    wanted = " ".join(value.lower().split())
    return lambda p: F.exists("feedback", lambda f: f["pt"].isin("*") & (f["value"] == wanted) | (f["pt"] == p) & (f["value"] == wanted)) & F.lit(bool(wanted))


def extension_id(uri: str, side: str) -> Column:
    """The id of a header extension in a direction that suits the side; null if a section hasn't got it."""
    wanted = uri.strip().lower()
    suits = lambda x: F.when(x["direction"] == "", F.col("direction")).otherwise(x["direction"]).isin(*SIDES[side])
    return F.get(F.filter("extension", lambda x: (x["uri"] == wanted) & suits(x)), F.lit(0))["id"]


def extension(uri: str, side: str) -> Check:
    return lambda p: extension_id(uri, side).isNotNull()


def _restriction(id_: Column, direction: str) -> Column:
    """The restriction with an id and direction; null if another has the same id."""
    same = F.filter("rid", lambda r: r["id"] == id_)
    return F.when(F.size(same) == 1, F.get(F.filter(same, lambda r: r["direction"] == direction), F.lit(0)))


def _streams(direction: str) -> Column:
    """The restriction ids of the one simulcast line's direction; null if there is none."""
    return F.when(F.size("simulcast") == 1, F.transform(F.flatten(F.get("simulcast", F.lit(0))[direction]), lambda x: x["rid"]))


def _suits(r: Column, p: Column) -> Column:
    return r.isNotNull() & ((F.size(r["types"]) == 0) | F.array_contains(r["types"], p))


def simulcast(direction: str = "") -> Check:
    """A stream of the one simulcast line has a restriction of its own for the payload type; of either direction if none is given."""

    def one(p: Column, d: str) -> Column:
        return F.coalesce(F.exists(_streams(d), lambda i: _suits(_restriction(i, d), p)), F.lit(False))

    return lambda p: one(p, direction) if direction else one(p, "send") | one(p, "recv")


def frame(width: Column | int, height: Column | int, fps: Column | int, side: str, bitrate: Column | int | None = None) -> Check:
    """A frame fits some restriction of the side: of its simulcast streams if there are such, else of any; without restrictions all fit."""
    direction = RID_SIDES[side]
    column = lambda x: x if isinstance(x, Column) else F.lit(x)

    def fits(r: Column) -> Column:
        limits = {k.replace("-", "_"): r[k.replace("-", "_")] for k in D.RESTRICTIONS}
        return F.coalesce(D.rid_allows(limits, column(width), column(height), column(fps), None if bitrate is None else column(bitrate)), F.lit(False))

    def check(p: Column) -> Column:
        streams = _streams(direction)
        alone = F.filter("rid", lambda r: (r["direction"] == direction) & _suits(r, p) & (F.size(F.filter("rid", lambda q: q["id"] == r["id"])) == 1))
        of_streams = F.exists(streams, lambda i: _suits(_restriction(i, direction), p) & F.coalesce(fits(_restriction(i, direction)), F.lit(False)))
        return F.when(streams.isNotNull(), of_streams).otherwise((F.size(alone) == 0) | F.exists(alone, fits))

    return check


def negotiated(found: DataFrame, checks: dict[str, tuple[str, Check]], ids: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """A row for each description that has sections: id, a boolean for each check, and the id of each extension asked for (null if it isn't there).

    ``found`` are :func:`sections`; a check is (side, check) and holds if it does for a bound payload type of an open
    video section whose direction suits the side. ``ids`` are (uri, side).
    """
    video = (F.col("media") == "video") & F.col("open")

    def holds(side: str, check: Check) -> Column:
        return F.coalesce(video & F.col("direction").isin(*SIDES[side]) & F.exists("bound", lambda p: F.coalesce(check(p), F.lit(False))), F.lit(False))

    out = [F.bool_or(holds(side, check)).alias(name) for name, (side, check) in checks.items()]
    for name, (uri, side) in (ids or {}).items():
        number = F.when(video & F.col("direction").isin(*SIDES[side]) & (F.size("bound") > 0), extension_id(uri, side))
        out.append(F.min_by(number, F.when(number.isNotNull(), F.col("section"))).alias(name))
    return found.groupBy("id").agg(*out)


# --- emission --------------------------------------------------------------------------------------


def extmap_line(number: Column, uri: Column, direction: Column, attributes: Column) -> Column:
    """An ``a=extmap:`` line; empty directions and attributes are left out; null for one that isn't sound."""
    where = F.lower(F.trim(direction))
    line = F.concat(F.lit("a=extmap:"), number.cast("string"), F.when(where != "", F.concat(F.lit("/"), where)).otherwise(""), F.lit(" "), F.trim(uri), F.when(F.trim(attributes) != "", F.concat(F.lit(" "), F.trim(attributes))).otherwise(""))
    return F.when(number.between(1, 255) & (F.trim(uri) != "") & ((where == "") | where.isin(*D.DIRECTIONS)), line)


def feedback_line(payload_type: Column, value: Column) -> Column:
    """An ``a=rtcp-fb:`` line for a payload type or ``*``, its words in lower case; null for one that isn't sound."""
    words = D._fields(F.lower(F.trim(value)))
    sound = ((payload_type == "*") | D._payload_type(payload_type).isNotNull()) & (F.size(words) > 0) & ~value.rlike("[\r\n]") & F.forall(words, lambda w: w.rlike("^[!#$%&'*+.^_`{|}~0-9a-z-]+$"))
    return F.when(sound, F.concat(F.lit("a=rtcp-fb:"), payload_type, F.lit(" "), F.array_join(words, " ")))


def rid_line(id_: Column, direction: Column, types: Column, limits: dict[str, Column]) -> Column:
    """An ``a=rid:`` line; limits of 0 and empty lists are left out; null for one that isn't sound."""
    parts = [F.when(F.size(types) > 0, F.concat(F.lit("pt="), F.array_join(F.transform(types, lambda t: F.trim(t)), ",")))]
    parts += [F.when(limits[k] > 0, F.concat(F.lit(f"{k}="), limits[k].cast("string"))) for k in D.RESTRICTIONS if k in limits]
    rest = F.concat_ws(";", *parts)
    sound = id_.rlike("^[A-Za-z0-9_-]+$") & F.lower(F.trim(direction)).isin("send", "recv") & ~F.exists(types, lambda t: F.trim(t) == "")
    for v in limits.values():
        sound &= v >= 0
    return F.when(sound, F.concat(F.lit("a=rid:"), id_, F.lit(" "), F.lower(F.trim(direction)), F.when(rest != "", F.concat(F.lit(" "), rest)).otherwise("")))


def simulcast_line(sent: Column, received: Column) -> Column:
    """An ``a=simulcast:`` line of lists of alternatives (rid, paused); null if there are none, or an id is empty, faulty or repeated."""
    def told(streams: Column, name: str) -> Column:
        one = lambda x: F.concat(F.when(x["paused"], "~").otherwise(""), x["rid"])
        return F.when(F.size(streams) > 0, F.concat(F.lit(f"{name} "), F.array_join(F.transform(streams, lambda s: F.array_join(F.transform(s, one), ",")), ";")))

    def sound(streams: Column) -> Column:
        ids = F.transform(F.flatten(streams), lambda x: x["rid"])
        return (F.size(streams) == 0) | (F.forall(streams, lambda s: F.size(s) > 0) & F.forall(ids, lambda i: i.rlike("^[A-Za-z0-9_-]+$")) & (F.size(F.array_distinct(ids)) == F.size(ids)))

    return F.when((F.size(sent) + F.size(received) > 0) & sound(sent) & sound(received), F.concat(F.lit("a=simulcast:"), F.concat_ws(" ", told(sent, "send"), told(received, "recv"))))
