"""Session-description attributes as column expressions: parsing, checks and canonical text.

Every parser gives nulls for a line that breaks its rules, and ``ok`` says whether it is sound; no
line aborts a job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tributary.functions.columns import let

# Sequence levels that are not defined, directions, and names of restrictions.
UNDEFINED_LEVELS = (2, 3, 6, 7, 10, 11, 20, 21, 22, 23, 24, 25, 26, 27, 28, 29, 30)
DIRECTIONS = ("sendonly", "recvonly", "sendrecv", "inactive")
RESTRICTIONS = ("max-width", "max-height", "max-fps", "max-fs", "max-br", "max-pps")
BLANK = r"\s+"


def _rest(line: Column, attribute: str) -> Column:
    """What follows the attribute's prefix, which may be absent, trimmed."""
    return F.trim(F.regexp_replace(F.trim(line), rf"(?i)^a={attribute}:", ""))


def _fields(text: Column) -> Column:
    return F.filter(F.split(text, BLANK), lambda x: x != "")


def _whole(text: Column) -> Column:
    """A decimal integer with an optional sign; null for anything else."""
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), F.regexp_replace(text, r"^\+", "").try_cast("int"))


def _payload_type(text: Column) -> Column:
    """A payload type of 0 to 127 as it stands; null for anything else."""
    return F.when(text.rlike(r"^[0-9]+$") & F.coalesce(text.try_cast("int") <= 127, F.lit(False)), text)


def _parts(text: Column, separator: str = ";") -> Column:
    return F.filter(F.transform(F.split(text, separator), lambda x: F.trim(x)), lambda x: x != "")


def _key(part: Column) -> Column:
    return F.lower(F.trim(F.substring_index(part, "=", 1)))


def _value(part: Column) -> Column:
    """What follows the first equals sign; null without one."""
    return F.when(F.contains(part, F.lit("=")), F.trim(F.regexp_replace(part, "(?s)^[^=]*=", "")))


def _judged(given: Column, body: Callable[[Column], dict[str, Column]]) -> Column:
    """A struct of the values that ``body`` makes of a column, all null but ``ok`` unless they are sound; each is worked out once."""
    raw = let(given, lambda v: F.struct(*[c.alias(k) for k, c in body(v).items()]))
    names = [k for k in body(given) if k != "ok"]

    def kept(r: Column) -> Column:
        return let(F.coalesce(r["ok"], F.lit(False)), lambda ok: F.struct(*[F.when(ok, r[k]).alias(k) for k in names], ok.alias("ok")))

    return let(raw, kept)


def _named_values(text: Column, separator: str = ";") -> Column:
    """The parts of a list as (key, value); a part without an equals sign has no value."""
    return F.transform(_parts(text, separator), lambda x: F.struct(_key(x).alias("key"), _value(x).alias("value")))


def _first(pairs: Column, name: str) -> tuple[Column, Column]:
    """The first value under a name, and how many there are."""
    found = F.filter(pairs, lambda x: x["key"] == name)
    return F.get(found, 0)["value"], F.size(found)


_FMTP = ("profile", "level_idx", "tier")


def _fmtp(pairs: Column) -> dict[str, Column]:
    def field(name: str, default: int) -> tuple[Column, Column]:
        value, n = _first(pairs, name)
        return F.when(n == 0, default).otherwise(_whole(value)), n <= 1

    (profile, a), (level, b), (tier, c) = field("profile", 0), field("level-idx", 5), field("tier", 0)
    sound = a & b & c & ~F.exists(pairs, lambda x: x["value"].isNull())
    sound &= profile.between(0, 2) & level.between(0, 31) & ~level.isin(*UNDEFINED_LEVELS) & tier.between(0, 1) & ((level > 7) | (tier == 0))
    return dict(zip(_FMTP, (profile, level, tier), strict=True)) | {"ok": sound}


def fmtp(text: Column) -> dict[str, Column]:
    """profile, level_idx, tier and ok of a parameter list; 0, 5 and 0 where absent.

    Names are read in any case and unknown ones are ignored; a part without a value, a repeated
    name, a value that is no integer or not defined makes all of it null.
    """
    found = _judged(_named_values(text), _fmtp)
    return {k: found[k] for k in (*_FMTP, "ok")}


def fmtp_text(profile: Column, level: Column, tier: Column) -> Column:
    return F.format_string("profile=%d; level-idx=%d; tier=%d", profile, level, tier)


def fmtp_struct(line: Column) -> Column:
    """payload_type, the parameters and ok of an ``a=fmtp:`` line."""

    def body(fields: Column) -> dict[str, Column]:
        number = _payload_type(F.get(fields, 0))
        found = _judged(_named_values(F.array_join(F.slice(fields, 2, F.greatest(F.size(fields), F.lit(1))), " ")), _fmtp)
        return {"payload_type": number, "found": found, "ok": (F.size(fields) >= 2) & number.isNotNull()}

    def whole(r: Column) -> Column:
        return let(r["ok"] & F.coalesce(r["found"]["ok"], F.lit(False)), lambda ok: F.struct(F.when(ok, r["payload_type"]).alias("payload_type"), *[F.when(ok, r["found"][k]).alias(k) for k in _FMTP], ok.alias("ok")))

    return let(_judged(_fields(_rest(line, "fmtp")), body), whole)


def fmtp_attribute(line: Column) -> dict[str, Column]:
    """The fields of :func:`fmtp_struct`."""
    found = fmtp_struct(line)
    return {k: found[k] for k in ("payload_type", *_FMTP, "ok")}


def allows(own: dict[str, Column], stream: dict[str, Column]) -> Column:
    """Whether a receiver's parameters admit a stream's: no higher profile, no higher level, tier no higher at its level."""
    order = F.struct(stream["level_idx"].alias("l"), stream["tier"].alias("t")) <= F.struct(own["level_idx"].alias("l"), own["tier"].alias("t"))
    return (stream["profile"] <= own["profile"]) & order


def rtpmap_struct(line: Column) -> Column:
    """payload_type, codec, clock and ok of an ``a=rtpmap:`` line."""

    def body(fields: Column) -> dict[str, Column]:
        number = _payload_type(F.get(fields, 0))
        return {"payload_type": number.cast("int"), "codec": F.substring_index(F.get(fields, 1), "/", 1), "clock": _whole(F.regexp_replace(F.get(fields, 1), "^[^/]*/", "")), "ok": (F.size(fields) == 2) & F.get(fields, 1).rlike("^[^/]*/[^/]*$") & number.isNotNull()}

    found = _judged(_fields(_rest(line, "rtpmap")), body)
    return let(found, lambda r: F.struct(*[F.when(r["clock"].isNotNull(), r[k]).alias(k) for k in ("payload_type", "codec", "clock")], (r["ok"] & r["clock"].isNotNull()).alias("ok")))


def rtpmap(line: Column) -> dict[str, Column]:
    """The fields of :func:`rtpmap_struct` without ok."""
    found = rtpmap_struct(line)
    return {k: found[k] for k in ("payload_type", "codec", "clock")}


def binds_codec(line: Column, codec: str = "AV1", clock: int = 90_000) -> Column:
    """Whether an ``a=rtpmap:`` line binds a payload type to the codec at its clock rate."""
    m = rtpmap(line)
    return F.coalesce((F.upper(m["codec"]) == codec) & (m["clock"] == clock), F.lit(False))


def extmap_struct(line: Column) -> Column:
    """id, direction (empty if not given), uri, attributes and ok of an ``a=extmap:`` line."""

    def body(fields: Column) -> dict[str, Column]:
        token = F.get(fields, 0)
        number = _whole(F.substring_index(token, "/", 1))
        direction = F.when(F.contains(token, F.lit("/")), F.lower(F.regexp_replace(token, "^[^/]*/", ""))).otherwise("")
        rest = F.array_join(F.slice(fields, 3, F.greatest(F.size(fields), F.lit(1))), " ")
        return {"id": number, "direction": direction, "uri": F.get(fields, 1), "attributes": rest, "ok": (F.size(fields) >= 2) & number.between(1, 255) & ((direction == "") | direction.isin(*DIRECTIONS))}

    return _judged(_fields(_rest(line, "extmap")), body)


def extmap(line: Column) -> dict[str, Column]:
    """The fields of :func:`extmap_struct`."""
    found = extmap_struct(line)
    return {k: found[k] for k in ("id", "direction", "uri", "attributes", "ok")}


_LIMITS = tuple(k.replace("-", "_") for k in RESTRICTIONS)


def rid_struct(line: Column) -> Column:
    """id, direction, payload_types, restrictions (0: none) and ok of an ``a=rid:`` line.

    A restriction's name without a value is no limit; unknown or repeated names, and values that are
    not positive, are faults.
    """

    def body(both: Column) -> dict[str, Column]:
        fields, pairs = both["fields"], both["pairs"]
        name, direction = F.get(fields, 0), F.lower(F.get(fields, 1))
        listed, n = _first(pairs, "pt")
        types = F.when(n > 0, F.transform(F.split(listed, ","), lambda x: F.trim(x))).otherwise(F.array().cast("array<string>"))
        ok = (F.size(fields) >= 2) & name.rlike("^[A-Za-z0-9_-]+$") & direction.isin("send", "recv") & (n <= 1) & F.coalesce(~F.array_contains(types, ""), F.lit(False)) & ~F.exists(pairs, lambda x: ~x["key"].isin("pt", *RESTRICTIONS))
        out = {"id": name, "direction": direction, "payload_types": types}
        for k, limit in zip(RESTRICTIONS, _LIMITS, strict=True):
            raw, times = _first(pairs, k)
            out[limit] = F.when(raw.isNull(), 0).otherwise(_whole(raw))
            ok &= (times <= 1) & (raw.isNull() | F.coalesce(_whole(raw) > 0, F.lit(False)))
        return out | {"ok": ok}

    def split(fields: Column) -> Column:
        return F.struct(fields.alias("fields"), _named_values(F.array_join(F.slice(fields, 3, F.greatest(F.size(fields), F.lit(1))), " ")).alias("pairs"))

    return _judged(let(_fields(_rest(line, "rid")), split), body)


def rid(line: Column) -> dict[str, Column]:
    """The fields of :func:`rid_struct`."""
    found = rid_struct(line)
    return {k: found[k] for k in ("id", "direction", "payload_types", *_LIMITS, "ok")}


def rid_allows(limits: dict[str, Column], width: Column, height: Column, fps: Column, bitrate: Column | None = None) -> Column:
    """Whether a frame (and with a bitrate, a coded one) keeps to restrictions; 0 is no limit; null for a frame that is none."""
    samples = width.cast("long") * height

    def under(limit: str, value: Column) -> Column:
        return (limits[limit] <= 0) | (value <= limits[limit])

    fits = under("max_width", width) & under("max_height", height) & under("max_fps", fps) & under("max_fs", samples) & under("max_pps", samples * fps)
    if bitrate is not None:
        fits &= under("max_br", bitrate)
    return F.when((width > 0) & (height > 0) & (fps > 0), fits)


def simulcast_struct(line: Column) -> Column:
    """sent, received and ok of an ``a=simulcast:`` line: lists of alternatives, each with rid and paused; ids differ within a direction."""

    def body(fields: Column) -> dict[str, Column]:
        size = F.size(fields)
        words = F.transform(F.filter(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), lambda i: i % 2 == 0), lambda i: F.lower(F.get(fields, i)))

        def streams(direction: str) -> Column:
            at = F.array_position(words, direction)
            text = F.when(at > 0, F.get(fields, (at * 2 - 1).cast("int")))
            return F.transform(F.split(text, ";"), lambda s: F.transform(F.split(s, ","), lambda x: F.struct(F.regexp_replace(F.trim(x), "^~", "").alias("rid"), F.trim(x).startswith("~").alias("paused"))))

        known = size.isin(2, 4) & (F.size(F.array_distinct(words)) == F.size(words)) & ~F.exists(words, lambda x: ~x.isin("send", "recv"))
        return {"sent": streams("send"), "received": streams("recv"), "ok": known}

    def sound(streams: Column) -> Column:
        ids = F.transform(F.flatten(streams), lambda x: x["rid"])
        return streams.isNull() | (F.forall(ids, lambda i: i.rlike("^[A-Za-z0-9_-]+$")) & (F.size(F.array_distinct(ids)) == F.size(ids)))

    known = _judged(_fields(_rest(line, "simulcast")), body)
    return _judged(known, lambda r: {"sent": r["sent"], "received": r["received"], "ok": r["ok"] & sound(r["sent"]) & sound(r["received"])})


def simulcast_directions(line: Column) -> dict[str, Column]:
    """The fields of :func:`simulcast_struct`."""
    found = simulcast_struct(line)
    return {k: found[k] for k in ("sent", "received", "ok")}


def simulcast(line: Column) -> Column:
    """Lists of alternatives of the send direction of an ``a=simulcast:`` line."""
    return F.transform(simulcast_directions(line)["sent"], lambda s: F.transform(s, lambda x: F.when(x["paused"], F.concat(F.lit("~"), x["rid"])).otherwise(x["rid"])))


def attribute_lines(payload_type: Column, profile: Column, level: Column, tier: Column) -> Column:
    """The codec's map and parameter lines of a payload type."""
    return F.concat_ws("\n", F.concat(F.lit("a=rtpmap:"), payload_type.cast("string"), F.lit(" AV1/90000")), F.concat(F.lit("a=fmtp:"), payload_type.cast("string"), F.lit(" "), fmtp_text(profile, level, tier)))
