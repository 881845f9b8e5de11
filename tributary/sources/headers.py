"""Header units: sequence headers as columns, and metadata units as a tagged union.

Both are syntax with conditions, read with a bit cursor in Arrow batches; each row gives one row, and a fault is data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.sources.bits import Bits
from tributary.sources.containers import _scan, leb128

# --- sequence headers ------------------------------------------------------------------------------

# Level numbers that aren't defined; 31 is "no level", 28 to 30 aren't defined either.
NO_LEVELS = frozenset((2, 3, 6, 7, 10, 11, 20, 21, 22, 23, 24, 25, 26, 27, 28, 29, 30))
# Force flags that leave the choice to the frame, and the description of colours that has no choice of range.
SELECT, IDENTITY_RGB = 2, (1, 13, 0)

_POINT = "struct<idc:int,level:int,tier:int,decoder_delay:long,encoder_delay:long,low_delay:boolean,display_delay:int>"
SEQUENCE = (
    "profile int, still_picture boolean, reduced boolean, units_in_tick long, time_scale long, ticks_per_picture long, buffer_delay_bits int, decoding_tick long, removal_time_bits int, presentation_time_bits int, "
    f"points array<{_POINT}>, max_width int, max_height int, delta_frame_id_bits int, more_frame_id_bits int, large_blocks boolean, filter_intra boolean, intra_edge boolean, interintra boolean, masked boolean, "
    "warped boolean, dual_filter boolean, order_hint_bits int, joint boolean, motion_field boolean, screen_content int, integer_motion int, superres boolean, cdef boolean, restoration boolean, "
    "bit_depth int, monochrome boolean, primaries int, transfer int, matrix int, full_range boolean, subsampling_x boolean, subsampling_y boolean, chroma_position int, separate_uv boolean, film_grain boolean"
)


def _level(b: Bits) -> int:
    level = b.take(5)
    if level in NO_LEVELS:
        raise ValueError("level is not defined")
    return level


def _timing(b: Bits) -> dict:
    if not b.flag():
        return {}
    out = {"units_in_tick": b.take(32), "time_scale": b.take(32)}
    if b.flag():
        out["ticks_per_picture"] = b.uvlc() + 1
    if b.flag():
        out |= {"buffer_delay_bits": b.take(5) + 1, "decoding_tick": b.take(32), "removal_time_bits": b.take(5) + 1, "presentation_time_bits": b.take(5) + 1}
    return out


def _points(b: Bits, delay_bits: int | None) -> Iterator[dict]:
    delayed = b.flag()
    for _ in range(b.take(5) + 1):
        point = {"idc": b.take(12), "level": _level(b), "tier": 0}
        if point["level"] > 7:
            point["tier"] = b.take(1)
        if delay_bits and b.flag():
            point |= {"decoder_delay": b.take(delay_bits), "encoder_delay": b.take(delay_bits), "low_delay": b.flag()}
        if delayed and b.flag():
            point["display_delay"] = b.take(4) + 1
        yield point


def _tools(b: Bits, reduced: bool) -> dict:
    out = {k: b.flag() for k in ("large_blocks", "filter_intra", "intra_edge")}
    out |= {"screen_content": SELECT, "integer_motion": SELECT, "order_hint_bits": 0} | dict.fromkeys(("interintra", "masked", "warped", "dual_filter", "joint", "motion_field"), False)
    if not reduced:
        out |= {k: b.flag() for k in ("interintra", "masked", "warped", "dual_filter")}
        hints = b.flag()
        if hints:
            out |= {"joint": b.flag(), "motion_field": b.flag()}
        out["screen_content"] = SELECT if b.flag() else b.take(1)
        out["integer_motion"] = 0
        if out["screen_content"]:
            out["integer_motion"] = SELECT if b.flag() else b.take(1)
        if hints:
            out["order_hint_bits"] = b.take(3) + 1
    return out | {k: b.flag() for k in ("superres", "cdef", "restoration")}


def _colours(b: Bits, profile: int) -> dict:
    high = b.flag()
    depth = (12 if b.flag() else 10) if high and profile == 2 else 10 if high else 8
    grey = profile != 1 and b.flag()
    described = tuple(b.many(3, 8)) if b.flag() else (2, 2, 2)
    out = dict(zip(("primaries", "transfer", "matrix"), described, strict=True)) | {"bit_depth": depth, "monochrome": grey, "chroma_position": 0, "separate_uv": False}
    if grey:
        return out | {"full_range": b.flag(), "subsampling_x": True, "subsampling_y": True}
    if described == IDENTITY_RGB:
        x, y, full = False, False, True
    else:
        full = b.flag()
        x, y = profile != 1, profile == 0
        if profile == 2 and depth == 12:
            x = b.flag()
            y = x and b.flag()
        if x and y:
            out["chroma_position"] = b.take(2)
    return out | {"full_range": full, "subsampling_x": x, "subsampling_y": y, "separate_uv": b.flag()}


def sequence(data: bytes) -> dict:
    """The fields of a sequence header's payload."""
    b = Bits(data)
    out = {"profile": b.take(3), "still_picture": b.flag(), "reduced": b.flag()}
    if out["profile"] > 2:
        raise ValueError("profile is not defined")
    if out["reduced"] and not out["still_picture"]:
        raise ValueError("a reduced header is for still pictures")
    if out["reduced"]:
        out["points"] = [{"idc": 0, "level": _level(b), "tier": 0}]
    else:
        out |= _timing(b)
        out["points"] = list(_points(b, out.get("buffer_delay_bits")))
    wide, tall = b.take(4) + 1, b.take(4) + 1
    out |= {"max_width": b.take(wide) + 1, "max_height": b.take(tall) + 1}
    if not out["reduced"] and b.flag():
        out |= {"delta_frame_id_bits": b.take(4) + 2, "more_frame_id_bits": b.take(3) + 1}
        if out["delta_frame_id_bits"] + out["more_frame_id_bits"] > 16:
            raise ValueError("frame id of more than 16 bits")
    out |= _tools(b, out["reduced"]) | _colours(b, out["profile"]) | {"film_grain": b.flag()}
    b.trailing()
    return out


def _one(parse: Callable[[bytes], dict]) -> Callable[[bytes], Iterator[dict]]:
    def run(data: bytes) -> Iterator[dict]:
        yield parse(data)

    return run


def sequence_headers(units: DataFrame, content: str = "payload") -> DataFrame:
    """One row per sequence header, its fields as columns and its operating points as an array.

    Fields that a header hasn't got are null, as are those of a faulty one, which has ``error``. A null payload has no row.
    """
    return _scan(units, content, SEQUENCE, _one(sequence))


# --- metadata --------------------------------------------------------------------------------------

# Numbers of the metadata kinds.
KINDS = {1: "light", 2: "mastering", 3: "scalability", 4: "message", 5: "timecode"}
#: Scalability mode that describes its structure itself.
STRUCTURE = 14

_GROUP = "array<struct<temporal_id:int,temporal_up:boolean,spatial_up:boolean,differences:array<int>>>"
METADATA = (
    "type long, kind string, light struct<max_content:int,max_average:int>, mastering struct<primaries:array<struct<x:int,y:int>>,white_x:int,white_y:int,luminance_max:long,luminance_min:long>, "
    f"scalability struct<mode:int,layers:int,dimensions:array<struct<width:int,height:int>>,references:array<int>,group:{_GROUP}>, message struct<country:int,extension:int,payload:binary>, "
    "timecode struct<counting:int,full:boolean,discontinuity:boolean,dropped:boolean,frames:int,seconds:int,minutes:int,hours:int,offset_bits:int,offset:long>, raw binary"
)


def _light(data: bytes) -> dict:
    b = Bits(data)
    out = {"max_content": b.take(16), "max_average": b.take(16)}
    _ended(data[4:])
    return out


def _mastering(data: bytes) -> dict:
    b = Bits(data)
    points = [{"x": b.take(16), "y": b.take(16)} for _ in range(4)]
    out = {"primaries": points[:3], "white_x": points[3]["x"], "white_y": points[3]["y"], "luminance_max": b.take(32), "luminance_min": b.take(32)}
    _ended(data[24:])
    return out


def _ended(rest: bytes) -> bytes:
    """What stands before the byte 0x80 that ends a unit, and the zeros behind that."""
    body = rest.rstrip(b"\0")
    if not body:
        raise ValueError("no trailing bits")
    if body[-1] != 0x80:
        raise ValueError("trailing bits")
    return body[:-1]


def _scalability(data: bytes) -> dict:
    b = Bits(data)
    out = {"mode": b.take(8)}
    if out["mode"] == STRUCTURE:
        layers, sized, described, grouped = b.take(2) + 1, b.flag(), b.flag(), b.flag()
        b.take(3)
        out["layers"] = layers
        if sized:
            out["dimensions"] = [{"width": b.take(16), "height": b.take(16)} for _ in range(layers)]
        if described:
            out["references"] = b.many(layers, 8)
        if grouped:
            out["group"] = [{"temporal_id": b.take(3), "temporal_up": b.flag(), "spatial_up": b.flag(), "differences": b.many(b.take(3), 8)} for _ in range(b.take(8))]
    b.trailing()
    return out


def _message(data: bytes) -> dict:
    size = 2 if data[:1] == b"\xff" else 1
    if len(data) < size:
        raise ValueError("no country code")
    body = data.rstrip(b"\0")
    if len(body) <= size:
        raise ValueError("no trailing bits")
    return {"country": data[0], "extension": data[1] if size == 2 else None, "payload": _ended(body)[size:]}


def _timecode(data: bytes) -> dict:
    b = Bits(data)
    out = {"counting": b.take(5), "full": b.flag(), "discontinuity": b.flag(), "dropped": b.flag(), "frames": b.take(9)}
    for name, width in (("seconds", 6), ("minutes", 6), ("hours", 5)):  # each only behind the one before
        if not out["full"] and not b.flag():
            break
        out[name] = b.take(width)
    out["offset_bits"] = b.take(5)
    out["offset"] = b.take(out["offset_bits"])
    b.trailing()
    return out


_READERS = {1: _light, 2: _mastering, 3: _scalability, 4: _message, 5: _timecode}


def metadata(data: bytes) -> dict:
    """A metadata unit's payload: its type and the record of its kind; that of an unknown kind stays as it is."""
    if not data:
        raise ValueError("short payload")
    kind, at = leb128(data, 0)
    if kind in _READERS:
        return {"type": kind, "kind": KINDS[kind], KINDS[kind]: _READERS[kind](data[at:])}
    if not data[at:].rstrip(b"\0"):
        raise ValueError("no trailing bits")
    return {"type": kind, "raw": data[at:]}


def metadata_units(units: DataFrame, content: str = "payload") -> DataFrame:
    """One row per metadata unit: type, kind, one struct a kind (all null but that of the row's), raw for unknown kinds, error.

    A null payload has no row.
    """
    return _scan(units, content, METADATA, _one(metadata))


def as_variant(rows: DataFrame) -> DataFrame:
    """Metadata rows with the record of each kind in one variant column ``body``; null for unknown kinds."""
    names = list(KINDS.values())
    body = F.coalesce(*[F.when(F.col("kind") == k, F.to_variant_object(F.col(k))) for k in names])
    return rows.withColumn("body", body).drop(*names)


def timed(code: Column) -> Column:
    """A timecode as text; parts that it hasn't got are question marks."""
    part = lambda c: F.coalesce(F.lpad(c.cast("string"), 2, "0"), F.lit("??"))
    return F.concat_ws(":", part(code["hours"]), part(code["minutes"]), part(code["seconds"]), code["frames"].cast("string"))
