"""Layer modes, resolutions, frame durations, bit fields and other scalars, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tributary.functions.columns import operating_point_matches

_MODE = r"^(L[123]|S[23])T([123])(h|_KEY|_KEY_SHIFT)?$"
# Coded numbers of the modes that have one.
MODE_NUMBERS = {
    "L1T2": 0, "L1T3": 1, "L2T1": 2, "L2T2": 3, "L2T3": 4, "S2T1": 5, "S2T2": 6, "S2T3": 7, "L2T1h": 8, "L2T2h": 9, "L2T3h": 10, "S2T1h": 11, "S2T2h": 12, "S2T3h": 13,
    "L3T1": 15, "L3T2": 16, "L3T3": 17, "S3T1": 18, "S3T2": 19, "S3T3": 20, "L2T2_KEY": 21, "L2T3_KEY": 22, "L3T2_KEY": 23, "L3T3_KEY": 24, "L2T2_KEY_SHIFT": 25, "L2T3_KEY_SHIFT": 26, "L3T2_KEY_SHIFT": 27, "L3T3_KEY_SHIFT": 28,
}
# The resolution steps between layers, in the order they are tried.
SCALINGS = ((8, 1), (4, 1), (2, 1), (3, 2), (1, 1), (2, 3), (1, 2), (1, 4), (1, 8))
# Names that encoders go by.
ENCODERS = {"aomenc": "aomenc", "libaom": "aomenc", "libaom-av1": "aomenc", "svt-av1": "svt-av1", "svtav1": "svt-av1", "svt": "svt-av1", "svtav1encapp": "svt-av1", "svt-av1encapp": "svt-av1"}


def scalability_mode(name: Column) -> dict[str, Column]:
    """Layers and kind of a mode such as L3T3_KEY, and its coded number; nulls for a name that is none.

    One spatial layer has no variants, separate streams (S) have no key variants, and a shift needs
    more than one temporal layer.
    """
    kind, temporal, variant = (F.regexp_extract(name, _MODE, g) for g in (1, 2, 3))
    spatial = F.substring(kind, 2, 1).cast("int")
    key = variant.startswith("_KEY")
    ok = F.coalesce(name.rlike(_MODE) & ((spatial > 1) | (variant == "")) & ~(kind.startswith("S") & key) & ~((variant == "_KEY_SHIFT") & (temporal == "1")), F.lit(False))
    number = F.try_element_at(F.create_map(*[F.lit(x) for pair in MODE_NUMBERS.items() for x in pair]), name)
    out = {"spatial": spatial, "temporal": temporal.cast("int"), "key": key, "shift": variant == "_KEY_SHIFT", "simulcast": kind.startswith("S"), "small_step": variant == "h", "number": number}
    return {k: F.when(ok, v) for k, v in out.items()} | {"ok": ok}


def resolution_scaling(width: Column, height: Column, to_width: Column, to_height: Column) -> Column:
    """The first step (num, den) that leads from one resolution to the other, up or down; null if there is none."""
    def whole(x: Column, by: int, over: int) -> Column:
        return F.floor(x * by / over)

    out = None
    for num, den in SCALINGS:
        up = (whole(width, num, den) == to_width) & (whole(height, num, den) == to_height)
        down = (whole(to_width, den, num) == width) & (whole(to_height, den, num) == height)
        step = F.struct(F.lit(num).alias("num"), F.lit(den).alias("den"))
        out = F.when(up | down, step) if out is None else out.when(up | down, step)
    return F.when((width > 0) & (height > 0) & (to_width > 0) & (to_height > 0), out)


def profile(text: Column) -> Column:
    return F.when(text.isin("0", "1", "2"), text.cast("int"))


def _gcd(a: Column, b: Column) -> Column:
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, 1).otherwise(s["b"])).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["a"])  # enough for 64 bits


def frame_duration(rate_num: Column, rate_den: Column, base_num: Column, base_den: Column) -> Column:
    """Ticks of a frame as a reduced (num, den); null if either is beyond 31 bits or a rate is not positive."""
    num, den = rate_den.cast("long") * base_den, rate_num.cast("long") * base_num
    ok = (num > 0) & (den > 0)

    def reduced(x: Column) -> Column:
        g = _gcd(x["n"], x["d"])
        return F.struct(F.floor(x["n"] / g).alias("num"), F.floor(x["d"] / g).alias("den"))

    found = F.element_at(F.transform(F.array(F.struct(F.when(ok, num).otherwise(1).alias("n"), F.when(ok, den).otherwise(1).alias("d"))), reduced), 1)
    return F.when(ok & (found["num"] <= 2147483647) & (found["den"] <= 2147483647), found)


def select_operating_point(points: Column, temporal: Column, spatial: Column) -> Column:
    """The first index of the points' bit masks that holds both layers; null if none does."""
    return F.get(F.filter(F.sequence(F.lit(0), F.size(points) - 1), lambda i: operating_point_matches(F.get(points, i), temporal, spatial)), 0)


def encoder_name(name: Column, more: dict[str, str] | None = None) -> Column:
    """The one name of a known encoder, or of one in ``more``; null for others."""
    known = ENCODERS | (more or {})
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), F.lower(F.trim(name)))


def observed_parallelism(wall: Column, user: Column, system: Column) -> Column:
    """Processor seconds a second; null without a positive time."""
    return F.when(wall > 0, (user + system) / wall)


def actual_bps(size: Column, frames: Column, fps: Column) -> Column:
    """Bits a second of a coded clip, rounded down; 0 for nothing coded."""
    return F.when((size > 0) & (frames > 0), F.floor(size.cast("long") * 8 * fps / frames)).otherwise(0).cast("long")


def encode_fps(frames: Column, wall: Column) -> Column:
    return F.when(wall > 0, F.round(frames / wall, 2))


def canonical_sha256(text: Column) -> Column:
    """64 hexadecimal digits in lower case; null for anything else."""
    found = F.lower(F.trim(text))
    return F.when(found.rlike("^[0-9a-f]{64}$"), found)


def is_exact_benchmark(pattern: Column) -> Column:
    return pattern.rlike(r"^\^Benchmark[A-Za-z0-9_]+\$$")


def is_stream_id(text: Column, longest: int = 255) -> Column:
    return text.rlike("^[A-Za-z0-9]+$") & (F.length(text) <= longest)


def selected(levels: Column, labels: Column, level: int, label: int) -> Column:
    """Whether a vector shares a level and a label with the masks; 0 asks for nothing."""
    return (F.lit(level == 0) | (levels.bitwiseAND(F.lit(level)) != 0)) & (F.lit(label == 0) | (labels.bitwiseAND(F.lit(label)) != 0))


def bits(data: Column) -> Column:
    """Bytes as a string of binary digits."""
    digits = F.hex(data)
    return F.array_join(F.transform(F.filter(F.split(digits, ""), lambda x: x != ""), lambda x: F.lpad(F.conv(x, 16, 2), 4, "0")), "")


def read_bits(data: Column, at: Column, n: Column) -> Column:
    """``n`` bits (63 at most) from bit ``at``, high bit first; null beyond the end."""
    return F.when((at + n <= F.octet_length(data) * 8) & n.between(1, 63), F.conv(F.substring(bits(data), at + 1, n), 2, 10).cast("long"))


def uvlc(data: Column) -> Column:
    """A variable-length integer: as many zeros as there are bits behind the first one; null if it doesn't end or has 32 zeros."""
    text = bits(data)
    zeros = F.instr(text, "1") - 1
    ok = zeros.between(0, 31) & (F.length(text) >= zeros * 2 + 1)
    rest = F.when(zeros > 0, F.conv(F.substring(text, zeros + 2, zeros), 2, 10).cast("long")).otherwise(0)
    return F.when(ok, F.call_function("shiftleft", F.lit(1).cast("long"), zeros.cast("int")) - 1 + rest)


def uvlc_bytes(value: Column) -> Column:
    """The coding of an integer, filled up with zeros to whole bytes."""
    text = F.bin(value.cast("long") + 1)
    whole = F.concat(F.repeat(F.lit("0"), F.length(text) - 1), text)
    filled = F.rpad(whole, F.ceil(F.length(whole) / 8).cast("int") * 8, F.lit("0"))
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), (F.length(filled) / 4).cast("int") - 1), lambda i: F.conv(F.substring(filled, i * 4 + 1, F.lit(4)), 2, 16)), ""))


def step_of(buffer: Column, budget: Column) -> Column:
    """How far a buffer level moves the quantiser: four frames' worth a step, held to twelve, toward zero."""
    raw = -buffer * 4 / budget
    return F.least(F.greatest(F.when(raw < 0, F.ceil(raw)).otherwise(F.floor(raw)), F.lit(-12)), F.lit(12)).cast("long")


def key_frame_q(q: Column, budget: Column, buffer: Column, low: Column, high: Column) -> Column:
    """The quantiser of a key frame: lowered by a boost of 12 to 50, which shrinks as the buffer runs dry; two thirds of the range at most while it isn't."""
    horizon = budget * 24
    boost = F.least(F.greatest(F.floor(budget / 1600), F.lit(12)), F.lit(50))
    credit = F.greatest(horizon + buffer, F.lit(0))
    boost = F.when(buffer < 0, F.floor(boost * (horizon * 3 + credit) / (horizon * 4))).otherwise(boost)
    lowered = F.greatest(q - boost, low)
    return F.when(buffer >= 0, F.least(lowered, low + F.floor((high - low) * 2 / 3))).otherwise(lowered).cast("long")


def split_bitrate(target: Column, layers: Column) -> Column:
    """A bitrate over layers in proportion to their targets, or by weights 1, 2, 3 ... if none has one; the last takes what is left."""
    total = F.aggregate(layers, F.lit(0).cast("long"), lambda s, x: s + x)
    weights = F.when(total > 0, F.transform(layers, lambda x: x.cast("long"))).otherwise(F.transform(layers, lambda x, i: (i + 1).cast("long")))
    sum_ = F.aggregate(weights, F.lit(0).cast("long"), lambda s, x: s + x)
    parts = F.transform(weights, lambda w: F.floor(target * w / sum_).cast("long"))
    rest = target - F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), F.lit(0).cast("long"), lambda s, x: s + x)
    return F.transform(parts, lambda x, i: F.when(i == F.size(parts) - 1, rest.cast("long")).otherwise(x))
