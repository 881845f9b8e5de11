"""Ordered packet streams: gaps, loss, reordering, acknowledgement, feedback and repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tributary.functions.columns import clamp
from tributary.operators.scans import levels_of, numbered, states_before


def _stream():
    """The packets of a stream in sequence order (made when used: windows need a session)."""
    return Window.partitionBy("ssrc").orderBy("ext_seq")


def gaps(received: DataFrame) -> DataFrame:
    """(ssrc, first, length) of each run of missing sequence numbers between received ones."""
    rows = received.select("ssrc", "ext_seq").distinct().withColumn("before", F.lag("ext_seq").over(_stream()))
    return rows.filter(F.col("ext_seq") - F.col("before") > 1).select("ssrc", (F.col("before") + 1).alias("first"), (F.col("ext_seq") - F.col("before") - 1).alias("length"))


def gap_report(received: DataFrame) -> DataFrame:
    """Loss per stream: received, expected and lost packets, gaps, the longest gap, loss in percent."""
    rows = received.select("ssrc", "ext_seq").distinct().withColumn("missing", F.col("ext_seq") - F.lag("ext_seq").over(_stream()) - 1)
    out = rows.groupBy("ssrc").agg(
        F.count(F.lit(1)).alias("received"), (F.max("ext_seq") - F.min("ext_seq") + 1).alias("expected"),
        F.count_if(F.col("missing") > 0).alias("gaps"), F.coalesce(F.max("missing"), F.lit(0)).alias("longest_gap"))
    lost = F.col("expected") - F.col("received")
    return out.withColumn("lost", lost).withColumn("loss_pct", F.round(lost * 100.0 / F.col("expected"), 6))


def missing_sequences(received: DataFrame) -> DataFrame:
    """Every missing sequence number."""
    return numbered(gaps(received).withColumn("last", F.col("first") + F.col("length") - 1), "first", "last", "seq").select("ssrc", "seq")


def after_loss(received: DataFrame) -> DataFrame:
    """Packets in order, each with whether one before it is missing."""
    return received.select("ssrc", "ext_seq", F.coalesce(F.col("ext_seq") - F.lag("ext_seq").over(_stream()) > 1, F.lit(False)).alias("after_loss"))


def reordered(arrivals: DataFrame) -> DataFrame:
    """Each packet once, in sequence order, with whether it came after a later one."""
    by_arrival = Window.partitionBy("ssrc").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    rows = arrivals.withColumn("furthest", F.max("ext_seq").over(by_arrival))
    once = rows.groupBy("ssrc", "ext_seq").agg(F.min("arrival").alias("arrival"), F.min_by(F.coalesce(F.col("ext_seq") < F.col("furthest"), F.lit(False)), "arrival").alias("late"), F.count(F.lit(1)).alias("copies"))
    return once.withColumn("position", F.row_number().over(_stream()).cast("long"))


def unwrapped(packets: DataFrame) -> DataFrame:
    """Sequence numbers without wrap-around: a step back of more than half the range is a wrap."""
    order = Window.partitionBy("ssrc").orderBy("event_id")
    wrap = F.when(F.col("seq") - F.lag("seq").over(order) < -32768, 1).otherwise(0)
    return packets.withColumn("wrap", wrap).select("ssrc", "event_id", "seq", (F.sum("wrap").over(order) * 65536 + F.col("seq")).alias("unwrapped"))


#: Sequence numbers of a piece of a stream's losses, and pieces that are folded at once.
LOSSES, PIECES = 1 << 10, 256
#: Sequence numbers that a loss pair covers: its base and the sixteen that follow.
COVERED = 17


def packed_nacks(lost: DataFrame) -> DataFrame:
    """Lost sequence numbers packed greedily into (pid, mask) with a mask of the sixteen that follow.

    Where a pair begins depends on where the one before ended, and so on all losses before it. But what a piece
    of the stream does is a map: from how many of its first numbers are covered already (0 to 16) to how many of the
    next piece's are. Maps are composed piece by piece; then each piece is packed on its own. Losses may be as dense as they like.
    """
    rows = lost.select("ssrc", F.col("seq").cast("long").alias("seq")).filter("seq is not null").distinct().withColumn("piece", F.floor(F.col("seq") / LOSSES))
    pieces = rows.groupBy("ssrc", "piece").agg(F.array_sort(F.collect_list("seq")).alias("seqs"))  # LOSSES at most
    begin = F.col("piece") * LOSSES

    def covered(held: Column) -> Column:
        """The number behind the last one covered, from the number behind those covered at the start."""
        return F.aggregate("seqs", held, lambda end, x: F.when(x < end, end).otherwise(x + COVERED))

    over = lambda c: F.greatest(covered(begin + c) - begin - LOSSES, F.lit(0)).cast("int")
    maps = pieces.select(F.col("ssrc").alias("stream"), F.col("piece").alias("at"), F.transform(F.sequence(F.lit(0), F.lit(COVERED - 1)), over).alias("map"))
    # a piece without losses hands on nothing: what is covered ends within seventeen numbers
    order = Window.partitionBy("stream").orderBy("at")
    next_to = F.coalesce(F.lag("at").over(order) == F.col("at") - 1, F.lit(False))
    none = F.transform(F.sequence(F.lit(0), F.lit(COVERED - 1)), lambda _: F.lit(0))
    linked = maps.withColumn("first", ~next_to).withColumn("place", (F.row_number().over(order) - 1).cast("long"))
    own = F.when(F.col("first"), F.transform(none, lambda _: F.get("map", F.lit(0)))).otherwise(F.col("map"))
    last = linked.agg(F.max("place")).first()[0] or 0
    steps = linked.select("stream", F.col("place").alias("at"), own.alias("map"))
    same = F.sequence(F.lit(0), F.lit(COVERED - 1))
    before = states_before(steps, lambda m, s: F.get(m, s), lambda m, n: F.transform(m, lambda s: F.get(n, s)), same, F.lit(0), "int", levels_of(last, PIECES), PIECES)
    begun = linked.join(before.select("stream", F.col("at").alias("place"), "state"), ["stream", "place"]).select(F.col("stream").alias("ssrc"), F.col("at").alias("piece"), F.when(F.col("first"), 0).otherwise(F.col("state")).alias("state"))
    walk = F.struct((begin + F.col("state")).alias("end"), F.array(begin + F.col("state") - COVERED).alias("starts"))
    step = lambda w, x: F.when(x < w["end"], w).otherwise(F.struct((x + COVERED).alias("end"), F.concat(w["starts"], F.array(x)).alias("starts")))
    packed = pieces.join(begun, ["ssrc", "piece"]).withColumn("starts", F.aggregate("seqs", walk, step)["starts"])
    placed = packed.select("ssrc", F.explode("seqs").alias("seq"), "starts").withColumn("pid", F.array_max(F.filter("starts", lambda p: p <= F.col("seq"))))
    bit = F.when(F.col("seq") > F.col("pid"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("seq") - F.col("pid") - 1).cast("int"))).otherwise(0)
    return placed.groupBy("ssrc", "pid").agg(F.sum(bit).cast("long").alias("mask"))


def expanded_nacks(pairs: DataFrame) -> DataFrame:
    """The sequence numbers of (pid, mask) pairs."""
    held = F.filter(F.sequence(F.lit(0), F.lit(15)), lambda i: F.call_function("shiftright", F.col("mask"), i).bitwiseAND(F.lit(1)) == 1)
    return pairs.select("ssrc", F.explode(F.concat(F.array("pid"), F.transform(held, lambda i: F.col("pid") + i + 1))).alias("seq"))


def repaired(lost: DataFrame, sent: DataFrame, slots: int = 64) -> DataFrame:
    """Lost packets that a cache of ``slots`` slots still holds: a slot keeps the last packet stored in it."""
    cache = sent.groupBy("ssrc", (F.col("ext_seq") % slots).alias("slot")).agg(F.max("ext_seq").alias("seq"), F.max_by("size", "ext_seq").alias("size"))
    found = lost.join(cache, ["ssrc", "seq"])
    return found.select("ssrc", "seq", "size", F.row_number().over(Window.partitionBy("ssrc").orderBy("seq")).cast("long").alias("rtx_seq"))


def feedback(received: DataFrame) -> DataFrame:
    """Every expected sequence number of a stream, whether it was received, and its delta in ticks of 250 us."""
    ranges = received.groupBy("ssrc").agg(F.min("ext_seq").alias("low"), F.max("ext_seq").alias("high"))
    expected = numbered(ranges, "low", "high", "ext_seq").select("ssrc", "ext_seq")
    delta = F.floor((F.col("recv_us") - F.lag("recv_us").over(_stream())) / 250).cast("long")
    seen = received.select("ssrc", "ext_seq", "recv_us").withColumn("delta_ticks", F.coalesce(delta, F.lit(0)))
    return expected.join(seen, ["ssrc", "ext_seq"], "left").select("ssrc", "ext_seq", F.col("recv_us").isNotNull().alias("received"), "delta_ticks")


def timeline(report: DataFrame) -> DataFrame:
    """Receive times since the first packet, by running sum over the received ones."""
    return report.filter("received").select("ssrc", "ext_seq", (F.sum("delta_ticks").over(_stream()) * 250).alias("at_us"))


def feedback_summary(report: DataFrame) -> DataFrame:
    """Counts, first and last received, and the range of deltas per stream."""
    seen = F.when(F.col("received"), F.col("ext_seq"))
    return report.groupBy("ssrc").agg(F.count_if("received").alias("received"), F.count_if(~F.col("received")).alias("missing"), F.min(seen).alias("first_seq"), F.max(seen).alias("last_seq"), F.min("delta_ticks").alias("min_delta"), F.max("delta_ticks").alias("max_delta"))


def clamped_bitrate(packets: DataFrame, low: int, high: int) -> DataFrame:
    """A bitrate estimate per packet held to a range, and split over three layers by weights 1, 2, 3."""
    rate = clamp(F.col("size") * 1000, low, high)
    first, second = F.floor(rate / 6), F.floor(rate * 2 / 6)
    return packets.select("event_id", rate.alias("target"), first.alias("layer0"), second.alias("layer1"), (rate - first - second).alias("layer2"))


def buffer_levels(packets: DataFrame, drain: int, size: int, chunk: int = 512) -> DataFrame:
    """Level of a leaky buffer after each packet: a running sum held to 0..size."""
    return held_sums(packets.select("ssrc", "ext_seq", (F.col("size") - drain).alias("add")), 0, size, chunk)


def rate_levels(packets: DataFrame, budget: int, surplus: int, chunk: int = 512) -> DataFrame:
    """Level of a rate controller's buffer after each frame: its budget less its size is added, held to 24 frames of debt and ``surplus`` of credit."""
    return held_sums(packets.select("ssrc", "ext_seq", (F.lit(budget) - F.col("size")).alias("add")), -24 * budget, max(surplus, 1) * budget, chunk)


def held_sums(steps: DataFrame, low: int, high: int, chunk: int = 512) -> DataFrame:
    """Running sums of ``add`` per stream from 0, held to low..high after each step.

    Clamped additions compose to clamped additions, so chunks of a stream are folded on their own
    first, then the levels between chunks, and last the levels within each chunk.
    """
    rows = steps.select("ssrc", "ext_seq", F.col("add").cast("long").alias("add"), F.floor(F.col("ext_seq") / chunk).alias("chunk"))
    parts = rows.groupBy("ssrc", "chunk").agg(F.array_sort(F.collect_list(F.struct("ext_seq", "add"))).alias("steps"))
    whole = F.struct(F.lit(0).cast("long").alias("add"), F.lit(low).cast("long").alias("low"), F.lit(high).cast("long").alias("high"))

    def composed(m, x):
        return F.struct((m["add"] + x["add"]).alias("add"), clamp(m["low"] + x["add"], low, high).cast("long").alias("low"), clamp(m["high"] + x["add"], low, high).cast("long").alias("high"))

    maps = parts.groupBy("ssrc").agg(F.array_sort(F.collect_list(F.struct("chunk", F.aggregate("steps", whole, composed).alias("map")))).alias("maps"))
    begun = F.array().cast("array<struct<chunk:bigint,before:bigint,after:bigint>>")

    def across(out, x):
        before = F.coalesce(F.try_element_at(out, F.lit(-1))["after"], F.lit(0).cast("long"))
        after = F.least(F.greatest(before + x["map"]["add"], x["map"]["low"]), x["map"]["high"])
        return F.concat(out, F.array(F.struct(x["chunk"].alias("chunk"), before.alias("before"), after.alias("after"))))

    starts = maps.select("ssrc", F.explode(F.aggregate("maps", begun, across)).alias("s")).select("ssrc", "s.chunk", "s.before")
    levels = F.array().cast("array<struct<ext_seq:bigint,level:bigint>>")

    def within(out, x):
        before = F.coalesce(F.try_element_at(out, F.lit(-1))["level"], F.col("before"))
        return F.concat(out, F.array(F.struct(x["ext_seq"].alias("ext_seq"), clamp(before + x["add"], low, high).cast("long").alias("level"))))

    return parts.join(starts, ["ssrc", "chunk"]).select("ssrc", F.explode(F.aggregate("steps", levels, within)).alias("p")).select("ssrc", "p.ext_seq", "p.level")


def repaired_at(requests: DataFrame, sent: DataFrame, slots: int = 64) -> DataFrame:
    """Requested packets (ssrc, seq, at) that a cache of ``slots`` slots holds when they are asked for.

    ``at`` is the last packet sent before the request; a slot keeps the last packet stored in it by
    then. Packets sent again are numbered by stream in the order of the requests.
    """
    stored = sent.select("ssrc", (F.col("ext_seq") % slots).alias("slot"), F.col("ext_seq").alias("at"), F.lit(0).alias("turn"), F.struct(F.col("ext_seq").alias("seq"), "size").alias("stored"), F.lit(None).cast("long").alias("seq"))
    asked = requests.select("ssrc", (F.col("seq") % slots).alias("slot"), "at", F.lit(1).alias("turn"), F.lit(None).cast(stored.schema["stored"].dataType).alias("stored"), "seq")
    order = Window.partitionBy("ssrc", "slot").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)
    found = stored.unionByName(asked).withColumn("held", F.last("stored", ignorenulls=True).over(order)).filter((F.col("turn") == 1) & (F.col("held.seq") == F.col("seq")))
    return found.select("ssrc", "seq", "at", "held.size", F.row_number().over(Window.partitionBy("ssrc").orderBy("at", "seq")).cast("long").alias("rtx_seq"))


def reference_frames(pictures: DataFrame, stream: str, picture: str, slots: str, refreshes: str) -> DataFrame:
    """For each picture and each of its reference slots the last picture that refreshed the slot before; null if none did.

    ``slots`` is an array of slot numbers, ``refreshes`` an array of those that the picture refreshes.
    """
    stored = pictures.select(stream, picture, F.explode(refreshes).alias("slot"), F.lit(1).alias("turn"), F.lit(None).cast("int").alias("place"), F.col(picture).alias("stored"))
    asked = pictures.select(stream, picture, F.posexplode(slots).alias("place", "slot")).select(stream, picture, "slot", F.lit(0).alias("turn"), "place", F.lit(None).cast(pictures.schema[picture].dataType).alias("stored"))
    order = Window.partitionBy(stream, "slot").orderBy(picture, "turn").rowsBetween(Window.unboundedPreceding, 0)
    return stored.unionByName(asked).withColumn("reference", F.last("stored", ignorenulls=True).over(order)).filter("turn = 0").select(stream, picture, "place", "slot", "reference")


def unit_events(units: DataFrame, stream: str, order: str) -> DataFrame:
    """What each unit does: a frame header again after the first of its frame is ignored, a delimiter ends a pending frame."""
    kind = F.col("type")
    last = F.last(F.when(kind.isin(2, 3, 6), kind), ignorenulls=True).over(Window.partitionBy(stream).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    names = {1: "sequence", 2: "delimiter", 3: "frame header", 4: "tiles", 5: "metadata", 6: "frame", 8: "tile list", 15: "padding"}
    event = F.when(kind == 7, F.when(last == 3, "ignored").otherwise("frame header"))
    for number, name in names.items():
        event = event.when(kind == number, name)
    return units.withColumn("event", event.otherwise("reserved"))


def layer_outputs(outputs: DataFrame, keys: list[str], order: str, spatial: str, pinned: int = -1) -> DataFrame:
    """The output of each group that is shown: the last one of the pinned layer (null if there is none), or the last of all; and how many there were."""
    taken = F.when(F.lit(pinned < 0) | (F.col(spatial) == pinned), F.struct(order, spatial))
    return outputs.groupBy(*keys).agg(F.max(taken).alias("t"), F.count(F.lit(1)).alias("completed")).select(*keys, "t.*", "completed")


def sessions(units: DataFrame) -> DataFrame:
    """Runs of units between sequence starts (a sign-up starts a new coded sequence)."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    marked = units.withColumn("session", F.sum(F.when(F.col("event_type") == "signup", 1).otherwise(0)).over(order))
    return marked.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("units"), F.min("event_id").alias("first_unit"), F.max("event_id").alias("last_unit"))


def current_reference(units: DataFrame) -> DataFrame:
    """For each unit the last unit before it that refreshed its reference slot (a purchase does), or null."""
    order = Window.partitionBy("user_id", (F.col("event_id") % 8)).orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    return units.select("event_id", "user_id", (F.col("event_id") % 8).alias("slot"), F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(order).alias("reference"))


def window_rates(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Packets and bytes per time window and type."""
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("packets"), F.sum(F.floor(F.col("value") * 10).cast("long")).alias("bytes")).select(F.unix_micros(F.col("w.start").cast("timestamp")).alias("start_us"), "event_type", "packets", "bytes")
