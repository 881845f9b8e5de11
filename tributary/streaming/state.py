"""Stateful packet streams: reordering within a window, and rates per window of event time.

The state of a stream is bounded: at most ``slots`` packets ahead of the next one are held, and a
packet beyond that window makes the stream jump, which marks the next row as after a loss.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "ssrc long, ext_seq long, size long, after_loss boolean"
STATE = "next long, held_seq array<long>, held_size array<long>, lost boolean"


def release(next_seq: int | None, held: dict[int, int], lost: bool, seq: int, size: int, slots: int) -> tuple[int, bool, list[tuple[int, int, bool]]]:
    """Take in one packet: (next expected, whether a loss is pending, released rows). ``held`` is changed.

    Packets before the next expected one are late or repeated and are dropped.
    """
    out: list[tuple[int, int, bool]] = []
    if next_seq is None:
        next_seq = seq
    if seq < next_seq or seq in held:
        return next_seq, lost, out
    held[seq] = size
    while held and max(held) - next_seq >= slots:  # beyond the window: give up on what is missing
        first = min(held)
        if first > next_seq:
            next_seq, lost = first, True
        while next_seq in held:
            out.append((next_seq, held.pop(next_seq), lost))
            next_seq, lost = next_seq + 1, False
    while next_seq in held:
        out.append((next_seq, held.pop(next_seq), lost))
        next_seq, lost = next_seq + 1, False
    return next_seq, lost, out


def flush(next_seq: int, held: dict[int, int], lost: bool) -> list[tuple[int, int, bool]]:
    """Release all held packets, each run behind a gap marked."""
    out = []
    for seq in sorted(held):
        lost = lost or seq > next_seq
        out.append((seq, held[seq], lost))
        next_seq, lost = seq + 1, False
    return out


def reordered_stream(packets: DataFrame, slots: int = 32, idle: str = "10 seconds", order: str = "arrival") -> DataFrame:
    """A stream of (ssrc, ext_seq, size, ...) packets in sequence order, each once, with after_loss.

    Within a batch packets are taken by ``order``. A stream that is idle for ``idle`` releases what it holds.
    """
    millis = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        next_seq, lost, held = None, False, {}
        if state.exists:
            next_seq, seqs, sizes, lost = state.get
            held = dict(zip(seqs, sizes, strict=True))
        out: list[tuple[int, int, bool]] = []
        if state.hasTimedOut:
            out = flush(next_seq, held, lost)
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values(order)
            for seq, size in zip(rows["ext_seq"].tolist(), rows["size"].tolist(), strict=True):
                next_seq, lost, done = release(next_seq, held, lost, seq, size, slots)
                out += done
            state.update((next_seq, list(held), list(held.values()), lost))
            state.setTimeoutDuration(millis)
        yield pd.DataFrame({"ssrc": [key[0]] * len(out), "ext_seq": [r[0] for r in out], "size": [r[1] for r in out], "after_loss": [r[2] for r in out]})

    return packets.groupBy("ssrc").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def reordered_batch(packets: DataFrame, slots: int = 32, order: str = "arrival") -> DataFrame:
    """The same over a finished table: each stream is taken in order of arrival and flushed at its end."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # the streams of a task follow each other; only the window of one is held
        stream, next_seq, lost, held = None, None, False, {}
        for rows in frames:
            out: list[tuple[int, int, int, bool]] = []
            for ssrc, seq, size in zip(rows["ssrc"].tolist(), rows["ext_seq"].tolist(), rows["size"].tolist(), strict=True):
                if ssrc != stream:
                    out += [(stream, *r) for r in flush(next_seq or 0, held, lost)]
                    stream, next_seq, lost, held = ssrc, None, False, {}
                next_seq, lost, done = release(next_seq, held, lost, seq, size, slots)
                out += [(ssrc, *r) for r in done]
            yield pd.DataFrame(out, columns=["ssrc", "ext_seq", "size", "after_loss"])
        yield pd.DataFrame([(stream, *r) for r in flush(next_seq or 0, held, lost)], columns=["ssrc", "ext_seq", "size", "after_loss"])

    rows = packets.select("ssrc", "ext_seq", "size", order).repartition("ssrc").sortWithinPartitions("ssrc", order)
    return rows.mapInPandas(run, OUT)


def windowed_rates(packets: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Packets and bytes per window of event time, as a stream with a watermark; late rows are dropped."""
    from pyspark.sql import functions as F

    return packets.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("packets"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "packets", "total")
