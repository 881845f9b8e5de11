"""Session-description lines, manifests, logs and other text with fields in it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tributary.functions.columns import normal_category
from tributary.functions.sdp import allows, fmtp, fmtp_text, rtpmap, simulcast


def fragments(size: Column, mtu: int) -> Column:
    """(offset, length, first, last) of the slices of a payload in packets with one byte of header."""
    room = mtu - 1
    n = F.greatest(F.ceil(size / room), F.lit(1)).cast("long")
    return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.struct((i * room).alias("offset"), F.least(size - i * room, F.lit(room)).cast("long").alias("length"), (i == 0).alias("first"), (i == n - 1).alias("last")))


def benchmark_row(line: Column) -> dict[str, Column]:
    """Name, processors and nanoseconds per operation of a benchmark log line; nulls where it is none."""
    shape = r"^Benchmark([A-Za-z0-9_/]+)-(\d+)\s+\d+\s+([0-9.]+) ns/op"
    ok = line.rlike(shape)
    return {"name": F.when(ok, F.regexp_extract(line, shape, 1)), "cpus": F.when(ok, F.regexp_extract(line, shape, 2).cast("int")), "ns": F.when(ok, F.regexp_extract(line, shape, 3).cast("double"))}


__all__ = ["allows", "benchmark_row", "fmtp", "fmtp_text", "fragments", "normal_category", "rtpmap", "simulcast"]
