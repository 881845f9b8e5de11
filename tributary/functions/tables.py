"""The SQL surface: readers as table functions, and aggregates over small groups, registered by name.

    register(spark)
    spark.sql("SELECT * FROM rtp_elements(TABLE(payloads), 'content')")
    spark.sql("SELECT * FROM rtp_units(TABLE(packets), 'ssrc', 'ext_seq', 'payload')")
    spark.sql("SELECT clip, mean_log_rate(metric, rate) FROM curves GROUP BY clip")

A table function takes any table and the name of its binary column; its result has the other columns, and those of the reader.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from tributary.sources import containers as K
from tributary.sources import descriptor as D
from tributary.sources import headers as H
from tributary.sources import payloads as P
from tributary.sources import rtcp as RC

_ELEMENT = "idx int, continues_previous boolean, continues_next boolean, inferred boolean, new_sequence boolean, data binary"
_IVF = "width int, height int, timebase_den long, timebase_num long, frame_count long, idx int, offset long, pts long, payload binary"
_RTP = "marker boolean, payload_type int, seq int, timestamp long, ssrc long, csrc array<long>, profile int, extensions array<struct<id:int,payload:binary>>, payload binary"


def _one(parse: Callable[[bytes], dict]) -> Callable[[bytes], Iterator[dict]]:
    def run(data: bytes) -> Iterator[dict]:
        yield parse(data)

    return run


#: Readers by name: their columns, and what they make of the bytes of a row.
READERS: dict[str, tuple[str, Callable[[bytes], Iterator[dict]]]] = {
    "ivf_frames": (_IVF, K._ivf),
    "low_overhead_units": (K._UNIT, K._units),
    "annexb_units": (K._UNIT.replace("type int", "frame_unit int, type int"), K._annexb),
    "rtp_packets": (_RTP, K._rtp),
    "rtp_elements": (_ELEMENT, P._payload),
    "rtcp_packets": (RC.FIELDS, RC._rtcp),
    "sequence_headers": (H.SEQUENCE, _one(H.sequence)),
    "metadata_units": (H.METADATA, _one(H.metadata)),
    "layer_allocations": (D.ALLOCATION, _one(D.allocation)),
}


def _others(table: AnalyzeArgument, *named: AnalyzeArgument) -> list[T.StructField]:
    """The columns of a table argument beside the ones named, which must be there."""
    if not table.isTable:
        raise ValueError("the first argument is a table")
    known = table.dataType.fieldNames()
    for argument in named:
        if not argument.isConstantExpression or argument.value not in known:
            raise ValueError(f"no column {argument.value!r} in {known}")
    return [f for f in table.dataType.fields if f.name not in {a.value for a in named}]


def _as_cells(kind: T.DataType, value: object) -> object:
    """Dictionaries of a struct type as rows, at any depth."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return tuple(_as_cells(f.dataType, value.get(f.name)) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return [_as_cells(kind.elementType, v) for v in value]
    return value


def _reader(fields: str, parse: Callable[[bytes], Iterator[dict]]) -> type:
    parsed = T.StructType.fromDDL(f"{fields}, error string")

    class Reader:
        @staticmethod
        def analyze(table: AnalyzeArgument, content: AnalyzeArgument) -> AnalyzeResult:
            kept = _others(table, content)
            clash = {f.name for f in kept} & set(parsed.fieldNames())
            if clash:
                raise ValueError(f"columns of the table are named like those of the reader: {sorted(clash)}")
            return AnalyzeResult(T.StructType([*kept, *parsed.fields]))

        def eval(self, row: Row, content: str) -> Iterator[tuple]:
            kept = tuple(v for k, v in row.asDict(recursive=False).items() if k != content)
            found = iter(parse(bytes(row[content])) if row[content] is not None else ())
            while True:
                try:
                    cells = next(found)
                except StopIteration:
                    return
                except (ValueError, IndexError, struct.error) as e:
                    yield *kept, *[None] * (len(parsed) - 1), str(e) or type(e).__name__
                    return
                yield *kept, *[_as_cells(f.dataType, cells.get(f.name)) for f in parsed.fields]

    return Reader


class Units:
    """Whole units of packets, for each stream by itself and in order: its partitioning is part of the function."""

    @staticmethod
    def analyze(table: AnalyzeArgument, stream: AnalyzeArgument, seq: AnalyzeArgument, payload: AnalyzeArgument) -> AnalyzeResult:
        _others(table, stream, seq, payload)
        kinds = {f.name: f.dataType for f in table.dataType.fields}
        schema = T.StructType().add(stream.value, kinds[stream.value]).add("first_seq", T.LongType()).add("last_seq", T.LongType()).add("fragments", T.LongType()).add("new_sequence", T.BooleanType()).add("data", T.BinaryType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(stream.value)], orderBy=[OrderingColumn(seq.value)])

    def __init__(self):
        self.first = self.last = None
        self.pieces: list[bytes] = []
        self.fresh = False

    def eval(self, row: Row, stream: str, seq: str, payload: str) -> Iterator[tuple]:
        at = row[seq]
        if self.pieces and at != self.last + 1:
            self.pieces = []
        try:
            for e in P._payload(bytes(row[payload])) if row[payload] is not None else ():
                if e["continues_previous"] and not self.pieces:
                    continue
                if not e["continues_previous"]:
                    self.pieces, self.first, self.fresh = [], at, False
                self.pieces.append(e["data"])
                self.last, self.fresh = at, self.fresh or e["new_sequence"]
                if not e["continues_next"]:
                    yield row[stream], self.first, at, len(self.pieces), self.fresh, b"".join(self.pieces)
                    self.pieces = []
        except (ValueError, IndexError):
            return


def mean_log_rate(metric: pa.Array, rate: pa.Array) -> float:
    """The mean of the logarithm of the rate over the range of the metric, on straight lines between the points of a curve; null for less than two metrics."""
    x, y = metric.to_numpy(zero_copy_only=False).astype(float), rate.to_numpy(zero_copy_only=False).astype(float)
    good = np.isfinite(x) & np.isfinite(y) & (y > 0)
    order = np.lexsort((y[good], x[good]))
    x, y = x[good][order], np.log(y[good][order])
    return float((np.diff(x) * (y[1:] + y[:-1]) / 2).sum() / (x[-1] - x[0])) if len(x) > 1 and x[-1] > x[0] else None


def register(spark: SparkSession) -> SparkSession:
    """Register all table functions and aggregates with a session."""
    for name, (fields, parse) in READERS.items():
        spark.udtf.register(name, F.udtf(_reader(fields, parse)))
    spark.udtf.register("rtp_units", F.udtf(Units))

    def of_curve(metric: pa.Array, rate: pa.Array) -> float:
        return mean_log_rate(metric, rate)

    spark.udf.register("mean_log_rate", F.arrow_udf(of_curve, T.DoubleType()))
    return spark
