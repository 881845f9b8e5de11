"""Live packet streams: units put together across micro-batches, and a cache of sent packets that answers requests.

Both are stateful processors keyed by stream. What is kept is bounded: the fragments of one open unit, up
to a number of bytes, and a fixed number of slots whose packets grow old. Packets of a stream are
taken in sequence order within a batch, and batches follow each other; a stream that comes in disorder goes through
:func:`tributary.streaming.state.reordered_stream` first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tributary.sources.payloads import _payload

UNITS = "ssrc long, first_seq long, last_seq long, fragments long, new_sequence boolean, data binary, dropped string"
REPAIRS = "ssrc long, seq long, at long, size long, rtx_seq long"


def with_state(spark: SparkSession) -> SparkSession:
    """Set the state store that these processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def elements(payload: bytes | None) -> Iterator[dict]:
    """The elements of a payload up to a fault."""
    try:
        yield from _payload(payload) if payload is not None else ()
    except (ValueError, IndexError):
        return


class Open:
    """A unit whose last fragment hasn't come: what is known of it, and the fragments that the state doesn't hold yet."""

    def __init__(self, first: int, last: int, fragments: int, fresh: bool, size: int, stored: bool):
        self.first, self.last, self.fragments, self.fresh, self.size, self.stored, self.new = first, last, fragments, fresh, size, stored, []

    def add(self, seq: int, element: dict) -> None:
        self.last, self.fragments, self.size = seq, self.fragments + 1, self.size + len(element["data"])
        self.fresh = self.fresh or element["new_sequence"]
        self.new.append(element["data"])


class Reassembly(StatefulProcessor):
    """Units of a stream from the elements of its packets. Emits whole units, and those dropped with the reason."""

    def __init__(self, limit: int, idle_ms: int):
        self.limit, self.idle_ms = limit, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "first long, last long, fragments long, fresh boolean, size long, seen long")
        self.pieces = handle.getListState("pieces", "data binary")

    def _row(self, stream: int, unit: Open, dropped: str | None) -> tuple:
        data = None
        if dropped is None:
            held = [bytes(p[0]) for p in self.pieces.get()] if unit.stored else []
            data = b"".join([*held, *unit.new])
        return stream, unit.first, unit.last, unit.fragments, unit.fresh, data, dropped

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        stream, unit, seen = key[0], None, None
        before = self.head.get() if self.head.exists() else None
        if before is not None:
            seen = before[5]
            if before[0] is not None:
                unit = Open(*before[:5], stored=True)
        out: list[tuple] = []
        packets = pd.concat(list(rows)).sort_values("ext_seq", kind="stable")
        for seq, payload in zip(packets["ext_seq"].tolist(), packets["payload"].tolist(), strict=True):
            if seen is not None and seq <= seen:
                continue  # late or repeated
            if unit is not None and seq != unit.last + 1:
                out.append(self._row(stream, unit, "gap"))
                unit = None
            seen = seq
            for e in elements(None if payload is None else bytes(payload)):
                if not e["continues_previous"]:
                    if unit is not None:
                        out.append(self._row(stream, unit, "interrupted"))
                    unit = Open(seq, seq, 0, False, 0, False)
                elif unit is None:
                    continue  # its beginning was lost
                unit.add(seq, e)
                if unit.size > self.limit:
                    out.append(self._row(stream, unit, "bytes"))
                    unit = None
                elif not e["continues_next"]:
                    out.append(self._row(stream, unit, None))
                    unit = None
        if unit is None or not unit.stored:
            self.pieces.clear()
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if unit is not None:
            self.pieces.appendList([(d,) for d in unit.new])
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        self.head.update((unit.first, unit.last, unit.fragments, unit.fresh, unit.size, seen) if unit else (None, None, None, None, None, seen))
        yield self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        first, last, fragments, fresh, size, seen = self.head.get()
        out = [self._row(key[0], Open(first, last, fragments, fresh, size, True), "idle")] if first is not None else []
        self.pieces.clear()
        self.head.update((None, None, None, None, None, seen))
        yield self._frame(out)

    @staticmethod
    def _frame(out: list[tuple]) -> pd.DataFrame:
        names = [f.split(" ")[0] for f in UNITS.split(", ")]
        return pd.DataFrame({n: pd.Series([r[i] for r in out], dtype="int64" if 0 < i < 4 else "object") for i, n in enumerate(names)})

    def close(self) -> None:
        pass


def live_units(packets: DataFrame, limit: int = 64 << 20, idle: str = "10 seconds") -> DataFrame:
    """Units of a stream of packets (ssrc, ext_seq, payload): whole ones with data, dropped ones with the reason.

    A unit is dropped at a gap in the sequence, when another one begins inside it (``interrupted``), beyond ``limit`` bytes, and when its
    stream is idle. Late and repeated packets are passed over; elements behind a fault in a payload are lost.
    """
    millis = int(pd.Timedelta(idle).total_seconds() * 1000)
    rows = packets.select(F.col("ssrc").cast("long").alias("ssrc"), F.col("ext_seq").cast("long").alias("ext_seq"), "payload")
    return rows.groupBy("ssrc").transformWithStateInPandas(Reassembly(limit, millis), UNITS, "Append", "ProcessingTime")


class Repair(StatefulProcessor):
    """A cache of ``slots`` packets of a stream; requests for those it holds are answered and numbered."""

    def __init__(self, slots: int, ttl_ms: int | None):
        self.slots, self.ttl_ms = slots, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cache = handle.getMapState("cache", "slot int", "seq long, size long", self.ttl_ms)
        self.sent = handle.getValueState("sent", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        n = self.sent.get()[0] if self.sent.exists() else 0
        new: dict[int, tuple[int, int]] = {}
        out = []
        batch = pd.concat(list(rows)).sort_values(["at", "turn", "seq"], kind="stable")
        for at, turn, seq, size in zip(batch["at"].tolist(), batch["turn"].tolist(), batch["seq"].tolist(), batch["size"].tolist(), strict=True):
            slot = seq % self.slots
            if turn == 0:
                new[slot] = (seq, size)
                continue
            held = new.get(slot) or self.cache.getValue((slot,))
            if held is not None and held[0] == seq:
                n += 1
                out.append((key[0], seq, at, int(held[1]), n))
        for slot, (seq, size) in new.items():
            self.cache.updateValue((slot,), (int(seq), int(size)))
        self.sent.update((n,))
        yield pd.DataFrame({c: pd.Series([r[i] for r in out], dtype="int64") for i, c in enumerate(("ssrc", "seq", "at", "size", "rtx_seq"))})

    def close(self) -> None:
        pass


def live_repairs(sent: DataFrame, requests: DataFrame, slots: int = 64, ttl: str | None = "1 minute") -> DataFrame:
    """Answers to a stream of requests (ssrc, seq, at) from a stream of sent packets (ssrc, ext_seq, size).

    A slot holds the last packet stored in it, and nothing once that is older than ``ttl``. ``at`` is the last
    packet sent before a request; within a batch packets come before the requests that follow them.
    """
    stored = sent.select(F.col("ssrc").cast("long").alias("ssrc"), F.col("ext_seq").cast("long").alias("at"), F.lit(0).alias("turn"), F.col("ext_seq").cast("long").alias("seq"), F.col("size").cast("long").alias("size"))
    asked = requests.select(F.col("ssrc").cast("long").alias("ssrc"), F.col("at").cast("long").alias("at"), F.lit(1).alias("turn"), F.col("seq").cast("long").alias("seq"), F.lit(0).cast("long").alias("size"))
    millis = int(pd.Timedelta(ttl).total_seconds() * 1000) if ttl else None
    return stored.unionByName(asked).groupBy("ssrc").transformWithStateInPandas(Repair(slots, millis), REPAIRS, "Append", "ProcessingTime" if ttl else "None")


def played(rows: DataFrame, cut: str, folder: str, live, schema: str) -> DataFrame:
    """Run a live operator over a finished table, a batch for each value of ``cut``; returns what it emitted.

    The batches are written as files in order, read as a stream of one file a trigger, and the results are
    written with a checkpoint, all in ``folder``, which the driver and all executors share.
    """
    spark = rows.sparkSession
    with_state(spark)
    cuts = [r[0] for r in rows.select(cut).distinct().orderBy(cut).collect()]  # a few batches
    held = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.noDataMicroBatches.enabled",)}
    for c in cuts:
        rows.filter(F.col(cut) == c).drop(cut).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.drop(cut).schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    # timers of processing time would otherwise start batches without data for ever
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        run = live(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        run.awaitTermination()
        if run.exception():
            raise run.exception()
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(schema).parquet(f"{folder}/out")
