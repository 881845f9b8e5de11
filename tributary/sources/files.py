"""Containers as Spark data sources: readers that split files, and writers that commit.

A file is read by places: only headers are read on the way, and payloads where they are asked for. A large
file is cut into parts at records, found by walking over the headers, so that no file has to fit
into one task or one cell; of many files the parts are found by a job of their own, :func:`split_index`.
Small files are bundled: a task reads many of them, and the driver doesn't open them.
Filters on the numbers of a record are pushed into the reader, which leaves out whole parts and reads
no payload of what it skips; columns that the schema given to ``spark.read`` leaves out aren't read.

Writers put files of bounded size into a staging folder, one for each attempt of a task. The driver
moves those of the committed attempts into place, and an abort takes the folder away.

    register(spark)
    frames.write.format("ivf").option("width", 64).mode("append").save(path)
    spark.read.format("ivf").schema("path string, idx int, pts long").load(path)
"""

from __future__ import annotations

import hashlib
import itertools
import operator
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tributary.sources.containers import leb128

#: Bytes of a part of a file, of a written file, read ahead at once, and of a batch.
PART, FILE, AHEAD, BATCH = 128 << 20, 64 << 20, 1 << 16, 8 << 20
#: What opening a file counts for in bytes, the least size of a bundle of files, and how many bundles there are, about, until they have the size of a part.
OPENING, BUNDLE, BUNDLES = 1 << 12, 1 << 20, 200


def opened(path: str) -> tuple[files.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return files.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (files.LocalFileSystem(), path)


class _Source:
    """A file read by places; small reads are served from what was read ahead."""

    def __init__(self, system: files.FileSystem, path: str):
        self.file = system.open_input_file(path)
        self.size, self.at, self.held = self.file.size(), 0, b""

    def take(self, at: int, n: int, what: str) -> bytes:
        if n < 0 or at + n > self.size:
            raise ValueError(f"truncated {what}")
        if not self.at <= at <= at + n <= self.at + len(self.held):
            if n > AHEAD:
                return self.file.read_at(n, at)
            self.at, self.held = at, self.file.read_at(AHEAD, at)
        return self.held[at - self.at : at - self.at + n]

    def number(self, at: int, end: int) -> tuple[int, int]:
        """(value, next place) of a variable-length integer before ``end``."""
        if at < end and (first := self.take(at, 1, "size")[0]) < 128:
            return first, at + 1
        value, size = leb128(self.take(at, min(8, end - at), "size"), 0)
        return value, at + size

    def close(self) -> None:
        self.file.close()


@dataclass
class _Record:
    """Where a record is, what its headers say, and the state with which a reader can begin at it, if it can."""

    start: int
    fields: dict
    place: int
    size: int
    state: tuple | None


class Ivf:
    """Frames of IVF files; the state is the number of the frame."""

    name, suffix = "ivf", ".ivf"
    fields = "width int, height int, timebase_den long, timebase_num long, frame_count long, idx int, offset long, pts long"

    @staticmethod
    def walk(src: _Source, at: int, state: tuple, stop: int) -> Iterator[_Record]:
        mark, _, length, codec, width, height, den, num, count, _ = struct.unpack("<4sHH4sHHIIII", src.take(0, 32, "file header"))
        if mark != b"DKIF" or codec != b"AV01" or length != 32:
            raise ValueError("not an IVF file of this codec")
        at, i = max(at, 32), state[0]
        while at < stop:
            size, pts = struct.unpack("<IQ", src.take(at, 12, "frame header"))
            src.take(at + 12 + size, 0, "frame")
            file = {"width": width, "height": height, "timebase_den": den, "timebase_num": num, "frame_count": count}
            yield _Record(at, file | {"idx": i, "offset": at + 12, "pts": pts}, at + 12, size, (i, 0))
            at, i = at + 12 + size, i + 1

    @staticmethod
    def head(options: dict, count: int) -> bytes:
        width, height, den, num = (int(options.get(k, d)) for k, d in (("width", 0), ("height", 0), ("den", 30), ("num", 1)))
        return struct.pack("<4sHH4sHHIIII", b"DKIF", 0, 32, b"AV01", width, height, den, num, count, 0)

    @staticmethod
    def encoded(rows: Iterator[dict]) -> Iterator[bytes]:
        for r in rows:
            yield struct.pack("<IQ", len(r["payload"]), r["pts"]) + r["payload"]


def _unit(src: _Source, at: int, end: int) -> tuple[dict, int, int]:
    """(fields, place, size) of the unit at a place."""
    first = src.take(at, 1, "unit header")[0]
    if first & 128:
        raise ValueError("forbidden bit is set")
    at, layers = at + 1, 0
    if first >> 2 & 1:
        if at >= end:
            raise ValueError("truncated unit extension")
        layers, at = src.take(at, 1, "unit extension")[0], at + 1
    size = end - at
    if first >> 1 & 1:
        size, at = src.number(at, end)
    if size < 0 or at + size > end:
        raise ValueError("truncated unit")
    return {"type": first >> 3 & 15, "temporal_id": layers >> 5, "spatial_id": layers >> 3 & 3, "has_size": bool(first >> 1 & 1)}, at, size


def _coded(n: int) -> bytes:
    if n < 128:
        return bytes((n,))
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _unit_bytes(row: dict, sized: bool) -> bytes:
    head = bytes([row["type"] << 3 | 4 | sized << 1, row["temporal_id"] << 5 | row["spatial_id"] << 3])
    return head + (_coded(len(row["payload"])) if sized else b"") + row["payload"]


class LowOverhead:
    """Units of low-overhead streams; the state is the numbers of the unit and of the temporal unit before it."""

    name, suffix = "low_overhead_units", ".obu"
    fields = "idx int, offset long, temporal_unit int, type int, temporal_id int, spatial_id int, has_size boolean"

    @staticmethod
    def walk(src: _Source, at: int, state: tuple, stop: int) -> Iterator[_Record]:
        i, tu = state
        while at < stop:
            row, place, size = _unit(src, at, src.size)
            if not row["has_size"]:
                raise ValueError("unit without a size in a low-overhead stream")
            before, tu = tu, tu + (row["type"] == 2)
            yield _Record(at, row | {"idx": i, "offset": at, "temporal_unit": max(tu - 1, 0)}, place, size, (i, before))
            at, i = place + size, i + 1

    head = staticmethod(lambda options, count: b"")

    @staticmethod
    def encoded(rows: Iterator[dict]) -> Iterator[bytes]:
        for r in rows:
            yield _unit_bytes(r, True)


class AnnexB:
    """Units of length-delimited streams; a reader begins at a temporal unit."""

    name, suffix = "annexb_units", ".annexb"
    fields = "idx int, offset long, temporal_unit int, frame_unit int, type int, temporal_id int, spatial_id int, has_size boolean"

    @staticmethod
    def walk(src: _Source, at: int, state: tuple, stop: int) -> Iterator[_Record]:
        i, tu = state
        while at < stop:
            start = at
            size, at = src.number(at, src.size)
            end, frame, fresh = at + size, 0, (i, tu)
            src.take(end, 0, "temporal unit")
            while at < end:
                size, at = src.number(at, end)
                last = at + size
                if last > end:
                    raise ValueError("frame unit beyond its temporal unit")
                while at < last:
                    size, at = src.number(at, last)
                    if at + size > last:
                        raise ValueError("unit beyond its frame unit")
                    row, place, length = _unit(src, at, at + size)
                    yield _Record(start, row | {"idx": i, "offset": at, "temporal_unit": tu, "frame_unit": frame}, place, length, fresh)
                    at, i, fresh = at + size, i + 1, None
                frame += 1
            tu += 1

    head = staticmethod(lambda options, count: b"")

    @staticmethod
    def encoded(rows: Iterator[dict]) -> Iterator[bytes]:
        """A temporal unit of one frame unit for each run of equal ``temporal_unit``."""
        units: list[bytes] = []
        now = None

        def whole() -> bytes:
            frame = b"".join(_coded(len(u)) + u for u in units)
            frame = _coded(len(frame)) + frame
            units.clear()
            return _coded(len(frame)) + frame

        for r in rows:
            if units and r["temporal_unit"] != now:
                yield whole()
            now = r["temporal_unit"]
            units.append(_unit_bytes(r, False))
        if units:
            yield whole()


class Planes:
    """Raw pictures: the planes of each row, one behind the other. Written only: such files are read by :func:`tributary.sources.bench.raw_frames`."""

    name, suffix, fields = "raw_planes", ".yuv", ""
    head = staticmethod(lambda options, count: b"")

    @staticmethod
    def encoded(rows: Iterator[dict]) -> Iterator[bytes]:
        for r in rows:
            yield (r["y"] or b"") + (r["u"] or b"") + (r["v"] or b"")


# --- reading ---------------------------------------------------------------------------------------


@dataclass
class Part(D.InputPartition):
    """Bytes of a file from a record on, the state there, and the number of the record behind the part, if it is known."""

    path: str
    start: int
    stop: int
    state: tuple
    following: int | None


@dataclass
class Bundle(D.InputPartition):
    """Parts that one task reads, one behind the other."""

    parts: list[Part]


def bundled(parts: list[Part], split: int) -> list[Bundle]:
    """Parts in bundles of neighbours; none of several parts is larger than ``split``."""
    sizes = [p.stop - p.start + OPENING for p in parts]
    limit, out, held = min(split, max(BUNDLE, sum(sizes) // BUNDLES)), [], 0
    for part, size in zip(parts, sizes, strict=True):
        if not out or held + size > limit:
            out.append(Bundle([]))
            held = 0
        out[-1].parts.append(part)
        held += size
    return out


def parts_of(format_: type, path: str, split: int, size: int | None = None) -> Iterator[Part]:
    """The parts of a file; a fault ends the walk, and the last part runs into it again. A file whose ``size`` is known to be small isn't opened."""
    if size is not None and size <= split:
        yield Part(path, 0, size, (0, 0), None)
        return
    system, inner = opened(path)
    src = _Source(system, inner)
    start, state = 0, (0, 0)
    if src.size > split:
        try:
            for r in format_.walk(src, 0, state, src.size):
                if r.state is not None and r.start - start >= split:
                    yield Part(path, start, r.start, state, r.state[0])
                    start, state = r.start, r.state
        except (ValueError, struct.error):
            pass
    yield Part(path, start, src.size, state, None)
    src.close()


def sized(path: str, suffix: str) -> list[tuple[str, int]]:
    """The files at or under a path and their sizes, without those whose name begins with a dot or an underscore."""
    system, inner = opened(path)
    info = system.get_file_info(inner)
    if info.type == files.FileType.File:
        return [(path, info.size)]
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    found = [f for f in system.get_file_info(files.FileSelector(inner, recursive=True)) if f.type == files.FileType.File and f.path.endswith(suffix)]
    return sorted((prefix + f.path, f.size) for f in found if not any(x[:1] in "._" for x in f.path[len(inner.rstrip("/")) + 1 :].split("/")))


def listed(path: str, suffix: str) -> list[str]:
    """The files of :func:`sized`."""
    return [f for f, _ in sized(path, suffix)]


_TESTS = {D.EqualTo: operator.eq, D.GreaterThan: operator.gt, D.GreaterThanOrEqual: operator.ge, D.LessThan: operator.lt, D.LessThanOrEqual: operator.le, D.In: lambda a, b: a in b}


class _Reader(D.DataSourceReader):
    def __init__(self, format_: type, schema: StructType, options: dict):
        self.format, self.schema, self.options, self.tests = format_, schema, dict(options), []
        self.numbers = {name for name, kind in (f.split(" ") for f in format_.fields.split(", ")) if kind != "boolean"}

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        for f in filters:
            name = ".".join(getattr(f, "attribute", ()))
            if name in self.numbers and type(f) in _TESTS and f.value is not None:
                self.tests.append((name, type(f).__name__, f.value))
            elif name in self.numbers and isinstance(f, D.IsNotNull):
                self.tests.append((name, "IsNotNull", None))
            else:
                yield f

    def _passing(self) -> Callable[[dict], bool]:
        """Whether a record passes, by its fields."""
        kinds = {c.__name__: t for c, t in _TESTS.items()} | {"IsNotNull": lambda a, b: True}
        tests = [(n, kinds[k], v) for n, k, v in self.tests]

        def passes(fields: dict) -> bool:
            for name, test, value in tests:
                if (x := fields.get(name)) is None or not test(x, value):
                    return False
            return True

        return passes

    def _may_hold(self, part: Part) -> bool:
        """Whether a part can hold records that pass, by the numbers of its first record and of the one behind it."""
        if part.following is None:
            low, high = part.state[0], float("inf")
        else:
            low, high = part.state[0], part.following - 1
        for name, kind, value in self.tests:
            if name == "idx" and kind != "IsNotNull":
                values = value if kind == "In" else [value]
                possible = {"EqualTo": low <= values[0] <= high, "In": any(low <= v <= high for v in values), "GreaterThan": high > values[0], "GreaterThanOrEqual": high >= values[0], "LessThan": low < values[0], "LessThanOrEqual": low <= values[0]}
                if not possible[kind]:
                    return False
        return True

    def partitions(self) -> list[Bundle]:
        split = int(self.options.get("split", PART))
        if "index" in self.options:
            system, inner = opened(self.options["index"])
            rows = pyarrow.parquet.read_table(inner, filesystem=system).to_pylist()
            found = [Part(r["path"], r["start"], r["stop"], (r["idx"], r["unit"]), r["following"]) for r in rows]
        else:
            found = [p for f, size in sized(self.options["path"], self.options.get("suffix", self.format.suffix)) for p in parts_of(self.format, f, split, size)]
        return bundled([p for p in found if self._may_hold(p)], split)

    def read(self, partition: Bundle | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are no parts
            return
        arrow = to_arrow_schema(self.schema)
        columns: dict[str, list] = {n: [] for n in arrow.names}
        held = 0

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)
            for c in columns.values():
                c.clear()
            return out

        def add(row: dict) -> None:
            for n, c in columns.items():
                c.append(row.get(n))

        passes = self._passing()
        for part in partition.parts:
            system, inner = opened(part.path)
            src = _Source(system, inner)
            try:
                for r in self.format.walk(src, part.start, part.state, part.stop):
                    if not passes(r.fields):
                        continue
                    row = r.fields | {"path": part.path, "size": r.size}
                    if "payload" in columns:
                        row["payload"] = src.take(r.place, r.size, "payload")
                        held += r.size
                    add(row)
                    held += 64
                    if held > BATCH:
                        yield batch()
                        held = 0
            except (ValueError, IndexError, struct.error) as e:
                if not self.tests:  # a fault has no numbers, so no test on them holds
                    add({"path": part.path, "error": str(e) or type(e).__name__})
            finally:
                src.close()
        if arrow.names and columns[arrow.names[0]]:
            yield batch()


def split_index(spark: SparkSession, format_: type, paths: list[str], split: int = PART) -> DataFrame:
    """The parts of many files, found in parallel: written as Parquet, its path is the option ``index`` of the reader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = [(p.path, p.start, p.stop, p.state[0], p.state[1], p.following) for p in parts_of(format_, path, split)]
                yield pa.RecordBatch.from_arrays([pa.array(c) if k < 5 else pa.array(c, pa.int64()) for k, c in enumerate(zip(*rows, strict=True))], names=["path", "start", "stop", "idx", "unit", "following"])

    rows = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return rows.mapInArrow(run, "path string, start long, stop long, idx long, unit long, following long")


def file_digests(spark: SparkSession, paths: list[str], block: int = 1 << 20) -> DataFrame:
    """(path, size, sha256, error) of files of any size, read block by block, a file a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                digest, size, error = hashlib.sha256(), 0, None
                try:
                    system, inner = opened(path)
                    with system.open_input_stream(inner) as stream:
                        while data := stream.read(block):
                            digest.update(data)
                            size += len(data)
                except (OSError, pa.ArrowException) as e:
                    error = type(e).__name__
                rows.append((path, size, None, error) if error else (path, size, digest.hexdigest(), None))
            if rows:
                kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "size", "sha256", "error"])

    rows = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return rows.mapInArrow(run, "path string, size long, sha256 string, error string")


# --- writing ---------------------------------------------------------------------------------------


@dataclass
class Written(D.WriterCommitMessage):
    """The staged files of a task, and their names once they are in place."""

    files: list[tuple[str, str]]


class _Writer(D.DataSourceArrowWriter):
    def __init__(self, format_: type, schema: StructType, options: dict, overwrite: bool):
        self.format, self.options, self.overwrite = format_, dict(options), overwrite
        self.staging = f"{self.options['path'].rstrip('/')}/_staging-{uuid.uuid4().hex}"
        self.run = uuid.uuid4().hex[:8]
        # made here, so that a task that outlives an abort finds no folder to write into
        system, inner = opened(self.staging)
        system.create_dir(inner, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, inner = opened(f"{self.staging}/{task.partitionId()}-{task.taskAttemptId()}")
        system.create_dir(inner, recursive=False)
        limit, done = int(self.options.get("file_bytes", FILE)), []

        def save(name: str, count: int, body: bytearray) -> None:
            file = f"{name}-{self.run}-{task.partitionId():05d}-{len(done):05d}{self.format.suffix}"
            with system.open_output_stream(f"{inner}/{file}") as out:
                out.write(self.format.head(self.options, count))
                out.write(body)
            done.append((f"{inner}/{file}", file))

        for name, rows in _by_name(iterator):
            body, count = bytearray(), 0  # one block, which goes back to the system when it is dropped
            for record in self.format.encoded(rows):
                if count and len(body) + len(record) > limit:
                    save(name, count, body)
                    body, count = bytearray(), 0
                body += record
                count += 1
            if count:
                save(name, count, body)
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        system, inner = opened(self.options["path"])
        inner = inner.rstrip("/")
        system.create_dir(inner, recursive=True)
        staged = opened(self.staging)[1]
        if self.overwrite:
            for f in system.get_file_info(files.FileSelector(inner)):
                if not f.path.endswith(staged.rsplit("/", 1)[-1]):
                    system.delete_dir(f.path) if f.type == files.FileType.Directory else system.delete_file(f.path)
        for message in messages:
            for source, name in message.files if message else ():
                system.move(source, f"{inner}/{name}")
        self.abort(messages)
        system.open_output_stream(f"{inner}/_SUCCESS").close()

    def abort(self, messages: list[Written | None]) -> None:
        system, inner = opened(self.staging)
        if system.get_file_info(inner).type == files.FileType.Directory:
            system.delete_dir(inner)


def _by_name(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[dict]]]:
    """Runs of rows of one ``file`` (without that column, all rows); names are taken safe for a path."""

    def cells(c: pa.Array) -> list:
        return c.to_numpy().tolist() if pa.types.is_integer(c.type) and not c.null_count else c.to_pylist()

    def rows() -> Iterator[dict]:
        for b in batches:
            names = b.schema.names
            for k in range(0, len(b), 256):
                for values in zip(*map(cells, b.slice(k, 256).columns), strict=True):
                    yield dict(zip(names, values, strict=True))

    for name, run in itertools.groupby(rows(), key=lambda r: r.get("file")):
        yield "".join(c if c.isalnum() or c in "-." else "_" for c in name or "part"), run


# --- the sources -----------------------------------------------------------------------------------


def _made(format_: type) -> type:
    class Source(D.DataSource):
        @classmethod
        def name(cls) -> str:
            return format_.name

        def schema(self) -> str:
            if not format_.fields:
                raise ValueError(f"{format_.name} is only written")
            return f"path string, {format_.fields}, size long, payload binary, error string"

        def reader(self, schema: StructType) -> D.DataSourceReader:
            return _Reader(format_, schema, self.options)

        def writer(self, schema: StructType, overwrite: bool) -> D.DataSourceWriter:
            return _Writer(format_, schema, self.options, overwrite)

    Source.__name__ = Source.__qualname__ = f"{format_.__name__}Source"
    return Source


FORMATS = (Ivf, LowOverhead, AnnexB, Planes)


def register(spark: SparkSession) -> SparkSession:
    """Make the formats known to a session, with filters pushed down into them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for f in FORMATS:
        spark.dataSource.register(_made(f))
    return spark
