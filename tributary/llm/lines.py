"""Line dedup: lines that many documents hold are dropped everywhere.

Lines are counted by 128-bit hashes, once a document, and added up before any shuffle. Over the
distinct hashes of the lines that reach the threshold a minimal perfect hash is built in shards of
bounded size: in each level of a shard the keys that have a bit to themselves are placed, the others
go on to the next level, and a key's number is the count of set bits before its own. The numbers
index an array of fingerprints and one of counts, each of the least width that holds its values.

Documents probe these arrays, and lines are never joined. A small index is sent to all tasks and
documents don't move at all; for a larger one the hashes travel to the shards, hot shards being dealt
to several tasks, and only the hits come back.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from tributary.llm.hashing import U64, mixed, text_runs
from tributary.llm.native import BLANKS
from tributary.llm.scratch import dropped, written

#: Keys of a shard, on average, and bits of a level for each key still to be placed.
SHARD_KEYS, BITS_PER_KEY = 1 << 15, 2
#: An index of at most so many bytes is sent to all tasks.
SENT_BYTES = 64 << 20
#: Probes of a shard that one task takes, about.
TASK_PROBES = 1 << 22
#: Distinct lines that a task counts before it hands them on.
COUNTED = 1 << 17

_BLANKS = BLANKS.encode()
_STEP = 0x9E3779B97F4A7C15
_ONE = U64(1)
_INDEX = "shard long, sizes array<long>, bits binary, prints binary, counts binary, width int"


def keys_of(text: bytes, min_chars: int) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text, and the hash of each line's key, None for keys that are too short."""
    lines = text.split(b"\n")
    hashes: list[bytes | None] = []
    for line in lines:
        key = line.strip(_BLANKS).lower()
        long_enough = len(key) >= min_chars and (min_chars < 2 or len(key.decode("utf-8", "replace")) >= min_chars)
        hashes.append(xxh3_128_digest(key) if long_enough else None)
    return lines, hashes


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _counted(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def rows() -> pa.RecordBatch:
        hi, lo = _halves(list(seen))
        out = pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo), pa.array(list(seen.values()), pa.int64())], names=["hi", "lo", "n"])
        seen.clear()
        return out

    for batch in batches:
        for text in _texts(batch.column(0)):
            seen.update(set(keys_of(text, min_chars)[1]) - {None})
            if len(seen) >= COUNTED:
                yield rows()
    yield rows()


def _texts(column: pa.Array) -> Iterator[bytes]:
    """The bytes of each text, those of a null being none."""
    for i, j, data, offsets in text_runs(column):
        whole = data.tobytes()
        for k in range(j - i):
            yield whole[offsets[k] : offsets[k + 1]]


def line_counts(docs: DataFrame, text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """(hi, lo, n) for each distinct line: its hash in two longs, and the number of rows that hold it."""
    counted = docs.select(text_col).mapInArrow(lambda it: _counted(it, min_chars), "hi long, lo long, n long")
    return counted.groupBy("hi", "lo").agg(F.sum("n").alias("n"))


def _place(hi: np.ndarray, lo: np.ndarray, level: int, size: np.ndarray | int) -> np.ndarray:
    """The bit of each key in a level of ``size`` bits."""
    mix = mixed(hi.view(U64) ^ mixed(lo.view(U64) + U64((level + 1) * _STEP % (1 << 64))))
    return (((mix >> U64(32)) * np.asarray(size).astype(U64)) >> U64(32)).astype(np.int64)


def shard_arrays(hi: np.ndarray, lo: np.ndarray, counts: np.ndarray) -> dict:
    """The bit levels, fingerprints and counts of one shard, whose keys are distinct."""
    left, sizes, bits, order = np.arange(len(hi)), [], [], []
    while len(left):
        size = -(-BITS_PER_KEY * len(left) // 64) * 64
        at = _place(hi[left], lo[left], len(sizes), size)
        alone = np.bincount(at, minlength=size)[at] == 1
        taken = np.zeros(size, bool)
        taken[at[alone]] = True
        sizes.append(size)
        bits.append(np.packbits(taken, bitorder="little"))
        order.append(left[alone][np.argsort(at[alone])])
        left = left[~alone]
    by_number = np.concatenate(order) if order else left
    width = next(w for w in (1, 2, 4, 8) if not len(counts) or int(counts.max()) < 1 << (8 * w))
    return {"sizes": sizes, "bits": b"".join(b.tobytes() for b in bits), "prints": lo[by_number].tobytes(), "counts": counts[by_number].astype(f"u{width}").tobytes(), "width": width}


def _index(counts: DataFrame, shards: int) -> DataFrame:
    def build(table: pa.Table) -> pa.Table:
        hi, lo, n = (table.column(c).to_numpy() for c in ("hi", "lo", "n"))
        row = {"shard": table.column("shard")[0].as_py()} | shard_arrays(hi, lo, n)
        return pa.Table.from_pylist([row], pa.schema([("shard", pa.int64()), ("sizes", pa.list_(pa.int64())), ("bits", pa.binary()), ("prints", pa.binary()), ("counts", pa.binary()), ("width", pa.int32())]))

    return counts.withColumn("shard", F.pmod("hi", F.lit(shards))).groupBy("shard").applyInArrow(build, _INDEX)


class Index:
    """The arrays of some shards laid end to end; ``rows`` are those of :func:`_index`."""

    def __init__(self, rows: list, shards: int):
        rows = sorted(rows, key=lambda r: r["shard"])
        self.shards = shards
        self.slot = {r["shard"]: k for k, r in enumerate(rows)}
        levels = max((len(r["sizes"]) for r in rows), default=0)
        self.size = np.zeros((levels, len(rows)), np.int64)
        for k, r in enumerate(rows):
            self.size[: len(r["sizes"]), k] = r["sizes"]
        whole = self.size.sum(0)
        self.start = np.cumsum(whole) - whole + np.cumsum(self.size, 0) - self.size
        self.bits = np.frombuffer(b"".join(bytes(r["bits"]) for r in rows), U64)
        ones = np.bitwise_count(self.bits).astype(np.int64)
        self.before = (np.cumsum(ones) - ones).astype(np.uint32)
        self.prints = np.frombuffer(b"".join(bytes(r["prints"]) for r in rows), np.int64)
        wide = max((r["width"] for r in rows), default=1)
        self.counts = np.concatenate([np.zeros(0, f"u{wide}"), *(np.frombuffer(bytes(r["counts"]), f"u{r['width']}").astype(f"u{wide}") for r in rows)])

    def lookup(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The count of each key, 0 for keys that aren't in the index."""
        out = np.zeros(len(hi), np.int64)
        slots = np.full(self.shards, -1, np.int64)
        slots[list(self.slot)] = list(self.slot.values())
        slot = slots[hi % self.shards]
        left = np.flatnonzero(slot >= 0)
        for level in range(len(self.size)):
            left = left[self.size[level, slot[left]] > 0]
            at = self.start[level, slot[left]] + _place(hi[left], lo[left], level, self.size[level, slot[left]])
            word, bit = self.bits[at >> 6], (at & 63).astype(U64)
            hit = (word >> bit) & _ONE == _ONE
            number = self.before[at >> 6] + np.bitwise_count(word & ((_ONE << bit) - _ONE))
            mine = left[hit]
            same = self.prints[number[hit]] == lo[mine]
            out[mine[same]] = self.counts[number[hit][same]]
            left = left[~hit]
        return out


def _drop_with(docs: DataFrame, columns: list[str], find: Callable[[pa.RecordBatch, int, int, list[bytes]], set[bytes]], min_chars: int) -> DataFrame:
    """``columns``, n_lines, n_dropped and the text of the lines left; the text is the last column of ``docs``."""
    width = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_runs(batch.column(docs_width - 1)):
                whole = data.tobytes()
                split = [keys_of(whole[offsets[k] : offsets[k + 1]], min_chars) for k in range(j - i)]
                gone = find(batch, i, j, sorted({h for _, hashes in split for h in hashes if h}))
                left = [[line for line, h in zip(lines, hashes, strict=True) if h not in gone] for lines, hashes in split]
                n = [len(lines) for lines, _ in split]
                arrays = [pa.array(n, pa.int64()), pa.array([a - len(b) for a, b in zip(n, left, strict=True)], pa.int64()), pa.array([b"\n".join(x) for x in left], pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[i:j] for c in range(width)), *arrays], names=[*columns, "n_lines", "n_dropped", "text"])

    docs_width = len(docs.columns)
    kinds = [f"`{c}` {docs.schema[k].dataType.simpleString()}" for k, c in enumerate(columns)]
    return docs.mapInArrow(run, ", ".join([*kinds, "n_lines long, n_dropped long, text string"]))


def _sent(docs: DataFrame, columns: list[str], index: DataFrame, shards: int, min_docs: int, min_chars: int) -> DataFrame:
    """Every task gets the whole index."""
    shared = docs.sparkSession.sparkContext.broadcast([r.asDict() for r in index.collect()])
    made: list[Index] = []

    def find(_batch: pa.RecordBatch, _i: int, _j: int, keys: list[bytes]) -> set[bytes]:
        if not made:
            made.append(Index(shared.value, shards))
        if not keys:
            return set()
        return {keys[k] for k in np.flatnonzero(made[0].lookup(*_halves(keys)) >= min_docs)}

    return _drop_with(docs, columns, find, min_chars)


def _dealt(docs: DataFrame, columns: list[str], index: DataFrame, shards: int, loads: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """The hashes of the documents' lines go to the shards; hits come back to the rows, which are written first."""
    rows = written(docs.select(*columns, F.monotonically_increasing_id().alias("_row"), docs.columns[-1]), "rows")
    parts = np.ones(shards, np.int64)  # one number a shard, so a few bytes for each SHARD_KEYS lines
    for r in loads.filter(F.col("probes") > TASK_PROBES).toLocalIterator():
        parts[r["shard"]] = -(-r["probes"] // TASK_PROBES)
    shared = docs.sparkSession.sparkContext.broadcast(parts)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), strict=True):
                keys = list(set(keys_of(text, min_chars)[1]) - {None})
                if keys:
                    hi, lo = _halves(keys)
                    shard = hi % shards
                    yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array((row % shared.value[shard]).astype(np.int32)), pa.array(np.full(len(hi), row)), pa.array(hi), pa.array(lo)], names=["shard", "part", "row", "hi", "lo"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = None
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(shard) != 0) | (batch.column("sizes").is_valid().to_numpy(zero_copy_only=False)[1:])) + 1).tolist(), len(batch)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(a, b - a)
                if a < b and part.column("sizes")[0].is_valid:  # the shard's arrays come before its probes
                    here = Index([part.select(["shard", "sizes", "bits", "prints", "counts", "width"]).slice(0, 1).to_pylist()[0]], shards)
                    part = part.slice(1)
                if here is None or not len(part) or part.column("shard")[0].as_py() not in here.slot:
                    continue  # no line of this shard reaches the threshold
                hi, lo = part.column("hi").to_numpy(zero_copy_only=False).astype(np.int64), part.column("lo").to_numpy(zero_copy_only=False).astype(np.int64)
                some = pa.array(here.lookup(hi, lo) >= min_docs)
                yield part.select(["row", "hi", "lo"]).filter(some)

    asked = rows.select("_row", F.col(rows.columns[-1])).mapInArrow(probes, "shard long, part int, row long, hi long, lo long")
    many = F.udf(lambda s: int(shared.value[s]), "int")  # once a shard
    held = index.withColumn("part", F.explode(F.sequence(F.lit(0), many("shard") - 1)))
    both = held.unionByName(asked, allowMissingColumns=True).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("sizes").isNull())
    hits = both.mapInArrow(answer, "row long, hi long, lo long").groupBy("row").agg(F.collect_list(F.struct("hi", "lo")).alias("hits"))
    found = rows.join(hits.withColumnRenamed("row", "_row"), "_row", "left").select(*columns, "hits", rows.columns[-1])

    def find(batch: pa.RecordBatch, i: int, j: int, keys: list[bytes]) -> set[bytes]:
        hits = batch.column(len(columns))[i:j].flatten()
        both = np.stack([hits.field(0).to_numpy(), hits.field(1).to_numpy()], 1).tobytes() if len(hits) else b""
        return {both[k : k + 16] for k in range(0, len(both), 16)}

    return _drop_with(found, columns, find, min_chars)


def drop_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """Every row without the lines that at least ``min_docs`` rows hold: id, n_lines, n_dropped, text.

    A line's key is the line without ASCII white space at both ends and with A-Z lower-cased; keys of
    fewer than ``min_chars`` code points are never dropped. Lines split at newlines only. A null or
    empty text is one empty line, and comes back empty. Rows are counted, not ids: a repeated row or id counts each time,
    and a line repeated in one row counts once. Rows with a null id are rows like any other. Very long
    texts are hashed line by line. An empty table gives an empty one. Other columns aren't read.

    Two lines are the same if their 128-bit hashes are. A line below the threshold isn't in the index; it
    is taken for one that is only where 64 bits of fingerprint agree by chance. An index beyond
    ``sent_bytes`` isn't sent to the tasks, and the result is the same.
    """
    common = written(line_counts(docs, text_col, min_chars).filter(F.col("n") >= min_docs), "lines")
    shards = max(1, -(-common.count() // SHARD_KEYS))
    index = written(_index(common, shards), "index")
    bytes_of = F.length("bits") + F.length("prints") + F.length("counts")
    held = index.agg(F.sum(bytes_of).alias("bytes")).first()["bytes"] or 0
    rows, columns = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")), ["id"]
    if held <= sent_bytes:
        dropped(common)
        out = _sent(rows, columns, index, shards, min_docs, min_chars)
    else:
        loads = common.groupBy(F.pmod("hi", F.lit(shards)).alias("shard")).agg(F.sum("n").alias("probes"))
        out = _dealt(rows, columns, index, shards, loads, min_docs, min_chars)
    return out.withColumnRenamed("id", id_col)
