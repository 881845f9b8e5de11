"""Whitening of embeddings with a compensated covariance.

Entries are scaled to whole numbers, so that sums are exact. Vectors are centred on the exact mean, held
in two doubles, and a block of them is cut into slices of so few bits that every product of two
slices' matrices is free of rounding; these products are added up in double-double with two-sums. Tasks hand on the high
and low parts, which are merged in double-double again. The matrix is solved by LAPACK's
tridiagonal divide and conquer (``numpy.linalg.eigh``), and the vectors are refined in extended precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a block, and bits of a slice: a sum of so many products of two slices fits into 53 bits.
BLOCK, SLICE_BITS = 1 << 10, 21
#: Slices of a number of two doubles.
SLICES = 6
#: An eigenvalue below this share of the largest is taken for zero: its component can't be scaled.
NOTHING = 1e-13
#: Steps that refine the eigenvectors, at most.
REFINED = 4


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rounded sum and its error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def added(high: np.ndarray, low: np.ndarray, more: np.ndarray, rest: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """The sum of two double-doubles."""
    s, e = two_sum(high, more)
    t, f = two_sum(low, np.broadcast_to(rest, np.shape(low)))
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def slices_of(high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    """Matrices that add up to ``high + low``; each column of each has few bits, on a grid of its own."""
    out = []
    top = np.abs(high).max(0, initial=0.0)
    step = np.where(top > 0, np.exp2(np.floor(np.log2(np.where(top > 0, top, 1.0))) + 2 - SLICE_BITS), 1.0)
    for _ in range(SLICES):
        if not high.any():
            break
        cut = np.rint(high / step) * step
        out.append(cut)
        high, low = two_sum(high - cut, low)  # the difference is exact: both lie on one grid
        step = step * 2.0 ** (1 - SLICE_BITS)
    return out


def outer_products(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum over rows of the outer product of each row of ``high + low`` with itself, in double-double."""
    width = high.shape[1]
    total = (np.zeros((width, width)), np.zeros((width, width)))
    for begin in range(0, len(high), BLOCK):
        cuts = slices_of(high[begin : begin + BLOCK], low[begin : begin + BLOCK])
        for i in range(len(cuts)):
            for j in range(i + 1):
                if i + j >= SLICES:
                    continue  # beyond the bits of two doubles
                part = cuts[i].T @ cuts[j]  # free of rounding
                total = added(*total, part)
                if i != j:
                    total = added(*total, part.T)
    return total


def _scaled(column: pa.Array, scale: float, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are whole, and the whole numbers of these, as one row each (of one length)."""
    if not pa.types.is_large_list(column.type):
        column = column.cast(pa.large_list(column.type.value_type))
    lengths = np.array(pa.compute.fill_null(pa.compute.list_value_length(column), -1))
    flat = column.flatten()
    values = np.asarray(pa.compute.fill_null(flat.cast(pa.float64()), np.nan))
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(values * scale)
    fits = np.abs(x) < 2.0**52  # nor is a NaN
    owner = np.repeat(np.arange(len(lengths)), np.maximum(lengths, 0))
    good = lengths > 0
    good[owner[~fits]] = False
    keep = good[owner]
    return good, x[keep].astype(np.int64) + offset


def _clean(batches: Iterator[pa.RecordBatch], at: int, scale: float, offset: int, dim: int | None) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole vectors with their numbers; with ``dim``, of those of that length alone."""
    for batch in batches:
        for begin in range(0, len(batch), 8 * BLOCK):
            part = batch.slice(begin, 8 * BLOCK)
            lengths = np.array(pa.compute.fill_null(pa.compute.list_value_length(part.column(at)), -1))
            for length in [dim] if dim else np.unique(lengths[lengths > 0]).tolist():
                some = part.filter(pa.array(lengths == length))
                good, x = _scaled(some.column(at), scale, offset)
                if good.any():
                    yield some.filter(pa.array(good)), x.reshape(-1, length)


def _sums(vectors: DataFrame, scale: float, offset: int) -> tuple[int, list[int]]:
    """The number of vectors and the exact sums of each dimension, for the length that most vectors have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}
        for _, x in _clean(batches, 0, scale, offset, None):
            d = x.shape[1]
            n[d] = n.get(d, 0) + len(x)
            sums[d] = sums.get(d, 0) + x.sum(0)
        for d, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * (d + 1), pa.int32()), pa.array(range(-1, d), pa.int32()), pa.array([n[d], *s.tolist()], pa.int64())], names=["length", "dim", "sum"])

    parts = vectors.mapInArrow(run, "length int, dim int, sum long")
    summed = parts.groupBy("length", "dim").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"))
    most = summed.filter("dim = -1").orderBy(F.desc("sum"), F.desc("length")).limit(1).select("length")
    rows = summed.join(F.broadcast(most), "length").collect()  # one row a dimension
    sums = {r["dim"]: int(r["sum"]) for r in rows}
    return sums.pop(-1, 0), [sums[k] for k in range(len(sums))]


def _means(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Exact means in two doubles."""
    means = [Fraction(s, n) for s in sums]
    high = [float(m) for m in means]
    return np.array(high), np.array([float(m - Fraction(h)) for m, h in zip(means, high, strict=True)])


def _merged(parts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sum of double-double matrices, of which each row has one line: (line, high, low)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # the lines dealt to this task
        for batch in batches:
            for line, high, low in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h, lo = np.frombuffer(high), np.frombuffer(low)
                totals[line] = added(*totals[line], h, lo) if line in totals else (h, lo)
        for line, (h, lo) in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([line], pa.int32()), pa.array([h.tobytes()], pa.binary()), pa.array([lo.tobytes()], pa.binary())], names=["line", "high", "low"])

    out = np.zeros((2, width, width))
    for r in parts.repartition("line").mapInArrow(run, "line int, high binary, low binary").collect():  # a row a dimension
        out[:, r["line"]] = np.frombuffer(r["high"]), np.frombuffer(r["low"])
    return out[0], out[1]


def _lines(high: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
    width = len(high)
    return pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([h.tobytes() for h in high], pa.binary()), pa.array([x.tobytes() for x in low], pa.binary())], names=["line", "high", "low"])


def _centred(x: np.ndarray, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers less a mean, in two doubles."""
    s, e = two_sum(x.astype(np.float64), -high)
    return two_sum(s, e - low)


def _covariance(vectors: DataFrame, scale: float, offset: int, n: int, mean: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The covariance of the whole numbers, in two doubles."""
    width = len(mean[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = (np.zeros((width, width)), np.zeros((width, width)))
        for _, x in _clean(batches, 0, scale, offset, width):
            total = added(*total, *outer_products(*_centred(x, *mean)))
        yield _lines(*total)

    return _divided(*_merged(vectors.mapInArrow(run, "line int, high binary, low binary"), width), n)


def _divided(high: np.ndarray, low: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A double-double over a whole number."""
    exact = [(Fraction(h) + Fraction(x)) / n for h, x in zip(high.ravel().tolist(), low.ravel().tolist(), strict=True)]
    first = [float(v) for v in exact]
    rest = [float(v - Fraction(f)) for v, f in zip(exact, first, strict=True)]
    return np.array(first).reshape(high.shape), np.array(rest).reshape(high.shape)


def components_of(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, of a symmetric matrix of two doubles.

    The divide-and-conquer solution is refined in extended precision: each vector is corrected by the
    others, from how far they are from being orthogonal and from making the matrix diagonal. Every step
    squares what is wrong, so a few are enough.
    """
    value, vector = np.linalg.eigh(high)
    whole = high.astype(np.longdouble) + low
    v = vector[:, np.argsort(-value, kind="stable")].astype(np.longdouble)
    for _ in range(REFINED):
        unit = np.eye(len(high), dtype=np.longdouble) - v.T @ v
        turned = v.T @ (whole @ v)
        turned = (turned + turned.T) / 2
        e = np.diag(turned) / (1 - np.diag(unit))
        gap = e[None, :] - e[:, None]
        # vectors of eigenvalues that are as good as equal have no direction of their own: they only stay orthogonal
        near = np.abs(gap) <= np.abs(e).max() * 1e-14 + 2 * np.abs(turned - np.diag(np.diag(turned)))
        with np.errstate(divide="ignore", invalid="ignore"):
            fix = np.where(near, unit / 2, (turned + e[None, :] * unit) / gap)
        v = v + v @ fix
        if np.abs(fix).max() < 1e-17:
            break
    v = v / np.sqrt((v * v).sum(0))
    e = (v * (whole @ v)).sum(0)
    order = np.argsort(-e, kind="stable")
    return e[order].astype(np.float64), v[:, order].astype(np.float64)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """The exact sums of squares of ``n * x - sums``; None beyond the range of a long."""
    largest = n * float(np.abs(x).max(initial=0)) + float(np.abs(sums).max(initial=0))
    if largest < 2.0**62:
        v = n * x - sums
        if float(np.abs(v).max(initial=0)) ** 2 * v.shape[1] < 2.0**62:
            return (v * v).sum(1).tolist()
    exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    return [v if v < 1 << 63 else None for v in exact]


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 32, scale: float = 64.0, offset: int = 1_000_000) -> DataFrame:
    """A row for each vector and component: id, component, n, deviation, whitened, explained, identity_error.

    Entries become whole numbers ``floor(scale * entry) + offset``. Rows whose vector is null, empty, or holds null or
    non-finite entries are left out, as are entries beyond 2**52 after scaling, and vectors of another length than most
    have (of equally many, the longest stays). Components are numbered from 1 by falling eigenvalue, at most ``most``
    of them. ``whitened`` is null for components without any variance (constant vectors, a single vector), and ``deviation`` where it
    is beyond a long. ``identity_error`` is the largest absolute entry of the covariance of the whitened values of all rows, less the identity,
    over the components that have variance; null if none has. Repeated rows count each time; null ids are rows like any other; an empty table gives an
    empty one. Other columns aren't read. What reaches the driver are sums and covariances of dimensions.
    """
    rows = vectors.select(F.col(vector_col).alias("vector"))
    n, sums = _sums(rows, scale, offset)
    width = len(sums)
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not n:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    mean = _means(n, sums)
    covariance = _covariance(rows, scale, offset, n, mean)
    value, vector = components_of(*covariance)
    trace = float(sum(Fraction(float(h)) + Fraction(float(x)) for h, x in zip(np.diag(covariance[0]), np.diag(covariance[1]), strict=True)))
    count = min(most, width)
    alive = int((value[:count] > NOTHING * max(value[0], 0.0)).sum()) if value[0] > 0 else 0
    to = vector[:, :alive] / np.sqrt(value[:alive])
    held = np.array(sums, np.int64)

    def projected(x: np.ndarray) -> np.ndarray:
        high, low = _centred(x, *mean)
        return high @ to + low @ to

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # with a one in front of each vector, its outer product holds the sums as well
        total = (np.zeros((alive + 1, alive + 1)), np.zeros((alive + 1, alive + 1)))
        for _, x in _clean(batches, 0, scale, offset, width):
            w = np.concatenate([np.ones((len(x), 1)), projected(x)], 1)
            total = added(*total, *outer_products(w, np.zeros_like(w)))
        yield _lines(*total)

    error = None
    if alive:
        high, low = _divided(*_merged(rows.mapInArrow(moments, "line int, high binary, low binary"), alive + 1), n)
        whole = high.astype(np.longdouble) + low
        error = float(np.abs(whole[1:, 1:] - np.outer(whole[0, 1:], whole[0, 1:]) - np.eye(alive)).max())
    explained = (value[:count] / trace if trace > 0 else np.zeros(count)).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _clean(batches, 1, scale, offset, width):
            m = len(x)
            out = np.full((m, count), np.nan)
            out[:, :alive] = projected(x)
            numbers = np.repeat(np.arange(m), count)
            values = pa.array(out.ravel(), mask=np.tile(np.arange(count) >= alive, m))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(numbers)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), m)), pa.array(np.full(m * count, n)), pa.array(_deviations(x, n, held), pa.int64()).take(pa.array(numbers)), values, pa.array(np.tile(explained, m)), pa.array([error] * (m * count), pa.float64())],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
