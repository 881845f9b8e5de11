"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Indicators of n-grams are scaled by the log ratio of their smoothed frequencies in the two classes;
a linear hinge-loss model is fitted on the scaled, length-normalised rows by dual coordinate descent
and moved part of the way to its mean weight, as in naive Bayes interpolation. N-grams are byte
trigrams of the text and word-shape n-grams (case, symbols, repetition of words and of lines).

The class counts cover all labelled rows that :func:`fit` is given (a bounded sample of the labels, in
the query); the linear model is fitted on ``SAMPLE`` of them at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.hashing import _SPACE, text_runs, word_hashes

#: Hashed n-gram indicators.
BITS = 16
#: Bound of the labelled rows that the linear model is fitted on.
SAMPLE = 3000
EPOCHS, COST, KEEP = 20, 1.0, 0.75


def _word_shapes(data: np.ndarray, hashes: np.ndarray, first: np.ndarray, last: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A small code per word: kind of its first and last byte, case, repetition of the word before it in the same row."""
    kind = np.zeros(256, np.uint32)
    kind[97:123], kind[65:91], kind[48:58], kind[128:] = 1, 2, 3, 1
    kind[[44, 46, 59, 58, 63]] = 4
    kind[0:32] = 0
    kind[[33, 34, 35, 36, 37, 38, 42, 47, 60, 61, 62, 64, 92, 94, 95, 96, 123, 124, 125, 126]] = 5
    again = np.zeros(len(hashes), np.uint32)
    again[1:] = hashes[1:] == hashes[:-1]
    again[bounds[:-1][bounds[:-1] < len(hashes)]] = 0
    second = np.minimum(first + 1, last)
    return kind[data[first]] + 6 * kind[data[second]] + 36 * kind[data[last]] + 216 * again


def features(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted indicator numbers of each row; a row of fewer than three bytes has few or none."""
    size, mask = 1 << BITS, np.uint32((1 << BITS) - 1)
    d = data.astype(np.uint32)
    grams = np.zeros(len(d), np.uint32)
    if len(d) > 2:
        x = d[:-2] * np.uint32(0x9E3779B1) + d[1:-1] * np.uint32(0x85EBCA77) + d[2:] * np.uint32(0xC2B2AE3D)
        grams[:-2] = (x >> np.uint32(32 - BITS)) & mask
    inside = ~_SPACE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    at = offsets[:-1][offsets[:-1] < len(data)]
    starts[at] = inside[at]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    stop = offsets[1:][offsets[1:] > 0] - 1
    ends[stop] = inside[stop]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends)
    hashes, bounds = word_hashes(data, offsets)
    shape = _word_shapes(data, hashes, first, last, bounds) if len(first) else np.zeros(0, np.uint32)
    one = (shape * np.uint32(0x9E3779B1) + np.uint32(77)) >> np.uint32(32 - BITS)
    two = (shape[:-1] * np.uint32(0x85EBCA77) ^ shape[1:] * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)
    out = []
    for i in range(len(offsets) - 1):
        a, b, u, v = offsets[i], offsets[i + 1], bounds[i], bounds[i + 1]
        mark = np.zeros(size, bool)
        if b - a > 2:
            mark[grams[a : b - 2]] = True
        if v > u:
            mark[one[u:v]] = True
            mark[two[u : v - 1]] = True
            # how far the words repeat, in tenths, and the length as a power of two
            distinct = len(np.unique(hashes[u:v]))
            mark[(31 * (10 * distinct // (v - u)) + 7 * int(v - u).bit_length() + 40503) % size] = True
            mark[(1009 + 97 * (10 * distinct // (v - u))) % size] = True
        out.append(np.flatnonzero(mark).astype(np.int32))
    return out


def _feature_rows(df: DataFrame) -> DataFrame:
    """(label, draw, indicators) of (text, label, draw) rows."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_runs(batch.column(0)):
                yield pa.RecordBatch.from_arrays([batch.column(1)[i:j], batch.column(2)[i:j], pa.array([f.tobytes() for f in features(data, offsets)], pa.binary())], names=["label", "draw", "features"])

    return df.mapInArrow(build, "label int, draw long, features binary")


def _class_counts(df: DataFrame) -> DataFrame:
    """Rows of (label, indicator, n); indicator -1 counts the rows. Summed within tasks first."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, (1 << BITS) + 1), np.int64)
        for batch in batches:
            for i, j, data, offsets in text_runs(batch.column(0)):
                for label, found in zip(batch.column(1)[i:j].to_pylist(), features(data, offsets), strict=True):
                    counts[label, found] += 1
                    counts[label, -1] += 1
        for label in (0, 1):
            some = np.flatnonzero(counts[label])
            numbers = np.where(some == 1 << BITS, -1, some)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), label, np.int32)), pa.array(numbers.astype(np.int32)), pa.array(counts[label, some])], names=["label", "f", "n"])

    return df.mapInArrow(build, "label int, f int, n long").groupBy("label", "f").agg(F.sum("n").alias("n"))


class Model:
    """Weights over scaled indicators and the line that turns a margin into a probability."""

    def __init__(self, ratio: np.ndarray, weights: np.ndarray, slope: float, at: float):
        self.scaled, self.square, self.slope, self.at = ratio * weights, ratio * ratio, slope, at

    def margin(self, found: np.ndarray) -> float:
        norm = float(np.sqrt(self.square[found].sum()))
        return float(self.scaled[found].sum()) / norm if norm > 0 else 0.0

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margins + self.at, -40, 40)))


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray, size: int, cost: float = COST, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of a linear hinge-loss model, by coordinate steps in the dual with 0 <= alpha <= cost."""
    weights, alpha = np.zeros(size), np.zeros(len(rows))
    square = np.array([float(v @ v) for v in values])
    order = np.random.default_rng(7)
    for _ in range(epochs):
        largest = 0.0
        for i in order.permutation(len(rows)):
            if square[i] == 0:
                continue
            slack = signs[i] * float(weights[rows[i]] @ values[i]) - 1
            fresh = min(max(alpha[i] - slack / square[i], 0.0), cost)
            if fresh != alpha[i]:
                weights[rows[i]] += (fresh - alpha[i]) * signs[i] * values[i]
                largest = max(largest, abs(fresh - alpha[i]))
                alpha[i] = fresh
        if largest < 1e-4:
            break
    return weights


def _line(margins: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit of the classes on the margins, by damped Newton steps."""
    n1, n0 = positive.sum(), (~positive).sum()
    target = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    t = np.zeros(2)
    x = np.stack([margins, np.ones(len(margins))])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(t @ x, -40, 40)))
        grad, hess = x @ (p - target), (x * (p * (1 - p))) @ x.T + 1e-4 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        t = t - step * min(1.0, 5.0 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return float(t[0]), float(t[1])


def _drawn(rows: DataFrame, sample: int) -> list[tuple[int, bytes]]:
    """(label, features) of the ``sample`` rows with the least draws. Draws are counted first, so that
    the driver gets features of these rows alone, and those of repeated rows once."""
    often, left = {}, sample
    for r in rows.groupBy("draw", "label").agg(F.count(F.lit(1)).alias("n")).orderBy("draw", "label").limit(sample).collect():
        if left:
            often[r["draw"], r["label"]] = min(r["n"], left)
            left -= often[r["draw"], r["label"]]
    if not often:
        return []
    some = rows.filter(F.col("draw") <= max(draw for draw, _ in often)).select("text", "label", "draw")
    once = _feature_rows(some).groupBy("draw", "label").agg(F.first("features").alias("features"))
    return sorted((r["label"], bytes(r["features"])) for r in once.collect() for _ in range(often.get((r["draw"], r["label"]), 0)))


def fit(train: DataFrame, text_col: str = "text", label_col: str = "quality", key_col: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Fit on the rows whose label is 0 or 1. With no rows or one class only, a constant model.

    Class counts cover all rows; the linear model is fitted on the ``sample`` rows with the least
    hashes of key and text, of which repeated ones count as often as they occur.
    """
    rows = train.filter(F.col(label_col).isin(0, 1)).select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"), F.xxhash64(key_col, text_col).alias("draw"))
    size = 1 << BITS
    counts, totals = np.ones((2, size)), np.zeros(2)
    for r in _class_counts(rows.select("text", "label")).collect():  # at most 2 * (2^BITS + 1) rows
        if r["f"] < 0:
            totals[r["label"]] = r["n"]
        else:
            counts[r["label"], r["f"]] += r["n"]
    if totals.min() == 0:
        p = (totals[1] + 0.5) / (totals.sum() + 1)
        return Model(np.zeros(size), np.zeros(size), 0.0, float(np.log(p / (1 - p))))
    ratio = np.log((counts[1] / counts[1].sum()) / (counts[0] / counts[0].sum()))
    got = _drawn(rows, sample)
    found = [np.frombuffer(f, np.int32) for _, f in got]
    positive = np.array([label == 1 for label, _ in got])
    if not len(got) or positive.all() or not positive.any():
        p = totals[1] / totals.sum()
        return Model(np.zeros(size), np.zeros(size), 0.0, float(np.log(p / (1 - p))))
    values = [ratio[f] / max(float(np.sqrt((ratio[f] ** 2).sum())), 1e-12) for f in found]
    weights = dual_coordinate_descent(found, values, np.where(positive, 1.0, -1.0), size)
    weights = KEEP * weights + (1 - KEEP) * np.abs(weights).mean()
    model = Model(ratio, weights, 1.0, 0.0)
    model.slope, model.at = _line(np.array([model.margin(f) for f in found]), positive)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """id, score and predicted for every row, from its whole text; a null text counts as empty.

    A text without any indicator gets the model's score at margin 0; a score of exactly 0.5 predicts
    1. Repeated rows are judged alike, a very long text is read whole, and an empty table gives an
    empty one. ``keep``: further columns.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = keep or {}
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for i, j, data, offsets in text_runs(batch.column(1)):
                p = m.probability(np.array([m.margin(f) for f in features(data, offsets)]))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(p), pa.array((p >= 0.5).astype(np.int32)), *(batch.column(2 + k)[i:j] for k in range(len(names)))], names=["id", "score", "predicted", *names])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(c.alias(n) for n, c in keep.items()))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, ", ".join([f"id {kinds['id']}, score double, predicted int", *(f"{n} {kinds[n]}" for n in keep)])).withColumnRenamed("id", id_col)
