"""Periodic runs of words, found by Karp-Miller-Rosenberg naming.

Words get numbers, and stretches of 2, 4, 8 and so on words get the rank of the pair of numbers of their halves, so that
two stretches are equal just when their names are. How far two places agree, forwards or backwards, is
read off by going down the levels of names. A run of period p and of length 2p or more agrees with
itself p words on over at least p words; so of every p places one is tested, first by a single
comparison of names half that long on either side, and only what passes is extended. Texts are laid
end to end, with a word of its own after each, so that many are worked on at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.hashing import text_runs

#: Texts are put together up to about this many words, and places tested at once.
TOGETHER, TESTED = 1 << 15, 1 << 18


def names_of(words: np.ndarray) -> list[np.ndarray]:
    """For each level k the names of the stretches of ``2**k`` words at each place, up to the last level at which two are equal."""
    levels = [words]
    while 2 * (span := 1 << (len(levels) - 1)) <= len(words):
        last = levels[-1]
        pairs = last[: len(last) - span].astype(np.int64) * (int(last.max()) + 1) + last[span:]
        order = np.argsort(pairs, kind="stable")
        ranked = pairs[order]
        new = np.concatenate([[False], ranked[1:] != ranked[:-1]])
        rank = np.cumsum(new)
        if rank[-1] == len(pairs) - 1:
            break  # no stretch of this length occurs twice
        names = np.empty(len(pairs), np.int32)
        names[order] = rank
        levels.append(names)
    return levels


def agreeing(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words from place ``a`` on equal those from ``b`` on, for each pair of places."""
    length = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        names = levels[k]
        fits = np.flatnonzero(np.maximum(a, b) + length < len(names))
        same = fits[names[a[fits] + length[fits]] == names[b[fits] + length[fits]]]
        length[same] += 1 << k
    return length


def agreeing_before(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words before place ``a`` equal those before ``b``."""
    length = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        names, span = levels[k], 1 << k
        x, y = a - length - span, b - length - span
        fits = np.flatnonzero((np.minimum(x, y) >= 0) & (np.maximum(x, y) < len(names)))
        same = fits[names[x[fits]] == names[y[fits]]]
        length[same] += span
    return length


def _candidates(levels: list[np.ndarray], periods: np.ndarray, need: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of the grid places that agree with the place a period on over half of ``need`` words on one side."""
    level = np.floor(np.log2(-(-need // 2))).astype(np.int64)
    places = np.maximum(0, -(-(n - periods) // need))
    total = np.concatenate([[0], np.cumsum(places)])
    begin = 0
    while begin < len(periods):
        end = max(begin + 1, int(np.searchsorted(total, total[begin] + TESTED, side="right")) - 1)
        end = min(end, int(np.searchsorted(level, level[begin], side="right")))
        many, k = places[begin:end], int(level[begin])
        if k < len(levels):
            names, span = levels[k], 1 << k
            step, p = np.repeat(need[begin:end], many), np.repeat(periods[begin:end], many)
            at = (np.arange(len(p)) - np.repeat(total[begin:end] - total[begin], many)) * step
            fits = np.flatnonzero(at + p < len(names))
            on = fits[names[at[fits]] == names[at[fits] + p[fits]]]
            fits = np.flatnonzero(at >= span)
            back = fits[names[at[fits] - span] == names[at[fits] + p[fits] - span]]
            some = np.union1d(on, back)
            if len(some):
                yield at[some], p[some]
        begin = end


def runs_of(words: np.ndarray, longest: int, least: int) -> np.ndarray:
    """(start, length, period) of all maximal runs, by start and then period.

    ``words`` are numbers of words, of texts of at most ``longest`` words with a number of its own after each.
    """
    if longest < max(2, least):
        return np.zeros((0, 3), np.int64)
    levels, n = names_of(words), len(words)
    periods = np.arange(1, longest // 2 + 1)
    # a run of period p agrees with itself over its length less p; levels must rise with the period
    need = np.maximum(periods, least - periods)
    found = []
    for some in (periods < least - periods, periods >= least - periods):
        p, w = periods[some], need[some]
        order = np.argsort(w, kind="stable")
        for at, period in _candidates(levels, p[order], w[order], n):
            before, after = agreeing_before(levels, at, at + period), agreeing(levels, at, at + period)
            good = before + after >= np.maximum(period, least - period)
            found.append(np.stack([at - before, before + after + period, period], 1)[good])
    every = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)
    # the same stretch under several periods is a run of the smallest
    first = np.concatenate([[True], (every[1:, :2] != every[:-1, :2]).any(1)])[: len(every)]
    every = every[first]
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def _together(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Indices of texts to be worked on together: of like length, and up to ``TOGETHER`` words."""
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    begin = 0
    while begin < len(order):
        size = np.cumsum(lengths[order[begin:]] + 1)
        end = begin + max(1, int(np.searchsorted(size, TOGETHER, side="right")))
        end = min(end, begin + int(np.searchsorted(lengths[order[begin:]], 2 * lengths[order[begin]], side="right")))
        yield order[begin:end]
        begin = end


def text_runs_of(texts: list[list[bytes]], least: int) -> list[np.ndarray]:
    """The runs of each text, given as its words."""
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    lengths = np.array([len(t) for t in texts], np.int64)
    for some in _together(lengths):
        flat = pa.array([w for k in some for w in texts[k]], pa.large_binary()).dictionary_encode()
        ends = np.cumsum(lengths[some] + 1)
        starts = ends - lengths[some] - 1
        words = np.empty(int(ends[-1]), np.int32)
        inside = np.ones(len(words), bool)
        inside[ends - 1] = False
        words[inside] = flat.indices.to_numpy()
        words[ends - 1] = len(flat.dictionary) + np.arange(len(some))
        found = runs_of(words, int(lengths[some].max()), least)
        cut = np.searchsorted(found[:, 0], np.append(starts, ends[-1]))
        for k, a, b, s in zip(some.tolist(), cut[:-1], cut[1:], starts, strict=True):
            if a < b:
                out[k] = found[a:b] - [s, 0, 0]
    return out


def _collapsed(words: list[bytes], found: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by spaces."""
    if not len(found):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 0] + found[:, 1], -1)
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist())


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12) -> DataFrame:
    """Runs of every row's whole text: id, n_words, runs (of start, length and period), collapsed.

    Words are split at ASCII white space and numbered from 0. A run is a stretch of at least ``least``
    words and at least twice its smallest period that no neighbouring word extends; runs are listed by
    start, then period. ``collapsed`` is the text without the words that any run holds after its first
    period, joined by single spaces. Runs may overlap; of two on the same stretch only the one of the
    smallest period is a run. Null and empty texts have no words, no runs and an empty text. Repeated rows and null
    ids are rows like any other, a text is never split over tasks or cut, and an empty table gives an empty one. Other columns aren't read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_runs(batch.column(1)):
                whole = data.tobytes()
                texts = [whole[offsets[k] : offsets[k + 1]].split() for k in range(j - i)]
                found = text_runs_of(texts, least)
                at = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
                every = np.concatenate(found)
                runs = pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.array(every[:, c]) for c in range(3)], ["start", "length", "period"])).cast(_RUNS)
                text = pa.array([_collapsed(t, f) for t, f in zip(texts, found, strict=True)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array([len(t) for t in texts], pa.int64()), runs, text], names=["id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string").withColumnRenamed("id", id_col)
