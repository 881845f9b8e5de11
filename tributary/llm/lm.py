"""Language-model scoring by logistic mixing of context bit predictors.

A text is a sequence of units: words, and the white space between them where it isn't one space; an
empty unit ends it. A unit that the text has shown before is coded from the text's own history, by
two adaptive bits: whether it is what followed the last two units when they last stood together,
and whether it occurred at all (then by its share so far). Any other unit is spelled, byte by byte
with an end mark, as binary decisions down a Huffman tree.

For each decision several predictors give a state from the counts in their hashed context: the last
one, two, three or four bytes of the unit, or all of it so far. States are turned into log odds by
what they were followed by, summed with weights chosen by a gate (what the two longest contexts have
seen), and the sum is refined by a table. Two more predictors look across the edge between units:
the last byte of the unit before with up to one byte of this one, and the last two bytes of the unit
before. What the first five say of a unit depends on the unit alone and is worked out once for each
different unit; the mixing is done along each text, decision by decision.

Counts come from all training texts and are kept per context, so that they grow with the input.
Different units are dealt into chunks; the contexts of each chunk meet in blocks of the hash range,
are summed there, and return as states. Weights and refinement start from what is learned over the
joint states of all training decisions, each without its own occurrence, in a fixed order. From
there every text moves its own, online, after each ``STEP`` of its decisions, which are priced
before they are learned from. Neither they nor the scores depend on the partitioning.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm.hashing import _BASE, _SPACE, mixed, text_runs
from tributary.llm.scratch import dropped, swept, written

END = 256
#: Predictors: contexts of one to four bytes, and the unit so far. For each, the bounds between the
#: levels of a context that has seen one bit value only, and the steps of log odds if it saw both.
LEVELS = ((), (4,), (2, 4), (2, 3, 5, 10), (2, 3, 5, 10))
STEPS = (8, 7, 9, 13, 13)
K = len(LEVELS)
STATES = tuple(s if not v else 1 + 2 * (len(v) + 1) + s for v, s in zip(LEVELS, STEPS, strict=True))
CELLS = int(np.prod(STATES))
#: Log odds at the outermost step; weights' learning rate and passes; bounds of mixed log odds and steps of the refinement.
EDGE, RATE, PASSES, BATCHES, WIDE, FINE = 4.5, 0.05, 12, 32, 8.0, 33
#: Steps of the refinement for each unit of log odds; least probability; gates for each kind of the context before the longest.
FINER, LEAST, GATE = (FINE - 1) / (2 * WIDE), 1e-6, len(LEVELS[K - 1]) + 3
RUN = 1 << 18
#: Decisions that are worked on at once, about, where they need not be held together; texts that are mixed side by side.
SLICE, BESIDE = 1 << 18, 512
#: Different units held by a task before they are sent on; bytes of the units of a chunk; entries of a block, about.
HELD, CHUNK, BLOCK = 1_000_000, 1 << 19, 3_000_000
#: Units seen most often that go to all tasks, and their bytes each, about; the others are joined.
FREQUENT, FREQUENT_BYTES = 400_000, 16
#: Decisions of a text between two moves of its weights and refinement; rates of either.
STEP, ADAPT, REFINE = 32, 0.01, 0.01
#: Bytes of the texts that are scored side by side, about, and such packs in a task.
PACK, PACKS = 1 << 20, 8
#: Rows of rare units that a task gathers before they are sent to their packs.
GATHERED = 300_000
#: Predictors across the edge of units: contexts of either, their kind of state, and the state of a decision that they don't see.
EDGES, CONTEXTS, EDGE_STATE = 2, 257 * 257, 3
UNSEEN = STATES[EDGE_STATE]
#: Where a decision's code holds the states of all predictors, above its bit, and how many bits each takes; and the last context's state behind the end of a text.
AT, TAKES, BEHIND = (1, 4, 8, 12, 17, 22, 27), (3, 4, 4, 5, 5, 5, 5), 31
#: Short contexts, whose states all tasks have; those of the others come with the units.
SHORT = 2
#: Cells of the two bits of a text's history.
MATCH, SEEN = 16, 256


def huffman(counts: np.ndarray) -> list[list[tuple[int, int]]]:
    """The (node, bit) path of each symbol; every symbol counts as seen once more than it was."""
    heap = [(int(c) + 1, s, s) for s, c in enumerate(counts)]
    heapq.heapify(heap)
    children, n = {}, len(counts)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        children[n] = (a[2], b[2])
        heapq.heappush(heap, (a[0] + b[0], n, n))
        n += 1
    paths: list[list[tuple[int, int]]] = [[] for _ in counts]
    stack = [(heap[0][2], [])]
    while stack:
        at, path = stack.pop()
        if at < len(counts):
            paths[at] = path
            continue
        for bit in (0, 1):
            stack.append((children[at][bit], [*path, (at - len(counts), bit)]))
    return paths


def _places(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``begin``, ``begin`` + 1 ... of each stretch of ``size`` (one at least), one stretch after the other."""
    ends = np.cumsum(size)
    steps = np.ones(int(ends[-1]) if len(ends) else 0, np.int64)
    steps[ends[:-1]] = begin[1:] - begin[:-1] - size[:-1] + 1
    steps[:1] = begin[:1]
    return np.cumsum(steps, out=steps)


class Coder:
    """The decisions (tree node and bit) of each symbol."""

    def __init__(self, counts: np.ndarray):
        paths = huffman(counts)
        self.length = np.array([len(p) for p in paths], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.node = np.array([n for p in paths for n, _ in p], np.int64)
        self.bit = np.array([b for p in paths for _, b in p], np.int64)

    def decisions(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the decisions of the symbols in order: the symbol's place, the step of its path, and which entry of ``node`` and ``bit`` it is."""
        length, first = self.length[symbols], self.first[symbols]
        at, which = np.repeat(np.arange(len(symbols)), length), _places(first, length)
        return at, which - first[at], which


def states(n0: np.ndarray, n1: np.ndarray, k: int) -> np.ndarray:
    """The state of predictor ``k`` after ``n0`` zeros and ``n1`` ones in its context."""
    steps, levels = STEPS[k], LEVELS[k]
    middle = (steps - 1) / 2
    mixed_step = np.clip(np.rint(np.log((n1 + 0.4) / (n0 + 0.4)) * (middle / EDGE) + middle), 0, steps - 1).astype(np.uint8)
    if not levels:
        return mixed_step
    n = n0 + n1
    level = np.searchsorted(levels, n, side="right")
    single = 1 + 2 * level + (n1 > 0)
    out = np.where(np.minimum(n0, n1) > 0, 1 + 2 * (len(levels) + 1) + mixed_step, single)
    return np.where(n <= 0, 0, out).astype(np.uint8)


def _turned() -> np.ndarray:
    """For the states of the longer contexts, two bytes with the bit behind: the same states told by what the bit is to them, most often the value they have seen. Turning twice changes nothing."""
    both = np.arange(2 << (AT[K] - AT[SHORT]), dtype=np.int64)
    bit, out = both & 1, np.zeros(len(both), np.int64)
    for k in range(SHORT, K):
        at, first = AT[k] - AT[SHORT] + 1, 1 + 2 * (len(LEVELS[k]) + 1)
        s = (both >> at) & ((1 << TAKES[k]) - 1)
        single, step = (s > 0) & (s < first), (s >= first) & (s < STATES[k])
        s = np.where(single, ((s - 1) ^ bit) + 1, np.where(step & (bit == 0), first + STATES[k] - 1 - s, s))
        out |= s << (at - 1)
    return out.astype("<u2")


def spelled(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The symbols of units with their end marks, the contexts before each, and the unit of each."""
    rows = len(offsets) - 1
    ends = offsets[1:] + np.arange(rows)
    symbols = np.zeros(len(data) + rows, np.int64)
    inner = np.ones(len(symbols), bool)
    inner[ends] = False
    symbols[inner], symbols[ends] = data, END
    length = np.diff(offsets) + 1
    begin = ends - length + 1
    unit = np.repeat(np.arange(rows), length)
    place = np.arange(len(symbols)) - begin[unit]
    s, back = symbols.astype(np.uint64), []
    for k in (1, 2, 3, 4):
        b = np.zeros(len(s), np.uint64)
        b[k:] = s[: max(len(s) - k, 0)] + np.uint64(1)
        b[place < k] = 0
        back.append(b)
    power = np.multiply.accumulate(np.full(int(length.max(initial=0)) + 1, np.uint64(_BASE)))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((s + np.uint64(1)) * power[place])])
    so_far = mixed(sums[:-1] - sums[begin][unit])
    nine, contexts, c = np.uint64(9), [], np.zeros(len(s), np.uint64)
    for b in back:
        c = (c << nine) | b
        contexts.append(c)
    # the lowest bits tell the kinds apart; short contexts are kept whole, a unit so far as 61 bits of its hash
    return symbols, [(c << np.uint64(3)) | np.uint64(k) for k, c in enumerate((*contexts, so_far))], unit


def _pairs(contexts: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """64-bit keys of contexts with symbols."""
    return mixed(contexts ^ mixed((symbols.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE)))


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, a place of each, how often it occurs, and the rank of every key."""
    if not len(keys):
        return keys, *[np.zeros(0, np.int64)] * 3
    low = np.uint64((1 << len(keys).bit_length()) - 1)
    both = np.sort((keys & ~low) | np.arange(len(keys), dtype=np.uint64))
    place = (both & low).astype(np.int64)
    found = keys[place]
    new = np.concatenate([[True], found[1:] != found[:-1]])
    if (new[1:] & ((both[1:] & ~low) == (both[:-1] & ~low))).any():  # different keys with equal high bits
        distinct, first, inverse, n = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        return distinct, first, n, inverse
    first = np.flatnonzero(new)
    rank = np.empty(len(keys), np.int64)
    rank[place] = np.cumsum(new) - 1
    return found[first], place[first], np.diff(np.append(first, len(keys))), rank


class Entries:
    """The distinct (context, symbol) pairs of a chunk of units with their counts, in the order of the blocks that sum them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, times: np.ndarray, blocks: int):
        self.symbols, contexts, self.unit = spelled(data, offsets)
        weight, parts, ranks, size = times[self.unit].astype(np.float64), [], [], 0
        for c in contexts:
            keys, place, _, rank = ranked(_pairs(c, self.symbols))
            parts.append((c[place], self.symbols[place], np.bincount(rank, weights=weight, minlength=len(keys)).astype(np.int64)))
            ranks.append(rank + size)
            size += len(keys)
        context, symbol, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        block = (mixed(context) >> np.uint64(20)) % np.uint64(blocks)
        order = np.argsort(block, kind="stable")
        self.block, self.context, self.symbol, self.n = block[order].astype(np.int64), context[order], symbol[order], n[order]
        where = np.empty(size, np.int64)
        where[order] = np.arange(size)
        self.ranks = [where[r] for r in ranks]


def _planes(x: np.ndarray) -> bytes:
    """The bytes of numbers, those of the same place together, which compress well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _unplaned(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def gated(shape: tuple[np.ndarray, ...]) -> np.ndarray:
    """The gate of states: what the two longest contexts have seen."""
    kinds = []
    for k in (K - 2, K - 1):
        last = 2 * (len(LEVELS[k]) + 1)
        kinds.append(np.minimum((shape[k] + 1) // 2, last // 2 + 1))
    return kinds[0] * GATE + kinds[1]


class Mixer:
    """Odds of states, weights and refinement, learned from how often either bit value followed each joint state; and the cost in bits of each in each joint state, before a text has moved them."""

    def __init__(self, zeros: np.ndarray, ones: np.ndarray):
        total, shape = zeros + ones, np.unravel_index(np.arange(CELLS), STATES)
        odds = []
        for k in range(K):
            n1, n = np.bincount(shape[k], ones, STATES[k]), np.bincount(shape[k], total, STATES[k])
            p = (n1 + 0.4) / (n + 0.8)
            odds.append(np.log(p / (1 - p)))
        self.odds, x = odds, np.stack([o[s] for o, s in zip(odds, shape, strict=True)], 1)
        gate = gated(shape)
        gates = int(gate.max()) + 1
        self.weights = np.full((gates, K), 0.3)
        some = np.flatnonzero(total)
        some = some[np.argsort(mixed(some.astype(np.uint64)), kind="stable")]
        square = np.full((gates, K), 1e-6)
        for _ in range(PASSES):
            for part in np.array_split(some, BATCHES):
                g = gate[part]
                miss = ones[part] - total[part] / (1 + np.exp(-np.clip((self.weights[g] * x[part]).sum(1), -WIDE, WIDE)))
                many = np.maximum(np.bincount(g, total[part], gates), 1)
                for k in range(K):
                    step = np.bincount(g, miss * x[part, k], gates) / many
                    square[:, k] += step * step
                    self.weights[:, k] += RATE * step / np.sqrt(square[:, k])
        mix = np.clip((self.weights[gate] * x).sum(1), -WIDE, WIDE)
        p = 1 / (1 + np.exp(-mix))
        cell = shape[1] * FINE + np.rint((mix + WIDE) * FINER).astype(np.int64)
        size = STATES[1] * FINE
        n1, n, expected, cells = np.bincount(cell, ones, size), np.bincount(cell, total, size), np.bincount(cell, p, size), np.bincount(cell, minlength=size)
        # a step that no joint state's odds come to, but a text's may
        middle = 1 / (1 + np.exp(-(np.arange(size) % FINE / FINER - WIDE)))
        self.fine = (n1 + 4 * np.where(cells > 0, expected / np.maximum(cells, 1), middle)) / (n + 4)
        p = np.clip((p + self.fine[cell]) / 2, LEAST, 1 - LEAST)
        self.cost = (-np.log2(np.stack([1 - p, p], 1))).astype(np.float32).ravel()


class Adaptive:
    """Mixing along texts: every text moves weights and refinement of its own, from the learned start."""

    def __init__(self, odds: list[np.ndarray], edge_odds: list[np.ndarray], weights: np.ndarray, fine: np.ndarray, rate: float, refine: float):
        x = [np.append(o, np.zeros((1 << t) - len(o))).astype(np.float32) for o, t in zip((*odds, *edge_odds), TAKES, strict=True)]
        # predictors go in pairs, a complex number each: their log odds by the states of both, where those are in a code, and their weights
        self.pairs = []
        for k in range(0, len(x), 2):
            one, two = x[k], x[k + 1] if k + 1 < len(x) else np.zeros(1, np.float32)
            self.pairs.append((AT[k], len(one) * len(two) - 1, (one[None, :] + 1j * two[:, None]).astype(np.complex64).ravel()))
        both = np.arange(1 << (TAKES[K - 2] + TAKES[K - 1]))
        seen = [np.minimum(x, STATES[K - 1] - 1) for x in (both & 31, both >> 5)]
        self.gate = gated((*[np.zeros(1, int)] * (K - 2), *seen)).astype(np.int64)
        every = np.concatenate([weights, np.zeros((len(weights), 2 * len(self.pairs) - K))], 1).astype(np.float32)
        self.weights = [np.ascontiguousarray(every[:, 2 * k] + 1j * every[:, 2 * k + 1]).astype(np.complex64) for k in range(len(self.pairs))]
        self.fine = fine.astype(np.float32)
        self.rate, self.refine = rate, refine

    def bits(self, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """What the decisions of each text cost. A code holds the bit and the states of all predictors."""
        n = np.diff(bounds)
        order, total = np.argsort(-n, kind="stable"), np.zeros(len(n))
        for some in (order[i : i + BESIDE] for i in range(0, len(order), BESIDE)):
            total[some] = self._beside(codes, bounds[:-1][some], n[some])
        return total

    def _beside(self, codes: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The same for some texts, longest first, which move side by side."""
        blocks = -(-n // STEP)
        begin = np.cumsum(blocks) - blocks
        table = np.full(int(blocks.sum()) * STEP, BEHIND << AT[K - 1], np.uint32)
        for a, i, size in zip((begin * STEP).tolist(), start.tolist(), n.tolist(), strict=True):
            table[a : a + size] = codes[i : i + size]
        table = table.reshape(-1, STEP)
        falling, total = -blocks, np.zeros(len(n))
        gates, cells = len(self.weights[0]), len(self.fine)
        left = [int(x) for x in np.searchsorted(falling, -np.arange(int(blocks.max(initial=0)) + 1))]  # texts with a block left
        w, fine = [np.tile(x, left[0]) for x in self.weights], np.tile(self.fine, left[0])
        gate_at, fine_at = (np.arange(left[0])[:, None] * size for size in (gates, cells))
        wide, finer, one, half, least = (np.float32(v) for v in (WIDE, FINER, 1, 0.5, LEAST))
        rate, refine = np.float32(self.rate), np.float32(self.refine)
        for b, (m, after) in enumerate(zip(left[:-1], left[1:], strict=True)):
            code = table[begin[:m] + b].astype(np.int64)
            bit = (code & 1).astype(np.float32)
            g = self.gate.take((code >> AT[K - 2]) & (len(self.gate) - 1), mode="clip")
            g += gate_at[:m]
            x = [odds.take((code >> at) & mask, mode="clip") for at, mask, odds in self.pairs]
            u = sum(o.view(np.float32) * v.take(g, mode="clip").view(np.float32) for o, v in zip(x, w, strict=True)).view(np.complex64)
            mix = u.real + u.imag
            np.clip(mix, -wide, wide, out=mix)
            p = one / (one + np.exp(-mix))
            f = ((code >> AT[1]) & 15) * FINE
            f += np.rint((mix + wide) * finer).astype(np.int64)
            f += fine_at[:m]
            r = fine.take(f, mode="clip")
            q = np.clip((p + r) * half, least, one - least)
            cost = np.log2(np.abs(q + bit - one))
            behind = ((code[after:] >> AT[K - 1]) & 31) == BEHIND  # only in a text's last block
            cost[after:][behind] = 0
            total[:m] -= cost.sum(1, dtype=np.float64)
            if self.rate:
                miss, off = (bit - p) * rate, (bit - r) * refine
                miss[after:][behind] = off[after:][behind] = 0
                twice, g = np.repeat(miss.ravel(), 2), g.ravel()
                for o, v in zip(x, w, strict=True):
                    moves = o.ravel().view(np.float32)
                    moves *= twice
                    np.add.at(v, g, moves.view(np.complex64))
                np.add.at(fine, f.ravel(), off.ravel())
        return total


def edges(data: np.ndarray, first: np.ndarray, length: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each unit: its first two symbols (-1: none), the contexts of the first predictor across the edge before either, and that of the second before the first."""
    n = len(first)
    data = np.append(data, np.uint8(0)).astype(np.int32)
    end = first + length
    one, two = np.zeros(n, np.int32), np.zeros(n, np.int32)
    one[1:] = data[np.maximum(end[:-1] - 1, 0)] + 1
    two[1:] = np.where(length[:-1] > 1, data[np.maximum(end[:-1] - 2, 0)] + 1, 0)
    one[bounds[:-1]] = two[bounds[:-1]] = 0
    symbol = np.where(length > 0, data[np.minimum(first, len(data) - 1)], END)
    second = np.where(length > 1, data[np.minimum(first + 1, len(data) - 1)], np.where(length == 1, END, -1))
    return symbol, second, one, 257 + one * 256 + np.minimum(symbol, 255), two * 257 + one


def seen_states(key: np.ndarray, n: np.ndarray, coder: Coder, k: int) -> tuple[tuple[np.ndarray, np.ndarray, int], np.ndarray]:
    """From counts of symbols in short contexts: (place, state, state of all other places) of what they have seen, and the odds of each state, from each decision without itself."""
    at, _, which = coder.decisions(key % 257)
    place, inverse = np.unique((key // 257)[at] * 256 + coder.node[which], return_inverse=True)
    n0, n1 = (np.bincount(inverse, n[at] * (coder.bit[which] == b), len(place)) for b in (0, 1))
    zeros = np.bincount(states(np.maximum(n0 - 1, 0), n1, k), n0, STATES[k])
    ones = np.bincount(states(n0, np.maximum(n1 - 1, 0), k), n1, STATES[k])
    return (place, states(n0, n1, k), int(states(np.zeros(1), np.zeros(1), k)[0])), np.log((ones + 0.4) / (zeros + 0.4))


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return key, np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(key)).astype(np.int64)


def _short(symbols: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """The contexts of one and two bytes of the unit before each symbol."""
    back = []
    for k in (1, 2):
        b = np.zeros(len(symbols), np.int32)
        b[k:] = symbols[: max(len(symbols) - k, 0)] + 1
        b[place < k] = 0
        back.append(b)
    return [back[0], back[1] * 257 + back[0]]


def unit_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The units of texts: their hashes, first bytes and lengths, and the first unit of each text; an empty unit ends each."""
    rows, n = len(offsets) - 1, len(data)
    blank = _SPACE[data]
    new = np.ones(n, bool)
    np.not_equal(blank[1:], blank[:-1], out=new[1:])
    new[offsets[:-1][offsets[:-1] < n]] = True
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, n))
    bounds = np.searchsorted(start, offsets)
    keep = np.ones(len(start), bool)
    if len(start):
        # one space between two words needs no unit
        single = blank[start] & (length == 1) & (data[start] == 32)
        full = np.flatnonzero(bounds[1:] > bounds[:-1])
        single[bounds[:-1][full]] = False
        single[bounds[1:][full] - 1] = False
        keep = ~single
        power = np.multiply.accumulate(np.full(int(length.max()), np.uint64(_BASE)))
        values = power[np.arange(n) - np.repeat(start, length)]
        values *= data.astype(np.uint64) + np.uint64(1)
        sums = mixed(np.add.reduceat(values, start))[keep]
    else:
        sums = np.zeros(0, np.uint64)
    kept = np.concatenate([[0], np.cumsum(keep)])[bounds]
    place = np.arange(len(sums)) + np.repeat(np.arange(rows), np.diff(kept))
    at = kept + np.arange(rows + 1)
    hashes, first, size = np.zeros(len(sums) + rows, np.uint64), np.zeros(len(sums) + rows, np.int64), np.zeros(len(sums) + rows, np.int64)
    hashes[place], first[place], size[place] = sums, start[keep], length[keep]
    return hashes, first, size, at


def _told(data: np.ndarray, offsets: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """What :func:`unit_runs` gives, and :func:`history` of it, found in runs of texts."""
    parts, told, units, a = [], [], 0, 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + RUN, side="right")) - 1)
        hashes, first, size, at = unit_runs(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        parts.append((hashes, first + offsets[a], size, at[:-1] + units))
        told.append(history(hashes, at))
        units += len(hashes)
        a = b
    hashes, first, size, at = (np.concatenate(x) for x in zip(*parts, strict=True))
    return (hashes, first, size, np.append(at, units)), tuple(np.concatenate(x) for x in zip(*told, strict=True))


def unit_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The hashes that :func:`unit_runs` gives to units, one row each."""
    length = np.diff(offsets)
    some = np.flatnonzero(length)
    out = np.zeros(len(length), np.uint64)
    if len(some):
        power = np.multiply.accumulate(np.full(int(length.max()), np.uint64(_BASE)))
        values = (data.astype(np.uint64) + np.uint64(1)) * power[np.arange(len(data)) - np.repeat(offsets[:-1], length)]
        out[some] = mixed(np.add.reduceat(values, offsets[:-1][some]))
    return out


def _before(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key, the place where it occurred last (-1: nowhere) and how often it occurred before."""
    _, _, n, rank = ranked(keys)
    order = np.argsort(rank, kind="stable")
    begin = np.cumsum(n) - n
    times = np.empty(len(keys), np.int64)
    times[order] = np.arange(len(keys)) - np.repeat(begin, n)
    last = np.full(len(keys), -1, np.int64)
    last[order[1:]] = np.where(times[order[1:]] > 0, order[:-1], -1)
    return last, times


def history(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How the units of texts follow from their own text: cells and bits of both decisions (-1 where not asked), whether a unit is new, and the bits that its share costs."""
    n = len(hashes)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    place = np.arange(n) - bounds[:-1][text]
    salt = mixed(text.astype(np.uint64) ^ np.uint64(0xA0761D6478BD642F))  # a constant of its own: one-byte units are hashed alike otherwise
    _, times = _before(mixed(hashes ^ salt))
    two = salt.copy()
    two[1:] ^= mixed(hashes[:-1] + np.uint64(1))
    two[2:] += mixed(hashes[:-2] ^ np.uint64(_BASE))
    two = mixed(two)
    short = place < 2
    two[short] = mixed(np.arange(int(short.sum()), dtype=np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
    last, _ = _before(two)
    asked = last >= 0
    hit = asked & (hashes[np.maximum(last, 0)] == hashes)
    # how long the match before this unit is, to MATCH - 1
    miss = np.where(hit, -1, np.arange(n))
    run = np.arange(n) - np.maximum.accumulate(miss)
    run = np.minimum(np.concatenate([[0], run[:-1]]) if n else run, place)
    match = np.where(asked, np.minimum(run, MATCH - 1), -1)
    old = times > 0
    past = np.zeros(n, np.int64)
    for k in (1, 2, 3):
        before = np.zeros(n, bool)
        before[k:] = old[:-k] if k < n else before[k:]
        before[place < k] = False
        past |= before.astype(np.int64) << (k - 1)
    size = np.minimum(np.frexp(place.astype(np.float64))[1], 15).astype(np.int64)
    seen = np.where(hit, -1, ((size * 8 + past) * 2 + asked))
    share = np.where(old & ~hit, np.log2(np.maximum(place, 1) / np.maximum(times, 1)), 0.0)
    return np.where(match < 0, -1, match * 2 + hit), np.where(seen < 0, -1, seen * 2 + old), ~old, share


def _counted(rows: DataFrame) -> DataFrame:
    """(kind, unit, n): the different units of all texts with their number in training texts (kind 0), the training texts' history decisions (1 and 2), and symbols in contexts across the edge of units (3 and 4)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        bits = [np.zeros(2 * MATCH, np.int64), np.zeros(2 * SEEN, np.int64)]
        across: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]

        def flushed() -> pa.RecordBatch:
            keys, units, n = np.concatenate([h[0] for h in held]), pa.concat_arrays([h[1] for h in held]), np.concatenate([h[2] for h in held])
            held.clear()
            distinct, place, _, rank = ranked(keys)
            return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(distinct), np.int32)), units.take(pa.array(place)), pa.array(np.bincount(rank, n, len(distinct)).astype(np.int64))], names=["kind", "unit", "n"])

        size = 0
        for batch in batches:
            flags = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for i, j, data, offsets in text_runs(batch.column(0), RUN):
                hashes, first, length, bounds = unit_runs(data, offsets)
                train = np.repeat(~flags[i:j], np.diff(bounds))
                keys, place, _, rank = ranked(hashes)
                ends = np.cumsum(length[place])
                at = np.arange(int(ends[-1])) + np.repeat(first[place] - (ends - length[place]), length[place])
                units = pa.LargeStringArray.from_buffers(len(place), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(data[at].tobytes())).cast(pa.string())
                held.append((keys, units, np.bincount(rank, train, len(keys))))
                size += len(keys)
                match, seen, _, _ = history(hashes, bounds)
                symbol, second, before, so_far, longer = edges(data, first, length, bounds)
                both = train & (second >= 0)
                for parts, keys in zip(across, (np.concatenate([before[train] * 257 + symbol[train], so_far[both] * 257 + second[both]]), longer[train] * 257 + symbol[train]), strict=True):
                    parts.append(np.unique(keys, return_counts=True))
                    if len(parts) == 16:
                        parts[:] = [_summed(parts)]
                for cells, found in zip(bits, (match, seen), strict=True):
                    cells += np.bincount(found[train & (found >= 0)], minlength=len(cells))
                if size > HELD:
                    size = 0
                    yield flushed()
        if held:
            yield flushed()
        for kind, cells in enumerate(bits, 1):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), kind, np.int32)), pa.array([str(c) for c in range(len(cells))]), pa.array(cells)], names=["kind", "unit", "n"])
        for kind, parts in enumerate(across, 3):
            if parts:
                key, n = _summed(parts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key).cast(pa.string()), pa.array(n)], names=["kind", "unit", "n"])

    return rows.select("text", "held_out").mapInArrow(build, "kind int, unit string, n long").groupBy("kind", "unit").agg(F.sum("n").alias("n"))


def _chunks(units: DataFrame) -> DataFrame:
    """(chunk, units, n): the units in order, in chunks of bounded size, one row each."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, j, _, _ in text_runs(batch.column(0), CHUNK):
                part = batch.slice(i, j - i)
                columns = [pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), c) for c in part.columns]
                yield pa.RecordBatch.from_arrays([pa.array([number]), *columns], names=["chunk", "units", "n"])
                number += 1

    return units.mapInArrow(build, "chunk long, units array<string>, n array<long>")


def _entries(batch: pa.RecordBatch, r: int, blocks: int) -> tuple[Entries, np.ndarray, np.ndarray, np.ndarray]:
    """The entries of a chunk, the counts of its units, their bytes and offsets."""
    units, n = (batch.column(c).slice(r, 1).flatten() for c in (1, 2))
    units, n = units.cast(pa.large_string()), n.to_numpy()
    offsets = np.frombuffer(units.buffers()[1], np.int64)[units.offset : units.offset + len(units) + 1]
    data = np.frombuffer(units.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return Entries(data, offsets - offsets[0], n, blocks), n, data, offsets - offsets[0]


def _short_counts(chunks: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """How often training units have each symbol (their bytes and ends) in each context of one and of two bytes."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(SHORT)]
        for batch in batches:
            for r in range(batch.num_rows):
                units, n = (batch.column(c).slice(r, 1).flatten() for c in (1, 2))
                n = n.to_numpy()
                for i, j, data, offsets in text_runs(units):
                    symbols, _, unit = spelled(data, offsets)
                    weight = n[i:j][unit]
                    some = np.flatnonzero(weight)
                    place = np.arange(len(symbols)) - (offsets[:-1] + np.arange(j - i))[unit]
                    for parts, context in zip(counts, _short(symbols, place), strict=True):
                        parts.append(_summed([((context * 257 + symbols)[some], weight[some])]))
                        if len(parts) == 16:
                            parts[:] = [_summed(parts)]
        for k, parts in enumerate(counts):
            if parts:
                key, n = _summed(parts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), k, np.int32)), pa.array(key), pa.array(n)], names=["k", "key", "n"])

    got = chunks.mapInArrow(build, "k int, key long, n long").groupBy("k", "key").agg(F.sum("n").alias("n")).orderBy("k", "key").toArrow()  # at most 257 * (CONTEXTS + 257) rows
    k, key, n = (got.column(c).to_numpy() for c in range(3))
    return [(key[k == x], n[k == x]) for x in range(SHORT)]


def _returned(chunks: DataFrame, coder: Coder, blocks: int) -> DataFrame:
    """(chunk, block, all, others): the states along the paths of a chunk's entries, from all counts and without one occurrence of the symbol."""
    shared = chunks.sparkSession.sparkContext.broadcast(coder)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                e, *_ = _entries(batch, r, blocks)
                found, first = np.unique(e.block, return_index=True)
                cuts = [*first.tolist(), len(e.block)]
                columns = [[_planes(x[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)] for x in (e.context, e.symbol.astype(np.uint16), e.n)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), batch.column(0)[r].as_py())), pa.array(found), *(pa.array(c, pa.binary()) for c in columns)], names=["chunk", "block", "context", "symbol", "n"])

    def summed(t: pa.Table) -> pa.Table:
        code = shared.value
        context, symbol, n = (np.concatenate([_unplaned(x.as_py(), kind) for x in t.column(c)]) for c, kind in (("context", np.uint64), ("symbol", np.uint16), ("n", np.int64)))
        size = [len(x.as_py()) // 2 for x in t.column("symbol")]
        symbol = symbol.astype(np.int64)
        _, place, _, rank = ranked(_pairs(context, symbol))
        total = np.bincount(rank, n, len(place))
        context, symbol = context[place], symbol[place]
        # a part at a time, with all symbols of its contexts
        part = (mixed(context) >> np.uint64(40)) % np.uint64(1 + len(context) * 4 // SLICE)
        order = np.argsort(part, kind="stable")
        context, symbol, total, part = context[order], symbol[order], total[order], part[order]
        rank = np.argsort(order)[rank]
        every, other, cuts = [], [], [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            at, _, which = code.decisions(symbol[a:b])
            node, bit = code.node[which], code.bit[which]
            _, _, _, cell = ranked(mixed(context[a:b][at] ^ mixed((node.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE))))
            weight = total[a:b][at]
            n0, n1 = (np.bincount(cell, weight * (bit == v))[cell] if len(cell) else np.zeros(0) for v in (0, 1))
            kind = (context[a:b] & np.uint64(7)).astype(np.int64)[at]
            every.append(np.zeros(len(at), np.uint8))
            other.append(np.zeros(len(at), np.uint8))
            for k in range(K):
                m = np.flatnonzero(kind == k)
                zero, seen, one = n0[m], n1[m], bit[m]
                every[-1][m], other[-1][m] = states(zero, seen, k), states(np.maximum(zero - (1 - one), 0), np.maximum(seen - one, 0), k)
        every, other = np.concatenate(every), np.concatenate(other)
        # each chunk gets the paths of its own entries, in its order
        length = code.length[symbol]
        begin = np.cumsum(length) - length
        cuts, out = np.concatenate([[0], np.cumsum(size)]), [[], []]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            r = rank[a:b]
            l = length[r]  # noqa: E741
            where = np.arange(int(l.sum())) + np.repeat(begin[r] - (np.cumsum(l) - l), l)
            for o, x in zip(out, (every, other), strict=True):
                o.append(x[where].tobytes())
        return pa.table([t.column("chunk"), t.column("block"), pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary())], names=["chunk", "block", "every", "others"])

    rows = chunks.mapInArrow(sent, "chunk long, block long, context binary, symbol binary, n binary")
    return rows.groupBy("block").applyInArrow(summed, "chunk long, block long, every binary, others binary")


def _decided(batch: pa.RecordBatch, r: int, coder: Coder, blocks: int, column: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(joint state, bit, unit, count of the unit) of the decisions of a chunk, in slices."""
    e, n, _, _ = _entries(batch, r, blocks)
    parts = sorted(batch.column(3)[r].as_py(), key=lambda x: x["block"])
    paths = np.frombuffer(b"".join(p["every" if column == 0 else "others"] for p in parts), np.uint8)
    length = coder.length[e.symbol]
    begin = np.cumsum(length) - length
    for a in range(0, len(e.symbols), SLICE // 4):
        b = a + SLICE // 4
        at, step, which = coder.decisions(e.symbols[a:b])
        cell = np.zeros(len(at), np.int64)
        for k in range(K):
            cell *= STATES[k]
            cell += paths[begin[e.ranks[k][a:b]][at] + step]
        yield cell, coder.bit[which], e.unit[a:b][at], n


def _learned(table: DataFrame, coder: Coder, blocks: int) -> Mixer:
    """Count the joint states of all training decisions, each without itself, and learn from them."""
    shared = table.sparkSession.sparkContext.broadcast(coder)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * CELLS)
        for batch in batches:
            for r in range(batch.num_rows):
                for cell, bit, unit, n in _decided(batch, r, shared.value, blocks, 1):
                    np.add.at(counts, cell * 2 + bit, n[unit].astype(np.float64))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some].astype(np.int64))], names=["cell", "n"])

    got = table.mapInArrow(build, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most 2 * CELLS rows
    counts = np.zeros(2 * CELLS)
    counts[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return Mixer(counts[0::2], counts[1::2])


def _spellings(table: DataFrame, coder: Coder, blocks: int) -> DataFrame:
    """(key, unit, n, code): the states that the longer contexts have for the decisions that spell each unit, two bytes each, turned by the bits, so that they compress."""
    shared = table.sparkSession.sparkContext.broadcast(coder)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned = _turned()
        for batch in batches:
            for r in range(batch.num_rows):
                raws, many = [], 0
                for cell, bit, unit, n in _decided(batch, r, shared.value, blocks, 0):
                    shape, raw = np.unravel_index(cell, STATES), np.zeros(len(cell), "<u2")
                    for k in range(SHORT, K):
                        raw |= (shape[k] << (AT[k] - AT[SHORT])).astype("<u2")
                    raws.append(turned.take(raw.astype(np.int64) << 1 | bit))
                    many += np.bincount(unit, minlength=len(n))
                raw = np.concatenate(raws)
                ends = np.concatenate([[0], np.cumsum(many * 2)]).astype(np.int64)
                code = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(raw)]).cast(pa.binary())
                units = batch.column(1).slice(r, 1).flatten()
                _, _, data, offsets = next(text_runs(units, 1 << 62))
                yield pa.RecordBatch.from_arrays([pa.array(unit_hashes(data, offsets).view(np.int64)), units, pa.array(n), code], names=["key", "unit", "n", "code"])

    return table.mapInArrow(build, "key long, unit string, n long, code binary")


def _among(ordered: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are among those in order, and where."""
    if not len(ordered):
        return np.zeros(len(key), bool), np.zeros(len(key), np.int64)
    spot = np.minimum(np.searchsorted(ordered, key), len(ordered) - 1)
    return ordered[spot] == key, spot


def _slices(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of stretches that together have about ``SLICE`` decisions."""
    ends = np.cumsum(size)
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE, side="right")))
        yield a, b
        a = b


def _raw(code: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The decisions in a column of codes, and how many each row has."""
    code = code.cast(pa.large_binary())
    ends = np.frombuffer(code.buffers()[1], np.int64)[code.offset : code.offset + len(code) + 1] if len(code) else np.zeros(1, np.int64)
    return np.frombuffer(code.buffers()[2] or b"", np.uint8)[int(ends[0]) : int(ends[-1])].view("<u2"), np.diff(ends) // 2


class Known:
    """Units by key: whether they are tokens, how often their words occur, and the decisions that spell them."""

    def __init__(self, key: np.ndarray, token: np.ndarray, count: np.ndarray, raw: np.ndarray, length: np.ndarray):
        order = np.argsort(key)
        self.key, self.token, self.count, self.raw = key[order], token[order], count[order], raw
        self.begin, self.length = (np.cumsum(length) - length)[order], length[order]

    def found(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are here, and where."""
        return _among(self.key, key)


def _packs(rows: DataFrame, often_keys) -> DataFrame:
    """(pack, id, length, text, held_out, rare): texts of like length in packs of bounded size, one row each, their bytes compressed, with the keys of their units that are not among ``often_keys``, which are in order."""
    kind = rows.schema["id"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, number = often_keys.value, TaskContext.get().partitionId() << 32
        for batch in batches:
            batch = batch.take(pa.array(np.argsort(pc.binary_length(batch.column(1)).to_numpy(), kind="stable")))
            for i, j, whole, offsets in text_runs(batch.column(1), PACK):
                length, packed = np.diff(offsets), pa.compress(whole.tobytes(), "zstd", asbytes=True)
                part, rare = batch.slice(i, j - i), [np.zeros(0, np.int64)]
                for _, _, data, offsets in text_runs(part.column(1), RUN):
                    keys = np.unique(unit_runs(data, offsets)[0].view(np.int64))
                    rare.append(keys[~_among(often, keys)[0]])
                columns = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (part.column(0), pa.array(length), part.column(2), pa.array(np.unique(np.concatenate(rare))))]
                yield pa.RecordBatch.from_arrays([pa.array([number]), *columns, pa.array([packed], pa.binary())], names=["pack", "id", "length", "held_out", "rare", "text"])
                number += 1

    return rows.select("id", "text", "held_out").mapInArrow(build, f"pack long, id array<{kind}>, length array<long>, held_out array<boolean>, rare array<long>, text binary")


def _gathered(joined: DataFrame) -> DataFrame:
    """(pack, n, decisions, units): rows of (pack, spot, token, c, code), those of a pack that come together as one row, column by column and compressed."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def sent() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            pack, spot, c = (t.column(x).to_numpy() for x in ("pack", "spot", "c"))
            token = t.column("token").to_numpy().astype(np.uint8)
            raw, length = _raw(t.column("code").combine_chunks() if t.num_rows else pa.array([], pa.binary()))
            begin, order, out = np.cumsum(length) - length, np.lexsort((spot, pack)), []
            for some in np.split(order, np.flatnonzero(np.diff(pack[order])) + 1):
                code = raw[_places(begin[some], length[some])]
                states = [((code >> (AT[k] - AT[SHORT])) & ((1 << TAKES[k]) - 1)).astype(np.uint8).tobytes() for k in range(SHORT, K)]
                columns = (_planes(np.diff(spot[some], prepend=0).astype(np.int32)), token[some].tobytes(), _planes(c[some]), _planes(length[some].astype(np.int32)), *states)
                out.append((int(pack[some[0]]), len(some), len(code), pa.compress(b"".join(columns), "zstd", asbytes=True)))
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["pack", "n", "decisions", "units"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows > GATHERED:
                rows = 0
                yield sent()
        if held:
            yield sent()

    return joined.select("pack", "spot", "token", "c", "code").mapInArrow(build, "pack long, n long, decisions long, units binary")


def _spread(units: list[dict], keys: np.ndarray) -> Known:
    """The units of a pack, from its rows of :func:`_gathered` and their keys by spot."""
    parts = [[np.zeros(0, kind)] for kind in (np.int64, np.bool_, np.int64, "<u2", np.int64)]
    for x in units:
        n, many = x["n"], x["decisions"]
        data, at = pa.decompress(x["units"], 17 * n + (K - SHORT) * many, "zstd", asbytes=True), 0

        def column(size: int) -> bytes:
            nonlocal at
            at += size
            return data[at - size : at]  # noqa: B023

        spot, token, c, length = np.cumsum(_unplaned(column(4 * n), np.int32)), np.frombuffer(column(n), np.bool_), _unplaned(column(8 * n), np.int64), _unplaned(column(4 * n), np.int32)
        code = np.zeros(many, "<u2")
        for k in range(SHORT, K):
            code |= np.frombuffer(column(many), np.uint8).astype("<u2") << (AT[k] - AT[SHORT])
        for part, got in zip(parts, (keys[spot], token, c, code, length.astype(np.int64)), strict=True):
            part.append(got)
    return Known(*(np.concatenate(p) for p in parts))


def _scored(packs: DataFrame, known) -> DataFrame:
    """Per text of packs: tokens, known tokens, the sum of their base logs, bits and bytes."""
    kind = packs.schema["id"].dataType.elementType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, coder, found, (on_match, on_seen), learned = known.value
        model, seen_at = Adaptive(*learned), []
        for place, state, other in found:
            # a row for each context that was seen, and one for all others
            context, rows = place // 256, np.zeros(CONTEXTS, np.int64)
            some = np.unique(context)
            rows[some] = np.arange(1, len(some) + 1) * 256
            table = np.full((len(some) + 1) * 256, other, np.uint8)
            table[rows[context] + place % 256] = state
            seen_at.append((rows, table))
        bit_at, turned = coder.bit.astype(np.uint32), _turned()

        def seen_as(k: int, context: np.ndarray, length: np.ndarray, node: np.ndarray) -> np.ndarray:
            """The states of a short context for the decisions of symbols, of which each has ``length``."""
            rows, table = seen_at[k]
            at = np.repeat(rows.take(context, mode="clip"), length)
            at += node
            return table.take(at, mode="clip").astype(np.uint32)

        def coded(data: np.ndarray, offsets: np.ndarray, units: list[dict]) -> tuple[list[np.ndarray], np.ndarray]:
            (hashes, first, length, bounds), (match, seen, new, share) = _told(data, offsets)
            bits = share + np.where(match >= 0, on_match[match], 0.0) + np.where(seen >= 0, on_seen[seen], 0.0)
            keys, spot, _, rank = ranked(hashes)
            keys, data = keys.view(np.int64), np.append(data, np.uint8(0))
            token, count, size, begin = np.zeros(len(keys), bool), *np.zeros((3, len(keys)), np.int64)
            done, rare = 0, _spread(units, np.sort(keys[~often.found(keys)[0]]))
            for source in (often, rare):
                hit, where = source.found(keys)
                hit = np.flatnonzero(hit)
                where = where[hit]
                token[hit], count[hit], size[hit], begin[hit] = source.token[where], source.count[where], source.length[where], source.begin[where] + done
                done += len(source.raw)
            # the decisions of each different unit, with the states of the contexts within it
            ends = np.concatenate([[0], np.cumsum(size)])
            spelling = np.empty(int(ends[-1]), np.uint32)
            for a, b in _slices(size):
                at = _places(begin[a:b], size[a:b])
                far = at >= len(often.raw)
                codes = often.raw.take(at, mode="clip") if len(often.raw) else np.zeros(len(at), "<u2")
                codes[far] = rare.raw[at[far] - len(often.raw)]
                # their symbols, with an end mark each
                more = length[spot[a:b]] + 1
                place = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more)
                symbols = data[np.minimum(_places(first[spot[a:b]], more), len(data) - 1)].astype(np.int32)
                symbols[np.cumsum(more) - 1] = END
                long = coder.length[symbols]
                path = _places(coder.first[symbols], long)
                bit = bit_at.take(path, mode="clip")
                codes = turned.take(codes.astype(np.int64) << 1 | bit, mode="clip").astype(np.uint32) << AT[SHORT] | bit
                node = coder.node.take(path, mode="clip")
                for k, context in enumerate(_short(symbols, place)):
                    codes |= seen_as(k, context, long, node) << AT[k]
                codes |= np.uint32(UNSEEN << AT[K] | UNSEEN << AT[K + 1])
                spelling[ends[a] : ends[b]] = codes
            # those of the units that are new to their text, in order, with the states of the contexts across the edge
            new = np.flatnonzero(new)
            begin, size = ends[rank[new]], size[rank[new]]
            symbol, second, before, so_far, longer = (x[new] for x in edges(data[:-1], first, length, bounds))
            ends = np.concatenate([[0], np.cumsum(size)])
            codes = np.empty(int(ends[-1]), np.uint32)
            for a, b in _slices(size):
                part = spelling.take(_places(begin[a:b], size[a:b]), mode="clip")
                start = ends[a:b] - ends[a]
                for e, at, context, x in ((0, start, before, symbol), (1, start, longer, symbol), (0, start + coder.length[symbol[a:b]], so_far, second)):
                    some = np.flatnonzero(x[a:b] >= 0)
                    x = x[a:b][some]
                    long = coder.length[x]
                    state = seen_as(SHORT + e, context[a:b][some], long, coder.node.take(_places(coder.first[x], long), mode="clip"))
                    part[_places(at[some], long)] ^= (state ^ np.uint32(UNSEEN)) << AT[K + e]
                codes[ends[a] : ends[b]] = part
            token, count = token[rank], count[rank]

            def sums(x: np.ndarray) -> np.ndarray:
                total = np.concatenate([[0], np.cumsum(x)])
                return total[bounds[1:]] - total[bounds[:-1]]

            return [sums(token), sums(token & (count > 0)), sums(np.where(token, np.log10(count + 0.1), 0.0)), sums(bits), np.diff(offsets), np.diff(ends[np.searchsorted(new, bounds)])], codes

        for batch in batches:
            for r in range(batch.num_rows):
                ids, length, flags = (batch.column(c).slice(r, 1).flatten() for c in ("id", "length", "held_out"))
                ends = np.concatenate([[0], np.cumsum(length.to_numpy())]).astype(np.int64)
                whole = pa.decompress(batch.column("text")[r].as_buffer(), int(ends[-1]), "zstd") if ends[-1] else pa.py_buffer(b"")
                texts = pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(ends), whole)
                (*columns, n), codes = coded(*next(text_runs(texts, 1 << 62))[2:], batch.column("rare")[r].as_py())
                columns[3] = columns[3] + model.bits(codes, np.concatenate([[0], np.cumsum(n)]))
                yield pa.RecordBatch.from_arrays([ids, flags, *(pa.array(x) for x in columns)], names=["id", "held_out", "n_tokens", "n_known", "base", "bits", "n_bytes"])

    return packs.mapInArrow(build, f"id {kind}, held_out boolean, n_tokens long, n_known long, base double, bits double, n_bytes long")


# A-Z and what they are lower-cased to.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.0, refine: float = 0.0) -> DataFrame:
    """Unigram and mixed-context scores of every text, learned from the rows where ``held_out`` is false.

    Weights and refinement move along each text by ``rate`` and ``refine`` (``ADAPT`` and ``REFINE``
    suit most texts); with a rate of zero they stay where training has left them.

    Per row: id, held_out, n_tokens, n_known, train_tokens, base_score (log10, additive smoothing of
    0.1 over the training words and one unknown), score (log10 probability of the text), n_bytes and
    bits_per_byte (of bytes and end mark). A null text is empty: one end token. A row with a null
    ``held_out`` is held out. Repeated rows are texts of their own; a null id is a row like any
    other. With no training text, counts are all zero; an empty table gives an empty one. A very
    long text is scored whole.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(True)).alias("held_out"))
    counted = written(_counted(rows), "counted")
    bits = [np.full(2 * MATCH, 0.5), np.full(2 * SEEN, 0.5)]
    for r in counted.filter("kind in (1, 2)").collect():  # at most 2 * (MATCH + SEEN) rows
        bits[r["kind"] - 1][int(r["unit"])] += r["n"]
    flags = [-np.log2((b.reshape(-1, 2) / b.reshape(-1, 2).sum(1, keepdims=True)).ravel()) for b in bits]
    across = []
    for kind in range(3, 3 + EDGES):  # at most 257 * CONTEXTS rows, two bytes and a symbol
        got = counted.filter(F.col("kind") == kind).select(F.col("unit").cast("long").alias("key"), "n").orderBy("key").toArrow()
        across.append((got.column(0).to_numpy(), got.column(1).to_numpy()))
    units = counted.filter("kind = 0").select("unit", "n")
    chunks = written(_chunks(units.orderBy("unit")), "units")
    size = units.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("unit")).alias("bytes")).first()
    blocks = 1 + (size["n"] + (size["bytes"] or 0)) * K // BLOCK
    short = _short_counts(chunks)
    coder = Coder(np.bincount(short[0][0] % 257, short[0][1], 257).astype(np.int64))
    back = _returned(chunks, coder, blocks).groupBy("chunk").agg(F.collect_list(F.struct("block", "every", "others")).alias("paths"))
    table = written(chunks.join(back, "chunk").select("chunk", "units", "n", "paths"), "paths")
    dropped(chunks)
    swept(spark)
    mixer = _learned(table, coder, blocks)
    spellings = written(_spellings(table, coder, blocks), "spellings")
    dropped(table)
    dropped(counted)
    swept(spark)

    # The base is over lower-cased words and one end a text; white space units are no words.
    token = F.col("unit").rlike(r"^[^\x20\x09-\x0D]") | (F.col("unit") == "")
    same = Window.partitionBy(F.translate("unit", _UPPER, _LOWER))
    band = F.floor(F.log2(F.col("n") + 1) * 4)
    prices = spellings.select(
        "key", band.alias("band"), F.octet_length("unit").alias("bytes"), token.alias("token"), F.when(token, F.sum("n").over(same)).otherwise(0).alias("c"),
        (token & (F.col("unit") == F.min("unit").over(same))).alias("first"), "code",
    )
    prices = written(prices, "prices")
    dropped(spellings)
    swept(spark)
    totals = prices.filter("first and c > 0").agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n")).first()
    total, distinct = totals["n"] or 0, totals["v"]
    bands = prices.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).orderBy(F.desc("band")).collect()
    least, room, most = None, FREQUENT, FREQUENT * FREQUENT_BYTES
    for found in bands:  # the most frequent bands that fit
        room, most = room - found["n"], most - found["bytes"]
        if room < 0 or most < 0:
            break
        least = found["band"]
    often = F.lit(False) if least is None else F.col("band") >= least
    top = prices.filter(often).select("key", "token", "c", "code").orderBy("key").toArrow().combine_chunks()
    code = top.column("code").combine_chunks() if top.num_rows else pa.array([], pa.binary())
    keys = top.column("key").to_numpy()
    found = [seen_states(*counts, coder, k) for counts, k in zip((*short, *across), (*range(SHORT), *[EDGE_STATE] * EDGES), strict=True)]
    shared = spark.sparkContext.broadcast((
        Known(*(top.column(c).to_numpy() for c in ("key", "token", "c")), *_raw(code)), coder, [f[0] for f in found], flags,
        (mixer.odds, [f[1] for f in found[SHORT:]], mixer.weights, mixer.fine, rate, refine),
    ))

    often_keys = spark.sparkContext.broadcast(keys)
    packs = written(_packs(rows, often_keys), "packs")
    often_keys.unpersist()
    swept(spark)
    parts = 1 + packs.count() // PACKS
    # A unit that isn't among the frequent ones comes by a join, once for each pack that has it.
    lone = packs.select("pack", F.posexplode("rare").alias("spot", "key"))
    joined = lone.join(prices.filter(~often).select("key", "token", "c", "code"), "key")
    gathered = written(_gathered(joined), "gathered")
    dropped(prices)
    swept(spark)
    rare = gathered.repartition(parts, "pack").groupBy("pack").agg(F.collect_list(F.struct("n", "decisions", "units")).alias("rare"))
    whole = packs.drop("rare").repartition(parts, "pack").join(rare, "pack", "left").withColumn("rare", F.coalesce("rare", F.array().cast(rare.schema["rare"].dataType)))
    scored = written(_scored(whole, shared), "scored")
    for left in (packs, gathered):
        dropped(left)
    below = float(np.log10(total + 0.1 * (distinct + 1)))
    return scored.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(below)).alias("base_score"), (-F.col("bits") * F.lit(float(np.log10(2)))).alias("score"),
        "n_bytes", (F.col("bits") / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
