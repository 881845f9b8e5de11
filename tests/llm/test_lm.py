import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.llm import lm


def units_of(text):
    """The units of a text: words, white space that isn't one space between words, and the end."""
    runs = re.findall(r"[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    return [u for i, u in enumerate(runs) if u != " " or i in (0, len(runs) - 1)] + [""]


def state(n0, n1, k):
    steps, levels, n = lm.STEPS[k], lm.LEVELS[k], n0 + n1
    middle = (steps - 1) / 2
    step = int(min(max(round(math.log((n1 + 0.4) / (n0 + 0.4)) * (middle / lm.EDGE) + middle), 0), steps - 1))
    if not levels:
        return step
    if n <= 0:
        return 0
    if n0 and n1:
        return 1 + 2 * (len(levels) + 1) + step
    return 1 + 2 * sum(n >= x for x in levels) + (n1 > 0)


class Plain:
    """The model with dictionaries, a unit and a decision at a time."""

    def __init__(self, texts, held):
        self.train = Counter(u for t, h in zip(texts, held, strict=True) if not h for u in units_of(t))
        counts = np.zeros(257, np.int64)
        for u, c in self.train.items():
            for b in u.encode():
                counts[b] += c
            counts[256] += c
        self.paths = lm.huffman(counts)
        self.seen = defaultdict(lambda: [0, 0])
        for u, c in self.train.items():
            for where, bit in self.decisions(u):
                for key in where:
                    self.seen[key][bit] += c
        zeros, ones = np.zeros(lm.CELLS), np.zeros(lm.CELLS)
        for u, c in self.train.items():
            for where, bit in self.decisions(u):
                (ones if bit else zeros)[self.cell(where, bit, 1)] += c
        self.cost = lm.Mixer(zeros, ones).cost
        self.flags = Counter()
        for t, h in zip(texts, held, strict=True):
            if not h:
                self.flags.update(x for x, _, _ in self.told(t) if x)
                self.flags.update(y for _, y, _ in self.told(t) if y)

    def decisions(self, unit):
        b = unit.encode()
        for i in range(len(b) + 1):
            before = [b[max(0, i - k) : i] for k in (1, 2, 3, 4)] + [b[:i]]
            for node, bit in self.paths[b[i] if i < len(b) else 256]:
                yield [(k, x, node) for k, x in enumerate(before)], bit

    def cell(self, where, bit, less):
        out = 0
        for k, key in enumerate(where):
            n = list(self.seen[key])
            n[bit] = max(n[bit] - less, 0)
            out = out * lm.STATES[k] + state(*n, k)
        return out

    def spelled(self, unit):
        return sum(float(self.cost[self.cell(where, bit, 0) * 2 + bit]) for where, bit in self.decisions(unit))

    @staticmethod
    def told(text):
        """(match decision, history decision, what is coded then) of each unit."""
        units, follows, count, run, old = units_of(text), {}, Counter(), 0, []
        for t, u in enumerate(units):
            pair = (units[t - 2], units[t - 1]) if t >= 2 else None
            asked = pair in follows
            hit = asked and follows[pair] == u
            match = ("m", min(run, lm.MATCH - 1), hit) if asked else None
            past = sum(o << k for k, o in enumerate(old[::-1][:3]))
            again = None if hit else ("s", min(t.bit_length(), 15), past, asked, count[u] > 0)
            yield match, again, ("hit",) if hit else ("share", t / count[u]) if count[u] else ("new", u)
            run = run + 1 if hit else 0
            old.append(count[u] > 0)
            count[u] += 1
            if pair:
                follows[pair] = u

    def bits(self, text):
        total = 0.0
        for match, again, (kind, *what) in self.told(text):
            for flag in (match, again):
                if flag:
                    n, other = self.flags[flag] + 0.5, self.flags[(*flag[:-1], not flag[-1])] + 0.5
                    total -= math.log2(n / (n + other))
            total += math.log2(what[0]) if kind == "share" else self.spelled(what[0]) if kind == "new" else 0.0
        return total


def texts_of(spark, n):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 3000").orderBy("doc_id").limit(n).collect()
    return [r.text for r in docs]


@pytest.mark.parametrize("often", [400_000, 300])
def test_scores_equal_a_plain_model(spark, monkeypatch, often):
    """Two hundred short texts, with all units at hand and with most of them joined."""
    monkeypatch.setattr(lm, "FREQUENT", often)
    monkeypatch.setattr(lm, "CHUNK", 1 << 14)
    monkeypatch.setattr(lm, "BLOCK", 50_000)
    texts = [t[:400] for t in texts_of(spark, 190)] + ["", " ", "a", "a a a a a a", "x y\n\nx y x y z", "  b ", "\t", "é ü é ü é", "q" * 300, "A a"]
    held = [i % 7 == 0 for i in range(len(texts))]
    plain = Plain(texts, held)
    docs = spark.createDataFrame(list(zip(range(len(texts)), texts, held, strict=True)), "doc_id long, text string, h boolean").repartition(3)
    got = {r.doc_id: r for r in lm.score(docs, F.col("h")).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = plain.bits(t)
        assert abs(-got[i].score / math.log10(2) - want) < 1e-3 * max(1, want), (t, want)


def test_spelling_is_a_distribution():
    """The probabilities of all next symbols sum to one, whatever their contexts hold."""
    r = np.random.default_rng(2)
    coder = lm.Coder(r.integers(0, 50, 257))
    cost = lm.Mixer(r.integers(0, 3, lm.CELLS).astype(float), r.integers(0, 3, lm.CELLS).astype(float)).cost
    at, _, which = coder.decisions(np.arange(257))
    joint = r.integers(0, lm.CELLS, 257)[coder.node[which]]  # a node has one state in one place of a text
    each = np.exp2(-np.bincount(at, cost[joint * 2 + coder.bit[which]]))
    assert abs(each.sum() - 1) < 1e-3


def test_units_of_texts():
    texts = ["ab  cd e", "", " ab", "x\n", "é  "]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    hashes, first, length, bounds = lm.unit_runs(data, offsets)
    found = [[bytes(data[first[i] : first[i] + length[i]]).decode() for i in range(a, b)] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert found == [units_of(t) for t in texts]
    flat = [u for f in found for u in f]
    raw = np.frombuffer("".join(flat).encode(), np.uint8)
    assert (lm.unit_hashes(raw, np.cumsum([0, *(len(u.encode()) for u in flat)])) == hashes).all()


def test_counts_grow_with_the_contexts(spark):
    """Every unit so far keeps its own count, also beyond any fixed number of slots."""
    letters = np.random.default_rng(3).integers(97, 123, (40_000, 10)).astype(np.uint8)
    words = sorted({bytes(w).decode() for w in letters})
    entries = lm.Entries(np.frombuffer("".join(words).encode(), np.uint8), np.arange(len(words) + 1) * 10, np.ones(len(words), np.int64), 7)
    last = (entries.context & np.uint64(7)) == 4
    want = {(w[:k], w[k : k + 1]) for w in words for k in range(11)}
    assert last.sum() == len(want) and entries.n[last].sum() == 11 * len(words)


def test_scores_of_odd_texts(spark):
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (3, "a"), (None, "é" * 3000), (5, "ab " * 60_000)], "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("key", F.lit("x"))
    for held in (F.lit(False), F.lit(True), F.lit(None).cast("boolean")):
        got = lm.score(odd, held).collect()
        assert len(got) == 6 and all(np.isfinite([r.score, r.base_score]).all() for r in got)
        assert {r.n_tokens for r in got if r.doc_id in (1, 2)} == {1}
        assert [r.n_tokens for r in got if r.doc_id == 5] == [60_001]
    assert lm.score(odd.limit(0), F.lit(False)).count() == 0


def test_scores_do_not_depend_on_partitions_or_ids(spark):
    texts = texts_of(spark, 60)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nameless = rows.withColumn("doc_id", F.lit(None).cast("long"))
    a, b, c = (sorted(round(r.bits_per_byte, 9) for r in lm.score(d, F.lit(False)).collect()) for d in (rows.repartition(1), rows.repartition(5), nameless))
    assert a == b == c
