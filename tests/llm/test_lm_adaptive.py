"""The language model along a text: what every decision teaches, and what is seen across the edge of units."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_lm import Plain, state, texts_of, units_of

from tributary.llm import lm


class Moving(Plain):
    """The plain model with weights and refinement that a text moves after each step of its decisions."""

    def __init__(self, texts, held):
        super().__init__(texts, held)
        zeros, ones = np.zeros(lm.CELLS), np.zeros(lm.CELLS)
        for u, c in self.train.items():
            for where, bit in self.decisions(u):
                (ones if bit else zeros)[self.cell(where, bit, 1)] += c
        self.mixer = lm.Mixer(zeros, ones)
        self.across = defaultdict(lambda: [0, 0])
        for t, h in zip(texts, held, strict=True):
            if not h:
                for keys, bit in self.crossing(units_of(t)):
                    for key in keys:
                        if key:
                            self.across[key][bit] += 1
        n = np.zeros((2, lm.UNSEEN, 2))
        for key, both in self.across.items():
            for bit in (0, 1):
                less = list(both)
                less[bit] -= 1
                if both[bit]:
                    n[key[0], state(*less, lm.EDGE_STATE), bit] += both[bit]
        self.across_odds = np.log((n[:, :, 1] + 0.4) / (n[:, :, 0] + 0.4))

    def crossing(self, units):
        """(keys of both predictors or None, bit) of all decisions that spell units."""
        for before, u in zip(["", *units[:-1]], units, strict=True):
            before, b = before.encode(), u.encode()
            for i in range(len(b) + 1):
                for node, bit in self.paths[b[i] if i < len(b) else 256]:
                    yield ((0, before[-1:], b[:i], node) if i < 2 else None, (1, before[-2:], node) if i < 1 else None), bit

    def bits(self, text, rate, refine):
        flags, self.cost = 0.0, np.zeros(2 * lm.CELLS)
        flags += super().bits(text)
        units = units_of(text)
        new = [kind == "new" for _, _, (kind, *_) in self.told(text)]
        decisions = []
        for i, u in enumerate(units):
            if new[i]:
                edge = list(self.crossing([units[i - 1], u] if i else ["", u]))[-sum(1 for _ in self.decisions(u)) :]
                decisions += [(where, bit, keys) for (where, bit), (keys, _) in zip(self.decisions(u), edge, strict=True)]
        weights, fine, total = np.concatenate([self.mixer.weights, np.zeros((len(self.mixer.weights), 2))], 1), self.mixer.fine.copy(), flags
        for at in range(0, len(decisions), lm.STEP):
            moves, refined = np.zeros_like(weights), np.zeros_like(fine)
            for where, bit, keys in decisions[at : at + lm.STEP]:
                states = np.unravel_index(self.cell(where, bit, 0), lm.STATES)
                x = [o[s] for o, s in zip(self.mixer.odds, states, strict=True)]
                x += [self.across_odds[e][state(*self.across.get(key, (0, 0)), lm.EDGE_STATE)] if key else 0.0 for e, key in enumerate(keys)]
                gate = int(lm.gated(tuple(np.array([s]) for s in states))[0])
                mix = min(max(float(weights[gate] @ x), -lm.WIDE), lm.WIDE)
                p = 1 / (1 + math.exp(-mix))
                cell = states[1] * lm.FINE + round((mix + lm.WIDE) * lm.FINER)
                q = min(max((p + fine[cell]) / 2, lm.LEAST), 1 - lm.LEAST)
                total -= math.log2(q if bit else 1 - q)
                moves[gate] += rate * (bit - p) * np.array(x)
                refined[cell] += refine * (bit - fine[cell])
            weights += moves
            fine += refined
        return total


@pytest.mark.parametrize("often", [400_000, 100])
def test_adaptive_scores_equal_a_plain_model(spark, monkeypatch, often):
    """With all units at hand and with most of them joined, in packs of a few texts; every text moves its own weights."""
    monkeypatch.setattr(lm, "FREQUENT", often)
    texts = [t[:300] for t in texts_of(spark, 60)] + ["", " ", "a", "a a a", "x y\n\nx y x y z", "é ü é ü é", "q" * 300]
    held = [i % 7 == 0 for i in range(len(texts))]
    plain = Moving(texts, held)
    docs = spark.createDataFrame(list(zip(range(len(texts)), texts, held, strict=True)), "doc_id long, text string, h boolean").repartition(2)
    got = {r.doc_id: -r.score / math.log10(2) for r in lm.score(docs, F.col("h"), rate=0.02, refine=0.02).collect()}
    frozen = {i: plain.bits(t, 0.0, 0.0) for i, t in enumerate(texts)}
    moved = {i: plain.bits(t, 0.02, 0.02) for i, t in enumerate(texts)}
    assert all(abs(got[i] - moved[i]) < 1e-3 * max(1, moved[i]) for i in moved)
    assert sum(abs(frozen[i] - moved[i]) > 1e-2 * moved[i] for i in moved) > len(texts) // 2


def test_a_text_is_priced_before_it_is_learned_from():
    """Decisions of the first step cost what they do without moves; a repeated surprise costs less later; texts don't meet."""
    r = np.random.default_rng(4)
    mixer = lm.Mixer(r.integers(0, 9, lm.CELLS).astype(float), r.integers(0, 9, lm.CELLS).astype(float))
    still, moving = (lm.Adaptive(mixer.odds, [np.zeros(lm.UNSEEN)] * 2, mixer.weights, mixer.fine, rate, rate) for rate in (0.0, 0.02))
    n = [lm.STEP, 1, 0, 40 * lm.STEP + 5]
    codes = np.full(sum(n), 1 | 3 << lm.AT[0] | 2 << lm.AT[1] | 5 << lm.AT[2] | 6 << lm.AT[3] | 6 << lm.AT[4] | lm.UNSEEN << lm.AT[5] | lm.UNSEEN << lm.AT[6], np.uint32)
    a, b = (m.bits(codes, np.concatenate([[0], np.cumsum(n)])) for m in (still, moving))
    assert np.allclose(a[:3], b[:3], rtol=1e-6) and a[2] == 0 and np.allclose(a[3] / n[3], a[1], rtol=1e-5)
    assert b[3] < 0.9 * a[3]
    alone = moving.bits(codes[: n[3]], np.array([0, n[3]]))
    assert alone[0] == b[3]
