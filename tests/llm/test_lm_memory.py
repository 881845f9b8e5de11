"""The language model's memory and disk: what is held at once is bounded, and what is sent is small."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from tributary.llm import lm


def test_mixing_holds_a_bounded_number_of_texts_at_once():
    """Weights of 20,000 short texts together took some 70 MB; texts are mixed 512 at a time."""
    r = np.random.default_rng(4)
    mixer = lm.Mixer(r.integers(0, 9, lm.CELLS).astype(float), r.integers(0, 9, lm.CELLS).astype(float))
    model = lm.Adaptive(mixer.odds, [np.zeros(lm.UNSEEN)] * 2, mixer.weights, mixer.fine, 0.02, 0.02)
    n = r.integers(0, 2 * lm.STEP, 20_000)
    codes = (1 | r.integers(0, 8, n.sum()) << lm.AT[0] | lm.UNSEEN << lm.AT[5] | lm.UNSEEN << lm.AT[6]).astype(np.uint32)
    bounds = np.concatenate([[0], np.cumsum(n)])
    tracemalloc.start()
    bits = model.bits(codes, bounds)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6
    some = r.integers(0, len(n), 20)
    assert all(model.bits(codes[bounds[i] : bounds[i + 1]], np.array([0, n[i]]))[0] == bits[i] for i in some)


def test_turning_states_by_their_bits_loses_nothing():
    """Valid states come back when turned again, and a context that has seen only this bit is the same for both bits."""
    turned = lm._turned()
    states = np.stack(np.meshgrid(*(np.arange(lm.STATES[k]) for k in range(lm.SHORT, lm.K)), indexing="ij"), -1).reshape(-1, lm.K - lm.SHORT)
    raw = sum(states[:, i] << (lm.AT[k] - lm.AT[lm.SHORT]) for i, k in enumerate(range(lm.SHORT, lm.K)))
    for bit in (0, 1):
        assert (turned[turned[raw << 1 | bit].astype(np.int64) << 1 | bit] == raw).all()
    one, zero = (sum(int(lm.states(np.array([z]), np.array([o]), k)[0]) << (lm.AT[k] - lm.AT[lm.SHORT]) for k in range(lm.SHORT, lm.K)) for z, o in ((0, 1), (1, 0)))
    assert turned[one << 1 | 1] == turned[zero << 1]


def test_units_gathered_for_packs_come_back(spark, monkeypatch):
    """Every rare unit of a pack returns with its token, count and decisions, however few rows a task holds."""
    monkeypatch.setattr(lm, "GATHERED", 7)
    rows = [(p, s, (p + s) % 3 == 0, p * 1000 + s, bytes([s % 251, p % 61] * (1 + s % 5))) for p in (0, 3 << 32, 5) for s in range(0, 40, 1 + p % 2)]
    joined = spark.createDataFrame(rows, "pack long, spot int, token boolean, c long, code binary").repartition(3)
    sent = lm._gathered(joined).groupBy("pack").agg(F.collect_list(F.struct("n", "decisions", "units")).alias("units")).collect()
    assert len(sent) == 3
    for r in sent:
        keys = np.arange(40, dtype=np.int64) * 1_000_003 - 7_000_000
        known = lm._spread([x.asDict() for x in r["units"]], keys)
        own = {int(keys[s]): (token, c, code) for p, s, token, c, code in rows if p == r["pack"]}
        got = {int(k): (bool(t), int(c), known.raw[b : b + n].tobytes()) for k, t, c, b, n in zip(known.key, known.token, known.count, known.begin, known.length, strict=True)}
        assert got == own
    assert not len(lm._spread([], np.zeros(0, np.int64)).key)
