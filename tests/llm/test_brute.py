"""Classifiers against brute force: counts, posteriors, dual optimum and forward pass by plain loops; and the robustness of operators."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.llm import language, mixing, pii, quality, rules

PROSE = ["the quick brown fox", "a lazy dog, a lazy dog!", "le renard brun", "the dog", "chien et renard 42", "Brown BROWN fox"]


def test_posteriors_equal_counts_by_hand(spark):
    """Naive Bayes over token buckets: counts, priors, scaled evidence and softmax from the words themselves."""
    seed = [(PROSE[k % 6] + f" w{k % 4}", "abc"[k % 3]) for k in range(30)] + [("x", None), (None, "a"), ("", "b")]
    model = mixing.learn(spark.createDataFrame(seed, "text string, domain string"))
    docs = [(k, t) for k, t in enumerate([*PROSE, None, "", "unknown words only", "fox " * 5000 + "dog"])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: [r.p_a, r.p_b, r.p_c] for r in mixing.mixed(df, model, {"a": 1.0, "b": 1.0, "c": 1.0}).collect()}
    buckets = {r.t: r.b for r in spark.createDataFrame([(t or "",) for t in {x for x, _ in seed} | {x for _, x in docs}], "t string").select("t", mixing.indicators(F.col("t")).alias("b")).collect()}
    size, held = Counter(d for _, d in seed if d), {d: Counter() for d in "abc"}
    for t, d in seed:
        if d:
            held[d].update(set(buckets[t or ""]))
    for k, t in docs:
        found = set(buckets[t or ""])
        scale = min(1.0, mixing.EVIDENCE / max(len(found), 1))
        logs = []
        for d in "abc":
            whole = sum(held[d].values()) + 0.5 * mixing.BUCKETS
            logs.append(math.log((size[d] + 1) / (sum(size.values()) + 3)) + scale * sum(math.log((held[d][b] + 0.5) / whole) for b in found))
        top = max(logs)
        want = [math.exp(x - top) for x in logs]
        assert got[k] == pytest.approx([x / sum(want) for x in want], rel=1e-5), t


def test_copies_of_one_id_are_rounded_apart(spark):
    """Rows under one id or none are rounded on their own, so that copies add up to the rates; what is missed comes along."""
    r = np.random.default_rng(0)
    texts = [" ".join(r.choice(["red", "green"], 12, p=[k / 600, 1 - k / 600])) + f" {k}" for k in range(600)]
    df = spark.createDataFrame([(None if k % 2 else 7, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, missed string")
    seed = spark.createDataFrame([("red red", "a"), ("green", "b")] * 20, "text string, domain string")
    out = mixing.mixed(df, mixing.learn(seed), {"a": 0.55, "b": 0.45}, keep=("missed",)).toPandas()
    assert abs(out.copies.sum() - out.rate.sum()) < 0.05 * len(out) and out.copies.nunique() > 1
    assert (out.missed < 1e-6).all() and out.doc_id.isna().sum() == 300
    empty = mixing.mixed(df.limit(0), mixing.learn(seed), {"a": 1.0})
    assert empty.collect() == [] and "missed" in empty.columns


def indicators(text):
    data = np.frombuffer((text or "").encode(), np.uint8)
    return quality.features(data, np.array([0, len(data)]))[0]


def test_indicators_of_a_row_do_not_depend_on_the_rows_beside_it():
    texts = ["the dog", "dog the", "", "the the", "the", "é", "the dog"]
    data = [t.encode() for t in texts]
    together = quality.features(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    assert all(np.array_equal(f, indicators(t)) for f, t in zip(together, texts, strict=True))


def test_hinge_model_equals_a_dense_solution(spark):
    """Counts, ratios, the dual optimum by projected gradients on the dense matrix, and the score of each document, worked out apart."""
    rng = np.random.default_rng(1)
    good, bad = ["fine", "clear", "prose", "well", "said"], ["spam", "buy", "now", "click", "here"]
    rows = [(k, " ".join(rng.choice(good if y else bad, 3)) + " " + " ".join(rng.choice(good + bad, 4)), int(y)) for k, y in enumerate(rng.integers(0, 2, 50))]
    model = quality.fit(spark.createDataFrame([*rows, (90, "odd", 2), (91, "null label", None)], "doc_id long, text string, quality int"))
    size = 1 << quality.BITS
    found, y = [indicators(t) for _, t, _ in rows], np.array([1.0 if q else -1.0 for _, _, q in rows])
    counts = np.ones((2, size))
    for f, q in zip(found, y, strict=True):
        counts[int(q > 0), f] += 1
    ratio = np.log((counts[1] / counts[1].sum()) / (counts[0] / counts[0].sum()))
    x = np.zeros((len(rows), size))
    for k, f in enumerate(found):
        x[k, f] = ratio[f] / np.linalg.norm(ratio[f])
    gram, alpha = (x @ x.T) * np.outer(y, y), np.zeros(len(rows))
    step = 1 / np.linalg.norm(gram, 2)
    for _ in range(60_000):
        alpha = np.clip(alpha - step * (gram @ alpha - 1), 0, quality.COST)
    weights = x.T @ (alpha * y)
    own = quality.dual_coordinate_descent(found, [x[k, f] for k, f in enumerate(found)], y, size, epochs=2000)
    loss = lambda w: 0.5 * w @ w + quality.COST * np.maximum(0, 1 - y * (x @ w)).sum()
    assert loss(own) <= loss(weights) * 1.001 and np.abs(own - weights).max() < 1e-2
    assert np.allclose(model.square, ratio * ratio)
    # the model stops after some passes: its weights, before they are drawn towards their mean, lose little against the optimum
    fitted = np.divide(model.scaled, ratio, out=np.zeros(size), where=ratio != 0)
    few = quality.dual_coordinate_descent(found, [x[k, f] for k, f in enumerate(found)], y, size)
    assert loss(few) <= loss(weights) * 1.05
    held = [*[(k, t) for k, t, _ in rows], (100, None), (101, ""), (102, "spam " * 30_000)]
    got = {r.doc_id: r for r in quality.score(spark.createDataFrame(held, "doc_id long, text string"), model).collect()}
    for k, t in held:
        f = indicators(t)
        norm = np.linalg.norm(ratio[f])
        margin = float(sum(ratio[i] * fitted[i] for i in f) / norm) if len(f) and norm > 0 else 0.0
        assert got[k].score == pytest.approx(1 / (1 + math.exp(-(model.slope * margin + model.at))), abs=1e-9) and got[k].predicted == int(got[k].score >= 0.5)
    assert np.mean([got[k].predicted == q for k, _, q in rows]) > 0.9 and got[102].predicted == 0


def test_language_score_equals_plain_loops(spark):
    """Filters, pools and softmax by loops over the bytes of each window, and a text's score from its windows by their lengths."""
    net = language.ByteNet(["aa", "bb", "cc"], seed=5)
    p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def logs(window):
        pooled = []
        for w in language.WIDTHS:
            for f in range(language.FILTERS):
                pooled.append(max(sum(p["E"][window[i + j]] @ p[f"W{w}"][j][:, f] for j in range(w)) for i in range(language.WINDOW - w + 1)) + p[f"b{w}"][f])
        o = [sum(max(h, 0.0) * p["U"][k][c] for k, h in enumerate(pooled)) + p["c"][c] for c in range(3)]
        whole = math.log(sum(math.exp(v) for v in o))
        return np.array([v - whole for v in o])

    texts = ["short", "Ünïcode text " * 30, "a" * 256, "b c " * 64 + "!"]
    df = spark.createDataFrame([*enumerate(texts), (9, None), (10, "123 !")], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("lang_pred", "score", "id")})
    got = {r.doc_id: r for r in language.predict(df, net).collect()}
    for k, t in enumerate(texts):
        data = t.encode()
        parts = [data[i : i + language.WINDOW] for i in range(0, len(data), language.WINDOW)]
        o = sum(logs(part.ljust(language.WINDOW, b"\0")) * len(part) for part in parts) / len(data)
        q = np.exp(o) / np.exp(o).sum()
        assert got[k].lang_pred == "abc"[int(q.argmax())] * 2 and got[k].score == pytest.approx(float(q.max()), abs=1e-4)
    assert {(got[k].lang_pred, got[k].score) for k in (9, 10)} == {("und", 0.0)}


def test_terms_at_the_thresholds_and_the_joined_path(spark, monkeypatch):
    """A term that determines an entity with exactly the least probability counts; a list too long for the tasks is joined, with the same result."""
    mail = "ann@example.org"
    rows = [(k, f"codeword{k % 2} wrote to {mail} on day{k}") for k in range(8)] + [(8 + k, f"codeword0 alone {k}") for k in range(1)] + [(20 + k, f"filler text number {k} of many others") for k in range(900)]
    rows += [(None, rows[0][1]), (5, rows[1][1]), (950, None), (951, ""), (952, "word " * 40_000 + mail)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("q") for c in ("spans", "removed", "row", "terms", "gone", "t")}).repartition(4)
    told = lambda: sorted(((r.doc_id or -1), [(s.start, s.kind, s.end) for s in r.spans], sorted(r.removed_terms)) for r in pii.find_personal(df).collect())
    few = told()
    by_term = {r.term: r.probability for r in pii.revealing_terms(df).collect()}
    assert by_term["codeword0"] == pytest.approx(0.8) and by_term["codeword1"] == 1.0
    monkeypatch.setattr(pii, "LISTED", 1)
    assert told() == few and len(few) == len(rows)
    assert pii.find_personal(df.limit(0)).collect() == []


def test_very_long_texts_and_empty_tables(spark):
    long = "A line, with words. " * 60_000
    df = spark.createDataFrame([(1, long), (1, None), (None, ""), (2, "x y z")], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n_words", "score", "_t")})
    order = list(rules.RULES)
    assert {r.doc_id: r.n_words for r in rules.judged(df.filter("text <> ''"), order).collect()} == {1: 240_000, 2: 3}
    assert rules.judged(df.limit(0), order).collect() == []
    assert [r.text for r in rules.kept_documents(df).collect()] == []
    net = language.ByteNet(["aa", "bb"])
    assert [r.lang_pred for r in language.predict(df.filter("text is null"), net).collect()] == ["und"] and language.predict(df.limit(0), net).collect() == []
    model = quality.Model(np.zeros(1 << quality.BITS), np.zeros(1 << quality.BITS), 0.0, 0.0)
    assert quality.score(df.limit(0), model).collect() == [] and quality.score(df, model).count() == 4
