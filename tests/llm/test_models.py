"""Classifiers and the language model: held-out accuracy, exact base scores, odd inputs."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.llm import language, lm, mixing, quality, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")


def test_quality_on_held_out_labels(spark):
    got = queries.op8_quality_classifier(spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.95 and got.score.between(0, 1).all()


def test_quality_without_labels_or_text(spark):
    train = spark.createDataFrame([], "doc_id long, text string, quality int")
    odd = spark.createDataFrame([(1, None), (2, ""), (2, "x"), (None, "y" * 100)], "doc_id long, text string").withColumn("score", F.lit("old"))
    assert [r.score for r in quality.score(odd, quality.fit(train)).collect()] == [0.5] * 4
    one = spark.createDataFrame([(1, "a b c", 1), (2, "d e", 1)], "doc_id long, text string, quality int")
    assert all(r.predicted == 1 for r in quality.score(odd, quality.fit(one)).collect())


def test_dual_coordinate_descent_separates():
    rows = [np.array([0]), np.array([1]), np.array([0, 2]), np.array([1, 2])]
    signs = np.array([1.0, -1.0, 1.0, -1.0])
    w = quality.dual_coordinate_descent(rows, [np.ones(len(r)) for r in rows], signs, 3)
    assert all(s * w[r].sum() > 0 for r, s in zip(rows, signs, strict=True))


def test_language_on_held_out_documents(spark, docs):
    got = queries.op9_language_id(spark, SF).toPandas().set_index("doc_id")
    held = got[got.held_out]
    assert (held.lang_pred == docs.lang[held.index]).mean() > 0.97


def test_language_of_odd_texts(spark):
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "é"), (4, "é")], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    assert [r.lang_pred for r in language.predict(odd, language.ByteNet(["xx"])).orderBy("doc_id").collect()] == ["und", "und", "und", "xx", "xx"]
    empty = language.fit(odd)
    assert empty.classes == [] and all(r.lang_pred == "und" for r in language.predict(odd, empty).collect())


def test_language_gradients_are_right():
    net = language.ByteNet(["a", "b"], 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = np.random.default_rng(0).integers(0, 256, (3, language.WINDOW)), np.array([0, 1, 1])
    loss = lambda: -np.log(net._forward(x)[3][np.arange(3), y]).mean()
    g = net.gradients(x, y)
    for k in net.p:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        keep, eps = net.p[k][at], 1e-5
        net.p[k][at] = keep + eps
        up = loss()
        net.p[k][at] = keep - eps
        down = loss()
        net.p[k][at] = keep
        assert abs((up - down) / (2 * eps) - g[k][at]) < 1e-4


def test_base_scores_are_exact(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 500)  # so that both ways of counting are used
    got = queries.op10_lm_scoring(spark, SF).toPandas().set_index("doc_id")
    import zlib
    from collections import Counter

    words = {i: [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] for i, t in docs.text.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in words}
    count = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    ends = sum(not h for h in held.values())
    n, v = sum(count.values()) + ends, len(count) + 1
    for i, ws in words.items():
        r = got.loc[i]
        want = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws) + math.log10((ends + 0.1) / (n + 0.1 * (v + 1)))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws) + 1, sum(count[w] > 0 for w in ws) + 1, n)
        assert abs(r.base_score - want) < 1e-6 * max(1, abs(want))
    assert got.bits_per_byte[got.held_out].median() < 2.8


def test_mixing_meets_its_targets(spark):
    got = queries.op4_source_mixing(spark, SF).toPandas()
    assert len(got) == 1000 and (got.rate >= 0).all()
    total = got.n_tokens.sum()
    for domain, share in queries.TARGETS.items():
        assert abs((got.rate * got.n_tokens * got[f"p_{domain}"]).sum() / total - share) < 1e-4
    assert abs(got[[f"p_{d}" for d in queries.TARGETS]].sum(axis=1) - 1).max() < 1e-9


def test_mixing_of_odd_tables(spark):
    rows = spark.createDataFrame([(1, None, 1), (2, "", 2), (None, "a b", 3), (2, "", 2)], "doc_id long, text string, rate int")
    none = mixing.learn(rows.withColumn("domain", F.lit(None).cast("string")))
    assert [r.rate for r in mixing.mixed(rows, none, {"a": 1.0}, keep=("rate", "text")).collect()] == [1.0] * 4
    one = mixing.learn(rows.withColumn("domain", F.lit("a")))
    assert all(abs(r.rate - 1) < 1e-6 for r in mixing.mixed(rows, one, {"a": 2.0, "b": 5.0}).collect())
    assert mixing.mixed(rows.limit(0), one, {"a": 1.0}).count() == 0
