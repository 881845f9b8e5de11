"""Bounded draws at any size, the folder of intermediate tables, ties, and folds over long arrays."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.llm import language, mixing, native, quality, scratch
from tributary.llm.labels import labelled


def test_draws_hold_at_any_size():
    for n in (1, 10**6, 2 * 10**9, 10**11, 10**15):
        assert 0 < language.share_of(250, n) <= 1 and abs(language.share_of(250, n) * n - min(n, 250)) < 1e-6 * n


def test_labels_are_drawn_by_hash_up_to_the_bound(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    labels = spark.range(800).select((F.col("id") % 400).alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    ids = sorted(r.doc_id for r in labelled(docs, labels, ["quality"], sample=50).collect())
    assert len(ids) == 50 == len(set(ids)) and ids == sorted(r.doc_id for r in labelled(docs.repartition(3), labels.repartition(7), ["quality"], sample=50).collect())
    assert labelled(docs, labels.limit(0), ["quality"]).count() == 0 and labelled(docs, labels, ["quality"]).count() == 400


def test_drawn_rows_are_those_with_the_least_hashes(spark):
    texts = [(i % 7, f"text number {i % 23} " * (i % 5), i % 7 % 2) for i in range(300)]
    rows = spark.createDataFrame(texts, "doc_id long, text string, label int").withColumn("draw", F.xxhash64("doc_id", "text"))
    plain = sorted((r.label, bytes(r.features)) for r in quality._feature_rows(rows.select("text", "label", "draw")).collect())
    for n in (1, 40, 150, 300, 500):
        least = quality._feature_rows(rows.select("text", "label", "draw")).orderBy("draw", "label").limit(n).collect()
        got = quality._drawn(rows.repartition(5), n)
        assert got == sorted((r.label, bytes(r.features)) for r in least) and len(got) == min(n, 300)
    assert got == plain and quality._drawn(rows.limit(0), 10) == []


def fake(master, folder=None):
    context = SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda k: folder), getCheckpointDir=lambda: made[-1] if made else None, setCheckpointDir=lambda d: made.append(d))
    made = []
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d=None: d))


def test_folder_is_shared_or_an_error():
    assert scratch.shared_folder(fake("spark://h:7077", "hdfs://x/y/")) == "hdfs://x/y"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_folder(fake("spark://h:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_folder(fake("local-cluster[2,1,1024]"))
    local = fake("local[4]")
    assert scratch.shared_folder(local).startswith("file:///tmp/") and scratch.shared_folder(local) == scratch.shared_folder(local)


def test_a_tied_score_predicts_one(spark):
    model = quality.Model(np.zeros(1 << quality.BITS), np.zeros(1 << quality.BITS), 0.0, 0.0)
    assert [(r.score, r.predicted) for r in quality.score(spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string"), model).collect()] == [(0.5, 1)] * 2
    net = language.ByteNet(["aa", "bb"])
    net.p["U"][:] = 0
    assert [r.lang_pred for r in language.predict(spark.createDataFrame([("k1", "abc")], "doc_id string, text string"), net).collect()] == ["aa"]


def test_running_folds(spark):
    rows = [list(range(n)) for n in (1, 63, 64, 65, 500)] + [[]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, a array<int>")
    got = {r.i: r.s for r in df.select("i", native.running(F.col("a"), lambda s, x: s + x, F.lit(0)).alias("s")).collect()}
    for i, r in enumerate(rows):
        assert got[i] == [0, *np.cumsum(r).tolist()]


def test_mixing_rates_equal_projected_steps_in_numpy(spark):
    """The rates of few documents against the same problem solved densely."""
    r = np.random.default_rng(4)
    texts = [" ".join(r.choice(["red", "blue", "green", "gold"], n)) for n in r.integers(3, 40, 60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    seed = spark.createDataFrame([("red red blue", "a"), ("green gold", "b"), ("gold red", "b"), ("blue blue", "a")], "text string, domain string")
    got = mixing.mixed(docs, mixing.learn(seed), {"a": 0.7, "b": 0.3}).toPandas()
    p, n = got[["p_a", "p_b"]].to_numpy(), got.n_tokens.to_numpy()
    rate, total = np.ones(len(n)), n.sum()
    for _ in range(200):
        miss = (rate * n) @ p / total - np.array([0.7, 0.3])
        on = rate > 0
        rate = np.maximum(0, rate - p @ (np.linalg.pinv((p[on] * n[on, None]).T @ p[on] / total, rcond=1e-10) @ miss))
    assert np.abs(rate - got.rate).max() < 1e-5 and np.abs((got.rate * n) @ p / total - [0.7, 0.3]).max() < 1e-6
