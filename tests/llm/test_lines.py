"""Line dedup against plain counting, and the perfect hash against a dictionary."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.llm import lines

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def key(line, min_chars):
    k = line.encode().strip(b" \t\n\x0b\x0c\r").translate(LOWER)
    return k if len(k.decode()) >= min_chars else None


def plain(texts, min_docs, min_chars):
    split = [(t or "").split("\n") for t in texts]
    times = {}
    for s in split:
        for k in {key(x, min_chars) for x in s} - {None}:
            times[k] = times.get(k, 0) + 1
    common = {k for k, n in times.items() if n >= min_docs}
    left = [[x for x in s if key(x, min_chars) not in common] for s in split]
    return sorted((len(s), len(s) - len(x), "\n".join(x)) for s, x in zip(split, left, strict=True))


def corpus(seed, n=300):
    r = random.Random(seed)
    said = [" ".join(r.choice(["Éa", "b", "C", "日本"]) for _ in range(r.randint(0, 6))) for _ in range(60)]
    some = [None, "", "\n", " \n\t\n", "\n".join(said[:5] * 3), "x" * 200_000, "A LINE\r\n a line \x0b"] * 2
    return some + ["\n".join(r.choice(("", " ", "\t")) + r.choice((str.upper, str))(r.choice(said)) for _ in range(r.randint(1, 9))) for _ in range(n)]


@pytest.mark.parametrize("min_docs,min_chars,sent", [(10, 1, lines.SENT_BYTES), (3, 4, lines.SENT_BYTES), (2, 1, 0), (10, 3, 0)])
def test_equals_plain_counting(spark, monkeypatch, min_docs, min_chars, sent):
    monkeypatch.setattr(lines, "SHARD_KEYS", 16)
    monkeypatch.setattr(lines, "TASK_PROBES", 50)
    texts = corpus(min_docs)
    df = spark.createDataFrame([(i % 40 or None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    df = df.withColumns({c: F.lit(1) for c in ("n_lines", "id", "_row", "hits", "shard", "_text", "hi")})
    out = lines.drop_common_lines(df, min_docs=min_docs, min_chars=min_chars, sent_bytes=sent)
    assert out.columns == ["doc_id", "n_lines", "n_dropped", "text"]
    assert sorted((r.n_lines, r.n_dropped, r.text) for r in out.collect()) == plain(texts, min_docs, min_chars)


def test_no_documents_and_no_common_lines(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    for sent in (0, -1, lines.SENT_BYTES):
        assert lines.drop_common_lines(empty, sent_bytes=sent).collect() == []
        assert [tuple(r) for r in lines.drop_common_lines(spark.createDataFrame([(1, "a\nb")], "doc_id long, text string"), sent_bytes=sent).collect()] == [(1, 2, 0, "a\nb")]


def test_hash_is_perfect_and_minimal():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 5000):
        hi, lo = r.integers(-(2**63), 2**63, (2, n))
        counts = r.integers(1, 300 if n < 5000 else 10**10, n)
        shards = 1 + n // 700
        rows = []
        for s in range(shards):
            mine = hi % shards == s
            if mine.any():
                rows.append({"shard": s} | lines.shard_arrays(hi[mine], lo[mine], counts[mine]))
        index = lines.Index(rows, shards)
        assert len(index.prints) == n == len(index.counts) and int(np.bitwise_count(index.bits).sum()) == n
        assert (index.lookup(hi, lo) == counts).all()
        assert not index.lookup(lo, hi).any() and not index.lookup(hi, lo ^ 1).any()
        assert len(index.bits) * 64 <= 6 * n + 64 * 12 * shards
    assert {row["width"] for row in rows} == {8} and lines.shard_arrays(hi[:9], lo[:9], counts[:9] % 200)["width"] == 1
