"""Periodic runs against a plain search of every period."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.llm import runs


def plain(words, least):
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j - i >= max(p, least - p):
                found.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def collapsed(words, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts(seed):
    r = random.Random(seed)
    out = [None, "", " \n\t", "a", "a " * 11, "a " * 12, "a\n" * 500, "a b " * 300, ("x " * 12 + "y " * 12) * 9, "A a " * 8, "é é " * 13]
    for _ in range(120):
        out.append(" ".join(r.choice("ab" if r.random() < 0.5 else "abcdefgh") for _ in range(r.randint(1, 90))))
        base = [r.choice("abcdefghijkl") for _ in range(r.randint(1, 25))]
        out.append(" ".join((base * r.randint(1, 6))[: r.randint(1, 140)]) + r.choice((" ", "\t", "  z ")) + " ".join(base))
    return out


@pytest.mark.parametrize("least", [2, 12])
def test_equals_plain_search(spark, least):
    some = texts(least)
    df = spark.createDataFrame(list(enumerate(some)) + [(None, "b " * 20), (3, some[3])], "doc_id long, text string").repartition(3)
    df = df.withColumns({c: F.lit("q") for c in ("runs", "n_words", "id", "collapsed")})
    got = {r.doc_id: r for r in runs.periodic_runs(df, least=least).collect()}
    assert len(got) == len(some) + 1 and runs.periodic_runs(df, least=least).count() == len(some) + 2
    for i, t in enumerate(some):
        words = [w.decode() for w in (t or "").encode().split()]
        want = plain(words, least)
        assert [(x.start, x.length, x.period) for x in got[i].runs] == want, (i, t)
        assert (got[i].n_words, got[i].collapsed) == (len(words), collapsed(words, want))
    assert [tuple(x) for x in got[None].runs] == [(0, 20, 1)]


def test_texts_together_and_in_blocks_are_the_same(monkeypatch):
    r = random.Random(5)
    some = [[r.choice([b"a", b"b"]) for _ in range(r.randint(0, 60))] for _ in range(200)]
    whole = runs.text_runs_of(some, 12)
    monkeypatch.setattr(runs, "TESTED", 7)
    monkeypatch.setattr(runs, "TOGETHER", 1)
    assert all(np.array_equal(a, b) for a, b in zip(whole, runs.text_runs_of(some, 12), strict=True))
    assert [[tuple(x) for x in f] for f in whole] == [plain(w, 12) for w in some]


def test_very_long_text():
    r = random.Random(3)
    words = [str(r.randint(0, 5000)).encode() for _ in range(300_000)]
    words[1000:1000 + 90_000] = (words[1000:31_000]) * 3
    words[200_000:200_040] = [b"ha"] * 40
    found = runs.text_runs_of([words], 12)[0]
    assert [90_000, 30_000] in found[:, 1:].tolist() and [200_000, 40, 1] in found.tolist()


def test_names_are_equal_for_equal_stretches_only():
    words = np.array([r % 3 for r in range(40)] + [7, 1, 2, 0, 1, 2])
    levels = runs.names_of(words)
    for k, names in enumerate(levels):
        stretches = [tuple(words[i : i + 2**k]) for i in range(len(names))]
        assert len(set(zip(names.tolist(), stretches, strict=True))) == len(set(stretches)) == len(set(names.tolist()))


def test_no_documents(spark):
    assert runs.periodic_runs(spark.createDataFrame([], "doc_id string, text string")).collect() == []
