"""Near-dedup in groups of near copies that aren't all linked."""

import random

import numpy as np
import pytest
from test_pairs import classes, corpus

from tributary.llm import minhash


def group(copies, own, seed=5):
    """Copies of one text of 150 words, each with some words of its own behind."""
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    return [(i, " ".join([*base, *(f"own{i}x{j}" for j in range(own(i)))])) for i in range(copies)]


def counted(monkeypatch):
    """The numbers of rows of the tables that are written from now on, by name."""
    rows, real = {}, minhash.written

    def written(df, name):
        out = real(df, name)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(minhash, "written", written)
    return rows


def test_pairs_below_the_threshold_do_not_become_rows(spark, monkeypatch):
    """At 0.77 none is linked: the long signature alone lets nearly all pairs of the group pass."""
    rows, made = group(60, lambda i: 22), counted(monkeypatch)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=5).collect()
    assert all(r.component_id == r.doc_id for r in got) and len(got) == 60
    assert sum(made["pairs"] + made["across"]) <= 60


def test_a_group_is_gathered_around_its_middle(spark, monkeypatch):
    """A middle text is linked to those with 24 words of their own, none of which is linked to another."""
    rows, made = group(80, lambda i: 0 if i == 50 else 24 if i % 4 else 40), counted(monkeypatch)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=5).collect()}
    assert got == classes(rows, 5)
    assert sum(made["across"]) <= 80


@pytest.mark.parametrize("sizes", [10, 40, 4096])
def test_small_and_large_sets_equal_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(minhash, "ODD_SIZES", sizes)
    monkeypatch.setattr(minhash, "OPEN", 0)
    rows = corpus(11)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()}
    assert got == classes(rows, 4)


def test_sketches_differ_in_no_more_bits_than_sets_in_shingles():
    r = np.random.default_rng(3)
    for n, d in ((1, 0), (5, 3), (146, 32), (2000, 250), (2200, 2200)):
        both = r.integers(0, 1 << 63, n + d, dtype=np.uint64) * np.uint64(2)
        a, b = (minhash._odd_sketch(x).view(np.uint64) for x in (both[:n], both[d:]))
        differ = sum(int(x).bit_count() for x in a ^ b)
        assert differ <= len(np.setxor1d(both[:n], both[d:]))
        if n == 146:
            assert differ >= 2 * d - 8
