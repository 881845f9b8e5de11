"""Faults that spread over references, and joins with intervals, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tributary.operators import ranges as N
from tributary.operators import references as X


def pictures(seed, streams=3, n=90):
    r = random.Random(seed)
    rows = []
    for s in range(streams):
        for p in range(0, n * 2, 1 + s):
            key = r.random() < 0.06
            refs = [] if key else r.sample(range(8), r.randint(1, 3))
            rows.append((s if s else None, p, refs, list(range(8)) if key else r.sample(range(8), r.randint(0, 2)) or None, r.random() < 0.05))
    return rows


def plain(rows):
    out = {}
    for s in {r[0] for r in rows}:
        bad = set(range(8))
        for _, p, refs, fresh, lost in sorted((r for r in rows if r[0] == s), key=lambda r: r[1]):
            hit = sorted(set(refs) & bad)
            out[s, p] = (hit, lost or bool(hit))
            bad = bad | set(fresh or ()) if lost or hit else bad - set(fresh or ())
    return out


@pytest.mark.parametrize("piece", [2, 5, 256])
def test_faults_spread_as_in_order(spark, piece):
    rows = pictures(piece)
    df = spark.createDataFrame(rows, "stream int, picture long, refs array<int>, fresh array<int>, lost boolean").repartition(5)
    out = X.spread_faults(df, "stream", "picture", "refs", "fresh", F.col("lost"), piece=piece)
    assert {(r.stream, r.picture): (r.faulty_slots, r.faulty) for r in out.collect()} == plain(rows) and out.count() == len(rows)


def test_shown_again_and_no_pictures(spark):
    """A shown key picture loads all slots; one that is lost leaves what it refreshes faulty until a sound one comes."""
    rows = [(0, [], [0, 1, 2, 3, 4, 5, 6, 7], False), (1, [0], [1], True), (2, [1], [], False), (3, [0], [0, 1, 2, 3, 4, 5, 6, 7], False), (4, [1], [], False)]
    df = spark.createDataFrame([(1, *r) for r in rows], "s int, p int, refs array<int>, fresh array<int>, lost boolean")
    got = [r.faulty for r in X.spread_faults(df, "s", "p", "refs", "fresh", F.col("lost")).orderBy("p").collect()]
    assert got == [False, True, True, False, False]
    assert X.spread_faults(df.limit(0), "s", "p", "refs", "fresh", F.col("lost")).collect() == []


@pytest.mark.parametrize("how,hot,bucket", [("inner", 10**6, 7), ("left", 10, 7), ("left", 3, 100), ("inner", 1, 1)])
def test_range_join_equals_all_pairs(spark, how, hot, bucket):
    r = random.Random(hot)
    values = [(r.choice("ab"), 50 if r.random() < 0.4 else r.randint(-20, 120), i) for i in range(300)] + [("a", None, 900), (None, 5, 901), ("c", 5, 902)]
    spans = [(r.choice("ab"), a, a + r.randint(-1, 40), i) for i in range(25) for a in [r.randint(-20, 100)]] + [("a", None, 5, 99), ("a", 5, None, 98), (None, 0, 9, 97)]
    v = spark.createDataFrame(values, "k string, v long, i int")
    s = spark.createDataFrame(spans, "k string, low long, high long, j int")
    got = N.range_join(v, s, ["k"], "v", "low", "high", bucket, hot, how)
    want = [(*x, *y[1:]) for x in values for y in spans if None not in (x[0], x[1], y[1], y[2]) and x[0] == y[0] and y[1] <= x[1] < y[2]]
    if how == "left":
        held = {x[2] for x in want}
        want += [(*x, None, None, None) for x in values if x[2] not in held]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def table(knots):
    """The scaling of each of 256 places, by its definition."""
    out = [knots[0][1] if knots else 0] * 256
    for (x, y), (x2, y2) in zip(knots, knots[1:], strict=False):
        d = (y2 - y) * ((65536 + ((x2 - x) >> 1)) // (x2 - x))
        for i in range(x2 - x):
            out[x + i] = y + ((i * d + 32768) >> 16)
    for i in range(knots[-1][0], 256):
        out[i] = knots[-1][1]
    return out


@pytest.mark.parametrize("depth", [8, 10, 12])
def test_scaling_between_knots(spark, depth):
    r = random.Random(depth)
    knots = {k: [(x, r.randint(0, 255)) for x in sorted(r.sample(range(256), n))] for k, n in (("a", 1), ("b", 7), ("c", 14))}
    knots["d"] = [(0, 9), (255, 200)]
    samples = [(k, i) for k in "abcde" for i in [-4, 0, 1, *(r.randrange(1 << depth) for _ in range(80)), (1 << depth) - 2, (1 << depth) - 1, 1 << depth]]
    out = N.scaled(spark.createDataFrame(samples, "k string, v int"), spark.createDataFrame([(k, x, y) for k, p in knots.items() for x, y in p], "k string, x int, y int"), ["k"], "v", "x", "y", depth, hot=20)
    shift = depth - 8
    for row in out.collect():
        if row.k == "e":
            assert row.scaling is None
            continue
        lut, i = table(knots[row.k]), min(max(row.v, 0), (1 << depth) - 1)
        x = i >> shift
        want = lut[x] if not shift or x == 255 else lut[x] + (((lut[x + 1] - lut[x]) * (i & ((1 << shift) - 1)) + (1 << (shift - 1))) >> shift)
        assert row.scaling == want, row
    assert out.count() == len(samples)
