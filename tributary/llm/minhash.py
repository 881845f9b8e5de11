"""Near-duplicate detection with MinHash signatures and a multi-index Hamming join.

Each text becomes its set of distinct word shingles, and each set a signature of ``SLOTS`` minimum
hashes cut to ``BITS`` bits. The signature is split into ``CHUNKS`` chunks. By the pigeonhole
principle, two signatures that differ in at most ``CHUNKS * (ERRORS + 1) - 1`` slots differ in at
most ``ERRORS`` slots of some chunk; so for each chunk every choice of ``ERRORS`` slots is left out
in turn and the others are hashed into an index key. All pairs under that distance share a key.
Texts that share a key with another get a sketch. That of a small set has a bit for each bucket of
shingles, set if the bucket holds an odd number of them: two sets differ in as many shingles at least
as their sketches in bits, so that a pair beyond the allowed number has no link for certain. Large
sets, whose buckets fill up, have a long signature of one-bit minimum hashes instead, and pairs that
differ in more than ``LONG_DISTANCE`` of its bits are left out. The others are confirmed on the full sets.

Pairs within a key are not all emitted. Each text is first compared with the few anchors of its keys
that it shares most keys with, links are confirmed on the full sets, and components are contracted.
In large keys that are still open, texts are compared once more, with those that share most keys with
others: the middle of a group of near copies, to which most of it is linked, if to anything. Then, in
the keys whose members still lie in several components, all pairs across components are compared. A
link between two texts is thus never left out unless both are in one component already.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tributary.llm.components import connected_components
from tributary.llm.hashing import mixed, shingle_sets, text_runs, word_hashes
from tributary.llm.scratch import dropped, written

SLOTS, BITS, CHUNKS, ERRORS = 42, 20, 10, 1
#: Slots are packed into longs, with a guard bit above each.
PER_LONG, LANE = 3, BITS + 1
LONGS = [f"s{i}" for i in range(SLOTS // PER_LONG)]
#: Signatures that differ in at most so many slots share an index key.
DISTANCE = CHUNKS * (ERRORS + 1) - 1
#: Bits of the long signature, and how many may differ: at a similarity of 0.8 a tenth of them are
#: expected to, and 4.75 standard deviations are allowed above that.
LONG_BITS = 2048
LONGER = [f"t{i}" for i in range(LONG_BITS // 64)]
LONG_DISTANCE = int(LONG_BITS * 0.1 + 4.75 * (LONG_BITS * 0.1 * 0.9) ** 0.5)
#: Bits of a small set's sketch, and the sizes that two sets may have together to be told by it: beyond, the long signature tells more.
ODD_BITS, ODD_SIZES = 2048, 4096
ODD = [f"o{i}" for i in range(ODD_BITS // 64)]
#: Anchors of a key, and the number of anchors that a text is compared with before the exhaustive rest.
ANCHORS = 3
#: Keys with more members outside their largest component than so many are open for a round with so many of their middle texts.
OPEN, MIDDLE = 16, 8
_LOW = sum(((1 << BITS) - 1) << (LANE * j) for j in range(PER_LONG))
_GUARD = sum(1 << (BITS + LANE * j) for j in range(PER_LONG))

_SEEDS = mixed(np.arange(1, SLOTS + LONG_BITS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_ODD = mixed(_SEEDS) | np.uint64(1)


def _signed(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in text_runs(batch.column(1)):
            shingles, at = shingle_sets(*word_hashes(data, offsets), words)
            n = np.diff(at)
            some = np.flatnonzero(n)
            longs = np.zeros((len(LONGS), j - i), np.int64)
            marks = np.zeros((2, j - i), np.uint64)
            if len(some):
                begin = at[:-1][some]
                marks[0, some] = np.add.reduceat(shingles, begin)
                marks[1, some] = np.add.reduceat(mixed(shingles), begin)
                for k in range(SLOTS):
                    least = np.minimum.reduceat((shingles ^ _SEEDS[k]) * _ODD[k], begin)
                    value = (mixed(least) >> np.uint64(64 - BITS)).astype(np.int64)
                    longs[k // PER_LONG, some] |= value << (LANE * (k % PER_LONG))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[i:j], pa.array(n), *(pa.array(m.view(np.int64)) for m in marks), *(pa.array(x) for x in longs)],
                names=["id", "n", "f1", "f2", *LONGS],
            )


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """One row per document: id, n (set size), f1 and f2 (fingerprint of the set), the packed signature."""
    schema = ", ".join([f"id {docs.schema[id_col].dataType.simpleString()}", "n long", "f1 long", "f2 long", *(f"{c} long" for c in LONGS)])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lambda it: _signed(it, words), schema)


def _long_signature(shingles: np.ndarray) -> np.ndarray:
    """One bit of the least hash of each of ``LONG_BITS`` permutations, packed into longs."""
    bits = np.empty(LONG_BITS, bool)
    step = max(1, min(64, (1 << 20) // len(shingles)))
    for s in range(0, LONG_BITS, step):
        rows = slice(SLOTS + s, SLOTS + min(s + step, LONG_BITS))
        least = ((shingles[None, :] ^ _SEEDS[rows, None]) * _ODD[rows, None]).min(1)
        bits[s : s + step] = (mixed(least) >> np.uint64(63)).astype(bool)
    return np.packbits(bits).view(np.int64)


def _odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """For each bucket of shingles whether it holds an odd number of them, packed into longs."""
    bucket = (shingles >> np.uint64(64 - (ODD_BITS - 1).bit_length())).astype(np.int64)
    return np.packbits((np.bincount(bucket, minlength=ODD_BITS) & 1).astype(bool)).view(np.int64)


def _sets(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """The id, the full set of shingles, its size, and the sketch and the long signature (null where no link needs them) of every text that has a shingle."""
    # a link is between sets of which the smaller has percent of the larger's size
    small, large = ODD_SIZES * 100 // (100 + percent), ODD_SIZES * percent // (100 + percent)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_runs(batch.column(1)):
                shingles, at = shingle_sets(*word_hashes(data, offsets), words)
                some = np.flatnonzero(np.diff(at))
                n = np.diff(at)[some]
                columns = []
                for sketched, made, names in ((n <= small, _odd_sketch, ODD), (n >= large, _long_signature, LONGER)):
                    longs = np.zeros((len(some), len(names)), np.int64)
                    for k in np.flatnonzero(sketched):
                        longs[k] = made(shingles[at[some[k]] : at[some[k] + 1]])
                    columns += [pa.array(longs[:, k], mask=~sketched) for k in range(len(names))]
                sets = pa.ListArray.from_arrays(pa.array(np.append(at[some], at[-1]).astype(np.int32)), pa.array(shingles.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j].take(pa.array(some)), sets, pa.array(n), *columns], names=["id", "shingles", "n", *ODD, *LONGER])

    schema = ", ".join([f"id {docs.schema[id_col].dataType.simpleString()}, shingles array<long>, n long", *(f"{c} long" for c in (*ODD, *LONGER))])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(build, schema)


def _slot(k: int) -> Column:
    return F.shiftright(F.col(LONGS[k // PER_LONG]), LANE * (k % PER_LONG)).bitwiseAND(F.lit((1 << BITS) - 1))


def _index() -> list[tuple[int, ...]]:
    """The slots that each index key holds."""
    keys = []
    for chunk in np.array_split(np.arange(SLOTS), CHUNKS):
        for out in combinations(chunk.tolist(), ERRORS):
            keys.append(tuple(s for s in chunk.tolist() if s not in out))
    return keys


def _differing(a: str, b: str) -> list[Column]:
    """For each long, a guard bit for each slot in which two signatures differ."""
    return [(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}")) + F.lit(_LOW)).bitwiseAND(F.lit(_GUARD)) for c in LONGS]


def _distance(a: str, b: str, names: list[str]) -> Column:
    """The number of bits in which two texts' sketches differ."""
    return reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in names))


def _near(a: str, b: str) -> Column:
    """Whether two texts that share an index key are close enough for a link, by the long signature alone."""
    return _distance(a, b, LONGER) <= LONG_DISTANCE


def _close(a: str, b: str, percent: int) -> Column:
    """Whether two texts that share an index key are close enough for a link, by their sizes and by the sketch that fits these."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    # 100 * intersection >= percent * union: at most this many shingles are in one set only
    odd = _distance(a, b, ODD) * (100 + percent) <= (n + m) * (100 - percent)
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & F.when(n + m <= ODD_SIZES, odd).otherwise(_near(a, b))


def _first_key(a: str, b: str) -> Column:
    """The number of the first index key that two signatures share."""
    bits = reduce(
        lambda x, y: x.bitwiseOR(y),
        (F.shiftleft(F.shiftright(x, BITS + LANE * j).bitwiseAND(F.lit(1)), PER_LONG * i + j) for i, x in enumerate(_differing(a, b)) for j in range(PER_LONG)),
    )

    def first(mask: Column) -> Column:
        out = None
        for k, held in enumerate(_index()):
            hit = mask.bitwiseAND(F.lit(sum(1 << s for s in held))) == 0
            out = F.when(hit, k) if out is None else out.when(hit, k)
        return out

    return F.element_at(F.transform(F.array(bits), first), 1)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    joined = pairs.select("a", "b").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    joined = joined.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    shared = joined.select("a", "b", (F.size("x") + F.size("y")).alias("n"), F.size(F.array_intersect("x", "y")).alias("i"))
    return shared.filter(F.expr(f"100L * i >= {percent}L * (n - i)")).select("a", "b")


def _compared(pairs: DataFrame, sketch: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links among different pairs (a, b)."""
    sig = F.struct(*[c for c in sketch.columns if c != "id"])
    p, q = sketch.select(F.col("id").alias("a"), sig.alias("p")), sketch.select(F.col("id").alias("b"), sig.alias("q"))
    close = written(pairs.join(q, "b").join(p, "a").filter(_close("p", "q", percent)).select("a", "b"), "pairs")
    links = written(_linked(close, sets, percent), "links")
    dropped(close)
    return links


def _contracted(classes: DataFrame, links: DataFrame) -> DataFrame:
    """The classes (id, component) with more links (a, b); texts that aren't in them are classes of their own."""
    for side in ("a", "b"):
        links = links.join(classes.select(F.col("id").alias(side), F.col("component").alias("c")), side, "left").withColumn(f"c_{side}", F.coalesce("c", side)).drop("c")
    merged = written(connected_components(links, "c_a", "c_b"), "classes").select(F.col("id").alias("component"), F.col("component").alias("top"))
    lone = merged.select(F.col("component").alias("id"), F.col("component")).join(classes, "id", "left_anti")
    return classes.unionByName(lone).join(merged, "component", "left").select("id", F.coalesce("top", "component").alias("component"))


def _placed(members: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members of keys with their components c, and of each key that has several: the largest (main) and how many members are outside it."""
    at = written(members.join(classes, "id", "left").select("id", "k", "key", F.coalesce("component", "id").alias("c")), "placed")
    sizes = at.groupBy("key", "c").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.groupBy("key").agg(F.max_by("c", F.struct("size", "c")).alias("main"), F.count(F.lit(1)).alias("classes"), (F.sum("size") - F.max("size")).alias("outside"))
    return at, written(largest.filter("classes > 1").drop("classes"), "largest")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Classes of near duplicates: one row per input row with id, n_shingles and component_id.

    Texts are linked when their sets of ``words``-word shingles (A-Z lower-cased, words split at ASCII
    white space) have 100 * intersection >= ``percent`` * union; component_id is the smallest id
    reachable over links. Null and empty texts have no shingles and are classes of their own; a
    text shorter than a shingle is one shingle. A repeated row is an exact copy; rows of one id with
    different texts count as one document, linked with whatever any of them is. A very long text is
    read whole, and other columns aren't read. Rows with a null id can't be named: they come back with a null component. An empty table gives an empty one.
    """
    signed = written(signatures(docs, id_col, text_col, words), "signatures")
    # Written first: a join of written tables is one whose hot keys the adaptive planner can split.
    copies = signed.filter("n > 0 and id is not null").groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").drop("copies")
    copies = written(copies, "copies")
    nodes = written(signed.join(copies, ["f1", "f2", "n"], "left").select("id", "n", F.coalesce("rep", "id").alias("rep"), *LONGS), "nodes")
    dropped(signed)
    only = nodes.filter("n > 0 and id = rep").select("id", *LONGS)

    keys = F.array(*[F.xxhash64(F.lit(k), *[_slot(s) for s in held]) for k, held in enumerate(_index())])
    posted = only.select("id", F.posexplode(keys).alias("k", "key"))
    orders = [F.col("id"), *[F.xxhash64(F.lit(turn), "id") for turn in range(1, ANCHORS)]]
    anchors = posted.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), *[F.min(F.struct(o.alias("o"), F.col("id").alias("t"))).alias(f"a{i}") for i, o in enumerate(orders)])
    anchors = written(anchors.filter("low < high").select("key", F.array_distinct(F.array(*[f"a{i}.t" for i in range(ANCHORS)])).alias("anchors")), "anchors")
    members = written(posted.join(anchors.select("key"), "key", "left_semi"), "members")
    involved = members.select("id").distinct()
    whole = written(_sets(docs.join(involved.withColumnRenamed("id", id_col), id_col, "left_semi"), id_col, text_col, words, percent), "sets")
    sets = whole.select("id", "shingles")
    sketch = written(only.join(whole.drop("shingles"), "id"), "sketches")

    # Each text against the anchors that it shares the most keys with.
    def nearest(met: DataFrame, most: int) -> DataFrame:
        counted = met.filter("id <> t").groupBy("id", "t").agg(F.count(F.lit(1)).alias("keys"))
        rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("keys"), "t"))
        return counted.withColumn("rank", rank).filter(F.col("rank") <= most).select(F.least("id", "t").alias("a"), F.greatest("id", "t").alias("b")).distinct()

    links = _compared(nearest(members.join(anchors, "key").select("id", F.explode("anchors").alias("t")), ANCHORS), sketch, sets, percent)
    classes = written(connected_components(links, "a", "b"), "classes")
    at, largest = _placed(members, classes)

    # In large keys that are open, all that aren't in their component against the texts that are in
    # most keys, the first of each of ``MIDDLE`` draws.
    wide = largest.filter(F.col("outside") > OPEN).select("key")
    if not wide.isEmpty():
        held = at.groupBy("id").agg(F.count(F.lit(1)).alias("held"))
        open_at = at.join(wide, "key").join(held, "id")
        first = F.struct((-F.col("held")).alias("o"), "id", "c")
        draw = F.pmod(F.xxhash64(F.lit("middle"), "id"), F.lit(MIDDLE))
        middle = open_at.groupBy("key").agg(*[F.min(F.when(draw == i, first)).alias(f"m{i}") for i in range(MIDDLE)])
        middle = written(middle.select("key", F.array_compact(F.array(*[f"m{i}" for i in range(MIDDLE)])).alias("middle")), "middle")
        met = open_at.join(middle, "key").select("id", "c", F.explode("middle").alias("m")).filter("c <> m.c").select("id", F.col("m.id").alias("t"))
        more = _compared(nearest(met, MIDDLE), sketch, sets, percent)
        if not more.isEmpty():
            classes = written(_contracted(classes, more), "classes")
            for left in (at, largest):
                dropped(left)
            at, largest = _placed(members, classes)

    # What is left: keys whose members lie in several components. All pairs across components,
    # each at the first key that it shares, so that no pair is made twice.
    sig = F.struct(*[c for c in sketch.columns if c != "id"])
    open_keys = at.join(largest.drop("outside"), "key").join(sketch.select("id", sig.alias("sig")), "id")
    x = open_keys.filter("c <> main").select("key", "k", F.col("id").alias("x"), F.col("c").alias("cx"), F.col("sig").alias("p"))
    y = open_keys.select("key", F.col("id").alias("y"), F.col("c").alias("cy"), "main", F.col("sig").alias("q"))
    across = x.join(y, "key").filter((F.col("cx") != F.col("cy")) & ((F.col("cy") == F.col("main")) | (F.col("x") < F.col("y"))) & _close("p", "q", percent) & (_first_key("p", "q") == F.col("k")))
    across = written(across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "across")
    if not across.isEmpty():
        more = written(_linked(across, sets, percent), "links")
        if not more.isEmpty():
            classes = _contracted(classes, more)
    for left in (whole, sketch, members, anchors, at, largest, across):
        dropped(left)
    found = classes.select(F.col("id").alias("rep"), "component")
    return nodes.select("id", "n", "rep").join(found, "rep", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "id").alias("component_id"))
