"""Near-dedup, decontamination and connected components against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tributary.llm import components, decontaminate, minhash

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles(text, k):
    w = (text or "").encode().translate(LOWER).split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def classes(rows, k):
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b) and top(i) != top(j):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    return {i: top(i) for i in parent}


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(1, 5)))
    texts = []
    for _ in range(40):
        base = [word() for _ in range(r.randint(3, 60))]
        texts.append(" ".join(base))
        for _ in range(r.choice((0, 0, 1, 6))):
            edited = list(base)
            for _ in range(r.randint(0, 3)):
                edited[r.randrange(len(edited))] = word()
            texts.append(r.choice((" ", "\t", "\n ")).join(edited).upper() if r.random() < 0.3 else " ".join(edited))
    return list(enumerate(texts)) + [(900, ""), (901, None), (902, " \n"), (903, "one"), (904, "One"), (905, "one two"), (7, texts[7])]


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_equal_brute_force(spark, k):
    rows = corpus(k)
    df = spark.createDataFrame(rows + [(None, "null id")], "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("key", F.lit(2))
    got = minhash.near_duplicates(df, words=k, percent=80).collect()
    want = classes(rows, k)
    assert len(got) == len(rows) + 1
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert {r.doc_id: r.n_shingles for r in got if r.doc_id is not None} == {i: len(shingles(t, k)) for i, t in rows}


def test_no_documents(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_index_shares_a_key_up_to_the_distance():
    r = random.Random(1)
    for _ in range(200):
        a = [r.randrange(1 << 20) for _ in range(minhash.SLOTS)]
        b = list(a)
        for s in r.sample(range(minhash.SLOTS), minhash.DISTANCE):
            b[s] ^= 1 + r.randrange(1 << 19)
        assert any(all(a[s] == b[s] for s in held) for held in minhash._index())


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 5), (1, 2), (2, 1), (None, 3)] + [(300, 301 + i) for i in range(50)]
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1} | {i: 100 for i in range(100, 161)} | {i: 300 for i in range(300, 351)}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def occurrences(text, items, window):
    words = decontaminate.words_of(text)
    hit, found = set(), set()
    for item, t in items:
        w = decontaminate.words_of(t)
        for p in {tuple(w[i : i + window]) for i in range(max(1, len(w) - window + 1))} if w else ():
            for i in range(len(words) - len(p) + 1):
                if tuple(words[i : i + len(p)]) == p:
                    hit.update(range(i, i + len(p)))
                    found.add(str(item))
    return len(words), hit, sorted(found)


def test_search_equals_brute_force(spark, monkeypatch):
    r = random.Random(3)
    text = lambda n: " ".join(r.choice(("the", "An", "of", "x1", "é", "QUICK")) + r.choice(("", ",", ".", "-")) for _ in range(n))
    items = [(i, text(r.choice((1, 2, 4, 5, 6, 9)))) for i in range(12)] + [(12, None), (13, "!!"), (10, "an of the x1")]
    docs = [(i, text(r.randint(0, 60))) for i in range(60)] + [(60, None), (61, ""), (60, "an")]
    for i in range(10):
        docs.append((100 + i, text(5) + " " + (items[i][1] or "").upper() + "; " + text(5)))
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items + [(None, "an an an")], "item_id long, text string")
    for limit in (100_000, 7):  # in one block and in many
        monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", limit)
        got = sorted((r.doc_id, r.n_words, tuple(x for s in r.spans for x in range(s.start, s.end)), tuple(r["items"])) for r in decontaminate.find_benchmark(a, b, window=5).collect())
        want = sorted((i, n, tuple(sorted(hit)), tuple(found)) for i, t in docs for n, hit, found in [occurrences(t, items, 5)])
        assert got == want


def test_clean_documents_keep_their_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e", 5), (2, "z z z", 6), (None, "q", 7)], "doc_id long, text string, _leaked int")
    items = spark.createDataFrame([(1, "b c d")], "item_id long, text string")
    out = decontaminate.clean_documents(docs, items, window=3)
    assert out.columns == docs.columns and sorted(r.text for r in out.collect()) == ["q", "z z z"]
    assert decontaminate.clean_documents(docs, items.limit(0)).count() == 3


def test_pairs_with_a_key_are_left_to_the_long_signature(spark):
    """Texts that share a key aren't dropped for the number of slots that differ."""
    near = {c: 0 for c in [*minhash.LONGS, *minhash.LONGER]}
    far = near | {c: sum(1 << (minhash.LANE * j) for j in range(minhash.PER_LONG)) for c in minhash.LONGS[: minhash.DISTANCE // minhash.PER_LONG + 1]}
    schema = "struct<" + ",".join(f"{c}:long" for c in near) + ">"
    df = spark.createDataFrame([(tuple(near.values()), tuple(far.values()))], f"p {schema}, q {schema}")
    assert df.select(minhash._near("p", "q").alias("x")).first().x


def test_items_of_a_window_that_all_share(spark):
    """A line that every item holds is one pattern at the tasks; its items come from the table. Clashing names, repeated ids, a long text."""
    items = spark.createDataFrame([(i, f"the licence line of them all {i} own words {i}") for i in range(300)], "item_id long, text string")
    long = "x " * 50_000 + "the licence line of them all" + " y" * 50_000
    docs = spark.createDataFrame([(1, long, 0), (1, "nothing here", 0), (None, "THE licence, line of them all", 0)], "doc_id long, text string, n_words int").withColumns({c: F.lit("q") for c in ("spans", "items", "hits", "id", "name", "block")})
    got = sorted(((r.n_words, len(r["items"]), [(s.start, s.end) for s in r.spans]) for r in decontaminate.find_benchmark(docs, items, window=6).collect()))
    assert got == [(2, 0, []), (6, 300, [(0, 6)]), (100_006, 300, [(50_000, 50_006)])]
    assert decontaminate.find_benchmark(docs.limit(0), items).collect() == []
    assert decontaminate.clean_documents(docs, items, window=6).select("text").collect() == [("nothing here",)]
