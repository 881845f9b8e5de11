"""The pipeline against plain versions of its stages."""

import re

import corpus_pipeline
from test_pairs import classes, occurrences
from test_texts import plain_spans, repeated

SF = "/root/testdata/sf0.001"


def rejected(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    chars, upper, letters = sum(map(len, w)), len(re.findall("[A-Z]", text or "")), len(re.findall("[A-Za-z]", text or ""))
    return len(w) < 10 or 100 * repeated(w) > 20 * len(w) or 2 * len(re.findall(r"[#*$%&|<>]", text)) > len(w) or 10 * (len(lines) - len(set(lines))) > 3 * len(lines) or not 2 * len(w) <= chars <= 20 * len(w) or 2 * upper > letters


def test_pipeline(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {i: r.text for i, r in docs.items() if not rejected(r.text)}
    top = classes(sorted(kept.items()), 5)
    kept = {i: t for i, t in kept.items() if top[i] == i}
    kept = {i: t for i, t in kept.items() if not occurrences(t, items, 10)[1]}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(kept)
    for i, text in kept.items():
        for kind, name in enumerate(("EMAIL", "IP", "CARD", "PHONE")):
            for start, k, end in plain_spans(text):
                if k == kind:
                    assert text[start:end] not in got[i].text and "<" in got[i].text
        if not plain_spans(text) and "<TERM>" not in got[i].text and got[i].text == text:
            assert got[i].n_chars == len(text)
        assert got[i].rate >= 0 and got[i].source == docs[i].source


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "personal_data", "mix"]


def test_stages_take_empty_tables_and_nulls(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "word " * 3, "en", "s", 1), (None, None, None, None, None), (1, None, None, None, None)], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0
        assert stage(spark, odd, SF).count() <= 4


def test_null_and_repeated_ids_are_judged_by_their_texts(spark):
    """Copies go and clean rows stay, whatever their ids; one leaked row takes no other with it."""
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(r.text.split()) >= 10)
    rows = [(None, text(0)), (None, text(0)), (None, text(0) + " more"), (None, text(1)), (5, text(2)), (5, text(3)), (5, text(2)), (7, text(1))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], schema)
    got = sorted(((r.doc_id, r.text.split()[0]) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()), key=str)
    assert got == sorted([(None, "w0x0"), (7, "w1x0"), (5, "w2x0"), (5, "w3x0")], key=str)
    mixed = docs.unionByName(spark.createDataFrame([(i, item, "en", "s", len(item)) for i in (None, 5)], schema))
    assert sorted(r.text for r in corpus_pipeline.decontamination(spark, mixed, SF).collect()) == sorted(t for _, t in rows)
