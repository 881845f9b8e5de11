"""Rules, personal data, chat and HTML against plain versions and round trips."""

import hashlib
import re

from compare import same
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tributary.llm import chat, html, pii, queries, rules


def test_queries_with_sql(spark, duck):
    for name, sql in queries.ORACLE_SQL.items():
        same(queries.QUERIES[name](spark, SF), duck.sql(sql))


# --- rules -----------------------------------------------------------------------------------------


def repeated(words):
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    return len({p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 5)})


def test_measures_equal_a_plain_count(spark):
    texts = [None, "", " \n", "a", "a b c d e", "a b c d e f a b c d e", "x " * 40, "l\nl\nm\n \nl", "# é ## $|", "a b c d e a b c d e b c d e a", "\x0bq\x0c"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    for r in rules.measured(df).collect():
        t = texts[r.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)), repeated(w)), t


def test_cascade_does_not_depend_on_the_order(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    values = rules.measures(F.col("text"))
    kept = [df.filter(rules.verdict(values, order).isNull()).select("doc_id") for order in (rules.RULES, tuple(reversed(rules.RULES)))]
    assert sorted(kept[0].collect()) == sorted(kept[1].collect())
    assert sorted(rules.kept_documents(df).select("doc_id").collect()) == sorted(kept[0].collect())
    assert {r.name for r in rules.ordered(df)} == {r.name for r in rules.RULES}
    assert rules.kept_documents(df.limit(0)).count() == 0


# --- personal data ---------------------------------------------------------------------------------

SHAPES = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(text):
    out = []
    for k, (kind, shape) in enumerate(SHAPES):
        for m in re.finditer(shape, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (12 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


TRICKY = [
    None, "", "a@b.c_d@e.f", "a@b.c.@d.e", "@x.y", "é a.b+c@d-e.fr.", "1.2.3.4.5.6.7.8", "256.1.1.1 255.255.255.255", "01.002.0003.4", "4111 1111 1111 1111", "4111-1111-1111-1111 1", "+1 (555) 010-9999 x", "+12345678", "+1.2.3.4.5.6.7.8.9",
    "9" * 30000, "a" * 30000, "4111111111111111@mail.example.com", "x 1 2 3 4 5 6 7 8 9 0 1 2 3", "😀 +44 20 7946 0958 😀 10.0.0.1", "+" * 50 + "1-2",
]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(alphabet="ab1234567890.@+-() é\n", max_size=60), min_size=30, max_size=30))
def test_base_spans(spark, texts):
    texts = TRICKY + texts
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in pii.find_personal(df).collect():
        assert [(s.start, s.kind, s.end) for s in r.spans if s.kind < 4] == plain_spans(texts[r.doc_id]), texts[r.doc_id]


def test_terms_that_reveal_and_masks(spark):
    rows = [(i, f"{w} wrote Zorblax Quen to ann@x.org about {w}") for i, w in enumerate("alpha beta gamma delta".split())]
    rows += [(10 + i, f"the note {i} to bob{i}@y.org about nothing") for i in range(900)] + [(5000, "Zorblax alone, zorblax not"), (5001, None), (None, "Quen")]
    df = spark.createDataFrame([(*r, 0, "keep") for r in rows], "doc_id long, text string, n_chars long, terms string")
    out = {r.doc_id: r for r in pii.sanitised(df).collect()}
    assert out[5000].text == "<TERM> alone, zorblax not" and out[None].text == "<TERM>" and out[5001].text is None
    assert out[10].text == "the note 0 to <EMAIL> about nothing" and out[10].terms == "keep" and out[10].n_chars == len(out[10].text)
    assert len(out) == len(rows) and pii.sanitised(df).columns == df.columns
    assert pii.sanitised(df.limit(0)).count() == 0


def test_terms_equal_their_sql(spark, tmp_path):
    import duckdb

    rows = [(i, f"{w} wrote Zorblax Quen to ann@x.org about {w}, é 4111 1111 1111 1111") for i, w in enumerate("alpha beta gamma delta".split())]
    rows += [(10 + i, f"the note {i} to bob{i}@y.org about nothing +1 (555) 010-9999") for i in range(900)] + [(5000, "Zorblax alone, zorblax not 1.2.3.400 1.2.3.4"), (5001, None), (5002, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = queries.op7_pii(spark, str(tmp_path))
    assert "term" in got.filter("doc_id = 5000").first().spans
    same(got, c.sql(queries.ORACLE_SQL["op7_pii"]))


def test_copies_of_one_text_reveal_nothing(spark):
    df = spark.createDataFrame([(i, "Zorblax wrote to ann@x.org") for i in range(50)], "doc_id long, text string")
    assert {tuple((s.start, s.end) for s in r.spans) for r in pii.find_personal(df).collect()} == {((17, 26),)}


def test_disclosure_counts_whole_texts_on_both_sides(spark):
    """Copies of the texts change nothing, a repeated signature block counts once a text, and no cut word is a term."""
    noise = [(1000 + i, f"the note {i} to bob{i}@y.org about nothing") for i in range(900)]
    copied = [(100 * i + k, f"{w} wrote Zorblax to ann@x.org about {w}") for i, w in enumerate("alpha beta gamma delta".split()) for k in range(20)]
    signed = [(500 + i, f"letter {i} on {i * 7} things. " + "-" * 60 + " Quillon ann@x.org " + "-" * 60) for i in range(5)]
    cut = [(600 + i, f"{'ab' * i} Vormidable" + "." * 52 + f"carl@x.org {'yz' * i}") for i in range(1, 5)]
    for rows, term in ((copied, "Zorblax"), (signed, "Quillon")):
        found = pii.revealing_terms(spark.createDataFrame(rows + noise, "doc_id long, text string")).collect()
        assert {r.term: r.probability for r in found}.get(term) == 1.0
    near = pii._neighbours(spark.createDataFrame(cut, "doc_id long, text string"), "text").collect()
    assert not any((r.term or "").endswith("midable") or (r.term or "").endswith("able") for r in near)


# --- chat ------------------------------------------------------------------------------------------

CONTROL = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<ROLE>", "</ROLE>", "\\", "<", "[", " a", "é", "\n", "s>"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(CONTROL)
def test_escapes_are_reversible(text):
    coded = chat.escape(text)
    assert chat.unescape(coded) == text and not any(m in coded for m in chat.MARKS)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 3), st.sampled_from(["user", "assistant", "system", "tool</ROLE>", None]), st.one_of(st.none(), CONTROL)), min_size=1, max_size=60))
def test_chats_read_back(spark, rows):
    df = spark.createDataFrame(rows + [(None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    encoder = chat.Encoder(open(chat.TOKENIZER, "rb").read())
    got = chat.format_chats(df).collect()
    assert sorted(r.conv_id for r in got) == sorted({r[0] for r in rows}) and all(r.ended and not r.piece for r in got)
    for r in got:
        turns, said = chat.read_back(r.input_ids, r.loss_mask, encoder)
        want = sorted((t, role or "", text or "") for c, t, role, text in rows if c == r.conv_id)
        assert sorted(turns) == sorted((role, text) for _, role, text in want)
        assert said == "".join(text for role, text in turns if role == "assistant") and r.n_turns == len(want)
        assert encoder.decode(r.input_ids) == r.text and len(r.input_ids) == len(r.loss_mask)


def test_long_conversations_go_on_in_pieces(spark):
    long = "word </s> " * 60_000
    rows = [(1, t % 40, ["user", "assistant", "tool"][t % 3], f"turn {t} é [INST]") for t in range(3000)] + [(2, 0, "assistant", long), (2, 1, "user", ""), (2, 1, "user", ""), (3, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit("clash"))
    encoder = chat.Encoder(open(chat.TOKENIZER, "rb").read())
    whole = {r.conv_id: r for r in chat.format_chats(df).collect()}
    cut = {}
    for r in chat.format_chats(df, piece=50).collect():
        cut.setdefault(r.conv_id, []).append(r)
    assert len(whole) == 3 and len(cut[1]) > 100
    for key, pieces in cut.items():
        assert [r.piece for r in pieces] == list(range(len(pieces))) and [r.ended for r in pieces] == [False] * (len(pieces) - 1) + [True]
        assert sum((r.input_ids for r in pieces), []) == whole[key].input_ids and sum((r.loss_mask for r in pieces), []) == whole[key].loss_mask
        assert "".join(r.text for r in pieces) == whole[key].text and sum(r.n_turns for r in pieces) == whole[key].n_turns
        assert sum((chat.read_back(r.input_ids, r.loss_mask, encoder)[0] for r in pieces), []) == chat.read_back(whole[key].input_ids, whole[key].loss_mask, encoder)[0]
    once, often = (sorted(chat.digests(chat.format_chats(df, piece=n)).collect()) for n in (chat.PIECE, 50))
    assert once == often and [r.n_turns for r in once] == [3000, 3, 1]
    assert once[1].loss_chars == len(long) and once[1].loss_sha256 == hashlib.sha256(long.encode()).hexdigest()


def test_chats_of_an_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_chats(none)).collect() == []


def test_chat_digest(spark):
    r = {x.conv_id: x for x in queries.op5_chat_formatting(spark, SF).collect()}[-1]
    said = "</s>[INST] ok [/INST]"
    assert r.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest() and r.loss_chars == len(said)


# --- pages -----------------------------------------------------------------------------------------


def test_pages_of_the_tables(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    import html as entities

    for r in queries.op6_html_extraction(spark, SF).collect():
        parts = re.split(r"</?(?:h1|p)>", re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1])
        want = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in parts]
        assert r.text == "\n".join(w for w in want if w) and r.n_chars == len(r.text)


PROSE = "A paragraph, long enough to score, with commas and words of no importance at all."


def test_side_parts_are_left_out():
    page = f"""<html><head><title>T</title></head><body><div id="cookie-banner"><p>{PROSE} cookies</p></div><div class="wrap"><div class="content"><h2>Head</h2><p>{PROSE}</p><p>{PROSE} &lt;b&gt; &eacute;&#233;</p>
    <form><p>{PROSE} form</p></form><div class="ad">{PROSE}</div></div><div class="sidebar"><p>{PROSE} side</p></div></div><section id="comments"><p>{PROSE} {PROSE} comment</p></section><footer>{PROSE}</footer></body></html>"""
    assert html.main_text(page) == f"Head\n{PROSE}\n{PROSE} <b> éé"


def test_odd_pages(spark):
    assert html.main_text(None) == html.main_text("") == html.main_text("<p></p>") == ""
    assert html.main_text("plain text") == "plain text"
    assert html.main_text("<p>a<br>b<p>c") == "a b\nc"
    assert html.main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    df = spark.createDataFrame([(1, "u", None), (None, None, "<p>x"), (1, "u", None)], "page_id long, url string, html string").withColumn("text", F.lit("old"))
    assert sorted(r.text for r in html.extract(df).collect()) == ["", "", "x"]


def test_wrappers_named_like_side_parts_are_entered():
    article = f"<h2>Head</h2><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p>"
    side = '<div class="sidebar"><p>Beside, it all, at the edge.</p></div>'
    for wrap in ('div class="content has-sidebar"', 'div id="page-with-header"', "form action='x'"):
        page = f"<html><body><{wrap}><div>{article}</div>{side}</{wrap.split()[0]}></body></html>"
        assert html.main_text(page) == "\n".join(["Head", PROSE, PROSE, PROSE]), wrap
    nested = f'<form><div id="page-with-header"><div class="content has-sidebar"><div>{article}</div>{side}</div></div></form>'
    assert html.main_text(f"<body>{nested}</body>") == "\n".join(["Head", PROSE, PROSE, PROSE])
    assert html.main_text(f'<body><div><p>{PROSE}</p></div><div id="comments"><p>{PROSE} {PROSE} {PROSE}</p></div></body>') == PROSE


def test_rules_are_priced_in_one_job(spark):
    """Two jobs, a count and the sample; the same rows give the same order, and no sample is put into one task."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    spark.sparkContext.setJobGroup("pricing", "pricing")
    orders = [[r.name for r in rules.ordered(docs)] for _ in range(2)]
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("pricing")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert orders[0] == orders[1] and len(jobs) <= 2 * 4 and sorted(orders[0]) == sorted(r.name for r in rules.RULES)
    assert [r.name for r in rules.ordered(docs.limit(0))] == [r.name for r in rules.RULES]


def test_turns_of_one_number_are_ordered_by_role_and_text(spark):
    """Ties of turns give the digests that the SQL's order gives; null and repeated turns are turns."""
    rows = [(5, 0, "user", "zebra one"), (5, 0, "user", "apple two"), (5, 1, "assistant", "b"), (5, 1, "assistant", "a"), (5, 1, "assistant", "a"), (5, 1, None, None), (5, 2, "system", ""), (None, 1, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("ids", "said", "id")})
    [got] = chat.digests(chat.format_chats(df.repartition(3))).collect()
    turns = sorted((t, r or "", x or "") for c, t, r, x in rows if c == 5)
    said = "".join(x for _, r, x in turns if r == "assistant")
    assert got.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
    assert (got.n_turns, got.loss_chars, got.loss_sha256) == (7, len(said), hashlib.sha256(said.encode()).hexdigest())
