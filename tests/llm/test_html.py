"""Pages of many templates: what is the article stays, what is beside it goes."""

import time

import pytest

from tributary.llm import html

A, B, C = (f"The {x} harbour of the old town, which was rebuilt after the flood, is open to all boats again, the council said on Monday." for x in ("northern", "southern", "western"))
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li></ul></nav>'
SIDE = f'<div class="sidebar"><p>Read more, {C}</p></div>'
FOOT = f"<footer><p>All rights reserved, {C}</p></footer>"
ARTICLE = f"<h1>Harbour opens</h1><p>{A}</p><p>{B}</p>"
TEXT = f"Harbour opens\n{A}\n{B}"

TEMPLATES = {
    "article element": f"<body>{NAV}<article>{ARTICLE}</article>{SIDE}{FOOT}</body>",
    "main element": f"<body>{NAV}<main>{ARTICLE}{SIDE}</main>{FOOT}</body>",
    "div only": f'<body>{NAV}<div id="wrap"><div class="post">{ARTICLE}</div>{SIDE}</div>{FOOT}</body>',
    "table layout": f"<body><table><tr><td>{NAV}</td><td>{ARTICLE}</td></tr></table>{FOOT}</body>",
    "nested containers": f"<body>{NAV}<div><div><div><div>{ARTICLE}</div></div></div></div>{SIDE}</body>",
    "named like a side part": f'<body>{NAV}<div class="share-prices">{ARTICLE}</div>{FOOT}</body>',
    "named header in the article": f'<body>{NAV}<article><div class="entry-header"><h1>Harbour opens</h1></div><p>{A}</p><p>{B}</p></article>{SIDE}</body>',
    "one form around the page": f'<body><form id="aspnetForm">{NAV}<div>{ARTICLE}</div>{SIDE}</form></body>',
    "advert within": f'<body><article><h1>Harbour opens</h1><p>{A}</p><div class="ad-slot">{C} Buy now.</div><p>{B}</p></article>{FOOT}</body>',
    "comments longer than the article": f'<body><div class="post">{ARTICLE}</div><section id="comments"><p>{C} {C}</p><p>{C} {C}</p><p>{C}</p></section></body>',
    "cookie notice": f'<body><div class="cookie-notice"><p>We use cookies, {C}</p></div><div class="post">{ARTICLE}</div></body>',
    "newsletter form within": f'<body><article>{ARTICLE}<form><p>Subscribe to our letter, {C}</p></form></article></body>',
    "unclosed paragraphs": f"<body>{NAV}<article><h1>Harbour opens</h1><p>{A}<p>{B}</article>{SIDE}",
    "scripts and styles": f"<body><script>var a = '<p>{C}</p>';</script><style>p {{ }}</style><article>{ARTICLE}</article><!-- {C} --></body>",
}


TEMPLATES |= {
    "names inside a line": f'<body>{NAV}<article><h1>Harbour <em class="alert">opens</em></h1><p><span class="social">{A[:11]}</span>{A[11:]}</p><p><strong class="ad" role="alert">{B}</strong></p></article>{FOOT}</body>',
    "named sections of the article": f'<body>{NAV}<article><section id="related-work"><h1>Harbour opens</h1><p>{A}</p></section><div class="popup-art"><p>{B}</p></div></article>{FOOT}</body>',
    "links under a doubtful name": f'<body><article>{ARTICLE}<div class="related-reports"><a href="/x">{C}</a><p>Also see</p></div></article></body>',
    "a form under a doubtful name": f'<body><article>{ARTICLE}<div class="subscribe-harbour"><p>{C}</p><button>Go</button></div></article></body>',
    "comments within": f'<body><main>{ARTICLE}<div class="comments-section" id="c1"><p>{C}</p></div></main></body>',
    "header element of the article": f"<body><header><p>{C}</p></header><article><header><h1>Harbour opens</h1></header><p>{A}</p><p>{B}</p></article></body>",
    "sections of unlike depth": f'<body>{NAV}<div class="s1"><div><h1>Harbour opens</h1><p>{A}</p></div></div><div class="s2"><div><div><p>{B}</p></div></div></div>{FOOT}</body>',
    "a short line beside sections": f'<body>{NAV}<div><div><h1>Harbour opens</h1><p>{A}</p></div><div><div><p>{B}</p></div></div><div>All rights reserved</div></div><div><a href="/">{C}</a></div></body>',
}


@pytest.mark.parametrize("name", TEMPLATES)
def test_template(name):
    assert html.main_text(f"<html><head><title>x</title></head>{TEMPLATES[name]}</html>") == TEXT


def test_sibling_with_a_short_paragraph_stays():
    short = "The ferry, which had been out of service since March, sails at nine again."
    assert html.main_text(f"<body>{NAV}<div><div><p>{A}</p><p>{B}</p></div><div><p>{short}</p></div></div>{FOOT}</body>") == f"{A}\n{B}\n{short}"


def test_lists_and_quotes_in_the_article():
    page = f"<body><article><p>{A}</p><ul><li>one, two</li><li>three</li></ul><blockquote>{B}</blockquote><pre>x  y</pre></article></body>"
    assert html.main_text(page) == f"{A}\none, two\nthree\n{B}\nx y"


@pytest.mark.parametrize("piece", ["<b>", "<b></i>", "<div><i></b>", "<p><b>", "<li><i></p>", '<div class="ad">', "<td></table>"])
def test_time_is_linear_in_the_page(piece):
    """Pages of unclosed and unmatched tags take a time in proportion to their length."""

    def seconds(n):
        began = time.process_time()
        html.main_text(f"<body><p>{A}</p>" + piece * n + f"<p>{B}</p>")
        return time.process_time() - began

    small = max(min(seconds(5_000) for _ in range(2)), 0.02)
    assert seconds(40_000) < 8 * small * 3


def test_columns_stay_together():
    columns = [[f"{x} {k} {w}." for k, x in enumerate((A, B, C))] for w in ("left", "middle", "right")]
    page = "".join(f'<div class="col"><p>{"</p><p>".join(c)}</p></div>' for c in columns)
    assert html.main_text(f'<body>{NAV}<div class="row">{page}</div>{SIDE}{FOOT}</body>') == "\n".join(x for c in columns for x in c)


def test_sections_of_unlike_depth():
    one, two = [f"{A} {k}" for k in range(3)], [f"{B} {k}" for k in range(2)]
    assert html.main_text(f'<body><div class="s1"><div><p>{"</p><p>".join(one)}</p></div></div><div class="s2"><div><div><p>{"</p><p>".join(two)}</p></div></div></div>{FOOT}</body>') == "\n".join(one + two)


def test_tables_of_pages(spark):
    """Null, empty and repeated pages, one of side parts only, a very long one; columns of clashing names; no pages."""
    long = "<body><article>" + f"<p>{A}</p>" * 20_000 + "</article></body>"
    rows = [(1, "u", None), (2, "u", ""), (None, None, f"<body>{NAV}{FOOT}</body>"), (4, "v", TEMPLATES["article element"]), (4, "v", TEMPLATES["article element"]), (5, "w", long)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, text string, _html string")
    got = sorted(((r.page_id or 0, r.text) for r in html.extract(df).collect()))
    assert got == [(0, ""), (1, ""), (2, ""), (4, TEXT), (4, TEXT), (5, "\n".join([A] * 20_000))]
    assert html.extract(df.limit(0)).collect() == [] and html.extract(df).columns == ["page_id", "url", "text"]
