"""Main-text extraction from HTML by tree scoring.

Paragraphs pass points for their length and commas up to their ancestors, less the further up; a
container's points are discounted by the share of its text that lies in links. The best container
and those siblings that score well enough are kept; where no article is marked, a container around the best one that gains enough points
takes its place, so that text in several columns or sections stays together.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("head script style noscript template nav header footer aside form button select textarea input iframe object embed svg math canvas audio video menu dialog title option label fieldset".split())
ENDS_P = BLOCK - frozenset("td th tr tbody thead tfoot caption html body".split())
SCOPE = frozenset("article section div td th table body html main aside li blockquote ul ol".split())
SAME_LEVEL = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
# Words in class and id names, and roles, of what isn't an article's text.
SIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription "
    "signup share sharing social related recommended recommendations recirc outbrain taboola sidebar widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar comment comments disqus respond replies reply "
    "login search pagination pager tags skip skiplink paywall".split()
)
# Words that say no more in such a name, so that a name of these and side words is a side part's.
PLAIN_WORDS = frozenset(
    "area articles bar block body bottom box button buttons by center col column container content count desktop extra field form global group holder icon icons id in inner item items js left link links list main message "
    "mobile more news of on outer page panel pane post posts reading right row section short site slot small stories story text the thread to top unit wrap wrapper zone article large inline block view views".split()
)
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Link text, as a share of a part's text, from which on a part of a doubtful name is a side part.
LINKED = 0.33
#: Points of paragraphs that a container must add to what it holds to be taken instead, as a share.
GAIN = 0.2
#: Text outside all side parts, as a share of a named part's, up to which that part is the page's wrapper.
WRAPPED = 0.1
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "parent", "children", "side", "named", "doubtful", "role", "score", "points", "chars", "links", "commas")

    def __init__(self, tag: str, parent: Node | None, side: bool = False, named: bool = False, doubtful: bool = False, role: str = ""):
        self.tag, self.parent, self.children, self.side, self.named, self.doubtful, self.role = tag, parent, [], side or named, named, doubtful, role
        self.score, self.points, self.chars, self.links, self.commas = 0.0, 0.0, 0, 0, 0


def _beside(tag: str, attrs: dict[str, str], within: bool) -> bool:
    """Whether an element's kind, role or style says that it isn't part of the text; an article's own header is part of it."""
    if tag in DROPPED and tag != "form" and not (within and tag == "header") or "hidden" in attrs or _HIDDEN.search(attrs.get("style", "")):
        return True
    return tag in BLOCK and attrs.get("role", "").lower() in SIDE_ROLES - {"form"}


def _named(tag: str, attrs: dict[str, str], within: bool) -> tuple[bool, bool]:
    """Whether an element is a form, or its class or id has a word of side parts (it may still wrap the text); and whether that is in doubt.

    Names of elements inside a line are never looked at. ``within``: inside an article or the main part, where
    what is named a header holds the title, and a name that also has other words proves nothing.
    """
    if tag == "form" or attrs.get("role", "").lower() == "form":
        return True, False
    if tag not in BLOCK or tag in ("html", "body", "article", "main") or "class" not in attrs and "id" not in attrs:
        return False, False
    names = [{w.lower() for w in _NAME.findall(name)} for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split()]
    side = SIDE_WORDS - {"header"} if within else SIDE_WORDS
    hit = [n for n in names if n & side]
    return bool(hit), bool(hit) and within and not any(all(w in side or w in PLAIN_WORDS or w.isdigit() for w in n) for n in hit)


class _Tree(HTMLParser):
    """The elements of a page. Open elements are also listed by tag, so that no tag looks through all of them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", None)
        self.open, self.places, self.blocks = [self.root], {}, [0]

    def _cut(self, place: int) -> None:
        """Close the open elements from a place on."""
        while len(self.open) > place:
            self.places[self.open.pop().tag].pop()
        while self.blocks[-1] >= place:
            self.blocks.pop()

    def _last(self, tags: set[str] | frozenset[str]) -> int:
        """The place of the innermost open element of ``tags``."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def _close(self, tags: set[str] | frozenset[str], within: set[str] | frozenset[str]) -> None:
        """Close the outermost open element of ``tags`` that no element of ``within`` shields."""
        some = [self.places[t] for t in tags if self.places.get(t)]
        if some:
            shield = self._last(within)
            outer = [p[k] for p in some if (k := bisect_right(p, shield)) < len(p)]
            if outer:
                self._cut(min(outer))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS_P and self.places.get("p"):
            self._close({"p"}, SCOPE)
        if tag in SAME_LEVEL:
            self._close(*SAME_LEVEL[tag])
        if tag == "body":
            self._close({"head"}, set())
        named = {k: v or "" for k, v in attrs}
        within = bool(self.places.get("article") or self.places.get("main"))
        beside = _beside(tag, named, within)
        by_name, doubtful = (False, False) if beside else _named(tag, named, within)
        node = Node(tag, self.open[-1], beside, by_name, doubtful, named.get("role", "").lower())
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.open))
            if tag in BLOCK:
                self.blocks.append(len(self.open))
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path", "math"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        opened = self.places.get(tag)
        # an inline end tag doesn't close blocks
        if opened and (tag in BLOCK or self.blocks[-1] < opened[-1]):
            self._cut(opened[-1])

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    _settled(tree.root)
    _freed(tree.root)
    return tree.root


def _settled(root: Node) -> None:
    """Parts of a doubtful name stay in the text, unless they are full of links or hold a form."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if isinstance(c, Node)]
    sums: dict[Node, tuple[int, int, bool]] = {}  # characters, those in links, whether there are fields of a form
    for node in reversed(order):
        inner = [sums[c] for c in node.children if isinstance(c, Node) and c.tag not in ("script", "style", "noscript", "template")]
        chars = sum(len("".join(c.split())) for c in node.children if isinstance(c, str)) + sum(x[0] for x in inner)
        sums[node] = chars, chars if node.tag == "a" else sum(x[1] for x in inner), node.tag in ("form", "button", "input", "select", "textarea") or any(x[2] for x in inner)
        if node.doubtful:
            node.side = node.named = sums[node][2] or sums[node][1] > LINKED * chars


def _freed(root: Node) -> None:
    """Let parts that only their name (or being a form) sets aside pass if they wrap nearly all of the page's text."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if isinstance(c, Node) and (not c.side or c.named)]
    whole: dict[Node, int] = {}  # characters outside links, with named parts and without
    clear: dict[Node, int] = {}
    for node in reversed(order):
        own = 0 if node.tag == "a" else sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
        inner = [] if node.tag == "a" else [c for c in node.children if c in whole]
        whole[node] = own + sum(whole[c] for c in inner)
        clear[node] = own + sum(clear[c] for c in inner if not c.side)
    outside = clear[root]
    above: dict[Node, Node | None] = {}  # the innermost named part around each part
    for node in order:
        up = node.parent
        above[node] = None if up is None else up if up.named else above[up]
    for node in sorted((c for c in order if c.side), key=lambda x: -whole[x]):  # a wrapper before what it wraps
        if not whole[node] or outside > WRAPPED * whole[node]:
            break  # the others are smaller
        up = above[node]
        while up is not None and not up.side:  # one of the few that were let pass
            up = above[up]
        if up is None:
            node.side = False
            outside += clear[node]


def _ordered(root: Node) -> list[Node]:
    """The elements outside side parts, parents before children."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [c for c in reversed(node.children) if isinstance(c, Node) and not c.side]
    return out


def _scored(nodes: list[Node]) -> None:
    for node in reversed(nodes):
        for c in node.children:
            if isinstance(c, str):
                n = len("".join(c.split()))
                node.chars += n
                node.commas += c.count(",") + c.count("、") + c.count("，")
            elif not c.side:
                node.chars += c.chars
                node.links += c.links
                node.commas += c.commas
        if node.tag == "a":
            node.links = node.chars
    for node in nodes:
        inner = any(isinstance(c, Node) and c.tag in BLOCK for c in node.children)
        if node.chars < 10 or node.links > 0.5 * node.chars or not (node.tag in ("p", "pre", "blockquote", "td", "li", "dd") or node.tag in ("div", "section", "article", "main", "body")) or (inner and node.tag != "blockquote"):
            continue
        points, up, level = 1 + node.commas + min(node.chars / 100, 3.0), node.parent, 0
        node.points = points
        while up is not None and level < 5:
            up.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up, level = up.parent, level + 1
        node.score += points if node.tag not in ("p", "li", "dd") else 0
    for node in reversed(nodes):  # a container's points are those of all paragraphs in it
        if node.parent is not None:
            node.parent.points += node.points


def _density(node: Node) -> float:
    return node.links / node.chars if node.chars else 0.0


def _paragraphs(node: Node) -> bool:
    """Whether a container holds a long paragraph of its own, and few links."""
    return _density(node) < 0.25 and any(isinstance(c, Node) and not c.side and c.tag == "p" and c.chars > 60 and _density(c) < 0.25 for c in node.children)


def _worth(node: Node) -> bool:
    """Whether a part of a container that was taken for its gain is text of the article."""
    if node.tag in ("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"):
        return True
    return _density(node) < 0.5 and (node.points >= 2 or node.tag in ("p", "ul", "ol", "dl", "table", "pre", "blockquote", "figure"))


def _widened(best: Node) -> Node:
    """The container around ``best`` up to which each gains enough points; parts beside the way that aren't text are set aside."""
    weight = lambda n: n.points * (1 - _density(n))
    top, up = best, best.parent
    while up is not None and up.tag not in ("html", "#root"):
        if weight(up) > (1 + GAIN) * weight(top):
            top = up
        up = up.parent
    node = best
    while node is not top:
        for c in node.parent.children:
            if isinstance(c, Node) and c is not node and c.tag in BLOCK and not _worth(c):
                c.side = True
        node = node.parent
    return top


def chosen(root: Node) -> list[Node]:
    """The elements whose text is the article, in page order."""
    nodes = _ordered(root)
    _scored(nodes)
    rank = lambda n: n.score * (1 - _density(n))
    containers = [n for n in nodes if n.tag in BLOCK and n.tag not in ("p", "html", "ul", "ol", "tr", "li") and n.score > 0]
    if not containers:
        whole = [n for n in nodes if n.tag in ("article", "main") or n.role == "main"] or [n for n in nodes if n.tag == "body"] or [root]
        return whole[:1]
    best = max(containers, key=rank)
    node = best
    while node is not None and not (node.tag in ("article", "main") or node.role in ("main", "article")):
        node = node.parent
    top = node if node is not None else best
    if node is None:
        while best.tag in ("td", "tbody", "thead", "blockquote", "dl", "pre") and best.parent is not None and best.parent.tag not in ("body", "#root"):
            best = best.parent
        top = _widened(best)
    if top.parent is None:
        return [top]
    least = 0.2 * rank(top)
    kept = []
    for s in top.parent.children:
        if s is top:
            kept.append(s)
        elif isinstance(s, Node) and not s.side and top.tag != "body":
            if (s.tag in BLOCK and s.tag != "p" and (rank(s) >= max(10.0, least) or _paragraphs(s))) or (s.tag == "p" and _density(s) < 0.25 and s.chars > 80) or (s.tag == "p" and s.chars and not s.links and s.commas):
                kept.append(s)
    return kept


def blocks(node: Node) -> list[str]:
    """The text of each block, in order, with white space made one space; empty blocks are left out."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append(text)

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            run.append(x)
        elif x.tag == "br":
            run.append(" ")
        elif not x.side:
            if x.tag in BLOCK:
                end()
                stack.append(None)
            stack += reversed(x.children)
    end()
    return out


def main_text(html: str | None) -> str:
    """The article's blocks joined by newlines; empty for a null or empty page."""
    return "\n".join(b for node in chosen(parse(html)) for b in blocks(node)) if html else ""


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` and the main text of every page, from its whole html; one row for each row.

    A null or empty page has an empty text, as has one of side parts only. Repeated rows are read
    alike, a very long page is read whole, and an empty table gives an empty one.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pages.select(*keep).schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(h.as_py()) for h in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(text, pa.string())], names=[*keep, "text"])

    return pages.select(*keep, F.col(html_col).alias("_html")).mapInArrow(run, ", ".join([*(f"`{k}` {t}" for k, t in kinds.items()), "text string"]))
