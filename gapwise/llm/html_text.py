"""Main text of web pages: flat text blocks, classified by a small decision tree.

A page is cut into flat blocks of text at every block-level tag.  Each block is described by its words and link density,
those of the block before and after it, and where it stands (inside or outside the article; inside an element whose
name, class, id or role says menu, footer, advert and so on).  A decision tree, grown on the blocks of the small labelled
pages below, says which blocks are main text.  Everything happens in the task that holds the page: no shuffle.

A word in a class, id or role is weak evidence.  It does not count for the element that has most of the page's text and its
articles, nor for an article with a third of the text (``form-post``, ``search-layout``), nor with a prefix as in ``no-sidebar``.
Text outside an article is told apart from it if the articles have a third of the text that is not named as boilerplate.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.llm.common import in_pieces

# fixed values: element names and words of class, id and role
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template svg iframe noembed noframes xmp".split())
BOILER_TAGS = frozenset("nav aside footer header form menu dialog select button fieldset".split())
ARTICLE_TAGS = frozenset("article main".split())
BOILER_WORDS = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside ad ads adv advert adverts advertisement adsense banner promo "
    "promotion sponsor sponsored notice notices cookie cookies consent gdpr popup modal overlay alert comment comments commentlist "
    "reply replies respond disqus share sharing social related recommended breadcrumb breadcrumbs pagination pager widget login signup "
    "subscribe newsletter copyright disclaimer toolbar search form".split()
)
ADVERT_WORDS = frozenset("ad ads adv advert adverts advertisement adsense banner promo promotion sponsor sponsored".split())
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond disqus".split())
SURE_WORDS = ADVERT_WORDS | COMMENT_WORDS | frozenset("nav navbar navigation menu footer sidebar cookie cookies consent gdpr breadcrumb breadcrumbs".split())
NOT_OWN = ("no-", "non-", "has-", "with-", "without-", "no_", "has_", "with_")
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

# a quote opens a value only right after "="; a value whose quote is never closed is an unquoted one
TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+)*+)>""")
CUT_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
NAMED = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
LONG = 20
FEATURES = ["boiler", "article", "words", "links", "words_before", "links_before", "words_after", "links_after", "heading"]


@dataclass
class Block:
    """A run of text without a block-level tag inside."""

    text: str
    linked: int  # words inside links
    element: int
    heading: bool
    boiler: bool = False
    article: int = 0  # 1 inside an article, -1 outside the articles of the page, 0 if it has none

    @property
    def words(self) -> int:
        return self.text.count(" ") + 1

    @property
    def links(self) -> float:
        return self.linked / self.words


@dataclass
class Element:
    """A block-level element; the first one of a page stands for the page itself."""

    name: str
    parent: int
    named: frozenset[str] = frozenset()  # words of class, id and role that say boilerplate
    hard: bool = False  # boilerplate by its tag
    inside: bool = False  # inside an article or main element
    words: int = 0
    articles: int = 0  # article and main elements in it, itself included, that are not named as comments
    boiler: bool = False
    article: bool = False


def _names(rest: str) -> frozenset[str]:
    """Words of class, id and role of a tag that name boilerplate."""
    if not rest:
        return frozenset()
    tokens = (t for x in NAMED.findall(rest) for t in "".join(x).lower().split() if not t.startswith(NOT_OWN))
    return BOILER_WORDS.intersection(w for t in tokens for w in re.split(r"[^a-z0-9]+", t))


def _place(elements: list[Element], found: list[Block]) -> None:
    """Say of every block whether it stands in boilerplate and in an article: one pass up, one down."""
    for b in found:
        elements[b.element].words += b.words
    for e in reversed(elements[1:]):
        up = elements[e.parent]
        e.articles += e.name in ARTICLE_TAGS and not e.named & COMMENT_WORDS
        if e.name == "form" and e.articles:
            e.hard = False  # a form around the whole page
        if not e.hard:
            up.words += e.words
            up.articles += e.articles
    page = elements[0]
    for e in elements[1:]:
        up = elements[e.parent]
        own = bool(e.named)
        if own and e.name == "main":
            own = False
        elif own and e.name == "article":
            own = e.words * (2 if e.named & COMMENT_WORDS else 3) <= page.words
        elif own and e.words * 2 > page.words:
            own = e.articles < page.articles if page.articles else bool(e.named & SURE_WORDS)
        e.boiler = up.boiler or e.hard or own
        e.article = up.article or e.name in ARTICLE_TAGS and not e.boiler
    words = [0, 0]  # outside and inside articles, boilerplate left out
    for b in found:
        e = elements[b.element]
        b.boiler, b.article = e.boiler, int(e.article)
        words[b.article] += 0 if b.boiler else b.words
    if words[1] * 2 >= words[0] and words[1]:
        for b in found:
            b.article = b.article or -1


def blocks(page: str | None) -> list[Block]:
    """Flat text blocks of a page in order, blank ones left out; works on broken and cut-off markup in linear time.

    Text of inline elements that are named as adverts is left out.
    """
    page = page or ""
    found: list[Block] = []
    elements = [Element("", 0)]
    stack = [0]  # open elements
    count: Counter[str] = Counter()  # open elements by name
    parts: list[str] = []
    linked: list[str] = []
    in_link = heading = False
    advert, nested = "", 0  # inline advert that is open, and elements of its name in it
    tags = TAG

    def flush() -> None:
        text = " ".join("".join(parts).split())
        if text:
            found.append(Block(text, len("".join(linked).split()), stack[-1], heading))
        parts.clear()
        linked.clear()

    def add(raw: str) -> None:
        if raw and not advert:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_link:
                linked.append(text + " ")

    def pop() -> str:
        name = elements[stack.pop()].name
        count[name] -= 1
        return name

    at = 0
    while at < len(page):
        tag = page.find("<", at)
        if tag < 0:
            add(page[at:])
            break
        add(page[at:tag])
        if page.startswith("<!--", tag):
            end = page.find("-->", tag + 4)
            at = len(page) if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), tag):
            end = page.find(">", tag)
            at = len(page) if end < 0 else end + 1
            continue
        m = tags.match(page, tag)
        if not m and re.match(r"</?[A-Za-z]", page[tag : tag + 3]):
            # no ">" outside quotes up to the end of the page: from here on a tag ends at its first ">"
            tags = CUT_TAG
            m = tags.match(page, tag)
            if not m:
                break
        if not m:
            add("<")
            at = tag + 1
            continue
        at, closing, name, rest = m.end(), m[1] == "/", m[2].lower(), m[3]
        if name in RAW:
            if not closing and not rest.endswith("/"):
                end = re.compile(rf"</{name}[\s/>]", re.IGNORECASE).search(page, at)
                at = len(page) if end is None else page.find(">", end.start()) + 1 or len(page)
            continue
        if name in INLINE:
            if name == "a":
                in_link = not closing
            elif name == "br":
                parts.append(" ")
            if advert:
                nested += (name == advert) * (-1 if closing else 1)
                advert = advert if nested else ""
            elif rest and not closing and name not in VOID and _names(rest) & ADVERT_WORDS:
                advert, nested = name, 1
            continue
        flush()
        in_advert, advert = bool(advert), ""
        heading = not closing and len(name) == 2 and name[0] == "h" and name[1].isdigit()
        if closing:
            if count[name]:
                while pop() != name:
                    pass
            continue
        if len(stack) > 1:
            last = elements[stack[-1]].name
            if (name in CLOSES_P and last == "p") or (name == "li" and last == "li"):
                pop()
        if name not in VOID and not rest.endswith("/"):
            up = elements[stack[-1]]
            inside = up.inside or up.name in ARTICLE_TAGS
            hard = in_advert or name in BOILER_TAGS and not (name == "header" and inside)
            named = _names(rest) if name not in ("html", "body") else frozenset()
            stack.append(len(elements))
            elements.append(Element(name, stack[-2], named, hard, inside))
            count[name] += 1
    flush()
    _place(elements, found)
    return found


def features(page: list[Block]) -> list[list[float]]:
    """One row per block, in the order of ``FEATURES``; a missing neighbour has no words, over ``LONG`` words are that many."""
    out = []
    for i, b in enumerate(page):
        before, after = (page[i - 1] if i else None), (page[i + 1] if i + 1 < len(page) else None)
        out.append(
            [float(b.boiler), float(b.article), float(min(b.words, LONG)), b.links]
            + [x for n in (before, after) for x in ((float(min(n.words, LONG)), n.links) if n else (0.0, 0.0))]
            + [float(b.heading)]
        )
    return out


def _w(n: int, word: str = "word") -> str:
    return " ".join([word] * n)


def _l(n: int) -> str:
    return f'<a href="/x">{_w(n)}</a>'


#: labelled pages: markup and one letter per block, m = main text, b = boilerplate
LABELLED = [
    (f"<body><nav><ul><li>{_l(1)}</li><li>{_l(2)}</li></ul></nav><article><h1>{_w(7)}</h1><p>{_w(60)}</p><p>{_w(3)}</p><p>{_w(1)}</p></article><footer>{_w(25)}</footer>", "bbmmmmb"),
    (f"<header>{_w(4)}</header><main><h1>{_w(1)}</h1><p>{_w(90)}</p><p>{_w(2)}{_l(5)}</p><div class='share'>{_w(9)}</div><p>{_w(12)}</p></main><aside>{_w(70)}</aside>", "bmmmbmb"),
    (f"<div class='ad'>{_w(14)}</div><article><p>{_w(5)}</p><aside>{_w(30)}</aside><p>{_w(200)}</p><section class='comments'><p>{_w(40)}</p><p>{_w(6)}</p></section></article>", "bmbmbb"),
    (f"<div><a href='/'>{_w(2)}</a></div><div><h1>{_w(6)}</h1><p>{_w(80)}</p><p>{_w(45)}</p><p>{_w(30)}</p></div><div>{_l(3)}</div><div>{_l(4)} {_l(2)}</div>", "bmmmmbb"),
    (f"<table><tr><td>{_l(1)}</td><td>{_l(1)}</td><td>{_l(2)}</td></tr></table><h2>{_w(8)}</h2><p>{_w(50)}</p><p>{_w(22)} {_l(3)}</p><div>{_w(3)}</div>", "bbbmmmb"),
    (f"<p>{_w(120)}</p><p>{_w(75)}</p>", "mm"),
    (f"<p>{_w(18)}</p>", "m"),
    (f"<div id='sidebar'><p>{_w(55)}</p><ul><li>{_l(3)}</li></ul></div><div><p>{_w(35)}</p><p>{_w(15)}</p><p>{_w(40)}</p></div><div class='cookie-notice'>{_w(33)}</div>", "bbmmmb"),
    (f"<form>{_w(11)}<select><option>{_w(2)}</option></select></form><article><h1>{_w(12)}</h1><ul><li>{_w(4)}</li><li>{_l(2)}</li><li>{_w(10)}</li></ul></article><div class='footer'>{_w(8)} {_l(2)}</div>", "bbmmmmb"),
    (f"<div>{_l(2)}</div><div>{_w(2)}</div><div>{_l(3)}</div><div>{_w(3)}</div><div>{_l(6)}</div>", "bbbbb"),
    (f"<article><p>{_l(12)}</p><p>{_w(1)}</p><h2>{_w(2)}</h2></article>", "mmm"),
    (f"<div>{_w(20)}</div><article><p>{_w(30)}</p><p>{_w(4)}</p></article><div>{_w(6)}</div><div>{_w(30)}</div>", "bmmbb"),
    (f"<h3>{_w(5)}</h3><main><p>{_l(2)}</p><p>{_w(26)}</p><p>{_l(9)} {_w(1)}</p></main><p>{_w(22)}</p>", "bmmmb"),
    # nothing is named here: what stands before and after decides
    (f"<div>{_l(1)}</div><div>{_l(2)}</div><div>{_w(6)}</div><div>{_w(48)}</div><div>{_w(4)}</div><div>{_w(66)}</div><div>{_w(9)}</div><div>{_w(37)}</div><div>{_l(3)}</div><div>{_w(5)}</div>", "bbmmmmmmbb"),
    (f"<div>{_l(2)}</div><div>{_w(3)}</div><div>{_l(4)}</div><div>{_w(9)}</div><div>{_w(33)}</div><div>{_w(2)}</div><div>{_w(54)}</div><div>{_l(2)}</div><div>{_w(14)}</div><div>{_l(1)}</div>", "bbbmmmmbbb"),
    (f"<p>{_w(5)}</p><p>{_w(95)}</p><p>{_w(7)}</p><p>{_w(41)}</p><p>{_l(5)}</p><p>{_w(19)}</p><p>{_l(2)}</p>", "mmmmbbb"),
    (f"<div>{_l(3)}</div><div>{_w(12)}</div><div>{_l(2)}</div><div>{_w(4)}</div><div>{_l(1)}</div><div>{_w(8)}</div><div>{_w(72)}</div><div>{_w(26)}</div>", "bbbbbmmm"),
    (f"<p>{_w(31)}</p><p>{_w(3)}</p><p>{_w(44)}</p><p>{_w(1)}</p><p>{_w(58)}</p><p>{_l(2)}</p><p>{_l(6)}</p><p>{_w(11)}</p>", "mmmmmbbb"),
    (f"<div>{_w(2)}</div><div>{_w(3)}</div><div>{_w(2)}</div><div>{_w(7)}</div><div>{_w(50)}</div><div>{_w(35)} {_l(6)}</div><div>{_w(3)}</div><div>{_w(2)}</div>", "bbbmmmbb"),
    (f"<div>{_l(4)}</div><div>{_w(10)}</div><div>{_w(28)}</div><div>{_w(11)} {_l(2)}</div><div>{_w(45)}</div><div>{_l(1)}</div><div>{_w(17)} {_l(3)}</div>", "bmmmmbb"),
]
for _n in (1, 2, 3, 5, 9, 16):
    for _m in (25, 45, 70):
        # an article among text and links that nothing names, with every kind of block in it
        LABELLED.append((f"<div>{_l(2)}</div><div>{_w(_m)}</div><article><h1>{_w(_n)}</h1><p>{_w(_m)}</p><p>{_w(_n)}</p><p>{_l(_n)}</p><p>{_w(_n)} {_l(_n)}</p><aside>{_w(_m)}</aside><p>{_w(_n)}</p></article><div>{_w(_n)}</div><div>{_w(_m)}</div><div>{_l(_n)}</div>", "bbmmmmmbmbbb"))
        LABELLED.append((f"<div class='ad'>{_w(_n)}</div><main><p>{_w(_m)}</p></main><div class='ad'>{_w(_m)}</div><div>{_w(_n)}</div>", "bmbb"))
        LABELLED.append((f"<article><p>{_l(_n)}</p><p>{_w(_m)}</p><p>{_l(_n)}</p></article>", "mmm"))
        LABELLED.append((f"<article><nav>{_l(_n)}</nav><p>{_w(_m)}</p><div class='share'>{_l(_n)}</div><p>{_l(_n)}</p></article>", "bmbm"))
        LABELLED.append((f"<nav>{_l(_n)}</nav><article><h1>{_w(_n)}</h1><p>{_w(_n)}</p><p>{_l(_n)}</p><p>{_w(_n)}</p><p>{_w(2)}</p><p>{_w(1)}</p></article><footer>{_w(_m)}</footer>", "bmmmmmmb"))
        LABELLED.append((f"<article><p>{_l(1)}</p><p>{_w(_n)}</p><p>{_w(_m)}</p><p>{_w(_n)}</p><p>{_l(_n)}</p><p>{_w(_n)} {_l(1)}</p></article><div>{_w(_n)}</div>", "mmmmmmb"))
        # the same without an element for the article
        LABELLED.append((f"<div>{_l(1)}</div><div>{_l(_n)}</div><div>{_w(_n)}</div><div>{_w(_m)}</div><div>{_w(_n)}</div><div>{_w(_m)}</div><div>{_l(_n)}</div><div>{_w(_n)}</div>", "bbmmmmbb"))
        LABELLED.append((f"<div class='sidebar'>{_w(_m)}</div><div>{_w(_m)}</div><div>{_w(_m + 8)}</div><div class='menu'>{_w(_n)}</div>", "bmmb"))
        LABELLED.append((f"<p>{_l(_n)}</p><p>{_w(_n)}</p><p>{_l(2)}</p><p>{_w(_m)}</p><p>{_w(_m + 3)}</p><p>{_l(_n)}</p>", "bbbmmb"))
        LABELLED.append((f"<h1>{_w(_n)}</h1><p>{_w(_m)}</p><p>{_w(_n)}</p><p>{_w(_m)}</p>", "mmmm"))
        LABELLED.append((f"<p>{_w(_m)}</p><p>{_w(_m)}</p><p>{_w(_n)}</p>", "mmm"))
# what a page without any name is made of belongs to the text inside an article, and not inside an element of boilerplate
for _page, _labels in [x for x in LABELLED if not re.search("<(article|main|nav|aside|form|header|footer)|class=|id=", x[0])]:
    LABELLED.append((f"<article>{_page}</article>", "m" * len(_labels)))
    LABELLED.append((f"<aside>{_page}</aside>", "b" * len(_labels)))
    LABELLED.append((f"<article><aside>{_page}</aside></article>", "b" * len(_labels)))


@dataclass
class Node:
    """Inner node: ``left`` if the feature is at most ``cut``; a leaf has ``main`` only."""

    main: float
    feature: int = -1
    cut: float = 0.0
    left: Node | None = None
    right: Node | None = None

    def share(self, x: list[float]) -> float:
        node = self
        while node.feature >= 0:
            node = node.left if x[node.feature] <= node.cut else node.right
        return node.main


def grow(x: list[list[float]], y: list[int], depth: int = 8, least: int = 1) -> Node:
    """Decision tree by Gini impurity; of equal cuts the first feature and the lowest cut win."""
    n, main = len(y), sum(y) / len(y)
    best = None
    if depth and 0 < main < 1:
        for f in range(len(x[0])):
            values = sorted({r[f] for r in x})
            for low, high in zip(values, values[1:], strict=False):
                cut = (low + high) / 2
                left = [k for r, k in zip(x, y, strict=True) if r[f] <= cut]
                a, b = len(left), n - len(left)
                if min(a, b) < least:
                    continue
                p, q = sum(left) / a, (sum(y) - sum(left)) / b
                impurity = (a * p * (1 - p) + b * q * (1 - q)) / n
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, f, cut)
    if best is None or best[0] >= main * (1 - main) - 1e-12:
        return Node(main)
    _, f, cut = best
    sides = [[(r, k) for r, k in zip(x, y, strict=True) if (r[f] <= cut) == side] for side in (True, False)]
    left, right = (grow([r for r, _ in s], [k for _, k in s], depth - 1, least) for s in sides)
    return Node(main, f, cut, left, right)


def train(labelled: list[tuple[str, str]] = LABELLED) -> Node:
    """Tree for the blocks of labelled pages."""
    x: list[list[float]] = []
    y: list[int] = []
    for page, labels in labelled:
        rows = features(blocks(page))
        if len(rows) != len(labels):
            raise ValueError(f"{len(rows)} blocks but {len(labels)} labels: {page[:80]}")
        x += rows
        y += [int(k == "m") for k in labels]
    return grow(x, y)


def main_text(page: str | None, tree: Node) -> str:
    """Main blocks of one page, joined by line breaks."""
    found = blocks(page)
    return "\n".join(b.text for b, x in zip(found, features(found), strict=True) if tree.share(x) > 0.5)


def extract(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None, tree: Node | None = None) -> DataFrame:
    """``keep`` columns of every row, ``text`` (main text, empty if none) and ``n_chars`` (its code points).

    Character references are decoded, white space inside a block becomes one space, blocks are joined in page order by one
    line break.  A null page is an empty one.  Repeated rows stay.  Other columns than ``keep`` are ignored.
    """
    keep = ["page_id", "url"] if keep is None else keep
    tree = tree or train()
    schema = [*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep), "text string"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in in_pieces(batches, 256):
            texts = [main_text(p, tree) for p in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [*keep, "text"])

    rows = pages.select(*keep, F.col(html_col).alias("__html")).mapInArrow(run, ", ".join(schema))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
