"""WARC, main text, URL filter."""

import random
import re

import numpy as np
import pytest

from gapwise.llm import html_text, url_filter, warc

from llm_brute import payload

PAGES = "page_id long, url string, html string, digest string, file string, at int"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "d", "f", 1) for r in rows], PAGES)


# ------------------------------------------------------------------ WARC

FAKE = warc.VERSION + "WARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
ROWS = [
    (1, "u", "a"), (2, "u", "a"), (2, "v", "a"), (3, None, None), (None, "x", ""), (5, "u", FAKE + FAKE), (6, "é\r\nX: y", "é" * 50_000 + warc.VERSION),
    (7, "u", "\r\n\r\n"), (8, "u", warc.VERSION), (9, "u", "x" * 300_000), (10, "u", "WARC/1.1"), (11, "u", warc.VERSION + "Content-Length: 9" + "9" * 17 + "\r\n\r\n"),
]


@pytest.mark.parametrize("split", ["128m", "10k"])
def test_round_trip(spark, split):
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    got = warc.round_trip(pages_of(spark, ROWS)).collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got), key=str) == sorted(((p, *payload(h)) for p, _, h in ROWS), key=str)
    kinds = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in got if r["page_id"] in (None, 1, 2, 3)), key=str)
    assert kinds == sorted([(1, "revisit", 2), (2, "response", None), (2, "revisit", 2), (3, "response", None), (None, "revisit", 3)], key=str)
    assert all(r["record_type"] == "response" for r in got if r["page_id"] and r["page_id"] > 3)


def test_payloads_come_back_whole(spark, tmp_path):
    warc.write_archives(pages_of(spark, ROWS), str(tmp_path / "w"))
    got = [r["payload"] for r in warc.read_archives(spark, str(tmp_path / "w")).where("header LIKE '%WARC-Type: response%'").collect()]
    assert sorted(got) == sorted({h or "" for _, _, h in ROWS})


def test_smaller_payloads_are_all_responses(spark):
    got = warc.round_trip(pages_of(spark, ROWS), min_bytes=2).where("page_id < 3").collect()
    assert {r["record_type"] for r in got} == {"response"}


def test_broken_archive(spark, tmp_path):
    """What is behind a record that is cut off is not believed."""
    warc.write_archives(pages_of(spark, [(1, "u", "abc")]).coalesce(1), str(tmp_path / "w"))
    (part,) = [p for p in (tmp_path / "w").iterdir() if p.name.startswith("part") and p.stat().st_size]
    data = part.read_bytes()
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "one.txt").write_bytes(data + data.replace(b"Content-Length: 3", b"Content-Length: 900") + data)
    assert warc.read_archives(spark, str(tmp_path / "x")).count() == 1


def test_no_pages(spark):
    assert warc.round_trip(pages_of(spark, [])).count() == 0


@pytest.mark.parametrize("unit", [1, 7, 30, 500, warc.UNIT])
def test_chains(spark, unit):
    """Only what successors reach from the start of a file counts."""
    links = [("f", i * 10, i * 10 + 10) for i in range(100)] + [("f", 55, 60), ("f", 57, 58), ("g", 5, 9), ("h", 0, 7)]
    got = {(r["file"], r["at"]) for r in warc.reachable(spark.createDataFrame(links, "file string, at long, next long"), unit).collect()}
    assert got == {("f", i * 10) for i in range(100)} | {("h", 0)}


# ------------------------------------------------------------------ main text


def plain_article(page):
    """Blocks of the article of the sample tables, whose pages have one article element and no lists in it."""
    import html

    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", body))
    return "\n".join(p for p in parts if p)


def test_articles_of_a_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    got = html_text.extract(pages).collect()
    assert {r["page_id"]: r["text"] for r in got} == {k: plain_article(v) for k, v in html.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_broken_pages(spark):
    text = " ".join(["word"] * 30)
    pages = [
        (1, "u", None), (2, "u", ""), (3, "u", "<p"), (4, "u", "<script>var x"), (5, "u", "<!-- <p>x"), (6, "u", f"<article><p>{text} &lt;b&gt; 1 < 2 &amp"),
        (6, "u", f"<article><p>{text} &lt;b&gt; 1 < 2 &amp"), (7, "u", f'<p class="a>b">{text}'), (8, "u", f"<article><p>{text}</p></article>" * 2000), (None, None, "<nav>x</nav>"),
        (9, "u", f"<article><p>a</p><aside><p>{text}</p></aside><form>{text}</form><div class='comments'><p>{text}</p></div><p>b\n \tc</p></article>"),
    ]
    got = [(r["page_id"], r["text"]) for r in html_text.extract(pages_of(spark, pages)).collect()]
    want = [(i, "") for i in (1, 2, 3, 4, 5, None)] + [(6, f"{text} <b> 1 < 2 &")] * 2 + [(7, text), (8, "\n".join([text] * 2000)), (9, "a\nb c")]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert html_text.extract(pages_of(spark, [])).count() == 0


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p title=don't>First paragraph.</p><p>It's the second.</p>", ["First paragraph.", "It's the second."]),
        ("<p don't>One.</p><p>It's two.</p>", ["One.", "It's two."]),
        ('<p title="a"b">One "two".</p><p>Three"</p>', ['One "two".', 'Three"']),
        ('<p title = "a>b" lang=en/>One.<p>Two.', ["One.", "Two."]),
        ('<p title="a>One.</p><p>Two.</p>', ["One.", "Two."]),
        ('<p>One.</p><p title="a>Two.</p><p>Three "four"', ["One.", "Two.", 'Three "four"']),
        ('<p =">One.</p><p>"Two".</p>', ["One.", '"Two".']),
    ],
)
def test_stray_quotes(page, want):
    assert [b.text for b in html_text.blocks(page)] == want


def test_cut_off_tags():
    for end in ("x" * 1000, "a=" * 500, "a='" * 500, 'a="b" ' * 200, '"' * 1000, " " * 1000, "/" * 1000, "='" * 999):
        assert [b.text for b in html_text.blocks(f"<p>One.</p><div {end}")] == ["One."]
    # every tag is open up to the end of the page
    assert len(html_text.blocks("""<p a=" <q b=' > ' " """ * 50_000)) < 100_000


def test_tree_fits_its_table():
    tree = html_text.train()
    for page, labels in html_text.LABELLED:
        found = html_text.blocks(page)
        assert "".join("m" if tree.share(x) > 0.5 else "b" for x in html_text.features(found)) == labels


def w(n):
    return " ".join(["text"] * n)


def link(n):
    return f"<a href='x'>{w(n)}</a>"


def kept(page):
    tree, found = html_text.train(), html_text.blocks(page)
    return "".join("m" if tree.share(x) > 0.5 else "b" for x in html_text.features(found))


def test_tree_asks_the_neighbours():
    def asked(node):
        return set() if node.feature < 0 else {html_text.FEATURES[node.feature]} | asked(node.left) | asked(node.right)

    def leaves(node, known):
        if node.feature < 0:
            return [node.main]
        x = known.get(html_text.FEATURES[node.feature])
        return [m for side, at in ((node.left, x is None or x <= node.cut), (node.right, x is None or x > node.cut)) if at for m in leaves(side, known)]

    # whatever the lengths are, text of an article stays and named boilerplate goes
    tree = html_text.train()
    assert min(leaves(tree, {"article": 1, "boiler": 0})) > 0.5
    assert max(leaves(tree, {"boiler": 1})) <= 0.5
    assert len(asked(tree) & {"words_before", "links_before", "words_after", "links_after"}) >= 2


@pytest.mark.parametrize(
    "page, want",
    [
        # pages that name nothing, none of them in the table of the tree
        (f"<div>{link(2)}</div><div>{link(3)}</div><div>{w(8)}</div><div>{w(70)}</div><div>{w(3)}</div><div>{w(52)}</div><div>{link(2)}</div><div>{w(13)}</div>", "bbmmmmbb"),
        (f"<p>{link(1)}</p><p>{w(4)}</p><p>{link(2)}</p><p>{w(7)}</p><p>{w(100)}</p><p>{w(5)}</p><p>{w(39)}</p><p>{link(4)}</p>", "bbbmmmmb"),
        # names of the article or of what surrounds it are no reason to lose it
        (f"<nav>{link(3)}</nav><article class='post form-post'><p>{w(50)}</p><p>{w(2)}</p></article><div class='ad'>{w(30)}</div>", "bmmb"),
        (f"<div class='search header-layout'><article class=social><p>{w(50)}</p></article><div class='comments'><article class='comment'><p>{w(30)}</p></article></div></div>", "mb"),
        (f"<body class='no-sidebar'><div class='has-sidebar'><div class='related-form'><p>{w(80)}</p><p>{w(20)}</p></div></div><div class='sidebar'><p>{w(30)}</p></div>", "mmb"),
        (f"<form><main class='search'><p>{w(40)}</p><form>{w(30)}</form></main></form><footer>{w(60)}</footer>", "mbb"),
        # most of the text are comments
        (f"<article><p>{w(40)}</p></article><section id='comments'><article class='comment'><p>{w(60)}</p></article><article class='comment'><p>{w(50)}</p></article></section>", "mbb"),
        # a short teaser is not the article
        (f"<article><p>{w(4)}</p></article><div><h1>{w(6)}</h1><p>{w(90)}</p><p>{w(60)}</p></div>", "mmmm"),
    ],
)
def test_places(page, want):
    assert kept(page) == want


def test_inline_adverts():
    page = f"<article><p>{w(20)} <span class='ad'>buy <span>now</span> <b>here</b></span>and <em class='ads-box'>x</em>on.</p><p>One <span class=sponsored>two<p>Three.</article>"
    tree = html_text.train()
    assert html_text.main_text(page, tree) == f"{w(20)} and on.\nOne"
    assert html_text.main_text(f"<article><p>A <img class='ad'>b <i class='shadow'>c</i></p><p>d</article>", tree) == "A b c\nd"


def test_unmatched_end_tags_take_linear_time():
    import time

    start = time.time()
    found = html_text.blocks("<div>" * 100_000 + "x" + "</section>" * 100_000 + "y" + "</div>" * 100_000 + "z")
    assert [b.text for b in found] == ["x", "y", "z"]
    assert time.time() - start < 5


# ------------------------------------------------------------------ URL filter


def test_rules(spark):
    urls = [None, "", "nope", "HTTP://É.NET?x", "a://b.net/://c", "://", "x://ORG/fr/", "x://xorg/fr/", "http://a.example.net/en/1", "http://a.example.net/en", "http://example.com/de/?q", "http://m.ads-x.com#f"]
    got = {r["page_id"]: r for r in url_filter.judge(pages_of(spark, [(i, u, None) for i, u in enumerate(urls)])).collect()}
    assert [got[i]["rule"] for i in range(len(urls))] == [None, None, None, None, "net/", None, "org/fr/", None, "example.net/en/", "net/", "example.com/de/", None]
    assert [got[i]["verdict"] for i in range(len(urls))] == ["allow"] * 4 + ["block", "allow", "allow", "allow", "allow", "block", "block", "block"]
    assert (got[4]["host"], got[4]["path"], got[3]["host"], got[0]["host"]) == ("b.net", "/://c", "É.net", "")
    assert url_filter.judge(pages_of(spark, [])).count() == 0


def test_cascade_is_exact(spark):
    """Every key of the universe is judged right, whatever the filters' false positives."""
    rng = random.Random(2)
    keys = [f"h{i}.example" for i in range(20_000)]
    listed = set(rng.sample(keys, 700)) | {"outside.example"}
    universe = spark.createDataFrame([(k,) for k in keys + keys[:50]], "key string")
    cascade = url_filter.build(universe, spark.createDataFrame([(k,) for k in listed], "key string"))
    assert len(cascade.levels) > 2
    rows = universe.distinct().select("key", *url_filter._hashed(url_filter.F.col("key"))).collect()
    a, b = (np.array([r[c] for r in rows], np.int64).view(np.uint64) for c in ("a", "b"))
    assert {r["key"] for r, on in zip(rows, cascade.listed(a, b), strict=True) if on} == listed & set(keys)


def test_list_beyond_the_bound_is_joined(spark, monkeypatch):
    pages = pages_of(spark, [(1, "http://m.spam-x.com/", None), (2, "http://ok.com/", None), (None, None, None)])
    monkeypatch.setattr(url_filter, "MOST_BYTES", 0)
    assert sorted(((r["page_id"], r["verdict"]) for r in url_filter.judge(pages).collect()), key=str) == [(1, "block"), (2, "allow"), (None, "allow")]
