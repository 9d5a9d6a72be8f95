import html
import random
import re
import time

import pytest

from quarrylens.llm.extract import Page, extract, main_blocks, op11_extract

P = [
    "The first paragraph tells, at some length, what the article is about; it has commas, too.",
    "A second one follows. It is longer than the menus are, and it ends in a full stop.",
    "The third paragraph closes the piece, with a remark on what comes next: nothing at all.",
]
MENU = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("Home", "News", "Sport", "Culture", "About us"))


def ps(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


PAGES = {
    "article": f'<body><header><h1>The Daily</h1></header><nav><ul>{MENU}</ul></nav><article><h1>Title</h1>{ps(P)}</article><aside><p>{P[0]}</p></aside><footer><p>All rights reserved, 2024.</p></footer>',
    "classes": f'<body><div id="header">The Daily</div><ul class="menu">{MENU}</ul><div class="content"><h1>Title</h1>{ps(P)}</div><div class="sidebar"><p>{P[1]}</p></div><div class="comments"><h2>Comments</h2><p>I do not agree, not at all. {P[0]}</p></div><div id="footer">Imprint</div>',
    "no names": f"<body><div><ul>{MENU}</ul></div><div><h1>Title</h1>{ps(P)}</div><div><ul>{MENU}</ul></div><div>Imprint</div></body>",
    "table": f"<table><tr><td><a href=/>Home</a><br><a href=/a>About</a><td><h1>Title</h1>{ps(P)}</table>",
    "unclosed": f"<div class=nav><ul>{MENU}</ul></div><main><h1>Title<p><b>{P[0]}<br><p>{P[1]}<p>{P[2]}</main><div class='cookie-notice'>We use cookies. Accept them, please, all of them.</div>",
    "form": f'<main><h1>Title</h1>{ps(P[:2])}<form action="/s"><label>Your mail</label><input name=q><button>Subscribe now</button></form><div class="ad">Buy this. It is good, and cheap.</div>{ps(P[2:])}</main>',
    "whole form": f'<form id=aspnet><div class="topbar"><a href=/>x</a></div><div class=main><h1>Title</h1>{ps(P)}</div></form>',
    "scripts": f"<head><title>No</title><style>p{{}}</style></head><body class='has-sidebar no-ads'><script>if (a<b) document.write('<p>no</p>')</script><!-- <p>no</p> --><article><h1>Title</h1>{P[0] and ps(P)}<noscript>no</noscript><p hidden>no</p><p style='display: none'>no</p></article>",
    "comment articles": f'<main><article class="post"><h1>Title</h1>{ps(P)}</article><section id="comments"><article class="comment-body">{ps(P)}</article><article class="comment-body">{ps(P)}</article></section></main>',
    "comment heading": f"<body><div><h1>Title</h1>{ps(P)}<h3>3 Comments</h3><p>{P[0]} I agree.</p><p>{P[1]} Me too.</p></div></body>",
    "links below": f"<article><h1>Title</h1>{ps(P)}<h3>Related</h3><ul>{MENU}</ul></article>",
    "named region": f"<div class=top><a href=/>Home</a> <a href=/n>News</a></div><div class=main><h2>Title</h2>{ps(P)}</div><div class=right>Buy one, today, or two. Now.</div>",
    "wordpress": f'<body class="single ad-enabled"><div id="page"><header id="masthead"><h1>Blog</h1></header><div id="content"><div class="post-5 hentry"><div class="entry-header"><h1>Title</h1></div><div class="entry-content">{ps(P)}<div class="social-links">Share</div></div></div><div id="comments" class="comments-area"><ol class="comment-list"><li><p>{P[0]} {P[1]}</p></li></ol></div></div><div id="secondary" class="widget-area"><p>{P[2]}</p></div></div>',
    "roles": f'<div role="banner">The Daily</div><div role="navigation">{MENU}</div><div itemprop="articleBody"><h1>Title</h1>{ps(P)}</div><div role="contentinfo">Imprint</div>',
    "quotes": f"""<article data-x="a > b" title='it"s'><h1 title=it's>Title</h1>{ps(P)}<img alt="<p>no</p>"></article>""",
    "inline advert": f"<article><h1>Title</h1><p>{P[0][:20]}<span class='ad'>no</span>{P[0][20:]}</p>{ps(P[1:])}</article>",
}


@pytest.mark.parametrize("name", PAGES)
def test_templates(name):
    assert main_blocks(PAGES[name]) == ["Title", *P]


def test_blocks_and_references():
    page = "<article><h2>A&nbsp;B &amp; C&lt;d&gt; &#233; &#x4e2d; &copy &unknown; a < b</h2><p>one\n\t two<br>three</p>bare <i>text</i>\n<ul><li>x <b>y</b></li><li>z</ul><table><tr><td>1</td><td>2</td></tr></table><pre>a\n  b</pre><p> \xa0 </p></article>"
    assert main_blocks(page) == ["A B & C<d> é 中 © &unknown; a < b", "one two three", "bare text", "x y", "z", "1 2", "a b"]


def test_odd_pages():
    for page in (None, "", "   ", "<p", "<!--", "<!-- <p>a", "<script>", "</p></div>", "<article></article>", "<nav><p>Only a menu, nothing else.</p></nav>", "<![CDATA[x]]>", '<a b="', "<title>x</title>"):
        assert main_blocks(page) == [], page
    assert main_blocks("plain text only") == ["plain text only"]
    assert main_blocks("<p>a</b></i><b>c</p>d") == ["ac", "d"]
    for end in range(0, len(PAGES["quotes"]), 7):
        main_blocks(PAGES["quotes"][:end])


def test_time_is_linear():
    n = 60_000
    began = time.time()
    for page in ("<div>" * n, "<b>" * n + "</i>" * n, "<p>a" * n, "<" * n, "<!--" * n, '<a b="' * n, "<a b='\">" * n, "</x" * n, "<li>" * n, "<div>a<p><b>" * n, "&amp" * n, "<script>" * n, "<textarea></" * n):
        main_blocks(page)
    assert time.time() - began < 60


def test_deep_nesting_keeps_texts():
    assert main_blocks("<div>" * 3000 + "<p>" + P[0] + "</p>" + "</div>" * 3000) == [P[0]]
    assert len(Page("<div>" * 3000).tag) < 600


def test_query_matches_the_given_pages(spark, sf):
    """The given pages have one article of paragraphs each: cut out by a plain pattern."""
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: r for r in op11_extract(spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows:
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        want = [" ".join(html.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split("</?(?:p|h1)>", body)]
        text = "\n\n".join(w for w in want if w)
        assert (got[r.page_id].url, got[r.page_id].text, got[r.page_id].n_chars) == (r.url, text, len(text))


def test_random_layouts():
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9)))
    sentence = lambda k: " ".join(word() for _ in range(k)).capitalize() + "."
    hit = total = 0
    for _ in range(200):
        want = [" ".join(sentence(rnd.randint(5, 20)) for _ in range(rnd.randint(2, 5))) for _ in range(rnd.randint(3, 12))]
        side = "".join(f"<div><a href=/>{sentence(3)}</a></div>" for _ in range(rnd.randint(2, 9)))
        page = f"<html><body><div><div>{side}</div><div><h2>{word()}</h2>{ps(want)}</div><div>{sentence(4)}</div></div></body></html>"
        got = main_blocks(page)
        hit += got[1:] == want
        total += 1
    assert hit >= 0.97 * total


def test_tables_with_odd_rows(spark):
    rows = [(1, PAGES["article"], "x"), (1, PAGES["article"], "x"), (None, None, None), (2, "", "y"), (3, "<p>" + "word, " * 200_000 + "</p>", "z")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string").select("page_id", "html", "text")
    got = extract(df.withColumnRenamed("text", "url"), "page_id", "url").collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, len("\n\n".join(["Title", *P]))), (1, len("\n\n".join(["Title", *P]))), (2, 0), (3, 1_199_999)]
    assert extract(df.limit(0), "page_id").collect() == []
