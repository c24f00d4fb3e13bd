import itertools
import time

import numpy as np
import pytest

from strandloom.llm import html, layouts

BODY = """<h1>How rivers find the sea</h1><p>Rivers begin as small streams in the hills, and gather water on their way down.
</p><p>Some of them are long.</p><p>In flat country a river bends &amp; wanders, leaving lakes behind where it once ran, until it reaches the coast.</p>"""
TEXT = """How rivers find the sea
Rivers begin as small streams in the hills, and gather water on their way down.
Some of them are long.
In flat country a river bends & wanders, leaving lakes behind where it once ran, until it reaches the coast."""
MENU = "<ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/s>Sport</a></li></ul>"
SAID = "<div><b>Anna</b><p>I think this is a very good article indeed, thanks.</p></div><div><b>Ben</b><p>Not at all, I saw it otherwise last year.</p></div>"
HEAD = "<html><head><title>T</title><style>p{}</style></head><body>"
LAYOUTS = {
    "article": f"{HEAD}<nav>{MENU}</nav><article>{BODY}</article><footer>&copy; us</footer>",
    "main": f"{HEAD}<nav>{MENU}</nav><main>{BODY}</main><footer>&copy; us</footer>",
    "main and article": f"{HEAD}<main><article>{BODY}</article><aside>{MENU}</aside></main>",
    "content div": f'{HEAD}<div class="menu">{MENU}</div><div class="content">{BODY}</div><div class="footer">&copy; us</div>',
    "div without a name": f"{HEAD}<div>{MENU}</div><div>{BODY}</div><div>&copy; 2020 us</div>",
    "odd names": f'{HEAD}<div class="zz1">{MENU}</div><div class="zz2">{BODY}</div><div class="zz3">{MENU}</div>',
    "bare body": HEAD + BODY,
    "form around all": f'<form id="f">{HEAD}<nav>{MENU}</nav><article>{BODY}</article><footer>&copy; us</footer></form>',
    "form around body": f"{HEAD}<form><nav>{MENU}</nav><div class=content>{BODY}</div></form>",
    "no-sidebar": f'{HEAD}<div id="page" class="no-sidebar"><article>{BODY}</article></div>',
    "with-sidebar": f'{HEAD}<div class="content with-sidebar"><article>{BODY}</article><div class="sidebar">{MENU}</div></div>',
    "has-comments": f'{HEAD}<nav>{MENU}</nav><article class="post has-comments">{BODY}</article>',
    "article-header": f'{HEAD}<article>{BODY.replace("<h1>", "<div class=article-header><h1>").replace("</h1>", "</h1></div>")}</article>',
    "header in article": f"{HEAD}<header>Site name</header><article>{BODY.replace('<h1>', '<header><h1>').replace('</h1>', '</h1></header>')}</article>",
    "plain-div footer": f"{HEAD}<article>{BODY}</article><div>&copy; 2021 The Paper. All rights reserved.</div>",
    "plain-div footer of div": f"{HEAD}<div class=story>{BODY}</div><div>&copy; 2021 The Paper. All rights reserved.</div>",
    "comments after": f"{HEAD}<article>{BODY}</article><section id=comments><h3>Comments</h3>{SAID}</section>",
    "comments inside": f"{HEAD}<article>{BODY}<div class=comment-list>{SAID}</div></article>",
    "c-list": f'{HEAD}<article>{BODY}</article><div class="c-list"><h3>2 comments</h3>{SAID}</div>',
    "c-list inside": f'{HEAD}<article>{BODY}<div class="c-list"><h3>Comments (2)</h3>{SAID}</div></article>',
    "comments as articles": f"{HEAD}<article>{BODY}</article><div id=comments><article class=comment>{SAID}</article></div>",
    "cookie notice": f'{HEAD}<div class="cookie-notice">We use cookies to serve you better.</div><article>{BODY}</article>',
    "notice in a div": f"{HEAD}<div>We use cookies to serve you better.</div><article>{BODY}</article>",
    "ad inside": f'{HEAD}<article>{BODY.replace("<p>Some", "<div class=ad>Buy this thing now, it is cheap.</div><p>Some")}</article>',
    "ad before": f'{HEAD}<nav>{MENU}</nav><div class="ad">Buy this thing now, it is cheap.</div><article>{BODY}</article>',
    "aside inside": f"{HEAD}<article>{BODY}<aside><p>Read also how lakes come and go.</p></aside></article>",
    "share box": f'{HEAD}<article>{BODY}<div class="social-share">{MENU}</div></article>',
    "search form": f"{HEAD}<form>Search <input></form><article>{BODY}</article><form><p>Sign up for our letter.</p></form>",
    "scripts": f'{HEAD}<script>var t="</p><p>no</p>";</script><!-- <p>no</p> --><article>{BODY}<script>x()</script></article><noscript>no</noscript>',
    "hidden": f'{HEAD}<div hidden><p>Not seen by anyone, ever.</p></div><article>{BODY}<p style="display: none">No.</p></article>',
    "unclosed": f"{HEAD}<nav>{MENU}</nav><article>{BODY.replace('</p>', '')}</article><footer>us",
    "unclosed head": f"<head><title>T</title><nav>{MENU}</nav><article>{BODY}</article>",
    "hinted wrapper": f'{HEAD}<div class="sidebar-layout">{"<div class=inner>"}<article>{BODY}</article></div></div>',
    "upper case": f"{HEAD}<NAV>{MENU}</NAV><ARTICLE>{BODY.replace('<p>', '<P>')}</ARTICLE>",
    "table layout": f"{HEAD}<table><tr><td>{MENU}</td><td>{BODY}</td></tr></table>",
    "related teasers": f"{HEAD}<article>{BODY}</article><div class=related><article><h3><a href=/x>Why lakes vanish</a></h3></article></div>",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    assert html.main_text(LAYOUTS[name]) == TEXT


#: Names of containers that the pages of the fit don't have.
OTHER_NAMES = {
    "nav": ["site-links", "main-nav", "topmenu", "crumbs", "primary-navigation"], "header": ["page-head", "brand", "top", "siteheader"],
    "side": ["rail", "right-col", "more-stories", "also-read", "share-tools"], "ad": ["ad-slot", "dfp", "adsbox", "promotion", "sponsor-unit"],
    "notice": ["cookiebar", "gdpr-box", "modal", "signup-popup"], "footer": ["foot", "bottom", "colophon", "footer-wrap"],
    "comments": ["comment-thread", "replies", "disqus", "reader-comments"], "content": ["post-body", "text", "article-text", "blog-entry", "maincontent", "body-copy"],
}


@pytest.mark.parametrize("names", [{}, OTHER_NAMES])
def test_pages_that_were_not_fitted(monkeypatch, names):
    """At most 5 % of pages are wrong in any block, whether names are those of the fit or others."""
    html.fitted()
    monkeypatch.setattr(layouts, "NAMES", layouts.NAMES | names)
    wrong = 0
    for page, good in layouts.pages(300, seed=77):
        kept = set(html.main_text(page).split("\n"))
        wrong += any((text in kept) != (text in good) for text in html.blocks_of(page))
    assert wrong <= 15


@pytest.mark.parametrize("name", [
    "post-content social-share-enabled", "elementor-widget-text", "post-body tags-enabled", "search-result-body", "banner-story", "legal-article", "notice-text", "sidebar", "x9",
])
def test_prose_in_a_container_of_any_name(name):
    assert html.main_text(f'{HEAD}<nav>{MENU}</nav><div class="{name}">{BODY}</div><footer>&copy; us</footer>') == TEXT
    assert html.main_text(f'<div class="{name}">{BODY}</div>') == TEXT


def test_articles_side_by_side_and_formulas():
    two = f"{HEAD}<nav>{MENU}</nav><article>{BODY}</article><article>{BODY.replace('ivers', 'akes')}</article><footer>us</footer>"
    assert html.main_text(two) == TEXT + "\n" + TEXT.replace("ivers", "akes")
    sum_ = "<math><semantics><mrow><mi>a</mi><mo>+</mo><mi>b</mi></mrow><annotation encoding=x>a<p>+b</annotation></semantics></math>"
    page = f"{HEAD}<article>{BODY}<p>We know that {sum_} holds for all of them, as was said before.</p></article>"
    assert html.main_text(page) == TEXT + "\nWe know that a+b holds for all of them, as was said before."


UNITS = [
    "<", "<a ", "<a b='", '<a b="', "<!--", "<script>", "</", "<![", "<a b='\"", "<p class=", "&#", "&#9", "<title>", "<x y='z' ", "<annotation>", "<!", "<?", "<a\"'", '="<',
    "<div ", "</a ", "<div><p>", "<a>x</a>", "</script", "<style></styl", "<textarea>", "a<b ", "<!-->", "</p", "& ", "<li>", "<td class=ad>x",
]


@pytest.mark.parametrize("unit", UNITS)
def test_hostile_pages_take_time_in_proportion(unit):
    html.fitted()
    began = time.time()
    html.main_text(unit * ((1 << 20) // len(unit)))
    assert time.time() - began < 10


def test_tags_and_text_of_any_bytes():
    """Every letter outside of tags, comments and scripts comes out once, in order."""
    from strandloom.llm import markup

    assert list(markup.read("a < b<p id='1' x>c</p >&lt;<br/>")) == [
        ("text", "a "), ("text", "<"), ("text", " b"), ("start", "p", [("id", "1"), ("x", None)]), ("text", "c"), ("end", "p"), ("text", "<"), ("start", "br", []),
    ]
    assert list(markup.read("<a b='x<p>y")) == [("start", "a", [("b", "'x")]), ("start", "p", []), ("text", "y")]
    assert list(markup.read('<script>a</p></SCRIPT >b<!-- c --!>d<!---->e<![CDATA[f]]>g</>h<')) [1:] == [
        ("end", "script"), ("text", "b"), ("text", "d"), ("text", "e"), ("text", "g"), ("text", "h"), ("text", "<"),
    ]
    assert markup.decoded("&#" + "9" * 9000 + ";&amp;&#x41;&nbsp;") == "\ufffd&A\xa0"
    rng = np.random.default_rng(3)
    parts = ["<p>", "</p>", "word ", "< ", "<a href='x'>", "&amp;", "<b class=\"q\">", "<!-- n -->", "</b>", "\n"]
    for _ in range(500):
        chosen = rng.choice(parts, 30)
        text = "".join(x[1] for x in markup.read("".join(chosen)) if x[0] == "text")
        assert text == "".join({"&amp;": "&"}.get(c, c) for c in chosen if not c.startswith("<") or c == "< ")


def test_nothing_to_keep():
    assert html.main_text(None) == html.main_text("") == html.main_text(f"<nav>{MENU}</nav>") == html.main_text("<script>x</script>") == ""


def test_reading_goes_on_after_unknown_declarations():
    for odd in ("<![foo]>", "<![ x]>", "array<![0']>", "<![>", "<![if !IE]>", "<![endif]>", "<!x>"):
        assert html.blocks_of(f"<p>one</p>{odd}<p>two</p>")[-1] == "two"
    rng = np.random.default_rng(9)
    parts = ["<![", "<!", "[", "]", "]]>", ">", "<", "</", "<?", "--", "<!--", "cdata[", "if", " ", "x", "&#", "&#x110000;", "&", "<p>", "<a href='", "=", "\"", "\0"]
    for _ in range(2000):
        html.main_text("".join(rng.choice(parts, 12)))


def test_long_pages_take_time_in_proportion():
    html.fitted()
    began = time.time()
    many = HEAD + f"<article>{'<p>This is a paragraph of some words, as many are.</p>' * 16_000}</article>"
    assert html.main_text(many).count("\n") == 15_999
    html.main_text("<div>" * 100_000 + "x")
    html.main_text("<x>" * 30_000 + "<p>a</p></b>" * 30_000)
    assert time.time() - began < 40


def test_minimum_cut_is_minimal():
    rng = np.random.default_rng(5)
    for trial in range(300):
        n = 7
        unary = (rng.normal(size=n) * rng.choice([0.3, 1.0])).tolist()
        edges = [(int(a), int(b), float(abs(rng.normal()))) for a, b in rng.integers(0, n, (trial % 16, 2)) if a != b]
        cost = lambda keep: sum(max(u, 0) if not k else max(-u, 0) for u, k in zip(unary, keep)) + sum(c for a, b, c in edges if keep[a] != keep[b])
        best = min(cost(keep) for keep in itertools.product([False, True], repeat=n))
        assert cost(html.minimum_cut(unary, edges)) == pytest.approx(best)


def test_extraction_of_odd_rows(spark):
    page = LAYOUTS["article"]
    rows = [(1, None, page, "clash", 7), (1, None, page, "clash", 7), (2, "u", None, None, None), (None, "u", "", None, None), (3, "u", page * 40, "", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, Score int")
    got = html.extract(df).collect()
    assert [(r.page_id, r.n_chars, r.Score) for r in got[:4]] == [(1, len(TEXT), 7), (1, len(TEXT), 7), (2, 0, None), (None, 0, None)]
    assert got[0].text == TEXT and len(got) == 5
    assert html.extract(df.limit(0)).collect() == []
