"""HTML extraction by minimum-cut labelling of blocks."""

from __future__ import annotations

import math
import re
from collections import defaultdict, deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandloom.llm import markup
from strandloom.llm.common import pieces, table

# Tags of HTML.
SILENT = {
    "script", "style", "noscript", "template", "head", "title", "svg", "iframe", "object", "canvas", "audio", "video", "select",
    "textarea", "button", "dialog", "xmp", "noembed", "noframes", "annotation", "annotation-xml",
}
HEAD_TAGS = {"html", "head", "title", "style", "script", "noscript", "template", "meta", "link", "base"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img",
    "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
    "time", "tt", "u", "var", "wbr",
    "math", "semantics", "mrow", "mi", "mn", "mo", "ms", "mtext", "mspace", "mfrac", "msqrt", "mroot", "mstyle", "merror", "mpadded", "mphantom",
    "menclose", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mmultiscripts", "mtable", "mtr", "mtd",
}
#: What is left out without an end to the text around it.
INLINE_SILENT = {"annotation", "annotation-xml"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: What ends an open element of a kind when one more begins, and where the search for it stops.
IMPLIED = {
    "p": ("div", "article", "section", "main", "body", "li", "td", "th", "aside", "nav", "footer", "header", "blockquote", "form"),
    "li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead"),
    "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",),
}
# Containers, and words of class, id or role, that are features for or against content.
AGAINST_TAGS = {"nav", "footer", "aside", "menu"}
MAIN_TAGS = {"article", "main"}
AGAINST_WORDS = {
    "ad", "ads", "adv", "advert", "advertisement", "advertising", "banner", "promo", "promoted", "sponsor", "sponsored",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "topbar", "sidebar", "aside", "widget",
    "widgets", "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "overlay", "newsletter", "subscribe",
    "subscription", "signup", "login", "search", "share", "sharing", "social", "related", "recommended", "recommendations",
    "pagination", "pager", "tags", "toc", "complementary", "contentinfo", "dialog", "skip", "copyright", "legal",
    "disclaimer", "teaser", "teasers", "outbrain", "taboola", "dfp", "gpt", "adbox", "adslot", "adsense", "adunit", "banners", "billboard", "skyscraper",
    "crumb", "crumbs", "topnav", "subnav", "mainnav", "topmenu", "submenu", "hamburger", "links", "rail", "column", "colophon", "foot", "bottom", "bottombar",
    "masthead", "toolbar", "tools", "cookiebar", "privacy", "alert", "toast", "paywall", "login", "register", "follow", "followers", "sharebar", "sharethis",
    "addthis", "facebook", "twitter", "pinterest", "also", "more", "next", "previous", "prev", "trending", "popular", "latest", "jump", "skiplink",
}
#: The same where a word only begins like this.
AGAINST_STARTS = ("advert", "sponsor", "promo", "cookie", "newsletter", "subscri", "navig", "breadcrumb", "sidebar", "recommend", "relat", "footer", "menu", "adsbox", "popup", "copyright")
TOP_WORDS = {"header", "head", "masthead", "siteheader", "brand", "branding", "logo", "top"}
COMMENT_WORDS = {"comment", "comments", "commentlist", "respond", "reply", "replies", "disqus", "discussion", "thread", "kommentare", "comentarios", "commentaires"}
FOR_WORDS = {"article", "content", "post", "entry", "story", "main", "body", "articlebody", "maincontent", "text", "copy", "prose", "paragraph"}
#: A class that only tells what else there is: has-comments, no-sidebar.
TELLING = {"has", "no", "with", "without", "not", "is", "hide", "show", "enabled", "disabled", "active", "on", "off"}
SAYS_NOTICE = re.compile(
    r"©|\(c\)\s|all rights reserved|cookies|advertisement|\bsponsored\b|alle rechte vorbehalten|tous droits réservés|todos los derechos", re.I
)
SAYS_COMMENTS = re.compile(r"\W*(\d+\s+)?(reader |leave a |post a )?(comments?|replies|responses|kommentare|comentarios|commentaires)\b.{0,20}", re.I | re.S)
#: Smoothness: cost of a boundary between blocks that follow each other, and between the next blocks of one parent.
NEXT, SIBLING = 0.3, 0.7


def _hints(attrs) -> tuple[bool, bool, bool]:
    """Whether class, id or role speak against content, of comments, and for content.

    The last word of a name that is a container's says what it is, the others what kind:
    notice-text is a text, article-footer a footer. A name that only tells what else there is says nothing.
    """
    against = comment = good = False
    for key, value in attrs:
        if not value or key not in ("class", "id", "role"):
            continue
        for token in value.split():
            words = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+|[^\W\d_a-zA-Z]+", token)]
            if not words or not TELLING.isdisjoint(words):
                continue
            last = words[-1]
            if not COMMENT_WORDS.isdisjoint(words):
                comment = True
            elif last in FOR_WORDS:
                good = True
            elif not AGAINST_WORDS.isdisjoint(words) or any(w.startswith(AGAINST_STARTS) for w in words):
                against = True
            elif not FOR_WORDS.isdisjoint(words):
                good = True
            elif not TOP_WORDS.isdisjoint(words):
                against = True
    return against and not good, comment, good


class _Page:
    """Elements that are not inline, and blocks of text in page order.

    Each open element and each open place by tag is on a stack, so that a tag costs the
    same however deep it stands.
    """

    def __init__(self):
        self.tag, self.parent, self.hint, self.silent = [""], [0], [(False, False, False)], [False]
        self.stack = [0]
        self.at: dict[str, list[int]] = defaultdict(list)  # depths of the open elements of a tag
        self.blocks: list[tuple[str, int, int]] = []  # text, element, letters in links
        self.text: list[str] = []
        self.linked = 0
        self.link = 0  # depth at which a link was opened, or 0
        self.inner = -1
        self.mute = ""  # the tag of INLINE_SILENT that is open

    def feed(self, text: str):
        for kind, *what in markup.read(text):
            if kind == "text":
                if not self.mute:
                    self.handle_data(*what)
            elif kind == "end" and what[0] == self.mute:
                self.mute = ""
            elif kind == "start" and what[0] in INLINE_SILENT:
                self.mute = what[0]
            elif kind == "start":
                self.mute = ""
                self.handle_starttag(*what)
            else:
                self.handle_endtag(*what)

    def flush(self):
        if self.inner >= 0:
            text = " ".join("".join(self.text).split())
            if text:
                self.blocks.append((text, self.inner, self.linked))
        self.text, self.linked, self.inner = [], 0, -1

    def _close(self, depth: int):
        while len(self.stack) > depth:
            self.at[self.tag[self.stack.pop()]].pop()
        if self.link > depth:
            self.link = 0

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text.append(" ")
        elif tag in VOID:
            if tag not in INLINE:
                self.flush()
        elif tag in INLINE:
            if tag == "a":
                self.link = len(self.stack)
        else:
            self.flush()
            if tag not in HEAD_TAGS and self.at["head"]:  # a head that was not closed ends here
                self._close(self.at["head"][-1])
            if tag in IMPLIED and self.at[tag]:
                stop = max((self.at[s][-1] for s in IMPLIED[tag] if self.at[s]), default=0)
                if self.at[tag][-1] > stop:
                    self._close(self.at[tag][-1])
            above = self.stack[-1]
            hidden = any(
                k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and re.search(r"display\s*:\s*none", v) for k, v in attrs
            )
            self.at[tag].append(len(self.stack))
            self.stack.append(len(self.tag))
            self.tag.append(tag)
            self.parent.append(above)
            self.hint.append(_hints(attrs) if attrs and tag not in ("html", "body") else (False, False, False))
            self.silent.append(self.silent[above] or hidden or tag in SILENT)

    def handle_endtag(self, tag):
        if tag == "a":
            self.link = 0
        elif tag not in VOID and tag not in INLINE:
            self.flush()
            stop = max((self.at[s][-1] for s in IMPLIED.get(tag, ()) if self.at[s]), default=0)
            if self.at[tag] and self.at[tag][-1] > stop:
                self._close(self.at[tag][-1])

    def handle_data(self, data):
        top = self.stack[-1]
        if self.silent[top]:
            return
        if self.inner < 0 and not data.isspace():
            self.inner = top
        self.text.append(data)
        if self.link:
            self.linked += len(data.strip())


def read(html: str) -> _Page:
    page = _Page()
    page.feed(html)
    page.flush()
    return page


def blocks_of(html: str) -> list[str]:
    return [text for text, *_ in read(html).blocks]


#: How much the prose of an element counts that its name or tag speaks against.
NAMED, TAGGED = 0.35, 0.1


def _bodies(page: _Page, plain: np.ndarray, linked: np.ndarray) -> list[int]:
    """The elements that hold the article, as far as can be told, the fullest first.

    That is the element, article or main before others, under which most prose stands; names
    weigh, but don't decide, so prose in a container of any name is found. Articles beside it that
    have a good part of text of their own belong to it.
    """
    n = len(page.tag)
    prose, weight, talk = np.zeros(n), np.ones(n), [False] * n
    for e in range(1, n):
        above = page.parent[e]
        against, comment, good = page.hint[e]
        own = TAGGED if page.tag[e] in AGAINST_TAGS or comment else NAMED if against else 1.0
        weight[e] = min(weight[above], own)
        talk[e] = talk[above] or comment or page.tag[e] in AGAINST_TAGS
    for text, e, link in page.blocks:
        holder = page.parent[e] if page.tag[e] in ("p", "blockquote", "pre", "li", "ul", "ol", "td", *HEADINGS) else e
        if link * 3 < len(text):
            words = text.count(" ") + 1
            prose[holder] += (len(text) - link) * (1.0 if words >= 10 or text[-1] in ".!?…" else 0.5)
    inner = prose.copy()
    for e in range(n - 1, 0, -1):
        inner[page.parent[e]] += inner[e]
    good = [e for e, t in enumerate(page.tag) if t in MAIN_TAGS and plain[e] > 0 and not talk[e]]
    good = [e for e in good if inner[e] * weight[e] * 4 >= (prose * weight).max()]
    articles = [e for e in good if page.tag[e] == "article"]
    if good:
        body = max(articles or good, key=lambda e: (inner[e] * weight[e], -e))
    else:
        body = max((e for e in range(n) if page.tag[e] not in ("p", "li", "ul", "ol", *HEADINGS)), key=lambda e: (prose[e] * weight[e], -e))
    beside = [
        e for e in range(1, n)
        if e != body and page.tag[e] == page.tag[body] == "article" and page.parent[e] == page.parent[body] and not talk[e]
        and not page.hint[e][0] and linked[e] < plain[e] and plain[e] * 5 >= plain[body]
    ]
    return [body, *beside]


FEATURES = (
    "bias", "in boilerplate tag", "in header", "word against", "comments", "in form", "in body", "word for", "link share",
    "words", "few words", "ends a sentence", "heading", "first heading", "paragraph", "item", "notice", "link share of parent",
    "share of text of parent", "body is marked and elsewhere", "after the body", "long", "boilerplate tag in body", "word against in body", "cell in body",
)


def features(page: _Page) -> np.ndarray:
    """One row of ``FEATURES`` for each block."""
    n = len(page.tag)
    plain, linked = np.zeros(n), np.zeros(n)
    for text, e, link in page.blocks:
        plain[e] += max(0, len(text) - link)
        linked[e] += link
    for e in range(n - 1, 0, -1):
        plain[page.parent[e]] += plain[e]
        linked[page.parent[e]] += linked[e]
    bodies = _bodies(page, plain, linked)
    body = bodies[0]
    around, e = set(bodies), body
    while e:
        around.add(e)
        e = page.parent[e]
    marked = page.tag[body] in MAIN_TAGS
    bodies = set(bodies)
    flags = np.zeros((n, 7))  # boilerplate tag, header, against, comment, form, body, for
    for e in range(1, n):
        tag, (against, comment, good) = page.tag[e], page.hint[e]
        own = np.array([tag in AGAINST_TAGS, tag == "header", against, comment, tag == "form", e in bodies, good or tag in MAIN_TAGS], float)
        if e in around:  # what holds the article is no boilerplate, whatever its name
            own[:5] = 0
        elif tag == "header" and flags[page.parent[e], 5]:
            own[1] = 0
        flags[e] = np.maximum(flags[page.parent[e]], own)
    rows = np.zeros((len(page.blocks), len(FEATURES)))
    total, seen, after, commented = plain[0] + 1, False, False, -1
    for k, (text, e, link) in enumerate(page.blocks):
        words, tag = text.count(" ") + 1, page.tag[e]
        above = page.parent[e] if tag in ("p", "li", "td", *HEADINGS) else e
        heading = tag in HEADINGS
        inside = flags[e, 5] > 0
        after = after or (seen and not inside)
        seen = seen or inside
        if (heading or words <= 4) and seen and SAYS_COMMENTS.fullmatch(text):
            commented = k
        share = min(1.0, link / max(len(text), 1))
        rows[k] = (
            1, flags[e, 0], flags[e, 1], flags[e, 2], max(flags[e, 3], float(commented >= 0)), flags[e, 4], inside, flags[e, 6], share,
            min(math.log1p(words), 5) / 5, words < 4, text[-1] in ".!?…:;\"”»)", heading, tag == "h1", tag in ("p", "blockquote", "pre"), tag == "li",
            min(1.0, 30 / words) if SAYS_NOTICE.search(text) else 0.0, linked[above] / (plain[above] + linked[above] + 1), plain[above] / total,
            marked and not inside, after and not inside, words >= 25, inside and flags[e, 0], inside and flags[e, 2], inside and tag in ("td", "th", "dt", "dd"),
        )
    return rows


@lru_cache(maxsize=1)
def fitted() -> np.ndarray:
    """Weights of the classifier: logistic regression on labelled pages of many layouts, ``layouts.pages``."""
    from strandloom.llm.layouts import pages

    rows, labels = [], []
    for html, content in pages():
        page = read(html)
        rows.append(features(page))
        labels += [text in content for text, *_ in page.blocks]
    x, y = np.concatenate(rows), np.array(labels, float)
    w = np.zeros(x.shape[1])
    keep = np.ones(len(w))
    keep[0] = 0.01  # the bias is hardly held back
    for _ in range(12):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - keep * w
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), slope)
    return w


def minimum_cut(unary: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source: the labelling that costs least.

    unary: above 0 a capacity from the source, below 0 one to the sink. A node whose
    own capacity is no less than all its edges' keeps its side, and its edges become capacities of
    their other ends; flow through the rest is pushed by levels (Dinic).
    """
    n, own = len(unary), list(unary)
    near: list[dict[int, float]] = [{} for _ in unary]
    for u, v, c in edges:
        near[u][v] = near[u].get(v, 0.0) + c
        near[v][u] = near[v].get(u, 0.0) + c
    side: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        u = queue.popleft()
        if side[u] is None and abs(own[u]) >= sum(near[u].values()):
            side[u] = own[u] > 0
            for v, c in near[u].items():
                own[v] += c if side[u] else -c
                del near[v][u]
                queue.append(v)
            near[u] = {}
    for u in range(n):
        if side[u] is None:
            group, queue = [], deque([u])
            side[u] = False
            while queue:
                group.append(queue.popleft())
                for v in near[group[-1]]:
                    if side[v] is None:
                        side[v] = False
                        queue.append(v)
            for v in _source_side(group, own, near):
                side[v] = True
    return side


def _source_side(group: list[int], own: list[float], near: list[dict[int, float]]) -> set[int]:
    """Nodes of a connected group that stay with the source after as much flow as can be."""
    tiny = 1e-9
    excess = {u: own[u] for u in group}
    while True:
        level = {u: 0 for u in group if excess[u] > tiny}
        queue, ends = deque(level), False
        while queue:
            u = queue.popleft()
            for v, c in near[u].items():
                if c > tiny and v not in level:
                    level[v] = level[u] + 1
                    ends = ends or excess[v] < -tiny
                    queue.append(v)
        if not ends:
            return set(level)
        arcs = {u: list(near[u]) for u in level}
        for s in [u for u in level if level[u] == 0]:
            while excess[s] > tiny:
                path = [s]
                while path and excess[path[-1]] > -tiny:
                    u = path[-1]
                    while arcs[u] and not (near[u].get(arcs[u][-1], 0) > tiny and level.get(arcs[u][-1]) == level[u] + 1):
                        arcs[u].pop()
                    if arcs[u]:
                        path.append(arcs[u][-1])
                    else:
                        path.pop()
                        if path:
                            arcs[path[-1]].pop()
                if not path:
                    break
                flow = min(excess[s], -excess[path[-1]], *(near[a][b] for a, b in zip(path, path[1:])))
                for a, b in zip(path, path[1:]):
                    near[a][b] -= flow
                    near[b][a] = near[b].get(a, 0.0) + flow
                excess[s] -= flow
                excess[path[-1]] += flow


def _prose(page: _Page, rows: np.ndarray) -> np.ndarray:
    """Blocks that are prose beyond doubt: sentences of ten words or more, hardly linked, in no menu, footer, notice or comment."""
    long = np.array([text.count(" ") >= 9 and text[-1] in ".!?…\"”»" for text, *_ in page.blocks])
    column = lambda name: rows[:, FEATURES.index(name)]
    return long & (column("link share") < 0.3) & (column("in boilerplate tag") == 0) & (column("comments") == 0) & (column("notice") == 0)


def main_text(html: str | None, weights: np.ndarray | None = None) -> str:
    """The blocks on the source's side of the cut, in page order, one to a line."""
    page = read(html) if html else None
    if not page or not page.blocks:
        return ""
    edges, last = [], {}
    for k, (_, e, _) in enumerate(page.blocks):
        if k:
            edges.append((k - 1, k, NEXT))
        above = page.parent[e]
        if above in last:
            edges.append((last[above], k, SIBLING))
        last[above] = k
    rows = features(page)
    unary = rows @ (fitted() if weights is None else weights)
    keep = minimum_cut(unary.tolist(), edges)
    if not any(keep) and (sure := _prose(page, rows) & (rows[:, FEATURES.index("in body")] > 0)).any():
        # a page with prose in its body has a main text: the scale of costs is moved until the likeliest prose is on its side
        keep = minimum_cut(np.where(sure, unary - unary[sure].max() + 2 * (NEXT + SIBLING), unary).tolist(), edges)
    return "\n".join(text for (text, *_), good in zip(page.blocks, keep, strict=True) if good)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without html, with text (the main text) and n_chars (its code points).

    Each block's log odds of content, by a classifier fitted on labelled layouts, are
    its capacity from the source or to the sink; blocks that follow each other and the
    next blocks of one parent are tied. Null, empty and broken html give as much as can
    be read, an empty text if nothing. A page of any length is read whole in one task, in
    time that grows with its length. Repeated rows are treated alike; there are no ties
    between rows. An empty table gives an empty result. Columns named text or n_chars
    are replaced; others may have any names.
    """
    keep = [c for c in pages.columns if c.lower() not in (html.lower(), "text", "n_chars")]
    schema = pages.select(keep).schema.add("text", "string").add("n_chars", "long")
    weights = fitted()

    def extracted(batches):
        for whole in batches:
            for batch in pieces(whole, len(keep)):
                texts = [main_text(x.as_py(), weights) for x in batch.column(len(keep))]
                rows = [*(batch.column(c) for c in range(len(keep))), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(rows, schema.fieldNames())

    return pages.select(*keep, html).mapInArrow(extracted, schema)


def op8_html_extraction(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
