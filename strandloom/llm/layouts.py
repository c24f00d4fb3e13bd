"""Labelled pages of many layouts, on which the classifier of ``html`` is fitted."""

from __future__ import annotations

import random
from collections.abc import Iterator

#: Pages that are made for the fit. Documented bound.
PAGES = 700
SEED = 20

SYLLABLES = "ba be co da en er fi ga ho in ka la mi no or pe qui ra se st ta th un ver wi za".split()
#: Names of containers that say what they hold, and names that say nothing.
PLAIN_NAMES = ["c1", "col-8", "row", "box", "inner", "wrap", "grid", "panel", "x-left", "area"]
NAMES = {
    "nav": ["nav", "menu", "navbar", "top-navigation", "breadcrumbs"],
    "header": ["header", "masthead", "site-header", "topbar"],
    "side": ["sidebar", "widget", "related", "recommended", "social-share"],
    "ad": ["ad", "advert", "sponsored", "promo-box", "banner"],
    "notice": ["cookie-notice", "consent", "popup", "newsletter"],
    "footer": ["footer", "site-footer", "legal", "copyright"],
    "comments": ["comments", "comment-list", "respond", "discussion"],
    "content": ["content", "post", "entry-content", "story", "article-body", "main"],
}
TELLING_NAMES = ["has-sidebar", "no-sidebar", "with-comments", "page", "site", ""]


class _Maker:
    def __init__(self, rng: random.Random):
        self.rng = rng
        self.content: set[str] = set()

    def words(self, n: int) -> list[str]:
        return ["".join(self.rng.choices(SYLLABLES, k=self.rng.randint(1, 4))) for _ in range(n)]

    def sentence(self, low: int, high: int) -> str:
        return " ".join(self.words(self.rng.randint(low, high))).capitalize() + self.rng.choice("...!?")

    def text(self, low: int = 1, high: int = 5) -> str:
        out = " ".join(self.sentence(2, 18) for _ in range(self.rng.randint(low, high)))
        return out[:-1] if self.rng.random() < 0.25 else out

    def good(self, text: str) -> str:
        self.content.add(text)
        return text

    def box(self, inner: str, kind: str, tags: list[str], named: float = 0.75) -> str:
        tag = self.rng.choice(tags)
        names = NAMES[kind] if self.rng.random() < named or tag == "div" and kind in ("ad", "notice") else PLAIN_NAMES
        label = f' class="{self.rng.choice(names)}"' if tag == "div" or self.rng.random() < 0.4 else ""
        return f"<{tag}{label}>{inner}</{tag}>"

    def links(self, low: int = 3, high: int = 9) -> str:
        items = [f'<a href="/{w}">{" ".join(self.words(self.rng.randint(1, 3)))}</a>' for w in self.words(self.rng.randint(low, high))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self.rng.random() < 0.7 else " | ".join(items)

    def ad(self) -> str:
        return self.box(self.text(1, 2), "ad", ["div", "div", "aside"])

    def body(self) -> str:
        rng, parts = self.rng, []
        title = self.good(self.text(1, 1))
        heading = f"<h1>{title}</h1>"
        if rng.random() < 0.25:
            heading = f'<header class="{rng.choice(["article-header", "entry-header", ""])}">{heading}</header>'
        if rng.random() < 0.85:
            parts.append(heading)
        for _ in range(rng.choice([1, 2, 3, 4, 6, 8, 12])):
            kind = rng.random()
            if kind < 0.72:
                text = self.good(self.text(1, rng.choice([1, 2, 6])) if rng.random() < 0.85 else " ".join(self.words(rng.randint(1, 4))))
                parts.append(rng.choice(["<p>{}</p>", "<p>{}", "<p><b>{}<br></p>", "<p>{}</p>", "<div>{}</div>"]).format(text))
            elif kind < 0.82:
                parts.append(f"<h2>{self.good(' '.join(self.words(rng.randint(2, 6))))}</h2>")
            elif kind < 0.86:
                parts.append("<ul>" + "".join(f"<li>{self.good(self.text(1, 1))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.92:
                cells = [[self.good(" ".join(self.words(rng.randint(1, 3)))) for _ in range(3)] for _ in range(rng.randint(2, 4))]
                parts.append("<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in row) + "</tr>" for row in cells) + "</table>")
            elif kind < 0.96:
                parts.append(f"<blockquote><p>{self.good(self.text())}</p></blockquote>")
            else:
                parts.append(self.ad())
        if rng.random() < 0.2:
            parts.append(self.box(self.links(), "side", ["div", "aside"], 1.0))
        return "".join(parts)

    def comments(self) -> str:
        each = [f"<div><b>{self.words(1)[0]}</b></div><p>{self.text(1, 2)}</p>" for _ in range(self.rng.randint(1, 6))]
        head = "<h3>Comments</h3>" if self.rng.random() < 0.7 else ""
        if head and self.rng.random() < 0.4:
            return head + "".join(f"<div>{x}</div>" for x in each)
        return self.box(head + "".join(f"<div>{x}</div>" for x in each), "comments", ["div", "section"], 1.0)

    def page(self) -> str:
        rng, before, after = self.rng, [], []
        if rng.random() < 0.5:
            before.append(self.box(self.sentence(1, 4), "notice", ["div"]))
        if rng.random() < 0.6:
            before.append(self.box(f"<div>{' '.join(self.words(2))}</div>" + (self.links(2, 4) if rng.random() < 0.5 else ""), "header", ["header", "div"]))
        if rng.random() < 0.85:
            before.append(self.box(self.links(), "nav", ["nav", "nav", "div"]))
        if rng.random() < 0.4:
            before.append(self.ad())
        body = self.body()
        inside = rng.random() < 0.35
        talk = self.comments() if rng.random() < 0.4 else ""
        tag = rng.choice(["article", "article", "main", "div", "div", "section"])
        name = rng.choice(NAMES["content"] + PLAIN_NAMES + TELLING_NAMES)
        main = f'<{tag} class="{name}">{body}{talk if inside else ""}</{tag}>'
        if not inside:
            after.append(talk)
        if rng.random() < 0.5:
            after.append(self.box(
                f"<h4>{' '.join(self.words(2))}</h4>" + self.links() + (f"<p>{self.text(1, 1)}</p>" if rng.random() < 0.4 else ""),
                "side", ["aside", "div"],
            ))
        if rng.random() < 0.3:
            after.append(f"<form><p>{self.sentence(3, 9)}</p><input></form>")
        if rng.random() < 0.85:
            mark = rng.choice(["&copy; ", "", "© 2020 "])
            after.append(self.box(mark + self.sentence(2, 9) + (self.links(2, 5) if rng.random() < 0.4 else ""), "footer", ["footer", "footer", "div"]))
        whole = "".join(before) + main + "".join(after)
        for _ in range(rng.randint(0, 2)):
            whole = f'<{rng.choice(["div", "div", "form"])} class="{rng.choice(TELLING_NAMES + PLAIN_NAMES)}">{whole}</div>'
        return f"<html><head><title>{' '.join(self.words(3))}</title><style>p{{}}</style></head><body>{whole}</body></html>"


def pages(n: int = PAGES, seed: int = SEED) -> Iterator[tuple[str, set[str]]]:
    """(html, texts of the blocks that are content)."""
    rng = random.Random(seed)
    for _ in range(n):
        maker = _Maker(rng)
        yield maker.page(), maker.content
