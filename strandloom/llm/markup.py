"""Markup as a stream of tags and text, in time that grows with the page whatever its bytes."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

#: Elements whose content is neither markup nor text of the page: up to their end tag, or to the end of the page.
RAW = {"script", "style", "xmp", "iframe", "noembed", "noframes"}
#: The same, but their content is read where nothing ends them.
RAW_IF_ENDED = {"title", "textarea", "annotation", "annotation-xml"}
_NAME = re.compile(r"[a-zA-Z][^\s/<>]*")
_ATTRIBUTE = re.compile(r"[^\s\"'<>/=]+")
_SPACE = re.compile(r"[\s/]*")
_BARE = re.compile(r"[^\s<>]*")
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW | RAW_IF_ENDED}
_COMMENT_END = re.compile(r"--!?>")
_HUGE = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{7,});?")


def decoded(text: str) -> str:
    """Text with its character references resolved; numbers that are no character become one that says so."""
    return html.unescape(_HUGE.sub("�", text)) if "&" in text else text


class _Finder:
    """Where something comes next. What isn't found once is never looked for again."""

    def __init__(self, text: str):
        self.text, self.none = text, set()

    def text_at(self, what: str, at: int) -> int:
        if what in self.none:
            return -1
        found = self.text.find(what, at)
        if found < 0:
            self.none.add(what)
        return found

    def match_at(self, what: re.Pattern, at: int) -> re.Match | None:
        if what in self.none:
            return None
        found = what.search(self.text, at)
        if not found:
            self.none.add(what)
        return found


def _attributes(text: str, at: int, find: _Finder) -> tuple[list[tuple[str, str | None]], int]:
    """Attributes from a place on, and where the tag ends: behind its >, or before a < or the end of the page, which cut it."""
    out: list[tuple[str, str | None]] = []
    n = len(text)
    while True:
        at = _SPACE.match(text, at).end()
        if at >= n or text[at] == "<":
            return out, at
        if text[at] == ">":
            return out, at + 1
        name = _ATTRIBUTE.match(text, at)
        if not name:  # a quote or = that stands alone; a quoted text is passed over as a whole
            end = find.text_at(text[at], at + 1) if text[at] in "\"'" else -1
            at = end + 1 if end >= 0 else at + 1
            continue
        key, at = name.group().lower(), name.end()
        then = _SPACE.match(text, at).end()
        if then >= n or text[then] != "=":
            out.append((key, None))
            continue
        at = then + 1
        while at < n and text[at].isspace():
            at += 1
        if at < n and text[at] in "\"'" and (end := find.text_at(text[at], at + 1)) >= 0:
            value, at = text[at + 1 : end], end + 1
        else:
            found = _BARE.match(text, at)
            value, at = found.group(), found.end()
        out.append((key, decoded(value)))


def read(text: str) -> Iterator[tuple]:
    """("text", text), ("start", tag, attributes) and ("end", tag) in page order.

    Nothing is read twice: a tag ends at its >, outside quotes, or is cut by the next <;
    a quote that nothing closes is passed over. Comments, declarations and instructions are
    left out, unclosed ones up to the end of the page, and so is what stands in scripts, styles,
    titles and the like (``RAW``, ``RAW_IF_ENDED``). A < before anything else is text.
    """
    find, at, n = _Finder(text), 0, len(text)
    while at < n:
        begin = text.find("<", at)
        if begin < 0:
            yield ("text", decoded(text[at:]))
            return
        if begin > at:
            yield ("text", decoded(text[at:begin]))
        at = begin
        following = text[at + 1 : at + 2]
        if following == "!" or following == "?" or following == "/" and not text[at + 2 : at + 3].isalpha():
            if text.startswith("<!--", at):
                if text.startswith((">", "->"), at + 4):
                    at = text.index(">", at + 4) + 1
                    continue
                end = find.match_at(_COMMENT_END, at + 4)
                at = end.end() if end else n
            elif following == "/" and at + 2 >= n:
                yield ("text", text[at:])
                return
            else:
                end = find.text_at(">", at + 2)
                at = end + 1 if end >= 0 else n
            continue
        name = _NAME.match(text, at + 2 if following == "/" else at + 1)
        if not name:
            yield ("text", "<")
            at += 1
            continue
        tag = name.group().lower()
        attributes, at = _attributes(text, name.end(), find)
        if following == "/":
            yield ("end", tag)
            continue
        yield ("start", tag, attributes)
        if tag in RAW or tag in RAW_IF_ENDED:
            end = find.match_at(_END[tag], at)
            if end:
                at = end.start()
            elif tag in RAW:
                return
