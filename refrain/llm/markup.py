"""A linear scanner of HTML: tags and the text between them, whatever the markup's state.

Every character is passed over a bounded number of times. A quote that is never closed is an
ordinary character; a tag, comment or declaration that never ends runs to the end of the
page, as does an element of raw text without an end tag.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

#: Fixed values of HTML: elements whose content is text and not markup.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())

_NAME = re.compile(r"[^\s/>]*")
_SPACE = re.compile(r"[\s/]*")
_KEY = re.compile(r"[^\s/>=]+")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_SIMPLE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)>")

#: (text, tag, closing, attributes): text before a tag, the tag's name ("" at the end of the page).
Token = tuple[str, str, bool, dict[str, str]]


def tokens(html: str) -> Iterator[Token]:
    at, end = 0, len(html)
    text = 0  # where the text that wasn't handed out yet begins
    last = {q: html.rfind(q) for q in ">\"'"}
    raw_end: dict[str, re.Pattern] = {}
    pending: list[str] = []

    while True:
        at = html.find("<", at)
        if at < 0:
            yield "".join([*pending, html[text:]]), "", False, {}
            return
        simple = _SIMPLE.match(html, at)
        if simple:
            tag, closing, attrs, after = simple[2].lower(), bool(simple[1]), {}, simple.end()
        else:
            first = html[at + 1 : at + 2]
            if first in ("!", "?") or (first == "/" and not html[at + 2 : at + 3].isalpha()):
                pending.append(html[text:at])
                if html.startswith("<!--", at):
                    close = html.find("-->", at + 2)
                    at = text = close + 3 if close >= 0 else end
                else:
                    at = text = html.find(">", at) + 1 or end
                continue
            closing = first == "/"
            begin = at + 1 + closing
            if not (html[begin : begin + 1].isascii() and html[begin : begin + 1].isalpha()):
                at += 1  # a sign of text
                continue
            if begin > last[">"]:  # no tag ends any more
                yield "".join([*pending, html[text:at]]), "", False, {}
                return
            name = _NAME.match(html, begin)
            tag = name[0].lower()
            attrs, after = _attributes(html, name.end(), end, last)
        yield "".join([*pending, html[text:at]]), tag, closing, attrs
        pending.clear()
        at = text = after
        if not closing and tag in RAW:
            if tag not in raw_end:
                raw_end[tag] = re.compile(rf"</{tag}(?=[\s/>])", re.I)
            close = raw_end[tag].search(html, at)
            at = text = close.start() if close else end


def _attributes(html: str, at: int, end: int, last: dict[str, int]) -> tuple[dict[str, str], int]:
    """A tag's attributes from ``at`` on, and where the tag has ended."""
    found: dict[str, str] = {}
    while True:
        at = _SPACE.match(html, at).end()
        if at >= end:
            return found, end
        if html[at] == ">":
            return found, at + 1
        key = _KEY.match(html, at)
        if key is None:  # an equals sign without a name
            at += 1
            continue
        at = key.end()
        equals = _EQUALS.match(html, at)
        value = ""
        if equals:
            at = equals.end()
            quote = html[at : at + 1]
            if quote in ('"', "'") and quote and at < last[quote]:
                close = html.find(quote, at + 1)
                value, at = html[at + 1 : close], close + 1
            else:
                bare = _BARE.match(html, at)
                value, at = bare[0], bare.end()
        found.setdefault(key[0].lower(), unescape(value) if "&" in value else value)
