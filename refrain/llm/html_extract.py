"""Main text of web pages by consensus host paths.

1. Every page's containers are scored by the running text they hold: a text block counts
   fully for the container around it and half for each further one, linked text not at all.
2. A container's path is its chain of tags and classes, digits generalised. Pages vote for
   paths with their containers' shares of the page's score; votes are summed by host in Spark.
3. Every page is extracted again at its host's winning path. A page that has no text there is
   extracted at its own best container, and one without any container's text as a whole.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments are left out at each step. Elements and roles that say so always go. The words of
class and id only make a part suspect: it stays if it holds nearly all of a page's text and
that text is long and hardly linked, or if nothing would be left without it; adverts, notices
and reader comments stay only in the last case. Lists of links alone are menus, outside an article.
Character references are decoded, white space within a block becomes one blank, and blocks
are joined by a line feed in page order; nothing else is dropped or cut.

Defined results: null html is empty and has an empty text; a null url, or one without a
host, votes with the empty host; broken or unclosed markup is read as far as it goes, in time
proportional to the page's length; repeated pages vote once each. An empty table gives an
empty result. Other columns pass through, except one named like the output, which is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from refrain.llm.markup import RAW, tokens
from refrain.sources.shared import materialize

#: Hosts (some 200 bytes each) up to which the winning paths are broadcast; beyond, they are joined by shuffle.
BROADCAST_HOSTS = 100_000

_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_DIGITS = re.compile(r"\d+")

#: Fixed values of HTML: elements without content, blocks, containers, headings.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CONTAINERS = frozenset("html body main article section div center td th blockquote figure aside nav header footer form dialog fieldset table tbody thead tfoot tr ul ol dl menu details search noscript template".split())
_TEXTS = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 pre address figcaption caption summary legend hgroup".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Form controls: their content goes, and any block ends them.
_CONTROLS = frozenset("button select option optgroup datalist".split())
#: A start tag on the left ends an open element on the right that is nearer than any list or table around it.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_OPEN_PARTS = frozenset("li dt dd tr td th".split())

#: Elements and roles that aren't running text, and the words that say so in a class or id.
_BAD_TAGS = frozenset("nav footer aside form menu dialog search fieldset noscript template".split())
_BAD_ROLES = frozenset("navigation contentinfo complementary search form menu menubar dialog alert alertdialog".split())
_SURE_WORDS = re.compile(
    r"comments?|commentlist|disqus|respond|responses?|repl(?:y|ies)|discussion|ad|ads|adv|adverts?|advertisement|advertising|adsense|adbox|sponsor|sponsored|promoted"
    r"|cookies?|consent|gdpr|notice|notices|notification|alert|disclaimer|popup|modal|overlay"
)
_BAD_WORDS = re.compile(
    r"nav|navbar|navigation|menu|menus|breadcrumbs?|sidebar|rail|footer|foot|banner|promo|promotion|newsletter|subscribe|subscription|signup|login|share|sharing|social"
    r"|related|recommended|recommendations|trending|popular|widgets?|toolbar|pagination|pager|search|form"
)
_HEADER_WORDS = frozenset("header masthead topbar".split())
#: Words that take the next, or the last, word's meaning away.
_WITHOUT = frozenset("has with no without is".split())
_FREE = frozenset("free less off".split())
_GOOD_WORDS = frozenset("content article post entry main story body text".split())
#: Share of a page's text that a suspect part must hold to stay, its characters at least, and the share of it that may be linked.
MOST, LONG, LINKED = 0.8, 400, 0.3

#: How an element is suspect.
_NOT, _PART, _SURE = range(3)


class Page:
    """A page's containers and text blocks, in page order."""

    def __init__(self, html: str | None) -> None:
        # of containers; 0 is the page itself
        self.names = [""]
        self.ids = [0]  # of paths
        self.parents = [-1]
        self.lifted = [0]  # the innermost article or main element around, else itself
        self.weights = [1.0]
        self.blocks: list[tuple[int, str, int, bool, int]] = []  # container, text, linked characters, link-only list item, suspect part
        self.suspects = [_NOT]  # parts; 0 is no part
        if html:
            self._read(html)
            self._drop_suspects()
            self._drop_link_lists()

    def _read(self, html: str) -> None:
        # open elements: tag, container, skip (0 no, 1 all but headings, 2 all), suspect part
        stack: list[tuple[str, int, int, int]] = [("", 0, 0, 0)]
        opened: Counter[str] = Counter()
        words: list[str] = []
        linked = 0
        link = control = False

        def flush() -> None:
            nonlocal linked
            if words:
                tag, container, skip, part = stack[-1]
                text = " ".join(unescape("".join(words)).split())
                if text and (skip == 0 or skip == 1 and tag in _HEADINGS):
                    self.blocks.append((container, text, min(linked, len(text)), tag == "li" and linked >= len(text), part))
                words.clear()
            linked = 0

        def end(k: int) -> None:
            for tag, *_ in stack[k:]:
                opened[tag] -= 1
            del stack[k:]

        for text, tag, closing, attrs in tokens(html):
            if text and not control and stack[-1][2] < 2:
                words.append(text)
                if link:
                    linked += len(" ".join(unescape(text).split()))
            if tag == "a":
                link = not closing
                continue
            if tag in _CONTROLS:
                control = not closing and tag != "datalist"
                continue
            if tag in RAW or tag in _VOID:
                if tag == "hr":
                    flush()
                elif tag == "br" and words:
                    words.append(" ")
                continue
            container = tag in _CONTAINERS
            if not container and tag not in _TEXTS:
                if tag == "head" and closing:
                    flush()
                continue
            control = False
            if closing:
                if opened[tag] > 0:
                    flush()
                    link = False
                    k = len(stack) - 1
                    while stack[k][0] != tag:
                        k -= 1
                    end(k)
                continue
            flush()
            link = False
            top = stack[-1][0]
            if top == "p" or top in _HEADINGS and tag in _HEADINGS:
                end(len(stack) - 1)
            ends = _ENDS.get(tag)
            if ends and any(opened[t] > 0 for t in ends):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in ends:
                        end(k)
                        break
                    if stack[k][0] not in _TEXTS and stack[k][0] not in _OPEN_PARTS:
                        break
            _, parent, skip, part = stack[-1]
            skip = max(skip, self._skips(tag, attrs)) if attrs or tag in _BAD_TAGS or tag == "header" else skip
            if attrs and not part and skip < 2:
                suspect = self._suspect(tag, attrs)
                if suspect:
                    part = len(self.suspects)
                    self.suspects.append(suspect)
            inside = self._open(tag, parent, attrs) if container else parent
            stack.append((tag, inside, skip, part))
            opened[tag] += 1
        flush()

    def _open(self, tag: str, parent: int, attrs: dict[str, str]) -> int:
        name = tag
        good = tag in ("article", "main")
        if attrs:
            classes = ".".join(sorted({_DIGITS.sub("#", c) for c in attrs.get("class", "").split()}))
            name = f"{tag}.{classes}" if classes else tag
            good = good or any(w.lower() in _GOOD_WORDS for w in _WORD.findall(attrs.get("class", "") + " " + attrs.get("id", "")))
        at = len(self.names)
        self.names.append(name)
        # a path is known by a hash of its parent's and its own name, as whole paths add up to the square of the depth
        self.ids.append(xxh3_64_intdigest(name.encode(), self.ids[parent]) >> 1)
        self.parents.append(parent)
        self.lifted.append(at if tag in ("article", "main") or self.names[self.lifted[parent]].split(".")[0] not in ("article", "main") else self.lifted[parent])
        self.weights.append(1.25 if good else 1.0)
        return at

    @staticmethod
    def _skips(tag: str, attrs: dict[str, str]) -> int:
        if tag in _BAD_TAGS:
            return 2
        role = attrs.get("role", "").lower()
        if "hidden" in attrs or attrs.get("aria-hidden") == "true" or role in _BAD_ROLES or "display:none" in attrs.get("style", "").replace(" ", "").lower():
            return 2
        return 1 if tag == "header" or role == "banner" or tag not in ("html", "body", "main", "article") and any(w in _HEADER_WORDS for w in _said(attrs)) else 0

    @staticmethod
    def _suspect(tag: str, attrs: dict[str, str]) -> int:
        if tag in ("html", "body", "main"):
            return _NOT
        found = _NOT
        for w in _said(attrs):
            if _SURE_WORDS.fullmatch(w):
                return _SURE
            if tag != "article" and _BAD_WORDS.fullmatch(w):
                found = _PART
        return found

    def _drop_suspects(self) -> None:
        if len(self.suspects) == 1:
            return
        size, linked = [0] * len(self.suspects), [0] * len(self.suspects)
        for _, text, n, _, part in self.blocks:
            size[part] += len(text)
            linked[part] += n
        total = sum(n for n, kind in zip(size, self.suspects, strict=True) if kind != _SURE)
        stays = {0} | {k for k, kind in enumerate(self.suspects) if kind == _PART and size[k] > max(LONG, MOST * total) and linked[k] < LINKED * size[k]}
        if not any(size[k] for k in stays):  # nothing would be left: all parts that aren't sure to be something else, or else all
            stays = {k for k, kind in enumerate(self.suspects) if kind != _SURE}
            if not any(size[k] for k in stays):
                return
        self.blocks = [b for b in self.blocks if b[4] in stays]

    def _drop_link_lists(self) -> None:
        """Lists of links alone are menus, unless they are in an article."""
        items: dict[int, tuple[int, bool]] = {}
        for container, _, _, only, _ in self.blocks:
            n, all_so_far = items.get(container, (0, True))
            items[container] = n + 1, all_so_far and only
        menus = {c for c, (n, only) in items.items() if only and n > 1 and self.names[self.lifted[c]].split(".")[0] not in ("article", "main")}
        if menus and len(menus) < len(items):
            self.blocks = [b for b in self.blocks if b[0] not in menus]

    def scores(self) -> dict[int, float]:
        """Each path's share of the page's text; a path within an article or main element stands for that element."""
        total = sum(len(b[1]) for b in self.blocks)
        if not total:
            return {}
        held = [0.0] * len(self.names)
        for container, text, linked, *_ in self.blocks:
            held[container] += len(text) - linked
        for k in range(len(held) - 1, 0, -1):
            held[self.parents[k]] += held[k] / 2
        raw: dict[tuple[int, int], float] = {}
        for k, worth in enumerate(held):
            if worth > 0:
                path = self.ids[self.lifted[k]], self.ids[k]
                raw[path] = raw.get(path, 0.0) + worth * self.weights[k]
        out: dict[int, float] = {}
        for (lifted, _), worth in raw.items():  # what is lifted doesn't count twice
            out[lifted] = max(out.get(lifted, 0.0), worth / total)
        return out

    def best(self) -> int:
        scores = self.scores()
        return max(scores, key=lambda p: (scores[p], p)) if scores else 0

    def text(self, path: int | None) -> str:
        """Blocks at ``path``, or at the page's best path where there are none, or all."""
        found = self._inside(path) if path is not None else []
        return "\n".join(found or self._inside(self.best()) or [b[1] for b in self.blocks])

    def _inside(self, path: int) -> list[str]:
        within = [False] * len(self.names)
        for k, p in enumerate(self.ids):
            within[k] = p == path or k > 0 and within[self.parents[k]]
        return [b[1] for b in self.blocks if within[b[0]]]


def _said(attrs: dict[str, str]) -> list[str]:
    """The words of class and id that mean what they say."""
    out = []
    for name in (*attrs.get("class", "").split(), attrs.get("id", "")):
        found = [w.lower() for w in _WORD.findall(name)]
        out += [w for k, w in enumerate(found) if (k == 0 or found[k - 1] not in _WITHOUT) and (k + 1 == len(found) or found[k + 1] not in _FREE)]
    return out


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:/?#]*://([^/?#]*)", 1))


def _votes(html: Column) -> Column:
    kind = pa.list_(pa.struct([("path", pa.int64()), ("score", pa.float64())]))

    @F.arrow_udf("array<struct<path: long, score: double>>")
    def votes(htmls: pa.Array) -> pa.Array:
        return pa.array([[{"path": p, "score": s} for p, s in Page(h.as_py()).scores().items()] for h in htmls], kind)

    return votes(html)


def _text_at(html: Column, path: Column) -> Column:
    @F.arrow_udf("string")
    def text_at(htmls: pa.Array, paths: pa.Array) -> pa.Array:
        return pa.array([Page(h.as_py()).text(p.as_py()) for h, p in zip(htmls, paths, strict=True)], pa.string())

    return text_at(html, path)


def winning_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path): the path (a hash) with the most votes; of equals the one on most pages, then the largest."""
    votes = pages.select(host_of(F.col(f"`{url}`")).alias("host"), F.explode(_votes(F.col(f"`{html}`"))).alias("v"))
    # shares are summed as whole millionths, so that the order of addition can't matter
    counted = votes.groupBy("host", "v.path").agg(F.sum(F.round(F.col("v.score") * 1_000_000).cast("long")).alias("votes"), F.count(F.lit(1)).alias("n"))
    return counted.groupBy("host").agg(F.max(F.struct("votes", "n", "path")).alias("w")).select("host", F.col("w.path").alias("path"))


def extract_text(pages: DataFrame, url: str = "url", html: str = "html", out: str = "text", broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """``pages`` with column ``out``: each page's main text at its host's winning path."""
    winners = materialize(winning_paths(pages, url, html), "host-paths")
    if winners.count() <= broadcast_hosts:
        winners = F.broadcast(winners)
    others = [c for c in pages.columns if c != out]
    narrow = pages.select(host_of(F.col(f"`{url}`")).alias("host"), F.col(f"`{html}`").alias("html"), F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others))).alias("row"))
    joined = narrow.join(winners, "host", "left")
    return joined.select(*(F.col(f"row.c{k}").alias(c) for k, c in enumerate(others)), _text_at(F.col("html"), F.col("path")).alias(out))
