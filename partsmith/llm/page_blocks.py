"""Elements, blocks and template tokens of one HTML page.

A block is a run of text between boundaries of block-level elements.  Elements
that hold no article text (menus, headers, footers, side bars, notices,
adverts, forms, scripts, styles, reader comments) are flagged by their tag or by
a word of their class, id or role; a flag on an element that holds the only
article of a page does not stand.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

import xxhash

OPEN, CLOSE, RUN, ARTICLE = 0, 1, 2, 3  # kinds of tokens; ARTICLE opens an article or main element

_BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody
    tfoot thead tr ul""".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg math select noframes xmp".split())
#: without an end tag these reach to the end of the page
_TO_THE_END = frozenset("script style".split())
_DROPPED_TAGS = frozenset("head script style nav header footer aside form noscript template dialog menu button select textarea iframe object svg".split())
#: words of class, id and role that mark what is no article text
_DROPPED_WORDS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr
    notice notices notification alert popup modal overlay newsletter subscribe subscription signup sidebar aside menu nav navbar
    navigation breadcrumb breadcrumbs pagination pager toolbar header masthead topbar footer comment comments disqus discussion
    respond reply replies share sharing social related recommended recommendations widget login search form paywall
    complementary contentinfo dialog alertdialog""".split())
_MAIN_WORDS = frozenset("main articlebody".split())
#: opening one of these ends open elements of the given tags, up to a barrier
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
         "tr": ({"tr"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
         "body": ({"head"}, set())}
_BARRIERS = {"table", "caption", "td", "th", "button", "object", "template"}
_MARKUP = re.compile(r"""<!--(?:.*?-->|.*)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CLOSING = 0x5555555555555555


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@lru_cache(4096)
def _traits(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """Name in paths, whether the element is flagged, whether it marks an article."""
    found = {}
    for name, value in _ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), unescape(value.strip("\"'")))
    words = {w.lower() for key in ("class", "id", "role") for w in _WORD.findall(found.get(key, ""))}
    hidden = "hidden" in found or re.search(r"display\s*:\s*none", found.get("style", "")) is not None
    flagged = hidden or tag in _DROPPED_TAGS or bool(words & _DROPPED_WORDS) and tag not in ("html", "body", "main")
    own = "".join(w.lower() for w in _WORD.findall(found.get("itemprop", "")))
    article = tag in ("article", "main") or found.get("role", "").lower() in ("main", "article") or own in _MAIN_WORDS
    classes = sorted(re.sub(r"\d+", "", c) for c in found.get("class", "").split())
    return ".".join([tag, *classes]), flagged, article and not flagged


@lru_cache(64)
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I)


class Page:
    """``tokens``, ``kinds`` and ``sizes`` in page order (sizes: characters of a run that no flag and no link covers) and ``blocks``.

    Element i has ``path[i]``, ``parent[i]``, ``flag[i]`` and ``article[i]``; block j is ``text[j]`` in element ``owner[j]``.
    """

    def __init__(self, html: str):
        self.path, self.parent, self.flag, self.article, self.opened = [], [], [], [], []
        self.text, self.owner, self.linked, self.run = [], [], [], []
        self.tokens, self.kinds = [], []
        self._stack: list[tuple[str, int]] = []  # tag, element (-1: inline)
        self._buffer: list[str] = []
        self._link_chars = 0
        self._inline_dropped = 0
        self._links = 0
        self._here = -1
        self._parse(html or "")
        self._flush()
        self._pop(0)
        self._settle()
        of_token = dict(zip(self.run, range(len(self.run))))
        self.sizes = [0] * len(self.tokens)
        for at, j in of_token.items():
            self.sizes[at] = 0 if self.dropped[self.owner[j]] else max(0, len(self.text[j]) - self.linked[j])

    def _flush(self) -> None:
        if self._buffer:
            text = " ".join("".join(self._buffer).split())
            if text:
                self.text.append(text)
                self.owner.append(self._here)
                self.linked.append(min(self._link_chars, len(text)))
                self.run.append(len(self.tokens))
                seed = self.path[self._here] if self._here >= 0 else 0
                self.tokens.append(_signed(xxhash.xxh64_intdigest(text, seed & 0xFFFFFFFFFFFFFFFF)))
                self.kinds.append(RUN)
            self._buffer, self._link_chars = [], 0

    def _push(self, tag: str, attributes: str) -> None:
        name, flagged, article = _traits(tag, attributes)
        if tag not in _BLOCK:
            dropped = flagged
            self._inline_dropped += dropped
            self._links += tag == "a"
            self._stack.append((tag, -2 if dropped else -1))
            return
        at = len(self.path)
        seed = self.path[self._here] if self._here >= 0 else 0
        self.path.append(_signed(xxhash.xxh64_intdigest(name, seed & 0xFFFFFFFFFFFFFFFF)))
        self.parent.append(self._here)
        self.flag.append(flagged)
        self.article.append(article)
        self.opened.append(len(self.tokens))
        self.tokens.append(self.path[at])
        self.kinds.append(ARTICLE if article else OPEN)
        self._stack.append((tag, at))
        self._here = at

    def _pop(self, depth: int) -> None:
        while len(self._stack) > depth:
            tag, at = self._stack.pop()
            if at < 0:
                self._inline_dropped -= at == -2
                self._links -= tag == "a"
                continue
            self._flush()
            self.tokens.append(self.path[at] ^ _CLOSING)
            self.kinds.append(CLOSE)
            self._here = self.parent[at]

    def _find(self, tags, barriers) -> int:
        for depth in range(len(self._stack) - 1, -1, -1):
            if self._stack[depth][0] in tags:
                return depth
            if self._stack[depth][0] in barriers:
                return -1
        return -1

    def _add(self, chunk: str) -> None:
        if self._inline_dropped:
            return
        if "&" in chunk:
            chunk = unescape(chunk)
        self._buffer.append(chunk)
        if self._links:
            self._link_chars += len(chunk)

    def _parse(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            found = _MARKUP.search(html, at)
            if found is None:
                self._add(html[at:])
                return
            if found.start() > at:
                self._add(html[at:found.start()])
            at = found.end()
            tag = found.group(2) or found.group(5)
            if tag is None:
                continue
            tag, end, attributes = tag.lower(), found.group(1) or found.group(4), found.group(3) or found.group(6) or ""
            if end:
                self._end(tag)
            elif tag in _RAW:
                closed = _closing(tag).search(html, at) if not attributes.endswith("/") or tag in _TO_THE_END else None
                if closed:
                    at = closed.end()
                elif tag in _TO_THE_END:
                    at = n
            else:
                self._start(tag, attributes)

    def _start(self, tag: str, attributes: str) -> None:
        if tag in _BLOCK:
            self._flush()
            depth = self._find({"p"}, _BARRIERS)
            if depth >= 0:
                self._pop(depth)
            if self._stack and self._stack[-1][0] == "head":
                self._pop(len(self._stack) - 1)
            if tag in _ENDS:
                depth = self._find(*_ENDS[tag])
                if depth >= 0:
                    self._pop(depth)
        elif tag in ("br", "td", "th"):
            self._buffer.append(" ")
        if tag not in _VOID:
            self._push(tag, attributes)

    def _end(self, tag: str) -> None:
        if tag in ("body", "html"):  # what follows them still belongs to the page
            return
        block = tag in _BLOCK
        for depth in range(len(self._stack) - 1, -1, -1):
            name, at = self._stack[depth]
            if name == tag:
                self._pop(depth)
                return
            if not block and at >= 0:
                return

    def _settle(self) -> None:
        """``dropped[i]``: element i lies in a flagged one; flags around the only articles do not stand."""
        n = len(self.path)

        def spread(flag):
            out = [False] * (n + 1)  # the last stands for the page itself
            for i in range(n):
                out[i] = flag[i] or out[self.parent[i]]
            return out

        dropped = spread(self.flag)
        inside = [i for i in range(n) if self.article[i]]
        self.main = [i for i in inside if not dropped[i]]
        if inside and not self.main:
            flag = list(self.flag)
            for i in inside:
                while i >= 0:
                    flag[i] = False
                    i = self.parent[i]
            dropped = spread(flag)
            self.main = inside
        self.dropped = dropped

    def within(self, chosen: set[int]) -> list[bool]:
        """Per element whether it is one of ``chosen`` or lies in one."""
        out = [False] * (len(self.path) + 1)
        for i in range(len(self.path)):
            out[i] = i in chosen or out[self.parent[i]]
        return out
