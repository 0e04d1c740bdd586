"""Leaf blocks of a web page with the elements around them, in one pass over the markup."""

from __future__ import annotations

import functools
import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

#: Elements that do not end a block. Names of HTML.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark "
    "nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements whose content is never markup: without an end they run to the end of the page.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
#: Elements whose content is not text of the page.
SKIPPED = RAW | frozenset(
    "noscript template svg math object canvas audio video head select datalist".split()
)
#: Elements without content.
VOID = frozenset(
    "area base basefont br col embed frame hr img input link meta param source track wbr".split()
)
#: Elements that end an open one of their kind, up to the element that holds them.
_IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
# A tag whose quoted values hold no "<", else up to the next ">"; both read on in one go.
_MARKUP = re.compile(
    r"<!--(?:.*?-->|.*)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>\"']|\"[^<\"]*\"|'[^<']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"
    r"|<[!?/][^>]*+>",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(
    r"(?:^|\s)(class|id|role|itemprop|itemtype|aria-label|hidden|data-gold)"
    r"(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?",
    re.IGNORECASE,
)
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: Marks the main blocks of labelled pages, "no" what is none of them inside; never a feature.
GOLD = "data-gold"


class Block(NamedTuple):
    """Text between two block boundaries, and what is around it."""

    text: str
    linked: int  # characters inside links
    tags: tuple[str, ...]  # the 64 nearest ancestors, outermost first
    words: frozenset[str]  # of classes, ids and roles of the ancestors
    near: frozenset[str]  # of the nearest ancestor that has any
    gold: bool


class _Element(NamedTuple):
    name: str
    tags: tuple[str, ...]
    words: frozenset[str]
    near: frozenset[str]
    gold: bool


@functools.lru_cache(maxsize=1 << 14)
def _described(attributes: str) -> tuple[frozenset[str], bool | None]:
    words: set[str] = set()
    gold = None
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name == GOLD:
            gold = value != '"no"'
        elif name == "hidden":
            words.add("hidden")
        else:
            words.update(w.lower() for w in _WORD.findall(entities.unescape(value)))
    return frozenset(words), gold


@functools.lru_cache(maxsize=len(SKIPPED))
def _ending(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE)


class _Page:
    def __init__(self) -> None:
        self.open = [_Element("", (), frozenset(), frozenset(), False)]
        self.parts: list[str] = []
        self.linked, self.in_link = 0, False

    def add(self, raw: str) -> None:
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            self.parts.append(text)
            if self.in_link:
                self.linked += len(text)

    def block(self) -> Iterator[Block]:
        """The block that ends here, if it has text."""
        text = " ".join("".join(self.parts).split())
        if text:
            top = self.open[-1]
            yield Block(text, min(self.linked, len(text)), top.tags, top.words, top.near, top.gold)
        self.parts, self.linked = [], 0

    def start(self, name: str, attributes: str) -> None:
        top = self.open[-1]
        words, gold = _described(attributes) if attributes.strip() else (frozenset(), None)
        tags = (*top.tags[-63:], name)
        gold = top.gold if gold is None else gold
        self.open.append(_Element(name, tags, top.words | words, words or top.near, gold))

    def imply(self, name: str) -> None:
        if name in _IMPLIED:
            ended, holders = _IMPLIED[name]
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].name in holders:
                    break
                if self.open[i].name in ended:
                    del self.open[i:]
                    break
        # A paragraph ends where any other block starts.
        if self.open[-1].name == "p":
            self.open.pop()

    def end(self, name: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name == name:
                del self.open[i:]
                return


def blocks(page: str) -> Iterator[Block]:
    """The blocks of a page in its order; character references decoded, blanks joined.

    Broken markup is read as browsers mostly do: unclosed elements end with the one
    around them, ends without a start are passed over, an unclosed comment or script
    runs to the end. ``<`` before anything but a tag is text.
    """
    state, endless = _Page(), set()
    at, last = 0, page.rfind(">")
    while True:
        start = page.find("<", at)
        if start < 0 or start > last and not page.startswith("<!--", start):
            state.add(page[at:])
            break
        found = _MARKUP.match(page, start)
        if found is None:
            state.add(page[at : start + 1])
            at = start + 1
            continue
        state.add(page[at:start])
        at = found.end()
        name = (found.group(2) or found.group(5) or "").lower()
        if not name:
            continue
        if found.group(1) or found.group(4):
            if name == "a":
                state.in_link = False
            elif name not in INLINE:
                yield from state.block()
                state.end(name)
            continue
        attributes = found.group(3) or found.group(6) or ""
        if name in SKIPPED:
            # Drawings may be closed at once; others without an end are no elements.
            closed = attributes.endswith("/") and name in ("svg", "math")
            ending = None if closed or name in endless else _ending(name).search(page, at)
            if ending:
                close = page.find(">", ending.end())
                at = close + 1 if close >= 0 else len(page)
            elif name in RAW:
                break
            elif not closed:
                endless.add(name)
        elif name == "br":
            state.add(" ")
        elif name == "a":
            state.in_link = True
        elif name not in INLINE:
            yield from state.block()
            state.imply(name)
            if name not in VOID:
                state.start(name, attributes)
    yield from state.block()
