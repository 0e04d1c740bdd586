"""Labelled pages: layouts of web pages, filled with words and marked where the article is.

The words come from real pages, the layouts from a random choice of elements, class
names, order and nesting. Blocks of the article carry the attribute that
:mod:`tradespec.llm.dom_blocks` reads as a label.
"""

from __future__ import annotations

import html
import random

from tradespec.llm.dom_blocks import GOLD

# What authors of pages call their parts.
NAMES = {
    "header": "header masthead site-header banner top branding logo page-header topbar".split(),
    "menu": "nav menu navbar navigation main-menu breadcrumb breadcrumbs topnav tabs links".split(),
    "sidebar": "sidebar side aside widget related recommended trending popular more teaser "
    "archive tags tagcloud rail secondary".split(),
    "notice": "notice cookie cookies consent banner alert gdpr popup modal overlay newsletter "
    "subscribe signup paywall disclaimer message warning privacy".split(),
    "advert": "ad ads advert advertisement sponsored promo promotion sponsor adsense "
    "commercial ad-slot adbox".split(),
    "form": "form search login contact searchform register poll survey".split(),
    "comments": "comments comment respond discussion replies reply feedback reactions "
    "comment-list disqus thread responses reviews".split(),
    "footer": "footer foot copyright legal site-footer bottom colophon credits imprint".split(),
    "share": "share social meta byline sharing pagination pager toolbar follow".split(),
    "article": "article post content entry entry-content main story body text article-body "
    "post-content page-content news document".split(),
    "wrapper": "page wrapper container site layout outer grid row col inner".split(),
}
ELEMENTS = {
    "header": ["header", "header", "div"],
    "menu": ["nav", "nav", "div", "ul"],
    "sidebar": ["aside", "aside", "div", "section"],
    "notice": ["div", "div", "section", "aside", "dialog"],
    "advert": ["div", "div", "aside", "ins", "section"],
    "form": ["form"],
    "comments": ["section", "div", "div", "ol"],
    "footer": ["footer", "footer", "div"],
    "share": ["div", "ul", "p"],
    "article": ["article", "article", "main", "div", "section"],
    "wrapper": ["div", "div", "section"],
}
ROLES = {
    "header": "banner",
    "menu": "navigation",
    "sidebar": "complementary",
    "notice": "alert",
    "form": "search",
    "footer": "contentinfo",
    "article": "main",
}


class Layout:
    """Pages drawn from one source of chance and one list of words."""

    def __init__(self, chance: random.Random, words: list[str]):
        self.chance, self.vocabulary = chance, words

    def words(self, least: int, most: int) -> str:
        found = [self.chance.choice(self.vocabulary) for _ in range(self.chance.randint(least, most))]
        return html.escape(" ".join(found))

    def sentences(self, least: int, most: int) -> str:
        parts = []
        for _ in range(self.chance.randint(least, most)):
            part = self.words(4, 18)
            parts.append(part[:1].upper() + part[1:].rstrip(".") + self.chance.choice("...!?"))
        return " ".join(parts)

    def link(self, least: int = 1, most: int = 4) -> str:
        text = self.words(least, most)
        return f'<a href="/{text[:20]}">{text}</a>'

    def maybe(self, share: float) -> bool:
        return self.chance.random() < share

    def part(self, kind: str, inner: str, gold: bool = False, named: float = 0.85) -> str:
        """An element that holds a part of the page, mostly with names that tell which."""
        tag = self.chance.choice(ELEMENTS[kind])
        says = ""
        # A plain element without a name tells nothing: only its place and text would.
        if self.maybe(named) or tag in ("div", "section", "ul", "ol", "p"):
            names = " ".join(self.chance.sample(NAMES[kind], self.chance.choice((1, 1, 2))))
            says = f' {self.chance.choice(("class", "class", "id"))}="{names}"'
        if kind in ROLES and self.maybe(0.15):
            says += f' role="{ROLES[kind]}"'
        if gold:
            says += f" {GOLD}"
        return f"<{tag}{says}>{inner}</{tag}>"

    def items(self, least: int, most: int) -> str:
        count = self.chance.randint(least, most)
        if self.maybe(0.7):
            return "<ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(count)) + "</ul>"
        return self.chance.choice((" ", " | ", "<br>", " / ")).join(self.link() for _ in range(count))

    def heading(self) -> str:
        return f"<h{(n := self.chance.choice('2346'))}>{self.words(1, 5)}</h{n}>"

    def menu(self) -> str:
        return self.part("menu", self.items(2, 9))

    def header(self) -> str:
        inner = self.chance.choice((f"<h1>{self.words(1, 4)}</h1>", f"<p>{self.words(2, 8)}</p>", self.link()))
        return self.part("header", inner + (self.menu() if self.maybe(0.5) else ""))

    def sidebar(self) -> str:
        inner = ""
        for _ in range(self.chance.randint(1, 3)):
            inner += self.heading() if self.maybe(0.7) else ""
            inner += self.chance.choice(
                (self.items(2, 6), f"<p>{self.sentences(1, 3)}</p>", f"<p>{self.words(2, 9)}</p>")
            )
        return self.part("sidebar", inner)

    def notice(self) -> str:
        inner = self.chance.choice((f"<p>{self.sentences(1, 3)}</p>", self.sentences(1, 2)))
        return self.part("notice", inner + (f"<button>{self.words(1, 2)}</button>" if self.maybe(0.5) else ""))

    def advert(self) -> str:
        return self.part(
            "advert",
            self.chance.choice(
                (self.sentences(1, 2), f"<p>{self.sentences(1, 4)}</p>", self.link(3, 9), self.words(2, 9))
            ),
        )

    def form(self) -> str:
        inner = f"<label>{self.words(1, 3)}</label><input name='q'>"
        if self.maybe(0.4):
            inner = f"<p>{self.sentences(1, 2)}</p>" + inner
        return self.part("form", inner + f"<button>{self.words(1, 2)}</button>", named=0.4)

    def share(self) -> str:
        return self.part("share", self.chance.choice((self.items(2, 5), self.words(2, 6))))

    def comments(self) -> str:
        inner = self.heading() if self.maybe(0.7) else ""
        for _ in range(self.chance.randint(1, 6)):
            tag = self.chance.choice(("div", "article", "li", "p"))
            name = self.chance.choice((' class="comment"', ' class="reply"', ""))
            body = self.sentences(1, 6)
            if tag != "p":
                author = f"<{(t := self.chance.choice(('h4', 'span', 'div', 'cite')))}>{self.words(1, 3)}</{t}>"
                body = (author if self.maybe(0.7) else "") + f"<p>{body}</p>"
            inner += f"<{tag}{name}>{body}</{tag}>"
        return self.part("comments", inner + (self.form() if self.maybe(0.4) else ""))

    def footer(self) -> str:
        inner = self.chance.choice(
            (
                f"&copy; {self.words(1, 3)} &middot; {self.sentences(1, 1)}",
                f"<p>&copy; 20{self.chance.randint(10, 29)} {self.words(1, 5)}</p>",
                f"<p>{self.sentences(1, 2)}</p>",
            )
        )
        return self.part("footer", inner + (self.items(2, 5) if self.maybe(0.5) else ""))

    def paragraph(self) -> str:
        draw = self.chance.random()
        if draw < 0.62:
            text = self.sentences(1, 9)
            if self.maybe(0.2):
                text = f"<b>{self.words(2, 6)}</b> {text} {self.link()} {self.sentences(1, 2)}"
            return f"<p>{text}</p>" if self.maybe(0.85) else f"<p>{text}"
        if draw < 0.72:
            return f"<p>{self.words(1, 8)}</p>"
        if draw < 0.82:
            return self.heading()
        if draw < 0.88:
            return "<ul>" + "".join(f"<li>{self.sentences(1, 2)}</li>" for _ in range(3)) + "</ul>"
        if draw < 0.92:
            return f"<blockquote><p>{self.sentences(1, 3)}</p></blockquote>"
        if draw < 0.95:
            return f"<table><tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr></table>"
        return f"<div>{self.sentences(1, 5)}</div>"

    def article(self) -> str:
        inner = f"<h1>{self.words(2, 12)}</h1>" if self.maybe(0.8) else ""
        for _ in range(self.chance.randint(1, 9)):
            inner += self.paragraph()
            if self.maybe(0.2):
                # What stands inside the article yet is none of it.
                made = self.chance.choice((self.advert, self.advert, self.notice, self.sidebar, self.form))
                inner += self.foreign(made)
        if self.maybe(0.15):
            inner += self.foreign(self.share)
        if self.maybe(0.2):
            inner += self.foreign(self.comments)
        return self.part("article", inner, gold=True)

    @staticmethod
    def foreign(make) -> str:
        return f'<div {GOLD}="no">{make()}</div>'

    def page(self) -> str:
        before = [m() for m in (self.header, self.menu, self.advert, self.notice) if self.maybe(0.5)]
        beside = [m() for m in (self.sidebar, self.advert, self.form) if self.maybe(0.3)]
        after = [
            m() for m in (self.share, self.comments, self.sidebar, self.advert, self.form, self.notice)
            if self.maybe(0.35)
        ]
        self.chance.shuffle(before)
        self.chance.shuffle(after)
        parts = [*before, *beside, self.article(), *after]
        if self.maybe(0.85):
            parts.append(self.footer())
        body = self.chance.choice(("", "\n")).join(parts)
        if self.maybe(0.4):
            body = self.part("wrapper", body)
        title = self.words(2, 9)
        return f"<html><head><title>{title}</title></head><body>{body}</body></html>"


def layouts(words: list[str], seed: int, count: int) -> list[str]:
    """``count`` labelled pages; equal arguments give equal pages."""
    chance = random.Random(seed)
    return [Layout(chance, words).page() for _ in range(count)]
