"""Web pages made from random templates, whose main text is known, to fit and to test extraction.

A page is of one family: how its parts are nested, what elements they are and what names they go by. Words are syllables at random, so that nothing but
structure can be learned.
"""

from __future__ import annotations

import random

#: Elements and names of the parts by family: page frame, article, heading block, menu, side, footer. An empty name is left out.
FAMILIES = {
    "blog": {"frame": ("div", "wrapper site"), "main": ("article", "post entry hentry"), "head": ("header", "site-header masthead"), "menu": ("nav", "navigation main-menu"), "side": ("aside", "sidebar widget-area"), "foot": ("footer", "site-footer colophon")},
    "news": {"frame": ("main", "page"), "main": ("div", "article-body story content"), "head": ("header", "top branding"), "menu": ("nav", "navbar sections"), "side": ("section", "rail secondary"), "foot": ("footer", "footer legal")},
    "docs": {"frame": ("div", "container"), "main": ("main", "content markdown-body"), "head": ("div", "header bar"), "menu": ("nav", "toc menu"), "side": ("div", "side toc"), "foot": ("div", "footer bottom")},
    "semantic": {"frame": ("main", ""), "main": ("article", ""), "head": ("header", ""), "menu": ("nav", ""), "side": ("aside", ""), "foot": ("footer", "")},
    "named": {"frame": ("div", "page wrap"), "main": ("div", "post-text entry-content"), "head": ("div", "header"), "menu": ("div", "nav menu"), "side": ("div", "sidebar"), "foot": ("div", "footer")},
    "bare": {"frame": ("div", ""), "main": ("div", ""), "head": ("div", ""), "menu": ("div", ""), "side": ("div", ""), "foot": ("div", "")},
    "portal": {"frame": ("div", "row grid"), "main": ("section", "col-8 box main"), "head": ("header", "hero"), "menu": ("ul", "tabs nav"), "side": ("div", "col-4 column widget"), "foot": ("footer", "")},
    "table": {"frame": ("table", ""), "main": ("td", ""), "head": ("td", ""), "menu": ("td", ""), "side": ("td", ""), "foot": ("td", "")},
    "archive": {"frame": ("section", "library"), "main": ("div", "text prose"), "head": ("hgroup", ""), "menu": ("menu", "breadcrumbs"), "side": ("aside", "recent links"), "foot": ("address", "")},
}
#: Names of parts that are never main text.
EXTRAS = {
    "ad": "ad ads advert advertisement sponsored promo banner",
    "share": "share social follow sharing-buttons",
    "form": "newsletter subscribe search login signup",
    "more": "related recommended popular trending more-stories",
    "notice": "cookie-banner consent notice alert modal popup",
    "talk": "comments comment-list discussion replies thread responses",
}
ONSETS, VOWELS, CODAS = "b c d f g h j k l m n p qu r s t v w z br ch cl gr pl sh st th tr".split(), "a e i o u é ö ai ea io ou ü".split(), ["", "", "", "l", "m", "n", "r", "s", "t", "nd", "st"]


def words(r: random.Random, n: int) -> str:
    """A run of ``n`` words with signs, begun with a capital."""
    out = []
    for i in range(n):
        w = "".join(r.choice(ONSETS) + r.choice(VOWELS) + r.choice(CODAS) for _ in range(r.choice((1, 1, 2, 2, 3, 4))))
        out.append((w.capitalize() if not i or r.random() < 0.05 else w) + (r.choice((",", ",", ".", ";", ":", "?", "!", "!!!", " –", " |", " *")) if r.random() < 0.13 else ""))
    return " ".join(out) + r.choice((".", ".", "!", "?", "", ""))


class Page:
    """One page in the making; ``main`` holds the texts of its main blocks."""

    def __init__(self, r: random.Random, family: str):
        self.r, self.parts, self.main = r, FAMILIES[family], set()
        self.family, self.loose = family, r.choice((0.0, 0.05, 0.3, 0.9))  # how often names are left out

    def some(self, *choices):
        return self.r.choice(choices)

    def text(self, low: int, high: int) -> str:
        return words(self.r, self.r.randint(low, high))

    def named(self, names: str) -> str:
        if not names or self.r.random() < self.loose:
            return ""
        return f' {self.some("class", "class", "id")}="{self.r.choice(names.split())}{self.some("", "", " block", "-1", " x")}"'

    def part(self, kind: str, inner: str) -> str:
        tag, names = self.parts[kind]
        end = "" if self.r.random() < 0.03 and kind in ("main", "frame") else f"</{tag}>"
        return f"<{tag}{self.named(names)}>{inner}{end}"

    def own(self, low: int, high: int) -> str:
        """Main text, sometimes with elements inside the line, not all of them closed."""
        t = words(self.r, self.r.randint(low, high))
        self.main.add(" ".join(t.split()))
        at = t.find(" ", len(t) // 2)
        if self.r.random() < 0.3 and at > 0:
            inner = self.some("b", "em", 'a href="#n"', "span", "code", "strong")
            t = f"{t[:at]} <{inner}>{t[at + 1:]}" + self.some(f"</{inner.split()[0]}>", f"</{inner.split()[0]}>", "")
            if self.r.random() < 0.1:
                t = t.replace(" ", "<br>", 1)
        elif self.r.random() < 0.06:
            t = f"<{(i := self.some('b', 'i', 'span'))}>{t}" + self.some("<br>", f"</{i}>", "")
        return t

    def links(self, n: int) -> str:
        items = [f'<a href="/{i}">{self.text(1, 3)}</a>' for i in range(n)]
        form = self.r.random()
        if form < 0.6:
            return f"<ul{self.named('menu links')}>" + "".join(f"<li>{x}" + self.some("</li>", "</li>", "") for x in items) + "</ul>"
        return self.some(" | ", " ", " &middot; ").join(items) if form < 0.85 else "".join(f"<div>{x}</div>" for x in items)

    def block(self) -> str:
        """A block of the article."""
        form = self.r.random()
        if form < 0.68:
            low, high = self.some((1, 4), (4, 20), (15, 60), (30, 140), (30, 140))
            return f"<p>{self.own(low, high)}" + self.some("</p>", "</p>", "</p>", "")
        if form < 0.76:
            return f"<{(h := self.some('h2', 'h2', 'h3', 'h4'))}>{self.own(1, 9)}</{h}>"
        if form < 0.86:
            t = self.some("ul", "ul", "ol")
            return f"<{t}>" + "".join(f"<li>{self.own(2, 18)}" + self.some("</li>", "</li>", "") for _ in range(self.r.randint(2, 6))) + f"</{t}>"
        if form < 0.9:
            return f"<blockquote>{self.some('', '<p>')}{self.own(5, 40)}</blockquote>"
        if form < 0.93:
            return f"<figure><img src=i.png><figcaption>{self.own(2, 12)}</figcaption></figure>"
        if form < 0.95:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.own(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(self.r.randint(2, 4))) + "</table>"
        return self.some(f"<pre>{self.own(3, 25)}</pre>", f"<div>{self.own(8, 60)}</div>", f"<section><p>{self.own(10, 50)}</p></section>")

    def extra(self, kind: str) -> str:
        """A part that is never main text."""
        t = "div" if self.family in ("bare", "table", "named") else self.some("div", "div", "aside", "section")
        names = self.named(EXTRAS[kind]) or (f' class="{self.r.choice(EXTRAS[kind].split())}"' if self.r.random() < 0.7 else "")
        wrap = lambda x, t=t: f"<{t}{names}>{x}</{t}>"
        if kind == "ad":
            return wrap(self.some("", "<p>") + self.text(1, 40) + self.some("", f'<a href="/buy">{self.text(1, 3)}</a>'))
        if kind == "share":
            return wrap(self.links(self.r.randint(2, 5)))
        if kind == "form":
            return wrap(f"<p>{self.text(2, 14)}</p><input name=q><button>{self.text(1, 2)}</button>", "form" if self.r.random() < 0.7 else t)
        if kind == "more":
            return wrap(f"<h3>{self.text(1, 3)}</h3>{self.links(self.r.randint(2, 8))}")
        if kind == "notice":
            return wrap(f"{self.some('', '<p>')}{self.text(4, 35)} <button>{self.text(1, 2)}</button>")
        each = "".join(
            f"<{(e := self.some('li', 'div', 'article'))}{self.named('comment reply')}><{(h := self.some('b', 'h4', 'span', 'p'))}>{self.text(1, 3)}</{h}><p>{self.text(2, 60)}</p></{e}>" for _ in range(self.r.randint(1, 7))
        )
        return wrap(f"<{(h := self.some('h2', 'h3'))}>{self.text(1, 3)}</{h}>{each}", self.some("section", "div", "div"))

    def make(self) -> str:
        r = self.r
        maybe = lambda p, x: x() if r.random() < p else ""
        blocks = "".join(self.block() + maybe(0.06, lambda: self.extra(self.some("ad", "more", "form", "share", "notice"))) for _ in range(self.some(1, 1, 2, 3, 4, 6, 9, 15)))
        title = f"<h1>{self.own(2, 14)}</h1>" if r.random() < 0.85 else ""
        if title and r.random() < 0.12:
            title = f"<header>{title}</header>"
        article = self.part("main", title + blocks + maybe(0.15, lambda: self.extra(self.some("share", "more", "ad"))))
        article += maybe(0.3, lambda: self.extra("talk"))
        side = maybe(0.35, lambda: self.part("side", f"<h4>{self.text(1, 3)}</h4>{self.some('', '<p>')}{self.text(3, 45)}{maybe(0.6, lambda: self.links(4))}"))
        head = maybe(0.5, lambda: self.part("head", f"<{(d := self.some('div', 'h2', 'p'))}>{self.text(1, 6)}</{d}>"))
        menu = maybe(0.8, lambda: self.part("menu", self.links(r.randint(2, 9))))
        foot = maybe(0.85, lambda: self.part("foot", self.some("&copy; ", "", "<p>") + self.text(1, 40) + maybe(0.4, lambda: self.links(3))))
        top = maybe(0.35, lambda: self.extra(self.some("ad", "notice", "form"))) + maybe(0.1, lambda: self.extra("ad"))
        low = maybe(0.35, lambda: self.extra(self.some("more", "form", "notice", "ad")))
        if self.family == "table":
            rows = "".join(f"<tr>{x}</tr>" for x in (head, menu + article + side if r.random() < 0.5 else article + side, foot) if x)
            body = top + f"<table>{rows}</table>" + low
        else:
            inner = article + side if r.random() < 0.7 else side + article
            body = head + menu + top + (self.part("frame", inner) if r.random() < 0.45 else inner) + low + foot
        script = self.some("", "", f"<script>{self.some('go(1)', 'x=1<2;y=3', 'f(a)')}</script>", f"<style>.a{{b:c}}</style>")
        return f"<!DOCTYPE html><html><head><title>{self.text(1, 8)}</title>{script}</head><body>{body}" + self.some("</body></html>", "</body></html>", "")


def made_page(r: random.Random, families: tuple[str, ...] = tuple(FAMILIES)) -> tuple[str, set[str]]:
    """A page of one of the families, and the texts of its main blocks."""
    page = Page(r, r.choice(families))
    return page.make(), page.main
