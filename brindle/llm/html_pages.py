"""Labelled pages to train the extraction model on: a grammar of page layouts whose content is known."""

from __future__ import annotations

import random

#: How a page holds its content.
FAMILIES = ("semantic", "named", "plain", "table", "bare")
_SYLLABLES = "ba de fi go lu ma ne pi ro su ta vo ker lin mon ter sal dur".split()


class PageGrammar:
    """Draws pages as HTML in which every element has data-y="1" where it is content and "0" where it isn't."""

    def __init__(self, seed: int, families: tuple[str, ...] = FAMILIES):
        self.r = random.Random(seed)
        self.families = tuple(families)

    def name(self) -> str:
        """A class that says nothing: made up, as generated and foreign names are, on content and on anything else."""
        r = self.r
        return "-".join("".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 3))) + r.choice(("", "", "1", "_x")) for _ in range(r.randint(1, 2)))

    def words(self, low: int, high: int) -> str:
        r = self.r
        return " ".join("".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(r.randint(low, high)))

    def el(self, tag: str, y: int, inner: str, names: str = "") -> str:
        if tag in ("div", "section", "p", "ul", "td", "h2", "span") and self.r.random() < 0.25:
            names = f"{names} {self.name()}".strip()
        mark = f' {self.r.choice(("class", "id"))}="{names}"' if names else ""
        return f'<{tag}{mark} data-y="{y}">{inner}</{tag}>'

    def link(self, y: int) -> str:
        return self.el("a", y, self.words(1, 3))

    def inline(self, y: int, low: int = 5, high: int = 60) -> str:
        r, out = self.r, self.words(low, high)
        for tag in r.sample(("b", "i", "em", "strong", "span", "code", "a", "small", "br"), r.randint(0, 2)):
            out += f' <br data-y="{y}">' if tag == "br" else " " + self.el(tag, y, self.words(1, 4 if tag == "a" else 30))
            out += " " + self.words(1, 8)
        return out

    def content_block(self) -> str:
        r = self.r
        kind = r.choice("p p p p p b h ul ol quote pre table figure div nested dl short pb".split())
        if kind == "p":
            return self.el("p", 1, self.inline(1, 3, 80))
        if kind == "short":
            return self.el("p", 1, self.words(1, 3))
        if kind == "b":
            return self.el("p", 1, self.el("b", 1, self.words(5, 60)))
        if kind == "pb":
            return f'<p data-y="1"><b data-y="1">{self.words(4, 40)}<br data-y="1"><p data-y="1">{self.words(4, 60)}</p>'
        if kind == "h":
            return self.el(r.choice(("h2", "h3", "h4")), 1, self.words(1, 7))
        if kind in ("ul", "ol"):
            return self.el(kind, 1, "".join(self.el("li", 1, self.inline(1, 1, 25)) for _ in range(r.randint(1, 6))))
        if kind == "quote":
            return self.el("blockquote", 1, self.el("p", 1, self.inline(1)) if r.random() < 0.5 else self.inline(1))
        if kind == "pre":
            return self.el("pre", 1, self.el("code", 1, self.words(3, 30)))
        if kind == "table":
            cells = lambda tag: "".join(self.el(tag, 1, self.words(1, 4)) for _ in range(3))
            return self.el("table", 1, self.el("tr", 1, cells("th")) + "".join(self.el("tr", 1, cells("td")) for _ in range(r.randint(1, 4))))
        if kind == "figure":
            return self.el("figure", 1, '<img data-y="1">' + self.el("figcaption", 1, self.words(2, 12)))
        if kind == "dl":
            return self.el("dl", 1, "".join(self.el("dt", 1, self.words(1, 3)) + self.el("dd", 1, self.words(2, 15)) for _ in range(r.randint(1, 4))))
        if kind == "div":
            return self.el("div", 1, self.inline(1, 10, 80))
        return self.el(r.choice(("div", "section")), 1, "".join(self.el("p", 1, self.inline(1)) for _ in range(r.randint(1, 3))), r.choice(("", "", "text", "content", "body")))

    def links(self) -> str:
        return self.el("ul", 0, "".join(self.el("li", 0, self.link(0)) for _ in range(self.r.randint(2, 9))))

    def boiler(self, names: str, tag: str = "div") -> str:
        r = self.r
        kind = r.choice(("text", "p", "links", "mixed", "heads"))
        if kind == "text":
            inner = self.words(1, 40)
        elif kind == "p":
            inner = "".join(self.el("p", 0, self.inline(0, 1, 40)) for _ in range(r.randint(1, 3)))
        elif kind == "links":
            inner = self.links()
        elif kind == "mixed":
            inner = self.words(1, 12) + " " + self.link(0) + " " + self.words(1, 5)
        else:
            inner = self.el(r.choice(("h2", "h3", "h4")), 0, self.words(1, 4)) + (self.links() if r.random() < 0.5 else self.el("p", 0, self.words(2, 30)))
        return self.el(tag, 0, inner, names)

    def form(self) -> str:
        inner = self.el("label", 0, self.words(1, 3)) + '<input data-y="0">' + (self.el("p", 0, self.words(2, 20)) if self.r.random() < 0.5 else self.words(0, 6))
        return self.el("form", 0, inner, self.r.choice(("", "search", "login", "newsletter", "signup")))

    def comments(self) -> str:
        r = self.r
        one = lambda: self.el(r.choice(("div", "div", "li", "li", "article")), 0, self.el("p", 0, self.inline(0, 2, 50)), r.choice(("comment", "reply", "comment body")))
        return self.el(r.choice(("div", "section")), 0, self.el("h3", 0, self.words(1, 3)) + "".join(one() for _ in range(r.randint(1, 4))), r.choice(("comments", "discussion", "respond", "comment list")))

    def any_boiler(self) -> str:
        r = self.r
        kind = r.choice("nav nav aside footer header ad ad notice form share related comments popup meta".split())
        named = {
            "nav": (("nav", ""), ("div", "nav"), ("div", "menu"), ("div", "navbar"), ("ul", "menu"), ("nav", "breadcrumb"), ("div", "breadcrumbs"), ("div", "pagination"), ("menu", "")),
            "aside": (("aside", ""), ("div", "sidebar"), ("aside", "widget"), ("div", "side widget")),
            "footer": (("footer", ""), ("div", "footer"), ("footer", "copyright"), ("div", "legal disclaimer")),
            "header": (("header", ""), ("div", "header"), ("div", "masthead"), ("header", "banner")),
            "ad": (("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "advertisement"), ("aside", "promo"), ("div", "sponsored"), ("section", "banner ad"), ("p", "ad"), ("div", "sponsor")),
            "notice": (("div", "cookie consent"), ("div", "cookie notice"), ("div", "notice"), ("div", "alert"), ("section", "gdpr consent"), ("p", "notice"), ("div", "disclaimer")),
            "share": (("div", "share"), ("div", "social"), ("ul", "social share")),
            "related": (("div", "related"), ("section", "recommended"), ("div", "related widget")),
            "popup": (("div", "popup"), ("dialog", ""), ("div", "modal"), ("div", "newsletter subscribe")),
            "meta": (("div", "tags"), ("div", "toolbar"), ("div", "login"), ("div", "search")),
        }
        if kind == "form":
            return self.form()
        if kind == "comments":
            return self.comments()
        tag, names = r.choice(named[kind])
        if tag == "ul":
            return self.el("ul", 0, "".join(self.el("li", 0, self.link(0)) for _ in range(r.randint(2, 6))), names)
        if kind == "nav":
            return self.el(tag, 0, self.links() if r.random() < 0.7 else " ".join(self.link(0) for _ in range(r.randint(2, 6))), names)
        if tag == "p":
            return self.el("p", 0, self.words(2, 30), names)
        return self.boiler(names, tag)

    def page(self) -> str:
        r = self.r
        title = self.el("h1", 1, self.words(2, 12))
        parts = [title] if r.random() < 0.8 else []
        parts += [self.content_block() for _ in range(r.choice((1, 1, 2, 3, 5, 8, 14, 30)))]
        for _ in range(r.choice((0, 0, 1, 2))):  # notices, adverts and forms inside the article
            parts.insert(r.randint(0, len(parts)), self.any_boiler())
        family = r.choice(self.families + tuple(f for f in self.families if f == "semantic"))
        around, after = ([self.any_boiler() for _ in range(r.randint(0, 4))] for _ in range(2))
        if family == "semantic":
            main = self.el(*(lambda t, n: (t, 1, "".join(parts), n))(*r.choice((("article", ""), ("article", ""), ("article", "post"), ("main", ""), ("main", "content"), ("section", "story")))))
        elif family == "named":
            main = self.el("div", 1, "".join(parts), r.choice(("content", "article body", "post entry", "entry content", "main text")))
        elif family == "plain":
            main = self.el(r.choice(("div", "section")), 1, "".join(parts), r.choice(("", self.name())))
            for _ in range(r.randint(0, 2)):
                main = self.el("div", 1, main + (self.any_boiler() if r.random() < 0.3 else ""), r.choice(("", self.name())))
        elif family == "table":
            cells = [self.el("td", 0, self.links())] if r.random() < 0.7 else []
            cells.insert(r.randint(0, len(cells)), self.el("td", 1, "".join(parts), r.choice(("", "", "content"))))
            main = self.el("table", 1, self.el("tr", 1, "".join(cells)))
        else:  # straight in the body
            main = "".join(parts)
        if family in ("semantic", "named") and r.random() < 0.2:
            main = self.el(r.choice(("main", "div", "section")), 1, main + (self.any_boiler() if r.random() < 0.5 else ""), r.choice(("", "main", "content")))
        head = f"<title>{self.words(1, 5)}</title>"
        body = "".join((*around, main, *after))
        return r.choice((f'<html data-y="1"><head>{head}</head><body data-y="1">{body}</body></html>', f'<html data-y="1"><head>{head}</head><body data-y="1">{body}', f'<head>{head}{body}', body, body))
