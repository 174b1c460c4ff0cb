"""Labelled pages to learn from: made by rule from a seed, each element marked content or not.

A page is an article (or main, or a div named like one) amid menus, headers, footers, sidebars, notices, adverts, forms and reader
comments, in orders, wrappers and names that vary with the seed; or it has no article: blocks stand in body or in nested divs without names, with or without the rest around them, or there is only text. The attribute data-content marks an element's label and is no input of the model."""

from __future__ import annotations

import random

_CONTENT = "content article post entry story main text body page single".split()
_OTHER = {
    "nav": "nav menu navigation navbar breadcrumb breadcrumbs links pagination pager".split(),
    "header": "header masthead banner top topbar branding logo hero site".split(),
    "footer": "footer copyright bottom legal credits colophon".split(),
    "aside": "sidebar aside widget related recommended trending popular tags archive".split(),
    "notice": "cookie notice consent alert gdpr popup modal overlay banner message privacy".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion".split(),
    "form": "form search login newsletter subscribe signup contact".split(),
    "comments": "comments comment reply replies discussion respond disqus thread".split(),
    "share": "share social follow meta byline author toolbar".split(),
}


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        return " ".join("".join(r.choice("aeioubcdfglmnprst") for _ in range(r.randint(1, 9))) for _ in range(r.randint(low, high)))

    def sentence(self, low: int = 4, high: int = 22) -> str:
        return self.words(low, high).capitalize() + self.r.choice("..??!.,")

    def prose(self, low: int = 1, high: int = 7) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def element(self, tag: str, label: int, inner: str, names: list[str] | None = None) -> str:
        name = ""
        if names and self.r.random() < 0.8:
            word = self.r.choice(names)
            if self.r.random() < 0.3:
                word += self.r.choice(["-wrap", "-box", "-list", "-inner", " clearfix", "-1", "_area"])
            name = f' {self.r.choice(["class", "class", "id"])}="{word}"'
        return f'<{tag}{name} data-content="{label}">{inner}</{tag}>'

    def links(self, names: list[str], tag: str | None = None) -> str:
        items = "".join(self.element("li", 0, f'<a href="/x">{self.words(1, 4)}</a>') for _ in range(self.r.randint(2, 9)))
        return self.element(tag or self.r.choice(["nav", "nav", "div", "section"]), 0, self.element(self.r.choice(["ul", "ul", "ol"]), 0, items), names)

    def other(self, kind: str) -> str:
        names, r = _OTHER[kind], self.r
        if kind == "nav":
            return self.links(names)
        if kind == "aside":
            return self.element(r.choice(["aside", "aside", "div"]), 0, self.element("h3", 0, self.words(1, 3)) + self.links(names, "div") + (self.element("p", 0, self.prose(1, 2)) if r.random() < 0.5 else ""), names)
        if kind == "form":
            return self.element("form", 0, self.element("label", 0, self.words(1, 3)) + '<input name="q">' + self.element("button", 0, self.words(1, 2)) + (self.element("p", 0, self.sentence()) if r.random() < 0.3 else ""), names)
        if kind == "comments":
            one = lambda: self.element(r.choice(["div", "li", "article"]), 0, self.element("h4", 0, self.words(1, 3)) + self.element("p", 0, self.prose(1, 4)), names)
            return self.element(r.choice(["section", "div", "ol"]), 0, self.element("h3", 0, self.words(1, 3)) + "".join(one() for _ in range(r.randint(1, 5))), names)
        text = {"header": lambda: self.words(1, 6), "footer": lambda: "&copy; " + self.prose(1, 2), "notice": lambda: self.prose(1, 3), "ad": lambda: self.prose(1, 4), "share": lambda: self.words(2, 6)}[kind]()
        tag = {"header": ["header", "header", "div"], "footer": ["footer", "footer", "div"]}.get(kind, ["div", "div", "section", "aside", "p"])
        inner = r.choice([text, self.element("p", 0, text), self.element("div", 0, text), f'<a href="/">{text}</a>'])
        return self.element(r.choice(tag), 0, inner, names)

    def content_links(self) -> str:
        """A list of links that is part of an article."""
        r = self.r
        one = lambda: self.element("li", 1, r.choice(["<a href='/z'>{}</a>", "<a href='/z'>{}</a>.", "{}: <a href='/z'>more</a>"]).format(self.words(2, 9)))
        return self.element(r.choice(["p", "h3"]), 1, self.words(1, 6).capitalize() + ":") + self.element(r.choice(["ul", "ol"]), 1, "".join(one() for _ in range(r.randint(2, 6))))

    def block(self) -> str:
        r, kind = self.r, self.r.random()
        if kind < 0.08:
            return self.content_links()
        if kind < 0.7:
            text = self.prose()
            return self.element("p", 1, f"{text} <a href='/y'>{self.words(1, 4)}</a> {self.sentence()}" if r.random() < 0.2 else text)
        if kind < 0.8:
            return self.element(r.choice(["h2", "h3"]), 1, self.words(1, 7))
        if kind < 0.87:
            return self.element(r.choice(["ul", "ol"]), 1, "".join(self.element("li", 1, self.sentence(2, 14)) for _ in range(r.randint(2, 6))))
        if kind < 0.92:
            return self.element("blockquote", 1, self.element("p", 1, self.prose(1, 3)))
        if kind < 0.95:
            return self.element("table", 1, "".join(self.element("tr", 1, "".join(self.element("td", 1, self.words(1, 3)) for _ in range(3))) for _ in range(3)))
        if kind < 0.97:
            return self.element("pre", 1, self.words(3, 20))
        return self.element("div", 1, self.prose(1, 3))

    def page(self) -> str:
        r = self.r
        blocks = [self.block() for _ in range(r.randint(1, 14))]
        for kind in r.sample(["ad", "share", "aside", "form", "nav", "notice"], r.choice([0, 0, 0, 1, 2])):
            blocks.insert(r.randint(0, len(blocks)), self.other(kind))
        if r.random() < 0.25:
            blocks.append(self.other(r.choice(["comments", "footer", "share"])))
        shape = r.random()
        if shape < 0.05:  # only text, with or without body
            text = self.prose(1, 5)
            return r.choice([f'<html data-content="1"><body data-content="1">{text}</body></html>', f'<html data-content="1">{text}</html>'])
        title = self.element(r.choice(["h1", "h1", "h2"]), 1, self.words(2, 9))
        if shape < 0.12:  # text directly in body, between few blocks
            return f'<html data-content="1"><body data-content="1">{title}{self.prose(1, 4)}{"".join(blocks[:3])}{self.prose(1, 3)}</body></html>'
        if shape < 0.4:  # blocks in body or in plain divs
            if r.random() < 0.4:
                title = ""
            main = title + "".join(blocks)
            if deep := r.choice([0, 1, 1, 2, 3]):
                if r.random() < 0.7:
                    main = title + "".join(f'<div data-content="1">{self.prose(1, 4)}</div>' for _ in range(r.randint(1, 5)))
                for _ in range(deep):
                    main = f'<div data-content="1">{main}</div>'
            around = r.choice([0, 0, 0, 1, 2])
            before = "".join(self.other(k) for k in r.sample(["header", "nav", "notice", "form"], around))
            after = "".join(self.other(k) for k in r.sample(["aside", "comments", "footer", "ad", "share"], around))
            return f'<html data-content="1"><head><title data-content="0">{self.words(2, 9)}</title></head><body data-content="1">{before}{main}{after}</body></html>'
        main = self.element(r.choice(["article", "article", "main", "div", "section"]), 1, title + "".join(blocks), _CONTENT)
        if r.random() < 0.3:
            main = self.element(r.choice(["main", "div"]), 1, main, _CONTENT)
        before = [self.other(k) for k in r.sample(["header", "nav", "notice", "ad", "form"], r.randint(1, 4))]
        after = [self.other(k) for k in r.sample(["aside", "comments", "footer", "ad", "nav", "share", "notice"], r.randint(1, 5))]
        middle = "".join([*before, main, *after])
        if r.random() < 0.3:
            middle = self.element("div", 0, middle, ["container", "wrapper", "page", "site", "layout"])
        return f'<html><head><title data-content="0">{self.words(2, 9)}</title></head><body data-content="0">{middle}</body></html>'


def labelled_page(seed: int) -> str:
    return _Maker(seed).page()
