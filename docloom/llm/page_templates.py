"""Labelled pages that the extraction model is trained on: invented sites of varied structure.

Content and other parts are marked by the class words label-content and label-other, which the
trainer takes away again. Texts are invented words, so no language is learned.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

SYLLABLES = "ka lo mi ren ta su vel dor an ei pro ser ti un ga ble sho mar ez ic".split()


class Site:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choices(SYLLABLES, k=self.r.choice((1, 1, 2, 2, 3, 4))))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self) -> str:
        return self.words(3, 16).capitalize() + self.r.choice(("", "", ", " + self.words(2, 6))) + self.r.choice("....!?")

    def prose(self, low: int = 1, high: int = 6) -> str:
        parts = [self.sentence() for _ in range(self.r.randint(low, high))]
        if self.r.random() < 0.25:
            parts.insert(0, self.r.choice(("<b>{}</b>", "<em>{}</em>", "<strong>{}</strong>", '<a href="/x">{}</a>')).format(self.words(1, 4)))
        if self.r.random() < 0.05:
            parts = [self.word().capitalize() + "."]
        return " ".join(parts)

    def links(self, low: int, high: int, item: str = "<li>{}</li>") -> str:
        return "".join(item.format(f'<a href="/{self.word()}">{self.words(1, 3)}</a>') for _ in range(self.r.randint(low, high)))

    def one(self, *choices: str) -> str:
        return self.r.choice(choices)

    def chance(self, p: float, made: str) -> str:
        return made if self.r.random() < p else ""

    def named(self, tag: str, names: str, inner: str, p: float = 0.85) -> str:
        name = self.r.choice(names.split())
        attr = self.r.choice(("class", "class", "id")) if self.r.random() < p else None
        return f'<{tag} {attr}="{name} label-other">{inner}</{tag}>' if attr == "class" else f'<{tag} id="{name} label-other">{inner}</{tag}>' if attr else f'<{tag} class="label-other">{inner}</{tag}>'

    def menu(self) -> str:
        inner = f"<ul>{self.links(3, 9)}</ul>" if self.r.random() < 0.7 else self.links(3, 9, "{} ")
        return self.r.choice((lambda: f'<nav class="label-other">{inner}</nav>', lambda: self.named("div", "nav menu navbar breadcrumb", inner), lambda: self.named("ul", "menu nav breadcrumb", self.links(3, 8))))()

    def banner(self) -> str:
        inner = self.one(f"<h1>{self.words(1, 4)}</h1>", f"<h1>{self.words(1, 4)}</h1><p>{self.words(2, 8)}</p>", f"<p>{self.prose(1, 2)}</p>", f'<a href="/">{self.words(1, 2)}</a>') + self.chance(0.3, self.menu())
        return self.one(f'<header class="label-other">{inner}</header>', self.named("div", "header masthead banner", inner))

    def footer(self) -> str:
        inner = self.one(f"&copy; {self.words(1, 3)}. {self.prose(1, 2)}", f"<p>&copy; 2020 {self.words(1, 4)}</p><ul>{self.links(2, 6)}</ul>", f"{self.word()}.example &middot; {self.prose(1, 3)}")
        return self.one(f'<footer class="label-other">{inner}</footer>', f'<footer class="label-other">{inner}</footer>', self.named("div", "footer copyright legal", inner))

    def sidebar(self) -> str:
        inner = f"<h3>{self.words(1, 3)}</h3>" + self.one(f"<ul>{self.links(2, 8)}</ul>", f"<p>{self.prose(1, 3)}</p>")
        return self.one(f'<aside class="label-other">{inner}</aside>', self.named("div", "sidebar side widget related recommended", inner), self.named("section", "related more recommended sidebar", inner))

    def advert(self) -> str:
        return self.named("div", "ad ads advert sponsored promo banner advertisement", self.one(self.prose(1, 2), f"<p>{self.prose(1, 2)}</p>", f'<a href="/ad">{self.words(2, 6)}</a>'), 1.0)

    def notice(self) -> str:
        inner = self.one(self.prose(1, 2), f"<p>{self.prose(1, 3)}</p>") + self.chance(0.5, "<button>OK</button>")
        return self.named(self.one("div", "div", "section", "dialog"), "cookie cookies consent notice popup modal alert gdpr", inner, 1.0)

    def form(self) -> str:
        inner = f"<label>{self.words(1, 3)}</label><input name=q>" + self.chance(0.6, f"<p>{self.prose(1, 2)}</p>") + "<button>Go</button>"
        made = f'<form class="label-other" action="/s">{inner}</form>'
        return self.one(made, self.named("div", "newsletter subscribe signup login search", self.one(inner, made, f"<p>{self.prose(1, 3)}</p>"), 1.0))

    def comments(self) -> str:
        each = "".join(self.one(f'<div class="comment"><p>{self.prose(1, 3)}</p></div>', f"<li><b>{self.word()}</b> <p>{self.prose(1, 3)}</p></li>", f"<article><p>{self.prose(1, 3)}</p></article>") for _ in range(self.r.randint(1, 5)))
        return self.named(self.one("div", "section", "ol"), "comments comments comment discussion replies respond", f"<h2>{self.words(1, 2)}</h2>{each}", 1.0)

    def share(self) -> str:
        return self.named("div", "share social toolbar tags pagination", self.links(2, 5, "{} "), 1.0)

    def paragraph(self) -> str:
        kind = self.r.random()
        if kind < 0.72:
            return f"<p>{self.prose()}</p>"
        if kind < 0.8:
            return f"<p><b>{self.words(3, 14)}.<br>" + self.chance(0.5, f"<p>{self.prose()}")
        if kind < 0.86:
            return f"<h{self.r.choice('234')}>{self.words(1, 6)}</h2>"
        if kind < 0.91:
            return f"<ul>{''.join(f'<li>{self.prose(1, 2)}</li>' for _ in range(self.r.randint(1, 5)))}</ul>"
        if kind < 0.94:
            return f"<blockquote><p>{self.prose()}</p></blockquote>"
        if kind < 0.96:
            return f"<table><tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr></table>"
        if kind < 0.98:
            return f"<pre>{self.words(3, 20)}</pre>"
        return f"<figure><img src=x><figcaption>{self.prose(1, 1)}</figcaption></figure>"

    def article(self) -> str:
        parts = [self.paragraph() for _ in range(self.r.choice((1, 1, 2, 3, 5, 8, 13)))]
        for made, p in ((self.advert, 0.15), (self.share, 0.12), (self.sidebar, 0.08), (self.form, 0.12), (self.notice, 0.08), (self.menu, 0.05), (self.banner, 0.1)):
            if self.r.random() < p:
                parts.insert(self.r.randint(0, len(parts)), made())
        title = f"<h1>{self.words(1, 10)}</h1>"
        inner = self.chance(0.85, title) + "".join(parts) + self.chance(0.1, self.comments()) + self.chance(0.04, self.footer())
        tag = self.one("article", "article", "article", "main", "div", "div", "section")
        name = self.one("content", "post", "entry", "article", "story", "main", "body", "text")
        bare = tag in ("article", "main") and self.r.random() < 0.7
        made = f'<{tag} class="{"" if bare else name} label-content">{inner}</{tag}>'
        return f'<main class="label-content">{made}</main>' if tag == "article" and self.r.random() < 0.15 else made

    def page(self) -> str:
        before = [f() for f, p in ((self.banner, 0.5), (self.menu, 0.8), (self.notice, 0.3), (self.advert, 0.5), (self.form, 0.15), (self.sidebar, 0.15)) if self.r.random() < p]
        after = [f() for f, p in ((self.comments, 0.35), (self.sidebar, 0.3), (self.share, 0.2), (self.form, 0.2), (self.advert, 0.2), (self.notice, 0.15), (self.menu, 0.1), (self.footer, 0.85)) if self.r.random() < p]
        inner = "".join(before) + self.article() + "".join(after)
        if self.r.random() < 0.3:
            inner = f'<div class="{self.one("page", "wrapper", "container", "site")}">{inner}</div>'
        return f'<!DOCTYPE html><html lang="x"><head><title>{self.words(2, 5)}</title></head><body>{inner}' + self.chance(0.9, "</body></html>")


def pages(count: int = 900) -> Iterator[str]:
    return (Site(seed).page() for seed in range(count))
