"""Labelled pages to train the main-text model on: layouts of common site kinds, filled by a seeded generator.

Each page is a list of (block label, markup); label 1 is the article. The layouts were written by hand for
this purpose; the words are meaningless, so that only markup and the shape of text can be learned.
"""

from __future__ import annotations

import random

SYLLABLES = "ka to mi ren sol ta ve lor in esh du pra el on ti ber na quo sta er".split()


class Maker:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def word(self) -> str:
        return "".join(self.rng.choice(SYLLABLES) for _ in range(self.rng.randint(1, 4)))

    def words(self, a: int, b: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(a, b)))

    def sentence(self) -> str:
        return self.words(3, 18).capitalize() + self.rng.choice(("." * 8) + "?!")

    def text(self, a: int, b: int) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.randint(a, b)))

    def pick(self, *options: str) -> str:
        return self.rng.choice(options)

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def links(self, a: int, b: int) -> str:
        return "".join(f'<li><a href="/{self.word()}">{self.words(1, 3)}</a></li>' for _ in range(self.rng.randint(a, b)))

    # Parts around the article.
    def menu(self) -> str:
        inner = f"<ul>{self.links(3, 9)}</ul>"
        plain = "".join(f'<a href="/{self.word()}">{self.word()}</a> ' for _ in range(self.rng.randint(3, 8)))
        inner = self.pick(inner, plain)
        return self.pick(f"<nav>{inner}</nav>", f'<div class="{self.pick("menu", "navbar", "nav", "breadcrumb", "top-menu")}">{inner}</div>', f'<div id="{self.pick("nav", "menu")}">{inner}</div>')

    def header(self) -> str:
        inner = self.pick(*(f"<{t}>{self.words(1, 4)}</{t}>" for t in ("h1", "div", "p"))) + self.pick("", f"<p>{self.sentence()}</p>")
        return self.pick(f"<header>{inner}</header>", f'<div class="{self.pick("header", "site-header", "masthead", "banner")}">{inner}</div>', f'<div id="header">{inner}</div>')

    def footer(self) -> str:
        inner = self.pick("&copy; 2020 ", "Copyright ", "") + self.words(1, 4) + self.pick("", " &middot; " + self.text(1, 3), f"<p>{self.text(1, 2)}</p><ul>{self.links(2, 5)}</ul>")
        return self.pick(f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", f'<div class="{self.pick("footer", "site-footer", "copyright", "legal")}">{inner}</div>', f'<div id="footer">{inner}</div>')

    def advert(self) -> str:
        kind = self.pick("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "banner-ad", "sponsor")
        inner = self.pick(self.text(1, 3), f'<a href="http://{self.word()}.example">{self.text(1, 2)}</a>', f"<p>{self.text(1, 3)}</p>")
        return self.pick(f'<div class="{kind}">{inner}</div>', f'<div id="{kind}">{inner}</div>', f'<aside class="{kind}">{inner}</aside>')

    def sidebar(self) -> str:
        inner = self.pick(f"<h3>{self.words(1, 3)}</h3><ul>{self.links(2, 8)}</ul>", f"<h4>{self.words(1, 3)}</h4><p>{self.text(1, 3)}</p>", f"<p>{self.text(1, 4)}</p>")
        return self.pick(f"<aside>{inner}</aside>", f"<aside>{inner}</aside>", f'<div class="{self.pick("sidebar", "widget", "related", "side", "recommended", "more-stories")}">{inner}</div>', f'<div id="sidebar">{inner}</div>')

    def notice(self) -> str:
        kind = self.pick("cookie", "cookie-notice", "cookie-banner", "notice", "consent", "gdpr", "alert", "popup", "newsletter", "modal")
        inner = self.pick(f"<p>{self.text(1, 3)}</p><button>{self.words(1, 2)}</button>", f"<p>{self.text(1, 3)}</p>", self.text(1, 3))
        return self.pick(f'<div class="{kind}">{inner}</div>', f'<div id="{kind}">{inner}</div>', f'<div class="{kind}" role="{self.pick("dialog", "alert", "banner")}">{inner}</div>')

    def form(self) -> str:
        return f'<form action="/{self.word()}">' + self.pick(f"<label>{self.words(1, 3)}</label><input name=q>", f"<p>{self.sentence()}</p><input type=text>", f"<select><option>{self.words(1, 2)}</option><option>{self.words(1, 2)}</option></select>") + f"<button>{self.word()}</button></form>"

    def comments(self) -> str:
        kind = self.pick("comments", "comment-list", "comment", "discussion", "responses", "reader-comments", "replies")
        entry = "".join(
            self.pick(f"<p>{self.text(1, 3)}</p>", f'<div class="comment"><b>{self.word()}</b><p>{self.text(1, 4)}</p></div>', f"<li><p>{self.text(1, 4)}</p></li>", f'<article class="comment"><p>{self.text(1, 4)}</p></article>')
            for _ in range(self.rng.randint(1, 5))
        )
        head = self.pick("", f"<h3>{self.words(1, 3)}</h3>", f"<h2>{self.words(1, 2)}</h2>")
        return self.pick(f'<div class="{kind}">{head}{entry}</div>', f'<section class="{kind}">{head}{entry}</section>', f'<section id="{kind}">{head}{entry}</section>', f'<div id="{kind}">{head}{entry}</div>')

    # The article.
    def paragraph(self) -> str:
        body = self.text(1, 6)
        if self.chance(0.2):
            body = f"<b>{body}</b>"
        elif self.chance(0.2):
            body += f' <a href="/{self.word()}">{self.words(1, 3)}</a> {self.sentence()}'
        elif self.chance(0.15):
            body = self.words(1, 3).capitalize() + "."
        elif self.chance(0.1):
            body = " ".join(self.word() + self.pick("***", "%%%", "$$$", "!!", " |") for _ in range(self.rng.randint(5, 40)))
        return self.pick(f"<p>{body}</p>", f"<p>{body}</p>", f"<p>{body}<br>{self.sentence()}</p>", f"<p>{body}")

    def article(self) -> list[str]:
        parts = [self.pick(f"<h1>{self.words(2, 10)}</h1>", f"<h2>{self.words(2, 8)}</h2>", "")]
        for _ in range(self.rng.randint(1, 9)):
            parts.append(self.paragraph())
            if self.chance(0.12):
                parts.append(self.pick(f"<h2>{self.words(1, 5)}</h2>", f"<h3>{self.words(1, 5)}</h3>"))
            if self.chance(0.08):
                parts.append("<ul>" + "".join(f"<li>{self.sentence()}</li>" for _ in range(self.rng.randint(2, 5))) + "</ul>")
            if self.chance(0.06):
                parts.append(f"<blockquote><p>{self.text(1, 3)}</p></blockquote>")
            if self.chance(0.05):
                parts.append(f"<pre>{self.words(4, 15)}</pre>")
            if self.chance(0.04):
                parts.append(f"<table><tr><td>{self.words(1, 3)}</td><td>{self.words(1, 4)}</td></tr></table>")
        return parts

    def page(self) -> list[tuple[int, str]]:
        """(label, markup) pieces; joined they are a page. Label -1: markup without text of its own."""
        before = [self.menu, self.header, self.advert, self.notice, self.form, self.sidebar]
        after = [self.footer, self.comments, self.sidebar, self.advert, self.form, self.notice]
        out = [(-1, "<!DOCTYPE html><html><head><title>x</title><style>p{a:b}</style></head><body>")]
        if self.chance(0.3):
            out.append((-1, self.pick('<div id="page">', '<div class="wrapper">', '<div class="container">')))
        out += [(0, f()) for f in self.rng.sample(before, self.rng.randint(0, 4))]
        opening, closing = self.rng.choice(
            [("<article>", "</article>")] * 4 + [("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="content">', "</div>"), ('<div class="post-body">', "</div>"), ('<div class="article">', "</div>"), ('<div class="entry-content">', "</div>"), ("<div>", "</div>"), ("<section>", "</section>")]
        )
        out.append((-1, opening))
        for part in self.article():
            out.append((1, part))
            if self.chance(0.08):
                out.append((0, self.rng.choice([self.advert, self.sidebar, self.notice, self.form])()))
        if self.chance(0.15):
            out.append((0, self.comments()))
        out.append((-1, closing))
        out += [(0, f()) for f in self.rng.sample(after, self.rng.randint(0, 4))]
        return [*out, (-1, "</body></html>")]


def labelled_pages(n: int, seed: int = 11) -> list[list[tuple[int, str]]]:
    maker = Maker(seed)
    return [maker.page() for _ in range(n)]
