"""Labelled pages: (html, text) where ``text`` is the main text, a line a block.

Layouts are drawn by a seeded grammar: the same kinds of parts under many
mark-ups (semantic elements, class or id words, nothing at all), so that a model
learns from them which evidence to trust when another is missing.
"""

from __future__ import annotations

import random
from html import escape

#: Pages that the default training set holds, and the seed they are drawn with.
PAGES, SEED = 600, 20250

_SYLLABLES = "ta re mi so lu ne ka vo di en or is an el um ar ité ción ung ße кра вод то 水 の 語".split()


class _Writer:
    def __init__(self, seed: int):
        self.rnd = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.rnd
        return " ".join("".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high)))

    def sentence(self, low: int = 3, high: int = 22) -> str:
        s = self.words(low, high).capitalize()
        return s + self.rnd.choice([".", ".", ".", "!", "?", ""])

    def odd(self) -> str:
        """Text that does not read like prose, in an article as anywhere."""
        r = self.rnd
        parts = [self.rnd.choice([self.words(1, 2), str(r.randrange(10**6)), "###", "$$$ ***", "A&B <x>", "http://e.example/a?b=1&c"]) for _ in range(r.randint(1, 40))]
        return r.choice([" | ", " ", " - ", ", "]).join(parts)

    def prose(self) -> str:
        if self.maybe(0.12):
            return self.odd()
        return " ".join(self.sentence() for _ in range(self.rnd.choice([1, 1, 1, 2, 3, 4, 6, 9])))

    def maybe(self, p: float) -> bool:
        return self.rnd.random() < p

    def attrs(self, words: list[str] | None, p: float = 1.0) -> str:
        """A class, id or role that names the part, or one that says nothing."""
        r = self.rnd
        if words and self.maybe(p):
            w = r.choice(words)
            w = r.choice([w, w, f"site-{w}", f"{w}-box", f"{w}Area", f"c7 {w}", f"{w} clearfix"])
            return f' {r.choice(["class", "class", "id"])}="{w}"'
        return r.choice(["", "", "", ' class="row"', ' class="c1x9"', ' id="b12"', ' class="wrapper container"', ' data-x="1"'])

    def part(self, tags: list[str], words: list[str], inner: str) -> str:
        """An element that its tag or its class gives away."""
        tag = self.rnd.choice(tags + ["div", "div"])
        return f"<{tag}{self.attrs(words, 1.0 if tag in ('div', 'section', 'p', 'span', 'ul', 'ol') else 0.5)}>{inner}</{tag}>"

    def links(self, low: int = 2, high: int = 9) -> str:
        items = [f'<a href="/{k}">{escape(self.words(1, 3))}</a>' for k in range(self.rnd.randint(low, high))]
        if self.maybe(0.7):
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return self.rnd.choice([" | ", " ", " &middot; "]).join(items)

    def plain(self) -> str:
        """Boilerplate that reads like prose."""
        return self.rnd.choice([lambda: escape(self.prose()), lambda: f"<p>{escape(self.prose())}</p>",
                                lambda: f"<h3>{escape(self.words(1, 5))}</h3><p>{escape(self.prose())}</p>"])()

    # -- parts that are not the article -------------------------------------

    def nav(self) -> str:
        if self.maybe(0.1):
            return "<div>" + self.links(4, 9) + "</div>"
        return self.part(["nav", "nav", "menu"], ["nav", "menu", "navbar", "navigation", "breadcrumbs", "submenu", "pagination"], self.links())

    def header(self) -> str:
        inner = self.rnd.choice([f'<a href="/">{escape(self.words(1, 3))}</a>', f"<h1>{escape(self.words(1, 3))}</h1>", f"<h2>{escape(self.words(1, 3))}</h2>",
                                 escape(self.sentence())])
        inner += f"<p>{escape(self.sentence())}</p>" if self.maybe(0.4) else ""
        return self.part(["header", "header", "header"], ["header", "masthead", "topbar", "banner", "logo"], inner + (self.nav() if self.maybe(0.4) else ""))

    def footer(self) -> str:
        inner = self.rnd.choice(["", "&copy; ", "&copy; 2021 ", "(c) "]) + escape(self.words(1, 3)) + self.rnd.choice(["", " &middot; ", " | "]) + escape(self.prose())
        if self.maybe(0.4):
            inner = f"<p>{inner}</p>" + (self.links() if self.maybe(0.5) else "")
        return self.part(["footer", "footer", "footer"], ["footer", "copyright", "colophon", "legal", "credits"], inner)

    def ad(self) -> str:
        return self.part(["aside"], ["ad", "ad", "ads", "advert", "advertisement", "sponsored", "promo", "sponsor", "commercial"], self.plain())

    def sidebar(self) -> str:
        inner = "".join(self.rnd.choice([self.plain, self.links, self.ad])() for _ in range(self.rnd.randint(1, 4)))
        return self.part(["aside", "aside"], ["sidebar", "side", "widget", "related", "recommended", "trending", "more"], inner)

    def notice(self) -> str:
        inner = self.plain() + (f"<button>{escape(self.words(1, 2))}</button>" if self.maybe(0.5) else "")
        if self.maybe(0.15):
            return f'<div role="{self.rnd.choice(["alert", "dialog"])}">{inner}</div>'
        if self.maybe(0.15):
            return f"<noscript>{inner}</noscript>"
        return self.part(["div"], ["cookie", "consent", "notice", "alert", "popup", "gdpr", "modal", "notification", "warning", "paywall"], inner)

    def form(self) -> str:
        inner = f"<label>{escape(self.words(1, 4))}</label><input name=q>" + (f"<p>{escape(self.sentence())}</p>" if self.maybe(0.4) else "")
        inner += f"<select><option>{escape(self.words(1, 2))}<option>{escape(self.words(1, 2))}</select>" if self.maybe(0.2) else ""
        inner += self.rnd.choice(["", "<textarea>...</textarea>"]) + f"<button>{escape(self.words(1, 2))}</button>"
        form = f"<form{self.attrs(['search', 'login', 'newsletter', 'subscribe', 'contact'], 0.4)}>{inner}</form>"
        return form if self.maybe(0.7) else self.part(["section"], ["newsletter", "search", "subscribe", "signup", "login"], form)

    def comments(self) -> str:
        def one():
            who = f"<b>{escape(self.words(1, 2))}</b> " if self.maybe(0.5) else f"<h4>{escape(self.words(1, 2))}</h4>"
            body = who + f"<p>{escape(self.prose())}</p>" * self.rnd.randint(1, 2)
            return f"<div{self.attrs(['comment', 'reply'], 0.5)}>{body}</div>" if self.maybe(0.6) else f"<li{self.attrs(['comment'], 0.5)}>{body}</li>"
        inner = (f"<h3>{escape(self.words(1, 3))}</h3>" if self.maybe(0.6) else "") + "".join(one() for _ in range(self.rnd.randint(1, 6)))
        inner += self.form() if self.maybe(0.3) else ""
        return self.part(["section"], ["comments", "comments", "responses", "discussion", "replies", "commentlist", "reviews"], inner)

    def social(self) -> str:
        return self.part(["ul"], ["share", "social", "follow", "sharing"], self.links(2, 5))

    def script(self) -> str:
        return self.rnd.choice(['<script>var a="</p><p>x";go(1<2);</script>', "<style>p{color:red}</style>", "<!-- <p>old</p> -->", ""])

    def hidden(self) -> str:
        return f'<div{self.rnd.choice([" hidden", " style=\"display: none\"", " aria-hidden=true"])}>{self.plain()}</div>'

    def junk(self) -> str:
        return self.rnd.choice([self.nav, self.ad, self.ad, self.notice, self.form, self.social, self.script, self.sidebar, self.hidden])()

    # -- the article ---------------------------------------------------------

    def block(self, lines: list[str]) -> str:
        """One block of the article; its lines are noted."""
        r, kind = self.rnd, self.rnd.random()
        text = self.prose()
        if kind < 0.62:
            lines.append(text)
            inner = escape(text, quote=self.maybe(0.3))
            if self.maybe(0.2):
                words = inner.split(" ")
                k = r.randrange(len(words))
                words[k] = r.choice(['<a href="/x">{}</a>', "<b>{}</b>", "<em class=hl>{}</em>", "<code>{}</code>"]).format(words[k])
                inner = " ".join(words)
            return r.choice([f"<p>{inner}</p>"] * 6 + [f"<p>{inner}", f"<p><b>{inner}<br>", f"<div>{inner}</div>", f'<p{self.attrs(["text", "lead", "body"], 0.5)}>\n  {inner}\n</p>'])
        if kind < 0.74:
            head = self.words(1, 7)
            lines.append(head)
            tag = r.choice(["h2", "h2", "h3", "h4"])
            return f"<{tag}>{escape(head)}</{tag}>"
        if kind < 0.84:
            items = [self.sentence(1, 14) for _ in range(r.randint(2, 6))]
            lines.extend(items)
            tag = r.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{escape(i)}" + r.choice(["", "</li>"]) for i in items) + f"</{tag}>"
        if kind < 0.90:
            lines.append(text)
            return f"<blockquote>{r.choice(['{}', '<p>{}</p>']).format(escape(text))}</blockquote>"
        if kind < 0.94:
            rows = [[self.words(1, 3) for _ in range(2)] for _ in range(r.randint(1, 4))]
            lines.extend(c for row in rows for c in row)
            return "<table>" + "".join("<tr>" + "".join(f"<td>{escape(c)}</td>" for c in row) + "</tr>" for row in rows) + "</table>"
        if kind < 0.97:
            lines.append(self.sentence())
            return f'<figure><img src="a.png"><figcaption>{escape(lines[-1])}</figcaption></figure>'
        inner = "".join(self.block(lines) for _ in range(r.randint(1, 3)))
        return f"<section{self.attrs(['text', 'content'], 0.3)}>{inner}</section>"

    def article(self, lines: list[str]) -> str:
        r = self.rnd
        out = []
        if self.maybe(0.8):
            title = self.words(1, 10)
            lines.append(title)
            out.append(r.choice([f"<h1>{escape(title)}</h1>"] * 5 + [f"<header><h1>{escape(title)}</h1></header>", f"<div class=title><h1>{escape(title)}</h1></div>"]))
        if self.maybe(0.15):  # a list of short lines, often the same ones
            line, many = self.sentence(1, 4), r.choice([3, 10, 40, 80])
            for _ in range(many):
                lines.append(line if self.maybe(0.7) else self.words(1, 4))
                out.append(f"<p>{escape(lines[-1])}</p>")
        for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8, 14])):
            out.append(self.block(lines))
            if self.maybe(0.08):
                out.append(r.choice([self.ad, self.ad, self.form, self.script, self.social, self.notice, self.sidebar])())
        if self.maybe(0.15):
            out.append(r.choice([self.social, self.comments, self.form, self.footer])())
        return "".join(out)

    def page(self) -> tuple[str, str]:
        r, lines = self.rnd, []
        inner = self.article(lines)
        shape = r.random()
        if shape < 0.45:
            body = f"<article{self.attrs(['post', 'article', 'entry'], 0.2)}>{inner}</article>"
            body = f"<main>{body}</main>" if self.maybe(0.25) else body
        elif shape < 0.55:
            body = f"<main{self.attrs(['content', 'main'], 0.3)}>{inner}</main>"
        elif shape < 0.85:
            body = f'<div{self.attrs(["content", "article", "post", "entry", "story", "main", "body"])}>{inner}</div>'
            body = f"<div{self.attrs(None)}>{body}</div>" if self.maybe(0.4) else body
        elif shape < 0.95:
            body = f"<div{self.attrs(None)}>{inner}</div>"
        else:
            body = inner
        before = [self.header] * self.maybe(0.5) + [self.nav] * self.maybe(0.7) + [self.notice] * self.maybe(0.2) + [self.ad] * self.maybe(0.5) + [self.junk] * self.maybe(0.3)
        after = [self.comments] * self.maybe(0.25) + [self.sidebar] * self.maybe(0.35) + [self.junk] * self.maybe(0.3) + [self.footer] * self.maybe(0.8)
        body = "".join(f() for f in before) + body + "".join(f() for f in after)
        if self.maybe(0.2):
            body = f"<div{self.attrs(None)}>{body}</div>"
        head = f"<head><meta charset=utf-8><title>{escape(self.words(2, 9))}</title>{self.script()}</head>"
        html = f"<!DOCTYPE html><html>{head}<body>{body}" + ("</body></html>" if self.maybe(0.8) else "")
        return html, "\n".join(" ".join(x.split()) for x in lines)


def labelled_pages(n: int = PAGES, seed: int = SEED) -> list[tuple[str, str]]:
    """``n`` pages (html, text), the same for the same seed."""
    return [_Writer(seed * 1_000_003 + k).page() for k in range(n)]
