"""Invented pages with known main text, on which the block labeller is trained."""

from __future__ import annotations

import random

SYLLABLES = "an ar be co da de di el en er es fo ha in ka la li ma mo na ne no on or pa re ri ro sa se si so ta te ti to un ve vi za".split()
MENU = "home about contact news sports login register search archive privacy imprint sitemap products help".split()
NOTICES = ["we use cookies to improve this site", "accept all cookies", "subscribe to our newsletter", "sign up for updates", "please enable notifications"]


class Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.main: set[str] = set()

    def words(self, lo: int, hi: int) -> str:
        r = self.r
        kind = r.random()
        out = ["".join(r.choices(SYLLABLES, k=r.randint(1, 3))) for _ in range(r.randint(lo, hi))]
        if kind < 0.08:
            out = [w.upper() + "!!" for w in out]
        elif kind < 0.14:
            out = [w + r.choice(["***", "###", "$$$"]) for w in out]
        elif kind < 0.2:
            out = [w for w in out[: max(1, len(out) // 5)] for _ in range(5)]
        out[0] = out[0].capitalize()
        return " ".join(out) + r.choice([".", ".", ".", "", "?"])

    def keep(self, lo: int, hi: int) -> str:
        text = self.words(lo, hi)
        self.main.add(text)
        return text

    def links(self, n: int) -> str:
        r = self.r
        return "".join(f'<li><a href="/{i}">{r.choice(MENU) if r.random() < 0.5 else self.words(1, 2)}</a></li>' for i in range(n))

    def div(self, name: str, body: str, tags: str = "div div section aside") -> str:
        r = self.r
        tag = r.choice(tags.split())
        attribute = r.choice(["class", "class", "id"])
        return f'<{tag} {attribute}="{name}">{body}</{tag}>'

    def paragraphs(self, n: int) -> list[str]:
        r, out = self.r, []
        for _ in range(n):
            k = r.random()
            if k < 0.68:
                out.append(f"<p>{self.keep(4, 60)}</p>")
            elif k < 0.74:
                out.append(f"<p><b>{self.keep(4, 50)}<br><p>{self.keep(4, 50)}</p>")
            elif k < 0.80:
                out.append(f"<h{(h := r.randint(2, 4))}>{self.keep(2, 8)}</h{h}>")
            elif k < 0.86:
                tag = r.choice(["ul", "ol"])
                out.append(f"<{tag}>" + "".join(f"<li>{self.keep(2, 14)}</li>" for _ in range(r.randint(2, 5))) + f"</{tag}>")
            elif k < 0.90:
                out.append(f"<blockquote>{self.keep(5, 25)}</blockquote>")
            elif k < 0.93:
                out.append("<table>" + "".join(f"<tr><td>{self.keep(1, 4)}</td><td>{self.keep(1, 4)}</td></tr>" for _ in range(2)) + "</table>")
            elif k < 0.95:
                out.append(f"<pre>{self.keep(3, 20)}</pre>")
            elif k < 0.97:
                out.append(f"<figure><img src='x'><figcaption>{self.keep(3, 10)}</figcaption></figure>")
            else:
                out.append(f"<div>{self.keep(4, 40)}</div>")
        return out

    def clutter(self) -> str:
        """Something that is not main text, and may stand in the middle of it."""
        r = self.r
        k = r.randrange(9)
        if k == 0:
            return self.div(r.choice(["ad", "ads", "advert", "advertisement", "ad-banner", "sponsored", "promo", "banner"]), self.words(3, 20))
        if k == 1:
            return self.div(r.choice(["notice", "cookie-notice", "cookie-banner", "cookies", "consent", "alert", "popup", "modal"]), f"<p>{r.choice(NOTICES) if r.random() < 0.5 else self.words(3, 18)}</p><button>{self.words(1, 2)}</button>")
        if k == 2:
            return self.div(r.choice(["sidebar", "side", "widget", "related", "related-posts", "recommended", "trending", "popular"]), f"<h3>{self.words(1, 4)}</h3><ul>{self.links(r.randint(2, 6))}</ul>" + (f"<p>{self.words(4, 20)}</p>" if r.random() < 0.5 else ""))
        if k == 3:
            return f"<form action='/x'><label>{self.words(1, 3)}</label><input name='q'><select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select><button>{self.words(1, 2)}</button></form>"
        if k == 4:
            return self.div(r.choice(["share", "social", "share-buttons", "breadcrumbs", "breadcrumb", "pagination", "pager", "tags", "toolbar"]), f"<a href='#'>{self.words(1, 2)}</a> <a href='#'>{self.words(1, 3)}</a>")
        if k == 5:
            return self.div(r.choice(["newsletter", "subscribe", "signup", "subscription"]), f"<p>{r.choice(NOTICES)}</p><form><input><button>{self.words(1, 2)}</button></form>")
        if k == 6:
            return f"<aside>{r.choice(['', '<h4>' + self.words(1, 4) + '</h4>'])}<p>{self.words(4, 30)}</p></aside>"
        if k == 7:
            return f"<nav><a href='/a'>{self.words(1, 2)}</a> | <a href='/b'>{self.words(1, 2)}</a></nav>"
        return f'<div class="{r.choice(["ad", "advertisement", "sponsor"])}">{self.words(2, 12)}</div>'

    def comments(self) -> str:
        r = self.r
        each = r.choice(["comment", "comment-body", "reply", "user-comment"])
        body = "".join(f'<div class="{each}"><b>{self.words(1, 2)}</b><p>{self.words(3, 40)}</p></div>' for _ in range(r.randint(1, 5)))
        if r.random() < 0.3:
            body = "<ol>" + "".join(f'<li class="{each}"><p>{self.words(3, 40)}</p></li>' for _ in range(r.randint(1, 5))) + "</ol>"
        return self.div(r.choice(["comments", "comment-list", "responses", "discussion", "disqus_thread", "reader-comments", "replies"]), f"<h3>{self.words(1, 3)}</h3>{body}")

    def plain_name(self) -> str:
        """A class name that says nothing: utility or generated."""
        r = self.r
        k = r.random()
        if k < 0.3:
            return "".join(r.choices(SYLLABLES, k=r.randint(1, 3)))
        if k < 0.65:
            return " ".join(r.choices("flex grid row col wrap box px mt mb w max mx auto text lg md sm block inner outer container".split(), k=r.randint(1, 4)))
        return f"css-{r.randrange(16**6):06x}"

    def chrome(self, where: str) -> str:
        """What stands around an article, in elements whose names say little: a menu, a heading, a foot."""
        r = self.r
        if where == "menu":
            sep = r.choice(["", " ", " | ", "<br>"])
            links = sep.join(f'<a href="/{i}">{r.choice(MENU) if r.random() < 0.5 else self.words(1, 2)}</a>' for i in range(r.randint(2, 8)))
            return links if r.random() < 0.6 else f"<ul>{self.links(r.randint(2, 8))}</ul>"
        if where == "top":
            return f"<a href='/'>{self.words(1, 3)}</a>" + (f"<span>{self.words(1, 6)}</span>" if r.random() < 0.5 else "")
        own = f"{r.choice(['&copy;', '(c)', 'Copyright'])} {r.choice(['', '2019 ', '2024 '])}{self.words(1, 4)}"
        return own + (f" <a href='/p'>{r.choice(MENU)}</a>" if r.random() < 0.5 else f" &middot; {self.words(1, 10)}" if r.random() < 0.6 else "")

    def article(self, title: str, lead: str = "<h1>{}</h1>") -> str:
        self.main.add(title)
        inside = self.paragraphs(self.r.randint(2, 12))
        if self.r.random() < 0.3:
            inside.insert(self.r.randint(0, len(inside)), self.clutter())
        return lead.format(title) + "".join(inside)

    def table_page(self, title: str) -> str:
        """A page laid out by a table: menu cells, an article cell, a foot row."""
        r = self.r
        cells = [f"<td {r.choice(['width=150', 'valign=top', 'class=left', ''])}>{self.chrome('menu')}</td>", f"<td>{self.article(title, r.choice(['<h1>{}</h1>', '<h2>{}</h2>', '<b>{}</b><br>']))}</td>"]
        if r.random() < 0.2:
            cells.reverse()
        top = f"<tr><td colspan=2>{self.chrome('top')}</td></tr>" if r.random() < 0.6 else ""
        foot = f"<tr><td colspan=2>{r.choice(['', '<hr>', '<font size=1>'])}{self.chrome('foot')}</td></tr>" if r.random() < 0.8 else ""
        return f"<table {r.choice(['border=0', 'width=100%', 'cellpadding=4'])}>{top}<tr>{''.join(cells)}</tr>{foot}</table>"

    def wiki_page(self, title: str) -> str:
        """An encyclopedia's page: contents box, edit links, categories, tools at the side."""
        r, system = self.r, self.r.choice(["mw", "wiki", "doku", "page"])
        parts = []
        for k in range(r.randint(1, 4)):
            if k:
                parts.append(f"<h2><span class='{system}-headline'>{self.keep(1, 4)}</span>" + (f"<span class='{system}-editsection'></span>" if r.random() < 0.5 else "") + "</h2>")
            parts += [f"<p>{self.keep(6, 60)}</p>" for _ in range(r.randint(1, 4))]
            if r.random() < 0.3:
                parts.append("<ul>" + "".join(f"<li>{self.keep(2, 14)}</li>" for _ in range(r.randint(2, 4))) + "</ul>")
        if r.random() < 0.5:
            parts.insert(1, f"<div id='toc' class='toc'><h2>Contents</h2><ul>{self.links(r.randint(2, 5))}</ul></div>")
        self.main.add(title)
        head = f"<h1 id='{r.choice(['firstHeading', 'title', 'top'])}'>{title}</h1>"
        body = f"<div class='{system}-{r.choice(['parser-output', 'body', 'text', 'content'])}'>{''.join(parts)}</div>"
        tags = f"<div id='catlinks' class='catlinks'><a href='/c'>Categories</a>: <ul>{self.links(r.randint(1, 3))}</ul></div>" if r.random() < 0.6 else ""
        side = f"<div id='{system}-{r.choice(['navigation', 'panel', 'tools', 'head'])}'><h3>{self.words(1, 2)}</h3><ul>{self.links(r.randint(3, 8))}</ul></div>"
        foot = f"<div id='footer'><ul><li>{self.words(5, 14)}</li><li><a href='/p'>{r.choice(MENU)}</a></li></ul></div>" if r.random() < 0.7 else ""
        page = f"<div id='content' class='{system}-body'>{head}<div id='bodyContent'>{body}{tags}</div></div>"
        return side + page + foot if r.random() < 0.5 else page + side + foot

    def bare_page(self, title: str) -> str:
        """Divisions without telling names, or no division at all."""
        r = self.r
        named = lambda x, tags="div div div section": self.div(self.plain_name(), x, tags)
        wrap = named if r.random() < 0.75 else (lambda x: f"{x}{r.choice(['<hr>', ''])}")
        parts = [wrap(self.chrome("top"))] * (r.random() < 0.5) + [wrap(self.chrome("menu"))] * (r.random() < 0.8)
        if r.random() < 0.2:
            self.main.add(title)
            each = self.plain_name()
            body = f"<h1>{title}</h1>" + "".join(f'<div class="{each}">{p}</div>' for p in self.paragraphs(r.randint(2, 10)))
        else:
            body = self.article(title, r.choice(["<h1>{}</h1>", "<h1>{}</h1>", "<h2>{}</h2>"]))
        for _ in range(r.randint(0, 2)):
            body = named(body)
        aside = named(f"<ul>{self.links(r.randint(2, 6))}</ul>") if r.random() < 0.3 else ""
        parts.append(wrap(body + aside if r.random() < 0.7 else aside + body))
        if r.random() < 0.25:
            parts.append(self.comments())
        if r.random() < 0.8:
            parts.append(wrap(f"<p>{self.chrome('foot')}</p>" if r.random() < 0.5 else self.chrome("foot")))
        return "".join(parts)

    def page(self) -> str:
        """A page of one of several layouts; the first, with telling names, is the most common."""
        r = self.r
        k = r.random()
        if k < 0.55:
            return self.named_page()
        title = self.words(2, 9)
        layout = self.table_page if k < 0.66 else self.wiki_page if k < 0.77 else self.bare_page
        page = f"<html><head><title>{title}</title></head><body>{layout(title)}</body></html>"
        return page[: r.randint(len(page) // 2, len(page))] if r.random() < 0.03 else page

    def named_page(self) -> str:
        r = self.r
        title = self.words(3, 9)
        head = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
        parts = []
        if r.random() < 0.35:
            parts.append(f"<header>{r.choice(['', '<h1>' + self.words(1, 3) + '</h1>'])}<p>{self.words(1, 8)}</p></header>" if r.random() < 0.6 else self.div(r.choice(["header", "masthead", "top-bar", "site-header"]), f"<p>{self.words(1, 8)}</p>"))
        if r.random() < 0.85:
            menu = f"<ul>{self.links(r.randint(2, 9))}</ul>"
            parts.append(f"<nav>{menu}</nav>" if r.random() < 0.65 else self.div(r.choice(["menu", "nav", "navbar", "main-menu", "navigation"]), menu, "div ul"))
        parts += [self.clutter() for _ in range(r.choice([0, 0, 1, 1, 2]))]
        inside = self.paragraphs(r.randint(0, 14))
        if r.random() < 0.75:
            self.main.add(title)
            inside.insert(0, f"<header><h1>{title}</h1></header>" if r.random() < 0.06 else f"<h1>{title}</h1>")
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            inside.insert(r.randint(0, len(inside)), self.clutter())
        if r.random() < 0.15:
            inside.append(self.comments())
        k = r.random()
        body = "".join(inside)
        if k < 0.6:
            parts.append(f"<article>{body}</article>")
        elif k < 0.72:
            parts.append(f"<main>{body}</main>")
        elif k < 0.8:
            parts.append(f"<main><article>{body}</article></main>")
        else:
            parts.append(f'<div class="{r.choice(["content", "article", "post", "entry-content", "article-body", "main", "story", "text", "post-content"])}">{body}</div>')
        if r.random() < 0.25:
            parts.append(self.comments())
        parts += [self.clutter() for _ in range(r.choice([0, 0, 1]))]
        if r.random() < 0.85:
            foot = f"&copy; {self.words(1, 2)} &middot; {self.words(2, 16)}"
            parts.append(f"<footer>{foot}</footer>" if r.random() < 0.75 else self.div(r.choice(["footer", "site-footer", "bottom", "copyright"]), foot))
        page = head + "".join(parts) + "</body></html>"
        return page[: r.randint(len(page) // 2, len(page))] if r.random() < 0.05 else page
