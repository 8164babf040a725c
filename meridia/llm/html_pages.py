"""Labelled pages on which the content model is trained.

A seeded generator makes pages in many layouts. An element may carry ``data-y``: "1" for
the main text, "0" for everything around it; what stands inside inherits it. The model
never sees the attribute as a feature. Words are invented, so that only structure, names
of elements and classes, links and lengths can be learned.
"""

from __future__ import annotations

import random

_SYLLABLES = "ba den ti ro lum sek ar vo ni pel qua tis mo ren ka lor fi gu est ami".split()
_AROUND = {
    "nav": ["nav", "menu", "navbar", "site-nav", "breadcrumb", "topbar", "toolbar"],
    "header": ["header", "masthead", "site-header", "page-header", "banner"],
    "footer": ["footer", "site-footer", "copyright", "legal", "colophon", "bottom"],
    "aside": ["sidebar", "aside", "widget", "related", "recommended", "side-bar", "rail"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "ad-slot"],
    "notice": ["cookie", "cookie-notice", "notice", "consent", "alert", "popup", "modal", "overlay", "disclaimer"],
    "share": ["share", "social", "share-buttons", "follow", "tags", "pagination", "pager"],
    "form": ["newsletter", "subscribe", "signup", "login", "search", "search-form", "contact-form"],
    "comments": ["comments", "comment", "comment-list", "disqus", "replies", "reader-comments", "respond"],
}
_CONTENT = ["content", "article", "post", "entry", "story", "article-body", "post-content", "entry-content", "main-content", "text", "main", "page-content"]
_HIDDEN = ["hidden", 'style="display:none"', "style='visibility: hidden'", 'aria-hidden="true"', 'class="hidden"']


def _words(r: random.Random, low: int, high: int) -> str:
    out = ["".join(r.choices(_SYLLABLES, k=r.randint(1, 4))) for _ in range(r.randint(low, high))]
    for k in range(0, len(out), 9):
        out[k] = out[k].capitalize()
    return " ".join(out) + r.choice([".", ".", "!", "", "&amp;", " &hellip;"])


def _links(r: random.Random, n: int) -> str:
    return "<ul>" + "".join(f'<li><a href="/{k}">{_words(r, 1, 3)}</a></li>' for k in range(n)) + "</ul>"


def _name(r: random.Random, names: list[str]) -> str:
    return f'{r.choice(["class", "class", "id"])}="{r.choice(names)}{r.choice(["", "", " wide", " x1"])}"'


def _around(r: random.Random, kind: str) -> str:
    """One element that isn't main text."""
    name = _name(r, _AROUND[kind])
    if kind in ("nav", "header", "footer", "aside"):
        tag = r.choice([kind, kind, "div", "section"])
        inner = {
            "nav": lambda: _links(r, r.randint(2, 9)),
            "header": lambda: r.choice([f'<a href="/">{_words(r, 1, 3)}</a>', f"<h1>{_words(r, 1, 9)}</h1>", f'<h1><a href="/">{_words(r, 1, 6)}</a></h1>']) + r.choice(["", f"<p>{_words(r, 2, 8)}</p>"]) + r.choice(["", _links(r, 4)]),
            "footer": lambda: f"&copy; {_words(r, 2, 20)}" + r.choice(["", _links(r, 3), f"<p>{_words(r, 5, 25)}</p>"]),
            "aside": lambda: f"<h3>{_words(r, 1, 4)}</h3>" + r.choice([_links(r, 4), f"<p>{_words(r, 5, 40)}</p>"]),
        }[kind]()
        plain = tag == kind and r.random() < 0.6
        return f'<{tag} {"" if plain else name} data-y="0">{inner}</{tag}>'
    if kind == "form":
        tag = r.choice(["form", "form", "div"])
        inner = f'<label>{_words(r, 1, 4)}</label><input type="text"><button>{_words(r, 1, 2)}</button>'
        return f'<{tag} {name} data-y="0">{r.choice(["", f"<p>{_words(r, 3, 20)}</p>"])}{inner}</{tag}>'
    if kind == "comments":
        tag, each = r.choice(["div", "section"]), r.choice(["div", "li", "article"])
        some = "".join(f'<{each} class="{r.choice(["comment", "comment", "reply"])}"><b>{_words(r, 1, 2)}</b> <p>{_words(r, 3, 60)}</p></{each}>' for _ in range(r.randint(1, 5)))
        return f'<{tag} {name} data-y="0"><h3>{_words(r, 1, 3)}</h3>{some}</{tag}>'
    tag = r.choice(["div", "div", "aside", "section", "p", "span"])
    return f'<{tag} {name} data-y="0">{_words(r, 2, 35)}{r.choice(["", _links(r, 2)])}</{tag}>'


def _block(r: random.Random) -> str:
    t = lambda a=4, b=90: _words(r, a, b)
    return r.choice(
        [
            lambda: f"<p>{t()}</p>",
            lambda: f"<p>{t()}</p>",
            lambda: f"<p>{t(1, 6)}</p>",
            lambda: f"<p>{t()} <a href='/x'>{t(1, 4)}</a> {t()} <em>{t(1, 3)}</em></p>",
            lambda: f"<p><b>{t()}<br></p>",
            lambda: f"<h2>{t(1, 8)}</h2>",
            lambda: f"<ul><li>{t(2, 20)}</li><li>{t(2, 20)}</li></ul>",
            lambda: f"<blockquote><p>{t()}</p></blockquote>",
            lambda: f"<pre><code>{t(3, 30)}</code></pre>",
            lambda: f"<table><tr><td>{t(1, 6)}</td><td>{t(1, 6)}</td></tr></table>",
            lambda: f'<figure><img src="/i.png"><figcaption>{t(2, 12)}</figcaption></figure>',
            lambda: f"<div>{t()}</div>",
        ]
    )()


def labelled_page(seed: int) -> str:
    """The seed's page, with ``data-y`` marks."""
    r = random.Random(seed)
    kinds = list(_AROUND)
    outside = lambda n: "".join(_around(r, r.choice(kinds)) for _ in range(r.randint(0, n)))
    short = r.random() < 0.25  # pages of many short paragraphs: lists of sayings, dialogue, junk
    block = (lambda: f"<p>{r.choice(['', '', '<b>'])}{_words(r, 1, 5)}</p>") if short else (lambda: _block(r))
    inserted = lambda: r.choice([_around(r, r.choice(kinds[3:])), f'<{(t := r.choice(["p", "div", "span"]))} {r.choice(_HIDDEN)} data-y="0">{_words(r, 2, 40)}</{t}>'])
    title = _words(r, 2, 9)
    has_title = r.random() < 0.55
    many = r.choice([0, 1, 2, 4, 8, 16, 50] if has_title else [1, 2, 3, 4, 8, 16, 50])
    body = "".join(block() + (inserted() if r.random() < 0.1 else "") for _ in range(many))
    root, attrs = r.choice(
        [("article", ""), ("article", ""), ("article", _name(r, _CONTENT)), ("main", ""), ("main", _name(r, _CONTENT)), ("div", _name(r, _CONTENT)), ("div", _name(r, _CONTENT)), ("section", _name(r, _CONTENT)), ("td", r.choice(["", _name(r, _CONTENT)]))]
    )
    heading = r.choice([f"<h1>{title}</h1>", f"<h1>{title}</h1>", f"<header><h1>{title}</h1></header>"]) if has_title else r.choice(["", "", f"<h2>{title}</h2>"])
    main = f'<{root} {attrs} data-y="1">{heading}{body}</{root}>'
    if root == "td":  # a table that lays out the page: a cell with the menu, one with the main text
        side = lambda: f'<td {r.choice(["", _name(r, _AROUND[r.choice(["nav", "aside", "ad"])])])} data-y="0">{r.choice([_links(r, r.randint(2, 9)), _links(r, r.randint(2, 9)), _around(r, "nav")])}</td>'
        cells = r.choice([lambda: side() + main, lambda: main + side(), lambda: side() + main + side()])()
        main = f'<table data-y="0"><tr>{cells}</tr></table>'
    for _ in range(r.choice([0, 0, 1, 2])):
        tag = r.choice(["div", "section", "main"] if root == "article" else ["div", "section"])
        main = f'<{tag} {r.choice(["", _name(r, ["container", "wrap", "page", "row", "layout"])])} data-y="0">{outside(1)}{main}{outside(1)}</{tag}>'
    head = f"<head><meta charset='utf-8'><title>{title}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
    bare = r.random() < 0.15  # nothing but the main part
    top = "".join(_around(r, k) for k in r.choice([["nav"], ["nav"], ["header"], ["header", "nav"], ["nav", "header"], []]))
    first, last = ("", "") if bare else (top, _around(r, "footer") if r.random() < 0.8 else "")
    return f'<!DOCTYPE html><html>{head}<body data-y="0">{first}<!-- {title} -->{"" if bare else outside(3)}{main}{"" if bare else outside(3)}{last}</body></html>'
