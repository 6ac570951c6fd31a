"""Labelled pages for the page model: generated, so that every block's label is known."""

from __future__ import annotations

import random
from html import escape

WORDS = (
    "time year people way day man thing woman life child world school state family student group country problem hand "
    "part place case week company system program question work government number night point home water room mother "
    "area money story fact month lot right study book eye job word business issue side kind head house service friend"
).split()
#: Each list: opening tags of regions of that kind.
ARTICLES = (
    "<article>", '<div class="content">', '<main>', '<div id="main-content">', '<section class="post">',
    '<div class="article-body">', '<div class="entry">', '<div role="main">', "<div>", "<section>",
)
#: The same, named after something that an article has or is about.
MISLEADING = (
    '<div class="post-tags-content">', '<div class="meta">', '<article class="post share-enabled">', '<div class="has-sidebar">',
    '<article class="with-comments">', '<main class="header-large">', '<div class="entry ad-free">', '<section class="discussion-paper">',
    '<div id="story-promo">', '<article data-share="1" class="legal-notice">', '<div class="search-result-article">', '<div class="menu-planning">',
)
NOISE = {
    "menu": ("<nav>", '<ul class="menu">', '<div id="navigation">', '<div class="navbar">', '<div role="navigation">'),
    "header": ("<header>", '<div id="header">', '<div class="banner">', '<div class="site-header">'),
    "footer": ("<footer>", '<div id="footer">', '<div class="site-footer">', '<div class="copyright">'),
    "side": ("<aside>", '<div class="sidebar">', '<div id="sidebar">', '<div class="related">', '<div class="widget">'),
    "notice": ('<div class="cookie-notice">', '<div class="notice">', '<div id="consent">', '<div class="alert">', '<div role="alert">', '<div class="popup">'),
    "ad": ('<div class="ad">', '<div class="advert">', '<div class="sponsored">', '<div id="ads">', '<div class="promo">', '<aside class="advertisement">'),
    "form": ("<form>", '<form class="newsletter">', '<form id="search">', '<div class="subscribe">'),
    "comments": ('<div class="comments">', '<section id="comments">', '<ul class="comment-list">', '<div id="disqus_thread">', '<section class="reader-comments">', '<div class="comment">'),
    "share": ('<div class="share">', '<div class="social">', '<ul class="breadcrumb">', '<div class="tags">', '<div class="post-meta">'),
}
#: Classes of noise with words that speak for content.
INNER = {
    "header": '<div class="header-content">', "footer": '<div class="footer-content">', "side": '<div class="sidebar-content">',
    "ad": '<div class="ad-body">', "comments": '<div class="comment-content">', "notice": '<div class="cookie-text">',
}


def sentence(r: random.Random, low: int, high: int) -> str:
    words = [r.choice(WORDS) for _ in range(r.randint(low, high))]
    return " ".join(words).capitalize() + r.choice((".", ".", "", "!"))


def close(tag: str) -> str:
    return f"</{tag[1:].split()[0].rstrip('>')}>"


def link(r: random.Random, high: int = 3) -> str:
    return f'<a href="/{r.choice(WORDS)}">{sentence(r, 1, high)}</a>'


def table(r: random.Random, cell) -> str:
    """A table of cells, with or without caption, head and sections."""
    columns = r.randint(1, 4)
    row = lambda tag: "<tr>" + "".join(f"<{tag}>{cell()}</{tag}>" for _ in range(columns)) + "</tr>"
    head = r.choice(("", row("th"), f"<thead>{row('th')}</thead>"))
    caption = f"<caption>{sentence(r, 2, 9)}</caption>" if r.random() < 0.3 else ""
    body = "".join(row("td") for _ in range(r.choice((1, 2, 3, 5, 9, 14))))
    return f"<table>{caption}{head}{f'<tbody>{body}</tbody>' if r.random() < 0.5 else body}</table>"


def terms(r: random.Random, meaning) -> str:
    return "<dl>" + "".join(f"<dt>{sentence(r, 1, 3)}</dt><dd>{meaning()}</dd>" for _ in range(r.randint(1, 5))) + "</dl>"


def blocks(r: random.Random, n: int) -> str:
    """n blocks of body text."""
    out = []
    for _ in range(n):
        kind = r.random()
        text = " ".join(sentence(r, 3, 22) for _ in range(r.choice((1, 1, 1, 2, 4, 7))))
        if r.random() < 0.2:
            text = f'<a href="/{r.choice(WORDS)}">{r.choice(WORDS)}</a> {text}'
        if kind < 0.55:
            out.append(f"<p>{text}</p>" if r.random() < 0.8 else f"<p><b>{text}<br>")
        elif kind < 0.62:
            tag = r.choice(("h2", "h2", "h3", "h4"))
            out.append(f"<{tag}>{link(r, 6) if r.random() < 0.3 else sentence(r, 1, 6)}</{tag}>")
        elif kind < 0.7:
            tag, linked = r.choice(("ul", "ul", "ol")), r.random() < 0.35
            out.append(f"<{tag}>" + "".join(f"<li>{link(r, 6) if linked else sentence(r, 1, 12)}</li>" for _ in range(r.randint(2, 10))) + f"</{tag}>")
        elif kind < 0.73:
            out.append(f"<blockquote>{text if r.random() < 0.5 else f'<p>{text}</p>'}</blockquote>")
        elif kind < 0.75:
            out.append(f"<pre>{text}</pre>")
        elif kind < 0.79:
            out.append(f"<div>{text}</div>")
        elif kind < 0.86:
            out.append(table(r, lambda: r.choice((sentence(r, 1, 3), sentence(r, 1, 14), str(r.randint(0, 9999)), link(r)))))
        elif kind < 0.9:
            out.append(f'<figure><img src="/{r.choice(WORDS)}.jpg"><figcaption>{sentence(r, 2, 14)}</figcaption></figure>')
        elif kind < 0.94:
            out.append(terms(r, lambda: sentence(r, 2, 16)))
        elif kind < 0.95:
            out.append(f"<details><summary>{sentence(r, 1, 5)}</summary><p>{text}</p></details>")
        else:
            out.append(text)
    return "".join(out)


def article(r: random.Random) -> str:
    """Markup of body text; every block is content."""
    title = f"<h1>{sentence(r, 2, 10)}</h1>" if r.random() < 0.8 else ""
    title = f"<header>{title}</header>" if title and r.random() < 0.04 else title
    n = r.randint(1, 9)
    if r.random() < 0.2:
        tag = r.choice(("<div>", "<section>", '<div class="row">'))
        return title + "".join(tag + blocks(r, r.randint(1, 4)) + close(tag) for _ in range(r.randint(1, 3)))
    return title + blocks(r, n)


def noise(r: random.Random, kind: str) -> str:
    tag = INNER[kind] if kind in INNER and r.random() < 0.07 else r.choice(NOISE[kind])
    item = "li" if tag.startswith("<ul") else r.choice(("p", "div", "span"))
    links = lambda low, high: "".join(f"<li>{link(r)}</li>" for _ in range(r.randint(low, high)))
    if kind in ("menu", "share"):
        if tag.startswith("<ul"):
            body = links(2, 12)
        else:
            body = r.choice((f"<ul>{links(2, 12)}</ul>",) * 4 + (table(r, lambda: link(r)), terms(r, lambda: link(r))) + (" ".join(link(r) for _ in range(r.randint(2, 9))),) * 2)
    elif kind == "form":
        body = f"<label>{sentence(r, 1, 4)}</label><input name='q'><button>{r.choice(WORDS)}</button>"
        body = table(r, lambda: sentence(r, 1, 3)) if r.random() < 0.1 else body
        body += f"<p>{sentence(r, 3, 15)}</p>" if r.random() < 0.5 else ""
    elif kind == "comments":
        body = "".join(
            f"<{item}>{' '.join(sentence(r, 3, 18) for _ in range(r.randint(1, 4)))}</{item}>" for _ in range(r.randint(1, 5))
        )
        body = f"<h3>{sentence(r, 1, 3)}</h3>" * (r.random() < 0.5) + body
    elif kind == "side":
        figure = f"<figure><img src='/x.png'><figcaption>{sentence(r, 2, 9)}</figcaption></figure>"
        body = f"<h3>{sentence(r, 1, 3)}</h3>" + r.choice((f"<p>{sentence(r, 4, 20)}</p>",) * 3 + (f"<ul>{links(4, 8)}</ul>",) * 3 + (table(r, lambda: sentence(r, 1, 3)), terms(r, lambda: sentence(r, 1, 8)), figure))
    elif kind == "footer":
        body = f"&copy; {r.choice(WORDS)}.example.com &middot; {sentence(r, 2, 14)}" + (link(r) if r.random() < 0.4 else "")
        body += r.choice(("",) * 5 + (f"<ul>{links(3, 8)}</ul>", terms(r, lambda: link(r)), table(r, lambda: link(r))))
    else:
        body = " ".join(sentence(r, 3, 14) for _ in range(r.randint(1, 3)))
        body = f"<p>{body}</p>" if r.random() < 0.4 else body
        body = f"<figure><img src='/x.png'><figcaption>{body}</figcaption></figure>" if kind == "ad" and r.random() < 0.1 else body
    return tag + body + close(tag)


def labelled_page(seed: int) -> str:
    """A page whose content lies between the marks \\x01 and \\x02, both control
    characters that no text has."""
    r = random.Random(seed)
    tag = r.choice(MISLEADING if r.random() < 0.15 else ARTICLES)
    inner = article(r)
    if r.random() < 0.3:
        where = r.choice(("ad", "share", "comments", "form", "side"))
        inner = f"\x01{inner}\x02{noise(r, where)}\x01{article(r) if where in ('ad', 'side') else ''}\x02"
    else:
        inner = f"\x01{inner}\x02"
    before = [noise(r, k) for k in ("header", "menu", "notice", "ad", "share") if r.random() < 0.5]
    after = [noise(r, k) for k in ("comments", "side", "form", "ad", "footer") if r.random() < 0.5]
    body = "".join(before) + tag + inner + close(tag) + "".join(after)
    if r.random() < 0.4:
        body = f'<div class="{r.choice(("wrapper", "page", "container", "layout"))}">{body}</div>'
    title = escape(sentence(r, 2, 6))
    return f"<!DOCTYPE html><html><head><title>{title}</title><script>x('</p>')</script></head><body>{body}</body></html>"
