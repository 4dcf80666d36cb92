"""Generated web pages with labelled elements: data-y="1" marks content, data-y="0" what is not, for what is inside too."""

from __future__ import annotations

import random
import re

# Usual markup of main texts and of what stands around them.
CONTENT = (
    '<article data-y="1">{}</article>', '<main><article class="post" data-y="1">{}</article></main>', '<main data-y="1">{}</main>', '<div class="article-body" data-y="1">{}</div>',
    '<div id="content"><div class="entry-content" data-y="1">{}</div></div>', '<section class="post-content" data-y="1">{}</section>', '<div role="main"><div class="story-text" data-y="1">{}</div></div>',
    '<article data-y="1"><div class="text">{}</div></article>', '<div class="wrapper"><div class="page-body article" data-y="1">{}</div></div>',
    '<div class="content" data-y="1">{}</div>', '<div id="main"><div class="content main-text" data-y="1">{}</div></div>', '<div data-y="1">{}</div>', '<div><div data-y="1">{}</div></div>', '<article data-y="1">{}</article>',
)
#: Containers of short texts, by themselves and in the columns of a grid.
SHORT = (
    '<main data-y="1">{}</main>', '<section data-y="1">{}</section>', '<div data-y="1">{}</div>', '<div id="content" data-y="1">{}</div>', '<article data-y="1">{}</article>', '<div class="post" data-y="1">{}</div>',
    '<table><tr><td data-y="1">{}</td></tr></table>', '<main><article data-y="1">{}</article></main>', '<main><section data-y="1">{}</section></main>', '<div class="row"><div class="col" data-y="1">{}</div></div>', '<main><div data-y="1">{}</div></main>',
    '<div class="container"><div class="row"><div class="column" data-y="1">{}</div></div></div>', '<section><div data-y="1">{}</div></section>', '<div id="main"><section data-y="1">{}</section></div>', '<div class="content" data-y="1">{}</div>',
)
WHOLE = ('<body data-y="1">{}', '<body class="page" data-y="1"><div>{}</div>', '<body data-y="1"><div id="wrapper"><div class="inner">{}</div></div>')
FORM = '<form method="post" action="/p" id="aspnetForm">{}</form>'
LINKS = '<ul><li><a href="/a">{}</a></li><li><a href="/b">{}</a></li><li><a href="/c">{}</a></li></ul>'
AROUND = (
    "<nav>" + LINKS + "</nav>", '<div class="menu">' + LINKS + "</div>", '<div id="navbar" class="nav">' + LINKS + "</div>", "<header><a>{}</a><p>{}</p></header>", '<div class="header"><h1>{}</h1><p>{}</p></div>',
    "<aside><h3>{}</h3>" + LINKS + "</aside>", '<div class="sidebar"><h2>{}</h2><p>{}</p></div>', '<div id="sidebar-right" class="widget">' + LINKS + "</div>", '<div class="ad">{}</div>', '<div class="advert ads"><p>{}</p></div>',
    '<div class="sponsored promo">{}<a href="/x">{}</a></div>', '<div class="banner"><p>{}</p></div>', '<div class="cookie-notice" role="dialog"><p>{}</p><p>{}</p></div>', '<div id="notice" class="alert">{}</div>', '<div class="newsletter subscribe popup"><p>{}</p></div>',
    '<div class="consent gdpr"><p>{}</p></div>', '<section id="comments" class="comments"><h2>{}</h2><div class="comment"><p>{}</p></div><div class="comment"><p>{} {}</p></div></section>', '<ol class="comment-list"><li class="comment"><p>{}</p></li><li class="comment reply"><p>{}</p></li></ol>',
    '<div id="disqus_thread" class="responses"><p>{}</p></div>', '<div class="related"><h3>{}</h3>' + LINKS + "</div>", '<div class="share social"><a href="#">{}</a><a href="#">{}</a></div>', '<div class="breadcrumb"><a href="/">{}</a> / <a href="/x">{}</a></div>',
    '<form action="/s" class="search"><p>{}</p><input name="q"></form>', '<form class="login" method="post"><h3>{}</h3><p>{}</p><input></form>', '<div class="subscribe"><form><p>{}</p><input type="email"></form></div>', '<form id="contact-form"><fieldset><legend>{}</legend><p>{}</p></fieldset></form>',
    '<section id="reader-comments"><h2>{}</h2><div class="comment"><p>{}</p><p>{}</p></div></section>', '<div class="comments-area"><div class="comment-body"><p>{}</p></div></div>', '<div class="discussion replies"><p>{}</p><p>{}</p></div>', '<ul class="tags meta"><li><a>{}</a></li><li><a>{}</a></li></ul>',
    '<div class="pagination"><a>{}</a> <a>{}</a></div>', '<div class="toolbar topbar"><span>{}</span><a>{}</a></div>', '<div class="author-bio bio"><p>{}</p></div>', '<section class="recommended more-stories"><h3>{}</h3><p><a>{}</a></p></section>',
)
AFTER = ("<footer>{}</footer>", '<footer><p>{}</p><a href="/t">{}</a></footer>', '<div class="footer"><p>{}</p></div>', '<div id="footer" class="copyright">{}</div>')
LETTERS = "eeetaoinshrdlucmfwypvbgkjqxz"


def _words(rng: random.Random, least: int, most: int) -> str:
    return " ".join("".join(rng.choices(LETTERS, k=rng.randint(2, 9))) for _ in range(rng.randint(least, most))).capitalize() + rng.choice(("", ".", ".", ".", "?"))


def _fill(rng: random.Random, shape: str, most: int) -> str:
    while "{}" in shape:
        shape = shape.replace("{}", _words(rng, 1, most), 1)
    return shape


def _comments(rng: random.Random) -> str:
    """What readers say, at the end of an article."""
    name = rng.choice(('div class="comments"', 'section id="comments"', 'section id="reader-comments"', 'div class="comment-list"', 'div class="responses"', 'section class="user-comments"'))
    head = f"<h3>{_words(rng, 1, 3)}</h3>" if rng.random() < 0.4 else ""
    shapes = ('<div class="comment"><p>{}</p></div>', '<div class="comment"><p>{}</p></div>', "<p>{}</p>", "<div><p>{}</p></div>")
    return f'<{name} data-y="0">{head}' + "".join(rng.choice(shapes).replace("{}", _words(rng, 2, 30)) for _ in range(rng.randint(1, 5))) + f"</{name.split()[0]}>"


def _body(rng: random.Random) -> str:
    parts = [f"<h1>{_words(rng, 2, 10)}</h1>"] if rng.random() < 0.8 else []
    for _ in range(rng.choice((rng.randint(1, 3), rng.randint(1, 14)))):
        kind = rng.random()
        text = _words(rng, 1, rng.choice((3, 12, 40, 120)))
        if kind < 0.62:
            link = f' <a href="/w">{_words(rng, 1, 4)}</a> ' if rng.random() < 0.5 else " "
            parts.append(f"<p>{text}{link}{_words(rng, 0, 20)}</p>")
        elif kind < 0.7:
            parts.append(f"<p><b>{text}<br><p>{_words(rng, 3, 60)}</p>")
        elif kind < 0.77:
            parts.append(f"<h2>{_words(rng, 1, 8)}</h2>")
        elif kind < 0.83:
            parts.append("<ul>" + "".join(f"<li>{_words(rng, 1, 15)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
        elif kind < 0.87:
            parts.append(f"<blockquote><p>{text}</p></blockquote>")
        elif kind < 0.9:
            parts.append(f"<table><tr><th>{_words(rng, 1, 3)}</th><td>{_words(rng, 1, 6)}</td></tr></table>")
        elif kind < 0.93:
            parts.append(f"<figure><img src='x'><figcaption>{_words(rng, 2, 10)}</figcaption></figure><pre><code>{_words(rng, 2, 12)}</code></pre>")
        else:
            parts.append(f"<div><p>{text} <em>{_words(rng, 1, 3)}</em> <strong>{_words(rng, 1, 3)}</strong> <span>{_words(rng, 1, 5)}</span></p></div>")
        if rng.random() < 0.06:
            parts.append('<div class="{}" data-y="0"><p>{}</p></div>'.format(rng.choice(("ad", "advert", "related", "share", "promo", "newsletter")), _words(rng, 2, 20)))
    if rng.random() < 0.3:
        parts.append(_comments(rng))
    return "".join(parts)


def _plain(rng: random.Random) -> str:
    """Paragraphs, or lines without any markup."""
    if rng.random() < 0.3:
        return "<br>".join(_words(rng, 3, 60) for _ in range(rng.randint(1, 4)))
    link = lambda: f"<a href=\"/w\">{_words(rng, 1, 4)}</a> " * (rng.random() < 0.3)
    return "".join(f"<p>{_words(rng, 1, rng.choice((5, 30, 90)))} {link()}{_words(rng, 1, 20)}</p>" for _ in range(rng.randint(1, 8)))


def _short_body(rng: random.Random) -> str:
    """One to four paragraphs of any length, with or without a heading."""
    head = rng.choice(("", "", f"<h1>{_words(rng, 1, 8)}</h1>", f"<h2>{_words(rng, 1, 8)}</h2>", f"<header><h1>{_words(rng, 1, 8)}</h1></header>"))
    label = f"<p><label>{_words(rng, 1, 4)}</label> {_words(rng, 1, 20)}</p>" if rng.random() < 0.1 else ""
    return head + "".join(f"<p>{_words(rng, 1, rng.choice((4, 12, 20, 40, 90)))}</p>" for _ in range(rng.randint(1, 4))) + label + (_comments(rng) if rng.random() < 0.25 else "")


def _short_page(rng: random.Random) -> str:
    around = "".join(_fill(rng, re.sub(r"^<(\w+)", r'<\1 data-y="0"', rng.choice(AROUND)), rng.choice((3, 12))) for _ in range(rng.choice((0, 0, 1, 1, 2, 3))))
    last = _fill(rng, re.sub(r"^<(\w+)", r'<\1 data-y="0"', rng.choice(AFTER)), 12) if rng.random() < 0.5 else ""
    return f"<html><head><title>x</title></head><body>{around}{rng.choice(SHORT).replace('{}', _short_body(rng))}{last}</body></html>"


def training_pages(count: int = 500, seed: int = 11) -> list[str]:
    """``count`` pages, half as many with short texts and some without any, the same for the same seed."""
    rng, pages = random.Random(seed), []
    other = lambda shape, most: _fill(rng, re.sub(r"^<(\w+)", r'<\1 data-y="0"', shape), most)
    for _ in range(count):
        before = "".join(other(rng.choice(AROUND), rng.choice((3, 12, 40))) for _ in range(rng.randint(1, 5)))
        after = "".join(other(rng.choice(AROUND), rng.choice((3, 12, 40))) for _ in range(rng.randint(0, 3)))
        last, head, kind = other(rng.choice(AFTER), 15), rng.choice(("<head><title>x</title></head>", "<head><title>x</title>", "")), rng.random()
        if kind < 0.15:  # nothing but text
            start = rng.choice(("", "", '<html data-y="1">', '<html data-y="1"><body>', '<div data-y="1">'))
            pages.append(start + _plain(rng) if start else f'<b data-y="1">{_words(rng, 0, 2)}</b>{_words(rng, 3, 60)}' if rng.random() < 0.5 else "".join(f'<p data-y="1">{_words(rng, 1, rng.choice((3, 60)))}</p>' for _ in range(rng.choice((1, 1, 2, 4)))))
        elif kind < 0.35:  # the page itself is the text
            whole = rng.choice(WHOLE)
            pages.append(f"<html>{head}{whole.split('{}')[0]}{before if rng.random() < 0.6 else ''}{_body(rng) if rng.random() < 0.6 else _plain(rng)}{after if rng.random() < 0.3 else ''}{last}{whole.split('{}')[1]}</body></html>")
        else:
            inside = f"{before}{rng.choice(CONTENT).replace('{}', _body(rng))}{after}{last}"
            pages.append(f"<!DOCTYPE html><html>{head}<body>{FORM.replace('{}', inside) if rng.random() < 0.12 else inside}</body></html>")
    pages += [_short_page(rng) for _ in range(count // 2)]
    for _ in range(count // 8):  # no text of its own at all
        pages.append("<html><head><title>x</title></head><body>" + "".join(other(rng.choice(AROUND), rng.choice((3, 12, 40))) for _ in range(rng.randint(1, 4))) + other(rng.choice(AFTER), 15) + "</body></html>")
    return pages
