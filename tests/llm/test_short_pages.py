"""Pages with one to four paragraphs in every usual container keep all of their text."""

import pytest

from marquee.llm.html_extract import Page, TreeModel
from marquee.llm.labelled_pages import training_pages

LINKS = '<ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">About</a></li></ul>'
BEFORE = ("", f"<nav>{LINKS}</nav>", f'<header><a href="/">Site name</a></header><nav>{LINKS}</nav>', '<div class="menu"><a href="/a">Home</a> <a href="/b">News</a></div><div class="ad">Buy this now</div>')
CONTAINERS = (
    "<main>{}</main>", "<section>{}</section>", "<div>{}</div>", '<div id="content">{}</div>', "<article>{}</article>", '<div class="post">{}</div>', "<table><tr><td>{}</td></tr></table>", "<main><article>{}</article></main>",
    '<div class="row"><div class="col">{}</div></div>',
)
AFTER = ("", "<footer>Copyright 2026 by the site</footer>")


@pytest.fixture(scope="module")
def model():
    return TreeModel(training_pages())


def paragraph(k, size):
    return (f"The quick brown fox number {k} jumps over lazy dogs and walks home again in the rain until evening. " * 9)[:size].strip()


@pytest.mark.parametrize("size", [20, 60, 100, 250, 700])
def test_short_pages(model, size):
    p = [("p", paragraph(k, size)) for k in range(4)]
    for before in BEFORE:
        for container in CONTAINERS:
            for body in (p[:1], p[:2], p, [("h1", "A heading of the page"), *p[:2]]):
                for after in AFTER:
                    inside = container.format("".join(f"<{t}>{x}</{t}>" for t, x in body))
                    page = f"<html><head><title>t</title></head><body>{before}{inside}{after}</body></html>"
                    assert model.extract(page) == "\n\n".join(x for _, x in body), page


def test_headings_in_headers_of_articles(model):
    one = paragraph(1, 100)
    assert model.extract(f"<html><body><article><header><h1>Title here</h1></header><p>{one}</p></article></body></html>") == f"Title here\n\n{one}"


def test_chance_of_any_content_equals_enumeration():
    import itertools

    import numpy as np

    from marquee.llm.html_extract import BLOCKS

    small = TreeModel(training_pages(40))
    page = Page("<div><p>some <a>words</a></p><ul><li>x</ul></div>")
    seen, n, weights = page.seen(), len(page.tag), {}
    for y in itertools.product((0, 1), repeat=n):
        log = small.root[y[0]] + sum(small.log[f][y[k]] for k in range(n) for f in seen[k] if f in small.log)
        weights[y] = np.exp(log + sum(small.edge[int(page.tag[k] in BLOCKS), y[page.parent[k]], y[k]] for k in range(1, n)))
    assert abs(small.chances(page)[1] - (1 - weights[(0,) * n] / sum(weights.values()))) < 1e-9
