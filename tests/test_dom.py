"""Pages as trees: structure, selectors, and the table functions on odd pages."""

import pytest

from marquee.functions.dom import page_text, page_title, select, selector, table_text, tree
from marquee.functions.similarity import register_functions


def found(html, css):
    return [n.text() for n in select(tree(html), selector(css))]


def test_trees_of_loose_markup():
    root = tree("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>1<td>2<tr><td>3</table><p>x<p>y<div>z</div><br>t</b></x>")
    assert [n.text() for n in root.walk() if n.tag == "li"] == ["a", "b c", "c", "d"]
    assert [[c.text() for c in r.children] for r in root.walk() if r.tag == "tr"] == [["1", "2"], ["3"]]
    assert [(n.tag, n.text()) for n in root.walk() if n.tag == "p"] == [("p", "x"), ("p", "y")]
    assert root.text() == "a b c d 1 2 3 x y z t"
    assert tree("<div>" * 20_000 + "deep").text() == "deep" and tree(None).text() == ""


def test_selectors():
    html = '<div id=n class="a b"><p class=c>1</p><div><p class="c d">2</p></div></div><p class=c>3</p><li class=b_algo><h2>no</h2><h2><a>4</a></h2>'
    assert found(html, ".c") == ["1", "2", "3"]
    assert found(html, "#n p, .b_algo a") == ["1", "2", "4"]
    assert found(html, "div.a.b div .d") == ["2"] and found(html, "div.a.x p") == [] and found(html, "div div div p") == []
    with pytest.raises(ValueError):
        selector("a[href]")


def test_texts_of_pages():
    long = "a sentence of the notice that is long enough to count as the text of a page, as it has eighty letters and more"
    page = lambda inner: f"<html><body>{'<!-- x -->' * 20}{inner}</body></html>"
    assert page_text("") == page_text(None) == page_text("<p>short</p>") == page_text("plain text") == ""
    assert page_text(long) == long and page_text("ICP " + long + "\nfive\n" + long) == long
    assert page_text(page(f"<nav>{long}</nav><div class=article>short</div><article>{long}<script>x</script><style>y</style></article>")) == long
    assert page_text(page(f"<header class=article>{long}</header><p>body text</p>")) == "body text"
    assert page_text(page(f"<td><h2>Head of it</h2>{long}</td>")) == f"Head of it {long}"
    assert page_text(page("x" * 13_000)) == "x" * 12_000
    table = f"<div class=content>{long}<table><tr><td>a</td><td>b</td></tr></table></div>"
    assert page_text(page(table), "夏令营") == f"{long} a b\n\n[表格]\na | b" and page_text(page(table), "x") == f"{long} a b"
    assert table_text(tree("<table><tr><th>a</th><td> </td><td>b<br>c</td></tr><tr></tr></table><table></table><table><tr><td>d</td></tr></table>")) == "a | b c\n\nd"


def test_titles_of_pages():
    assert page_title(None) == page_title("<h1>short</h1>") == ""
    assert page_title("<title>Long title of a page - site</title><h1>Heading</h1>") == "Long title of a page"
    assert page_title('<h1>A much longer heading than the other</h1><meta property="og:title" content="某大学夏令营"><h2>equal1</h2>') == "某大学夏令营"
    assert page_title("<h2>equal1</h2><h1>equal2</h1>") == "equal2" and len(page_title(f"<h1>{'x' * 900}</h1>")) == 500


def test_functions_in_sql(spark):
    register_functions(spark)
    pages = spark.createDataFrame([(1, '<li><a href="/a">A title of eight</a> 2026-01-01</li>', "https://h/"), (2, None, None), (3, "", "x")], "id long, html string, base string")
    assert [tuple(r) for r in spark.sql("SELECT id, i.* FROM {p} p, LATERAL list_items(p.html, p.base) i", p=pages).collect()] == [(1, 0, "A title of eight", "https://h/a", "A title of eight 2026-01-01")]
    assert spark.sql("SELECT id, i.* FROM {p} p, LATERAL result_boxes(p.html) i", p=pages).collect() == []
    assert sorted(tuple(r) for r in spark.sql("SELECT id, i.* FROM {p} p, LATERAL page_parts(p.html, p.base) i", p=pages).collect()) == [(1, "", ""), (2, "", ""), (3, "", "")]
    assert spark.sql("SELECT text_similarity('abcd', 'abxd')").first()[0] == 0.75


def test_usual_markup_gives_the_same_tree():
    import random

    from marquee.functions import dom

    def shown(root):
        return [(n.tag, sorted(n.attributes.items()), [c for c in n.children if isinstance(c, str)] if n.tag not in ("script", "style") else []) for n in root.walk()]

    bits = ["<p>", "</p>", "<div class=x>", "<div class='a b' id=\"c\">", "</div>", "<ul>", "<li>", "</ul>", "<table>", "<tr>", "<td>", "</table>", "a &amp; b", "&#35;x &nbsp", "<br/>", "<img src=/a/b.png alt=''>", "<script>x='<a href=x>';</script>", "<!-- c -->", "<!DOCTYPE html>",
            "<title>a - b</title>", "< 5", "a<b", "<a href=\"/x?a=1&amp;b=2\" HREF='n'>", "</a>", "<A TITLE=t\n HREF=/q/>", "<x/>", "<input disabled>", "</p >", "<?php ?>", "<a b", "<dl><dt>", "<dd>", "\n ", "<a href=x/y>", "<!-- a -- b -->", "<a x='1'y=2>", "&#x41"]
    rng, usual = random.Random(1), 0
    for _ in range(4000):
        html = "".join(rng.choice(bits) for _ in range(rng.randint(1, 8)))
        builder = dom._Builder()
        builder.feed(html)
        builder.close()
        assert shown(dom.tree(html)) == shown(builder.root), html
        usual += dom._usual(html) is not None
    assert 1000 < usual < 3500
