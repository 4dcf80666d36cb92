"""Pages as trees with selectors, and the table functions that read them.

``register_functions`` makes ``list_items``, ``result_boxes`` and ``page_parts`` known to SQL, for lateral joins with a
table of pages; the same classes are table functions of the DataFrame API.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

from pyspark.sql.functions import udtf

from .html import absolute

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Which open elements a start tag ends, and the elements that keep it from looking further out.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"})}
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
FURNITURE = ("script", "style", "nav", "footer", "header", "iframe")

# Where a notice's text stands, in the order in which the places are tried.
CONTENT = (
    ".v_news_content", ".article", "#content", ".content", "article",
    ".wp_articlecontent", ".news-content", ".detail", ".TRS_Editor",
    ".main-text", ".text", "#vsb_content",
)
# Elements that hold a page's title.
TITLES = ("h1", "h2", "h3", ".article h3", ".title", ".news-title")
# Links of result pages, each in a box, and the snippets of a box.
BOXES = ("li.b_algo h2 a", "#b_results .b_algo h2 a", "div.result h3 a", "div.c-container h3 a", "div.result-op h3 a")
SNIPPETS = "p, .b_caption p, .c-abstract"
# Elements and meta names that tell when a page was published, in the order in which they are asked.
DATED = (".time", ".date", ".pubtime", ".publish", ".article-time", ".news-time")
DATED_META = ("publishdate", "PubDate", "pubdate", "date")
#: Letters of a page's beginning that may tell it.
MOST_HEAD = 2_000
# Words of page furniture, and of what a notice is about.
NOISE = ("首页", "返回顶部", "版权所有", "ICP", "友情链接", "扫一扫", "微信公众号")
TOPICS = ("夏令营", "预推免", "推免", "开放日")
#: Letters: of a page, of a plain text, of a place that counts, of a plain text that counts; the longest text and table text.
LEAST_PAGE, LEAST_PLAIN, LEAST_PLACE, LEAST_TEXT, MOST, MOST_TABLE = 200, 80, 80, 50, 12_000, 6_000
TABLES = "\n\n[表格]\n"


class Node:
    __slots__ = ("attributes", "children", "parent", "tag")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None):
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []

    def walk(self) -> Iterator[Node]:
        """This element and all below it in page order, without recursion, however deep they are."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            if node.children:
                stack.extend([c for c in reversed(node.children) if c.__class__ is Node])

    def text(self, between: str = " ", skip: tuple[str, ...] = ("script", "style", "template")) -> str:
        """Its strings without surrounding white space, empty ones left out, and none of scripts and styles."""
        found, stack = [], self.children[::-1]
        while stack:
            node = stack.pop()
            if node.__class__ is str:
                if held := node.strip():
                    found.append(held)
            elif node.tag not in skip:
                stack += node.children[::-1]
        return between.join(found)

    def above(self, *tags: str) -> Node | None:
        node = self.parent
        while node and node.tag not in tags:
            node = node.parent
        return node


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attributes):
        if tag in ENDS:
            ended, walls = ENDS[tag]
            self._end(ended, walls)
        elif tag in BLOCKS:
            self._end(_P, _P_WALLS)
        node = Node(tag, {k: v or "" for k, v in reversed(attributes)}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attributes):
        self.handle_starttag(tag, attributes)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _end(self, tags: set[str] | frozenset[str], walls: set[str] | frozenset[str]) -> None:
        """Leave the outermost open element with one of these tags inside the nearest wall."""
        node, found = self.at, None
        while node.parent and node.tag not in walls:
            if node.tag in tags:
                found = node
            node = node.parent
        if found:
            self.at = found.parent

    def handle_endtag(self, tag):
        node = self.at
        while node.parent and node.tag != tag:
            node = node.parent
        if node.parent:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


#: Markup in its usual forms: a comment, a declaration, an end tag, or a start tag with its attributes.
_NAME, _VALUE = r"[a-zA-Z_:@][\w:.@-]*", r"\"[^\"<>]*\"|'[^'<>]*'|[^\s\"'<>=`]*[^\s\"'<>=`/]"
_MARKUP = re.compile(rf"<(?:!--(?![->])[^-]*(?:-[^-]+)*-->|![dD][oO][cC][tT][yY][pP][eE] [^<>\[\]\"'-]*>|/([a-zA-Z][a-zA-Z0-9]*)[ \t\n]*>|([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n]+{_NAME}(?:=(?:{_VALUE}))?)*)[ \t\n]*(/?)>)", re.ASCII)
_ATTRIBUTE = re.compile(rf"({_NAME})(?:=({_VALUE}))?", re.ASCII)
_RAW_END = {t: re.compile(f"</{t}", re.I) for t in ("script", "style")}
_P_WALLS = BLOCKS - {"p"}


@lru_cache(4096)
def _attributes(source: str) -> tuple[tuple[str, str], ...]:
    """Names and values; of equal names the first one counts."""
    out = {}
    for name, value in _ATTRIBUTE.findall(source):
        if value[:1] in ("'", '"'):
            value = value[1:-1]
        out.setdefault(name.lower(), unescape(value) if "&" in value else value)
    return tuple(out.items())


def _usual(source: str) -> Node | None:
    """The same tree as the parser builds, of pages whose markup is all in its usual forms; null for others."""
    root = at = Node("", {}, None)
    done, find, markup = 0, source.find, _MARKUP.match
    while True:
        begin = find("<", done)
        if begin < 0:
            if done < len(source):
                held = source[done:]
                at.children.append(unescape(held) if "&" in held else held)
            return root
        if begin > done:
            held = source[done:begin]
            at.children.append(unescape(held) if "&" in held else held)
        match = markup(source, begin)
        if not match:
            return None
        done = match.end()
        ended, tag, attributes, closed = match.groups()
        if tag:
            if closed and attributes and attributes[-1] not in "\"'" and source[done - 3] not in " \t\n":
                return None  # the slash may be part of a value
            tag = tag.lower()
            if tag in ENDS or tag in BLOCKS:
                # leave the outermost open element with one of these tags inside the nearest wall
                out, walls = ENDS[tag] if tag in ENDS else (_P, _P_WALLS)
                node, found = at, None
                while node.parent and node.tag not in walls:
                    if node.tag in out:
                        found = node
                    node = node.parent
                if found:
                    at = found.parent
            node = Node(tag, dict(_attributes(attributes)) if attributes else {}, at)
            at.children.append(node)
            if tag in _RAW_END and not closed:
                # what scripts and styles hold is never shown, unless a class or an id makes them something else
                end = _RAW_END[tag].search(source, done)
                match = end and markup(source, end.start())
                if not match or "class" in node.attributes or "id" in node.attributes:
                    return None
                if end.start() > done:
                    node.children.append(source[done : end.start()])
                done = match.end()
            elif tag not in VOID and not closed:
                at = node
        elif ended:
            ended = ended.lower()
            node = at
            while node.parent and node.tag != ended:
                node = node.parent
            if node.parent:
                at = node.parent


_P = frozenset({"p"})


def tree(html: str | None) -> Node:
    if (found := _usual(html or "")) is not None:
        return found
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def _compound(source: str) -> tuple[str, str, frozenset[str]]:
    """Tag, id and classes of one part of a selector."""
    if not re.fullmatch(r"[\w-]*(?:[#.][\w-]+)*", source):
        raise ValueError(f"not a selector of tags, ids and classes: {source}")
    marks = re.findall(r"([#.])([\w-]+)", source)
    return re.match(r"[\w-]*", source)[0], next((v for k, v in marks if k == "#"), ""), frozenset(v for k, v in marks if k == ".")


def selector(source: str) -> list[list[tuple[str, str, frozenset[str]]]]:
    """Alternatives, each a path of tags, ids and classes from the outside in."""
    return [[_compound(part) for part in way.split()] for way in source.split(",")]


def _is(node: Node, part: tuple[str, str, frozenset[str]]) -> bool:
    tag, name, classes = part
    if tag and node.tag != tag:
        return False
    if name and node.attributes.get("id") != name:
        return False
    return not classes or ("class" in node.attributes and classes <= _classes(node.attributes["class"]))


@lru_cache(4096)
def _classes(held: str) -> frozenset[str]:
    return frozenset(held.split())


def _matches(node: Node, way: list) -> bool:
    if not _is(node, way[-1]):
        return False
    left, node = len(way) - 1, node.parent
    while left and node:
        left -= _is(node, way[left - 1])
        node = node.parent
    return not left


def select(root: Node, ways: list, nodes: list[Node] | None = None) -> Iterator[Node]:
    """Elements below ``root`` that one of the alternatives describes, in page order; ``nodes`` are root and they, if known."""
    if len(ways) == 1 and len(ways[0]) == 1:
        part = ways[0][0]
        return (n for n in nodes or root.walk() if n is not root and _is(n, part))
    lasts = [(w[-1], w) for w in ways]
    return (n for n in nodes or root.walk() if n is not root and any(_is(n, last) and _matches(n, w) for last, w in lasts))


_CONTENT, _TITLES, _BOXES, _SNIPPETS = [selector(s) for s in CONTENT], [selector(s) for s in TITLES], [(selector(s)) for s in BOXES], selector(SNIPPETS)


_DATED = [selector(s) for s in DATED]


def table_text(root: Node) -> str:
    """Rows of all tables, cells apart by bars, tables by an empty line."""
    tables = []
    for table in select(root, [[_compound("table")]]):
        rows = (" | ".join(filter(None, (c.text() for c in row.walk() if c.tag in ("td", "th")))) for row in table.walk() if row.tag == "tr")
        if held := "\n".join(filter(None, rows)):
            tables.append(held)
    return "\n\n".join(tables)


def trimmed(text: str, noise: tuple[str, ...] = NOISE) -> str:
    """Sentences and lines of six letters or more without words of page furniture; the whole text if none is left."""
    parts = [p.strip() for p in re.split(r"[。\n]", text)]
    return "。".join(p for p in parts if len(p) >= 6 and not any(n in p for n in noise)) or text


def page_text(html: str | None, title: str | None = "", topics: tuple[str, ...] = TOPICS[:1], noise: tuple[str, ...] = NOISE, root: Node | None = None) -> str:
    """The text of a notice: of the first known place with enough of it, else round the first heading, else of the body.

    Tables follow once more as rows with bars if the title names a topic. What is too short is empty. A page whose body is
    taken has its furniture left out like the other places.
    """
    source = html or ""
    if not re.search(r"<[a-zA-Z!/?]", source[:4000]):
        text = trimmed(source[:MOST], noise) if len(source) >= LEAST_PLAIN else ""
        return text if len(text) >= LEAST_TEXT else ""
    if len(source) < LEAST_PAGE:
        return ""
    root = root or tree(source)
    nodes = list(root.walk())
    tables = table_text(root) if any(t in (title or "") for t in topics) else ""
    inner = lambda node: node.text(skip=(*FURNITURE, "template"))
    live = lambda node: node.tag not in FURNITURE and not node.above(*FURNITURE)

    def places() -> Iterator[Node]:
        for ways in _CONTENT:
            if found := next(filter(live, select(root, ways, nodes)), None):
                yield found
        if heading := next((n for n in nodes if n.tag in ("h1", "h2") and live(n)), None):
            yield heading.above("div", "article", "td") or heading.parent

    text = next((t for t in map(inner, places()) if len(t) >= LEAST_PLACE), None)
    if text is None:
        text = inner(next((n for n in nodes if n.tag == "body"), root)) or inner(root)
    body = trimmed(text[:MOST], noise)
    return f"{body}{TABLES}{tables[:MOST_TABLE]}" if tables and tables not in body else body


def page_title(html: str | None, topics: tuple[str, ...] = TOPICS) -> str:
    """The longest of headings, og:title and the start of the title element; one that names a topic comes first."""
    return title_of(tree(html), topics)


def title_of(root: Node, topics: tuple[str, ...] = TOPICS) -> str:
    nodes = list(root.walk())
    found = [t for ways in _TITLES for n in select(root, ways, nodes) if len(t := n.text("")) >= 6]
    for n in nodes:
        if n.tag == "meta" and n.attributes.get("property") == "og:title" and n.attributes.get("content"):
            found.append(n.attributes["content"].strip())
            break
    if head := next((n for n in nodes if n.tag == "title"), None):
        start = re.split(r"[-|_—]", head.text(""), maxsplit=1)[0].strip()
        found += [start] if len(start) >= 6 else []
    found = [t[:500] for t in found]
    return max([t for t in found if any(k in t for k in topics)] or found, key=len, default="")


def anchors_of(root: Node, base: str) -> Iterator[tuple[str, str, str]]:
    """Title, address and surroundings of the anchors that may be items of a list, each address once."""
    seen = set()
    for a in root.walk():
        if a.tag == "a" and "href" in a.attributes and 8 <= len(title := a.text("")) <= 200:
            url = absolute(base, a.attributes["href"])
            if url and url not in seen:
                seen.add(url)
                around = a.above("li", "tr", "div")
                yield title, url, around.text() if around else title


@udtf(returnType="position int, title string, url string, context string")
class ListItems:
    """Items of a list page: anchors of 8 to 200 letters with their absolute address and the text of the row round them."""

    def eval(self, html: str, base: str):
        for k, (title, url, context) in enumerate(anchors_of(tree(html), base or "")):
            yield k, title, url, context


@udtf(returnType="position int, title string, url string, snippet string")
class ResultBoxes:
    """Results of a search page by five kinds of boxes, kind after kind: title of 8 to 200 letters, address, first 300 letters of the snippet."""

    def eval(self, html: str):
        root, seen = tree(html), set()
        anchors = [n for n in root.walk() if n.tag == "a"]  # all boxes are told by their anchors
        for ways in _BOXES:
            for a in select(root, ways, anchors):
                url, title = a.attributes.get("href", "").split("#")[0], a.text("")
                if not url.startswith("http") or url in seen or not 8 <= len(title) <= 200:
                    continue
                box = a.above("li", "div")
                snippet = next(select(box, _SNIPPETS), None) if box else None
                yield len(seen), title, url, (snippet.text()[:300] or None) if snippet else None
                seen.add(url)


@udtf(returnType="title string, body string")
class PageParts:
    """One row per page: its title and the text of its notice; ``about`` decides whether tables are added as rows."""

    def eval(self, html: str, about: str):
        root = tree(html)
        yield title_of(root), page_text(html, about, root=root)


def dated_places(html: str | None) -> list[str]:
    """Texts that may tell a page's date: the first of each kind of element, meta tags, the page's beginning."""
    if not html:
        return []
    root = tree(html)
    nodes = list(root.walk())
    found = [n.text() for ways in _DATED if (n := next(select(root, ways, nodes), None))]
    metas = [n.attributes for n in nodes if n.tag == "meta"]
    for name in DATED_META:
        if content := next((m.get("content", "") for m in metas if m.get("name") == name), ""):
            found.append(content)
    return [*found, root.text()[:MOST_HEAD]]


@udtf(returnType="places array<string>")
class PageDates:
    """One row per page: the texts that may tell when it was published, in the order in which they are to be asked."""

    def eval(self, html: str):
        yield (dated_places(html),)


def register_functions(spark) -> None:
    for name, function in (("page_dates", PageDates), ("list_items", ListItems), ("result_boxes", ResultBoxes), ("page_parts", PageParts)):
        spark.udtf.register(name, function)
