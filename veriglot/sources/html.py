"""Text blocks, metadata, links and images of HTML pages: a generator over Arrow batches with the standard parser."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .. import lexicon
from ..functions.batches import slices
from ..config import AuditConfig, parse_selector

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
VISIBLE = re.compile("[a-zA-Z0-9À-ɏ]")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
BLOCK_TYPE = {tag: kind for kind, tags in reversed(lexicon.BLOCK_TYPES.items()) for tag in tags}


@dataclass
class Node:
    tag: str
    attrs: dict[str, str]
    parent: Node | None
    children: list[Node | str | Comment] = field(default_factory=list)
    nth: int = 1  # among its parent's children of the same tag
    tags: dict[str, int] = field(default_factory=dict)  # how many children of each tag it has
    size: int = 0  # length of all_text()
    visible: bool = False  # whether any string in it, comments included, has a visible character
    most: int = 0  # what all its strings, comments included, would be joined by spaces, and one
    links: int = 0  # length of the text inside links
    region: float = 0.0  # weight of the best connected region that begins here


class Comment(str):
    pass


class Tree(HTMLParser):
    """Open tags nest until they are closed: an end tag closes up to the nearest open tag of its name, or nothing."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.open: dict[str, int] = {}  # open tags by name, so that an end tag that closes nothing isn't searched for
        self.feed(html)
        self.close()
        measure(self.root)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        node.nth = self.at.tags[tag] = self.at.tags.get(tag, 0) + 1
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._leave()

    def handle_endtag(self, tag: str) -> None:
        if not self.open.get(tag):
            return
        while self.at.tag != tag:
            self._leave()
        self._leave()

    def _leave(self) -> None:
        self.open[self.at.tag] -= 1
        self.at = self.at.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)

    def handle_comment(self, data: str) -> None:
        self.at.children.append(Comment(data))


def walk(node: Node) -> Iterator[Node]:
    stack = [c for c in reversed(node.children) if isinstance(c, Node)]
    while stack:
        node = stack.pop()
        yield node
        stack += [c for c in reversed(node.children) if isinstance(c, Node)]


#: Elements that can be the content root, and those that cost a region nothing: they are a part of running text.
CONTAINERS, FREE = ("article", "main", "div", "section", "td", "body"), {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "blockquote", "pre", "table", "tbody", "tr", "td", "th", "br", *lexicon.INLINE_TAGS}
#: What an element that is no part of running text costs its region, in code points, and what one of a link does.
ELEMENT_COST, LINK_COST = 50.0, 1.0
#: Elements that seldom hold the content, and what each costs its region.
CHROME, CHROME_COST = {"head", "nav", "footer", "aside", "header", "form", "menu"}, 300.0
#: Where links hold more than this share of a subtree's text, it is navigation.
LINK_SHARE = 0.5


def measure(root: Node) -> None:
    """Sizes and weights of all nodes, children first. A node's own weight is the length of its strings, less those in
    links and less ELEMENT_COST where it is a part of the layout; its region adds the regions of those children that
    are worth something."""
    order = [root]
    for node in order:
        order += [c for c in node.children if isinstance(c, Node)]
    inside = {id(root): False}
    for node in order:
        link = inside[id(node)] or node.tag == "a"
        for c in node.children:
            if isinstance(c, Node):
                inside[id(c)] = link
    for node in reversed(order):
        silent, link = node.tag in ("script", "style"), inside[id(node)] or node.tag == "a"
        own = 0
        for c in node.children:
            if isinstance(c, Node):
                if c.tag not in ("script", "style"):
                    node.size, node.links = node.size + c.size, node.links + c.links
                    node.region += max(0.0, c.region)
                node.visible, node.most = node.visible or c.visible, node.most + c.most
            else:
                node.most += len(c.strip()) + 1 if c.strip() else 0
                node.visible = node.visible or bool(VISIBLE.search(c))
                own += 0 if isinstance(c, Comment) else len(c.strip())
        node.size += own
        node.links += own if link else 0
        node.region += (-LINK_COST if link else 0.0 if silent else 1.0) * own - (0.0 if node.tag in FREE else CHROME_COST if node.tag in CHROME else ELEMENT_COST)


def all_text(node: Node) -> str:
    """Stripped strings below a node, without comments, scripts and styles, one after the other."""
    out, stack = [], list(reversed(node.children))
    while stack:
        x = stack.pop()
        if isinstance(x, Node):
            if x.tag not in ("script", "style"):
                stack += list(reversed(x.children))
        elif not isinstance(x, Comment):
            out.append(x.strip())
    return "".join(out)


@lru_cache(maxsize=64)
def tests(selectors: tuple[str, ...]) -> list[Callable[[Node], bool]]:
    """A test of a node for each selector. A class is found as a whole word of one of the node's classes."""

    def test(kind: str, name: str, how: str = "", value: str = "") -> Callable[[Node], bool]:
        if kind == "class":
            whole = re.compile(rf"\b{re.escape(name)}\b")
            return lambda n: "class" in n.attrs and any(map(whole.search, n.attrs["class"].split()))
        if kind == "id":
            return lambda n: n.attrs.get("id") == name
        if kind == "tag":
            return lambda n: n.tag == name
        compare = {"": lambda v: True, "=": lambda v: v == value, "*=": lambda v: value in v, "^=": lambda v: v.startswith(value), "$=": lambda v: v.endswith(value), "~=": lambda v: value in v.split()}[how]
        return lambda n: name in n.attrs and (not how or how == "=" or value != "") and compare(n.attrs[name])

    return [test(*parse_selector(s)) for s in selectors]


def ignored(node: Node, selectors: tuple[str, ...] = lexicon.IGNORED) -> bool:
    """By tag, class, id or attribute selector, inline style or aria-hidden; the element itself is tested."""
    if any(holds(node) for holds in tests(selectors)):
        return True
    return bool(HIDDEN.search(node.attrs.get("style", ""))) or node.attrs.get("aria-hidden") == "true"


def own_text(node: Node, least: int, selectors: tuple[str, ...], deepest: int = 10) -> str:
    """Strings of a block and of inline or other elements in it; nested blocks count whole where they are longer than
    `least`. Comments count as strings. Strings in more than `deepest` elements of a block are left out (0: none is)."""
    out: list[str] = []
    stack = [(c, 0) for c in reversed(node.children)]
    while stack:
        x, depth = stack.pop()
        if isinstance(x, str):
            if x.strip():
                out.append(x.strip())
        elif not ignored(x, selectors):
            if x.tag in lexicon.CONTENT_TAGS and x.tag not in lexicon.INLINE_TAGS:
                if x.size > least:
                    out.append(all_text(x))
            elif depth < deepest or not deepest:
                stack += [(c, depth + 1) for c in reversed(x.children)]
    return " ".join(" ".join(out).split())


def xpath(node: Node) -> str:
    parts = []
    while node is not None and node.parent is not None:
        part = f"{node.tag}[{node.nth}]" if node.parent.tags[node.tag] > 1 else node.tag
        if node.attrs.get("id"):
            part = f"{node.tag}[@id='{node.attrs['id']}']"
        elif node.attrs.get("class"):
            part = f"{node.tag}[@class='{' '.join(node.attrs['class'].split())}']"
        parts.append(part)
        node = node.parent
    return "/html/" + "/".join(reversed(parts)) if parts else "/html"


def attributes(node: Node) -> list[tuple[str, str]]:
    return [(k, v) for k, v in node.attrs.items() if k in ("id", "class", "role", "lang") or k.startswith("data-")]


def content_root(tree: Tree) -> Node:
    """The first article, else the first main element, else the container of the best connected region: the nearest
    one at or above the node where that region begins that holds half of the page's text outside links. A page without
    text has the document as its root."""
    for tag in ("article", "main"):
        if found := next((n for n in walk(tree.root) if n.tag == tag), None):
            return found
    best = max(walk(tree.root), key=lambda n: n.region, default=tree.root)  # the first of equals, which is the outer one
    if best.region <= 0:
        return tree.root
    page = next((n for n in walk(tree.root) if n.tag == "body"), tree.root)
    while best.parent is not None and (best.tag not in CONTAINERS or 2 * (best.size - best.links) < page.size - page.links):
        best = best.parent
    return best


def is_navigation(node: Node) -> bool:
    """Whether no region of a subtree is worth anything and most of its text is in links, or its element says so."""
    return node.region <= 0 and (node.tag in CHROME or node.tag != "a" and node.links > LINK_SHARE * node.size)


def page_blocks(html: str | None, least: int = 10, selectors: tuple[str, ...] = lexicon.IGNORED, deepest: int = 10) -> list[tuple]:
    """(index, text, xpath, tag, attributes, block type, start, end); offsets count in the texts joined by blank
    lines. An accepted block takes all that is in it. Where a page says nothing of its main content by article or main,
    menus and other navigation below the content root are left out."""
    out, at = [], 0
    tree = Tree(html or "")
    root = content_root(tree)
    told = root.tag in ("article", "main")
    stack = [c for c in reversed(root.children) if isinstance(c, Node)]
    while stack:
        node = stack.pop()
        if not told and is_navigation(node):
            continue
        if node.tag in lexicon.CONTENT_TAGS and node.visible and node.most > least and not ignored(node, selectors):
            text = own_text(node, least, selectors, deepest)
            if len(text.strip()) >= least and VISIBLE.search(text):
                out.append((len(out), text, xpath(node), node.tag, attributes(node), BLOCK_TYPE.get(node.tag, "text"), at, at + len(text)))
                at += len(text) + 2
                continue
        stack += [c for c in reversed(node.children) if isinstance(c, Node)]
    return out


def page_meta(html: str | None) -> tuple:
    """title, description, declared language."""
    title = description = lang = None
    for node in walk(Tree(html or "").root):
        if node.tag == "title" and title is None:
            title = all_text(node)
        elif node.tag == "meta" and node.attrs.get("name", "").lower() == "description" and description is None:
            description = node.attrs.get("content")
        elif node.tag == "html" and lang is None:
            lang = node.attrs.get("lang")
    return title, description, lang


def page_links(html: str | None) -> list[tuple]:
    found = ((n.attrs["href"], all_text(n), n.attrs.get("title"), xpath(n)) for n in walk(Tree(html or "").root) if n.tag == "a" and n.attrs.get("href"))
    return [x for x in found if x[1]]


def page_images(html: str | None) -> list[tuple]:
    return [(n.attrs.get("src"), n.attrs["alt"].strip(), n.attrs.get("title"), xpath(n)) for n in walk(Tree(html or "").root) if n.tag == "img" and n.attrs.get("alt", "").strip()]


def failure(html: str | None) -> str | None:
    """What the parser says of markup that it can't read."""
    try:
        Tree(html or "")
    except (AssertionError, ValueError, RecursionError) as error:
        return f"{type(error).__name__}: {error}"
    return None


def _generate(pages: DataFrame, names: list[str], kinds: list[pa.DataType], schema: str, rows: Callable[[str | None], list[tuple]], carry: tuple[str, ...] = ()) -> DataFrame:
    """page_id and the columns `carry` with each row that `rows` makes of its html. A page that can't be parsed has no row and stops no other
    page; parse_failures() lists such pages."""

    def made_of(html: str | None) -> list[tuple]:
        try:
            return rows(html)
        except (AssertionError, ValueError, RecursionError):
            if failure(html) is None:  # not the markup's fault
                raise
            return []

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "html", *carry)
    out = StructType([source.schema["page_id"], *[source.schema[c] for c in carry], *StructType.fromDDL(schema).fields])
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in slices(batches):
            made = [(i, *row) for i, html in enumerate(batch.column(1).to_pylist()) for row in made_of(html)]
            at, *columns = list(zip(*made, strict=True)) or [()] * (len(names) + 1)
            at = pa.array(at, pa.int64())
            kept = [batch.column(i).take(at) for i in (0, *range(2, 2 + len(carry)))]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], schema=arrow)

    return source.mapInArrow(run, out)


def parse_failures(pages: DataFrame) -> DataFrame:
    """page_id and error of pages whose markup can't be parsed."""
    return _generate(pages, ["error"], [pa.string()], "error string", lambda html: [(x,)] if (x := failure(html)) else [])


def configured_blocks(pages: DataFrame, config: AuditConfig, carry: tuple[str, ...] = ()) -> DataFrame:
    """extract_blocks() by an audit's settings."""
    return extract_blocks(pages, config.min_block_chars, config.ignore_selectors, carry, config.max_nesting)


def extract_blocks(pages: DataFrame, least: int = 10, selectors: tuple[str, ...] = lexicon.IGNORED, carry: tuple[str, ...] = (), deepest: int = 10) -> DataFrame:
    """A row for each text block of a page; html_chars is the length of the page; carry are columns of pages that
    go along, of any type."""
    tests(selectors)
    text = pa.string()
    return _generate(
        pages, ["block_idx", "text", "xpath", "tag_name", "attributes", "block_type", "offset_start", "offset_end", "html_chars"], [pa.int32(), text, text, text, pa.map_(text, text), text, pa.int32(), pa.int32(), pa.int64()],
        "block_idx int, text string, xpath string, tag_name string, attributes map<string, string>, block_type string, offset_start int, offset_end int, html_chars bigint", lambda html: [(*b, len(html)) for b in page_blocks(html, least, selectors, deepest)], carry,
    )


def extract_meta(pages: DataFrame) -> DataFrame:
    return _generate(pages, ["title", "meta_description", "declared_language"], [pa.string()] * 3, "title string, meta_description string, declared_language string", lambda html: [page_meta(html)])


def extract_links(pages: DataFrame) -> DataFrame:
    return _generate(pages, ["url", "text", "title", "xpath"], [pa.string()] * 4, "url string, text string, title string, xpath string", page_links)


def extract_images(pages: DataFrame) -> DataFrame:
    return _generate(pages, ["src", "alt", "title", "xpath"], [pa.string()] * 4, "src string, alt string, title string, xpath string", page_images)
