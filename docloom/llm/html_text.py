"""Main text of HTML pages by composite text density.

The page is parsed into a tree with the usual implied end tags. Scripts, styles, forms, menus, headers, footers, sidebars
and notices are pruned by tag and role. For every node left, the density is its characters per tag, weighted down by its
share of link characters and link tags; a node's density sum adds those of its children.
The node with the largest sum is the centre; the least density on the path from it to the body is the threshold, and
the centre grows to an ancestor below the body as long as a sibling on the way reaches the threshold. An `article` or
`main` element around the centre is taken whole. Other elements right below the body are main text too where their density
reaches the threshold. The text of these subtrees is split at block elements; white space inside
a block becomes one space, empty blocks go, blocks are joined by one line end.

Class and id names are evidence against a node, not a verdict: a name of reader comments, consent notices, adverts and
the like prunes it; a name that may also mark a layout (side, widget, social, ...) prunes it only if the node holds less
than half of the text that is left, or is full of links, and has no name of main text beside it. Where nothing would be
left, names don't count.

Null and empty html give an empty text; pages cut off anywhere are closed at their end; text without any element is its
own main text; parsing takes time in proportion to the page, however it is nested or left open. Rows are independent of
each other: repeated ids stay as they are, and columns not asked for are ignored; a column in `keep` can't be named text
or n_chars.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_START = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][^\s/>\x00]*))")
_COMMENT_END = re.compile(r"--!?>")
_IN_TAG = re.compile(r"[^>\"']*")
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - frozenset("body caption dd dt head html legend li summary tbody td tfoot th thead tr".split()) | {"li", "dd", "dt"}
#: Start tag -> the open elements that it ends, and where the search for them stops.
_ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "tbody": (frozenset("tbody thead tfoot".split()), frozenset(["table"])),
    "tfoot": (frozenset("tbody thead tfoot".split()), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
_SCOPE = frozenset("td th table caption html body button object".split())
_PRUNED = frozenset("head script style noscript template iframe object embed svg canvas form button select textarea input label fieldset nav menu aside footer dialog title audio video map noembed noframes xmp".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words of class and id names.
_NEVER = frozenset("ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored cookie cookies consent gdpr popup popups modal newsletter subscribe subscription subscriptions signup login breadcrumb breadcrumbs sidebar sidebars comment comments commentlist disqus replies respond footer masthead topbar toolbar pagination pager copyright navbar navigation menu menus".split())
_RARELY = frozenset("banner banners promo promos promotion promoted notice notices alert alerts overlay nav side widget widgets related recommend recommended recommendations share sharing social foot skip".split())
_MAIN = frozenset("article articles post story entry main content body text blog news hentry".split())
#: Beside one of these a word tells of a feature of the node, not of its kind.
_FEATURE = frozenset("has have with without no not is enabled disabled open closed allow allowed show hide hidden active on off type format layout page template single category tag status".split())
_WORD = re.compile(r"[A-Za-z]+")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|\Z|["'])""", re.I)


class Node:
    __slots__ = ("tag", "attributes", "children", "parent", "pruned", "own", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Node | str] = []
        self.pruned, self.own = False, -1


def _tag_end(page: str, at: int, missing: set[str]) -> tuple[int, int]:
    """Where the attributes of a tag end and what comes after it. A quote that never closes is a character like any other."""
    n = len(page)
    while True:
        at = _IN_TAG.match(page, at).end()
        if at >= n:
            return n, n
        mark = page[at]
        if mark == ">":
            return at, at + 1
        end = -1 if mark in missing else page.find(mark, at + 1)
        if end < 0:
            missing.add(mark)
        at = at + 1 if end < 0 else end + 1


def parse(page: str) -> Node:
    root = Node("#root", "", None)
    at, n, missing = 0, len(page), set()
    stack: list[Node] = [root]
    opened: dict[str, list[int]] = {}  # places in the stack, by tag, of the open elements

    def last(tags: frozenset) -> int:
        """Place of the last open element with one of the tags, 0 where there is none."""
        depth = 0
        for t in tags & opened.keys():
            depth = max(depth, opened[t][-1])
        return depth

    def pop(depth: int) -> None:
        while len(stack) > depth:
            tag = stack.pop().tag
            places = opened[tag]
            places.pop()
            if not places:
                del opened[tag]

    def close(tags: frozenset, stop: frozenset) -> None:
        depth = last(tags)
        if depth and depth > last(stop):
            pop(depth)

    def push(node: Node) -> None:
        opened.setdefault(node.tag, []).append(len(stack))
        stack.append(node)

    while at < n:
        m = _START.search(page, at)
        text = page[at : n if m is None else m.start()]
        if text:
            stack[-1].children.append(html.unescape(text))
        if m is None:
            break
        at = m.end()
        if m[1]:
            end = None if page[at : at + 1] == ">" or page[at : at + 2] == "->" else _COMMENT_END.search(page, at)
            at = page.index(">", at) + 1 if page[at : at + 1] == ">" or page[at : at + 2] == "->" else n if end is None else end.end()
            continue
        if m[2] or m[3]:
            mark = "]]>" if m[2] else ">"
            end = page.find(mark, at)
            at = n if end < 0 else end + len(mark)
            continue
        tag = m[5].lower()
        end, after = _tag_end(page, at, missing)
        attributes, at = page[at:end], after
        if m[4]:
            if tag == "br":
                stack[-1].children.append(" ")
            else:
                close(frozenset([tag]), frozenset() if tag in ("body", "html", "table", "article", "div", "section") else frozenset(["table"]) if tag not in _ENDS else _ENDS[tag][1])
            continue
        if tag in ("html", "body"):
            if stack[-1].tag == "head":
                pop(len(stack) - 1)
            if tag in opened:
                continue
        if tag in _CLOSES_P:
            close(frozenset(["p"]), _SCOPE)
        if tag in _ENDS:
            close(*_ENDS[tag])
        node = Node(tag, attributes, stack[-1])
        stack[-1].children.append(node)
        if tag in _RAW:
            found = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = n if found is None else found.start()
            push(node)
        elif tag not in _VOID and not attributes.endswith("/") or tag in ("p", "div", "article", "section", "body"):
            push(node)
    return root


def _evidence(names: list[str]) -> tuple[bool, bool, bool]:
    """Whether names speak strongly against a node, weakly against it, or for it."""
    never = rarely = main = False
    for name in names:
        words = set(_WORD.findall(name))
        if not words & _FEATURE:
            never |= not words.isdisjoint(_NEVER)
            rarely |= not words.isdisjoint(_RARELY)
            main |= not words.isdisjoint(_MAIN) and words.isdisjoint(_NEVER | _RARELY)
    return never, rarely, main


def prune(root: Node) -> list[tuple[Node, bool, bool, bool]]:
    """Marks what cannot be main text by its tag or role; children of a pruned node are not looked at. Returns nodes whose names speak against them."""
    stack, named = [(root, False)], []
    while stack:
        x, in_article = stack.pop()
        if x.tag in _PRUNED or x.tag == "header" and not in_article:
            x.pruned = True
            continue
        if x.attributes and x.tag not in ("html", "body", "article", "main"):
            names: list[str] = []
            for name, value in _ATTRIBUTE.findall(x.attributes):
                name, value = name.lower(), value.strip("\"'").lower()
                if name in ("class", "id"):
                    names += value.split()
                elif name == "hidden" or name == "role" and value in _ROLES or name == "aria-hidden" and value == "true":
                    x.pruned = True
            if x.pruned:
                continue
            found = _evidence(names)
            if found[0] or found[1]:
                named.append((x, *found))
        in_article = in_article or x.tag == "article"
        stack += [(c, in_article) for c in x.children if isinstance(c, Node)]
    return named


def prune_named(root: Node, named: list[tuple[Node, bool, bool, bool]]) -> list[Node]:
    """Marks what its names speak against, the weaker names weighed by the text that is left; returns the nodes left."""
    order = count(root)
    for weak in (False, True):
        whole, changed = root.chars, False
        for x, never, rarely, main in named:
            if not x.pruned and (rarely if weak else never):
                light = 2 * x.chars < whole or 3 * x.link_chars > x.chars
                x.pruned = light or not weak and not main
                changed |= x.pruned
        if changed:
            order = count(root)
    return order


def count(root: Node) -> list[Node]:
    """Characters, tags and links of the nodes left; returns them, parents first."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        if x.own < 0:
            x.own = sum(len("".join(c.split())) for c in x.children if isinstance(c, str))
        x.chars, x.tags, x.link_chars, x.link_tags = x.own, 0, 0, 0
        stack += [c for c in reversed(x.children) if isinstance(c, Node) and not c.pruned]
    for x in reversed(order):
        if x.tag == "a":
            x.link_chars = x.chars
        up = x.parent
        if up is not None:
            up.chars += x.chars
            up.tags += x.tags + 1
            up.link_chars += x.link_chars
            up.link_tags += x.link_tags + (x.tag == "a")
    return order


def measure(order: list[Node]) -> None:
    """Densities and density sums of the nodes that count() returned."""
    whole = order[0]
    body_chars, body_links = max(1, whole.chars), whole.link_chars
    for x in order:
        c, t, lc, lt = x.chars, max(1, x.tags), x.link_chars, x.link_tags
        if not c:
            x.density = 0.0
            continue
        base = math.log(c / max(1, c - lc) * lc + body_links / body_chars * c + math.e)
        x.density = c / t * math.log(max(1.0, c / max(1, lc)) * (t / max(1, lt)) + (0 if lc or lt else math.e - 1), max(base, 1.0001))
        x.density = max(x.density, 0.0)
    for x in order:
        x.total = x.density * x.own / x.chars if x.own else 0.0  # text right below a node counts as a child
    for x in order:
        if x.parent is not None:
            x.parent.total += x.density


def _above(node: Node) -> Iterator[Node]:
    while node.parent is not None:
        node = node.parent
        yield node


def centres(order: list[Node]) -> list[Node]:
    """The main subtrees in order of the page: one, or several right below the body."""
    body = next((x for x in order if x.tag == "body"), order[0])
    best = max(order, key=lambda x: x.total)
    path = [best, *(a for a in _above(best))]
    if body in path:
        path = path[: path.index(body) + 1]
    least, on_path = min(x.density for x in path), set(map(id, path))
    for a in path[1:]:
        if a is body or a.parent is None:
            break
        if any(isinstance(c, Node) and not c.pruned and id(c) not in on_path and c.density >= least and c.chars for c in a.children):
            best = a
    for a in [best, *_above(best)]:
        if a.tag in ("article", "main"):
            best = a
    above = list(_above(best))
    if body not in above:  # the body itself is the centre: whole
        return [best]
    own = [best, *above][above.index(body)]
    return [best if c is own else c for c in body.children if isinstance(c, Node) and not c.pruned and (c is own or c.chars and c.density >= least)]


def text_of(node: Node) -> str:
    blocks: list[str] = []
    words: list[str] = []

    def flush() -> None:
        line = " ".join("".join(words).split())
        if line:
            blocks.append(line)
        words.clear()

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            words.append(x)
        elif x.pruned:
            continue
        elif x.tag == "br":
            words.append(" ")
        else:
            if x.tag in _BLOCK:
                flush()
                stack.append(None)
            stack += reversed(x.children)
    flush()
    return "\n".join(blocks)


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    named = prune(root)
    order = prune_named(root, named)
    if named and not root.chars:
        for x, *_ in named:
            x.pruned = False
        order = count(root)
    measure(order)
    return "\n".join(t for t in map(text_of, centres(order)) if t)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row per page: id, the columns to keep, text, n_chars."""
    if {"text", "n_chars"} & {id_col, *keep}:
        raise ValueError("a column to keep can't be named text or n_chars")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                texts = [main_text(h) for h in part.column(part.num_columns - 1).to_pylist()]
                yield pa.record_batch([*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, *keep, "text", "n_chars"])

    source = pages.select(F.col(id_col), *(F.col(k) for k in keep), F.col(html_col).cast("string").alias("__html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]) + ", text string, n_chars long"
    return source.mapInArrow(each, schema)
