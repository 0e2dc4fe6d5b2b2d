"""Main text of web pages by tree scoring.

A page becomes a tree of its elements. Every paragraph passes points for its
length and commas to its ancestors, fewer with each step up; a container's
points are discounted by the share of its characters in links. The best
container leads to the element around it that holds the whole article: one
marked as such and low in links. This one, or else the best container, is kept
with all its blocks and those of its siblings that look like it, in page order.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from glyphflow.llm import words as W
from glyphflow.llm.frames import small_batches

# Roles of elements in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
JUNK_TAGS = frozenset("nav footer aside button select menu dialog object audio video canvas fieldset head map".split())
# Elements of a form that hold its own words.
CONTROLS = frozenset("label legend option optgroup button select output datalist".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
# Words in class or id that name something other than the article.
JUNK_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie "
    "cookies disqus feedback footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification "
    "outbrain pager pagination paywall popup promo promotion recommended related replies reply respond rss share sharing sidebar "
    "signup skip social sponsor sponsored subscribe subscription taboola toolbar widget".split()
)
JUNK_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
GOOD_WORDS = frozenset("article body content entry main page post story text".split())
# Those of them that name an element that holds an article whole; "page", "body" and "text" also name wrappers and parts.
CONTENT_WORDS = frozenset("article content entry main post story".split())
# Points a container starts with.
START = {"article": 25, "main": 20, "section": 5, "div": 5, "td": 3, "blockquote": 3, "pre": 3, "body": 0}
# Share of link characters up to which an element that holds the best container is the article.
MAX_LINKED = 1 / 3

_ATTRIBUTES = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_MARK = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*+(?:=\s*+("[^"]*+"|'[^']*+'|[^\s>"']++))?""", re.IGNORECASE)
_SPLIT = re.compile(r"[^a-z0-9]+")


class Node:
    """An element: its tag, parent, and children or texts in order."""

    __slots__ = ("tag", "parent", "items", "junk", "bonus", "content", "block", "inline_open")

    def __init__(self, tag: str, parent: Node | None):
        self.tag = tag
        self.parent = parent
        # The innermost block element around; it counts the inline elements open in it.
        self.block: Node = parent.block if parent is not None and tag in INLINE else self
        self.inline_open: dict[str, int] = {}
        self.items: list[Node | str] = []
        self.junk = False
        self.bonus = 0
        self.content = False


def _marks(node: Node, attributes: str) -> None:
    """Judge an element by its tag, class, id and role."""
    node.junk = node.tag in JUNK_TAGS
    if not attributes or ("=" not in attributes and "hidden" not in attributes):
        return
    for name, value in _MARK.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            node.junk = True
        elif name == "role":
            node.junk |= value in JUNK_ROLES
        elif name in ("class", "id"):
            named = set(_SPLIT.split(value))
            if node.tag not in ("body", "html", "article", "main"):
                # "post-content" is content, "post-comments" is not.
                node.junk |= bool(named & JUNK_WORDS)
            node.bonus += 10 * bool(named & GOOD_WORDS)
            node.content |= bool(named & CONTENT_WORDS) and node.tag not in INLINE and node.tag not in ("body", "html")


class _Open:
    """The open elements while a page is read. Each is left once, and no step looks at elements that stay open."""

    def __init__(self, root: Node):
        self.node = root
        self.blocks: Counter[str] = Counter()

    def enter(self, child: Node) -> None:
        self.node = child
        counts = child.block.inline_open if child.tag in INLINE else self.blocks
        counts[child.tag] = counts.get(child.tag, 0) + 1

    def leave(self, until: Node) -> None:
        """Close everything below `until`."""
        while self.node is not until:
            counts = self.node.block.inline_open if self.node.tag in INLINE else self.blocks
            counts[self.node.tag] -= 1
            self.node = self.node.parent

    def close(self, tag: str) -> None:
        """An end tag; one that closes nothing is ignored, and an inline one closes nothing beyond its block."""
        counts = self.node.block.inline_open if tag in INLINE else self.blocks
        if not counts.get(tag):
            return
        at = self.node
        while at.tag != tag:
            at = at.parent
        self.leave(at.parent)

    def make_room(self, tag: str) -> None:
        """Close what a new `tag` ends."""
        if tag not in INLINE and self.node.tag == "head":
            self.leave(self.node.parent)
        if tag in CLOSES:
            ended, fence = CLOSES[tag]
            if any(self.blocks.get(x) for x in ended):
                at, last = self.node, None
                while at.parent is not None and at.tag not in fence:
                    last = at if at.tag in ended else last
                    at = at.parent
                if last is not None:
                    self.leave(last.parent)
        elif tag not in INLINE and self.node.block.tag == "p":
            self.leave(self.node.block.parent)

    def text(self, words: str) -> None:
        # Text is no part of a head, whose end tag may be missing.
        if self.node.tag == "head" and words.strip():
            self.leave(self.node.parent)
        self.node.items.append(words)


def parse(page: str) -> Node:
    """The tree of a page; broken mark-up is closed where a browser would close it."""
    root = Node("html", None)
    stack = _Open(root)
    at, size = 0, len(page)
    while at < size:
        low = page.find("<", at)
        if low < 0:
            stack.text(page[at:])
            break
        if low > at:
            stack.text(page[at:low])
        after = page[low + 1:low + 2]
        if after == "!" or after == "?":
            if page.startswith("<!--", low):
                end = page.find("-->", low + 4)
                at = size if end < 0 else end + 3
            else:
                end = page.find(">", low)
                at = size if end < 0 else end + 1
            continue
        closing = after == "/"
        name = _NAME.match(page, low + 1 + closing)
        if name is None:
            stack.text("<")
            at = low + 1
            continue
        tag = name.group().lower()
        end = _ATTRIBUTES.match(page, name.end())
        at = end.end() if end else (page.find(">", low) + 1 or size)
        if closing:
            stack.close(tag)
            continue
        attributes = page[name.end():at - 1]
        if tag in RAW:
            stop = re.compile(f"</{re.escape(tag)}(?![a-z0-9])", re.IGNORECASE).search(page, at)
            end = page.find(">", stop.end()) if stop else -1
            at = size if end < 0 else end + 1
            continue
        if tag == "br":
            stack.text("\n")
            continue
        if tag in VOID or tag == "html":
            continue
        stack.make_room(tag)
        child = Node(tag, stack.node)
        _marks(child, attributes)
        stack.node.items.append(child)
        if not attributes.endswith("/") or tag not in INLINE:
            stack.enter(child)
    return root


def _preorder(root: Node, junk: bool) -> list[Node]:
    """The elements, each before what it holds; with what is in junk, or without."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if junk or not node.junk:
            out.append(node)
            todo += [x for x in reversed(node.items) if isinstance(x, Node)]
    return out


def _drop(root: Node) -> None:
    """Mark page headers and forms.

    A header inside an article that holds its heading stays; so does a form
    that the whole page stands in: one with more than half of the page's text
    outside of controls.
    """
    nodes = _preorder(root, junk=True)
    heads: set[Node] = set()
    size: dict[Node, int] = {}
    for node in reversed(nodes):
        size[node] = size.get(node, 0) + sum(len(x.strip()) for x in node.items if isinstance(x, str))
        if node.parent is not None:
            if node in heads or node.tag in ("h1", "h2"):
                heads.add(node.parent)
            if node.tag not in CONTROLS and not node.junk:
                size[node.parent] = size.get(node.parent, 0) + size[node]
    inside: set[Node] = set()
    for node in nodes:
        if node.parent in inside or node.tag in ("article", "main"):
            inside.add(node)
        if node.tag == "header" and not (node.parent in inside and node in heads):
            node.junk = True
        if node.tag == "form" and 2 * size[node] <= size[root]:
            node.junk = True


def _blocks(root: Node) -> Iterator[tuple[Node, str, int]]:
    """Block element, text and link characters of every block that is not junk, in page order."""
    parts: list[str] = []
    linked = 0
    # None ends the block that the pair's element holds.
    todo: list[tuple[object, Node, bool]] = [(root, root, False)]
    while todo:
        item, owner, link = todo.pop()
        if isinstance(item, str):
            parts.append(item)
            if link:
                linked += len(item.strip())
            continue
        if item is None:
            text = _clean(parts)
            if text:
                yield owner, text, linked
            parts, linked = [], 0
            continue
        if item.junk:
            # A block left out still parts what stands around it.
            if item.tag not in INLINE:
                todo.append((None, owner, link))
            continue
        if item.tag in INLINE:
            todo += [(x, owner, link or item.tag == "a") for x in reversed(item.items)]
        else:
            todo.append((None, item, link))
            todo += [(x, item, link) for x in reversed(item.items)]
            todo.append((None, owner, link))


def _clean(parts: list[str]) -> str:
    text = "".join(parts)
    if "&" in text:
        text = unescape(text)
    return " ".join(text.split())


def _article(best: Node, chars: dict[Node, int], links: dict[Node, int]) -> Node:
    """The outermost article, else main element, else element named as content that is or holds `best` and is low in links; else `best`."""
    chain, node = [], best
    while node is not None:
        if links[node] <= MAX_LINKED * chars[node]:
            chain.append(node)
        node = node.parent
    marked = ([x for x in chain if x.tag == "article"], [x for x in chain if x.tag == "main"], [x for x in chain if x.content])
    return next((found[-1] for found in marked if found), best)


def main_text(page: str) -> str:
    """Blocks of the article, joined by newlines; empty if there is none."""
    root = parse(page)
    _drop(root)
    blocks = list(_blocks(root))
    if not blocks:
        return ""
    nodes = _preorder(root, junk=False)
    gained: dict[Node, float] = {}
    first: dict[Node, int] = {}
    chars = dict.fromkeys(nodes, 0)
    links = dict.fromkeys(nodes, 0)
    for i, (owner, text, linked) in enumerate(blocks):
        gain = 1 + text.count(",") + min(len(text) / 100, 3)
        node = owner if owner.tag in START else owner.parent or owner
        # Link lists are no prose, headings are not what makes an article.
        if linked <= len(text) / 2 and not _is_heading(owner):
            gained[node] = gained.get(node, 0) + gain
            first.setdefault(node, i)
        chars[owner] += len(text)
        links[owner] += linked
    # Sums go up once, from the leaves: half the points, all the characters.
    depth = {root: 0}
    for node in nodes[1:]:
        depth[node] = depth[node.parent] + 1
    for node in reversed(nodes[1:]):
        chars[node.parent] += chars[node]
        links[node.parent] += links[node]
        if node in gained:
            gained[node.parent] = gained.get(node.parent, 0) + gained[node] / 2
            first[node.parent] = min(first[node], first.get(node.parent, first[node]))
    score = {}
    for node, points in gained.items():
        score[node] = (points + START.get(node.tag, -3) + node.bonus) * (1 - min(1, links[node] / max(1, chars[node])))
    # Of equal ones the first on the page, the innermost of these.
    best = max(score, key=lambda n: (score[n], -first[n], depth[n])) if score else root
    best = _article(best, chars, links)
    kept = {best}
    if best.parent is not None and score:
        for x in best.parent.items:
            if isinstance(x, Node) and not x.junk and x is not best and chars[x]:
                prose = x.tag == "p" and chars[x] > 80 and links[x] < 0.25 * chars[x]
                if _is_heading(x) or prose or (score.get(x, 0) >= max(10, 0.2 * score.get(best, 0)) and x.tag == best.tag):
                    kept.add(x)
    for node in nodes[1:]:
        if node.parent in kept:
            kept.add(node)
    return "\n".join(text for owner, text, _ in blocks if owner in kept)


def _is_heading(node: Node) -> bool:
    return node.tag[0] == "h" and node.tag[1:].isdigit()


def extract(pages: DataFrame, keys: tuple[str, ...] = ("page_id",), html: str = "html") -> DataFrame:
    """The key columns and `text`, one row for each input row.

    A null or empty page, or one without text, has an empty text. Rows are
    independent: repeated rows give repeated rows, other columns of `pages` do
    not matter, a page of any length is read whole, and nothing is shuffled.
    """
    small_batches(pages.sparkSession)
    schema = T.StructType([*(pages.schema[k] for k in keys), T.StructField("text", T.StringType())])
    last = str(len(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches, last):
            texts = [main_text(p) if p else "" for p in part.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], [f.name for f in schema])

    return pages.select(*keys, html).toDF(*map(str, range(len(keys) + 1))).mapInArrow(run, schema)
