"""Main text of web pages by composite text density."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objcat.llm.common import slices

# How HTML's elements behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {  # a start tag ends these open elements, unless one of the third kind is in between
    **dict.fromkeys(BLOCK - {"html", "body", "li", "dd", "dt", "tr", "td", "th", "tbody", "thead", "tfoot", "caption"}, ({"p"}, {"table", "td", "th", "caption"})),
    "li": ({"p", "li"}, {"ul", "ol", "menu", "table", "div", "section"}),
    "dd": ({"p", "dd", "dt"}, {"dl", "table"}),
    "dt": ({"p", "dd", "dt"}, {"dl", "table"}),
    "tr": ({"p", "tr", "td", "th"}, {"table"}),
    "td": ({"p", "td", "th"}, {"tr", "table"}),
    "th": ({"p", "td", "th"}, {"tr", "table"}),
    "tbody": ({"p", "tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"p", "tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements that are never part of the main text.
NEVER = frozenset(
    "head script style template noscript title iframe object embed applet canvas svg annotation annotation-xml audio video map nav footer aside form button select "
    "textarea input label fieldset dialog menu search".split()
)
# Words of class, id and role that name what surrounds a main text, and words that may stand beside them in one name. A name
# with any other word in it (has-sidebar, related-work, hidden-xs) says nothing.
AROUND = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|nav|navbar|navigation|menu|menubar|"
    r"breadcrumbs?|sidebar|side|complementary|contentinfo|footer|masthead|comments?|commentlist|disqus|replies|reply|respond|feedback|discussions?|reactions?|opinions|share|sharing|social|related|recommended|"
    r"newsletter|subscribe|subscription|signup|login|search|pagination|pager|widget|toolbar|skip|hidden"
)
BESIDE = re.compile(r"site|page|posts?|articles?|stories|links?|buttons?|icons?|list|items?|box|bar|block|area|section|container|wrapper|wrap|inner|form|policy|primary|secondary|main|top|bottom|to|content|readers?|users?|guests?|\d*")
# What the class, id or itemprop of a comment's author and time are called, as the rest of a name or on its own.
AUTHOR = re.compile(r"author|user|avatar|byline|nick|poster|commenter")
TIME = re.compile(r"date|time|posted|\bago\b")
THREAD = 3  # so many like elements in a row may be a thread of comments
# What a < begins: a comment, a tag (only its name is read), or a declaration.
OPENS = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*)|<[!?/]", re.S)
STOPS = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s"'/]|$)""", re.I | re.S)


class Node:
    __slots__ = ("tag", "parent", "parts", "out", "marks", "chars", "tags", "linked", "links", "density", "total", "named")

    def __init__(self, tag: str, parent: Node | None, out: bool, marks: str = ""):
        self.tag, self.parent, self.out, self.marks = tag, parent, out, marks
        self.parts: list[Node | str] = []
        self.chars = self.tags = self.linked = self.links = 0
        self.density = self.total = 0.0
        self.named = False  # as what surrounds a main text


def _surrounds(value: str) -> bool:
    """Whether one of the names in a class, id or role is made of words for surroundings, as a whole."""
    for name in value.split():
        parts = re.split("[_-]+", name)
        if any(AROUND.fullmatch(p) for p in parts) and all(AROUND.fullmatch(p) or BESIDE.fullmatch(p) for p in parts):
            return not ("main" in parts and "content" in parts and "skip" not in parts)
    return False


def _left_out(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool, str]:
    """Whether an element is out, whether it is named as surroundings, and its marks."""
    if tag in NEVER or tag == "header" and not in_article:
        return True, False, ""
    marks, named = "", False
    for name, value in ATTRIBUTE.findall(attributes) if attributes.strip() else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, False, ""
        named = named or name in ("class", "id", "role") and tag not in ("html", "body", "article", "main") and _surrounds(value)
        marks += f" {name}={value}"
    return False, named, marks


class _Ends:
    """Finds the > that ends a tag, outside quotes.

    Which quotes are known to lead to the end of the page without one is kept, so that all the searches for a page
    together take time in proportion to its length, however many of its quotes are open.
    """

    def __init__(self, html: str):
        self.html, self.last, self.vain = html, {c: html.rfind(c) for c in ">\"'"}, set()

    def of(self, at: int) -> int:
        """Where the tag that begins before `at` ends, quotes skipped; without such an end, at the next >; else -1."""
        if at > self.last[">"]:
            return -1
        place, passed = at, []
        while stop := STOPS.search(self.html, place):
            begin, sign = stop.start(), stop.group()
            if sign == ">":
                return begin
            passed.append(begin)
            if begin in self.vain or begin == self.last[sign]:
                break
            place = self.html.find(sign, begin + 1) + 1
        self.vain.update(passed)
        return self.html.find(">", at)


class _Open:
    """The open elements, outermost first, and for each tag how deep its open elements are."""

    def __init__(self, root: Node):
        self.path, self.depths = [], {}
        self.blocks: list[int] = []
        self.push(root)

    def push(self, node: Node) -> None:
        self.depths.setdefault(node.tag, []).append(len(self.path))
        if node.tag in BLOCK:
            self.blocks.append(len(self.path))
        self.path.append(node)

    def cut(self, depth: int) -> None:
        """End all elements from this depth on, but never the root."""
        while len(self.path) > max(1, depth):
            node = self.path.pop()
            self.depths[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()

    def deepest(self, tags: Iterable[str]) -> int:
        return max((d[-1] for t in tags if (d := self.depths.get(t))), default=-1)

    def end(self, tag: str) -> None:
        """An end tag ends the last element of its name; out of a block it does not reach, unless it is a block's."""
        depth = self.deepest((tag,))
        if depth > 0 and (tag in BLOCK or depth > self.blocks[-1]):
            self.cut(depth)

    def end_before(self, ended: Iterable[str], barrier: Iterable[str]) -> None:
        """End the outermost element of `ended` within the last open one of `barrier`."""
        wall = self.deepest(barrier)
        found = [d[k] for t in ended if (d := self.depths.get(t)) and (k := bisect_right(d, wall)) < len(d)]
        if found:
            self.cut(min(found))


def parse(html: str) -> Node:
    """The tree of elements and texts of a page, however broken: open elements are ended where HTML says so.

    Time is in proportion to the page's length, whatever is left open in it.
    """
    root = Node("html", None, False)
    opened, ends, at, size, body = _Open(root), _Ends(html), 0, len(html), False

    while at < size:
        begin = html.find("<", at)
        here = opened.path[-1]
        if begin < 0:
            here.parts.append(unescape(html[at:]))
            break
        whole = html.startswith("<!--", begin)
        match = OPENS.match(html, begin) if whole or begin < ends.last[">"] else None
        tag = match and match.group(2)
        stop = -1 if not match else match.end() - 1 if whole else ends.of(match.end()) if tag else html.find(">", match.end())
        if stop < 0:
            here.parts.append(unescape(html[at : begin + 1]))  # a lone < is text
            at = begin + 1
            continue
        if begin > at:
            here.parts.append(unescape(html[at:begin]))
        at = stop + 1
        if not tag:
            continue  # comment, doctype or the like
        tag, attributes = tag.lower(), html[match.end() : stop]
        if match.group(1):
            opened.end(tag)
            continue
        if tag in ("html", "body"):
            if tag == "body" and not body:
                body = True
                opened.cut(1)
                node = Node("body", root, False)
                root.parts.append(node)
                opened.push(node)
            continue
        opened.end_before(*CLOSES.get(tag, ((), ())))
        if tag in HEADINGS and opened.path[-1].tag in HEADINGS:
            opened.cut(len(opened.path) - 1)
        if tag in BLOCK and opened.path[-1].tag == "head":
            opened.cut(len(opened.path) - 1)
        here = opened.path[-1]
        out, named, marks = _left_out(tag, attributes, opened.deepest(("article", "main")) > 0)
        node = Node(tag, here, out or here.out, marks)
        node.named = named
        here.parts.append(node)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b", re.I).search(html, at)
            close = html.find(">", end.end()) if end else -1
            if tag == "textarea":
                node.parts.append(html[at : end.start() if close >= 0 else size])
            at = close + 1 if close >= 0 else size
            continue
        opened.push(node)
    _leave_out_named(root)
    _leave_out_threads(root)
    return root


def _leave_out_named(root: Node) -> None:
    """Leave out what is named as surroundings, unless it holds most of the page's text outside links.

    Where an article or main has a twentieth of that text outside of it, it surrounds all the same, like long comments.
    """
    nodes = _order(root)
    if not any(n.named for n in nodes):
        return
    at = {id(n): i for i, n in enumerate(nodes)}
    plain, last = [0] * len(nodes), list(range(len(nodes)))  # of each node, its text outside links and the last node inside it
    for i in reversed(range(len(nodes))):
        for part in nodes[i].parts:
            if isinstance(part, str):
                plain[i] += len(" ".join(part.split()))
            elif not part.out:
                plain[i] += plain[at[id(part)]]
                last[i] = max(last[i], last[at[id(part)]])
        if nodes[i].tag == "a":
            plain[i] = 0
    for i, node in enumerate(nodes):
        node.out = node.named and 2 * plain[i] <= plain[0]
    bodies = [k for n in _order(root) if n.tag in ("article", "main") and 20 * plain[k := at[id(n)]] >= plain[0]]
    for i, node in enumerate(nodes):
        if node.named and not node.out:
            beside = [plain[k] - plain[i] * (last[k] >= i > k) for k in bodies if not i <= k <= last[i]]
            node.out = any(b > 0 and 20 * b >= plain[0] for b in beside)


def _leave_out_threads(root: Node) -> None:
    """Leave out threads of reader comments, known by their structure.

    A thread is an element with at least THREAD children of one tag and class, not paragraphs, that hold most of its text,
    after at least a tenth of the page's text. Besides, most of these children name an author and a time, or the thread is
    named as surroundings, or it comes after the end of the page's only article, if that has a tenth of the text.
    Articles in a row are a thread only inside an article, where they are comments. Text counts outside links.
    """
    nodes = _order(root)
    at = {id(n): i for i, n in enumerate(nodes)}
    begin, size, signed = [0] * len(nodes), [0] * len(nodes), [0] * len(nodes)
    around = [frozenset()] * len(nodes)  # which of article and main are around a node
    for i in reversed(range(len(nodes))):
        node = nodes[i]
        signed[i] = bool(AUTHOR.search(node.marks)) + 2 * (node.tag == "time" or bool(TIME.search(node.marks)))
        for part in node.parts:
            if isinstance(part, str):
                size[i] += len(" ".join(part.split()))
            elif not part.out:
                size[i] += size[at[id(part)]]
                signed[i] |= signed[at[id(part)]]
        if node.tag == "a":
            size[i] = 0
    for i, node in enumerate(nodes):
        place, within = begin[i], around[i] | ({node.tag} & {"article", "main"})
        for part in node.parts:
            if isinstance(part, str):
                place += 0 if node.tag == "a" else len(" ".join(part.split()))
            elif not part.out:
                begin[at[id(part)]], around[at[id(part)]] = place, within
                place += size[at[id(part)]]
    outer = [i for i, n in enumerate(nodes) if n.tag in ("article", "main") and size[i] and not around[i]]
    ended = begin[outer[0]] + size[outer[0]] if len(outer) == 1 and 10 * size[outer[0]] >= size[0] else math.inf
    for i, node in enumerate(nodes):
        if not size[i] or 10 * begin[i] < size[0] or node.tag in ("body", "main"):
            continue
        rows: dict[tuple[str, str], list[int]] = {}
        for part in node.parts:
            if isinstance(part, Node) and not part.out and part.tag != "p":
                rows.setdefault((part.tag, " ".join(re.findall("class=([^=]*)(?= |$)", part.marks))), []).append(at[id(part)])
        for (tag, _), row in rows.items():
            if len(row) >= THREAD and 2 * sum(size[k] for k in row) > size[i] and (tag != "article" or "article" in around[i] or node.tag == "article"):
                node.out = node.out or node.named or begin[i] >= ended or 2 * sum(signed[k] == 3 for k in row) > len(row)


def _order(root: Node) -> list[Node]:
    """All nodes that may count, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [n for n in reversed(node.parts) if isinstance(n, Node) and not n.out]
    return out


def measure(root: Node) -> list[Node]:
    """Set the composite density of every node and, as `total`, the sum over its children."""
    nodes = _order(root)
    for node in reversed(nodes):
        link = node.tag == "a"
        for part in node.parts:
            if isinstance(part, str):
                node.chars += len(" ".join(part.split()))
            elif not part.out:
                node.chars += part.chars
                node.tags += part.tags + 1
                node.linked += part.linked
                node.links += part.links + (part.tag == "a")
        if link:
            node.linked = node.chars
    body = next((n for n in nodes if n.tag == "body"), root)
    share = body.linked / max(1, body.chars)
    for node in reversed(nodes):
        c, t, lc, lt = node.chars, max(1, node.tags), node.linked, node.links
        if c:
            # Characters for each tag, damped where much of the text is in links, against the page's own share.
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            node.density = max(0.0, c / t * math.log(c / max(1, lc) * t / max(1, lt)) / math.log(base)) if base > 1 else 0.0
        node.total = sum(n.density for n in node.parts if isinstance(n, Node) and not n.out)
    return nodes


def _path(node: Node) -> list[Node]:
    out = [node]
    while out[-1].parent is not None:
        out.append(out[-1].parent)
    return out


def _articles(node: Node) -> list[Node]:
    """The articles around a node, or else what is marked as the main part around it."""
    path = _path(node)
    return [n for n in path if n.tag == "article" or "itemprop=articlebody" in n.marks] or [n for n in path if n.tag == "main" or "role=main" in n.marks]


def main_nodes(root: Node) -> set[int]:
    """The nodes whose whole content is main text.

    The subtree with the largest sum of densities, widened to the article around it. Beside the path to it from
    the body, other subtrees that are at least as dense as the thinnest node of that path are taken too.
    """
    nodes = measure(root)
    best = max(nodes, key=lambda n: (n.total, n.density))
    if not best.chars:
        return set()
    if best.total == 0.0:
        best = next((n for n in nodes if n.tag == "body"), root)
    wide = _articles(best)
    best = wide[-1] if wide else best
    path = _path(best)
    least, on_path = min(n.density for n in path if n.tag != "html" or len(path) == 1), {id(n) for n in path}
    chosen = {id(best)}
    if not wide:
        for node in path[1:]:
            for part in node.parts:
                if isinstance(part, Node) and not part.out and id(part) not in on_path and part.chars and part.density >= least:
                    chosen.add(id(part))
    return chosen


def main_text(html: str) -> str:
    """Blocks of the main text in page order, joined by line breaks; white space inside a block is one space."""
    root = parse(html)
    chosen = main_nodes(root)
    blocks: list[str] = []
    words: list[str] = []

    def end() -> None:
        block = " ".join("".join(words).split())
        if block:
            blocks.append(block)
        words.clear()

    stack: list[tuple[Node | str | None, bool, bool]] = [(root, False, False)]
    while stack:
        part, taken, block_ends = stack.pop()
        if part is None:
            if block_ends:
                end()
            continue
        if isinstance(part, str):
            if taken:
                words.append(part)
            continue
        if part.out:
            if part.tag in BLOCK:
                end()
            continue
        taken = taken or id(part) in chosen
        block = part.tag in BLOCK or id(part) in chosen
        if part.tag == "br":
            words.append(" ")
            continue
        if block:
            end()
            stack.append((None, taken, True))
        stack += [(p, taken, False) for p in reversed(part.parts)]
    end()
    return "\n".join(blocks)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every page, from its whole html. Null html is empty and has empty text.

    Pages stay where they are read; memory holds the tree of one page. Repeated rows give equal results.
    """
    short = pages.select(pages[key].alias(key), pages[url].alias(url), F.coalesce(pages[html].cast("string"), F.lit("")).alias("html"))
    schema = short.select(key, url).schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            found = [main_text(page) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], schema.names)

    return short.mapInArrow(run, schema)
