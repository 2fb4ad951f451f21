"""Main text of web pages by composite text density over the page's tree."""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tempora.llm.common import slices

# fixed values of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes")
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are never main text, whatever their density.
ASIDE = frozenset(
    "script style noscript template head title nav header footer aside form button select option textarea input iframe object embed svg canvas math"
    " audio video menu dialog".split()
)
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr"
    " main menu nav ol p pre section table ul".split()
)
ENDS_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
#: Words in a class, id or role that mark notices, adverts, menus and comments of readers.
MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer"
    " cookie cookies consent notice gdpr popup modal newsletter subscribe share sharing social comment comments disqus respond related recommended widget masthead"
    " complementary contentinfo search login pagination pager toolbar skip".split()
)
_TAG = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|<([a-zA-Z][^\s/>]*)([^>]*)>?", re.S)
_MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*(?:display\s*:\s*none|visibility\s*:\s*hidden)""", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|$)[^>]*>?", re.I) for name in RAW}
_WORD = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("name", "children", "aside", "chars", "tags", "link_chars", "link_tags", "density", "total", "parent", "block")

    def __init__(self, name: str, parent: "Node | None", aside: bool):
        self.name, self.parent, self.aside = name, parent, aside
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.block = name in BLOCK


Unit = list[Node | str]


def parse(page: str) -> Node:
    """The tree of a page; unclosed and stray tags are mended as browsers do in the common cases."""
    root = Node("html", None, False)
    here, at = root, 0
    while True:
        found = _TAG.search(page, at)
        text = page[at : found.start()] if found else page[at:]
        if text:
            here.children.append(entities.unescape(text))
        if not found:
            return root
        at = found.end()
        close, name = found.group(1), found.group(2) or found.group(4)
        if close:
            close = close.lower()
            up = here
            while up is not None and up.name != close:
                up = up.parent
            if up is not None and up.parent is not None:
                here = up.parent
            elif close in ("p", "br"):
                here.children.append(Node("br", here, False))
        elif name:
            name, attributes = name.lower(), found.group(3) or found.group(5) or ""
            if name == "html":
                continue
            if name in ENDS_P or name == "li":
                up = here
                while up.parent is not None and up.name not in ENDS_P and up.name not in ("li", "td", "th", "body"):
                    up = up.parent
                if up.name == "p":
                    here = up.parent
            if name in HEADINGS and here.name in HEADINGS:
                here = here.parent
            if name in ENDS_BY:
                up, top = here, None
                while up.parent is not None and up.name not in SCOPE[name]:
                    top = up if up.name in ENDS_BY[name] else top
                    up = up.parent
                here = top.parent if top is not None else here
            if name == "body" and here.name == "head":
                here = here.parent
            aside = name in ASIDE or bool(attributes) and marked(name, attributes)
            node = Node(name, here, aside)
            here.children.append(node)
            if name in RAW:
                end = _RAW_END[name].search(page, at)
                if not aside:
                    node.children.append(entities.unescape(page[at : end.start() if end else len(page)]))
                at = end.end() if end else len(page)
            elif name not in VOID and not attributes.endswith("/"):
                here = node
            elif name not in VOID and name in ("svg", "math"):
                continue
            elif name not in VOID:
                here = node


def marked(name: str, attributes: str) -> bool:
    """Whether attributes hide an element or name it as something beside the article; the article and body themselves never are."""
    if name in ("article", "main", "body", "html"):
        return False
    if _HIDDEN.search(attributes):
        return True
    for groups in _MARKS.findall(attributes):
        for value in "".join(groups).lower().split():
            parts = _WORD.findall(value)
            if parts and (parts[0] in MARKED or parts[-1] in MARKED):
                return True
    return False


def measure(root: Node) -> list[Node]:
    """Fills characters, tags, link characters, link tags, density and density sum of every node; nodes in page order.

    A node's density is its characters without links per tag without links, at least one tag; its sum is that of
    its children's densities, and its own text counts as one more child. A node with a block in it is one itself.
    """
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.aside)
    for node in reversed(order):
        own = sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
        node.chars += own
        if node.name == "a":
            node.link_chars, node.link_tags = node.chars, node.tags + 1
        node.density = max(0, node.chars - node.link_chars) / max(1, node.tags - node.link_tags)
        node.total += own
        if node.parent is not None:
            up = node.parent
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
            up.total += node.density
            up.block = up.block or node.block
    return order


def units(node: Node) -> list[Unit]:
    """What hangs under a node in page order, without what is beside the article: block elements, and lines of all between them."""
    out: list[Unit] = []
    line = False
    for c in node.children:
        if isinstance(c, str) or not c.aside:
            block = isinstance(c, Node) and c.block
            if block or not line:
                out.append([])
            out[-1].append(c)
            line = not block
    return out


def weigh(unit: Unit) -> tuple[int, float]:
    """(characters without links, those per tag) of a unit."""
    if len(unit) == 1 and isinstance(unit[0], Node):
        return unit[0].chars - unit[0].link_chars, unit[0].density
    chars = tags = 0
    for c in unit:
        if isinstance(c, str):
            chars += len("".join(c.split()))
        else:
            chars += c.chars - c.link_chars
            tags += c.tags + 1 - c.link_tags
    return chars, chars / max(1, tags)


def dense_parts(unit: Unit, threshold: float) -> list[Unit]:
    """The parts of a unit that are as dense as the threshold, in page order: itself, or the topmost ones in it."""
    out, stack = [], [unit]
    while stack:
        part = stack.pop()
        chars, density = weigh(part)
        if chars and density >= threshold:
            out.append(part)
        elif chars and isinstance(part[0], Node) and part[0].block:
            stack.extend(reversed(units(part[0])))
    return out


def holds(part: Node, best: Node, threshold: float) -> bool:
    """Whether the densest node lies in `part`, or above it with nothing as dense as the threshold beside `part`."""
    up: Node | None = best
    while up is not None and up is not part:
        up = up.parent
    if up is part:
        return True
    up = part
    while up is not best:
        if up.parent is None or any(dense_parts(u, threshold) for u in units(up.parent) if up not in u):
            return False
        up = up.parent
    return True


def select(root: Node) -> list[Unit]:
    """The parts of the page that are the article, in page order.

    The node with the largest density sum is where the text hangs. The threshold is the least density on the path from
    there to the body. A sole article or main element is the article if it `holds` that node. Otherwise, at every level up to
    the body, what stands beside the path and is as dense as the threshold is part of the article. Below the body a node is taken
    whole if all on the path so far was and another child or a heading joins it; else headings before the last part
    and text between two parts join them.
    """
    order = measure(root)
    if not root.chars:
        return []
    best = max((n for n in order if n.chars), key=lambda n: n.total)
    path = [best]
    while path[-1].parent is not None and path[-1].name not in ("body", "html"):
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    for name in ("article", "main"):
        named = [n for n in order if n.name == name and n.chars - n.link_chars > 0]
        if len(named) == 1 and holds(named[0], best, threshold):
            return [[named[0]]]
    kept: list[Unit] = [[best]]
    for child, up in zip(path, path[1:]):
        beside = units(up)
        at = next(k for k, u in enumerate(beside) if child in u)
        headings = [k for k, u in enumerate(beside) if isinstance(u[0], Node) and u[0].name in HEADINGS and weigh(u)[0]]
        parts = [dense_parts(u, threshold) if k != at else kept if len(u) == 1 else [u] for k, u in enumerate(beside)]
        joins = any(k != at and parts[k] == [u] for k, u in enumerate(beside)) or any(k != at for k in headings)
        if joins and up is not path[-1] and kept == [[child]]:
            kept = [[up]]
            continue
        last = max(k for k, p in enumerate(parts) if p)
        for k in headings:
            if k < last and k != at:
                parts[k] = [beside[k]]
        first = min(k for k, p in enumerate(parts) if p)
        for k in range(first + 1, last):
            if k != at and weigh(beside[k])[0]:
                parts[k] = [beside[k]]
        kept = [u for p in parts for u in p]
    return kept


def blocks(parts: list[Unit]) -> list[str]:
    """Texts of the blocks in the parts in page order, white space as one space, without what is beside the article."""
    out, part = [], []

    def flush():
        text = " ".join("".join(part).split())
        part.clear()
        if text:
            out.append(text)

    stack: list[Node | str | None] = [c for u in reversed(parts) for c in (None, *reversed(u))]
    while stack:
        item = stack.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            part.append(item)
        elif not item.aside:
            if item.name in BLOCK:
                flush()
                stack.append(None)
            stack.extend(reversed(item.children))
    flush()
    return out


def main_text(page: str) -> str:
    return " ".join(blocks(select(parse(page))))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every page; a null or empty page, or one without text, has the empty text."""
    fields = f"`{key}` {pages.schema[key].dataType.simpleString()}, `{url}` {pages.schema[url].dataType.simpleString()}, text string, n_chars long"

    def run(batches):
        for batch in slices(batches, html):
            texts = [main_text(p) for p in pc.fill_null(batch.column(html), "").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), batch.column(url), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[key, url, "text", "n_chars"]
            )

    return pages.select(key, url, html).mapInArrow(run, fields)
