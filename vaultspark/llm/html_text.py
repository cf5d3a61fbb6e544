"""Main text of web pages by scoring the element tree.

Every block of text gives its ancestors points for its length and its commas, less the further up they are, each ancestor's total
discounted by the share of its text that lies in links. An article or main element, or a name that says so, weighs more, a name of
page furniture less. The best container is kept: with the article or main element around it if the container is a fair part of that,
else with the siblings that score well or read like text. Elements that are page furniture by their tag have no points and no text;
those that are so by a name only have none either unless they hold most of the page's text, or all that would be left.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

_TAG = re.compile(
    # A quoted value with '<' in it is one up to 4096 characters: else each open quote would be sought to the page's end.
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|</?([a-zA-Z][^\s/>]*+)((?:[^'\">]++|\"(?:[^\"<]*+\"|[^\"]{0,4096}+\")|'(?:[^'<]*+'|[^']{0,4096}+'))*+)>|</?([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_RAW = {x: re.compile(rf"</{x}\b", re.I) for x in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "template")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_CLOSES_P = _BLOCK - frozenset("body html caption option optgroup tbody td tfoot th thead tr".split())
#: An element that ends an open one of these, up to the given container.
_SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
_FURNITURE = frozenset("head nav footer aside fieldset button select option input label menu dialog iframe object embed svg canvas audio video map applet script style noscript template textarea title".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Parts of class names and ids that mark furniture, wherever they stand.
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adsby\w*|sponsor\w*|promos?|promoted|promotion\w*|banner|cookies?|consent|gdpr|notices?|notification\w*|disclaimer|copyright|legal|alert|popup|modal|overlay|newsletter|subscri\w*|signup|sidebar\w*|side|widget\w*|menus?|nav|navbar|navigation|breadcrumbs?|pagination|pager|share|sharing|social|related|recommend\w*|comments?|commentlist|remarks?|disqus|respond|responses?|discussion|feedback|repl(?:y|ies)|footer|topbar|masthead|toolbar|login|search\w*|skip|toc|hidden)(?:$|[\s_-])",
    re.I,
)
_HEADER = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])", re.I)
#: Names that say what a page has, lacks or is filed under, not what the element is.
_MODIFIED = re.compile(r"(?<!\S)(?:\S*?[_-])?(?:has|no|not|with|without|category|tag)[_-]\S*|(?<!\S)\S+?[_-](?:open|closed|enabled|disabled|on|off|to[_-]\S+)(?!\S)|(?<!\S)side-by-side(?!\S)", re.I)
#: Parts of names that mark main text; they only weigh.
_GOOD = re.compile(r"(?:^|[\s_-])(?:article\w*|content|main|body|text|story|post|entry|page|h-entry|blog)(?:$|[\s_-])", re.I)
#: What multiplies a container's points, by its tag and by its names.
_WEIGHTS = {"article": 1.5, "main": 1.25}
_GOOD_NAME, _FURNITURE_NAME = 1.25, 0.5
_COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|remarks?|disqus|respond|responses?|discussion|repl(?:y|ies))(?:$|[\s_-])", re.I)
#: What an element is: text, furniture whatever it holds, or furniture unless more than this share of the page's unlinked text is in it.
_TEXT, _ALWAYS, _MOST, _NEARLY_ALL = 0.0, 2.0, 0.5, 0.95
_LINKS_ONLY, _LEAST_LINKS, _SIBLING_SHARE, _FAIR_PART = 0.8, 3, 0.2, 0.2
#: Elements this deep are not opened: what follows them stands beside them. Every walk up the tree ends within as many steps.
_DEEPEST = 256


class Node:
    __slots__ = ("tag", "parent", "parts", "drop", "points", "size", "linked", "links", "depth", "within", "weight")

    def __init__(self, tag: str, parent: Node | None, drop: bool):
        self.tag, self.parent, self.drop = tag, parent, drop
        self.parts: list = []
        self.points, self.size, self.linked, self.links = 0.0, 0, 0, 0
        self.depth, self.within = (parent.depth + 1, parent.within) if parent else (0, frozenset())
        self.weight = _WEIGHTS.get(tag, 1.0)
        if tag in _WEIGHTS:
            self.within |= {tag}


def _names(found: dict[str, str]) -> str:
    return _MODIFIED.sub(" ", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", html.unescape(f"{found.get('class', '')} {found.get('id', '')}")))


def _furniture(tag: str, attributes: str, node: Node) -> float:
    """What the element is, by its tag and attributes; sets the node's weight by its names."""
    if tag in _FURNITURE:
        return _ALWAYS
    if tag == "header":
        return _TEXT if "article" in node.within else _ALWAYS
    least = _MOST if tag == "form" else _TEXT
    if not attributes.strip():
        return least
    found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
    if found.get("role", "").lower() in _ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return _ALWAYS
    if re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
        return _ALWAYS
    if "class" not in found and "id" not in found:
        return least
    names = _names(found)
    header = _HEADER.search(names) and not node.within
    furniture = header or _NAMES.search(names)
    if _GOOD.search(names):
        node.weight *= _GOOD_NAME
    if tag in ("html", "body", "main", "article"):
        return _TEXT
    if not furniture:
        return least
    node.weight *= _FURNITURE_NAME
    # A name that is the word itself, and any name for comments, which may be longer than the article, says more than a part of a name.
    whole = any(not re.search("[_-]", x) and (_NAMES.search(x) or header and _HEADER.search(x)) for x in names.split())
    return _NEARLY_ALL if whole or _COMMENTS.search(names) else _MOST


def _mark(nodes: list[Node], kinds: list[float]) -> None:
    """Sets drop: furniture that does not hold the main text, and what is below it. Names don't count if nothing were left."""
    if any(_TEXT < k < _ALWAYS for k in kinds):
        held: dict[int, int] = {}
        for x, kind in zip(reversed(nodes), reversed(kinds), strict=True):  # children before parents
            if kind < _ALWAYS and x.tag != "a":
                held[id(x)] = sum(len(p.strip()) if isinstance(p, str) else held.get(id(p), 0) for p in x.parts if p is not None)
        total = held[id(nodes[0])]
        kinds = [_TEXT if k < _ALWAYS and held.get(id(x), 0) > k * total else k for x, k in zip(nodes, kinds, strict=True)]
    for only in (_TEXT, _MOST + _NEARLY_ALL):
        left = False
        for x, kind in zip(nodes, kinds, strict=True):
            x.drop = kind > only or x.parent is not None and x.parent.drop
            left = left or not x.drop and any(isinstance(p, str) and p.strip() for p in x.parts)
        if left:
            break


def parse(page: str) -> list[Node]:
    """All elements in page order; the first is the root. Text parts are decoded strings; None marks a line break."""
    root = Node("", None, False)
    nodes, kinds, open_ = [root], [_TEXT], root
    opened: Counter[str] = Counter()  # how many elements of a tag are open
    at, n = 0, len(page)
    find = _TAG.search

    def back(to: Node) -> Node:
        x = open_
        while x is not to:
            opened[x.tag] -= 1
            x = x.parent
        return to

    while at < n:
        m = find(page, at)
        lo = m.start() if m else n
        if lo > at:
            open_.parts.append(html.unescape(page[at:lo]) if "&" in page[at:lo] else page[at:lo])
        if not m:
            break
        at = m.end()
        tag = m[1] or m[3]
        if not tag:
            continue
        tag, attributes = tag.lower(), m[2] or m[4] or ""
        if page[lo + 1] == "/":
            if opened[tag]:
                open_ = back(_end(open_, tag))
            continue
        if tag == "br":
            open_.parts.append(None)
            continue
        if opened["p"] and tag in _CLOSES_P:
            open_ = back(_shut(open_, {"p"}, {"table", "td", "th", "button", "caption"}))
        if tag in _SIBLINGS and any(opened[x] for x in _SIBLINGS[tag][0]):
            open_ = back(_shut(open_, *_SIBLINGS[tag]))
        node = Node(tag, open_, False)
        open_.parts.append(node)
        nodes.append(node)
        kinds.append(_furniture(tag, attributes, node))
        if tag in _RAW:
            end = _RAW[tag].search(page, at)
            at = end.start() if end else n
        if tag not in _VOID and node.depth < _DEEPEST:
            open_ = node
            opened[tag] += 1
    _mark(nodes, kinds)
    return nodes


def _shut(node: Node, tags: set[str], stop: set[str]) -> Node:
    """The parent of the nearest open element of these tags, if no element of stop is nearer; else node."""
    x = node
    while x.parent is not None and x.tag not in stop:
        if x.tag in tags:
            return x.parent
        x = x.parent
    return node


def _end(node: Node, tag: str) -> Node:
    x, block = node, tag in _BLOCK
    while x.parent is not None:
        if x.tag == tag:
            return x.parent
        if not block and x.tag in _BLOCK:
            return node  # a stray end tag of an inline element
        x = x.parent
    return node


def _blocks(node: Node, keep) -> Iterator[tuple[str, Node, int]]:
    """Text of each block below node in page order, the element it stands in, and how much of it is in links."""
    held: list[str] = []
    linked = 0
    stack: list = [(node, 0, False)]
    while stack:
        x, k, link = stack.pop()
        while k < len(x.parts):
            part = x.parts[k]
            k += 1
            if part is None:
                held.append("\x00")
            elif isinstance(part, str):
                held.append(part)
                linked += len(part.strip()) if link else 0
            elif keep(part):
                if part.tag in _BLOCK and (held or linked):
                    yield from _pieces(held, _block_of(x), linked)
                    held, linked = [], 0
                stack.append((x, k, link))
                x, k, link = part, 0, link or part.tag == "a"
        if x.tag in _BLOCK and held:
            yield from _pieces(held, x, linked)
            held, linked = [], 0
    if held:
        yield from _pieces(held, _block_of(node), linked)


def _pieces(held: list[str], at: Node, linked: int) -> Iterator[tuple[str, Node, int]]:
    for part in "".join(held).split("\x00") if any("\x00" in h for h in held) else ["".join(held)]:
        if text := " ".join(part.split()):
            yield text, at, min(linked, len(text))
            linked = max(0, linked - len(text))


def _block_of(node: Node) -> Node:
    while node.parent is not None and node.tag not in _BLOCK:
        node = node.parent
    return node


#: Blocks that are not containers themselves: their points begin with the parent.
_PARAGRAPHS = frozenset("p pre blockquote li td h1 h2 h3 h4 h5 h6 dd dt".split())
_LEVELS = 5


def _score(nodes: list[Node]) -> None:
    for text, at, linked in _blocks(nodes[0], lambda x: not x.drop):
        points = (min(len(text) / 100, 3) + text.count(",") + (1 if len(text) >= 25 else 0.1)) * (1 - linked / len(text))
        container = at.parent if at.tag in _PARAGRAPHS and at.parent else at
        for level in range(1, _LEVELS + 1):
            if container is None:
                break
            container.points += points / level
            container = container.parent
        at.size += len(text)
        at.linked += linked
    for x in reversed(nodes):  # children before parents
        if x.tag == "a":
            x.links += 1
        if x.parent is not None and not x.drop:
            x.parent.size += x.size
            x.parent.linked += x.linked
            x.parent.links += x.links


def _density(x: Node) -> float:
    return x.linked / x.size if x.size else 0.0


def _value(x: Node) -> float:
    return x.points * x.weight * (1 - _density(x))


def _around(best: Node) -> Node | None:
    """The nearest article, else main element, that best is or is a fair part of."""
    for tag in ("article", "main"):
        x: Node | None = best
        while x is not None and x.tag != tag:
            x = x.parent
        if x is not None and best.size - best.linked >= _FAIR_PART * (x.size - x.linked):
            return x
    return None


def main_text(page: str | None) -> str:
    """The main text of a page: blocks in page order, joined by a space; empty if there is none. Markup may be broken; NUL is dropped."""
    if not page:
        return ""
    nodes = parse(page.replace("\x00", ""))
    _score(nodes)
    best = max((x for x in nodes if not x.drop), key=_value, default=nodes[0])
    if best.points <= 0:
        return ""
    around = _around(best)
    top = around or best
    chosen = [top]
    if top.parent is not None and (top.tag == "article" or around is None and top.tag not in ("body", "html")):
        limit = _SIBLING_SHARE * _value(best)
        for s in top.parent.parts:
            if isinstance(s, Node) and s is not top and not s.drop and s.size:
                # Beside the main container of a body stands anything; inside a closer parent, more of the same text.
                like = s.tag in ("p", "h1", "h2", "h3", "blockquote", "pre") or top.parent.tag not in ("body", "html", "")
                reads = like and top.tag != "article" and _density(s) < 0.25
                if reads or _value(s) >= limit and (top.tag != "article" or s.tag == "article"):
                    chosen.append(s)
    wanted = {id(c) for c in chosen}
    links = lambda x: x.tag in ("ul", "ol", "div", "section", "table", "p") and x.links >= _LEAST_LINKS and _density(x) >= _LINKS_ONLY
    out = []
    # An article's lists of links are its own.
    keep = lambda x: not x.drop and (top.tag == "article" or not links(x))
    for c in [top] if len(chosen) == 1 else [s for s in top.parent.parts if id(s) in wanted]:
        out += [text for text, _, _ in _blocks(c, keep)]
    return " ".join(out)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages, a page at a time.

    A null or empty html has an empty text. Null ids and urls stay null; repeated rows come back as often as they occur; of
    containers that tie the first on the page is taken. Other columns are not read. An empty table gives an empty result.
    """
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    cols = [F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html")]
    return pages.select(*cols).mapInArrow(run, "page_id long, url string, text string, n_chars long")
