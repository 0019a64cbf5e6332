"""Main text of web pages by tag-path ratios.

A page becomes its text nodes, each with its root-to-leaf tag path (tag names; tags that style running text don't
count). Per path the characters of text, the text nodes, the punctuation and the text inside links are added up. Two
ratios follow, text per node and punctuation per node, both lowered by the share of link text; each is smoothed over
neighbouring nodes in page order, they are fused by their product, and paths whose fused value reaches a part of the
page's deviation are content, as are short blocks (headings, short paragraphs) inside the container: the smallest
element that holds all content and the headline, and no smaller than the article, the main element or the text that
stands in paragraphs beside it. There headings, list items and paragraphs stay even if they are all link; if nothing
smaller than the body is the container, from the first content block to the last. Page furniture that names itself (nav, footer, forms, or a class or id such as "sidebar" or "comments") is
left out before; the elements scripts, styles and the like never hold text. A form or an element named by class, id or
role stays if it holds most of the page's text outside links or its only main, article or h1 (comments only stay where
no article is beside them), and if nothing else has text; inline elements only go if they are hidden.

Blocks are joined by two line feeds; white space inside a block becomes one space; character references are decoded.
Null, empty and broken HTML: what text it has, else "". Each row is extracted by itself, also if it repeats; all
columns are kept (an input column named text is replaced). No rows give no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from stratalake.llm.words import slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas audio video select option datalist".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
FURNITURE = frozenset("nav footer aside button menu dialog head".split())
#: What may stand in a head; any other element, or text, ends it.
HEAD = frozenset("html head title base link meta style script noscript template".split())
#: Elements that an opening tag of the same kind of place closes.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"),
}
BREAKS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main "
    "menu nav ol p pre section table ul".split()
)
#: Elements that are parts of a text rather than hold one.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that belong to an article even if all their text is link.
PARTS = HEADINGS | frozenset("p li dt dd".split())
#: Elements that are a part of an article and never hold the whole of it, and those that do by their name.
PARTIAL = (LEAVES - {"td", "th"}) | frozenset("ul ol dl table thead tbody tfoot tr section".split())
WHOLE = frozenset(("article", "main"))
_NAMES = (
    r"(?:ads?|advert\w*|adsense|alerts?|(?:about-)?author(?:-(?:bio|box|card|info))|banner|breadcrumbs?|byline-share|comments?|commentlist|consent|cookies?|copyright|disqus"
    r"|footer|gdpr|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|pager|pagination|popup|promo\w*|recommend\w*"
    r"|related|replies|reply|respond|share|sharing|side-?bar|signup|site-header|page-header|skip|social|sponsor\w*|subscribe|tags?"
    r"|toc|toolbar|widget)"
)
#: Words that a name may be joined with and still name the same thing.
_JOINED = r"(?:area|articles|bar|block|bottom|box|buttons?|container|left|links?|list|main|posts?|primary|reader|right|secondary|section|site|slot|stories|thread|top|user|wrap|wrapper)"
#: A class or id that is such a name as a whole, or made of nothing else; "tag-x" and "has-sidebar" say something of an article.
NAMED = re.compile(rf"(?!tag[_-](?!list$|links?$))(?:{_JOINED}[_-])*{_NAMES}(?:[_-](?:{_NAMES}|{_JOINED}))*", re.IGNORECASE)
COMMENTS = re.compile(r"(?:.*[_-])?(?:comments?|commentlist|disqus|replies|reply|respond)(?:[_-].*)?", re.IGNORECASE)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: A name, then perhaps a value: a quote opens one only directly after "=" and white space.
_VALUE = r"(?>\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>\"'][^\s>]*)"
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|</?([a-zA-Z][^\s/>]*)((?>[\s/=]|[^\s/>=]+(?>\s*=\s*{_VALUE}?)?)*+)(?:>|\Z)", re.DOTALL,
)
_ATTRIBUTE = re.compile(rf"([^\s/>=]+)(?:\s*=\s*({_VALUE}))?", re.DOTALL)
_TELLING = re.compile(r"class|id|role|hidden|style", re.IGNORECASE)
#: Elements nested deeper count as standing side by side, as browsers have it.
MOST_DEEP = 256
#: So many forms, headers and named elements around a block are judged one by one; those inside go with the last of them.
MOST_DOUBTED = 16
_PUNCTUATION = re.compile(r"[.,;:!?、。，！？…]")


@dataclass
class Node:
    """An open element: its tag, its path, whether it is furniture or in what may be, and the block that its text belongs to."""

    tag: str
    path: tuple[str, ...]
    skip: bool
    link: bool
    inside: tuple[int, ...]
    doubted: tuple[tuple[int, str], ...] = ()


@dataclass
class Block:
    """Text between two block boundaries."""

    path: tuple[str, ...]
    inside: tuple[int, ...]
    #: The open forms, headers and named elements, by number and kind: "named", "comments" or "header".
    doubted: tuple[tuple[int, str], ...] = ()
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def _attributes(text: str) -> list[tuple[str, str]]:
    """Names in lower case with their values, in order; only of tags that may tell what an element is."""
    if not _TELLING.search(text):
        return []
    return [(name.lower(), value[1:].removesuffix(value[0]) if value[:1] in ("'", '"') else value) for name, value in _ATTRIBUTE.findall(text)]


def _furniture(tag: str, attributes: list[tuple[str, str]]) -> bool:
    """Whether an element is furniture or hidden, whatever it holds."""
    if tag in FURNITURE:
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    for name, value in attributes:
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            return True
    return False


def _doubted(tag: str, attributes: list[tuple[str, str]], path: tuple[str, ...]) -> str:
    """What an element may be by its tag or names: "header", "comments", other "named" furniture, or ""."""
    if tag in ("html", "body", "article", "main"):
        return ""
    kind = "named" if tag == "form" else ""
    for name, value in attributes:
        if name in ("class", "id"):
            for token in value.split():
                if NAMED.fullmatch(token):
                    kind = "comments" if kind == "comments" or COMMENTS.fullmatch(token) else "named"
        elif name == "role" and value.lower() in ROLES:
            kind = kind or "named"
    # An article's own header holds its headline.
    return kind or ("header" if tag == "header" and "article" not in path and "main" not in path else "")


def _spared(found: list[tuple[Block, str]]) -> list[tuple[Block, str]]:
    """The blocks outside forms and named elements, and those in such as hold the page's text."""
    if not any(b.doubted for b, _ in found):
        return found
    kind = {"article": "article", "main": "article", "h1": "h1"}
    total, spared = 0, set()
    plain: dict[tuple[int, str], int] = {}
    holds: dict[tuple[int, str], set[str]] = {}
    for b, t in found:
        n = max(0, len(t) - b.linked)
        total += n
        for element in b.doubted:
            plain[element] = plain.get(element, 0) + n
            below = b.path[b.inside.index(element[0]) + 1 :] if element[0] in b.inside else ()
            holds.setdefault(element, set()).update(kind[x] for x in below if x in kind)
    left = lambda: [(b, t) for b, t in found if spared.issuperset(b.doubted)]
    shown = lambda: {kind[x] for b, _ in left() for x in b.path if x in kind}
    most = [e for e in sorted(plain) if 2 * plain[e] > total]
    spared.update(e for e in most if e[1] != "comments")
    there = shown()
    for element in sorted(plain):
        if element[1] == "header":
            # The page's only headline, unless the article stands elsewhere.
            wanted = "h1" in holds[element] - there and "article" not in there
        else:
            wanted = holds[element] - there or element in most and not there
        if element not in spared and wanted:
            spared.add(element)
            there = shown()
    return left() or found


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, without furniture; what only may be furniture is marked."""
    found: list[Block] = []
    stack = [Node("", (), False, False, ())]
    opened: dict[str, int] = {}
    number, at, block = 0, 0, None

    def push(node: Node) -> None:
        stack.append(node)
        opened[node.tag] = opened.get(node.tag, 0) + 1

    def pop(start: int) -> None:
        for node in stack[start:]:
            opened[node.tag] -= 1
        del stack[start:]

    def close(tags: tuple[str, ...], within: frozenset[str]) -> None:
        """Close the innermost open element among `tags`, unless one of `within` stands before it."""
        if not any(opened.get(t) for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                pop(i)
                return
            if stack[i].tag in within:
                return

    def add(raw: str, decode: bool = True) -> None:
        nonlocal block
        if not raw:
            return
        if stack[-1].tag == "head" and raw.strip():
            pop(len(stack) - 1)
        top = stack[-1]
        if top.skip:
            return
        text = entities.unescape(raw) if decode and "&" in raw else raw
        if block is None:
            if not text.strip():
                return
            block = Block(top.path, top.inside, top.doubted)
            found.append(block)
        block.parts.append(text)
        if top.link:
            block.linked += len(text.strip())

    scopes = frozenset("table td th div article section main body li blockquote".split())
    while True:
        match = _TAG.search(page, at)
        add(page[at : match.start()] if match else page[at:])
        if not match:
            return found
        at = match.end()
        whole, tag = match[0], (match[1] or "").lower()
        if not tag:
            if whole.startswith("<![CDATA["):
                add(whole[9:].removesuffix("]]>"), decode=False)
            continue
        if whole.startswith("</"):
            if tag not in INLINE:
                block = None
            if tag in INLINE:
                close((tag,), BREAKS_P)
            else:
                close((tag,), frozenset())
            continue
        if tag in RAW and not whole.endswith("/>"):
            end = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.IGNORECASE).search(page, at)
            if tag not in ("select", "option", "object", "svg", "math") or end:
                at = end.end() if end else len(page)
            continue
        if tag == "br":
            add(" ")
            continue
        if tag not in INLINE:
            block = None
        if stack[-1].tag == "head" and tag not in HEAD:
            pop(len(stack) - 1)
        if tag in VOID:
            continue
        if tag in BREAKS_P:
            close(("p",), scopes)
        if tag in CLOSES:
            for _ in CLOSES[tag]:
                close(CLOSES[tag], frozenset(("ul", "ol", "dl", "table")) - {tag})
        if whole.endswith("/>") and tag not in INLINE:
            continue
        top = stack[-1]
        attributes = [] if top.skip else _attributes(match[2] or "")
        if tag in INLINE:
            if not whole.endswith("/>"):
                push(Node(tag, top.path, top.skip or _furniture(tag, attributes), top.link or tag == "a", top.inside, top.doubted))
            continue
        number += 1
        skip = top.skip or _furniture(tag, attributes)
        kind = "" if skip else _doubted(tag, attributes, top.path)
        doubted = (*top.doubted, (number, kind)) if kind and len(top.doubted) < MOST_DOUBTED else top.doubted
        deep = len(top.path) >= MOST_DEEP
        push(Node(tag, top.path if deep else (*top.path, tag), skip, top.link, top.inside if deep else (*top.inside, number), doubted))


def _smooth(values: np.ndarray, width: int = 1) -> np.ndarray:
    """Mean of each value and its neighbours."""
    total = np.concatenate(([0.0], np.cumsum(values)))
    at = np.arange(len(values))
    low, high = np.maximum(at - width, 0), np.minimum(at + width + 1, len(values))
    return (total[high] - total[low]) / (high - low)


def _heading(block: Block) -> bool:
    return any(t in HEADINGS for t in block.path[-1:])


def _container(found: list[Block], content: np.ndarray, plain: np.ndarray) -> tuple[int, ...]:
    """The smallest element that holds the whole article, as the numbers of the elements down to it."""

    def common(blocks: list[Block]) -> int:
        a, b = min(x.inside for x in blocks), max(x.inside for x in blocks)
        return next((i for i, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))

    def fitting(depth: int) -> int:
        """Not a paragraph, a list, a table or a section, which are parts of an article."""
        while depth and (path[depth - 1] in PARTIAL or any(len(x.inside) == depth and path[depth - 1] not in WHOLE for x in held)):
            depth -= 1
        return depth

    held = [b for b, yes in zip(found, content, strict=True) if yes]
    start, path = found.index(held[0]), held[0].path
    depth = fitting(common(held))
    within = lambda depth: [b for b in found if b.inside[:depth] == held[0].inside[:depth]]
    # The headline: the last h1 before the content, or h2 on a page without h1, unless one is inside.
    level = "h1" if any("h1" in b.path for b in found) else "h2"
    if not any(level in b.path for b in within(depth)):
        above = [b for b in found[:start] if level in b.path]
        if above:
            depth = fitting(common([above[-1], *held]))
    for i in range(depth, 0, -1):
        if path[i - 1] in WHOLE:
            return held[0].inside[:i]
    # Paragraphs directly beside the container are parts of the same text.
    beside = {b.inside[:-1] for b, yes in zip(found, plain, strict=True) if yes and b.path and b.path[-1] in ("p", *HEADINGS)}
    for i in range(depth - 1, 0, -1):
        if path[i - 1] not in ("html", "body") and path[i - 1] not in PARTIAL and held[0].inside[:i] in beside:
            depth = i
    return held[0].inside[:depth]


def extract(page: str | None, part: float = 0.5) -> str:
    """The main text of one page; `part` of the deviation of the fused ratio is the threshold."""
    found = _spared([(b, t) for b in blocks(page or "") if (t := b.text())])
    if not found:
        return ""
    paths = {p: i for i, p in enumerate(dict.fromkeys(b.path for b, _ in found))}
    of = np.array([paths[b.path] for b, _ in found])
    length = np.array([len(t) for _, t in found], float)
    marks = np.array([len(_PUNCTUATION.findall(t)) for _, t in found], float)
    linked = np.array([min(b.linked, len(t)) for b, t in found], float)
    add = lambda x: np.bincount(of, x, len(paths))
    nodes, plain = add(np.ones(len(found))), 1 - add(linked) / add(length)
    text_ratio, mark_ratio = add(length) / nodes * plain, (1 + add(marks)) / nodes * plain
    fused = _smooth(text_ratio[of]) * _smooth(mark_ratio[of])
    own = text_ratio[of] * mark_ratio[of]
    level = part * min(np.std(own), np.mean(own))
    content = (np.sqrt(fused * own) >= level) & (linked < 0.5 * length)
    if not content.any():
        content = own >= own.max()
    parts = [b for b, _ in found]
    inside = _container(parts, content, linked < 0.5 * length)
    holder = next(b.path for b in parts if b.inside[: len(inside)] == inside)[: len(inside)]
    narrow = bool(holder) and holder[-1] not in ("html", "body")
    # Where link-heavy list items and paragraphs belong to the article: after its headline or first text.
    shown = [i for i, b in enumerate(parts) if b.inside[: len(inside)] == inside and (content[i] or narrow and _heading(b))]
    first, last = (shown[0], shown[-1]) if shown else (0, -1)
    kept = []
    for i, (b, t) in enumerate(found):
        if b.inside[: len(inside)] != inside:
            continue
        own_link = _heading(b) or any(x in PARTS for x in b.path[-1:])
        within = "article" in b.path or "main" in b.path or first <= i and (narrow or i <= last)
        if content[i] or linked[i] < 0.5 * length[i] or own_link and within:
            kept.append(t)
    return "\n\n".join(kept)


def main_text(pages: DataFrame) -> DataFrame:
    """Add the column text to rows with a column html."""
    pages = pages.drop("text")
    names = [*pages.columns, "text"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in slices(batch, "html"):
                texts = [extract(page.as_py()) for page in run.column("html")]
                yield pa.RecordBatch.from_arrays([*run.columns, pa.array(texts, pa.string())], names)

    return pages.mapInArrow(rows, StructType([*pages.schema.fields, StructField("text", StringType())]))
