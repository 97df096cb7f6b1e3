"""Main text of web pages by composite text density.

Every element of the page's tree gets a density: characters per tag, adjusted by how many of its
characters and tags belong to links. An element's sum is that of its children's densities. The element
with the largest sum below the body is the article; the least density on its path up to the body is
the threshold at which other branches of the page are searched for further parts, whatever their tags;
a branch below it that only wraps one element is judged by that element. Only containers compete for the
sum: a paragraph or an inline element is text, not an article.

Menus, headers, footers, sidebars, code and other parts beside the article are left out of the tree by their tags. Names
(classes, ids, roles) are evidence only, weighed on the tree's own characters outside links: a whole name such as ``ad``
takes its element out, unless the element holds most of the page, with paragraphs, and little is left without it (then
it wraps the article). A part of a name, as in ``site-nav`` or ``has-sidebar``, takes out an element of less than ``PART_SHARE``
of the page, outside an article. Headings and sections in an article are never judged by their ids.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.llm import shared

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",  # quotes that do not match
    re.S,
)
RAW_END = {
    name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in ("script", "style", "textarea", "title", "xmp", "noembed", "noframes")
}
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")

# Elements of the HTML standard by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section select summary "
    "table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset(
    "applet aside audio button canvas datalist dialog embed footer frame frameset head iframe input "
    "label map math menu nav noembed noframes noscript object optgroup option script select style svg template "
    "textarea title video xmp".split()
)
CONTAINERS = frozenset("article body center div dl form main section td".split())
ENDS_P = BLOCK - {"br", "body", "html", "option", "select", "td", "th", "tr", "tbody", "thead", "tfoot"}
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}
# Words that name a part beside the article.
CHROME = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "breadcrumb breadcrumbs menu menubar nav navbar navigation sidebar sidebars aside footer masthead toolbar widget "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login "
    "comment comments commentlist respond replies reply disqus discussion share sharing social related "
    "recommended recommendations complementary contentinfo search skip hidden".split()
)
ANCHORED = frozenset("section h1 h2 h3 h4 h5 h6".split())
READERS = frozenset("comment comments commentlist respond replies reply disqus discussion".split())
HEADER_WORDS = frozenset(("header", "masthead", "site-header", "banner"))


#: What a name says of an element: nothing, perhaps beside the article, beside it, from readers.
NONE, PART, WHOLE, READER = range(4)
#: Shares of the page's characters outside links: a part of a name counts below the first; an element of a whole name that holds
#: more than the second is kept if less than the third is left without it.
PART_SHARE, MOST, LITTLE = 0.1, 0.5, 0.2


class Node:
    __slots__ = ("tag", "children", "chars", "tags", "link_chars", "link_tags", "density", "total", "mark")

    def __init__(self, tag: str, mark: int = NONE):
        self.tag, self.children, self.mark = tag, [], mark

    @property
    def plain(self) -> int:
        """Characters outside links."""
        return self.chars - self.link_chars

    @property
    def container(self) -> bool:
        """Whether it may be the article: also an element of the page's own making."""
        return self.tag in CONTAINERS or "-" in self.tag


def _evidence(tag: str, attributes: str, inside_article: bool) -> int:
    """What the element's class, id, role or hidden attribute says of it."""
    if tag in ("form", "fieldset"):
        return WHOLE
    if not attributes or tag in ("body", "html", "article", "main"):
        return NONE
    found = NONE
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            found = max(found, WHOLE)
        if name not in ("class", "id", "role") or inside_article and name == "id" and tag in ANCHORED:
            continue
        for word in value.split():
            if word in READERS:
                return READER
            if word in CHROME or word in HEADER_WORDS and not inside_article:
                found = max(found, WHOLE)
            elif not inside_article and not CHROME.isdisjoint(re.split(r"[-_]+", word)):
                found = max(found, PART)
    return found


def _wraps(node: Node) -> bool:
    """Whether an element holds an article of its own or two paragraphs."""
    paragraphs, stack = 0, [node]
    while stack:
        at = stack.pop()
        paragraphs += at.tag == "p" and at.plain > 0
        if paragraphs > 1 or at.tag in ("article", "main") and at.plain > 0:
            return True
        stack.extend(c for c in at.children if type(c) is Node and c.mark != READER)
    return False


def _outermost(root: Node) -> list[Node]:
    """Marked elements that are in no other marked one."""
    found, stack = [], [root]
    while stack:
        for child in stack.pop().children:
            if type(child) is Node:
                (found if child.mark else stack).append(child)
    return found


def pruned(root: Node) -> Node:
    """The tree without the elements that their names put beside the article."""
    count(root)
    page = root.plain
    marked = _outermost(root)
    while True:
        kept = [n for n in marked if n.mark == PART and n.plain >= PART_SHARE * page]
        if not kept and page - sum(n.plain for n in marked) < LITTLE * page:
            large = max((n for n in marked if n.mark != READER), key=lambda n: n.plain, default=None)
            kept = [large] if large is not None and large.plain > MOST * page and _wraps(large) else []
        if not kept:
            break
        for node in kept:
            node.mark = NONE
        marked = [n for n in marked if n.mark] + [n for node in kept for n in _outermost(node)]
    gone = {id(n) for n in marked}
    stack = [root]
    while stack:
        node = stack.pop()
        node.children = [c for c in node.children if type(c) is not Node or id(c) not in gone]
        stack.extend(c for c in node.children if type(c) is Node)
    return root


def tree(page: str) -> Node:
    """The page as elements and texts; dropped elements are left out with all they hold.

    Ends that the standard implies (a paragraph before a block, a list item before the next) are made;
    other unclosed elements end with their parent, and unmatched end tags are passed over.
    """
    root = Node("body")
    stack = [root]
    skipped: list[str] = []
    articles = at = 0
    size = len(page)
    while at < size:
        token = TOKEN.search(page, at)
        begin = token.start() if token else size
        if begin > at and not skipped:
            stack[-1].children.append(page[at:begin])
        if token is None:
            break
        at = token.end() if token.end() > begin else begin + 1
        closing, name, attributes = token.group(1, 2, 3) if token[2] else token.group(4, 5, 6)
        if name is None:
            if page.startswith("<![CDATA[", begin) and not skipped:
                stack[-1].children.append(page[begin + 9 : at].removesuffix("]]>"))
            continue
        tag = name.lower()
        if closing:
            if skipped:
                if tag in skipped:
                    del skipped[len(skipped) - 1 - skipped[::-1].index(tag) :]
                elif tag in ("body", "article", "main") and any(node.tag == tag for node in stack):
                    skipped.clear()
                else:
                    continue
                if skipped or tag not in ("body", "article", "main"):
                    continue
            if tag in ("body", "html"):
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    articles -= sum(node.tag in ("article", "main") for node in stack[depth:])
                    del stack[depth:]
                    break
            continue
        if tag in RAW_END:
            ended = RAW_END[tag].search(page, at)
            at = size if ended is None else page.find(">", ended.end() - 1) + 1 or size
            continue
        if tag == "body" and skipped == ["head"]:
            skipped.clear()
        if tag in ("html", "body"):
            continue
        if skipped:
            if tag not in VOID and not attributes.endswith("/"):
                skipped.append(tag)
            continue
        if tag in ENDS_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    del stack[depth:]
                    break
                if stack[depth].tag in BLOCK:
                    break
        if tag in CLOSES:
            ending, scope = CLOSES[tag]
            cut = 0
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in scope:
                    break
                if stack[depth].tag in ending:
                    cut = depth
            if cut:
                del stack[cut:]
        if tag in DROPPED or tag == "header" and not articles:
            if tag not in VOID:
                skipped.append(tag)
            continue
        node = Node(tag, _evidence(tag, attributes, articles > 0))
        stack[-1].children.append(node)
        if tag not in VOID:
            stack.append(node)
            articles += tag in ("article", "main")
    return pruned(root)


def _post_order(root: Node) -> list[Node]:
    """Elements below and with the root, children before parents."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in node.children if type(c) is Node)
    return order[::-1]


def count(root: Node) -> list[Node]:
    """Set characters and tags, those of links among them, of every element; returns them, parents last."""
    order = _post_order(root)
    for node in order:
        chars = tags = link_chars = link_tags = 0
        for child in node.children:
            if type(child) is Node:
                chars += child.chars
                tags += child.tags + 1
                link_chars += child.link_chars
                link_tags += child.link_tags
            else:
                chars += len(child) if not child.isspace() else 0
        if node.tag == "a":
            link_chars, link_tags = chars, tags + 1
        node.chars, node.tags, node.link_chars, node.link_tags = chars, tags, link_chars, link_tags
    return order


def measure(root: Node) -> list[Node]:
    """Set density and children's sum of every element too; returns them, parents last.

    A container's own text counts in its sum as a child of one tag. An element without text has density 0. Ratios take 1
    for a missing denominator.
    """
    order = count(root)
    share = root.link_chars / max(1, root.chars)
    for node in order:
        node.density = composite(node.chars, node.tags, node.link_chars, node.link_tags, share)
        node.total = 0.0 if not node.container else sum(
            child.density if type(child) is Node else 0 if child.isspace() else len(child) for child in node.children
        )
    return order


def composite(chars: int, tags: int, link_chars: int, link_tags: int, body_share: float) -> float:
    """Characters per tag times the log, to a base that grows with link text, of the two link ratios."""
    if not chars:
        return 0.0
    plain, links = max(1, chars - link_chars), max(1, link_chars)
    base = math.log(chars / plain * link_chars + body_share * chars + math.e)
    inner = chars / links * max(1, tags) / max(1, link_tags)
    return chars / max(1, tags) * max(0.0, math.log(inner)) / base


def _article(order: list[Node], root: Node) -> list[Node]:
    """Elements that hold the main text, outermost ones only."""
    parents = {id(c): node for node in order for c in node.children if type(c) is Node}
    holds = [n for n in order if n.total > 0]
    if not holds:
        return [root]
    best: dict[int, Node] = {}
    for node in order:  # the largest sum in each subtree; of equal ones the outermost
        top = node
        for child in node.children:
            if type(child) is Node and best[id(child)].total > top.total:
                top = best[id(child)]
        best[id(node)] = top
    top = best[id(root)]
    threshold, node = top.density, top
    while node is not root:
        node = parents[id(node)]
        threshold = min(threshold, node.density)
    marked: list[Node] = []
    queue = [root]
    while queue:
        node = queue.pop()
        while node is not None and node is not root and node.density < threshold:
            node = _wrapped(node)
        if node is None:
            continue
        found = best[id(node)]
        marked.append(found)
        on_path = {id(found)}
        while found is not node:
            found = parents[id(found)]
            on_path.add(id(found))
            queue.extend(c for c in found.children if type(c) is Node and id(c) not in on_path)
    return marked


def _wrapped(node: Node) -> Node | None:
    """The only element with text of a node without text of its own, if it is such a wrapper."""
    held = [c for c in node.children if (c.chars if type(c) is Node else not c.isspace())]
    return held[0] if len(held) == 1 and type(held[0]) is Node else None


def text_of(root: Node, chosen: list[Node]) -> str:
    """Texts of the chosen elements in page order: a line per block, white space turned into one space."""
    wanted = {id(node) for node in chosen}
    lines: list[str] = []
    run: list[str] = []

    def close() -> None:
        line = " ".join("".join(run).split())
        run.clear()
        if line:
            lines.append(line)

    stack: list[tuple[object, bool]] = [(root, False)]
    while stack:
        item, inside = stack.pop()
        if item is None:
            close()
        elif type(item) is Node:
            inside = inside or id(item) in wanted
            if item.tag in BLOCK:
                close()
                stack.append((None, False))
            stack.extend((child, inside) for child in reversed(item.children))
        elif inside:
            run.append(entities.unescape(item) if "&" in item else item)
    close()
    return "\n".join(lines)


def main_text(page: str | None) -> str:
    """The article of one page; empty for NULL, empty pages and pages without text."""
    if not page:
        return ""
    root = tree(page)
    order = measure(root)
    return text_of(root, _article(order, root))


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Add the main text of every page; ``html`` is replaced by ``out``, other columns stay."""
    kept = [c for c in pages.columns if c != html]
    if out in kept:
        raise ValueError(f"column {out} is there already")
    shared.prepare(pages.sparkSession)

    @shared.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(v) for v in shared.texts_of(batch, html)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), texts], names=[*kept, out])

    schema = T.StructType([*(pages.schema[c] for c in kept), T.StructField(out, T.StringType())])
    return pages.select(*kept, html).mapInArrow(run, schema)


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, main text and its code points, one row per row of ``pages`` (page_id, url, html).

    A NULL or empty page, and one without text, has an empty text of 0 characters. Rows may repeat, ids may be NULL or repeat.
    Pages are read whole, however long or deep. Other columns are passed over, whatever their names; no pages give no rows.
    """
    return extract(pages.select("page_id", "url", "html")).withColumn("n_chars", F.char_length("text").cast("bigint"))
