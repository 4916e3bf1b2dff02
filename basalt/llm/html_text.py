"""Main text of web pages by tree scoring.

The page becomes a tree. Subtrees that are boilerplate by tag, role or name go. A name counts only as a
whole class or id, or with the usual words around it ("site-footer", not "tag-privacy"), and never against
an article, what holds most of the page's text, or all that is left of a page. Each paragraph left
passes points, for its length and its commas, to its parent in full, to its grandparent in half, and half
again at each step up; a container's points are discounted by its link density. The article or main
part that holds the best container is kept whole, or the least container of nearly all the text if it adds
few links; else the best container. Siblings come along that score near it, that hold
sentences, lists or tables and few links, are its title, or are articles or sections as it is; a line that only
says who owns the page is none of these.

Lengths, links and points are added up once, from the last element to the first, so time grows with the page
however deep it is. A quoted attribute that doesn't end where an attribute may end is taken as unclosed.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML by how they are treated, and names that mark boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("head script style noscript template nav footer aside button select option input textarea iframe object svg canvas dialog menu title audio video map".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
CLOSED_BY = {
    "p": BLOCK - {"body", "html", "caption", "tbody", "tfoot", "thead", "tr"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option"},
}
NAMES = frozenset(
    "ad ads advert advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb"
    " breadcrumbs sidebar aside rail widget footer foot cookie cookies consent notice gdpr privacy popup modal overlay newsletter subscribe"
    " subscription signup share sharing social comment comments discussion disqus respond reply replies related recommended recommendations"
    " pagination pager toolbar skip login search alert".split()
)
#: Words that may stand before and behind a name of boilerplate, and further compounds.
BEFORE = frozenset("site page main primary secondary top bottom left right global mobile post article entry header google sticky".split())
BEHIND = frozenset(
    "area bar block bottom box btn button buttons column container count form group holder icon icons inner left link links list media module"
    " outer panel post posts article articles primary right row secondary section slot stories text copy thread title top unit wrap wrapper zone".split()
)
COMPOUNDS = frozenset("related-content recommended-content sponsored-content promoted-content".split())
#: Names that are never the main text, however much of the page they hold.
BESIDE = frozenset("comment comments discussion disqus respond reply replies cookie cookies consent gdpr ad ads advert advertisement advertising adsense sponsor sponsored".split())
#: Names that ids made from headings bear too, and elements whose ids say nothing.
TOPICS = frozenset("discussion privacy notice search alert social menu banner navigation advertising advertisement consent comment reply recommended recommendations cookie cookies gdpr sponsored subscription login promotion share sharing".split())
SLUGS = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd blockquote pre table figure a span b i em strong".split())
#: Names that paragraphs of an article bear too, if they read like prose and link to nothing.
TOLD = frozenset("social search menu banner navigation related".split())
#: Names that boxes of an article's own bear.
BOXES = frozenset("alert privacy".split())
#: Names of boilerplate that wrappers of an article bear too.
LAYOUT = frozenset("sidebar rail aside nav navbar menu toolbar overlay modal widget search share social".split())
HEADS = frozenset("header masthead topbar".split())
#: Before "header", these make it the head of the text.
TITLED = frozenset("page post article entry".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
GOOD = frozenset("article main content body entry post story text hentry".split())

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|"
    r"<(/?)([a-zA-Z][^\s/<>]*+)((?:=\s*+\"[^\"]*+\"(?=[\s/>])|=\s*+'[^']*+'(?=[\s/>])|[^<>])*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: A value that ends in the slash before the tag's end, which closes nothing then.
UNQUOTED = re.compile(r"=\s*[^\s\"'>]*/\Z")
PARTS = re.compile(r"[^a-z0-9]+")
SIZE = re.compile(r"\d+(x\d+)?")
#: The share of a page's text that is nearly all, the share of links among text that is few, and the length of a title.
NEARLY_ALL, FEW_LINKS, TITLE = 0.9, 0.25, 300
#: What ends a sentence, and lines that begin so are no text but who owns it.
SENTENCE, OWNED = re.compile(r"[.!?…。！？][\"'”’»)\]]*(\s|$)"), re.compile(r"\s*(©|\(c\)|copyright\b)", re.I)
#: Elements of text that need no sentence.
LISTED = frozenset("ul ol dl table blockquote pre figure".split())


#: Elements that an open tag's implied end doesn't go beyond.
WALLS = frozenset("html article div section main table ul ol dl body".split())


class Node:
    """An element. block: the nearest block element, itself included; near: likewise of those with implied ends or walls."""

    __slots__ = ("tag", "names", "bad", "drop", "named", "told", "parent", "inside", "score", "size", "linked", "depth", "block", "near", "holds", "length", "links")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.inside = tag, parent, []
        self.names, self.bad, self.drop, self.named, self.told, self.score = frozenset(), frozenset(), False, False, False, 0.0
        self.size = self.linked = self.length = self.links = 0
        self.depth, self.holds = parent.depth + 1 if parent else 0, False
        self.block = self if tag in BLOCK or not parent else parent.block
        self.near = self if tag in CLOSED_BY or tag in WALLS or not parent else parent.near


@functools.lru_cache(1 << 14)
def boilerplate(token: str) -> tuple[frozenset, bool]:
    """The names of boilerplate that a class or id consists of, and whether it is one of them alone."""
    parts = [x for x in PARTS.split(token) if x]
    if "-".join(parts) in COMPOUNDS:
        return frozenset(parts[:1]), False
    a, b = 0, len(parts)
    while b > 1 and (parts[b - 1] in BEHIND or SIZE.fullmatch(parts[b - 1])):
        b -= 1
    while a < b - 1 and parts[a] in BEFORE:
        a += 1
    found = frozenset(parts[a:b])
    title = found <= HEADS and not TITLED.isdisjoint(parts[:a])
    return (found, len(parts) == 1) if found and found <= NAMES | HEADS and not title else (frozenset(), False)


def mark(node: Node, attributes: str, in_article: bool) -> None:
    """Set names, drop (by tag, role or style), named (by class or id) and told (may be prose for all its name) from tag and attributes."""
    found = {}
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), unescape(a or b or c))
    classes, ids = found.get("class", "").lower().split(), found.get("id", "").lower().split()
    node.names = frozenset(PARTS.split(" ".join(classes + ids))) - {""}
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    bad = {name for x in classes for name in boilerplate(x)[0]}
    if node.tag not in SLUGS:
        topical = node.tag == "section" or node.tag == "div" and (in_article or "section" in classes)
        bad |= {name for x in ids for names, alone in (boilerplate(x),) if not (topical and alone and names <= TOPICS) for name in names}
    if in_article or node.tag in SLUGS:
        bad -= HEADS
    if in_article:
        bad -= BOXES
    role = found.get("role", "").lower()
    node.drop = node.tag in DROPPED and node.tag != "button" or hidden or role in ROLES and (role, node.tag) != ("form", "form") or node.tag == "header" and not in_article
    node.bad = frozenset(bad)
    node.told = in_article and node.tag == "p" and node.bad <= TOLD
    node.named = bool(bad) and not node.drop and node.tag not in ("html", "body", "main", "form") and (node.tag != "article" or in_article and bool(bad & BESIDE))


def settle(nodes: list[Node]) -> None:
    """Drop what is boilerplate by name, and forms; what holds most of the page's text stays.

    `nodes` are in page order. What is mostly links or bears a name of things beside the text always goes.
    A button goes unless it stands amid the text of a paragraph.
    """
    for x in nodes:
        if x.tag in SLUGS:
            for before, y, after in zip(x.inside, x.inside[1:], x.inside[2:]):
                if isinstance(y, Node) and y.tag == "button" and all(isinstance(t, str) and t.strip() for t in (before, after)):
                    y.told = True
    for x in nodes:
        x.drop = x.drop or x.tag == "button" and not x.told
    for x in reversed(nodes):
        if x.parent and not (x.drop or x.named and x.bad & BESIDE):
            x.parent.size += x.size
            x.parent.linked += x.size if x.tag == "a" else x.linked
    for x in nodes:
        if (x.named or x.tag == "form") and not x.drop:
            prose = x.told and not x.linked and SENTENCE.search("".join(t for t in x.inside if isinstance(t, str)))
            most = prose or 2 * x.size > nodes[0].size and 2 * x.linked < x.size and not x.bad & BESIDE
            x.drop, x.named = not most, x.named and not most


def parse(html: str) -> list[Node]:
    """The tree of a page, as its elements in page order. Unclosed, stray and misnested tags are taken as browsers roughly do."""
    root = node = Node("html", None)
    nodes, at, articles = [root], 0, 0
    standing: dict[str, list[Node]] = {}  # open elements by tag
    once = set()

    def close(to: Node) -> None:
        """Leave everything below `to`."""
        nonlocal node, articles
        while node is not to:
            articles -= node.tag in ("article", "main")
            standing[node.tag].pop()
            node = node.parent

    def put(text: str) -> None:
        node.inside.append(text)
        node.size += len(text.strip())

    while at < len(html):
        m = TOKEN.search(html, at)
        end = m.start() if m else len(html)
        if end > at:
            put(html[at:end])
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                put(m[0][9:-3])
            continue
        tag = tag.lower()
        if m[1]:
            found = standing.get(tag)
            if found and (tag in BLOCK or found[-1].depth > node.block.depth):  # an inline end tag doesn't close the blocks around it
                close(found[-1].parent)
            continue
        if tag in ("html", "body"):
            if tag in once:
                continue
            once.add(tag)
        up = node.near
        while up.tag not in WALLS:
            if tag in CLOSED_BY[up.tag]:
                close(up.parent)
                break
            up = up.parent.near
        child = Node(tag, node)
        mark(child, m[3], articles > 0)
        node.inside.append(child)
        nodes.append(child)
        if tag in ("article", "main") and not child.drop:
            up = node
            while up and not up.holds:  # a wrapper that holds the article is no sidebar, whatever its name
                up.holds = True
                if up.named and up.bad <= LAYOUT | HEADS:
                    up.named = False
                up = up.parent
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK and not UNQUOTED.search(m[3]):
            continue
        if tag in RAW:
            close_tag = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I).search(html, at)
            child.inside.append(html[at : close_tag.start()])
            at = close_tag.end()
            continue
        articles += tag in ("article", "main")
        standing.setdefault(tag, []).append(child)
        node = child
    settle(nodes)
    return nodes


def walk(node: Node) -> Iterator[tuple[Node, str | Node, bool]]:
    """(parent, text or element, leaving?) in page order, without dropped subtrees."""
    stack = [(node, iter(node.inside))]
    while stack:
        at, rest = stack[-1]
        for x in rest:
            if isinstance(x, str):
                yield at, x, False
            elif not x.drop:
                yield at, x, False
                stack.append((x, iter(x.inside)))
                break
        else:
            stack.pop()
            if stack:
                yield stack[-1][0], at, True


def blocks(node: Node) -> Iterator[tuple[Node, str]]:
    """(the block element it lies in, text) of each block of text under node."""
    text, owner, breaks = [], node, 0

    def out():
        found = " ".join("".join(text).split())
        text.clear()
        return found

    for parent, x, leaving in walk(node):
        if isinstance(x, str):
            if breaks >= 2 and x.strip() and (found := out()):
                yield owner, found
            breaks = breaks if not x.strip() else 0
            if not text or not text[0].strip():
                owner = parent
            text.append(unescape(x))
        elif x.tag in BLOCK:
            if found := out():
                yield owner, found
            breaks = 0
        elif x.tag == "br" and not leaving:
            breaks += 1
            text.append(" ")
        elif x.tag in ("td", "th"):
            text.append(" ")
    if found := out():
        yield owner, found


def main_text(html: str | None) -> str:
    """The main text, blocks joined by a newline; empty for null, empty or textless pages."""
    if not html:
        return ""
    nodes = parse(html)
    text = best_text(nodes)
    if not text and any(x.named for x in nodes):
        for x in nodes:
            x.drop = x.drop and not x.named
            x.score, x.length, x.links = 0.0, 0, 0
        text = best_text(nodes)
    return text


def best_text(nodes: list[Node]) -> str:
    """The text of the best container of a page and of the siblings that belong to it."""
    root = nodes[0]
    for parent, x, _ in walk(root):
        if isinstance(x, str):
            parent.length += len(x.strip())
    for owner, text in blocks(root):
        paragraph = owner.block
        up = paragraph if paragraph.tag in ("div", "section", "article", "main", "body", "td", "html") else paragraph.parent or paragraph
        up.score += 1 + text.count(",") + min(len(text) / 100, 3)
    for x in reversed(nodes):
        if x.parent and not x.drop:
            x.parent.length += x.length
            x.parent.links += x.length if x.tag == "a" else x.links
            x.parent.score += x.score / 2
    scored = [x for x in nodes if x.score and not x.drop]
    if not scored:
        return ""
    density = lambda x: x.links / max(1, x.length)
    for x in scored:
        x.score += 25 if x.tag in ("article", "main") else 5 if x.tag in ("div", "section") and x.names & GOOD else 0
        x.score *= 1 - density(x)
    best = max(scored, key=lambda x: x.score)
    up, whole = best, None
    while up:
        if up.tag in ("article", "main"):
            whole = up
        up = up.parent
    up = best
    while not whole and up.tag not in ("body", "html"):
        if up.length >= NEARLY_ALL * root.length:
            if up.links - best.links <= FEW_LINKS * (up.length - best.length):
                best = up
            break
        up = up.parent
    best = whole or best
    kept = [best]
    if best.parent:
        kept = []
        for x in best.parent.inside:
            if x is best:
                kept.append(x)
            elif isinstance(x, Node) and not x.drop and x.length:
                title = x.tag == "h1" or x.tag in BLOCK and x.length <= TITLE and not density(x) and any(isinstance(y, Node) and y.tag == "h1" for _, y, _ in walk(x))
                part = x.tag == best.tag and x.tag in ("article", "section") and density(x) <= FEW_LINKS
                text = " ".join(t for _, t in blocks(x))
                few = density(x) <= FEW_LINKS and not OWNED.match(text)
                reads = few and (SENTENCE.search(text) or len(text) > 80 or x.tag in LISTED and not x.links)
                if x.score >= 0.2 * best.score or reads or title or part:
                    kept.append(x)
    return "\n".join(text for x in kept for _, text in blocks(x))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points): the main text of every page.

    Null or empty html: empty text. Null ids and urls are carried. Ties and repeated rows: each is
    taken for itself. Very long pages are read whole. Empty table: no rows. Other columns are dropped.
    """
    columns = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    id_type = columns.schema["page_id"].dataType.simpleString()
    return columns.mapInArrow(extract, f"page_id {id_type}, url string, text string, n_chars bigint")


def op10_html_text(spark, sf_dir: str) -> DataFrame:
    """extract_main_text over all pages; its cases hold."""
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
