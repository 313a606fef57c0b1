"""Main text of web pages by composite text density.

The project keeps no web pages of its own, so this operator is general: it takes
any table of pages and returns their articles.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from noteloom.llm.columns import plain
from noteloom.llm.shipping import map_arrow

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table "
    "tbody td tfoot th thead tr ul".split()
)
#: Elements that never hold article text.
LEFT_OUT = frozenset(
    "nav footer aside script style noscript template button select option textarea input iframe object embed svg "
    "canvas audio video math head title dialog menu search xmp noembed noframes datalist".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
#: Words of a class or id that name page furniture.
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored sponsors promo promos promotion "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pager pagination topbar toolbar masthead footer "
    "sidebar sidebars widget widgets rail trending share sharing social cookie cookies consent gdpr banner banners "
    "popup modal overlay newsletter subscribe subscription signup login comments commentlist disqus respond hidden".split()
)
#: Words that name furniture on one page and a part of the article on another.
EITHER = frozenset(
    "header aside copyright legal related recommended recommendations notice notices alert comment reply replies "
    "discussion form".split()
)
#: Words that only say where furniture stands or how it is boxed.
PLACES = frozenset(
    "area bar block bottom box container group inner items left links list main outer page panel primary right row secondary "
    "section site slot top unit wrap wrapper".split()
)
COMMENTS = frozenset("comments commentlist disqus respond".split())
#: A whole name of these on an article element makes it a reader's comment.
REMARKS = COMMENTS | frozenset(("comment", "reply"))
#: A class such as no-sidebar speaks of other elements.
STATES = frozenset("no has have with without is not hide hides show shows".split())
#: Evidence that an element is furniture: a word that may mean something else, a name that says so, readers' comments.
WEAK, SURE, GONE, READERS = 1, 2, 3, 4
#: Loosely named elements outside an article stay with so many characters a block and this share of the page's text.
PROSE = 80
SOME = 0.1
ARTICLE = frozenset(("article", "main"))
NEARLY_ALL = 0.8
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NOTHING: frozenset[str] = frozenset()
PARAGRAPH = frozenset(("p",))
#: A start tag of these ends an open paragraph.
ENDS_PARAGRAPH = BLOCK - frozenset("body html caption td th tr tbody thead tfoot legend summary".split())
#: A start tag ends an open one of these, up to the given containers.
SIBLINGS = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
    "tr": (frozenset(("tr", "td", "th")), frozenset(("table",))),
    "td": (frozenset(("td", "th")), frozenset(("table", "tr"))),
    "th": (frozenset(("td", "th")), frozenset(("table", "tr"))),
}

_TAG = re.compile(
    r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*+(?:>|\Z)"""
    r"""|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attributes2>[^>]*+)(?:>|\Z))""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?""")
_WORD = re.compile(r"[a-z0-9]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """An element with its texts and children in page order, and the counts of its subtree."""

    __slots__ = ("name", "parent", "parts", "doubt", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, name: str, parent: Node | None, doubt: int = 0):
        self.name, self.parent, self.doubt = name, parent, doubt
        self.parts: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _named(key: str, value: str, name: str) -> int:
    """What a class or id says: sure where a whole name means furniture, weak where a word of it may."""
    doubt = 0
    for token in value.split():
        words = frozenset(_WORD.findall(token))
        found = words & (FURNITURE | EITHER)
        if not found or words & STATES:
            continue
        # The id of a section tells its topic.
        topic = key == "id" and name == "section" and not words & COMMENTS
        whole = all(word in found or word in PLACES or word.isdigit() for word in words)
        sure = whole and not topic and (len(found) > 1 or not found.isdisjoint(FURNITURE))
        listed = "comment" in words and not words.isdisjoint(PLACES)
        readers = whole and not topic and (listed or not words.isdisjoint(COMMENTS))
        doubt = max(doubt, READERS if readers else SURE if sure else WEAK)
    return doubt


def _is_remark(value: str) -> bool:
    """Whether a class or id of an article element names a reader's comment."""
    boxed = PLACES | frozenset(("div", "body"))
    return any(
        words & REMARKS and all(word in REMARKS or word in boxed or word.isdigit() for word in words)
        for words in (frozenset(_WORD.findall(token)) for token in value.split())
    )


def _doubt(name: str, attributes: str, in_article: bool) -> int:
    """How surely an element is furniture by its tag and attributes."""
    if name in LEFT_OUT or (name == "header" and not in_article):
        return GONE
    if name == "form":
        return SURE
    if not attributes or name in ("html", "body", "main"):
        return 0
    doubt, seen = 0, set()
    for found in _ATTRIBUTE.finditer(attributes):
        key, value = found.group(1).lower(), (found.group(2) or "").strip("\"'").lower()
        if key in seen:  # the first of equal attributes holds
            continue
        seen.add(key)
        if name == "article":
            if key in ("class", "id") and _is_remark(value):
                return READERS
            continue
        if (
            key == "hidden"
            or (key == "aria-hidden" and value.strip() == "true")
            or (key == "style" and _UNSEEN.search(value))
            or (key == "role" and value.strip() in ROLES)
        ):
            return SURE
        if key in ("class", "id") and not (in_article and name in ("header", *HEADINGS)):
            doubt = max(doubt, _named(key, value, name))
    return doubt


def parse(page: str) -> Node:
    """The tree of a page without elements that never hold its text; forgiving of unclosed and cut tags."""
    body = Node("body", None)
    stack = [(body, False)]  # open elements, and whether they are left out
    is_open: Counter[str] = Counter()

    def close_to(depth: int) -> None:
        is_open.subtract(node.name for node, _ in stack[depth:])
        del stack[depth:]

    def depth_of(names: frozenset[str], bounds: frozenset[str]) -> int | None:
        """The innermost open element of the names, if none of the bounds lies inside it."""
        if not any(is_open[name] for name in names):
            return None
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth][0].name in names:
                return depth
            if stack[depth][0].name in bounds:
                return None
        return None

    def text(start: int, stop: int) -> None:
        node, gone = stack[-1]
        if stop > start and not gone:
            node.parts.append(html.unescape(page[start:stop]))

    at = 0
    while (found := _TAG.search(page, at)) is not None:
        text(at, found.start())
        at = found.end()
        name = (found["name"] or found["name2"] or "").lower()
        if not name:
            continue
        if found["end"] or found["end2"]:
            # A stray inline end tag closes no block.
            if (depth := depth_of(frozenset((name,)), NOTHING if name in BLOCK else BLOCK)) is not None:
                close_to(depth)
            continue
        if name in ("html", "body"):
            continue
        if name in ENDS_PARAGRAPH and (depth := depth_of(PARAGRAPH, BLOCK)) is not None:
            close_to(depth)
        if name in SIBLINGS:
            same, outer = SIBLINGS[name]
            while (depth := depth_of(same, outer)) is not None:
                close_to(depth)
        attributes = found["attributes"] or found["attributes2"] or ""
        parent, gone = stack[-1]
        in_article = is_open["article"] + is_open["main"] > 0
        doubt = _doubt(name, attributes, in_article)
        gone = gone or doubt == GONE
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        node = Node(name, parent, doubt)
        if not gone:
            parent.parts.append(node)
        if name not in VOID and not (attributes.endswith("/") and name not in BLOCK and name != "a"):
            stack.append((node, gone))
            is_open[name] += 1
    text(at, len(page))
    return body


def _in_order(root: Node) -> list[Node]:
    """Every node after its ancestors, without recursion."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [part for part in reversed(node.parts) if isinstance(part, Node)]
    return out


def _count(nodes: list[Node]) -> None:
    """Characters and tags of every subtree, all and of links."""
    for node in nodes:
        node.chars = node.tags = node.link_chars = node.link_tags = 0
    for node in reversed(nodes):
        node.chars += sum(len("".join(part.split())) for part in node.parts if isinstance(part, str))
        node.link_chars = node.chars if node.name == "a" else node.link_chars
        node.link_tags += node.name == "a"
        if node.parent is not None:
            up = node.parent
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags


def _is_prose(node: Node) -> bool:
    """Whether a node's own letters are neither in a heading nor in a link."""
    while node.parent is not None:
        if node.name == "a" or node.name in HEADINGS:
            return False
        if node.name in BLOCK:
            return True
        node = node.parent
    return True


def prune(body: Node) -> None:
    """Take furniture out of the tree, by its names and by the text it holds.

    A subtree with most of the page's text outside links stays whatever its name, unless an article or
    main element with text stands beside it. A loosely named one also stays where its text outweighs its links and
    it lies in an article, is a section, or has long blocks that are a good share of the page, unless it is a list of teasers:
    several links with a good share of its letters, or articles inside. Readers' comments go however long they are, if
    the page has any text besides, outside headings and doubtful elements; so an element that holds an article of
    another kind is not taken for them.
    """
    nodes = _in_order(body)
    if not any(node.doubt for node in nodes):
        return
    _count(nodes)
    whole = body.chars - body.link_chars
    doubted: set[int] = set()  # nodes in or under a doubtful one
    articles: Counter[int] = Counter()  # articles inside a node that are nobody's comment
    for node in reversed(nodes):
        if node.parent is not None:
            articles[id(node.parent)] += articles[id(node)] + (node.name == "article" and not node.doubt)
    besides = 0  # letters of the page that nothing speaks against
    above: dict[int, int] = {}  # articles above a node that lie under no doubtful one
    clear = 0
    for node in nodes:
        up = node.parent
        if node.doubt or (up is not None and id(up) in doubted):
            doubted.add(id(node))
        above[id(node)] = 0
        if up is not None:
            above[id(node)] = above[id(up)] + (up.name in ARTICLE and id(up) not in doubted)
        clear += node.name in ARTICLE and id(node) not in doubted and node.chars > 0
        if id(node) not in doubted:
            besides += sum(len("".join(part.split())) for part in node.parts if isinstance(part, str)) * _is_prose(node)
    inside, poorer = {id(body): False}, {}
    for node in nodes[1:]:
        up = node.parent
        inside[id(node)] = inside[id(up)] or up.name in ARTICLE
        if not node.doubt:
            continue
        words = node.chars - node.link_chars
        stays = 2 * words > whole and clear <= above[id(node)]
        teasers = node.link_tags > 1 and 4 * node.link_chars >= words or articles[id(node)] > 1
        if node.doubt == READERS and besides and not articles[id(node)]:
            stays = False
        elif node.doubt == WEAK and teasers and besides:
            stays = False
        elif node.doubt == WEAK and words > node.link_chars:
            in_text = inside[id(node)] or node.name == "section"
            long = words >= PROSE * max(node.tags - node.link_tags, 1) and words >= SOME * whole
            stays = stays or in_text or long
        if not stays:
            poorer.setdefault(id(up), (up, set()))[1].add(id(node))
    for up, gone in poorer.values():
        up.parts = [part for part in up.parts if id(part) not in gone]


def measure(body: Node) -> list[Node]:
    """Composite density and its sum over the children, for every node of the page.

    Density is characters per tag, times a logarithm of how far text outweighs
    links; its base grows where a node's links outweigh its text more than the body's do.
    """
    nodes = _in_order(body)
    _count(nodes)
    body_share = body.link_chars / max(body.chars, 1)
    for node in nodes:
        tags, links, link_tags = max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        if node.chars == 0:
            continue
        base = math.log(node.chars / max(node.chars - node.link_chars, 1) * node.link_chars + body_share * node.chars + math.e)
        weight = math.log(max(node.chars / links * tags / link_tags, 1.0)) / max(math.log(base), 1.0)
        node.density = node.chars / tags * weight
    for node in nodes:
        node.total = sum(part.density for part in node.parts if isinstance(part, Node))
    return nodes


def select(body: Node) -> Node:
    """The subtree that holds the article.

    The node with the largest sum of child densities leads; the threshold is
    the least density on its path to the body. From the body down, nodes at or above the threshold
    give their best-summed descendant; the article is the smallest subtree over all of these. An
    article or main element around it then adds what it holds besides, and articles beside an article join it if they
    have more text than links; a tag never makes the result smaller. Lists of nothing but links below the threshold, before and
    after all that was found, are menus.
    """
    nodes = measure(body)
    leader = max(nodes, key=lambda node: (node.total, node.density))
    path = [leader]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    height = {id(node): place for place, node in enumerate(path)}
    threshold = min((node.density for node in path if node.density > 0), default=0.0)
    meet = 0
    todo = [(body, height[id(body)])]  # with the place on the path where its branch leaves
    while todo:
        node, leaves = todo.pop()
        leaves = height.get(id(node), leaves)
        if id(node) not in height and node.density >= threshold:
            meet = max(meet, leaves)
        else:
            todo += [(part, leaves) for part in node.parts if isinstance(part, Node)]
    # What only adds a heading or a line around the subtree belongs to it.
    while meet + 1 < len(path) - 1 and path[meet].chars >= NEARLY_ALL * path[meet + 1].chars:
        meet += 1
    around = [place for place, node in enumerate(path) if place > meet and node.name in ARTICLE]
    if around:
        meet = next((place for place in reversed(around) if path[place].name == "article"), around[0])
    if path[meet].name == "article" and any(
        part.name == "article" and part is not path[meet] and part.chars > 2 * part.link_chars
        for part in path[meet].parent.parts
        if isinstance(part, Node)
    ):
        meet += 1
    chosen = path[meet]
    if all(node.name not in ARTICLE for node in path[meet:]):
        for end in (-1, 0):
            while chosen.parts and _is_menu(chosen.parts[end], height, threshold):
                del chosen.parts[end]
    return chosen


def _is_menu(part: Node | str, height: dict[int, int], threshold: float) -> bool:
    """Nothing, or nothing but links, at the edge of a subtree."""
    if isinstance(part, str):
        return not part.strip()
    return id(part) not in height and part.chars == part.link_chars and part.name != "a" and part.density < threshold


def blocks(node: Node) -> list[str]:
    """The texts of a subtree's blocks in page order, white space inside each as one space."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        joined = " ".join("".join(run).split())
        if joined:
            out.append(joined)
        run.clear()

    todo: list[Node | str | None] = [node]
    while todo:
        part = todo.pop()
        if part is None:
            flush()
        elif isinstance(part, str):
            run.append(part)
        elif part.name == "br":
            run.append(" ")
        else:
            block = part.name in BLOCK
            if block:
                flush()
                todo.append(None)
            todo += reversed(part.parts)
    flush()
    return out


def article(page: str) -> str:
    """The article of a page: its blocks joined by an empty line."""
    body = parse(page)
    prune(body)
    return "\n\n".join(blocks(select(body)))


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every page (page_id, url, html), whole.

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left
    out, but a name alone never takes most of a page (see ``prune``). Returns ``page_id``, ``url``, ``text`` (empty if there is none) and
    ``n_chars``, its code points. Null html is an empty page; rows are independent, so repeated rows
    give repeated results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [article(page.as_py()) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    work = plain(pages, "page_id", "url", "html").withColumn("html", F.coalesce(F.col("html").cast("string"), F.lit("")))
    fields = StructType([work.schema["page_id"], work.schema["url"]]).add("text", "string").add("n_chars", "long")
    return map_arrow(work, run, fields)
