"""Main text of web pages, by a style tree per site.

Pages of one host are merged into one tree. An element node is known by its path:
its parent's style (the sequence of the parent's children, each by tag and class),
its place in it and its own tag and class. Its styles are the child sequences
that pages have under it; a node without child elements holds text, and each
distinct text is a value of it. With c of m pages holding a value,

    importance = 1 - sum(c ln c) / (m ln m)        (1 for a single page)

which is the entropy of a node's presentation, and of its content: 0 if all
pages look or read the same, 1 if every page has its own. A node with l styles has the
composite importance (1 - g ** l) * own + g ** l * (mean of its children, weighted
by the share of their style). A branch that at least ``LEAST_PAGES`` different pages
have, and that is below ``LEAST_IMPORTANCE`` with all that is under it, is removed from
every page that has it.

Marks in the markup go first. Elements whose tag, role or class names a menu, header,
footer, sidebar, notice, advert, form, script, style or comment section have importance
0. Where a page declares its article (``article``, ``main``), its text is what
stands there, and paragraphs, headings, lists, tables and the like inside have
importance 1, as copies of one article on a host would otherwise pass for boilerplate.
Containers without a mark, and all of a page that declares no article, are the tree's
to judge. A page that would lose all its text so keeps it.

Elements deeper than ``DEPTH`` are content of their ancestor at that depth. Null and
empty pages have an empty text; a null or odd URL is a host of its own. Equal
pages of a host count once in the tree, and each is returned.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import free_name, materialize, table

LEAST_IMPORTANCE = 0.3
LEAST_PAGES = 3
DECAY = 0.9
DEPTH = 32
#: Branches to remove that are broadcast as they are; more are joined to pages instead.
MOST_BROADCAST = 500_000

_WORDS = str.split
RAW = frozenset(_WORDS("script style title textarea xmp iframe noembed noframes noscript template svg math"))
VOID = frozenset(_WORDS("area base br col embed hr img input link meta source track wbr param keygen frame"))
INLINE = frozenset(_WORDS("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr"))
#: Elements that are never part of the text, wherever they stand.
NO_TEXT = frozenset(_WORDS("head script style title textarea xmp iframe noembed noframes noscript template svg nav footer aside form button select option input dialog menu object canvas audio video datalist"))
NO_TEXT_ROLES = frozenset(_WORDS("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar"))
#: Parts of class names and ids that name what isn't article text.
NO_TEXT_NAMES = frozenset(_WORDS(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments disqus respond reply replies share sharing social related "
    "recommended newsletter subscribe subscription signup login search popup modal overlay pagination pager widget toolbar"))
HEAD = frozenset(_WORDS("meta link title style script base noscript template"))
ARTICLE = frozenset(_WORDS("article main"))
TEXT_BLOCKS = frozenset(_WORDS("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table caption thead tbody tfoot tr td th figure figcaption address hgroup details summary"))
#: Open elements that a start tag ends, and the elements at which the search for them stops.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
        "th": ({"td", "th"}, {"tr", "table"}), "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
        "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}

_TOKEN = re.compile(r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'=/>]+)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"[0-9]+")


class Node:
    """An element of a page: its children are nodes, and lists of text pieces between them."""

    __slots__ = ("tag", "style", "no_text", "parent", "children", "depth", "declared", "paragraph", "has_block")

    def __init__(self, tag: str, style: str, no_text: bool, parent: "Node | None") -> None:
        self.tag, self.style, self.no_text, self.parent = tag, style, no_text, parent
        self.children: list = []
        self.depth = parent.depth + 1 if parent else 0
        self.declared = tag in ARTICLE or bool(parent and parent.declared)
        #: The open paragraph that a block element here would end.
        self.paragraph = self if tag == "p" else None if parent is None or tag in ("button", "td", "th", "caption", "object") else parent.paragraph
        self.has_block = False
        if tag not in INLINE:
            while parent and parent.tag in INLINE and not parent.has_block:
                parent.has_block = True
                parent = parent.parent


def _marks(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """An element's presentation, whether it is no text by its tag or role, and whether by a name."""
    if "=" not in attributes:
        return tag, tag in NO_TEXT, False
    found = {}
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), html.unescape(a or b or c))
    classes = " ".join(sorted(_DIGITS.sub("", found.get("class", "")).lower().split()))
    names = {x.lower() for x in _NAME.findall(f"{found.get('class', '')} {found.get('id', '')}")}
    by_role = found.get("role", "").strip().lower() in NO_TEXT_ROLES
    return f"{tag}.{classes}" if classes else tag, tag in NO_TEXT or by_role, not names.isdisjoint(NO_TEXT_NAMES)


def parse(page: str) -> Node:
    """The page's elements, by a lenient reading: unclosed and stray tags, comments, raw text."""
    root = Node("body", "body", False, None)
    at, position, named = root, 0, []

    def put(text: str) -> None:
        if at.children and isinstance(at.children[-1], list):
            at.children[-1].append(text)
        else:
            at.children.append([text])

    for token in _TOKEN.finditer(page):
        if token.start() < position:
            continue  # inside raw text
        if token.start() > position:
            put(page[position : token.start()])
        position = token.end()
        tag = token[2]
        if tag is None:
            continue
        tag = tag.lower()
        if token[1]:
            there = at
            while there is not root and there.tag != tag and not (tag in INLINE and there.tag not in INLINE):
                there = there.parent
            if there is not root and there.tag == tag:
                at = there.parent
            elif tag == "p":
                at.children.append(Node("p", "p", False, at))
            continue
        if at.tag == "head" and tag not in HEAD:
            at = root
        if tag in ("html", "body"):
            continue
        if tag == "br":
            put(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                at.children.append(Node("hr", "hr", False, at))
            continue
        if tag in ENDS:
            closed, stop = ENDS[tag]
            there, last = at, None
            while there is not root and there.tag not in stop:
                if there.tag in closed:
                    last = there
                there = there.parent
            if last is not None:
                at = last.parent
        if tag not in INLINE and tag not in RAW and at.paragraph is not None:
            at = at.paragraph.parent
        style, by_tag, by_name = _marks(tag, token[3])
        inside = at.declared
        node = Node(tag, style, by_tag or tag == "header" and not inside, at)
        at.children.append(node)
        if by_name and (inside or tag not in ARTICLE):
            named.append((node, inside))
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, position)
            position = end.end() if end else len(page)
            continue
        at = node
    if position < len(page):
        put(page[position:])
    for node, inside in named:  # names of what holds the article say how it is laid out
        if inside or not _holds_article(node):
            node.no_text = True
    return root


def _holds_article(node: Node) -> bool:
    open_ = [node]
    while open_:
        for child in open_.pop().children:
            if isinstance(child, Node):
                if child.tag in ARTICLE and not child.no_text:
                    return True
                open_.append(child)
    return False


class Block:
    """A run of text between the borders of block elements, with the ids of the tree's nodes above it."""

    __slots__ = ("text", "path", "sure", "declared")

    def __init__(self, text: str, path: tuple, sure: bool, declared: bool) -> None:
        self.text, self.path, self.sure, self.declared = text, path, sure, declared


def _id(*parts) -> int:
    return int.from_bytes(blake2b("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _flow(node: Node) -> list:
    """A node's content in order: text pieces, block elements, and ``None`` for nothing (elements that are no text)."""
    out: list = []
    stack = [iter(node.children)]
    while stack:
        child = next(stack[-1], stack)
        if child is stack:
            stack.pop()
        elif isinstance(child, list):
            out += child
        elif child.no_text:
            if child.tag not in INLINE:
                out.append(None)
        elif child.tag in INLINE and not child.has_block:
            stack.append(iter(child.children))
        else:
            out.append(child)
    return out


def _all_text(node: Node) -> str:
    out, open_ = [], [node]
    while open_:
        here = open_.pop()
        if isinstance(here, str):
            out.append(here)
        else:
            open_ += reversed([x for x in _flow(here) if x is not None])
    return _clean(out)


def _clean(pieces: list[str]) -> str:
    return " ".join(html.unescape("".join(pieces)).split())


def blocks_of(page: str | None) -> tuple[list[Block], list[tuple]]:
    """A page's blocks, and its tree nodes as (node, the style it stands in, value, depth, child elements and texts; 0 without elements)."""
    if not page:
        return [], []
    blocks: list[Block] = []
    nodes: list[tuple] = []
    # (element, its node id, the style it stands in, ids of the nodes down to it, text is sure to stay, still in the tree)
    open_: list = [(parse(page), _id("body"), 0, (), False, True)]
    while open_:
        here = open_.pop()
        if isinstance(here, Block):
            blocks.append(here)
            continue
        node, own, within, path, sure, tracked = here
        sure = sure or (node.declared and node.tag in TEXT_BLOCKS)
        parts: list = []  # strings for runs of text, nodes for elements
        pieces: list[str] = []
        for x in [*_flow(node), None]:
            if isinstance(x, str):
                pieces.append(x)
                continue
            text = _clean(pieces)
            pieces = []
            if text:
                parts.append(text)
            if x is not None:
                parts.append(x)
        if not parts:
            continue
        tracked = tracked and not sure
        children: list = []
        if not tracked or len(path) >= DEPTH or not any(isinstance(p, Node) for p in parts):
            if tracked:
                nodes.append((own, within, _id("text", *(p if isinstance(p, str) else _all_text(p) for p in parts)), len(path), 0))
            children = [(p, own, within, path, sure, False) if isinstance(p, Node) else Block(p, path, sure, node.declared) for p in parts]
        else:
            style = _id(own, *("#text" if isinstance(p, str) else p.style for p in parts))
            nodes.append((own, within, style, len(path), len(parts)))
            for j, p in enumerate(parts):
                below = _id(style, j)
                if isinstance(p, Node):
                    children.append((p, below, style, (*path, below), sure, True))
                else:
                    nodes.append((below, style, _id("text", p), len(path) + 1, 0))
                    children.append(Block(p, (*path, below), sure, node.declared))
        open_ += reversed(children)
    return blocks, nodes


def text_of(page: str | None, removed: frozenset | set) -> tuple[str, int]:
    """The page's text without the blocks under ``removed`` tree nodes, and the number of blocks that these cost."""
    blocks, _ = blocks_of(page)
    if any(b.declared for b in blocks):
        blocks = [b for b in blocks if b.declared]
    kept = [b for b in blocks if b.sure or removed.isdisjoint(b.path)] or blocks
    return "\n".join(b.text for b in kept), len(blocks) - len(kept)


def host_of(url: Column) -> Column:
    """The URL's host in lower case, without user and port; what has none is its own host, null is empty."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.lower(F.coalesce(F.nullif(host, F.lit("")), url, F.lit("")))


def _page_nodes(pages: DataFrame) -> DataFrame:
    """Tree nodes of (host, html) as one row a page: host, page, and arrays of node, within, value, depth, kids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                at, columns = [], ([], [], [], [], [])
                for i, page in enumerate(part.column(2)):
                    _, nodes = blocks_of(page.as_py())
                    if nodes:
                        at.append(i)
                        for column, values in zip(columns, zip(*nodes)):
                            column.append(list(values))
                take = pa.array(at, pa.int32())
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int16(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), *(pa.array(c, pa.list_(k)) for c, k in zip(columns, kinds))],
                    ["host", "page", "node", "within", "value", "depth", "kids"])

    schema = "host long, page long, node array<long>, within array<long>, value array<long>, depth array<short>, kids array<int>"
    return pages.mapInArrow(read, schema)


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, node, depth, pages, importance, highest): composite importances of the nodes of all hosts' trees, from (host, page, html).

    ``highest`` is the highest importance of a node and of all under it.

    Levels are worked off from the leaves up, one small table each: a node's
    children meet in the style that they stand in. Children that are sure to
    stay aren't in the tree and count 1.
    """
    parts = ["node", "within", "value", "depth", "kids"]
    once = _page_nodes(pages).groupBy("host", "page").agg(*(F.first(c).alias(c) for c in parts))
    values = once.select("host", F.explode(F.arrays_zip(*parts)).alias("x")).select("host", "x.*").groupBy("host", *parts).agg(F.count(F.lit(1)).alias("c"))
    values = materialize(values, "tree-values")
    c, m = F.col("c").cast("double"), F.col("pages").cast("double")
    stats = values.groupBy("host", "node", "within", "depth").agg(F.sum("c").alias("pages"), F.sum(c * F.log(c)).alias("a"), F.count_if(F.col("kids") > 0).alias("styles"))
    own = F.when(F.col("pages") > 1, F.greatest(F.lit(0.0), 1 - F.col("a") / (m * F.log(m)))).otherwise(1.0)
    nodes = materialize(stats.withColumn("own", own), "tree-nodes")
    deepest = nodes.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    level, levels = None, []
    for depth in range(deepest, -1, -1):
        here = nodes.filter(F.col("depth") == depth)
        if level is None:
            found = here.withColumn("importance", F.col("own")).withColumn("highest", F.col("own"))
        else:
            children = level.groupBy("host", F.col("within").alias("value")).agg(
                F.sum(1 - F.col("importance")).alias("lacks"), F.max("highest").alias("top"), F.count(F.lit(1)).alias("in_tree"))
            shares = values.filter((F.col("depth") == depth) & (F.col("kids") > 0)).join(children, ["host", "value"], "left")
            # pages in which the node has no child elements lack nothing
            below = shares.groupBy("host", "node").agg(F.sum(F.col("c") * F.coalesce("lacks", F.lit(0.0)) / F.col("kids")).alias("lacks"),
                F.max(F.when(F.col("in_tree") == F.col("kids"), F.col("top")).otherwise(1.0)).alias("top"))
            weight = F.pow(F.lit(DECAY), F.col("styles"))
            mixed = (1 - weight) * F.col("own") + weight * (1 - F.col("lacks") / F.col("pages"))
            found = here.join(below, ["host", "node"], "left").withColumn("importance", F.coalesce(mixed, F.col("own"))).withColumn(
                "highest", F.greatest("importance", "top")).drop("lacks", "top")
        level = materialize(found, f"tree-level-{depth}")
        levels.append(level.select("host", "node", "depth", "pages", "importance", "highest"))
    return reduce(DataFrame.unionByName, levels)


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of Arrow batches whose last two columns are html and the page's removed nodes."""
    for batch in batches:
        n = batch.num_columns
        for low in range(0, batch.num_rows, 512):
            part = batch.slice(low, 512)
            found = [text_of(p.as_py(), frozenset(r.as_py() or ())) for p, r in zip(part.column(n - 2), part.column(n - 1))]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(i) for i in range(n - 2)), pa.array([t for t, _ in found], pa.string()), pa.array([k for _, k in found], pa.int64())],
                [*part.schema.names[: n - 2], "text", "n_removed"])


def extract(pages: DataFrame, url: str = "url", page_html: str = "html", keep: list[str] | None = None, least_importance: float = LEAST_IMPORTANCE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``keep`` (all but the html) with ``text`` and ``n_removed``, the number of blocks that the site's tree removed.

    Columns of these two names are replaced.
    """
    keep = [c for c in (keep or pages.columns) if c not in (page_html, "text", "n_removed")]
    host, page = F.xxhash64(host_of(F.col(url))).alias("host"), F.xxhash64(F.col(page_html)).alias("page")
    tree = style_tree(pages.select(host, page, F.col(page_html).alias("html")))
    low = tree.filter((F.col("depth") > 0) & (F.col("pages") >= least_pages) & (F.col("highest") < least_importance)).select("host", "node")
    low = materialize(low, "tree-low")
    h, p, removed = (free_name(pages.columns, x) for x in ("of_host", "of_page", "removed_nodes"))
    if low.count() <= MOST_BROADCAST:
        lists = low.groupBy(F.col("host").alias(h)).agg(F.collect_list("node").alias(removed))
        keyed = pages.withColumn("host_" + h, F.xxhash64(host_of(F.col(url))))
        joined = keyed.join(F.broadcast(lists), F.col("host_" + h) == F.col(h), "left")
    else:  # lists by page, joined by host and page, so that a large host spreads
        nodes = _page_nodes(pages.select(host, page, F.col(page_html).alias("html"))).select("host", "page", F.explode("node").alias("node"))
        lists = nodes.join(low, ["host", "node"]).groupBy(F.col("host").alias(h), F.col("page").alias(p)).agg(F.collect_set("node").alias(removed))
        keyed = pages.withColumn("host_" + h, F.xxhash64(host_of(F.col(url)))).withColumn("page_" + p, F.xxhash64(F.col(page_html)))
        joined = keyed.join(lists, (F.col("host_" + h) == F.col(h)) & (F.col("page_" + p) == F.col(p)), "left")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema)
    rows = joined.select(*keep, F.col(page_html).alias("html_"), F.col(removed))
    return rows.mapInArrow(_strip, f"{kinds}, text string, n_removed long")


def op12_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    found = extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_removed")
