"""Main text of web pages by consensus host paths.

Each page's containers are scored by the text of the blocks they hold, less that of links. The best container's
path - tags and classes from the body down, digits generalised - is the page's vote for its host. Spark adds up the votes,
and each page is extracted again from the containers on its host's winning path; a page that has none uses its own best.

Inside the container menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are
left out, by tag, role, and names of class and id: a name counts if every word of it is one of furniture, so related-links
goes and related-work stays. An article's own header, in the article, is part of it. Formulas, drawings' texts and what stands in
for media stay. A block's white space becomes single spaces; blocks are joined by one.

Defined results: repeated rows are extracted each and an empty table gives no rows; null and empty pages give an empty text; pages without a host vote for none and use their own best; a
page cut off in the middle keeps what came; ties go to the longer text, then to the path that sorts last.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.bytewords import by_value, column_of
from corpusloom.llm.common import table, text_batches, written
from corpusloom.llm.urls import host_and_path

by_value(__name__)

#: Winning paths of up to so many hosts (a few MB) are sent to every task; of more, they are joined by host.
FEW_HOSTS = 50_000

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|iframe|select)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^<>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([\w:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input meta link".split())
CONTAINERS = frozenset("article main section div td body".split())
LEFT_OUT = frozenset("nav header footer aside form button menu dialog fieldset option input head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
#: Words of names of class and id whose elements go, whatever they hold; those that go unless they hold the article; and words that may stand beside them.
ALWAYS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored comment comments disqus replies reply respond cookie cookies consent gdpr popup modal newsletter subscribe breadcrumb breadcrumbs".split())
MAYBE = frozenset("banner promo sidebar menu nav navbar navigation header masthead footer notice notices alert signup share sharing social related recommended widget toolbar pagination pager copyright login search disclaimer".split())
BESIDE = frozenset("area bar block body bottom box center column container content fixed global group head heading inline inner item items js left link links list main mobile nav outer overlay page panel post primary right row secondary section side site slot small sticky strip text title top unit user wrap wrapper".split())
#: A start tag that ends an open paragraph, and the elements that end one of their own kind.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SELF = frozenset("li dt dd tr td th option".split())


class Node:
    __slots__ = ("tag", "name", "parent", "children", "out", "holds", "link", "article", "container")

    def __init__(self, tag: str, name: str, parent: Node | None, link: bool):
        self.tag, self.name, self.parent, self.link = tag, name, parent, link
        self.container = None if parent is None else parent if parent.tag in CONTAINERS else parent.container  # the nearest one around it
        self.article = tag == "article" or parent is not None and parent.article
        self.children: list = []  # nodes and strings
        self.out = 0  # 1 left out, 2 left out unless it holds the article
        self.holds = False


def parse(page: str) -> Node:
    root = at = Node("#", "", None, False)
    last, open_ = 0, defaultdict(int)  # how many elements of each tag are open

    def closed(to: Node, below: Node) -> None:
        while to is not below:
            open_[to.tag] -= 1
            to = to.parent

    for m in TOKEN.finditer(page):
        if m.start() > last:
            at.children.append(page[last : m.start()])
        last = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if m[2]:
            if open_[tag]:  # an end tag without its start is no reason to walk up
                node = at
                while node.tag != tag:
                    node = node.parent
                closed(at, node.parent)
                at = node.parent
            continue
        if tag in ENDS_P or tag in SELF:
            node = at
            ends = ("p",) if tag in ENDS_P else (tag,)
            if not open_[ends[0]]:
                node = None
            while node is not None and node.tag not in ends and (node.tag in INLINE or tag in SELF and node.tag == "p"):
                node = node.parent
            if node is not None and node.tag in ends:
                closed(at, node.parent)
                at = node.parent
        at.children.append(node := opened(tag, m[4], at))
        if node.holds:
            up = at
            while up is not None and not up.holds:
                up.holds = True
                up = up.parent
        if tag not in VOID and not m[4].endswith("/"):
            at = node
            open_[tag] += 1
    if last < len(page):
        at.children.append(page[last:])
    return root


def furniture(name: str) -> int:
    """Of a name of class or id: 1 if its element goes, 2 if it goes unless it holds the article, else 0."""
    words = {w.lower() for w in WORD.findall(name)}
    if not words or not words <= ALWAYS | MAYBE | BESIDE:
        return 0
    return 1 if words & ALWAYS else 2 if words & MAYBE else 0


def opened(tag: str, attributes: str, parent: Node) -> Node:
    name, out = tag, 1 if tag in LEFT_OUT and not (tag == "header" and parent.article) else 0
    if "=" in attributes or "hidden" in attributes:
        values = {a[0].lower(): a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(attributes)}
        kinds = re.sub(r"\d+", "#", values.get("class", "")).lower().split()
        name = ".".join([tag, *sorted(set(kinds))])
        if tag not in ("html", "body", "article", "main"):
            found = {furniture(x) for x in f"{values.get('class', '')} {values.get('id', '')}".split()} - {0}
            if 1 in found or "hidden" in values or values.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", values.get("style", "")):
                out = 1
            elif (found or values.get("role", "").lower() in ROLES) and not out:
                out = 2
    node = Node(tag, name, parent, tag == "a" or parent.link)
    node.out = out
    node.holds = tag in ("article", "main", "h1") and not out
    return node


def left_out(node: Node) -> bool:
    return node.out == 1 or node.out == 2 and not node.holds


def path_of(node: Node) -> str:
    names = []
    while node is not None and node.tag not in ("#", "html"):
        names.append(node.name)
        node = node.parent
    return ">".join(reversed(names))


def visited(root: Node) -> Iterator[tuple[Node | None, str | None, Node]]:
    """(entered or left node, text, where it stands) in page order, without what is left out; iterative, for deep pages."""
    stack: list = [(root, iter(root.children))]
    while stack:
        node, rest = stack[-1]
        child = next(rest, None)
        if child is None:
            stack.pop()
            yield node, None, node
        elif isinstance(child, str):
            yield None, child, node
        elif not left_out(child):
            yield child, None, node
            stack.append((child, iter(child.children)))


def text_of(nodes: list[Node]) -> str:
    blocks, raw = [], []

    def close() -> None:
        if raw and (block := " ".join(unescape("".join(raw)).split())):
            blocks.append(block)
        raw.clear()

    for root in nodes:
        for node, text, _ in visited(root):
            if text is not None:
                raw.append(text)
            elif node.tag == "br":
                raw.append(" ")
            elif node.tag not in INLINE:
                close()
        close()
    return " ".join(blocks)


def containers(root: Node) -> list[tuple[float, int, Node]]:
    """(score, characters, node) of the containers with text: each block counts for its container, and half for the one around it."""
    own: dict[int, list] = {}
    for _, text, at in visited(root):
        if text is None or not (size := len(text.strip())):
            continue
        share, node = (-0.5 if at.link else 1.0), at if at.tag in CONTAINERS else at.container
        while node is not None and share:
            entry = own.setdefault(id(node), [0.0, 0, node])
            entry[0] += share * size
            entry[1] += size
            share = share / 2 if abs(share) > 0.3 else 0
            node = node.container
    return [(s * (3 if n.tag in ("article", "main") else 1), c, n) for s, c, n in own.values()]


def best(root: Node) -> tuple[float, int, str, Node] | None:
    found = containers(root)
    top = max((x[:2] for x in found), default=None)
    return max(((s, c, path_of(n), n) for s, c, n in found if (s, c) == top), key=lambda x: x[2], default=None)


def extract(page: str | None, path: str | None) -> str:
    """The text of the containers on the path, or of the page's own best, or of the whole page if it has no container."""
    if not page:
        return ""
    root = parse(page)
    if path:
        found, wanted = [], path.split(">")
        for node, text, at in visited(root):
            if text is None and node is not at and node.name == wanted[-1] and path_of(node) == path:
                found.append(node)
        # Elements of one path are equally deep, so none holds another.
        if found and (text := text_of(found)):
            return text
    own = best(root)
    return text_of([own[3] if own else root])


def host_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path): each host's winning path."""
    text_batches(pages.sparkSession)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes: dict[tuple[str, str], list] = defaultdict(lambda: [0, 0.0])
            for host, page in zip(column_of(batch, "host").to_pylist(), column_of(batch, "html").to_pylist(), strict=True):
                if host and page and (top := best(parse(page))):
                    entry = votes[host, top[2]]
                    entry[0] += 1
                    entry[1] += top[1]
            columns = list(zip(*[(h, p, n, c) for (h, p), (n, c) in votes.items()], strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.float64()), strict=True)], ["host", "path", "votes", "chars"])

    rows = pages.select(host_and_path(F.col(url))[0].alias("host"), F.col(html).alias("html"))
    votes = rows.mapInArrow(vote, "host string, path string, votes long, chars double").groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("chars").alias("chars"))
    return votes.groupBy("host").agg(F.max_by("path", F.struct("votes", "chars", "path")).alias("path"))


def extracted(pages: DataFrame, url: str = "url", html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Columns of pages (`keep`, or all) with text and n_chars. Columns of pages of these names are replaced."""
    kept = [c for c in (pages.columns if keep is None else keep) if c not in ("text", "n_chars", "_html", "_host", "_path")]
    paths = written(host_paths(pages, url, html)).select(F.col("host").alias("_host"), F.col("path").alias("_path"))
    few = paths.limit(FEW_HOSTS + 1).count() <= FEW_HOSTS
    rows = pages.select(*kept, F.col(html).alias("_html"), host_and_path(F.col(url))[0].alias("_host")).join(F.broadcast(paths) if few else paths, "_host", "left").select(*kept, "_html", "_path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h, p) for h, p in zip(column_of(batch, "_html").to_pylist(), column_of(batch, "_path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(column_of(batch, c) for c in kept), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*kept, "text", "n_chars"])

    return rows.mapInArrow(run, T.StructType([pages.schema[c] for c in kept]).add("text", "string").add("n_chars", "long"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
