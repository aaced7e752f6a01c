"""Operator 5: main text of web pages by the containers that a host's pages agree on.

Every page's containers are scored by the paragraphs they hold; containers of menus,
headers, adverts, forms, comments and the like are out. A container's generalised
path (tags with their classes, digits made 0) gets the page's vote by its share of
the page's score. Votes are added up for each host in Spark. The pages are read again
with the winning path of their host, which is shortened to the smallest container
that covers the other text, as title and lead, of most of them; then once more with
that path. A page without that path falls back to its
own best container. White space inside a block becomes one space, character
references are decoded, and blocks are joined by an empty line. What is noise by its
class, id or as a form is kept when it holds most of the page's text (a wrapper or
form over half of it, others over nine tenths, comments all).

Defined results: null or empty html and pages without a container of text have an
empty text; a null url, or one without a host, belongs to the host ""; repeated rows
are extracted alike (each has its votes); empty tables give empty results; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_side, table

CONTAINERS = frozenset("html body div article section main td th table tbody tr ul ol dl li blockquote center nav header footer aside form "
                       "figure details dialog fieldset menu search".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 pre hr dt dd address figcaption summary caption thead tfoot option legend".split())
RAW = frozenset("script style title textarea noscript template iframe svg math object select button audio video canvas".split())
#: Elements, roles and name parts of what is not the article.
NOISE_TAGS = frozenset("nav header footer aside form menu search dialog fieldset".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
NOISE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banners?|cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|overlay|nav|navbar|navigation|menus?|"
    r"breadcrumbs?|sidebars?|side-bar|footers?|headers?|masthead|comments?|disqus|respond|replies|share|sharing|social|related|recommended|widgets?|"
    r"subscribe|newsletter|signup|login|search|pagination|pager|toolbar|skip|hidden)(?:$|[\s_-])", re.I)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs2>[^>]*+)>", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>]|$)""", re.I)
_CLOSE = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
_SAME = {t: re.compile(rf"<{t}(?=[\s/>])", re.I) for t in ("button", "select", "noscript")}  # do not nest
_BLOCK = re.compile(rf"</?(?:{'|'.join(sorted(BLOCKS))})(?=[\s/>])", re.I)
#: Names that hold the article as often as not, and names of what may well be longer than it.
_WRAPPER = re.compile(r"(?:^|\s)(?:(?:has|no|not|with|without)-\S+|\S+-(?:wrap|wrapper|container|layout|content|page|area|inner|outer))(?:$|\s)", re.I)
_REPLIES = re.compile(r"(?:^|[\s_-])(?:comments?|disqus|respond|replies)(?:$|[\s_-])", re.I)
_DIGITS = re.compile(r"\d+")


class _Node:
    __slots__ = ("tag", "path", "noise", "parent", "score", "most", "named", "held")

    def __init__(self, tag: str, path: str, noise: bool, parent: _Node | None, most: float | None = None):
        self.tag, self.path, self.noise, self.parent, self.score = tag, path, noise, parent, 0.0
        self.most = most  # noise by its name, unless it holds over this share of the page's text
        self.named = self if most is not None else parent.named if parent else None
        self.held = 0


def _noise(tag: str, attrs: dict[str, str]) -> bool:
    """Noise whatever it holds."""
    return (tag in NOISE_TAGS and tag != "form" or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true"
            or attrs.get("role", "").lower() in NOISE_ROLES)


def _named_noise(tag: str, attrs: dict[str, str]) -> float | None:
    """The share of the page's text over which an element is the article in spite of its
    name, None when nothing names it noise: a form or wrapper half, comments all."""
    if tag in ("html", "body", "main"):  # their classes tell what a page has besides the article
        return None
    names = [n for a in ("class", "id") if NOISE_NAMES.search(n := attrs.get(a, ""))]
    if not names:
        return .5 if tag == "form" else None
    if all(_WRAPPER.search(n) for n in names):
        return .5
    return .999 if any(_REPLIES.search(n) for n in names) else .9


def _settle(nodes: list[_Node], blocks: list[tuple[_Node, str, int]]) -> None:
    """Noise by name is noise, and all in it, unless it holds most of the page's text."""
    total = 0
    for node, text, links in blocks:
        if not node.noise and len(text) >= 25:
            size = max(0, len(text) - links)
            total += size
            named = node.named
            while named is not None:
                named.held += size
                named = named.parent.named
    for node in nodes:  # parents come first
        node.noise = node.noise or node.parent.noise or node.most is not None and node.held <= node.most * total


def parse(html: str) -> list[tuple[_Node, str, int]]:
    """Blocks in page order: the innermost container, the text, characters in links.
    A noisy element that holds no block-level text of its own, as a span, is left out too."""
    root = _Node("", "", False, None)
    stack, blocks, piece, nodes = [root], [], [], []
    closes: dict[str, re.Match | None] = {}  # the next end tag of raw elements, None when there is none from here on
    links = held = 0
    muted = ""  # an inline or paragraph element that is noise, until its end tag
    at = 0

    def flush():
        nonlocal links, held
        if piece:
            text = " ".join(unescape("".join(piece)).split())
            if text:
                blocks.append((stack[-1], text, min(held, len(text))))
            piece.clear()
        held = 0

    for m in iter(lambda: _TOKEN.search(html, at), None):
        if m.start() > at and not muted:
            text = html[at:m.start()]
            piece.append(text)
            if links:
                held += len(text.strip())
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag, end, attrs = tag.lower(), m["end"] or m["end2"], m["attrs"] or m["attrs2"] or ""
        if end:
            if muted:
                if tag == muted:
                    muted = ""
                elif tag not in CONTAINERS:
                    continue
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCKS:
                flush()
                muted = ""
                if tag in CONTAINERS and any(n.tag == tag for n in stack):
                    while stack.pop().tag != tag:
                        pass
                    links = 0
            continue
        if tag in RAW:
            if not attrs.endswith("/"):
                if tag not in closes or closes[tag] and closes[tag].start() < at:
                    closes[tag] = _CLOSE[tag].search(html, at)
                close = closes[tag]
                if close and tag in _SAME and _SAME[tag].search(html, at, close.start()):
                    close = None
                if not close:  # ends where a block does or begins
                    close = _BLOCK.search(html, at)
                    at = close.start() if close else len(html)
                else:
                    at = close.end()
            continue
        if tag == "head":
            continue
        if tag == "br":
            if not muted:
                piece.append(" ")
            continue
        if tag in BLOCKS:
            flush()
            muted = ""
        if tag == "a":
            links += 1
        named = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)} if attrs else {}
        if tag in CONTAINERS:
            links = 0
            if tag in ("td", "th", "tr", "li") and stack[-1].tag == tag:  # their end tags may be missing
                stack.pop()
            top = stack[-1]
            classes = ".".join(sorted(set(_DIGITS.sub("0", named.get("class", "")).lower().split())))
            stack.append(_Node(tag, f"{top.path}>{tag}" + (f".{classes}" if classes else ""), top.noise or _noise(tag, named), top, _named_noise(tag, named)))
            nodes.append(stack[-1])
        elif named and not muted and not attrs.endswith("/") and (_noise(tag, named) or _named_noise(tag, named) is not None):
            muted = tag
    if at < len(html) and not muted:
        piece.append(html[at:])
    flush()
    _settle(nodes, blocks)
    return blocks


def scores(blocks: list[tuple[_Node, str, int]]) -> dict[str, float]:
    """Score of each container path: paragraphs count for their container, half for the
    one around it and a quarter for the next."""
    found: dict[str, float] = {}
    for node, text, links in blocks:
        if not node.noise:
            worth = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - links / len(text)) if len(text) >= 25 else 0.1
            for share in (1, .5, .25):
                if node is None or not node.tag:
                    break
                found[node.path] = found.get(node.path, 0.0) + share * worth
                node = node.parent
    return found


def extract(html: str | None, path: str | None) -> str:
    """The blocks inside containers of that path, or of the page's best one."""
    blocks = parse(html or "")
    inside = _inside(blocks, path) if path else []
    if not inside and (own := scores(blocks)):
        inside = _inside(blocks, max(own, key=lambda p: (own[p], p)))
    return "\n\n".join(inside)


def _inside(blocks: list[tuple[_Node, str, int]], path: str) -> list[str]:
    return [text for node, text, _ in blocks if not node.noise and (node.path == path or node.path.startswith(path + ">"))]


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html) -> (host, path, votes): a page deals 1000 votes by the share of each path."""
    for batch in batches:
        hosts, paths, votes = [], [], []
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = scores(parse(html or ""))
            total = sum(own.values())
            for path, score in own.items():
                hosts.append(host)
                paths.append(path)
                votes.append(round(1000 * score / total))
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(votes, pa.int64())],
                                         names=["host", "path", "votes"])


def _covering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html, path) -> (host, depth): steps of the path to the smallest container around
    the text of a page that has it, links aside."""
    for batch in batches:
        hosts, depths = [], []
        for host, html, path in zip(*(c.to_pylist() for c in batch.columns)):
            blocks = parse(html or "")
            if not _inside(blocks, path):
                continue
            steps = path.split(">")
            depth = len(steps)
            for other in {node.path for node, text, links in blocks if node.tag and not node.noise and 2 * links < len(text)}:
                own = other.split(">")
                depth = next((i for i, (a, b) in enumerate(zip(steps[:depth], own)) if a != b), min(depth, len(own)))
            hosts.append(host)
            depths.append(depth if depth > 1 else len(steps))
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(depths, pa.int32())], names=["host", "depth"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(html, path) for html, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                         names=["page", "url", "text", "n_chars"])


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def winning_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path): the path with the most votes of a host's pages."""
    votes = pages.select(_host(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).mapInArrow(_votes, "host string, path string, votes long")
    total = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    return total.groupBy("host").agg(F.max(F.struct("votes", "path"))["path"].alias("path"))


def covering_paths(pages: DataFrame, winners: DataFrame) -> DataFrame:
    """(host, path): the winning path, or the container around it that covers the text of
    more than half of the host's pages. pages: host, html; winners: a materialised table."""
    seen = pages.join(small_side(winners), "host").select("host", "html", "path").mapInArrow(_covering, "host string, depth int")
    n = seen.groupBy("host", "depth").agg(F.count(F.lit(1)).alias("n"))
    deeper = F.sum("n").over(Window.partitionBy("host").orderBy(F.desc("depth")))
    depth = (n.withColumn("deeper", deeper).withColumn("all", F.sum("n").over(Window.partitionBy("host")))
             .where("2 * deeper > all").groupBy("host").agg(F.max("depth").alias("depth")))
    return (winners.join(depth, "host", "left")
            .select("host", F.when(F.col("depth").isNull(), F.col("path")).otherwise(
                F.array_join(F.slice(F.split("path", ">"), 1, F.col("depth")), ">")).alias("path")))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars for every page."""
    winners = materialize(winning_paths(pages, url_col, html_col), "paths")
    p = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), _host(F.col(url_col)).alias("host"))
    winners = materialize(covering_paths(p, winners), "covering")
    both = p.join(small_side(winners), "host", "left").select("page", "url", "html", "path")
    kind = p.schema["page"].dataType.simpleString()
    return both.mapInArrow(_extracted, f"page {kind}, url string, text string, n_chars long").toDF(id_col, url_col, "text", "n_chars")


def op5_consensus_paths(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages"))
