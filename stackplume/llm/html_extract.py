"""Main text of web pages by consensus on host paths.

Every page votes: its containers are scored by how much running text they hold and how little of it is links, and the
best one names its generalised path, the tags and classes from the top with digits and repeated wrappers taken out.
Spark adds up the votes per host and path.  A path wins where at least two pages vote for it, and at least half of the
host's pages that have it do.  Text is then taken again by the winners: the one with the most votes that the page has
gives the text; a page that has none of them falls back to its own best container.

Pages are read by one pass of a tokenising expression; scripts, styles, menus, headers, footers, sidebars, notices,
adverts, forms and comments are left out.  What only looks like one of them because it wraps the article is not: see
``_unwrapped``.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackplume.llm.common import Store

# Elements by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg math title head select".split())
SKIPPED = frozenset("nav header footer aside form button dialog menu".split())
BLOCKS = frozenset(
    "address article blockquote body br caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr html li "
    "main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article main section div td body html".split())
#: Parts of a class by which it says what an element holds or lacks, not what it is.
HOLDING = frozenset("no has with without".split())
#: First parts of classes of the article's surroundings, unless their last part is unwanted itself (site-footer).
SURROUNDING = frozenset("content main page site".split())
#: Elements that a new one of the same group ends.
ENDED_BY = {
    "p": BLOCKS - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"},
    "th": {"td", "th", "tr"},
}
#: Words of a class, id or role that mark what is not the article.
UNWANTED = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header "
    "login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo related share sharing sidebar "
    "signup social sponsor sponsored subscribe subscription toolbar widget".split()
)

_token = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|</[^a-zA-Z>][^>]*>|</>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|([^<]+|<(?![a-zA-Z/!?]))",
    re.S,
)
#: A tag whose quotes do not pair up ends at the next bracket.
_broken_tag = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>()", re.S)
_marks = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_hidden = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_split = re.compile(r"[^a-z]+")
#: A container of a winning path with less than this share of the page's text is not its article.
LEAST_SHARE = 0.05
_blank = re.compile(r"\s+")
_digits = re.compile(r"\d+")


@dataclass
class Node:
    """An open or closed element: its blocks lie between ``first`` and ``last`` of the page's blocks."""

    tag: str
    path: str
    first: int
    marked: bool = False
    left_out: bool = False
    last: int = -1
    text: int = 0
    links: int = 0
    commas: int = 0


@dataclass
class Block:
    text: str
    links: int


def _unwanted(token: str) -> bool:
    """Whether a class, id or role says that an element is not the article."""
    parts = [p for p in _split.split(token) if p]
    if not any(p in UNWANTED for p in parts) or not HOLDING.isdisjoint(parts):
        return False
    return parts[0] not in SURROUNDING or parts[-1] in UNWANTED


def _attributes(raw: str) -> tuple[str, bool, bool]:
    """The generalised class of an element, whether its marks say that it is not the article, and whether a whole one does."""
    classes, unwanted = "", bool(_hidden.search(raw))
    whole = unwanted
    for name, *values in _marks.findall(raw):
        value = next((v for v in values if v), "").lower()
        tokens = value.split()
        unwanted = unwanted or any(map(_unwanted, tokens))
        whole = whole or any(t in UNWANTED for t in tokens)
        if name.lower() == "class":
            classes = ".".join(sorted(_digits.sub("#", value).split()))
    return classes, unwanted, whole


def read_page(page: str | None) -> tuple[list[str], list[Node]]:
    """Blocks of text outside elements that are left out, in page order, and the elements of a page."""
    page = page or ""
    root = Node("html", "", 0)
    open_nodes, nodes = [root], [root]
    blocks: list[Block] = []
    pending: list[str] = []
    links = linked = 0
    position = 0

    def flush() -> None:
        nonlocal pending, linked
        if pending:
            text = _blank.sub(" ", html.unescape("".join(pending))).strip()
            if text:
                blocks.append(Block(text, linked))
            pending, linked = [], 0

    end = len(page)
    while position < end:
        found = _token.match(page, position) or _broken_tag.match(page, position)
        if not found:
            # An unfinished tag at the end of the page is no text.
            break
        position = found.end()
        closing, tag, attributes, text = found.groups()
        if text:
            pending.append(text)
            if links:
                linked += len(text.strip())
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            if tag == "p" and not any(n.tag == "p" for n in open_nodes):
                flush()
                continue
            at = next((i for i in range(len(open_nodes) - 1, 0, -1) if open_nodes[i].tag == tag), 0)
            if at:
                if tag in BLOCKS or tag in SKIPPED or any(n.left_out for n in open_nodes[at:]):
                    flush()
                for node in open_nodes[at:]:
                    links -= node.tag == "a"
                    node.last = len(blocks)
                del open_nodes[at:]
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}\s*>", re.I).search(page, position) if not attributes.endswith("/") else None
            if stop:
                position = stop.end()
            elif tag in ("script", "style") and not attributes.endswith("/"):
                position = end
            continue
        if tag in BLOCKS or tag in SKIPPED:
            flush()
        while len(open_nodes) > 1 and tag in ENDED_BY.get(open_nodes[-1].tag, ()):
            open_nodes.pop().last = len(blocks)
        if tag in VOID or attributes.endswith("/"):
            continue
        parent = open_nodes[-1]
        if tag == "a":
            links += 1
            open_nodes.append(Node(tag, parent.path, len(blocks)))
            continue
        if tag in BLOCKS or tag in SKIPPED:
            classes, unwanted, whole = _attributes(attributes) if attributes else ("", False, False)
            left_out = tag in SKIPPED or (unwanted and tag not in ("html", "body", "article", "main"))
            if tag == "article":
                left_out = whole
            if tag == "header" and any(n.tag in ("article", "main") for n in open_nodes):
                left_out = unwanted
            step = f"{tag}.{classes}" if classes else tag
            path = parent.path if parent.path.endswith("/" + step) else f"{parent.path}/{step}"
            node = Node(tag, path, len(blocks), unwanted, left_out)
            open_nodes.append(node)
            nodes.append(node)
        else:
            open_nodes.append(Node(tag, parent.path, len(blocks)))
    flush()
    for node in open_nodes:
        node.last = len(blocks)
    return _measured(blocks, nodes)


def _seen(blocks: list[Block], nodes: list[Node]) -> list[bool]:
    """Which blocks stand outside all elements that are left out."""
    covers = [0] * (len(blocks) + 1)
    for node in nodes:
        if node.left_out:
            covers[node.first] += 1
            covers[node.last] -= 1
    return [depth == 0 for depth in accumulate(covers[:-1])]


def _unwrapped(blocks: list[Block], nodes: list[Node]) -> list[bool]:
    """Which blocks are seen, once elements that only wrap the article are no longer left out.

    Where no article or main element is seen, those around the longest unmarked one are such.  A form with over half of
    the text that no other element leaves out is one.  If nothing at all is seen, so are the outermost marked elements
    with over half of the page's text.
    """
    size = [0, *accumulate(len(b.text) for b in blocks)]

    def length(node: Node) -> int:
        return size[node.last] - size[node.first]

    forms = [n for n in nodes if n.tag == "form" and n.left_out]
    for node in forms:
        node.left_out = False
    seen = _seen(blocks, nodes)
    open_size = [0, *accumulate(len(b.text) * s for b, s in zip(blocks, seen))]
    for node in forms:
        node.left_out = node.marked or 2 * (open_size[node.last] - open_size[node.first]) <= open_size[-1]
    seen = _seen(blocks, nodes)
    mains = [n for n in nodes if n.tag in ("article", "main") and not n.marked and length(n)]
    if mains and not any(any(seen[n.first : n.last]) for n in mains):
        best = max(mains, key=lambda n: (length(n), -n.first))
        for node in nodes:
            if node.left_out and node.first <= best.first and node.last >= best.last and node is not best:
                node.left_out = False
        seen = _seen(blocks, nodes)
    if blocks and not any(seen):
        for node in nodes:
            if node.left_out and node.tag not in SKIPPED and 2 * length(node) > size[-1]:
                node.left_out = False
                break
        seen = _seen(blocks, nodes)
    return seen


def _measured(blocks: list[Block], nodes: list[Node]) -> tuple[list[str], list[Node]]:
    """The texts of the blocks that are seen, and the nodes with their places and sums among these."""
    if any(n.left_out for n in nodes):
        seen = _unwrapped(blocks, nodes)
        places = [0, *accumulate(map(int, seen))]
        blocks = [b for b, s in zip(blocks, seen) if s]
        for node in nodes:
            node.first, node.last = places[node.first], places[node.last]
    text = [0, *accumulate(len(b.text) for b in blocks)]
    links = [0, *accumulate(b.links for b in blocks)]
    commas = [0, *accumulate(b.text.count(",") + b.text.count(".") for b in blocks)]
    for node in nodes:
        node.text, node.links, node.commas = (x[node.last] - x[node.first] for x in (text, links, commas))
    return [b.text for b in blocks], nodes


def container_score(node: Node) -> float:
    """Running text, less what is links; the closest container of the text wins over those around it."""
    if node.text == 0:
        return 0.0
    share = min(1.0, node.links / node.text)
    depth = node.path.count("/")
    bonus = {"article": 1.5, "main": 1.3}.get(node.tag, 1.0)
    return bonus * (node.text + 20 * node.commas) * (1 - share) ** 2 * (1 + 0.001 * min(depth, 20))


def candidates(nodes: list[Node]) -> dict[str, float]:
    """Scores of the generalised paths of a page; containers on one path count together."""
    found: dict[str, float] = {}
    for node in nodes:
        if node.tag in CONTAINERS and node.text:
            found[node.path] = found.get(node.path, 0.0) + container_score(node)
    return found


def ranges_at(nodes: list[Node], path: str) -> list[int]:
    """First and last blocks of all containers on a path, in page order and each block once, as one flat list."""
    ranges: list[int] = []
    upto = 0
    for first, last in sorted((n.first, n.last) for n in nodes if n.path == path and n.tag in CONTAINERS):
        if last > max(first, upto):
            ranges += [max(first, upto), last]
            upto = last
    return ranges


def joined(blocks: list[str], ranges: list[int]) -> str:
    return " ".join(b for first, last in zip(ranges[::2], ranges[1::2]) for b in blocks[first:last])


def page_text(page: str | None, path: str | None = None) -> str:
    """The text of a page on a path; on the path of its own best container if there is none or it holds too little."""
    blocks, nodes = read_page(page)
    own = candidates(nodes)
    best = _best(own)
    return "" if best is None else _taken(blocks, {p: ranges_at(nodes, p) for p in {best, path} if p in own}, path, best)


def _best(scores: dict[str, float]) -> str | None:
    return min(scores, key=lambda p: (-scores[p], p), default=None)


def _taken(blocks: list[str], ranges: dict[str, list[int]], path: str | None, own: str) -> str:
    text = joined(blocks, ranges[path]) if path in ranges else ""
    return text if text and len(text) >= LEAST_SHARE * sum(map(len, blocks)) else joined(blocks, ranges[own])


def host_of(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def read_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, host, vote (the path of the best container), shape (a hash of all container paths), paths, ranges, blocks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            votes, shapes, paths, ranges, blocks = [], [], [], [], []
            for page in rows["html"].to_pylist():
                texts, nodes = read_page(page)
                scores = candidates(nodes)
                known = sorted(scores)
                votes.append(_best(scores))
                shapes.append(xxhash.xxh3_64_intdigest("\n".join(known).encode("utf-8", "replace")) - (1 << 63))
                paths.append(known)
                ranges.append([ranges_at(nodes, p) for p in known])
                blocks.append(texts)
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    rows["page_id"], rows["url"], rows["host"], pa.array(votes, pa.string()), pa.array(shapes, pa.int64()),
                    pa.array(paths, strings), pa.array(ranges, pa.list_(pa.list_(pa.int32()))), pa.array(blocks, strings),
                ],
                ["page_id", "url", "host", "vote", "shape", "paths", "ranges", "blocks"],
            )

    rows = pages.select("page_id", "url", "html", host_of().alias("host"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(
        read, f"page_id {kinds['page_id']}, url {kinds['url']}, host string, vote string, shape long, "
        "paths array<string>, ranges array<array<int>>, blocks array<string>"
    )


def shapes_of(read: DataFrame) -> DataFrame:
    """host, shape, vote, paths, pages: what the pages of each host look like and vote for, added up before the shuffle."""
    return read.where("vote IS NOT NULL").groupBy("host", "shape", "vote").agg(
        F.count(F.lit(1)).alias("pages"), F.any_value("paths").alias("paths")
    )


def winning_paths(shapes: DataFrame) -> DataFrame:
    """host, path, votes: all paths that at least two pages and half of the host's pages that have them vote for."""
    on_paths = shapes.select("host", "vote", "pages", F.explode("paths").alias("path"))
    counted = on_paths.groupBy("host", "path").agg(
        F.sum("pages").alias("having"), F.sum(F.when(F.col("path") == F.col("vote"), F.col("pages")).otherwise(0)).alias("votes")
    )
    return counted.where("votes >= 2 AND 2 * votes >= having").select("host", "path", "votes")


def chosen_paths(shapes: DataFrame, winners: DataFrame) -> DataFrame:
    """host, shape, path: the winning path with the most votes that pages of a shape have; shapes without one have no row."""
    return (
        shapes.groupBy("host", "shape").agg(F.any_value("paths").alias("paths"))
        .select("host", "shape", F.explode("paths").alias("path")).join(winners, ["host", "path"])
        .groupBy("host", "shape").agg(F.max(F.struct("votes", "path")).alias("best")).select("host", "shape", F.col("best.path").alias("path"))
    )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``.

    NULL and empty pages have empty text, and so have pages that hold nothing but menus and the like; text without any
    markup is the whole text; a NULL url or one without a host belongs to the nameless host; repeated rows give equal
    rows; an empty table gives no rows; other columns are ignored.  A host may have any number of winning paths: they
    are joined by host and shape, never gathered, and Spark decides by measured size how.
    """
    store = Store(pages.sparkSession, "html")
    read = store.keep(read_pages(pages), "pages")
    shapes = store.keep(shapes_of(read), "shapes")
    chosen = store.keep(chosen_paths(shapes, winning_paths(shapes)), "chosen")
    rows = read.join(chosen, ["host", "shape"], "left").select("page_id", "url", "path", "vote", "paths", "ranges", "blocks")

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            columns = (rows[c].to_pylist() for c in ("path", "vote", "paths", "ranges", "blocks"))
            texts = ["" if own is None else _taken(b, dict(zip(p, r)), path, own) for path, own, p, r, b in zip(*columns)]
            yield pa.RecordBatch.from_arrays(
                [rows["page_id"], rows["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(taken, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
