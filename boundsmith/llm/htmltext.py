"""Main text of web pages by paths that the pages of a host agree on.

Pass one scores every container of a page by the text of its blocks, outside
links and boilerplate, and climbs from the best one to the containers around it
that hold more of the article: headings, paragraphs, sections, lists, tables.  The page
votes for the generalised path of what it reached: tags with their classes, digits
replaced.  Spark counts per host and path the pages that have it and those that vote
for it.  Of the paths in a page the one with the largest share of votes among the pages
that have it wins, whatever number of layouts the host has; the page's own vote wins a
tie.  Pass two extracts the element on the winning path that scores best in the page,
climbing likewise.

The text: character references are decoded, white space inside a block becomes
one space, blocks are trimmed and joined in page order by one space.

Defined cases: a null or empty page has the empty text; a null url, or one without
``://``, belongs to the host ``''``; unclosed tags end as browsers end them; rows
that repeat vote and are answered each; columns of other names don't matter; an
empty table gives an empty result.

Scale: only paths, as 64-bit hashes, and their counts are shuffled by host.  The
pages for which another path won than their own vote are few on hosts with a consensus;
they are joined to the pages by a digest of host and html, by broadcast where that table
is small and else by a shuffled join that adaptive execution splits.  Parsing a page
takes time in proportion to its length, however deep its elements are nested.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boundsmith.llm.common import mapped, written

#: Added to the pages that have a path, so that few votes count less.
DOUBT = 2.0
UP, SEMANTIC = 0.85, 1.25

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|textarea|svg|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-zA-Z][^>]*>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# HTML elements by their role.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CONTAINER = frozenset("article blockquote body center div main section table tbody td tr ul ol".split())
_DROP_TAGS = frozenset("aside audio button canvas dialog footer form head header menu nav object select video".split())
_DROP_ROLES = frozenset("banner complementary contentinfo dialog navigation search alert form".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PARTS = _HEADINGS | frozenset("blockquote dd figure li p pre".split())
_ENDS_P = _BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "summary", "body", "html"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
_NONE: frozenset[str] = frozenset()
_CELLS = frozenset(("td", "th"))
_TABLE = _CELLS | {"tr", "tbody", "thead", "tfoot", "table", "body", "html"}
#: A block ends an open paragraph, unless one of these stands between.
_P_SCOPE = frozenset(("td", "th", "li", "button", "article", "section", "blockquote", "body"))
_P_OWN = frozenset(("td", "th", "li", "button"))
# Words in class names and ids that mark boilerplate.
_ALWAYS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist cookie cookies "
    "consent disqus gdpr login modal newsletter notice notices notification pagination pager paywall popup promo promoted promotion "
    "recommended related replies reply respond share sharing signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
_UNLESS_MAIN = frozenset("aside footer header masthead menu meta nav navbar navigation sidebar sidenav topbar".split())
_MAIN = frozenset("article body content entry main post story text".split())


class Node:
    __slots__ = ("tag", "name", "parent", "kids", "drop", "main", "score", "text", "linked", "all", "links", "box", "inside", "parts", "headed", "digest")

    def __init__(self, tag: str, name: str, parent: Node | None, drop: bool, main: bool = False) -> None:
        self.tag, self.name, self.parent, self.drop, self.main = tag, name, parent, drop, main
        self.kids: list[Node | str] = []
        self.score = 0.0
        self.text = self.linked = 0  # without the containers inside
        self.all = self.links = 0
        self.box: Node | None = None  # the container around it
        self.inside: list[Node] = []  # a container's next containers
        self.parts = self.headed = False
        #: Of the path, without walking it: the parent's digest and the own name.
        self.digest = b"" if parent is None or tag == "html" else hashlib.blake2b(parent.digest + name.encode("utf-8", "surrogatepass"), digest_size=8).digest()

    @property
    def key(self) -> int:
        return int.from_bytes(self.digest, "little", signed=True)

    def path(self) -> str:
        names, at = [], self
        while at is not None and at.tag not in ("html", "#root"):
            names.append(at.name)
            at = at.parent
        return ">".join(reversed(names))


def _described(tag: str, attrs: str) -> tuple[str, bool, bool]:
    """Generalised name of an element, whether it is boilerplate, and whether it says that it is the article."""
    if not attrs.strip(" /\t\r\n"):
        return tag, tag in _DROP_TAGS, tag in ("article", "main")
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
    classes = sorted({re.sub(r"\d+", "#", c) for c in found.get("class", "").lower().split()})
    words = set(re.split(r"[^a-z]+", f"{found.get('class', '')} {found.get('id', '')}".lower()))
    drop = (
        tag in _DROP_TAGS
        or found.get("role", "").lower() in _DROP_ROLES
        or "hidden" in found
        or found.get("aria-hidden", "").lower() == "true"
        or "display:none" in found.get("style", "").replace(" ", "").lower()
        or (bool(words & _ALWAYS) and tag not in ("html", "body"))
        or (bool(words & _UNLESS_MAIN) and not words & _MAIN and tag not in ("html", "body", "article", "main"))
    )
    return ".".join([tag, *classes]), drop, tag in ("article", "main") or (bool(words & _MAIN) and tag not in ("html", "body"))


def parse(html: str) -> Node:
    """A tree of elements and decoded strings; raw elements and comments are left out."""
    root = Node("#root", "", None, False)
    stack = [root]
    places: dict[str, list[int]] = {}  # where in the stack the open elements of a tag are
    place = 0

    def close(tag: str, scope: frozenset[str]) -> None:
        """Ends the innermost open ``tag`` if no element of ``scope`` is open inside it."""
        held = places.get(tag)
        if held and not any(p[-1] > held[-1] for s in scope if s != tag and (p := places.get(s))):
            depth = held[-1]
            for node in stack[depth:]:
                places[node.tag].pop()
            del stack[depth:]

    for m in _TOKEN.finditer(html):
        if m.start() > place:
            stack[-1].kids.append(unescape(html[place : m.start()]))
        place = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["end"]:
            if tag not in _VOID:
                close(tag, _NONE if tag in _TABLE else _CELLS)
            elif tag == "br":
                stack[-1].kids.append(Node("br", "br", stack[-1], False))
            continue
        if tag in _ENDS_P:
            close("p", _P_SCOPE if tag != "p" else _P_OWN)
        for same in _SAME.get(tag, ()):
            close(same, _SCOPE[tag])
        attrs = m["attrs"] or ""
        name, drop, main = _described(tag, attrs)
        node = Node(tag, name, stack[-1], drop, main)
        stack[-1].kids.append(node)
        if tag not in _VOID and not attrs.endswith("/"):
            places.setdefault(tag, []).append(len(stack))
            stack.append(node)
    if place < len(html):
        stack[-1].kids.append(unescape(html[place:]))
    return root


def score(root: Node) -> list[Node]:
    """Scores every container; returns them in page order.

    A block's characters outside links count for the nearest container, and a part
    of a container's score for the one around it.
    """
    order: list[Node] = []
    stack: list[tuple[Node, bool]] = [(root, False)]
    after: list[Node] = []
    while stack:
        node, linked = stack.pop()
        after.append(node)
        box = node.box
        if node.tag in _CONTAINER or node is root:
            order.append(node)
            if box is not None:
                box.inside.append(node)
            box = node
        linked = linked or node.tag == "a"
        for kid in reversed(node.kids):
            if isinstance(kid, Node):
                if not kid.drop:
                    kid.box = box
                    stack.append((kid, linked))
            else:
                size = len(kid.strip())
                node.text += size
                node.linked += size if linked else 0
        node.all, node.links = node.text, node.linked
    for node in reversed(after):
        box = node.tag in _CONTAINER or node is root
        if box:
            node.score += max(0, node.text - 2 * node.linked)
            if node.tag in ("article", "main"):
                node.score *= SEMANTIC
        if node.all and node.tag in _PARTS:
            node.parts = True
            if node.tag in _HEADINGS:
                node.box.headed = True
        up = node.parent
        if up is not None:
            up.all += node.all
            up.links += node.links
            up.parts |= node.parts
            if box:
                up.score += UP * node.score
            else:
                up.text += node.text
                up.linked += node.linked
                up.score += node.score
    return order


def best(order: list[Node]) -> Node:
    return max(order, key=lambda n: n.score)  # the first of equal ones: the outermost


def climbed(node: Node) -> Node:
    """The outermost container around ``node`` up to which most text outside it is article text.

    Article text is a container's own text, if most of it isn't links, and the
    containers beside ``node`` that aren't mostly links; a ``div`` must hold
    paragraphs, headings or items, or stand in an element marked as the article.
    There, headings may be links.
    """
    top, below, at = node, node, node.box
    while at is not None:
        own = at.text > 2 * at.linked or (at.main and at.headed)
        more, other = (at.text, 0) if own else (0, at.text)
        for kid in at.inside:
            if kid is not below:
                if kid.all > 2 * kid.links and (kid.tag not in ("div", "center") or kid.parts or at.main):
                    more += kid.all
                else:
                    other += kid.all
        if more > other:
            top = at
        elif other:
            break
        below, at = at, at.box
    return top


def text_of(node: Node) -> str:
    blocks: list[str] = []
    part: list[str] = []

    def end() -> None:
        if part and (words := "".join(part).split()):
            blocks.append(" ".join(words))
        part.clear()

    stack: list[Node | str | None] = [node]
    while stack:
        item = stack.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            part.append(item)
        elif item is node or not item.drop:
            if item.tag in _BLOCK:
                end()
                stack.append(None)
            stack.extend(reversed(item.kids))
    end()
    return " ".join(blocks)


def vote(html: str | None) -> tuple[Node | None, list[Node]]:
    """The page's best container, climbed, and all that have text, the best first."""
    if not html:
        return None, []
    order = [n for n in score(parse(html)) if n.score > 0]
    if not order:
        return None, []
    return climbed(best(order)), sorted(order, key=lambda n: -n.score)


def extract(html: str | None, key: int | None = None) -> str:
    """The text of the best container on the path ``key``, or else of the best one; climbed."""
    if not html:
        return ""
    order = score(parse(html))
    top = best([n for n in order if n.score > 0 and n.key == key] or order)
    return text_of(climbed(top) if top.score > 0 else top)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^.*?://([^/?#]*)", 1))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col, url_col, text, n_chars`` for each row of ``pages``."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    host = host_of(F.col(url_col))
    # Pages with equal host and html are answered alike, so a digest of both names them.
    base = pages.select(F.col(id_col).alias("i"), F.col(url_col).alias("u"), html.alias("h"), host.alias("host"), F.unhex(F.md5(F.concat(host, F.lit("\n"), html))).alias("digest"))

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, keys = [], []
            for h in batch.column("h"):
                top, order = vote(h.as_py())
                own.append(top.key if top else None)
                keys.append(list(dict.fromkeys(n.key for n in order)))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("host"), pa.array(own, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["digest", "host", "vote", "keys"])

    seen, _ = written(mapped(base.select("digest", "host", "h"), votes, "digest binary, host string, vote long, keys array<long>").where("vote is not null"), "page-votes")
    every = seen.select("digest", "host", "vote", F.posexplode("keys").alias("at", "key"))
    counted = every.groupBy("host", "key").agg(F.count(F.lit(1)).alias("pages"), F.sum((F.col("key") == F.col("vote")).cast("long")).alias("votes")).where("votes > 0")
    share = F.struct((F.col("votes") / (F.col("pages") + DOUBT)).alias("share"), (F.col("key") == F.col("vote")).alias("own"), (-F.col("at")).alias("rank"), F.col("key"))
    decided = every.join(counted, ["host", "key"]).groupBy("digest", "vote").agg(F.max(share).alias("won"))
    other, _ = written(decided.where("won.key <> vote").select("digest", F.col("won.key").alias("key")), "page-paths")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract(h.as_py(), k.as_py()) for h, k in zip(batch.column("h"), batch.column("key"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("u"), pa.array(found, pa.string())], names=["i", "u", "t"])

    met = base.join(other, "digest", "left").select("i", "u", "h", "key")
    out = mapped(met, texts, f"i {met.schema['i'].dataType.simpleString()}, u string, t string")
    return out.select(F.col("i").alias(id_col), F.col("u").alias(url_col), F.col("t").alias("text"), F.length("t").cast("long").alias("n_chars"))
