"""Main text of web pages by consensus of each host's pages.

Each page scores its containers and votes for the path of the best one, a chain of tags and classes
in which numbers are blanked. Spark sums the votes by host. Each page is then extracted again, from
the container on its host's path with most votes that the page has, or from its own best container
if it has none of them.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, table

#: A path is used on a host if it has at least this share of the votes there.
MIN_VOTE_SHARE = 0.05

#: What text counts for the container around the one it is in.
_OUTER_SHARE = 0.75

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b""")
_NAMES = re.compile(r"[a-z]+")
_NUMBERS = re.compile(r"\d+")

_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label link mark meta q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br area base col embed param source track".split())
_VOID = frozenset("hr img input br wbr meta link area base col embed param source track".split())
_RAW = frozenset("script style noscript template iframe textarea title svg math object canvas audio video xmp noembed noframes".split())
#: Never part of an article.
_OUTSIDE = frozenset("nav aside footer form menu dialog button select fieldset search head datalist".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CONTAINERS = frozenset("body article main section div td".split())
#: An open element of these kinds ends when one of the same group begins, up to the enclosing element.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
_ENCLOSING = frozenset("ul ol dl table html body div article section main".split())
#: Words, and beginnings of words, in a class, id or role of what is not the article.
_OUTSIDE_WORDS = frozenset("ad ads adv nav menu aside share social related respond pager tags modal alert login signup toolbar skip widget widgets hidden contentinfo complementary search dialog form".split())
_OUTSIDE_STEMS = ("advert", "sponsor", "promo", "banner", "breadcrumb", "comment", "disqus", "cookie", "consent", "notice", "newsletter", "subscri", "sidebar", "navig", "navbar", "footer", "popup", "overlay", "recommend", "pagination", "masthead")
_ARTICLE_WORDS = frozenset("article content post entry story text body main".split())


class Node:
    __slots__ = ("tag", "path", "parent", "outside", "heading_only", "favour", "weight")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.parent, self.weight = tag, parent, 0.0
        names, classes, hidden = set(), "", False
        if attributes:
            for key, a, b, c, bare in _ATTRIBUTE.findall(attributes):
                key, value = key.lower(), (a or b or c).lower()
                if key in ("class", "id", "role"):
                    names.update(_NAMES.findall(value))
                    if key == "class":
                        classes = "".join("." + x for x in sorted({_NUMBERS.sub("#", x) for x in value.split()}))
                hidden |= bool(bare) or key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", "")
        own = tag in _OUTSIDE or hidden
        if not own and names and tag not in ("html", "body", "main", "article"):
            own = not names.isdisjoint(_OUTSIDE_WORDS) or any(x.startswith(_OUTSIDE_STEMS) for x in names)
        self.outside = own or parent is not None and parent.outside
        self.heading_only = tag == "header" or "header" in names or parent is not None and parent.heading_only
        self.favour = 2.0 if tag == "article" else 1.5 if tag == "main" or not names.isdisjoint(_ARTICLE_WORDS) else 1.0
        self.path = (parent.path + ">" if parent else "") + tag + classes


def parse(page: str) -> list[tuple[Node, str, int]]:
    """Blocks of text in page order: element, text with single spaces, characters in links."""
    root = Node("html", "", None)
    stack, blocks, text = [root, Node("body", "", root)], [], []
    linked = in_link = position = 0

    def flush():
        nonlocal linked
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            if joined:
                blocks.append((stack[-1], joined, min(linked, len(joined))))
            text.clear()
            linked = 0

    for match in iter(lambda: _TAG.search(page, position), None):
        if match.start() > position:
            text.append(page[position : match.start()])
            linked += in_link and match.start() - position
        position = match.end()
        closing, tag, attributes = match.group(1, 2, 3) if match.group(2) else match.group(4, 5, 6)
        if not tag:
            continue
        tag = tag.lower()
        if tag in _INLINE:
            if tag == "a":
                in_link = not closing
            elif tag == "br":
                text.append(" ")
            continue
        if tag in _RAW:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, position)
                position = end.end() if end else len(page)
            if tag not in ("script", "style", "template", "noscript"):
                text.append(" ")
            continue
        flush()
        in_link = 0
        if closing:
            for k in range(len(stack) - 1, 1, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in ("html", "head"):
            continue
        if stack[-1].tag == "p" or tag in _HEADINGS and stack[-1].tag in _HEADINGS:
            stack.pop()
        if tag in _ENDS:
            for k in range(len(stack) - 1, 1, -1):
                if stack[k].tag in _ENDS[tag]:
                    del stack[k:]
                elif stack[k].tag in _ENCLOSING:
                    break
        elif tag == "body":
            stack = [root]
        if tag not in _VOID:
            stack.append(Node(tag, attributes, stack[-1]))
            if attributes.endswith("/") and tag not in ("p", "div"):
                stack.pop()
    text.append(page[position:])
    flush()
    return blocks


def in_article(node: Node) -> bool:
    return not node.outside and (not node.heading_only or node.tag in _HEADINGS)


def ancestors(node: Node | None):
    """The element and all that it is in."""
    while node:
        yield node
        node = node.parent


def best_container(blocks: list[tuple[Node, str, int]]) -> Node | None:
    """The container that holds most running text. What is in a container counts for those around it
    too, the less the farther out they are."""
    for node, text, linked in blocks:
        if node.outside:
            continue
        prose = len(text) >= 60 or text[-1] in ".!?…\"'”»"
        weight = (len(text) - linked) * (1.0 if prose and linked * 2 < len(text) else 0.1)
        for n in ancestors(node):
            n.weight += weight
            if n.tag in _CONTAINERS:
                weight *= _OUTER_SHARE
    best, score, seen = None, 0.0, set()
    for block in blocks:
        for node in ancestors(block[0]):
            if node in seen:
                break
            seen.add(node)
            if node.tag in _CONTAINERS and not node.outside and node.weight > 0:
                if node.weight * node.favour > score:
                    best, score = node, node.weight * node.favour
    return best


def extract(page: str | None, paths: list[str]) -> str:
    """Blocks of the article, joined by line feeds; empty if there are none."""
    blocks = parse(page or "")
    own = best_container(blocks)
    if own is None and not any(in_article(node) for node, _, _ in blocks):
        return ""
    chosen = own
    on_path: dict[str, list[Node]] = {path: [] for path in paths}
    for node, _, _ in blocks:
        for n in ancestors(node):
            if n.path in on_path and n.weight > 0 and not n.outside:
                on_path[n.path].append(n)
    for path in paths:
        if on_path[path]:
            chosen = max(on_path[path], key=lambda n: n.weight)
            break
    return "\n".join(text for node, text, _ in blocks if in_article(node) and (chosen is None or any(n is chosen for n in ancestors(node))))


def _votes(batches):
    for batch in batches:
        for part in slices(batch, 1):
            found = [best_container(parse(page)) if page else None for page in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n and n.path for n in found], pa.string())], ["host", "path"])


def _texts(batches):
    for batch in batches:
        for part in slices(batch, 1):
            texts = [extract(page, paths or []) for page, paths in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["row", "text"])


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_paths(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """host and paths (by falling votes; of equal ones the first in order) of each host."""
    rows = pages.select(host_of(F.col(f"`{url}`")).alias("host"), F.col(f"`{page}`").cast("string").alias("html"))
    votes = rows.mapInArrow(_votes, "host string, path string").filter("path IS NOT NULL").groupBy("host", "path").count()
    all_votes = votes.groupBy("host").agg(F.sum("count").alias("all"))
    winners = votes.join(all_votes, "host").filter(F.col("count") >= MIN_VOTE_SHARE * F.col("all"))
    # At most 1 / MIN_VOTE_SHARE paths a host.
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "path")))
    return winners.groupBy("host").agg(F.transform(ranked, lambda x: x["path"]).alias("paths"))


def main_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), url: str = "url", page: str = "html") -> DataFrame:
    """Kept columns and text of each page; no text is the empty string.

    A null page or URL counts as empty; pages without a host vote together. Repeated rows vote and
    are extracted each. Extra columns are ignored unless kept.
    """
    # Written, so that Spark knows its size and joins by broadcast only if it is small.
    paths = stored(host_paths(pages, url, page), "host-paths").withColumnRenamed("host", "path_host")
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{page}`").cast("string").alias("html"), host_of(F.col(f"`{url}`")).alias("host"))
    joined = rows.join(paths, F.col("host") == F.col("path_host"), "left").select("row", "html", "paths")
    schema = rows.select("row", F.lit("").alias("text")).schema
    return joined.mapInArrow(_texts, schema).select(*[F.col("row").getField(c).alias(c) for c in keep], "text")


def query(spark, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
