"""Main text of web pages, without what a site repeats.

Each page is parsed into a tree. Every block element's subtree (tag, classes, children, text) is hashed, and Spark counts
per host on how many pages with different content the hash occurs. A subtree on `LEAST_PAGES` of them at least, and on
`LEAST_SHARE` of the host's pages with different content, is template and deleted; so is one of `MANY_WORDS` words or
more on `MANY_PAGES` of them, whatever its share (shorter ones, such as table cells, may recur by chance). Copies of one page count once, so that a page that a host
serves many times doesn't delete itself; paragraphs and headings inside an article are the article's and are kept.
Templates are cut out of the tree first; the lists are the back-up for what a site doesn't repeat word for word: elements
whose tag, role, class or id says that they aren't main text (menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles, reader comments) are dropped from what is left. What remains of the page's articles (else of its
main element, else of its body) is cut at block elements; white space becomes one space, blocks are joined by newlines.
`template_words` counts the words of each page that fell to the templates, `other_words` those that fell to the lists or
stand outside the page's articles.

The templates of all hosts are broadcast while they number `BROADCAST_TEMPLATES` at most, and joined beyond.
A host has at most (mean block elements of a page) x (1 / LEAST_SHARE + pages / MANY_PAGES) of them.

Defined results: null or empty html has the empty text; unclosed, misnested and cut-off markup is read as far as it goes;
a null url belongs to the empty host; rows that repeat each get a row; extra columns are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .url_filter import host_of

LEAST_PAGES, LEAST_SHARE, BROADCAST_TEMPLATES = 5, 0.2, 200_000
MANY_PAGES, MANY_WORDS = 1000, 5
# HTML's element names by role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot "
    "th thead tr ul".split()
)
DROP_TAGS = set(
    "head script style noscript template iframe object svg math canvas audio video nav footer aside form button select "
    "option textarea label fieldset dialog menu title".split()
)
DROP_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
DROP_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices notification alert popup modal overlay sidebar side menu nav navbar navigation breadcrumb "
    "breadcrumbs header masthead footer comment comments disqus reply replies share sharing social related recommended "
    "newsletter subscribe signup login pagination pager widget toolbar skip".split()
)
PARAGRAPHS = set("p h1 h2 h3 h4 h5 h6 pre blockquote li dd dt td th figcaption".split())
_CLOSES_P = BLOCK - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "summary"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_FENCE = {"ul", "ol", "dl", "table", "article", "section", "div", "body", "main", "blockquote"}


_CUT_TAG = re.compile(r"<[A-Za-z/!][^<>]*\Z")


class Node:
    __slots__ = ("tag", "names", "role", "children", "hash", "words")

    def __init__(self, tag: str, names: str = "", role: str = ""):
        self.tag, self.names, self.role = tag, names, role
        self.children: list = []
        self.hash = self.words = 0


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.stack = [self.root]

    def _close(self, tags: set[str], fence: set[str]) -> None:
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at].tag in tags:
                del self.stack[at:]
                return
            if self.stack[at].tag in fence:
                return

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSES_P:
            self._close({"p"}, _FENCE | {"td", "th", "li"})
        if tag in _SAME:
            self._close(_SAME[tag], {"ul", "ol", "dl", "table", "menu", "select"})
        if tag in ("html", "body") and any(n.tag == tag for n in self.stack):
            return
        named = dict(attrs)
        node = Node(tag, f"{named.get('class') or ''} {named.get('id') or ''}".strip().lower(), (named.get("role") or "").lower())
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack[-1].tag == tag:
            self.stack.pop()

    def handle_endtag(self, tag):
        fence = {"article", "body"} if tag not in ("html", "body", "article") else set()
        self._close({tag}, fence)

    def handle_data(self, data):
        self.stack[-1].children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(_CUT_TAG.sub("", html))
    builder.close()
    return builder.root


def _dropped(node: Node, in_article: bool) -> bool:
    if node.tag in DROP_TAGS or node.role in DROP_ROLES:
        return True
    if node.tag == "header":
        return not in_article
    if node.names and node.tag not in ("html", "body", "main"):
        words = DROP_WORDS.intersection(re.split(r"[^a-z0-9]+", node.names))
        if in_article:
            words -= {"header", "masthead"}
        return bool(words) and not (node.tag == "article" and "comment" not in node.names)
    return False


def _hashed(node: Node) -> None:
    """Subtree hashes and numbers of words, children first, without recursion."""
    todo = [(node, False)]
    while todo:
        at, done = todo.pop()
        kids = [c for c in at.children if not isinstance(c, str)]
        if not done and kids:
            todo.append((at, True))
            todo += [(c, False) for c in kids]
            continue
        parts = [at.tag, at.names]
        at.words = 0
        for c in at.children:
            if isinstance(c, str):
                own = c.split()
                at.words += len(own)
                parts.append(" ".join(own))
            else:
                at.words += c.words
                parts.append(f"\x00{c.hash}")
        digest = hashlib.blake2b("\x01".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest()
        at.hash = int.from_bytes(digest, "little", signed=True)


def elements(root: Node) -> dict[int, int]:
    """Hashes of the block subtrees that may be a template, with their numbers of words."""
    out, todo = {}, [(root, False)]
    while todo:
        node, in_article = todo.pop()
        if node.tag in BLOCK and node.tag not in ("html", "body") and not (in_article and node.tag in PARAGRAPHS):
            out[node.hash] = node.words
        inside = in_article or node.tag in ("article", "main")
        todo += [(c, inside) for c in node.children if not isinstance(c, str)]
    return out


def prune(root: Node, template: set[int]) -> int:
    """Cut the subtrees in `template` out of a hashed tree, outermost first; their number of words."""
    gone, todo = 0, [(root, False)]
    while todo:
        node, in_article = todo.pop()
        inside = in_article or node.tag in ("article", "main")
        for place, child in enumerate(node.children):
            if isinstance(child, str):
                continue
            if child.hash in template and child.tag in BLOCK and not (inside and child.tag in PARAGRAPHS):
                gone += child.words
                node.children[place] = Node("hr")  # a border between blocks stays
            else:
                todo.append((child, inside))
    return gone


def n_words(root: Node) -> int:
    """Words of all text in the tree but scripts, styles and the page's head."""
    n, todo = 0, [root]
    while todo:
        at = todo.pop()
        if isinstance(at, str):
            n += len(at.split())
        elif at.tag not in ("head", "script", "style"):
            todo += at.children
    return n


def blocks(root: Node) -> list[str]:
    """The blocks of text under the page's articles, else its main element, else all of it."""

    def find(tag: str) -> list[Node]:
        out, todo = [], [root]
        while todo:
            node = todo.pop()
            if node.tag == tag:
                out.append(node)
            elif node is root or not _dropped(node, False):
                todo += [c for c in reversed(node.children) if not isinstance(c, str)]
        return [n for n in out if not _dropped(n, False)]

    tops = find("article") or find("main")
    in_article = bool(tops)
    out: list[str] = []
    part: list[str] = []

    def flush():
        text = " ".join("".join(part).split())
        if text:
            out.append(text)
        part.clear()

    for top in tops or [root]:
        todo: list = [top]
        while todo:
            at = todo.pop()
            if at is None:
                flush()
            elif isinstance(at, str):
                part.append(at)
            elif at is not top and _dropped(at, in_article):
                if at.tag in BLOCK or at.names:
                    flush()
            elif at.tag == "br":
                part.append(" ")
            else:
                if at.tag in BLOCK:
                    flush()
                    todo.append(None)
                todo += reversed(at.children)
        flush()
    return out


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        host, own, content, long = [], [], [], []
        for h, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            root = parse(html or "")
            _hashed(root)
            found = elements(root)
            text = "\n".join(blocks(root))
            digest = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
            # the row without an element stands for the page
            host += [h] * (len(found) + 1)
            own += [*found, None]
            content += [digest] * (len(found) + 1)
            long += [*(n >= MANY_WORDS for n in found.values()), False]
        yield pa.RecordBatch.from_pydict(
            {"host": pa.array(host, pa.string()), "element": pa.array(own, pa.int64()), "content": pa.array(content, pa.int64()), "long": pa.array(long, pa.bool_())}
        )


def templates(
    pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, many_pages: int = MANY_PAGES
) -> DataFrame:
    """(host, element) of the subtrees that recur. `pages`: host, html."""
    found = pages.mapInArrow(_elements, "host string, element long, content long, long boolean").distinct()
    counted = found.groupBy("host", "element").agg(F.count(F.lit(1)).alias("n"), F.max("long").alias("long"))
    counted = cut(counted.where((F.col("n") >= least_pages) | F.col("element").isNull()))
    sizes = counted.where("element is null").select(F.col("host").alias("of"), F.col("n").alias("pages"))
    recurs = (F.col("n") >= F.col("pages") * least_share) | (F.col("long") & (F.col("n") >= many_pages))
    own = counted.where("element is not null").join(sizes, F.col("host").eqNullSafe(F.col("of")))
    return own.where((F.col("n") >= least_pages) & recurs).select("host", "element")


def extract_text(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_pages: int = LEAST_PAGES,
    least_share: float = LEAST_SHARE,
    many_pages: int = MANY_PAGES,
) -> DataFrame:
    """(id, url, text, n_chars, template_words, other_words) of every row of `pages`."""
    rows = pages.select(
        F.col(id_col).alias("id"),
        F.col(url_col).cast("string").alias("url"),
        F.col(html_col).cast("string").alias("html"),
        host_of(F.col(url_col).cast("string")).alias("host"),
    )
    found = templates(rows.select("host", "html"), least_pages, least_share, many_pages)
    some = found.limit(BROADCAST_TEMPLATES + 1).collect()
    by_host: dict[str, set[int]] = {}
    if len(some) > BROADCAST_TEMPLATES:
        own = found.groupBy("host").agg(F.collect_set("element").alias("template"))
        rows = rows.join(own, "host", "left")
    else:
        for r in some:
            by_host.setdefault(r["host"], set()).add(r["element"])
        rows = rows.withColumn("template", F.lit(None).cast("array<long>"))
    shared = pages.sparkSession.sparkContext.broadcast(by_host)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, cut_words, listed = [], [], []
            columns = (batch.column(c).to_pylist() for c in ("host", "html", "template"))
            for host, html, own in zip(*columns):
                root = parse(html or "")
                template = set(own) if own else shared.value.get(host, set())
                gone = 0
                if template:
                    _hashed(root)
                    gone = prune(root, template)
                out.append("\n".join(blocks(root)))
                cut_words.append(gone)
                listed.append(max(0, n_words(root) - len(out[-1].split())))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("url"),
                    pa.array(out, pa.string()),
                    pa.array([len(t) for t in out], pa.int64()),
                    pa.array(cut_words, pa.int64()),
                    pa.array(listed, pa.int64()),
                ],
                names=["id", "url", "text", "n_chars", "template_words", "other_words"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "url", "host", "html", "template").mapInArrow(
        texts, f"id {kind}, url string, text string, n_chars long, template_words long, other_words long"
    )
