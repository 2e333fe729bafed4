"""HTML extraction: the main text of a page, without its site's template.

A page is parsed into a tree of elements. Every element subtree is hashed twice: as it is, and as a shape (tags, classes and roles, with
text masked and equal neighbours as one). Spark counts for each host how many distinct pages have each hash; a page's copies
count once. Subtrees that recur on many pages of their host are deleted: equal ones wherever they stand, and outside the
running text also those of a recurring shape that holds, on the average, only a small part of a page's text, which is
what menus, notices, adverts and footers are when their words differ from page to page.

What is left by then and is named as furniture by its tag, role or class (navigation, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, reader comments) goes too; on hosts with few pages this is all there is to go by. The rest of
the main element (article, main, or the element that holds most of the text) is split into blocks of text.

Inside the main element a heading, paragraph, list or table is the author's even if it is on many pages, unless it
recurs on nearly all of a large host.

Defined results: a null html has no text. A null url, or one without a host, is a host of its own. Unclosed elements end with
their parent, unknown end tags are skipped, truncated pages end where they end. Repeated rows give the same row again.
Extra columns are not carried. No rows in, no rows out.
"""

from __future__ import annotations

import html
import re
from collections.abc import Collection, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import few_rows, save

#: A subtree recurs if so many distinct pages of its host have it, and so large a share of them.
MIN_PAGES = 4
MIN_SHARE = 0.2
#: The same for subtrees of running text inside the main element.
TEXT_MIN_PAGES = 12
TEXT_MIN_SHARE = 0.8

#: The same for shapes, and the part of a page's text that they may hold.
SHAPE_MIN_PAGES = 4
SHAPE_MIN_SHARE = 0.5
SHAPE_MAX_TEXT = 0.35
#: An element with so much of its text in links is a menu whatever its tag.
LINKS = 0.6

#: A template table of so many digests (about 20 MB) is broadcast, and pages aren't moved at all; a larger one is joined by host and salt.
BROADCAST_DIGESTS = 400_000
SALTS = 16

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: A start tag of the second kind ends an open one of the first.
CLOSED_BY = {
    "p": BLOCKS,
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option", "optgroup"]),
    "head": frozenset(["body"]),
}
# Furniture by tag, by role, and by the words of class and id.
DROP_TAGS = frozenset("nav header footer aside form script style noscript template iframe svg math object head button select input textarea dialog menu audio video canvas".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside rail widget widgets footer masthead topbar toolbar "
    "comment comments discussion disqus respond replies reply share sharing social related recommended newsletter subscribe subscription signup login search pagination pager skip".split()
)
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl li dt dd table thead tbody tr td th blockquote pre figure figcaption b i em strong span a code br".split())

PARTS = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS = re.compile(r"[a-z]+")
#: Names of classes and roles in a shape; numbers in them differ from page to page.
CLASSES = re.compile(rb"(?:class|role)\s*=\s*[\"']?([a-z][a-z _-]*)")
SPACES = re.compile(r"\s+")
HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


class Node:
    __slots__ = ("tag", "attrs", "children", "digest", "shape", "size", "total", "links", "dropped")

    def __init__(self, tag: str, attrs: str):
        self.tag, self.attrs = tag, attrs
        self.children: list[Node | str] = []
        self.digest = self.shape = b""
        #: Characters of text: outside furniture, all, and in links.
        self.size = self.total = self.links = 0
        self.dropped = False


def parse(page: str) -> Node:
    """A tree of elements and decoded text; comments and declarations go."""
    root = Node("", "")
    stack = [root]
    at, n = 0, len(page)
    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            begin = n
        if begin > at:
            stack[-1].children.append(html.unescape(page[at:begin]))
        if begin >= n:
            break
        found = PARTS.match(page, begin)
        if found is None:
            stack[-1].children.append("<")
            at = begin + 1
            continue
        at = found.end()
        name = found[2]
        if name is None:
            if found[0].startswith("<![CDATA["):
                stack[-1].children.append(found[0][9:].removesuffix("]]>"))
            continue
        tag = name.lower()
        if found[1]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            # An end tag of an inline element doesn't end the blocks around it.
            if depth and (tag in BLOCKS or not any(x.tag in BLOCKS for x in stack[depth + 1 :])):
                del stack[depth:]
            elif tag == "br":
                stack[-1].children.append(Node("br", ""))
            continue
        while len(stack) > 1 and tag in CLOSED_BY.get(_open_block(stack), ()):
            _close(stack, _open_block(stack))
        node = Node(tag, found[3] or "")
        stack[-1].children.append(node)
        if tag in VOID or (found[3] or "").endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW and tag not in ("title", "textarea", "noscript"):
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|$)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        stack.append(node)
    return root


def _open_block(stack: list[Node]) -> str:
    """The innermost open element, seen through inline ones."""
    for node in reversed(stack):
        if node.tag in CLOSED_BY or node.tag in BLOCKS or not node.tag:
            return node.tag
    return ""


def _close(stack: list[Node], tag: str) -> None:
    while len(stack) > 1:
        if stack.pop().tag == tag:
            return


def furniture(node: Node) -> bool:
    if node.tag in DROP_TAGS:
        return True
    if not node.attrs:
        return False
    for name, *values in ATTRIBUTE.findall(node.attrs):
        name = name.lower()
        value = next((v for v in values if v), "").lower()
        if name in ("class", "id") and node.tag not in ("html", "body", "article", "main") and any(set(WORDS.findall(x)) & DROP_WORDS for x in value.split()):
            return True
        if name == "role" and value in DROP_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def prepare(root: Node) -> None:
    """Hashes and text sizes of every subtree, from the leaves up, and what is furniture; no recursion, for deep pages."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [x for x in node.children if isinstance(x, Node)]
    for node in reversed(order):
        name = node.tag.encode("utf-8", "surrogatepass")
        exact, shape = [name], [name, b" ".join(sorted(CLASSES.findall(node.attrs.lower().encode("utf-8", "surrogatepass"))))]
        node.dropped = furniture(node)
        for x in node.children:
            if isinstance(x, Node):
                exact.append(b"\1" + x.digest)
                if shape[-1] != x.shape:
                    shape.append(x.shape)
                node.size += 0 if x.dropped else x.size
                node.total += x.total
                node.links += x.total if x.tag == "a" else x.links
            elif text := SPACES.sub(" ", x).strip():
                exact.append(b"\2" + text.encode("utf-8", "surrogatepass"))
                if shape[-1] != b"\2":
                    shape.append(b"\2")
                node.size += len(text)
                node.total += len(text)
        node.digest = xxhash.xxh3_128_digest(b"\0".join(exact))
        node.shape = xxhash.xxh3_128_digest(b"\0".join(shape))


def main_of(root: Node) -> Node:
    """The article or main element with most text, or their parent if its articles hold more together; without any, the page."""
    best, todo, parents = None, [(root, root)], {}
    while todo:
        node, parent = todo.pop()
        if node.dropped:
            continue
        role = 'role="main"' in node.attrs or "role=main" in node.attrs or 'itemprop="articleBody"' in node.attrs
        if node.tag in ("article", "main") or role:
            # A main element with much text outside its articles is the better one.
            held = sum(x.size for x in node.children if isinstance(x, Node) and x.tag == "article" and not x.dropped)
            rank = (node.tag == "article" or held < 0.5 * node.size, node.size)
            if node.tag == "article":
                parents.setdefault(id(parent), (parent, []))[1].append(node)
            if best is None or rank > best[0]:
                best = (rank, node)
        todo += [(x, node) for x in node.children if isinstance(x, Node)]
    if best is None:
        return root
    # A story in several articles side by side, none of which is most of it.
    for parent, parts in parents.values():
        sizes = [x.size for x in parts]
        if len(parts) > 1 and parent is not root and best[1] in parts and max(sizes) < 0.6 * sum(sizes) and sum(sizes) > 0.8 * parent.size:
            return parent
    return best[1]


def content_of(root: Node) -> Node:
    """Where running text is taken for the author's: the main element, or the deepest element that holds most of the page."""
    node = main_of(root)
    if node is not root:
        return node
    while True:
        inner = max((x for x in node.children if isinstance(x, Node) and not x.dropped and x.tag in ("html", "body", "div", "section", "td", "table", "tbody", "tr", "center")), key=lambda x: x.size, default=None)
        if inner is None or inner.size < 0.6 * node.size or not inner.size:
            return node
        node = inner


#: How a subtree is counted: as it is, as it is inside running text, by its shape.
EQUAL, RUNNING_EQUAL, SHAPE = 0, 1, 2


def _may_go_by_shape(node: Node) -> bool:
    return node.tag not in RUNNING or node.links >= LINKS * node.total


def _path(root: Node, inner: Node) -> set[int]:
    """The elements that hold inner, and itself."""
    above, todo = {id(root): None}, [root]
    while todo:
        node = todo.pop()
        if node is inner:
            break
        for x in node.children:
            if isinstance(x, Node):
                above[id(x)] = node
                todo.append(x)
    found, node = set(), inner
    while node is not None:
        found.add(id(node))
        node = above[id(node)]
    return found


def subtrees(root: Node) -> dict[tuple[bytes, int], int]:
    """(digest, kind) of each subtree with text, but for those that hold the content, and the characters of all that are equal in this."""
    content = content_of(root)
    holds = _path(root, main_of(root)) | _path(root, content)
    found: dict[tuple[bytes, int], int] = {}
    todo = [(root, root is content)]
    while todo:
        node, inside = todo.pop()
        for x in node.children:
            if isinstance(x, Node) and x.total and x.tag != "br":
                if id(x) not in holds:
                    key = (x.digest, RUNNING_EQUAL if inside and x.tag in RUNNING else EQUAL)
                    found[key] = found.get(key, 0) + x.total
                    if not inside and _may_go_by_shape(x):
                        found[x.shape, SHAPE] = found.get((x.shape, SHAPE), 0) + x.total
                todo.append((x, inside or x is content))
    return found


def text_of(root: Node, template: Collection[bytes], in_text: Collection[bytes], shapes: Collection[bytes] = (), lists: bool = True) -> str:
    """The text left on a page. lists: whether furniture goes by its names and only the main element counts, beside what recurs."""
    content = content_of(root)
    main = main_of(root) if lists else root
    holds = _path(root, main_of(root)) | _path(root, content) if shapes or template else {id(main), id(content)}
    out: list[list[str]] = [[]]
    # Work items: a node to open with whether it lies in the content, text, or a mark that a block ends.
    todo: list[tuple[Node, bool] | str | None] = [(main, main is content)]
    while todo:
        item = todo.pop()
        if item is None:
            out.append([])
            continue
        if isinstance(item, str):
            out[-1].append(item)
            continue
        x, inside = item
        if x.tag == "br":
            out[-1].append(" ")
            continue
        if id(x) not in holds:
            if x.digest in (in_text if inside and x.tag in RUNNING else template) or not inside and x.shape in shapes and _may_go_by_shape(x):
                continue
            if lists and x.dropped and x is not main:
                continue
        inside = inside or x is content
        if x.tag in BLOCKS:
            out.append([])
            todo.append(None)
        todo += [y if isinstance(y, str) else (y, inside) for y in reversed(x.children)]
    blocks = (SPACES.sub(" ", "".join(parts)).strip() for parts in out)
    return "\n".join(b for b in blocks if b)


def host_of(url: str | None) -> str | None:
    found = HOST.match(url or "")
    return found[1].lower() if found else None


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in few_rows(batches, 500):
        hosts, pages, digests, kinds, shares = [], [], [], [], []
        for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            root = parse(page or "")
            prepare(root)
            own = subtrees(root)
            n = len(own) + 1
            hosts += [host_of(url)] * n
            pages += [root.digest] * n
            digests += [b"", *(d for d, _ in own)]
            kinds += [EQUAL, *(k for _, k in own)]
            shares += [0.0, *(size / root.total for size in own.values())]
        columns = [pa.array(x, k) for x, k in zip((hosts, pages, digests, kinds, shares), (pa.string(), pa.binary(), pa.binary(), pa.int32(), pa.float64()), strict=True)]
        yield pa.RecordBatch.from_arrays(columns, ["host", "page", "digest", "kind", "share"])


def _extract(lists: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches, 500):
            ids, urls, pages, found = (batch.column(n).to_pylist() for n in ("page_id", "url", "html", "template"))
            texts = []
            for page, own in zip(pages, found, strict=True):
                root = parse(page or "")
                prepare(root)
                texts.append(text_of(root, *({x["digest"] for x in own or () if x["kind"] == kind} for kind in (EQUAL, RUNNING_EQUAL, SHAPE)), lists))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def recurring(source: DataFrame) -> DataFrame:
    """(host, digest, kind): what goes on all pages of a host. A page with the same elements counts once, with partial counts before the shuffle."""
    seen = source.select("url", "html").mapInArrow(_subtrees, "host string, page binary, digest binary, kind int, share double")
    seen = seen.groupBy("host", "digest", "kind", "page").agg(F.max("share").alias("share"))
    counts = seen.groupBy("host", "digest", "kind").agg(F.count("*").alias("n"), F.avg("share").alias("share"))
    total = counts.filter("digest = X''").select(F.col("host").alias("_host"), F.col("n").alias("total"))
    often = counts.filter(F.col("digest") != F.lit(b"")).filter(f"n >= {min(MIN_PAGES, SHAPE_MIN_PAGES)}").join(total, F.col("host").eqNullSafe(F.col("_host")))
    enough = lambda pages, share: (F.col("n") >= pages) & (F.col("n") >= share * F.col("total"))
    rule = F.when(F.col("kind") == RUNNING_EQUAL, enough(TEXT_MIN_PAGES, TEXT_MIN_SHARE)).when(F.col("kind") == SHAPE, enough(SHAPE_MIN_PAGES, SHAPE_MIN_SHARE) & (F.col("share") <= SHAPE_MAX_TEXT))
    return often.filter(rule.otherwise(enough(MIN_PAGES, MIN_SHARE))).select("host", "digest", "kind")


def main_texts(pages: DataFrame, lists: bool = True) -> DataFrame:
    """page_id, url, text, n_chars of each page. lists: see text_of.

    A host's recurring subtrees reach its pages by a broadcast or, where there are many, by host and salt, so a hot host is not gathered anywhere.
    """
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    often = save(pages.sparkSession, recurring(source), "template")
    template = often.groupBy("host").agg(F.collect_list(F.struct("digest", "kind")).alias("template"))
    template = template.select(F.col("host").alias("_host"), "template")
    if often.count() <= BROADCAST_DIGESTS:
        template = F.broadcast(template)
    else:
        # Each host's pages are dealt to several tasks, each with a copy of what the host's template holds.
        template = template.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        source = source.withColumn("_deal", F.pmod(F.xxhash64("page_id", F.length("html")), F.lit(SALTS)).cast("int"))
    host = F.lower(F.nullif(F.regexp_extract("url", HOST.pattern, 1), F.lit("")))
    same = host.eqNullSafe(F.col("_host"))
    joined = source.join(template, same & (F.col("_deal") == F.col("_salt")) if "_salt" in template.columns else same, "left").select("page_id", "url", "html", "template")
    return joined.mapInArrow(_extract(lists), "page_id long, url string, text string, n_chars long")
