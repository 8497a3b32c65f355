"""Main-text extraction with site style trees.

Every page is parsed into blocks: stretches of text under style nodes.  A style
node is a path of labels (tag and first class name) from the root; the pages of a
host are merged into one tree, and each node is judged by all different pages
of the host that have it:

* presentation importance: the entropy of the node's style (the sequence of its
  children's labels) over the pages, as a share of the largest entropy so many
  pages can have, or, if that is more, the node's share of the host's varied text.
  A banner looks the same on every page; the part that holds articles does not.
* content importance: 1 minus the mean entropy of the node's contents over the
  pages (1 if every page says something else, 0 if all say the same), less the
  share of its text that is nothing but links.

Both are drawn to those of the same path over all hosts, and these to 1, with
the weight of ``PRIOR`` pages, so few pages decide little and there is no number of
pages below which a host is not judged.  A block stays if its own node's content
importance is at least ``LOW`` and so is the presentation importance of its node or
of a node above it (but the body, which is above everything); single texts that
``REPEATED`` of the host's different pages have at a node go.  Within an ``article``
or ``main`` element, which the HTML standard says is the content, presentation is not
asked.  What no tree can see is declared: elements that the standard gives another
role (navigation, footers, forms ...) and the few names of ``DECLARED`` (readers'
comments vary as articles do).

Pages whose weightiest nodes (those that hold ``WEIGHTY`` of the page's text) say
the same count once, so an article that is copied from page to page is not taken
for boilerplate.

Distribution: parsing is a narrow map; the tree is a grouped count of
(host, node, item) hashes, combined before the exchange, so a host with a third
of all pages is no hot spot.  Parsing takes time in proportion to the page,
however deeply it is nested.  Low nodes and texts are broadcast while there are at
most ``HELD`` of them; beyond, they are joined to pages as hashes.

Defined cases: null or empty html gives empty text; a page without any block of
its own gives empty text; a null url is a host of its own; repeated rows give
repeated results; an empty table gives an empty table; further columns are
ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import keep, table

# Fixed values of the HTML standard: elements without content, raw text, blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes svg math canvas object".split())
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: A new one of these ends an open paragraph; a new item ends an open item of its kind.
ENDS_P = BLOCKS - {"br", "body", "html", "head", "option", "optgroup", "tbody", "tr", "td", "th", "thead", "tfoot"}
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
NOISE_TAGS = frozenset("nav header footer aside form button select menu dialog label input option datalist map audio video head fieldset legend".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog toolbar".split())
#: Names of what the tree cannot tell from articles, or cannot judge on a host of few pages.
DECLARED = re.compile(r"(?:^|[-_])(?:ads?|adverts?|advertisement|sponsor(?:ed)?|comments?|commentlist|disqus|sidebar|cookies?|newsletter|breadcrumbs?|navbar|popup|share|sharing|related)(?:$|[-_])")
MAIN_TAGS = frozenset(("article", "main"))
BARRIERS = frozenset(("div", "article", "section", "main", "td", "body"))
LISTS = frozenset(("ul", "ol", "dl", "table", "select", "div", "article", "section", "body"))
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SPACE = re.compile(r"\s+")

LOW = 0.3  # importance below which a style node is removed
PRIOR = 4  # pages that what is known beforehand counts for
REPEATED = 0.5  # share of a host's different pages that makes a text at a node boilerplate
WEIGHTY = 0.9  # share of a page's text that it is known by
HELD = 2**18  # low nodes and texts that may be broadcast


def _hash(*parts: str) -> int:
    v = xxhash.xxh64_intdigest("\x1f".join(parts).encode("utf-8", "surrogatepass"))
    return v - (1 << 64) if v >= 1 << 63 else v


class Node:
    """An open element.  ``path`` is its style node's hash; ``block`` the nearest block element, itself included."""

    __slots__ = ("tag", "path", "noise", "noise_block", "main", "link", "block", "alive", "children")

    def __init__(self, tag: str, path: int, above: Node | None):
        self.tag, self.path, self.children = tag, path, []
        self.noise = self.noise_block = self.main = self.link = self.alive = False
        self.block = self
        if above is not None:
            self.noise, self.noise_block, self.main, self.link, self.alive, self.block = above.noise, above.noise_block, above.main, above.link, above.alive, above.block


class Block:
    __slots__ = ("node", "path", "text", "noise", "main", "linked", "alive")

    def __init__(self, node: Node, text: str, noise: bool, main: bool, linked: bool, alive: bool):
        self.node, self.path, self.text, self.noise, self.main, self.linked, self.alive = node, node.path, text, noise, main, linked, alive


def _declared(tag: str, attributes: dict[str, str], inside_main: bool) -> bool:
    """What an element's tag, role and names declare to be beside the content."""
    if tag in NOISE_TAGS and not (tag == "header" and inside_main):
        return True
    if attributes.get("role", "").lower() in NOISE_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "")):
        return True
    named = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split()
    return any(DECLARED.search(n) for n in named)


def parse(page: str, low: frozenset | set = frozenset(), at_host: str = "") -> tuple[list[Block], list[Node]]:
    """The text blocks of a page, in order, and its block elements; ``low`` holds presentation hashes of low nodes."""
    out: list[Block] = []
    nodes: list[Node] = []
    held: list[str] = []
    top = Node("", 0, None)
    stack = [top]
    open_tags: Counter = Counter()
    plain = 0  # characters of the current block outside links

    def flush() -> None:
        nonlocal plain
        text = SPACE.sub(" ", entities.unescape("".join(held))).strip() if held else ""
        if text:
            last = stack[-1]
            block = last.block
            block.children.append("#")
            alive = block.alive or (block.tag in ("", "body", "html") and _hash(at_host, "p", str(block.path)) not in low)
            out.append(Block(block, text, block.noise or last.noise, last.main, not plain, alive or last.main))
        held.clear()
        plain = 0

    def close(upto: int) -> None:
        while len(stack) > upto:
            if stack[-1].tag in BLOCKS:
                flush()
            open_tags[stack.pop().tag] -= 1

    def find(tag: str, barriers: frozenset) -> int:
        """Where the nearest open ``tag`` stands, 0 if none or one of ``barriers`` is nearer."""
        if not open_tags[tag]:
            return 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == tag:
                return i
            if stack[i].tag in barriers:
                return 0
        return 0

    def write(text: str) -> None:
        nonlocal plain
        last = stack[-1]
        if last.noise and not last.noise_block:
            return  # an inline element that is declared to be beside the content
        held.append(text)
        if not last.link and not text.isspace():
            plain += 1

    at, size = 0, len(page)
    while at < size:
        found = page.find("<", at)
        if found < 0:
            write(page[at:])
            break
        if found > at:
            write(page[at:found])
        m = TOKEN.match(page, found)
        if m is None:
            write("<")
            at = found + 1
            continue
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "p" and not open_tags["p"]:
                flush()
                continue
            depth = find(tag, frozenset() if tag in BLOCKS else BARRIERS)
            if depth:
                close(depth)
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in BLOCKS:
            if tag in ENDS_P and (depth := find("p", BARRIERS - {"body"})):
                close(depth)
            wanted = SIBLINGS.get(tag, ())
            if any(open_tags[w] for w in wanted):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in wanted:
                        close(i)
                        break
                    if stack[i].tag in LISTS:
                        break
            flush()
        if tag in VOID:
            continue
        attributes = {k.lower(): entities.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(m[3])} if m[3] else {}
        above = stack[-1]
        label = tag
        if tag in BLOCKS:
            name = attributes.get("class", "").split()
            label = f"{tag}.{name[0]}" if name else tag
        node = Node(tag, above.path, above)
        node.main = above.main or tag in MAIN_TAGS or attributes.get("role") == "main"
        declared = _declared(tag, attributes, node.main)
        node.noise = above.noise or declared
        node.link = above.link or tag == "a"
        if tag in BLOCKS:
            above.block.children.append(label)
            node.path, node.block, node.noise_block = _hash(str(above.path), label), node, node.noise
            node.alive = above.alive or (tag not in ("html", "body") and _hash(at_host, "p", str(node.path)) not in low)
            nodes.append(node)
        stack.append(node)
        open_tags[tag] += 1
    close(1)
    flush()
    return out, [top, *nodes]


def host(url: str | None) -> str:
    m = re.match(r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def low_hash(at_host: str, kind: str, path: int, text: str | None = None) -> int:
    """Name of a node's presentation ("p") or content ("c"), or of one text at it ("t"), in the set of what is low."""
    return _hash(at_host, kind, str(path)) if text is None else _hash(at_host, kind, str(path), text)


def main_text(page: str, low: frozenset | set, url: str | None) -> str:
    """The page's text less declared and low branches; only what ``article`` or ``main`` holds, where something of it is left."""
    at = host(url)
    found, _ = parse(page, low, at)
    kept = [b for b in found if not b.noise]
    if low:
        kept = [b for b in kept if b.alive and low_hash(at, "c", b.path) not in low and low_hash(at, "t", b.path, b.text) not in low]
    main = [b for b in kept if b.main]
    return "\n".join(b.text for b in main or [b for b in kept if not b.linked])


def _asked(page: str, url: str | None) -> set[int]:
    """All hashes that ``main_text`` may look up for a page."""
    at = host(url)
    found, nodes = parse(page)
    out = {low_hash(at, "p", n.path) for n in nodes}
    for b in found:
        out.add(low_hash(at, "c", b.path))
        out.add(low_hash(at, "t", b.path, b.text))
    return out


FEATURES = "host long, node long, said long, path long, item long, content boolean, mark long, size long, linked boolean"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page: each undeclared style node's style, and each text at a node.

    ``node``, ``said``: the presentation and the content name of a style node at its host; ``path``: the node
    at any host; ``item``: the style, or the text's name; ``mark``: what the page's
    weightiest nodes say.
    """
    names = [f.split()[0] for f in FEATURES.split(", ")]
    for batch in batches:
        rows: list[tuple] = []
        for url, page in zip(batch.column(0), batch.column(1), strict=True):
            at = host(url.as_py())
            found, nodes = parse(page.as_py() or "")
            found = [b for b in found if not b.noise]
            styles: dict[int, list[str]] = {}
            for n in nodes:
                if not n.noise:
                    styles.setdefault(n.path, []).extend(["<", *n.children])
            sizes: Counter = Counter()
            said: dict[int, int] = {}
            for b in found:
                sizes[b.path] += len(b.text)
                said[b.path] = said.get(b.path, 0) ^ _hash(str(b.path), b.text)
            mark, left = 0, WEIGHTY * sizes.total()
            for path, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
                if left > 0:
                    mark ^= said[path]
                left -= n
            own = _hash(at)
            for path, style in styles.items():
                rows.append((own, low_hash(at, "p", path), low_hash(at, "c", path), path, _hash(*style), False, mark, sizes[path], False))
            for b in found:
                rows.append((own, low_hash(at, "p", b.path), low_hash(at, "c", b.path), b.path, low_hash(at, "t", b.path, b.text), True, mark, len(b.text), b.linked))
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.int64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _drawn(own, weight, to):
    """``own`` drawn to ``to`` with the weight of PRIOR pages."""
    return (weight * own + PRIOR * to) / (weight + PRIOR)


def importances(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """(host, node, said, path, m, presentation, content) per style node, and (node, item, n, m) per text at a node.

    ``m`` counts the pages that differ in their mark or in the node's style.
    """
    rows = pages.select(F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    names = ["host", "node", "said", "path", "item", "content"]
    seen = rows.mapInArrow(_features, FEATURES).groupBy(*names, "mark").agg(F.max("size").alias("size"), F.max("linked").alias("linked"))
    each = keep(seen.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.sum(F.when(F.col("linked"), F.col("size")).otherwise(0)).alias("link_size")), "style-items")
    n, is_text = F.col("n"), F.col("content")
    nodes = each.groupBy("host", "node", "said", "path").agg(
        F.sum(F.when(~is_text, n)).alias("m"), F.sum(F.when(~is_text, n * F.log("n"))).alias("same"),  # a style a page
        F.avg(F.when(is_text, F.log("n"))).alias("entropy"), F.sum(F.when(is_text, F.col("size"))).alias("size"), F.sum(F.when(is_text, F.col("link_size"))).alias("link_size"),
    )
    most = F.nullif(F.log("m"), F.lit(0.0))  # the largest entropy m pages can have
    varied = F.greatest(F.lit(0.0), 1 - F.coalesce("entropy", F.lit(0.0)) / most)
    nodes = nodes.where("m is not null").select(
        "host", "node", "said", "path", "m", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce((F.log("m") - F.col("same") / F.col("m")) / most, F.lit(1.0)).alias("style"),
        (F.coalesce(varied, F.lit(1.0)) * (1 - F.coalesce(F.try_divide("link_size", "size"), F.lit(0.0)))).alias("content"),
    )
    nodes = keep(nodes, "style-nodes")
    varied_size = F.col("size") * F.col("content")
    of_host = nodes.groupBy("host").agg(F.sum(varied_size).alias("all"))
    judged = nodes.join(of_host, "host").withColumn("presentation", F.greatest("style", F.coalesce(F.try_divide(varied_size, F.col("all")), F.lit(0.0))))
    weight = F.col("m") - 1
    anywhere = judged.groupBy("path").agg(F.sum(weight).alias("w"), *[F.sum(weight * F.col(c)).alias(f"w_{c}") for c in ("presentation", "content")])
    anywhere = anywhere.select("path", *[((F.col(f"w_{c}") + PRIOR) / (F.col("w") + PRIOR)).alias(f"any_{c}") for c in ("presentation", "content")])
    drawn = keep(judged.join(anywhere, "path").select("host", "node", "said", "path", "m", *[_drawn(F.col(c), weight, F.col(f"any_{c}")).alias(c) for c in ("presentation", "content")]), "style-importances")
    texts = each.where(is_text).select("node", "item", "n").join(drawn.select("node", "m"), "node")
    return drawn, texts


def low_items(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(item): names of low presentations and contents of nodes, and of repeated texts."""
    nodes, texts = importances(pages, url_col, html_col)
    low_p = nodes.where(F.col("presentation") < LOW).select(F.col("node").alias("item"))
    low_c = nodes.where(F.col("content") < LOW).select(F.col("said").alias("item"))
    often = texts.where(F.col("n") - 1 >= REPEATED * (F.col("m") - 1 + PRIOR)).select("item")
    return keep(low_p.unionByName(low_c).unionByName(often).distinct(), "style-low")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", held: int = HELD) -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    low = low_items(pages, url_col, html_col)
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    kind = dict(rows.dtypes)["page_id"]
    if low.count() <= held:
        shared = pages.sparkSession.sparkContext.broadcast(frozenset(low.toArrow().column(0).to_pylist()))
        rows = rows.withColumn("low", F.lit(None).cast("array<bigint>"))
    else:
        shared = None
        key = F.xxhash64(F.col("url"), F.col("html"))

        def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pairs = [(k, i) for k, u, p in zip(*[c.to_pylist() for c in batch.columns], strict=True) for i in _asked(p or "", u)]
                yield pa.RecordBatch.from_arrays([pa.array([p[j] for p in pairs], pa.int64()) for j in (0, 1)], ["key", "item"])

        asked = rows.select(key.alias("key"), "url", "html").mapInArrow(asks, "key long, item long")
        lost = keep(asked.join(low, "item").groupBy("key").agg(F.collect_set("item").alias("low")), "style-lost")  # at most a page's own items
        rows = rows.withColumn("key", key).join(lost, "key", "left").select("page_id", "url", "html", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p or "", shared.value if shared is not None else frozenset(w or ()), u) for u, p, w in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3)], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
