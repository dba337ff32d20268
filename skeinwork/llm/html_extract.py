"""Main text of web pages by site style trees.

The DOMs of a host's pages are merged: a style node is a host and a path of block elements with their classes (digits aside),
named by a 64-bit hash. Its content node holds the texts that pages show there (all of the branch for a node with a name, those of
the node itself for others), its presentation node the sequences of its child elements. Importance of a node, over the pages that have it (copies, pages of a host with the same text outside
furniture, count once):

    (CONTENT * entropy of contents + (1 - CONTENT) * entropy of presentations + INSIDE if within article or main) * factor of its name

with the number of pages as base of the entropies: 0 if all show the same, 1 if each shows its own; 1 for nodes on fewer than
LEAST_PAGES pages, where nothing can be said. Names of elements, classes, roles and ids are evidence. Weak ones (a header
within an article, legal, disclaimer) lower importance by WEAKLY, so a node that shows something of its own on each page stays
and one that repeats itself goes. Strong ones (menus, footers, adverts, comments, notices, forms) lower it by NAMED,
which only weighs less where form elements or class words name a branch that holds the page's content: over half of its
text and all article and main elements, on most pages. A class or id is a name as a whole: all its parts are words of furniture
or of place, or its last part is a strong word; has-sidebar, article-header or legal-history are none. An article's headings are never
removed by a name of theirs or of a header around them. Branches of importance below LEAST_IMPORTANCE are removed from each page,
wherever they are. A passage that pages share stays where the other texts of its node differ.

Entropies come from counts by (host, node, value), summed by task before the shuffle, so a host with a third of all pages is
no hot key. What can't be told from a page alone, nodes on LEAST_PAGES pages or more that are low without a strong name or high in spite of
one, is a table of hashes by host. It is broadcast once where it is small; else each page is joined to its own nodes of the table
alone, by (host, path), so no list of a whole host travels with every page.
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

from skeinwork.llm.common import few_rows, work_dir, written

LEAST_IMPORTANCE = 0.3
CONTENT = 0.9
INSIDE = 0.15
NAMED = 0.25
WEAKLY = 0.5
LEAST_PAGES = 4
BROADCAST_BYTES = 32 << 20

# HTML element names by the role they play here.
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
SKIPPED = frozenset("script style noscript template svg math iframe object canvas audio video head title textarea select option".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe")
FURNITURE_TAGS = frozenset("nav header footer aside dialog menu button fieldset".split())
STRONG_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "footer contentinfo sidebar aside complementary related recommended share sharing social comment comments respond reply replies disqus cookie cookies consent "
    "notice notices alert popup modal dialog newsletter subscribe signup login search pagination pager toolbar topbar copyright widget widgets".split()
)
WEAK_WORDS = frozenset("header masthead legal disclaimer form".split())
PLACE_WORDS = frozenset(
    "site page global main top bottom left right primary secondary wrapper wrap container holder box block list area section zone region "
    "link links bar inner outer slot unit panel item items sticky fixed floating small large big mobile desktop group grid row col column 0".split()
)
STATE_WORDS = frozenset("no not has have with without is hide hidden show".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset("p div ul ol dl table section article aside header footer nav main form h1 h2 h3 h4 h5 h6 blockquote pre hr address fieldset figure".split())
SELF_CLOSING = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

SKIP, TAG, WORD, WEAK = 4, 3, 2, 1  # how a node is named furniture: never shown, by its element, by a strong word or a form, by a weak word

_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
_STOP = re.compile("[>\"']")
_NAMES = re.compile(r"\b(class|role|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HOST = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")
_PARTS = re.compile(r"[^a-z0-9]+")
_DIGITS = re.compile("[0-9]+")
_M64 = (1 << 64) - 1


def host(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def named_by(names: str) -> int:
    """WORD, WEAK or 0 by the words of a class, role or id, each taken as a whole."""
    found = 0
    for token in names.split():
        parts = [p for p in _PARTS.split(_DIGITS.sub("0", token)) if p]
        if not parts or STATE_WORDS.intersection(parts):
            continue
        strong = STRONG_WORDS.intersection(parts)
        if parts[-1] in STRONG_WORDS or strong and all(p in STRONG_WORDS or p in WEAK_WORDS or p in PLACE_WORDS for p in parts):
            return WORD
        if WEAK_WORDS.intersection(parts) and all(p in WEAK_WORDS or p in PLACE_WORDS for p in parts):
            found = WEAK
    return found


def signed(x: int) -> int:
    return (x & _M64) - (1 << 63)


class Node:
    __slots__ = ("parent", "tag", "path", "kind", "inside", "head", "last", "style", "chars", "mains")

    def __init__(self, parent: int, tag: str, path: int, kind: int, inside: bool, head: bool = False):
        self.parent, self.tag, self.path, self.kind, self.inside, self.head = parent, tag, path, kind, inside, head
        self.last = self.style = self.chars = 0
        self.mains = int(tag in ("article", "main"))


def parsed(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block elements in order, the page itself first, and the text blocks in order, each with its node. Takes linear time."""
    nodes = [Node(-1, "", 0, 0, False)]
    texts: list[tuple[int, str]] = []
    stack, opened = [0], Counter()
    buffer: list[str] = []
    at, end, quoted = 0, len(page), True

    def flush() -> None:
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                texts.append((stack[-1], text))
                nodes[stack[-1]].chars += len(text)

    def close(tag: str, within: tuple[str, ...] = ()) -> None:
        if not opened[tag]:
            return
        for k in range(len(stack) - 1, 0, -1):
            here = nodes[stack[k]].tag
            if here == tag:
                flush()
                opened.subtract(nodes[n].tag for n in stack[k:])
                del stack[k:]
                return
            if here in within:
                return

    def tag_end(p: int) -> int:
        """Place of the > that ends a tag; quotes hide one after an equals sign, as long as all of them are closed."""
        nonlocal quoted
        q = p
        while quoted:
            m = _STOP.search(page, q)
            if not m:
                break
            if m[0] == ">":
                return m.start()
            q = m.end()
            if page[max(p, m.start() - 8) : m.start()].rstrip().endswith("="):
                q = page.find(m[0], q) + 1
                if not q:
                    quoted = False
        quoted = False
        return page.find(">", p)

    while at < end:
        m = _OPEN.search(page, at)
        if not m:
            buffer.append(page[at:])
            break
        buffer.append(page[at : m.start()])
        if m[1]:
            stop = page.find("-->", m.end())
            at = end if stop < 0 else stop + 3
            continue
        stop = page.find(">", m.end()) if m[2] else tag_end(m.end())
        if stop < 0:
            buffer.append(page[m.start() :])
            break
        at = stop + 1
        if m[2]:
            continue
        tag, attributes = m[4].lower(), page[m.end() : stop]
        if tag in INLINE:
            if tag == "br":
                buffer.append(" ")
            continue
        if m[3]:
            close(tag)
            continue
        alone = attributes.endswith("/")
        if tag in RAW and not alone:
            shut = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = shut.end() if shut else end
            continue
        flush()
        if tag == "body":
            close("head")
        if tag in CLOSES_P:
            close("p", ("article", "main", "section", "div", "td", "li", "body"))
        if tag in SELF_CLOSING:
            close(tag, SELF_CLOSING[tag])
        if tag in VOID or alone:
            continue
        names = [(k.lower(), (a or b or c).lower()) for k, a, b, c in _NAMES.findall(attributes)] if "=" in attributes else []
        up = stack[-1]
        inside = nodes[up].inside
        word = 0 if tag in ("article", "main", "body", "html") or inside and tag in HEADINGS else named_by(" ".join(v for _, v in names))
        kind = SKIP if tag in SKIPPED else TAG if tag in FURNITURE_TAGS and not (tag == "header" and inside) else WORD if tag == "form" else max(word, WEAK if tag == "header" else 0)
        head = kind == WEAK and inside and (tag == "header" or any("header" in v or "masthead" in v for _, v in names))
        if tag in HEADINGS:
            while nodes[up].head:
                up = nodes[up].parent  # the article's own heading
        names = " ".join(v for k, v in names if k != "id")
        label = xxhash.xxh3_64_intdigest(f"{tag}.{_DIGITS.sub('0', names)}")
        above = nodes[up]
        if label != above.last:
            above.style = (above.style * 0x9E3779B97F4A7C15 + label) & _M64
            above.last = label
        path = xxhash.xxh3_64_intdigest(label.to_bytes(8, "little"), seed=above.path)
        stack.append(len(nodes))
        opened[tag] += 1
        nodes.append(Node(up, tag, path, kind, above.inside or tag in ("article", "main"), head))
    flush()
    return nodes, texts


NODES = "host string, page long, path long, content long, style long, kind int, holds boolean, inside boolean"


def measured(nodes: list[Node]) -> None:
    """Add up the text and the article and main elements below each node."""
    for n in reversed(nodes[1:]):
        nodes[n.parent].chars += n.chars
        nodes[n.parent].mains += n.mains


def holds(n: Node, page: Node) -> bool:
    """Whether a branch named by a word holds the page's content."""
    return n.kind == WORD and 2 * n.chars > page.chars and n.mains == page.mains


def page_nodes(page: str) -> tuple[int, list[tuple]]:
    """Hash of the page's text outside furniture; and path, content, presentation, kind, whether it holds the page's content, whether inside, of its style nodes with text or a name."""
    nodes, texts = parsed(page)
    named = [False] * len(nodes)
    for k, n in enumerate(nodes):
        named[k] = n.kind > WEAK or (k > 0 and named[n.parent])
    measured(nodes)
    branch = [0] * len(nodes)  # hash of all text below a node
    for k, block in texts:
        branch[k] += xxhash.xxh3_64_intdigest(block.encode("utf-8", "surrogatepass"))
    for k in range(len(nodes) - 1, 0, -1):
        branch[nodes[k].parent] += xxhash.xxh3_64_intdigest((branch[k] & _M64).to_bytes(8, "little"))
    text, shown = xxhash.xxh3_64(), {}
    for k, n in enumerate(nodes):
        if n.kind:
            row = shown.setdefault(n.path, [xxhash.xxh3_64(), 0, n.kind, False, n.inside])
            row[0].update((branch[k] & _M64).to_bytes(8, "little"))
            row[1] = (row[1] * 31 + n.style) & _M64
            row[3] |= holds(n, nodes[0])
    for k, block in texts:
        n, data = nodes[k], block.encode("utf-8", "surrogatepass") + b"\0"
        row = shown.setdefault(n.path, [xxhash.xxh3_64(), 0, 0, False, n.inside])
        if not n.kind:
            row[0].update(data)
            row[1] = (row[1] * 31 + n.style) & _M64
        if not named[k]:
            text.update(data)
    return signed(text.intdigest()), [(signed(p), signed(h.intdigest()), signed(s), kind, holding, inside) for p, (h, s, kind, holding, inside) in shown.items()]


def main_text(page: str, told: dict[int, bool]) -> str:
    """The blocks that are left when branches of low importance are removed.

    told: what the host's tree says of nodes by path, True for low. Of others the page decides: strongly named branches go
    unless they hold its content.
    """
    nodes, texts = parsed(page)
    measured(nodes)
    gone = [False] * len(nodes)
    for k, n in enumerate(nodes):
        own = n.kind >= TAG or told.get(signed(n.path), n.kind == WORD and not holds(n, nodes[0]))
        gone[k] = own or (k > 0 and gone[n.parent])
    return "\n\n".join(t for k, t in texts if not gone[k])


def style_nodes(pages: DataFrame) -> DataFrame:
    """host, path, pages (copies counted once), kind and importance of every style node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            rows = []
            for h, x in zip(map(host, batch.column(0).to_pylist()), batch.column(1).to_pylist(), strict=True):
                text, found = page_nodes(x or "")
                rows += [(h, text, *node) for node in found]
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_())
            cols = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in NODES.split(", ")])

    nodes = pages.select(pages["url"], pages["html"]).mapInArrow(run, NODES).distinct()
    valued = nodes.select("host", "path", "kind", "holds", "inside", F.explode(F.array(F.struct(F.lit(True).alias("c"), F.col("content").alias("v")), F.struct(F.lit(False).alias("c"), F.col("style").alias("v")))).alias("x"))
    counts = valued.groupBy("host", "path", "x").agg(
        F.count("*").alias("count"), F.max("kind").alias("kind"), F.sum(F.col("holds").cast("long")).alias("holds"), F.max("inside").alias("inside")
    )
    n = F.sum(F.when(F.col("x.c"), F.col("count")).otherwise(0))

    def entropy(of) -> F.Column:
        s = F.sum(F.when(of, F.col("count") * F.ln("count")).otherwise(0.0))
        return F.when(n >= LEAST_PAGES, (F.ln(n) - s / n) / F.ln(n)).otherwise(F.lit(1.0))

    strong = (F.max("kind") >= TAG) | ((F.max("kind") == WORD) & (F.sum(F.when(F.col("x.c"), F.col("holds")).otherwise(0)) * 2 <= n))
    factor = F.when(strong, NAMED).when(F.max("kind") == WEAK, WEAKLY).otherwise(1.0)
    importance = CONTENT * entropy(F.col("x.c")) + (1 - CONTENT) * entropy(~F.col("x.c")) + F.when(F.max("inside"), INSIDE).otherwise(0.0)
    return counts.groupBy("host", "path").agg(n.alias("pages"), F.max("kind").alias("kind"), F.round(importance * factor, 9).alias("importance"))


def verdicts(pages: DataFrame, least: float = LEAST_IMPORTANCE) -> DataFrame:
    """host, path, low: what pages can't tell by themselves. Nodes on LEAST_PAGES pages or more that are low without a strong name, and all of those that a strong word names."""
    low = F.col("importance") < least
    return style_nodes(pages).where((F.col("pages") >= LEAST_PAGES) & (F.col("kind") < TAG) & (low | (F.col("kind") == WORD))).select("host", "path", low.alias("low"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page; a null or empty page has the empty text.

    Pages without a url share one host; repeated rows and null ids are kept; other columns are left out; an empty table gives
    no rows. A very long page is parsed in one task, in time linear in its length, whatever its markup.
    """

    def emit(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    spark = pages.sparkSession
    table = written(verdicts(pages), work_dir(spark, "style-trees"), "verdicts")
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"], pages["html"])
    size = table.agg(F.coalesce(F.sum(F.octet_length("host") + 64), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        told: dict[str, dict[int, bool]] = {}
        for r in table.collect():  # at most BROADCAST_BYTES
            told.setdefault(r.host, {})[r.path] = r.low
        shared = spark.sparkContext.broadcast(told)

        def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in few_rows(batches):
                hosts = map(host, batch.column(1).to_pylist())
                yield emit(batch, [main_text(x or "", shared.value.get(h, {})) for h, x in zip(hosts, batch.column(2).to_pylist(), strict=True)])

        return rows.mapInArrow(alone, OUT)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            known = [{x["path"]: x["low"] for x in own or ()} for own in batch.column(3).to_pylist()]
            yield emit(batch, [main_text(x or "", k) for x, k in zip(batch.column(2).to_pylist(), known, strict=True)])

    key = F.xxhash64(F.coalesce("url", F.lit("")), F.coalesce("html", F.lit("")))  # equal pages have equal nodes
    own = page_paths(rows.select(key.alias("key"), "url", "html")).join(table, ["host", "path"]).groupBy("key").agg(F.collect_set(F.struct("path", "low")).alias("told"))
    return rows.withColumn("key", key).join(own, "key", "left").select("page_id", "url", "html", "told").mapInArrow(joined, OUT)


OUT = "page_id long, url string, text string, n_chars long"


def page_paths(pages: DataFrame) -> DataFrame:
    """key, host, path of every style node of every page (key, url, html), each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            rows = [(k, h, p) for k, h, x in zip(batch.column(0).to_pylist(), map(host, batch.column(1).to_pylist()), batch.column(2).to_pylist(), strict=True) for p in {signed(n.path) for n in parsed(x or "")[0]}]
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64()), strict=True)], names=["key", "host", "path"])

    return pages.select("key", "url", "html").mapInArrow(run, "key long, host string, path long").distinct()
