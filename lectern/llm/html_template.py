"""HTML extraction with removal of site templates.

1. Each page is parsed once, where it was read, into text blocks. Every element that could be a template, wherever it stands
   on the page, has a hash of its whole subtree (tags and text) and the run of blocks that it holds.
2. Spark counts, for each host and hash, pages with different content, so that copies of one page count once.
3. A subtree that recurs on enough pages of the host is a template: blocks inside it are deleted. ``LEAST`` pages are enough
   on a host of up to ``SMALL`` pages, and ``LEAST`` more for each tenfold of that (15 on a host of a million), so a
   template of one section of a large host goes too. Outside an article any block element can be a template, within one only
   containers, never a paragraph or a heading of its own; the article, the body and what holds them never are.
4. Markup says the rest. Elements that are no text of the page by their kind go (menus, footers, forms, asides, scripts), and
   those whose class, id or role names what differs from page to page, so that no count could find it (``VARYING``: reader
   comments, adverts, teasers). What such names say of parts that recur by nature (``RECURRING``: banners, notices, share
   boxes) counts only on hosts of fewer than ``MANY`` pages, where there is nothing to count yet; on others the count decides.
   A name counts as a whole and not as a part of another (``cookie-notice`` does, ``has-sidebar`` and ``related-work`` do
   not). Ids of headings, paragraphs, sections and inline elements of an article say nothing, and what holds the article
   stays. Where a page has an ``article``, the blocks of all that are not marked as comments or teasers and of the ``main``
   around them count, in page order; or else those of its ``main``.

Templates are broadcast, an array for each host, while there are at most ``BROADCAST_TEMPLATES`` of them and of hosts, and at
most ``HOST_TEMPLATES`` on each host. Beyond that they are joined with the subtrees of the pages by (host, hash), and what a
page has of them with the page by (host, content): uneven joins that Spark splits, and no row holds a host's templates.
Counts are aggregated before they are shuffled, so a host with a third of all pages is no task's burden.

White space within a block becomes one blank; blocks are joined by an empty line. A null or empty page has the empty text.
Time and memory grow in proportion to a page's length, however long it is and however deep its elements lie. Pages with
null or malformed addresses share the empty host. Repeated rows give a row each. Extra columns are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

import html as _html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.staging import materialize, table

LEAST, SMALL, MANY = 3, 100, 10
BROADCAST_TEMPLATES, HOST_TEMPLATES = 50_000, 2000

#: Elements of HTML by their part in the layout of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("aside blockquote center details div dl fieldset figure form header ol section table ul".split())
#: Elements whose text is no part of an article, and words in class, id or role that say so.
DROPPED = frozenset("aside button canvas dialog embed footer form head iframe input label math menu nav noscript object option script select style svg template textarea title".split())
VARYING = frozenset(
    "ad ads adbox advert advertisement advertising adverts breadcrumb breadcrumbs comment comments disqus hidden pager pagination promo promoted promotion recommended related replies respond sidebar sponsor sponsored teaser".split()
)
RECURRING = frozenset(
    "alert banner complementary consent contentinfo cookie cookies dialog disclaimer footer gdpr masthead menu modal nav navbar navigation newsletter notice notices paywall popup "
    "search share sharebar sharing signup skip social subscribe subscription toolbar topbar widget widgets".split()
)
ASIDE = frozenset("comment comments reply teaser teasers promo promoted sponsored related recommended".split())
#: Which open elements a start tag ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = frozenset("html body table ul ol dl select article section div td th".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>?|([^<]+)|<", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


_STOPS = SCOPE | {x for v in ENDS.values() for x in v} - {"html", "body"}


class _Node:
    """An element. ``drop``: 2 if it is left out for its kind or a name, 1 if for a name that recurs; ``off`` the most of this
    around it; ``first`` and ``last`` the run of blocks that it holds; ``scope``, ``stop`` and ``block`` the nearest elements
    around it, or itself, that the rules below look for; ``open`` how many inline elements are open right in a block."""

    __slots__ = ("tag", "parent", "drop", "off", "outs", "parts", "hash", "length", "inside", "holds", "top", "within", "first", "last", "scope", "stop", "block", "open")

    def __init__(self, tag: str, parent, drop: int, first: int):
        self.tag, self.parent, self.drop, self.off, self.outs, self.parts = tag, parent, drop, 0, 0, [tag]
        self.hash, self.length, self.holds, self.top, self.within, self.first, self.last = 0, 0, False, False, False, first, first
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        self.scope = self if parent is None or tag in SCOPE or tag == "p" else parent.scope
        self.stop = self if parent is None or tag in _STOPS else parent.stop
        self.block = self if parent is None or tag in BLOCK else parent.block
        self.open = {} if self.block is self else None


def _words(value: str) -> list[str]:
    return [x for x in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower()) if x]


def _off(tag: str, attrs: str, inside: bool) -> int:
    """Whether an element is left out for its tag or its attributes: 2 always, 1 where there is no count to say it."""
    if tag in DROPPED or (tag == "header" and not inside):
        return 2
    if not attrs or attrs.isspace():
        return 0
    found = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return 2
    if tag in ("html", "body", "main"):
        return 0
    ids = "" if inside and (tag == "section" or tag not in CONTAINER) and tag != "article" else found.get("id", "")  # made from headings
    named = [_words(x) for x in f"{found.get('class', '')} {ids} {found.get('role', '')}".split()]
    if tag == "article":
        return 2 * (any(len(x) == 1 and x[0] in ASIDE for x in named) or bool(re.fullmatch(r"(div-)?comment-\d+", ids)))
    named = [x for x in named if x and all(w in VARYING or w in RECURRING for w in x)]
    if any(w in VARYING for x in named for w in x):
        return 2
    return int(bool(named) or (not inside and any(_words(x) == ["header"] for x in found.get("class", "").split())))


def parse(page: str) -> tuple[list[tuple[str, int]], list[tuple[int, int, int]], int]:
    """(blocks of the main text, elements, hash of the main text). A block has its text and 1 if only a recurring name leaves
    it out; an element has the hash of its subtree and the run of these blocks that it holds."""
    from xxhash import xxh64_intdigest

    root = at = _Node("#root", None, 0, 0)
    nodes: list[_Node] = []
    blocks: list[tuple[str, _Node]] = []
    run: list[str] = []
    open_: dict[str, int] = {}

    def flush() -> None:
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                blocks.append((text, at))
                at.parts.append(text)

    def close(upto: _Node) -> None:
        nonlocal at
        end = upto.parent
        while at is not end:
            n = at
            if n.tag in BLOCK:
                flush()
            else:
                n.block.open[n.tag] -= 1
            open_[n.tag] -= 1
            n.last = len(blocks)
            n.hash = xxh64_intdigest("\x1f".join(n.parts).encode("utf-8", "surrogatepass")) >> 1
            n.parent.parts.append(f"\x1e{n.hash:x}")
            n.parts = None
            if not n.drop:
                n.parent.length += n.length
            at = n.parent

    pos, size = 0, len(page)
    while pos < size:
        m = _TOKEN.match(page, pos)
        pos = m.end()
        text = m.group(7)
        if text is None and m.group(0) == "<":
            text = "<"
        if text is not None:
            run.append(_html.unescape(text) if "&" in text else text)
            at.length += not text.isspace() and len(text)
            continue
        ending, tag, attrs = (m.group(1), m.group(2), m.group(3)) if m.group(2) else (m.group(4), m.group(5), m.group(6))
        if tag is None:
            continue
        tag = tag.lower()
        if ending:
            if open_.get(tag) if tag in BLOCK else at.block.open.get(tag):
                n = at
                while n.tag != tag:
                    n = n.parent
                close(n)
            elif tag == "p":
                flush()
            continue
        if tag in BLOCK:
            flush()
            if at.scope.tag == "p":  # a paragraph ends where the next block begins
                close(at.scope)
        if tag in ENDS:
            n = at.stop
            while n is not root and n.tag not in ENDS[tag] and (n.tag not in SCOPE or n.tag in ("td", "th")):
                n = n.parent.stop
            if n is not root and n.tag in ENDS[tag]:
                close(n)
        if tag in VOID:
            if tag == "br":
                run.append(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, pos)
            pos = end.end() if end else size
            continue
        if not (attrs or "").rstrip().endswith("/") or tag in BLOCK:
            at = _Node(tag, at, _off(tag, attrs or "", at.inside or at.tag in ("article", "main")), len(blocks))
            nodes.append(at)
            open_[tag] = open_.get(tag, 0) + 1
            if tag not in BLOCK:
                at.block.open[tag] = at.block.open.get(tag, 0) + 1
    flush()
    if at is not root:
        n = at
        while n.parent is not root:
            n = n.parent
        close(n)
    tops = _tops(nodes)
    for n in tops:
        n.top = True
        while n is not None and not n.holds:
            n.holds = True
            n = n.parent
    return _found(nodes, blocks, bool(tops), xxh64_intdigest)


def _switch(nodes: list[_Node], tag: str) -> list[_Node]:
    """The elements of this tag that are not left out. Where all of them are, for something around them, what holds the one
    with the least such around it, the longest of these, stays."""
    found = [n for n in nodes if n.tag == tag and n.length and not n.drop]
    for _ in range(2):
        for n in nodes:  # an element comes before those inside it
            n.off = max(n.drop, n.parent.off)
            n.outs = n.parent.outs + (n.drop > 0)
        if not found or not all(n.off for n in found):
            break
        n = max(found, key=lambda x: (-x.outs, x.length))
        while n is not None:
            n.drop = 0
            n = n.parent
    return [n for n in found if not n.off]


def _tops(nodes: list[_Node]) -> list[_Node]:
    """The elements that hold the page's text, none if it is the page itself: articles and any main around them, or else mains."""
    articles = _switch(nodes, "article")
    if not articles:
        return _switch(nodes, "main")
    around, seen = [], set()
    for n in articles:
        while (n := n.parent) is not None and n not in seen:
            seen.add(n)
            if n.tag == "main":
                around.append(n)
    return articles + around


def _found(nodes: list[_Node], blocks: list[tuple[str, _Node]], cut: bool, digest) -> tuple[list[tuple[str, int]], list[tuple[int, int, int]], int]:
    for n in nodes:
        n.within = n.top or n.parent.within
    out, place = [], [0]
    for text, n in blocks:
        if (n.within or not cut) and n.off < 2:
            out.append((text, n.off))
        place.append(len(out))
    fixed = ("html", "body", "main", "article")
    elements = [(n.hash, place[n.first], place[n.last]) for n in nodes if n.last > n.first and not n.holds and n.tag not in fixed and (n.tag in CONTAINER if n.within else n.tag in BLOCK)]
    return out, elements, digest("\n".join(t for t, off in out if not off).encode("utf-8", "surrogatepass")) >> 1


def _parser(batches):
    texts = pa.list_(pa.struct([("t", pa.string()), ("off", pa.int8())]))
    runs = pa.list_(pa.struct([("h", pa.int64()), ("a", pa.int32()), ("b", pa.int32())]))
    for b in batches:
        for i in range(0, b.num_rows, 500):
            part = b.slice(i, 500)
            rows, subtrees, digests, hosts = [], [], [], []
            for url, page in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                blocks, elements, digest = parse(page or "")
                rows.append([{"t": t, "off": off} for t, off in blocks])
                subtrees.append([{"h": h, "a": a, "b": z} for h, a, z in elements])
                digests.append(digest)
                m = _HOST.match(url or "")
                hosts.append(m[1].lower() if m else "")
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(hosts, pa.string()), pa.array(digests, pa.int64()), pa.array(rows, texts), pa.array(subtrees, runs)], names=["id", "url", "host", "digest", "blocks", "elements"])


def _writer(batches):
    """Delete the blocks in templates, and those that a recurring name leaves out where ``counted`` is false; join the rest."""
    for b in batches:
        out = []
        for blocks, elements, own, counted in zip(*(b.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True):
            n = len(blocks)
            inside = np.zeros(n + 1, np.int64)
            if own:
                own = set(own)
                for e in elements:
                    if e["h"] in own:
                        inside[e["a"]] += 1
                        inside[e["b"]] -= 1
                inside = np.cumsum(inside)
            out.append("\n\n".join(x["t"] for x, k in zip(blocks, inside[:n].tolist(), strict=True) if not k and (counted or not x["off"])))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["id", "url", "text"])


def _seen(parsed: DataFrame) -> DataFrame:
    """(host, digest, h): the subtrees of each content."""
    return parsed.select("host", "digest", F.explode(F.array_distinct(F.col("elements.h"))).alias("h")).distinct()


def _sizes(parsed: DataFrame) -> DataFrame:
    """(host, pages): pages with different content."""
    return parsed.select("host", "digest").distinct().groupBy("host").agg(F.count("*").alias("pages"))


def templates(parsed: DataFrame, least: int = LEAST) -> DataFrame:
    """(host, h): the subtrees that recur on many pages of the host."""
    counts = _seen(parsed).groupBy("host", "h").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return counts.join(_sizes(parsed), "host").filter(F.col("n") >= least * F.greatest(F.lit(1.0), 1 + F.log10(F.col("pages") / SMALL))).select("host", "h")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """Per row: id, url, text, n_chars."""
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`"))
    schema = "id long, url string, host string, digest long, blocks array<struct<t string, off byte>>, elements array<struct<h long, a int, b int>>"
    parsed = materialize(rows.mapInArrow(_parser, schema), "parsed", "zstd")
    found = materialize(templates(parsed, least), "templates")
    many = materialize(_sizes(parsed).filter(F.col("pages") >= MANY).select("host"), "hosts")
    size = found.groupBy("host").agg(F.count("*").alias("n")).agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
    counted = F.lit(True).alias("counted")
    none = F.array().cast("array<bigint>")
    if (size["all"] or 0) + many.count() <= BROADCAST_TEMPLATES and (size["most"] or 0) <= HOST_TEMPLATES:
        known = many.select("host", counted).join(found.groupBy("host").agg(F.collect_set("h").alias("hashes")), "host", "full_outer")
        met = parsed.join(F.broadcast(known), "host", "left").withColumn("own", F.array_intersect(F.col("elements.h"), F.coalesce("hashes", none)))
    else:
        own = _seen(parsed).join(found, ["host", "h"]).groupBy("host", "digest").agg(F.collect_set("h").alias("own"))
        own = parsed.select("host", "digest").distinct().join(many.select("host", counted), "host").join(own, ["host", "digest"], "full_outer")
        met = parsed.join(materialize(own, "own"), ["host", "digest"], "left")
    met = met.select("id", "url", "blocks", "elements", F.coalesce("own", none).alias("own"), F.coalesce("counted", F.lit(False)).alias("counted"))
    out = met.mapInArrow(_writer, "id long, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))


# the query ------------------------------------------------------------------------------------------------------------


def op9_template_removal(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op9_template_removal": op9_template_removal}
SQL: dict[str, str] = {}
