"""Main text of web pages by site template removal.

Every element's subtree is hashed (tag, text and child hashes).  Spark counts
with how many distinct main texts of its host each hash occurs; subtrees that
recur with many are that site's template and are deleted.  A single line of an
article is prose that may recur by itself, so it goes only where the same
subtree also recurs outside articles of that host, or stands in the articles
of a documented share of it.  Copies of a page have one main text and count
once.  Edited copies have other main texts, but the same lines around a
subtree: inside an article a template must also stand between other lines on
most of its pages.  An inline element in running text goes with its block.

To supplement this, elements that name themselves as page furniture (nav,
footer, forms, scripts, adverts, comments and the like) are deleted, and where
a page has an article, only it is read.
"""

from __future__ import annotations

import html as htmllib
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlens.llm.common import broadcast_if_small, materialize

MIN_PAGES = 5  # a subtree with so many distinct main texts, or with all of a smaller host's (two at least), is template
LINE_SHARE = 0.5  # a line of articles is template only in that share of its host's main texts, MIN_PAGES at least
AROUND = 3  # lines before and after a subtree in an article that tell edited copies from a template
MAX_BROADCAST_ROWS = 100_000  # templates (host, digest), and pages with their templates (bounded by page size)

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp noembed noframes".split())
SKIP = frozenset("head script style textarea title noscript template iframe svg nav footer aside form button select dialog menu audio video".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
# Elements whose start ends an open element of these names.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FURNITURE = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|banner|promo(?:tion)?|sponsor(?:ed)?|sidebar|side-bar|menu|nav(?:bar|igation)?|"
                       r"breadcrumbs?|footer|masthead|site-header|page-header|topbar|cookies?|consent|notice|popup|modal|overlay|newsletter|subscribe|"
                       r"signup|share|social|related|recommend(?:ed|ations)?|comments?|replies|respond|disqus|widget|toolbar|pagination|pager)(?:$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")


@dataclass
class Node:
    tag: str
    attrs: str = ""
    parent: "Node | None" = None
    inside: list = field(default_factory=list)  # strings and nodes in order
    digest: int = 0


def parse(page: str) -> Node:
    """A tree of elements; unclosed and misplaced tags are closed as a browser
    would for the common cases (p, li, table cells)."""
    root = Node("#root")
    at, node = 0, root
    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            if at < len(page):
                node.inside.append(page[at:])
            return root
        if m.start() > at:
            node.inside.append(page[at:m.start()])
        at = m.end()
        if not m.group(2):
            continue
        tag = m.group(2).lower()
        if m.group(1):
            up = node
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                node = up.parent
            elif tag == "p":  # a lone end tag is an empty paragraph
                node.inside.append(Node("p", parent=node))
            continue
        ends = ENDS.get(tag, ())
        stop = {"ul", "ol", "dl", "table", "select", "article", "section", "div", "main", "body"}
        if ends:
            up = node
            while up is not root and up.tag not in ends and up.tag not in stop:
                up = up.parent
            while up is not root and up.tag in ends:
                node = up.parent
                up = node
        if tag in BLOCK:  # a block ends an open paragraph
            up = node
            while up is not root and up.tag != "p" and up.tag not in stop and up.tag not in ("td", "th", "li"):
                up = up.parent
            if up is not root and up.tag == "p":
                node = up.parent
        child = Node(tag, m.group(3), node)
        node.inside.append(child)
        if tag in RAW and not m.group(3).rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if end:
                at = end.end()
                if tag in ("noscript", "textarea", "title"):
                    child.inside.append(page[m.end():end.start()])
            elif tag in ("script", "style"):
                return root
        elif tag not in VOID and not (m.group(3).rstrip().endswith("/") and tag in ("svg", "math")):
            node = child


def _walk(root: Node):
    """Nodes in document order, without recursion."""
    stack = [root]
    while stack:
        n = stack.pop()
        yield n
        stack.extend(x for x in reversed(n.inside) if isinstance(x, Node))


def digest_subtrees(root: Node) -> None:
    from xxhash import xxh64_intdigest

    for n in reversed(list(_walk(root))):
        parts = [n.tag]
        for x in n.inside:
            parts.append(f"<{x.digest}>" if isinstance(x, Node) else _SPACE.sub(" ", x).strip())
        n.digest = xxh64_intdigest("\x1f".join(parts))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _main(root: Node) -> Node:
    """The article, else the main element, else the whole page; of several the one with most text."""
    for tag in ("article", "main"):
        found = [n for n in _walk(root) if n.tag == tag and not _in_furniture(n)]
        if found:
            return max(found, key=lambda n: sum(len(x) for d in _walk(n) for x in d.inside if isinstance(x, str)))
    return root


def _attr(n: Node) -> dict[str, str]:
    return {m.group(1).lower(): m.group(2) or m.group(3) or m.group(4) or "" for m in _ATTR.finditer(n.attrs)}


def is_furniture(n: Node, top: Node) -> bool:
    """Whether an element names itself as something else than the article's text."""
    if n.tag in SKIP:
        return True
    if n is top or n.tag in ("html", "body", "article", "main", "#root"):
        # Reader comments are often articles inside the article.
        return n is not top and n.tag == "article" and bool(FURNITURE.search(" ".join((_attr(n).get("class", ""), _attr(n).get("id", "")))))
    if n.tag == "header":
        # The article's own header holds its title; another is the site's.
        up = n.parent
        while up is not None and up is not top:
            up = up.parent
        return up is None or top.tag == "#root"
    if not n.attrs:
        return False
    a = _attr(n)
    style = a.get("style", "").replace(" ", "").lower()
    return ("hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style
            or a.get("role", "").lower() in ROLES or bool(FURNITURE.search(f"{a.get('class', '')} {a.get('id', '')}")))


def _in_furniture(n: Node) -> bool:
    up = n.parent
    while up is not None:
        if up.tag in SKIP or (up.attrs and up.tag not in ("html", "body") and FURNITURE.search(" ".join(_attr(up).get(k, "") for k in ("class", "id")))):
            return True
        up = up.parent
    return False


def _in_running_text(n: Node) -> bool:
    """Whether an inline element stands in a line that has text beside it."""
    up = n
    while up.tag not in BLOCK and up.parent is not None:
        up = up.parent
        if any(isinstance(x, str) and x.strip() for x in up.inside):
            return True
    return False


def _unit(n: Node) -> bool:
    """Whether an element can be template by itself."""
    return n.tag in BLOCK or not _in_running_text(n)


def _lines(top: Node) -> tuple[list[str], dict[int, tuple[int, int]]]:
    """The lines of the text without furniture, and of each element in it (by
    id) the range of its lines."""
    lines: list[str] = []
    line: list[str] = []
    span: dict[int, tuple[int, int]] = {}

    def close():
        text = _SPACE.sub(" ", "".join(line)).strip()
        if text:
            lines.append(text)
        line.clear()

    stack: list = [top]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            line.append(n)
        elif isinstance(n, tuple):
            n, start = n
            if n.tag in BLOCK:
                close()
            span[id(n)] = (start, len(lines) + (n.tag not in BLOCK))
        elif n is top or not is_furniture(n, top):
            if n.tag in BLOCK:
                close()
            stack.append((n, len(lines)))
            stack.extend(reversed(n.inside))
    close()
    return lines, span


def page_subtrees(page: str | None) -> list[tuple[int, int, int, int, int]]:
    """Distinct (digest, main, before, after, line) of the subtrees that could
    be template: all with content, but for the page itself and its article.
    main names the page's main text; before and after the lines around a
    subtree in the article (main for others); line is 1 for a subtree that is
    no more than one line of an article.  Digest 0 stands for the page.  A
    page without main text has none."""
    from xxhash import xxh64_intdigest

    root = parse(page or "")
    digest_subtrees(root)
    top = _main(root)
    lines, span = _lines(top)
    if not lines:
        return []
    name = lambda x: _signed(xxh64_intdigest("\x1f".join(x)))
    main = name(lines)
    above = set()
    up = top
    while up is not None:
        above.add(id(up))
        up = up.parent
    found = {(0, main, main, main, 0)}
    for n in _walk(root):
        if not n.inside or id(n) in above or n.tag in ("html", "body", "head") or not _unit(n):
            continue
        at = span.get(id(n)) if top.tag != "#root" else None
        around = (name(lines[max(0, at[0] - AROUND):at[0]]), name(lines[at[1]:at[1] + AROUND])) if at else (main, main)
        found.add((_signed(n.digest), main, *around, int(at is not None and at[1] - at[0] <= 1)))
    return sorted(found)


def main_text(page: str | None, template: set[int]) -> str:
    """Text blocks of the page's article joined by line feeds; white space
    inside a block becomes one space, character references are decoded."""
    root = parse(page or "")
    if template:
        digest_subtrees(root)
    top = _main(root)
    out: list[str] = []
    line: list[str] = []

    def close():
        text = _SPACE.sub(" ", htmllib.unescape("".join(line))).strip()
        if text:
            out.append(text)
        line.clear()

    stack: list = [top]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            line.append(n)
            continue
        if n is None:
            close()
            continue
        if n is not top and (is_furniture(n, top) or (template and _signed(n.digest) in template and _unit(n))):
            continue
        if n.tag == "br":
            line.append(" ")
            continue
        block = n.tag in BLOCK
        if block:
            close()
            stack.append(None)
        stack.extend(reversed(n.inside))
    close()
    return "\n".join(out)


def host_of(url):
    """Lower-case host of a URL column; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _page_key():
    """Two hashes that name a page by its host and html."""
    return [F.xxhash64("host", "html").alias("k1"), F.xxhash64(F.lit("page"), "html", "host").alias("k2")]


def subtrees(pages: DataFrame) -> DataFrame:
    """(host, k1, k2, digest, main, before, after, line) of
    :func:`page_subtrees`, written once; k1, k2 name the page."""
    def run(batches):
        for b in batches:
            found = [page_subtrees(x) for x in b.column(3).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            cells = np.array([x for f in found for x in f], np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(3)), *(pa.array(cells[:, i]) for i in range(5))],
                                             names=["host", "k1", "k2", "digest", "main", "before", "after", "line"])
    keyed = pages.where("html <> ''").select(host_of(F.col("url")).alias("host"), "html").select("host", *_page_key(), "html")
    return materialize(keyed.mapInArrow(run, "host string, k1 long, k2 long, digest long, main long, before long, after long, line long"), "subtrees")


def site_templates(found: DataFrame) -> DataFrame:
    """(host, digest) of the subtrees with at least ``MIN_PAGES`` distinct main
    texts of their host (all, but two at least, where it has fewer), on most of
    them between other lines; lines of articles and other subtrees are counted
    apart, and a line needs ``LINE_SHARE`` of the host too."""
    counts = materialize(found.groupBy("host", "digest", "line").agg(F.countDistinct("main").alias("n")).where("n >= 2"), "counts")
    whole = counts.where("digest = 0").select("host", F.col("n").alias("pages"))
    enough = F.when(F.col("line") == 0, F.least(F.lit(MIN_PAGES), F.col("pages"))).otherwise(
        F.greatest(F.lit(MIN_PAGES), F.col("pages") * LINE_SHARE))
    often = counts.where("digest <> 0").join(whole, "host").where(F.col("n") >= enough).select("host", "digest", "line", "n")
    often = broadcast_if_small(materialize(often, "often"), MAX_BROADCAST_ROWS)
    around = found.select("host", "digest", "line", "before", "after").join(often, ["host", "digest", "line"]).groupBy(
        "host", "digest", "line", "n").agg(F.countDistinct("before").alias("before"), F.countDistinct("after").alias("after"))
    return around.where("greatest(before, after) * 2 >= n").select("host", "digest").distinct()


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row.

    Null or empty html gives an empty text.  Pages without a host (null url)
    form one site.  Repeated rows count as one page and all stay.  Other
    columns are ignored."""
    found = subtrees(pages)
    templates = broadcast_if_small(materialize(site_templates(found), "templates"), MAX_BROADCAST_ROWS)
    hits = found.select("host", "k1", "k2", "digest").join(templates, ["host", "digest"]).groupBy("k1", "k2").agg(
        F.collect_set("digest").alias("template"))
    hits = broadcast_if_small(materialize(hits, "page-templates"), MAX_BROADCAST_ROWS)
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    rows = rows.select("page_id", "url", "html", *_page_key()).join(hits, ["k1", "k2"], "left")
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            text = [main_text(page, set(t or ())) for page, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])
    return rows.select("page_id", "url", "html", "template").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
