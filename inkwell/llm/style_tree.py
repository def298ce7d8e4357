"""HTML extraction with a site style tree.

The DOMs of a host's pages are merged: an element node is a place in a presentation style (tag and classes), a style node is
an element's sequence of children, in which like neighbours count as one place. Text, link targets and image sources are
leaves. Over the m pages that have a node, the importance of an element is the entropy (to base m) of its styles; that of a
leaf is one less the mean entropy of its features over pages. Both are combined bottom-up:
(1 - g^l) own + g^l mean of the children, for l styles. Elements that are unimportant with all that is in them are removed
from every page; the rest of the page is its text.

The merged statistics are sums by (host, node), so a hot host is spread over tasks; only a host's distinct nodes come
together in one task.

Defined cases: a null html gives a null text, an empty one an empty text; a null url is a host of its own, as is one without
host; rows that repeat a page count as pages; nodes on fewer than MIN_PAGES pages are important; a page that would lose all its
text is kept whole; broken markup is closed where its parent ends; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import only, ready, written

GAMMA, LEAST, MIN_PAGES = 0.9, 0.3, 3
#: A whole tag without < and > in its values; the values of others are scanned by hand.
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>"']*+(?:(?:"[^"<>]*+"|'[^'<>]*+')[^<>"']*+)*+)>""")
_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile("[>\"']")
_ATTR = re.compile(r"""(class|href|src)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_LOW = {k: k + 32 for k in range(65, 91)}
_RAW = frozenset(("script", "style", "noscript", "template"))
_CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
_BLOCK = frozenset("p div section article aside header footer nav main h1 h2 h3 h4 h5 h6 ul ol li table tr td th pre blockquote form title figure dl dt dd body html br hr".split())
_ENDS_P = frozenset("p div section article aside header footer nav main h1 h2 h3 h4 h5 h6 ul ol table pre blockquote form figure dl hr".split())
_MASK = (1 << 63) - 1


class Node:
    __slots__ = ("tag", "sig", "kids", "text")

    def __init__(self, tag: str, sig: str, text: str = ""):
        self.tag, self.sig, self.text, self.kids = tag, sig, text, []


def tags(source: str):
    """(start, end, close mark, name, attributes) of the tags, and of comments and declarations with no name. A quoted value may hold
    < and >; a value that isn't closed ends at the next >. Every character is looked at a bounded number of times: once no quoted
    value can be closed, quotes mean nothing."""
    at, size, quotes = 0, len(source), True
    while (start := source.find("<", at)) >= 0:
        if source.startswith("<!", start):
            comment = source.startswith("<!--", start)
            end = source.find("-->" if comment else ">", start + 2)
            if end < 0 and not comment:
                return
            at = size if end < 0 else end + (3 if comment else 1)
            yield start, at, "", "", ""
            continue
        m = _TAG.match(source, start)
        if m:
            at = m.end()
            yield start, at, m[1], m[2], m[3]
            continue
        m = _NAME.match(source, start)
        if not m:
            at = start + 1
            continue
        here, end = m.end(), -1
        while quotes and (x := _STOP.search(source, here)):
            if x[0] == ">":
                end = x.start()
                break
            here = source.find(x[0], x.end()) + 1
            if not here:
                end = source.find(">", x.end())
                break
        if end < 0:
            quotes = False
            end = source.find(">", m.end())
        if end < 0:
            return
        at = end + 1
        yield start, at, m[1], m[2], source[m.end() : end]


def parse(source: str) -> Node:
    """The page's tree; leaves are #text, #link and #image."""
    root = Node("#page", "#page")
    stack, at, size = [root], 0, len(source)
    opened: Counter[str] = Counter()
    low = None

    def said(to):
        text = source[at:to]
        if text and not text.isspace():
            stack[-1].kids.append(Node("#text", "#text", " ".join(entities.unescape(text).split())))

    for start, end, closing, name, rest in tags(source):
        if start < at:  # within a script or the like
            continue
        said(start)
        at = end
        if not name:
            continue
        tag = name.lower()
        if closing:
            while opened[tag]:
                top = stack.pop().tag
                opened[top] -= 1
                if top == tag:
                    break
            continue
        if tag in _RAW:
            low = low if low is not None else source.lower()
            low = low if len(low) == size else source.translate(_LOW)
            to = low.find("</" + tag, at)
            at = size if to < 0 else source.find(">", to) + 1 or size
            continue
        close = _CLOSES.get(tag)
        if close and stack[-1].tag in close:
            opened[stack.pop().tag] -= 1
            if tag == "tr" and stack[-1].tag == "tr":
                opened[stack.pop().tag] -= 1
        elif tag in _ENDS_P and stack[-1].tag == "p" and len(stack) > 1:
            opened[stack.pop().tag] -= 1
        attrs = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTR.findall(rest)} if rest else {}
        node = Node(tag, tag + "." + ".".join(sorted(attrs["class"].split())) if attrs.get("class") else tag)
        stack[-1].kids.append(node)
        if tag == "a" and attrs.get("href"):
            node.kids.append(Node("#link", "#link", attrs["href"]))
        elif tag == "img" and attrs.get("src"):
            node.kids.append(Node("#image", "#image", attrs["src"]))
        if tag not in _VOID and not rest.endswith("/"):
            stack.append(node)
            opened[tag] += 1
    said(size)
    return root


def number(text: str) -> int:
    return xxhash.xxh64_intdigest(text) & _MASK


def walk(root: Node):
    """(node, element id, style id or 0 for a leaf, id of the parent's style) of all nodes, parents first."""
    todo = [(root, number("#page"), 0)]
    while todo:
        node, elem, above = todo.pop()
        if not node.kids:
            yield node, elem, 0, above
            continue
        shape, places, last = [], [], None
        for kid in node.kids:
            if kid.sig != last:
                shape.append(kid.sig)
                last = kid.sig
            places.append(len(shape))
        style = number(f"{elem} {' '.join(shape)}")
        yield node, elem, style, above
        todo.extend((kid, number(f"{style} {p} {kid.sig}"), style) for kid, p in zip(reversed(node.kids), reversed(places)))


def _statistics(batches):
    """Sums by (host, element, style or feature): pages, tf, tf log tf; kind 0 pages of an element, 1 styles, 2 features."""
    for b in batches:
        total: dict = {}
        for host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            page: dict = {}
            for node, elem, style, above in walk(parse(source)):
                page[elem, 0, 0, above] = 1
                if style:
                    page[elem, 1, style, above] = 1
                elif node.text:
                    k = elem, 2, number(node.text), above
                    page[k] = page.get(k, 0) + 1
            for k, n in page.items():
                x = total.setdefault((host, *k), [0, 0, 0.0])
                x[0] += 1
                x[1] += n
                x[2] += n * math.log(n)
        cols = list(zip(*[(*k, *v) for k, v in total.items()])) or [[]] * 8
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["host", "elem", "kind", "item", "above", "pages", "tf", "tflog"])


def importance(rows, gamma: float = GAMMA, least: float = LEAST, min_pages: int = MIN_PAGES) -> list[int]:
    """The topmost elements of a host that are unimportant with all that is in them; rows: (elem, kind, item, above, n, entropy
    sum, features): kind 0 with pages; 1 with a style's pages; 2 with the sum of its features' entropies and their number."""
    pages, above, styles, leaf = {}, {}, {}, {}
    for elem, kind, item, up, n, h, l in rows:
        above[elem] = up
        if kind == 0:
            pages[elem] = n
        elif kind == 1:
            styles.setdefault(elem, {})[item] = n
        else:
            leaf[elem] = 1 - (h / math.log(pages_of(n)) if n > 1 else 0.0) / l if n >= min_pages else 1.0
    kids: dict = {}
    for e, up in above.items():
        kids.setdefault(up, []).append(e)
    order, todo = [], list(kids.get(0, []))
    while todo:
        e = todo.pop()
        order.append(e)
        for s in styles.get(e, ()):
            todo.extend(kids.get(s, ()))
    value, noisy = {}, {}
    for e in reversed(order):
        m = pages.get(e, 1)
        if e not in styles:
            value[e] = leaf.get(e, 0.0 if m >= min_pages else 1.0)
            noisy[e] = value[e] < least
            continue
        own, inner = styles[e], 0.0
        total = sum(own.values())
        for s, n in own.items():
            below = kids.get(s, ())
            inner += n / total * (sum(value[k] for k in below) / len(below) if below else 0.0)
        node = 1.0 if m < min_pages else min(1.0, -sum(n / total * math.log(n / total) for n in own.values()) / math.log(m))
        if e in leaf:
            inner = (inner + leaf[e]) / 2
        decay = gamma ** len(own)
        value[e] = (1 - decay) * node + decay * inner
        noisy[e] = value[e] < least and all(noisy[k] for s in own for k in kids.get(s, ())) and leaf.get(e, 0) < least
    up_of = {s: e for e, x in styles.items() for s in x}
    return sorted(e for e in order if noisy[e] and not noisy.get(up_of.get(above[e]), False))


def pages_of(n: int) -> int:
    return max(int(n), 2)


def _noise(gamma, least, min_pages):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf[["elem", "kind", "item", "above", "n", "h", "l"]].itertuples(index=False, name=None)
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "noise": [importance(rows, gamma, least, min_pages)]})

    return run


def text_of(source: str | None, noise) -> tuple[str | None, int]:
    """The page's text without its noise, and how many branches went."""
    if source is None:
        return None, 0
    root = parse(source)
    noise = set(noise or ())
    keep, gone = [], 0
    skip: set = set()
    for node, elem, _, _ in walk(root):
        if id(node) in skip or elem in noise:
            gone += id(node) not in skip
            skip.update(map(id, node.kids))
        else:
            keep.append(id(node))
    good = set(keep)

    def join(ok) -> str:
        out: list[str] = []
        todo: list = [root]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            elif ok is None or id(x) in ok:
                if x.tag == "#text":
                    out.append(x.text + " ")
                elif x.tag[0] != "#" or x is root:
                    edge = "\n" if x.tag in _BLOCK else ""
                    todo.extend([edge, *reversed(x.kids), edge])
        return "\n".join(s for s in (" ".join(line.split()) for line in "".join(out).split("\n")) if s)

    text = join(good)
    if not text:
        return join(None), 0
    return text, gone


def _extract(batches):
    for b in batches:
        done = [text_of(s, n) for s, n in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([t for t, _ in done], pa.string()), pa.array([n for _, n in done], pa.int32())], ["page_id", "url", "text", "n_removed"])


def host_of(url):
    return F.coalesce(F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))), F.lit(""))


def noise(pages: DataFrame, gamma: float = GAMMA, least: float = LEAST, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, noise): ids of the topmost unimportant elements of each host."""
    ready(pages.sparkSession)
    rows = only(pages, "url", "html").filter("html is not null").select(host_of(F.col("url")).alias("host"), "html")
    stats = rows.mapInArrow(_statistics, "host string, elem bigint, kind int, item bigint, above bigint, pages bigint, tf bigint, tflog double")
    stats = written(stats.groupBy("host", "elem", "kind", "item").agg(F.max("above").alias("above"), F.sum("pages").alias("pages"), F.sum("tf").alias("tf"), F.sum("tflog").alias("tflog")), "nodes")
    shape = stats.filter("kind < 2").select("host", "elem", "kind", "item", "above", F.col("pages").alias("n"), F.lit(0.0).alias("h"), F.lit(0).cast("bigint").alias("l"))
    entropy = F.greatest(F.lit(0.0), F.log("tf") - F.col("tflog") / F.col("tf"))
    leaves = stats.filter("kind = 2").groupBy("host", "elem").agg(F.max("above").alias("above"), F.sum(entropy).alias("h"), F.count("*").alias("l"))
    leaves = leaves.join(stats.filter("kind = 0").select("host", "elem", F.col("pages").alias("n")), ["host", "elem"])
    both = shape.unionByName(leaves.select("host", "elem", F.lit(2).alias("kind"), F.lit(0).cast("bigint").alias("item"), "above", "n", "h", "l"))
    return both.groupBy("host").applyInPandas(_noise(gamma, least, min_pages), "host string, noise array<bigint>")


def extract(pages: DataFrame, gamma: float = GAMMA, least: float = LEAST, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, url, text, n_removed) for each page."""
    found = written(noise(pages, gamma, least, min_pages), "noise")
    x = only(pages, "page_id", "url", "html").withColumn("host", host_of(F.col("url"))).join(found, "host", "left")
    return x.select("page_id", "url", "html", "noise").mapInArrow(_extract, "page_id bigint, url string, text string, n_removed int")
