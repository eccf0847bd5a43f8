"""Main text of web pages by a site style tree.

1. Every page is read into blocks of text below paths of elements (tag and class). Pages of one host are merged by path: a node of the site's
   tree is a path, its presentations are the child sequences seen there, its contents the block texts seen there.
2. Importance. Of a content node's text that k of m pages hold: 1 - log(k) / log(m), the part of the entropy of its spread over pages
   that is missing (a text on one page: 1, on all of them: 0). Of a presentation node: the entropy of its child sequences, base m.
   Both together: GAMMA parts the content, the rest the presentation of the element around it. Nodes of fewer than ``least`` pages
   are too rare to judge and count 1. Pages of a host with one title are copies and count once, so a copied article is no template.
3. Blocks below ``threshold`` are removed from each page, and branches that names of elements, classes and roles show to be no part of an
   article (menus, headers, footers, sidebars, notices, adverts, forms, reader comments), unless such a branch holds the article. Where
   article or main elements are left, text outside them is removed; where none is, lists that consist of links only.

All counts are sums and distinct rows over (host, path, text hash): no host, however large, is gathered in one task. What is joined back to the
pages are the removed texts only.

Null or empty html gives an empty text. Null or unreadable urls have no host: such pages are judged by names alone. Rows are never merged:
repeated ids and pages each give their row. White space is ASCII white space and no-break spaces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapegrid.llm.dom import HIDDEN, Block, Element, read
from tapegrid.llm.text import fresh, map_docs
from tapegrid.plans.session import materialise

GAMMA = 0.9
THRESHOLD = 0.15
LEAST = 3

# Elements, roles and words of class names that mark what is no part of an article.
TAGS = frozenset("nav aside footer form menu dialog search fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
WORDS = frozenset("nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar rail widget widgets footer foot colophon copyright masthead topbar toolbar "
                  "ad ads adv advert adverts advertisement advertising adsense adslot adbox banner promo promos promotion promoted sponsor sponsored sponsors outbrain taboola "
                  "cookie cookies consent gdpr notice notices alert popup modal overlay lightbox interstitial paywall newsletter subscribe subscription signup optin "
                  "share sharing social follow related recommended recommendations trending popular comment comments disqus respond replies commentlist discussion "
                  "login signin register search searchbox form pagination pager".split())
MAIN = frozenset(("article", "main"))
TOP = frozenset(("header", "head", "top"))


def host_of(url):
    """Host of a url column in lower case without user and port; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)), F.lit(""))


def _hash(text: str) -> int:
    """XXH64 as Spark's xxhash64 gives it."""
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >> 63 else h


def paths(elements: list[Element]) -> list[int]:
    """Hash of each element's path from the root; an element's own place among its brothers does not matter."""
    out = [0] * len(elements)
    for i, e in enumerate(elements[1:], 1):
        out[i] = _hash(f"{out[e.parent]}>{e.tag}{e.style}")
    return out


def _named(e: Element, inside: bool, holds: bool, heads: bool) -> bool:
    """Whether a branch is no part of an article by its names. A wrapper that holds the article (``holds``) never is; one that holds the
    first-level heading (``heads``) is by its tag or role only, not by words such as has-sidebar."""
    if e.tag in HIDDEN:
        return True
    if holds or e.tag in ("html", "body"):
        return False
    if e.tag in TAGS or e.role in ROLES:
        return True
    return not inside and e.tag == "header" or not heads and bool(e.names & (WORDS if inside else WORDS | TOP))


def kept(elements: list[Element], blocks: list[Block]) -> list[bool]:
    """Whether each block is left by the names around it."""
    n = len(elements)
    main = [e.tag in MAIN or e.role in ("main", "articlebody") for e in elements]
    inside, holds, heads = main[:], main[:], [e.tag == "h1" for e in elements]
    for i in range(1, n):
        inside[i] = inside[i] or inside[elements[i].parent]
    for i in range(n - 1, 0, -1):
        up = elements[i].parent
        holds[up], heads[up] = holds[up] or holds[i], heads[up] or heads[i]
    gone = [False] * n
    for i in range(1, n):
        up = elements[i].parent
        gone[i] = gone[up] or _named(elements[i], inside[up], holds[i], heads[i])
    left = [not gone[b.element] for b in blocks]
    within = [x and inside[b.element] for x, b in zip(left, blocks)]
    if any(within):
        return within
    plain: dict[int, bool] = {}
    for b in blocks:  # lists of links only
        at = _list(elements, b.element)
        if at:
            plain[at] = plain.get(at, True) and b.linked >= len(b.text)
    return [x and not plain.get(_list(elements, b.element), False) for x, b in zip(left, blocks)]


def _list(elements: list[Element], i: int) -> int:
    while i > 0 and elements[i].tag not in ("ul", "ol", "dl"):
        i = elements[i].parent
    return i


FEATURES = "host string, page long, unit long, node long, around long, content boolean, value long"


def features(pages: DataFrame) -> DataFrame:
    """Presentation and content of each page with a host, columns (host, html): one row for each element path with its child sequence and
    one for each block text."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = []
        for i, (host, page) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            if host is None or not page:
                continue
            elements, blocks, title = read(page)
            path, own = paths(elements), _hash(page)
            unit = _hash(title) if title else own
            for e, p in zip(elements, path):
                if e.children and e.tag not in HIDDEN:
                    rows.append((host, own, unit, p, p, False, _hash(" ".join(e.children))))
            for x in blocks:
                rows.append((host, own, unit, path[x.element], path[elements[x.element].parent] if x.element else 0, True, _hash(x.text)))
        if not rows:
            return None
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(np.array(c, np.int64)) for c in cols[1:5]), pa.array(cols[5], pa.bool_()), pa.array(np.array(cols[6], np.int64))],
                                          names=[x.split()[0] for x in FEATURES.split(", ")])

    return map_docs(pages, run, FEATURES, "html")


def importance(found: DataFrame, gamma: float = GAMMA, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Of the merged trees: (host, node, value, pages, own, importance) of each text, and (host, node, pages, importance) of each presentation node."""
    units = found.groupBy("host", "node", "content", "value", "unit").agg(F.min("around").alias("around"))
    size = units.groupBy("host", "node", "content", "unit").agg(F.lit(1).alias("_")).groupBy("host", "node", "content").agg(F.count(F.lit(1)).alias("pages"))
    held = units.groupBy("host", "node", "content", "value").agg(F.count(F.lit(1)).alias("own"), F.min("around").alias("around"))
    both = materialise(held.join(size, ["host", "node", "content"]), "site-nodes")
    share = F.col("own") / F.col("pages")
    shape = (both.filter("NOT content").groupBy("host", "node").agg(F.max("pages").alias("pages"), F.sum(-share * F.log(share)).alias("_h"))
             .select("host", "node", "pages", F.when(F.col("pages") < least, 1.0).otherwise(F.least(F.lit(1.0), F.col("_h") / F.log("pages"))).alias("importance")))
    shape = materialise(shape, "site-shapes")  # one row a path: where that is little, the many texts of a hot host need no shuffle to meet it
    near = shape.select("host", F.col("node").alias("around"), F.col("importance").alias("_shape"))
    own = F.when(F.col("pages") < least, 1.0).otherwise(1 - F.log("own") / F.log("pages"))
    texts = (both.filter("content").join(near, ["host", "around"], "left")
             .select("host", "node", "value", "pages", "own", F.when(F.col("pages") < least, 1.0).otherwise(gamma * own + (1 - gamma) * F.coalesce("_shape", F.lit(1.0))).alias("importance")))
    return texts, shape


def extract(pages: DataFrame, url: str = "url", html: str = "html", text: str = "text", n_chars: str = "n_chars", threshold: float = THRESHOLD, gamma: float = GAMMA, least: int = LEAST) -> DataFrame:
    """``pages`` with the main text of each and its length in code points, in place of the html."""
    names = [c for c in pages.columns if c != html and c not in (text, n_chars)]
    host, own, noise, page = fresh(pages.columns + [text, n_chars], "_host", "_own", "_noise", "_page")
    inner = pages.select(host_of(F.col(url).cast("string")).alias("host"), F.col(html).cast("string").alias("html"))
    found = materialise(features(inner), "site-features")
    texts, _ = importance(found, gamma, least)
    low = materialise(texts.filter(F.col("importance") < threshold).select("host", "node", "value"), "site-template")
    # removed texts of each page: joined by text first, so what meets the pages is no larger than what they lose
    hit = (found.filter("content").select("host", "page", "node", "value").distinct().join(low, ["host", "node", "value"])
           .groupBy("host", "page").agg(F.collect_set(F.struct("node", "value")).alias(noise)))
    hit = materialise(hit.select(F.col("host").alias(own), F.col("page").alias(page), noise), "site-noise")
    keyed = pages.select(*names, F.col(html).cast("string").alias(html), host_of(F.col(url).cast("string")).alias(host))
    joined = keyed.join(hit, (F.col(host) == F.col(own)) & (F.xxhash64(html) == F.col(page)), "left").select(
        *names, html, F.transform(noise, lambda x: x["node"]).alias(own), F.transform(noise, lambda x: x["value"]).alias(page))
    at = len(names)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        nodes, values = b.column(at + 1), b.column(at + 2)
        marked = nodes.is_valid().to_pylist()
        for i, raw in enumerate(b.column(at).to_pylist()):
            if not raw:
                out.append("")
                continue
            elements, blocks, _ = read(raw)
            left = kept(elements, blocks)
            if marked[i]:
                path, drop = paths(elements), set(zip(nodes[i].as_py(), values[i].as_py()))
                left = [x and (path[k.element], _hash(k.text)) not in drop for x, k in zip(left, blocks)]
            out.append("\n\n".join(k.text for x, k in zip(left, blocks) if x))
        return pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=[*names, text, n_chars])

    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in pages.select(*names).schema.fields)
    return map_docs(joined, run, f"{schema}, `{text}` string, `{n_chars}` long", html)


def report(pages: DataFrame) -> DataFrame:
    return extract(pages).select("page_id", "url", "text", "n_chars")
