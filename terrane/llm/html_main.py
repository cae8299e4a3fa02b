"""Main text of web pages by nearest-URL page differencing.

Pages of a host are ordered by URL path; each is aligned, block of text by block of text, with its neighbours in that order
(longest common subsequence of block hashes), and shared blocks are deleted: they are the site's, not the page's.  The nearer
neighbour is the one with the longer common path.  All text takes part, what markup calls furniture too.  Blocks that SITE of
the host's different pages hold, LEAST at least, are the site's whatever the neighbours say.  What differencing leaves is then
held against markup where it is explicit: navigation, headers, footers, asides, forms, adverts, notices and comments go, and
of a page with an article or main element that element stays.

Inside such an element a shared block may be a paragraph that a few pages really have in common, so there it is deleted only
if both neighbours share it and SITE of the host's different articles hold it.  A neighbour that shares more than half of the
page's own blocks (those that are not the site's) is a copy, which says nothing about the site, and deletes nothing.

The order is dealt by splitters drawn from a hash sample of the keys, so a host of any size is spread over many tasks; each
task gets the last block hashes of the pages on either side of its range.

Defined cases: null or empty html gives the empty text; a null url is a host of its own; equal rows give equal results; a
page alone on its host keeps all that markup leaves; an empty table gives no rows; a page of any length is one row of a task;
ties of key are ordered by the html's hash; columns besides id, url and html, whatever their names, are not read."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .urls import host, path

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)>|<[!?][^>]*>", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z0-9]+")
#: Fixed lists of element names and of words in class, id and role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe svg object canvas select annotation".split())
NEVER = set("head nav header footer aside form button menu dialog".split())
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot semantics".split())
MARKED = set("ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies consent notice notices alert popup modal newsletter subscribe sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments disqus share sharing social related toolbar pagination login search widget contentinfo complementary form dialog".split())
MAIN = {"article", "main"}
#: Elements that hold running text: a class like `related-work` says nothing against them, only a whole word of MARKED does.
PROSE = INLINE | set("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote table tbody thead tr td th figure figcaption".split())
#: What a block is: the page's, inside an article or main element, or furniture by its markup.
PLAIN, BODY, FURNITURE = 0, 1, 2
#: What share of a host's different pages, and how many at least, hold a block that is the site's.
SITE, LEAST = 0.9, 3


def _unwanted(name: str, attrs: str) -> bool:
    if name in NEVER:
        return True
    if not attrs or name in ("html", "body", *MAIN) and "comment" not in attrs:
        return False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if key in ("class", "id", "role"):
            for one in value.split():
                words = _WORD.findall(one)
                if name in PROSE and len(words) > 1:
                    continue
                if words and words[0] not in ("has", "with", "no") and (words[0] in MARKED or words[-1] in MARKED):
                    return True
    return False


def parts(html: str) -> list[tuple[str, int]]:
    """(text, what it is) of each block of text, in page order; scripts, styles and the like hold none."""
    out: list[tuple[str, int]] = []
    stack: list[str] = []
    off = main = 0  # depth of the outermost unwanted element; how many of MAIN are open
    held: list[str] = []

    def close() -> None:
        text = " ".join(unescape("".join(held)).split())
        held.clear()
        if text:
            out.append((text, FURNITURE if off else BODY if main > 0 else PLAIN))

    def pop(to: int) -> None:
        nonlocal off, main
        if len(stack) > to:
            close()
        for name in stack[to:]:
            main -= name in MAIN
        del stack[to:]
        if off > len(stack):
            off = 0

    at, n = 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        held.append(html[at : m.start() if m else n])
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if closing:
            if name in stack:
                k = len(stack) - 1 - stack[::-1].index(name)
                if name in INLINE and k >= off and all(x in INLINE for x in stack[k:]):
                    del stack[k:]
                else:
                    pop(k)
            elif name not in INLINE:
                close()
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at) if not m[3].endswith("/") else None
            at = end.end() if end else (n if name in ("script", "style") and not m[3].endswith("/") else at)
            continue
        if name not in INLINE:
            close()
            for k in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph, an item its predecessor
                if stack[k] == "p" or stack[k] == name and name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                    pop(k)
                    break
                if stack[k] not in INLINE:
                    break
        elif name in ("br", "wbr", "img"):
            held.append(" " if name == "br" else "")
            continue
        if name in VOID or m[3].endswith("/") and name not in INLINE:
            continue
        if not off and _unwanted(name, m[3]):
            close()
            stack.append(name)
            off = len(stack)
        else:
            stack.append(name)
            main += name in MAIN
    close()
    return out


def blocks(html: str) -> list[tuple[str, bool]]:
    """(text, is it inside an article or main element) of each block that markup does not rule out, in page order."""
    return [(t, kind == BODY) for t, kind in parts(html) if kind != FURNITURE]


def shared(a: list[int], b: list[int]) -> set[int]:
    """The places in a of a longest common subsequence with b (Hunt and Szymanski; equal ends, which always belong to one, first)."""
    low, most = 0, min(len(a), len(b))
    while low < most and a[low] == b[low]:
        low += 1
    end = 0
    while end < most - low and a[-1 - end] == b[-1 - end]:
        end += 1
    where: dict[int, list[int]] = {}
    for j in range(low, len(b) - end):
        where.setdefault(b[j], []).append(j)
    tops: list[int] = []
    links: list[tuple | None] = []
    for i in range(low, len(a) - end):
        for j in reversed(where.get(a[i], ())):
            k = bisect_left(tops, j)
            link = (i, links[k - 1] if k else None)
            if k == len(tops):
                tops.append(j)
                links.append(link)
            else:
                tops[k], links[k] = j, link
    out, link = {*range(low), *range(len(a) - end, len(a))}, links[-1] if links else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def deleted(kinds: list[int], own: list[int], before: list[int] | None, after: list[int] | None, nearer: int, site: tuple[set[int], set[int]]) -> set[int]:
    """The places of the blocks that are the site's.  before, after: the neighbours' hashes, or None; nearer: 0 before, 1
    after; site: hashes that nearly all the host's pages hold outside, and those that they hold inside, an article."""
    wanted = BODY if BODY in kinds else PLAIN
    mine = {i for i, k in enumerate(kinds) if k == wanted and own[i] not in site[wanted]}
    found = []
    for other in (before, after):
        both = set() if other is None or not set(own) & set(other) else shared(own, other)
        found.append(set() if 2 * len(both & mine) > len(mine) else both)
    return {i for i, k in enumerate(kinds) if (i in found[0] & found[1] and own[i] in site[1] if k == BODY else i in found[nearer] or own[i] in site[0])}


_ROWS = "part int, key string, page_id {}, url string, lines array<string>, kinds array<int>, hashes array<long>"


def _extract(split: list[str]):
    """split: where the parts begin, but the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                keys, lines, kinds, hashes = [], [], [], []
                for h, p, i, html in zip(*(some[k].to_pylist() for k in ("host", "path", "page_id", "html")), strict=True):
                    b = parts(html)
                    keys.append("\0".join((h, p.replace("/", "\1"), str(i), xxhash.xxh3_64_hexdigest(html))))
                    lines.append([t for t, _ in b])
                    kinds.append([k for _, k in b])
                    hashes.append([xxhash.xxh3_64_intdigest(t) - 2**63 for t, _ in b])
                part = pa.array([bisect_right(split, k) for k in keys], pa.int32())
                yield pa.record_batch({"part": part, "key": pa.array(keys, pa.string()), "page_id": some["page_id"], "url": some["url"], "lines": pa.array(lines, pa.list_(pa.string())), "kinds": pa.array(kinds, pa.list_(pa.int32())), "hashes": pa.array(hashes, pa.list_(pa.int64()))})

    return run


def _common(a: str, b: str) -> int:
    """How much of the path two keys of one host have in common; -1 for two hosts."""
    if a.partition("\0")[0] != b.partition("\0")[0]:
        return -1
    a, b = (x.split("\0")[1] for x in (a, b))
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def _differ(rows: pa.Table, sides: pa.Table) -> pa.Table:
    pages = sorted(rows.select(["key", "page_id", "url", "lines", "kinds", "hashes"]).to_pylist(), key=lambda r: r["key"])
    around = {r["side"]: r for r in sides.to_pylist() if r["side"] < 2}
    site: dict[str, list[set]] = {}
    for r in sides.to_pylist():
        if r["side"] >= 2:
            site.setdefault(r["key"], [set(), set()])[r["side"] - 2] = set(r["hashes"])
    line = [around.get(0), *pages, around.get(1)]
    out = {"page_id": [], "url": [], "text": [], "n_chars": [], "n_shared": [], "n_marked": []}
    for b, p, a in zip(line, pages, line[2:], strict=False):
        near = [-1 if x is None else _common(x["key"], p["key"]) for x in (b, a)]
        sides_ = (x["hashes"] if n >= 0 else None for x, n in zip((b, a), near, strict=True))
        gone = deleted(p["kinds"], p["hashes"], *sides_, int(near[1] > near[0]), site.get(p["key"].partition("\0")[0], (set(), set())))
        wanted = BODY if BODY in p["kinds"] else PLAIN
        left = [i for i in range(len(p["kinds"])) if i not in gone]
        kept = [i for i in left if p["kinds"][i] == wanted]
        text = "\n\n".join(p["lines"][i] for i in kept)
        for k, v in zip(out, (p["page_id"], p["url"], text, len(text), len(gone), len(left) - len(kept)), strict=True):
            out[k].append(v)
    kinds = (rows.schema.field("page_id").type, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    return pa.table({k: pa.array(v, kind) for (k, v), kind in zip(out.items(), kinds, strict=True)})


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", unit_bytes: int = 2 * C.UNIT_BYTES) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, n_shared (blocks deleted by differencing), n_marked (blocks that
    differencing left and markup rules out)."""
    kind = pages.schema[id_col].dataType.simpleString()
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"), html.alias("html"))
    n_parts = C.unit_count(rows, "html", unit_bytes)
    split: list[str] = []
    if n_parts > 1:
        order = F.concat_ws("\0", "host", F.translate("path", "/", "\1"), F.col("page_id").cast("string"))
        n = rows.count()
        sample = rows.select(order.alias("k")).where(F.pmod(F.xxhash64("k"), F.lit(max(1, n // (30 * n_parts)))) == 0).collect()  # some 30 keys a part
        keys = sorted({r["k"] for r in sample})
        split = sorted({keys[len(keys) * i // n_parts] for i in range(1, n_parts)}) if keys else []
    dealt = rows.mapInArrow(_extract(split), _ROWS.format(kind))
    found = C.Table(dealt.select("part", "key", "kinds", "hashes"), "blocks").df
    ends = found.groupBy("part").agg(F.min(F.struct("key", "hashes")).alias("a"), F.max(F.struct("key", "hashes")).alias("z"))
    # a part's neighbours are the nearest parts that have pages: one row a part is ordered, not the pages
    line = C.Table(ends, "ends").df
    have = sorted(r["part"] for r in line.select("part").collect())
    step = pages.sparkSession.createDataFrame([(a, b) for a, b in zip(have, have[1:], strict=False)] or [(-1, -1)], "lower int, upper int")
    sides = line.join(step, F.col("part") == F.col("lower")).select(F.col("upper").alias("part"), F.lit(0).alias("side"), "z.key", "z.hashes").union(line.join(step, F.col("part") == F.col("upper")).select(F.col("lower").alias("part"), F.lit(1).alias("side"), "a.key", "a.hashes"))
    # what nearly all different pages of a host hold, outside (0) and inside (1) articles: a few hashes a host, sent to the
    # parts that have pages of it
    name = F.substring_index("key", "\0", 1).alias("key")
    different = found.where("size(hashes) > 0").select(name, "hashes", "kinds").distinct()
    each = different.select("key", F.explode(F.array_distinct(F.arrays_zip("hashes", F.transform("kinds", lambda k: (k == BODY).cast("int")).alias("body")))).alias("b")).select("key", "b.hashes", "b.body")
    held = each.groupBy("key", "body", "hashes").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)
    total = different.select("key", F.explode(F.array_distinct(F.transform("kinds", lambda k: (k == BODY).cast("int")))).alias("body")).groupBy("key", "body").agg(F.count("*").alias("pages"))
    site = held.join(total, ["key", "body"]).where(F.col("n") >= F.col("pages") * SITE).groupBy("key", "body").agg(F.collect_list("hashes").alias("hashes"))
    sides = sides.union(found.select("part", name).distinct().join(site, "key").select("part", F.col("body") + 2, "key", "hashes"))
    return dealt.groupBy("part").cogroup(sides.groupBy("part")).applyInArrow(_differ, f"page_id {kind}, url string, text string, n_chars long, n_shared long, n_marked long")
