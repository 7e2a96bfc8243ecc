"""Operator 2: main text of web pages by nearest-URL page differencing.

Pages are ordered by host, URL path and id.  A page is compared with its
nearest neighbours in that order, the page before and the page after it on the
same host: their text lines (one per block element) are aligned by longest
common subsequence, and lines of the alignment are deleted as the site's
furniture.  Between two neighbours that differ from each other a line goes only
if both share it, so a near copy on one side deletes nothing; the first and
last page of a host have one neighbour, whose lines decide alone.  The page's own
heading (``h1`` in its article) and lines equal to it stay.  Copies (pages with the same candidate lines) say nothing of each
other, and neither do pages without lines: the neighbour is the nearest page on
that side beyond them, however many there are.

What the tags say outright is used as well: lines in navigation, footers,
asides, forms, scripts, and blocks whose class or id names them as advert,
sidebar, comments, notice and the like are no candidates (names are class, id or
role tokens and their parts at hyphens, but for tokens like ``no-sidebar`` that hold a modifier).  Where a page marks its text as ``article`` or ``main``,
lines outside are none, and names of wrappers around it, forms too, do not hold inside; an
article within an article, or in or named as comments or related pages, is none of the page's own.  Differencing
decides all lines that are left, marked or not.

Character references are decoded, white space inside a block becomes one
space, blocks are trimmed and joined in page order by a newline.  Null or empty
html gives empty text; a null or host-less URL puts the page on the empty host.
Repeated rows come back one for one, as copies.  Pages are
handled whole; unclosed and truncated markup is read as far as it goes.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurescape.llm.common import in_order
from featurescape.session import materialize

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)"
                    r"((?:=\s*\"[^\"]*\"|=\s*'[^']*'|=|[^>=]+)*+)(?:>|\Z)", re.S)    # a quote opens after = only
_RAW = re.compile(r"</(script|style|title|textarea|noscript|template|iframe|svg|math)\s*>", re.I)
_RAW_NAMES = frozenset("script style title textarea noscript template iframe svg math".split())
_BLOCKS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl
    dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li
    main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul""".split())
_CONTAINERS = frozenset("""article aside button details dialog div dl fieldset figure footer form header head
    main menu nav ol section select span table tbody thead tfoot tr td ul""".split())
_FURNITURE = frozenset("aside button dialog footer form head menu nav select".split())
_MAIN = frozenset(("article", "main"))
_BODY = frozenset("article blockquote h2 h3 h4 h5 h6 main ol p pre section table ul".split())   # end an open h1
_NAMED = frozenset("""ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments
    consent cookie cookies copyright disclaimer disqus footer gdpr header masthead menu modal nav navbar
    navigation newsletter notice notification pagination pager popup promo promoted promotion related share
    sharing sidebar signup social sponsor sponsored subscribe toolbar widget""".split())
_OTHERS = frozenset("comment comments disqus related".split())   # hold articles that are not the page's
_MODIFIERS = frozenset("free has hide is layout no not with without wrap wrapper".split())
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def _tokens(attributes: str) -> set[str]:
    """Whole class, id and role tokens, and the parts of those that hold no modifier."""
    found = set()
    for m in _ATTRIBUTE.finditer(attributes):
        for token in (m[1] or m[2] or m[3] or "").lower().split():
            parts = [w for w in re.split("[-_]+", token) if w]
            found.update((token,) if _MODIFIERS.intersection(parts) else (token, *parts))
    return found


def lines_of(page: str | None) -> list[tuple[str, bool, bool]]:
    """(text, in a main element, heading of one) of each candidate line of a page."""
    page = page or ""
    out: list[tuple[str, bool, bool]] = []
    held: list[str] = []
    stack: list[tuple[str, int, int, int]] = []                # name; what it added to these three:
    opened: dict[str, int] = {}                                # how many of a name are on the stack
    furniture = main = barred = 0                              # barred: no article in it is the page's
    heading = False

    def flush():
        if held:
            text = " ".join(html_lib.unescape("".join(held)).split())
            held.clear()
            if text and not furniture:
                out.append((text, main > 0, heading and main > 0))

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at:m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if name in _RAW_NAMES:
            if not m[1] and not m[3].endswith("/"):
                end = next((e for e in _RAW.finditer(page, at) if e[1].lower() == name), None)
                at = end.end() if end else len(page)
            continue
        if name == "br":
            held.append(" ")
            continue
        if name in _BLOCKS:
            flush()
            if name == "h1" or name in _BODY:
                heading = name == "h1" and not m[1]
        if name not in _CONTAINERS or m[3].endswith("/"):
            continue
        if m[1]:
            if opened.get(name):
                flush()
                while True:
                    top = stack.pop()
                    opened[top[0]] -= 1
                    furniture -= top[1]
                    main -= top[2]
                    barred -= top[3]
                    if top[0] == name:
                        break
        else:
            named = _tokens(m[3])
            in_main = bar = 0
            if name in _MAIN:
                # An article in an article, or named as a comment, is not the page's own.
                bar = int(bool(named & _OTHERS) or name == "article" and bool(opened.get(name)))
                in_main = int(not bar and not barred)
                waste = -furniture if in_main else bar         # a wrapper's name does not hold for the text in it
            else:
                tag = (name in _FURNITURE and name != "form") or (name == "header" and not main)
                bar = int(tag or bool(named & _OTHERS))
                waste = int(bar or name == "form" or bool(named & _NAMED))
            if waste > 0:
                flush()
            stack.append((name, waste, in_main, bar))
            opened[name] = opened.get(name, 0) + 1
            furniture += waste
            main += in_main
            barred += bar
    flush()
    return out


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in ``a`` of a longest common subsequence of the lines of both: equal
    ends, and between them Hunt and Szymanski's longest increasing run of the matches."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    found = set(range(head)) | set(range(len(a) - tail, len(a)))
    return found | {head + i for i in _matched(a[head:len(a) - tail], b[head:len(b) - tail])}


def _matched(a: list[str], b: list[str]) -> set[int]:
    places: dict[str, list[int]] = {}
    for j, line in enumerate(b):
        places.setdefault(line, []).append(j)
    ends: list[int] = []                                       # last place in b, by length
    links: list[tuple] = []
    for i, line in enumerate(a):
        for j in reversed(places.get(line, ())):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    found, link = set(), links[-1] if links else None
    while link:
        found.add(link[0])
        link = link[1]
    return found


def candidates(page: list[tuple[str, bool, bool]]) -> list[str]:
    """The lines differencing decides: those in main elements if there are any."""
    inside = [t for t, main, _ in page if main]
    return inside or [t for t, _, _ in page]


def headings(page: list[tuple[str, bool, bool]]) -> frozenset[str]:
    """The page's own headings."""
    return frozenset(t for t, _, heading in page if heading)


def main_text(texts: list[str], neighbours: list[list[str]], own: frozenset[str] = frozenset()) -> str:
    """Text of a page's candidate lines, given the lines of its neighbours and its own
    headings.  Beside two neighbours unlike each other, only what both share goes."""
    shared = [common_lines(texts, other) for other in neighbours]
    if len(shared) == 2 and neighbours[0] != neighbours[1]:
        gone = shared[0] & shared[1]
    else:
        gone = set().union(*shared)
    return "\n".join(t for i, t in enumerate(texts) if i not in gone or t in own)


def _signatures(batches):
    """Digest of each page's candidate lines, null without any."""
    for b in batches:
        found = [candidates(lines_of(page)) for page in b.column("html").to_pylist()]
        marks = [hashlib.blake2b("\n".join(t).encode("utf-8", "replace"), digest_size=16).digest() if t else None
                 for t in found]
        yield pa.RecordBatch.from_arrays([b.column("_key"), pa.array(marks, pa.binary())], names=["_key", "mark"])


def _extract(batches):
    names = ["id", "url", "text", "n_chars"]
    place = left = texts = last = own = None    # of the run of copies that is open
    run: list[tuple] = []                       # (id, url) of its rows
    out: list[tuple] = []

    def close(right):
        if run:
            text = main_text(texts, [p for p in (left, right) if p is not None], own)
            out.extend((key, url, text, len(text)) for key, url in run)
            run.clear()

    def ready(least):
        while len(out) >= least:
            cols = list(zip(*out[:500]))
            del out[:500]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int64()))],
                names=names)

    for b in batches:
        cols = [b.column(c) for c in ("_bucket", "host", "_side", "id", "url", "html")]
        for i in range(b.num_rows):
            bucket, host, side, key, url, page = (c[i].as_py() for c in cols)
            lines = lines_of(page)
            mine, whole = candidates(lines), [t for t, _, _ in lines]
            if not mine:
                if side == 0:
                    out.append((key, url, "", 0))
            else:
                if place != (bucket, host):
                    close(None)
                    place, left, texts, own = (bucket, host), None, mine, headings(lines)
                elif texts != mine:
                    close(whole)
                    left, texts, own = last, mine, headings(lines)
                last = whole
                if side == 0:
                    run.append((key, url))
            yield from ready(500)
    close(None)
    yield from ready(1)


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
               html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    url = F.coalesce(F.col("url"), F.lit(""))
    src = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"),
                       F.col(html_col).alias("html"))
    src = src.withColumn("host", F.lower(F.regexp_extract(
        url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)))
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    key = [F.col("host"), path, F.coalesce("id", F.lit(-1)), F.xxhash64("url", "html")]
    marked = src.select(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(key)]).alias("_key"), "html")
    kind = marked.schema["_key"].dataType.simpleString()
    marks = materialize(marked.mapInArrow(_signatures, f"_key {kind}, mark binary"))
    ordered = in_order(src, key, before=True, marks=marks.where("mark is not null"))
    found = ordered.select("_bucket", "host", "_side", "id", "url", "html").mapInArrow(
        _extract, "id long, url string, text string, n_chars long")
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
