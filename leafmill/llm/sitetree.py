"""Main text of HTML pages by a site style tree.

The DOMs of a host's pages are merged by element path (tag names, classes and ids,
digits dropped; inline elements aren't part of it).  Over the host's m distinct pages
a node has
* content importance: 1 minus the mean share of pages that hold its texts; a block
  whose text stands on c of m pages has 1 - log c / log m, a path the mean of its blocks;
* presentation importance: the entropy, in units of log m, of the layouts (sequences of
  children) seen at it.
The composite importance of a path is 0.9 of its content's and 0.05 each of its own
presentation's and its parent's.

On a page, a branch's composite is multiplied by what its elements say: by MAIN inside
an article or main element, by LOW outside of it and in menus, headers, footers, asides,
forms, notices, adverts and reader comments.  Branches under THRESHOLD are removed.
Names say so only if all words of a class or id do (`cookie-notice`, not
`menu-of-the-day`).  Inside an article, a footer of its own and names that its parts may
bear (a menu of dishes, a notice) multiply by SOFT, so that the tree decides: what differs
from page to page stays, what the host repeats goes.  No name, and no form, says anything
about an article or main or what is around it, if the page has no other; nor, if the page
has none, where nothing with a letter would be left otherwise.  Reader comments are never
content.  If nothing is left of an article, all of it is.

Text: character references decoded, white space within a block one space, trimmed,
blocks joined in page order by two newlines.

Defined results: null or empty html, or no important block, gives an empty text; a
host with fewer than MIN_PAGES distinct pages has no statistics, so that all its
branches have composite importance 1; a null or malformed url is a host of its own
name; repeated rows count as one page in the statistics and get equal results; an
empty table stays empty.  Work and memory are linear in a page's length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from html import unescape
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import small_batches, written

THRESHOLD, MIN_PAGES = 0.3, 4
#: What elements multiply the composite importance by; SOFT leaves it to the tree.
MAIN, LOW, SOFT = 3.0, 0.25, 0.35
#: Composite importance from which on any branch that isn't LOW stays: the table of unimportant branches needs no others.
SURE = THRESHOLD / SOFT
#: Rows of the table of unimportant branches that may be broadcast (about 100 bytes each); a larger one is joined by host.
BROADCAST_ROWS = 100_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript xmp".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_ENDS_SAME = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
_NO_TEXT = frozenset("head script style noscript template iframe svg canvas object audio video select option textarea input".split())
_NO_USE = frozenset("nav footer aside form button dialog menu".split())
_NO_USE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
_NO_USE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar footer masthead topbar cookie cookies consent gdpr notice notices newsletter subscribe subscription signup login share sharing social related recommended comment comments disqus respond replies popup modal overlay toolbar widget pagination pager skip".split()
)
#: Words that take nothing from the names they stand with.
_PARTS = frozenset("list box block item items wrapper wrap container section area left right top bottom inner outer posts articles link links button buttons bar group panel unit slot site primary secondary global main content form thread".split())
#: Words beside which another name says nothing.
_USE_NAMES = frozenset("content article main post entry story body text page".split())
_MAIN = frozenset(("article", "main"))
#: Names and tags that parts of an article may have too.
_SOFT_NAMES = frozenset(("menu", "notice", "notices", "social", "banner"))
_SOFT_TAGS = frozenset(("footer",))
_COMMENTS = frozenset(("comment", "comments", "disqus", "respond", "replies"))
#: What an element says: nothing, that it is of no use by its names or as a form, that it is by its tag or role, or, inside an article, that it may be.
_NOTHING, _BY_NAME, _BY_TAG, _MAYBE = 0, 1, 2, 3


def _words(value: str) -> list[str]:
    return re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())


def _says(tag: str, attrs: str, in_main: bool) -> tuple[int, str, bool]:
    """What the element says, its name in paths, and whether it is a main part."""
    out, name, main = _NOTHING, tag, tag in _MAIN
    if tag in _NO_USE or (tag == "header" and not in_main):
        out = _BY_NAME if tag == "form" else _MAYBE if in_main and tag in _SOFT_TAGS else _BY_TAG
    if not attrs.strip(" /"):
        return out, name, main
    tokens: list[list[str]] = []
    for key, *values in _ATTR.findall(attrs):
        key, value = key.lower(), next((v for v in values if v), "")
        if key in ("class", "id"):
            name += ("." if key == "class" else "#") + "-".join(_words(value))
            tokens += [w for w in map(_words, value.split()) if w]
        elif key == "role":
            role = value.strip().lower()
            main = main or role == "main"
            out = _BY_TAG if role in _NO_USE_ROLES else out
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            out = _BY_TAG
    if out in (_NOTHING, _MAYBE) and tag not in ("html", "body") and not any(len(w) == 1 and w[0] in _USE_NAMES for w in tokens):
        known = _NO_USE_NAMES if in_main else _NO_USE_NAMES | {"header"}
        beside = {True: known.union(_PARTS, _USE_NAMES, ("user", "reader")), False: known.union(_PARTS)}
        found = [w for w in tokens if not known.isdisjoint(w) and beside[not _COMMENTS.isdisjoint(w)].issuperset(w)]
        if any(not _COMMENTS.isdisjoint(w) for w in found):
            out = _BY_TAG  # no size and no place makes comments content
        elif found:
            out = _MAYBE if in_main and all(known.intersection(w) <= _SOFT_NAMES for w in found) else _BY_NAME
    return out, name, main


class Page:
    """A parsed page: its elements in order (parent, path, what they say, whether main), layouts and blocks (element, text)."""

    def __init__(self, html: str):
        self.parent, self.path, self.says, self.main = [-1], [0], [_NOTHING], [False]
        self.layout: dict[int, int] = {}
        self.blocks: list[tuple[int, str]] = []
        self._parse(html)

    def _parse(self, html: str) -> None:
        stack: list[tuple[str, int, int, bool, bool]] = [("", 0, 0, False, False)]  # tag, element, its block's element, no text, in main
        opened: Counter[str] = Counter()
        text: list[str] = []

        def flush() -> None:
            if text:
                joined = " ".join(unescape("".join(text)).split())
                text.clear()
                if joined:
                    self.blocks.append((stack[-1][2], joined))

        def close(k: int) -> None:
            if any(s[0] not in _INLINE for s in stack[k:]):
                flush()
            opened.subtract(s[0] for s in stack[k:])
            del stack[k:]

        at, n = 0, len(html)
        while at < n:
            m = _TOKEN.search(html, at)
            end = m.start() if m else n
            if end > at and not stack[-1][3]:
                text.append(html[at:end])
            if not m:
                break
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                for k in range(len(stack) - 1, 0, -1) if opened[tag] > 0 else ():
                    if stack[k][0] == tag:
                        close(k)
                        break
                    if tag in _INLINE and stack[k][0] not in _INLINE:
                        break
                continue
            if tag == "br":
                if not stack[-1][3]:
                    text.append(" ")
                continue
            if tag in _ENDS_P and opened["p"] > 0:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        close(k)
                        break
                    if stack[k][0] not in _INLINE:
                        break
            if tag in _ENDS_SAME:
                ends, fence = _ENDS_SAME[tag]
                found = None
                for k in range(len(stack) - 1, 0, -1) if any(opened[e] > 0 for e in ends.split()) else ():
                    if stack[k][0] in fence:
                        break
                    if stack[k][0] in ends.split():
                        found = k
                if found is not None:
                    close(found)
            inline = tag in _INLINE
            if not inline:
                flush()
            if tag in _VOID:
                continue
            _, _, block, silent, in_main = stack[-1]
            says, name, is_main = _says(tag, m[3], in_main)
            # what an inline element holds belongs to a block with other text, so it goes by itself
            silent = silent or tag in _NO_TEXT or (inline and says != _NOTHING)
            if tag in _RAW:
                stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
                if not silent and tag != "title":
                    text.append(html[at : stop.start() if stop else n])
                    flush()
                at = stop.end() if stop else n
                continue
            element = block
            if not inline:
                element = len(self.path)
                self.parent.append(block)
                self.path.append(_key(f"{self.path[block]}/{name}"))
                self.says.append(says)
                self.main.append(is_main)
                self.layout[block] = _key(f"{self.layout.get(block, 0)} {name}")
            stack.append((tag, element, element, silent, in_main or is_main))
            opened[tag] += 1
        flush()

    def factors(self) -> list[float]:
        """What each element multiplies the importance of its blocks by."""
        n, says = len(self.path), self.says

        def low_and_main() -> tuple[list[bool], list[bool], list[bool]]:
            low, main, soft = [False] * n, [False] * n, [False] * n
            for k in range(1, n):
                low[k] = low[self.parent[k]] or says[k] in (_BY_NAME, _BY_TAG)
                main[k] = (main[self.parent[k]] or self.main[k]) and not low[k]
                soft[k] = soft[self.parent[k]] or says[k] == _MAYBE
            return low, main, soft

        low, main, soft = low_and_main()
        if not any(main) and any(self.main):
            around: set[int] = set()
            for k in range(1, n):
                up = k if self.main[k] else 0
                while up > 0 and up not in around:
                    around.add(up)
                    up = self.parent[up]
            says = [_NOTHING if s == _BY_NAME and k in around else s for k, s in enumerate(says)]
            low, main, soft = low_and_main()
        elif not any(main) and not any(any(c.isalpha() for c in t) for k, t in self.blocks if not low[k]):
            says = [_NOTHING if s == _BY_NAME else s for s in says]
            low, main, soft = low_and_main()
        other = LOW if any(main) else 1.0
        return [LOW if low[k] else SOFT if soft[k] and main[k] else MAIN if main[k] else other for k in range(n)]

    def kept(self, composite: Mapping[int, float]) -> list[str]:
        """Texts of the blocks that are important; composite: the importance of paths, where it is under SURE."""
        factor = self.factors()
        found = [t for k, t in self.blocks if composite.get(self.path[k], 1.0) * factor[k] >= THRESHOLD]
        return found or [t for k, t in self.blocks if factor[k] in (MAIN, SOFT)]


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").netloc or "").lower()
    except ValueError:
        return url or ""


def _key(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def tree(pages: DataFrame) -> DataFrame:
    """(host, path, composite): the importance of the merged trees' paths that have texts, on hosts with enough pages.

    A host with fewer than MIN_PAGES distinct pages has no rows; null html is a page without text.
    """
    small_batches(pages.sparkSession)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["host", "page", "path", "parent", "kind", "content"]
        for batch in batches:
            rows: set[tuple] = set()
            for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                page, host = Page(html or ""), host_of(url)
                factor = page.factors()
                # pages that differ in branches of no use only are one page
                key = _key("\n".join(t for k, t in page.blocks if factor[k] != LOW))
                rows.add((host, key, 0, 0, 2, key))
                rows.update((host, key, page.path[k], page.path[page.parent[k]], 0, _key(t)) for k, t in page.blocks)
                rows.update((host, key, page.path[k], page.path[page.parent[k]], 1, x) for k, x in page.layout.items())
            columns = list(zip(*rows)) or [()] * len(names)
            kinds = [pa.string(), *[pa.int64()] * 3, pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    # each distinct page of a host counts once for each of its contents and layouts
    seen = pages.select("url", "html").mapInArrow(parse, "host string, page long, path long, parent long, kind int, content long").distinct()
    c = seen.groupBy("host", "path", "kind", "content").agg(F.count("*").alias("c"), F.min("parent").alias("parent"))
    sums = lambda kind, name: (F.sum(F.when(F.col("kind") == kind, F.col("c"))).alias(f"n{name}"), F.sum(F.when(F.col("kind") == kind, F.col("c") * F.log("c"))).alias(f"e{name}"))
    per_path = written(c.groupBy("host", "path").agg(F.min("parent").alias("parent"), *sums(0, 0), *sums(1, 1), *sums(2, 2)), "site-paths")
    m = per_path.where("n2 is not null").select("host", F.col("n2").alias("m")).where(F.col("m") >= MIN_PAGES)
    nodes = per_path.join(m, "host")
    shape = F.coalesce((F.log("n1") - F.col("e1") / F.col("n1")) / F.log("m"), F.lit(0.0))
    up = nodes.select("host", F.col("path").alias("parent"), shape.alias("up"))
    scored = nodes.where("n0 is not null").withColumn("own", shape).join(up, ["host", "parent"], "left")
    composite = 0.9 * (1 - F.col("e0") / F.col("n0") / F.log("m")) + 0.05 * F.col("own") + 0.05 * F.coalesce("up", F.lit(0.0))
    return scored.select("host", "path", composite.alias("composite"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    small_batches(pages.sparkSession)
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    low = written(tree(source).where(F.col("composite") < SURE), "site-tree")

    def text_of(html: str | None, composite: Mapping[int, float]) -> str:
        return "\n\n".join(Page(html or "").kept(composite))

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def rows(ids: list, urls: list, htmls: list, trees: Iterable[Mapping[int, float]]) -> pa.RecordBatch:
        texts = [text_of(h, g) for h, g in zip(htmls, trees)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    out = "page_id long, url string, text string, n_chars long"
    if low.count() <= BROADCAST_ROWS:
        by_host: dict[str, dict[int, float]] = {}
        for r in low.collect():
            by_host.setdefault(r["host"], {})[r["path"]] = r["composite"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, urls, htmls = (c.to_pylist() for c in b.columns)
                yield rows(ids, urls, htmls, [by_host.get(host_of(u), {}) for u in urls])

        return source.mapInArrow(run, out)

    def add_host(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts = pa.array([host_of(u) for u in b.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, hosts], ["page_id", "url", "html", "host"])

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, urls, htmls, lows = (c.to_pylist() for c in b.columns)
            yield rows(ids, urls, htmls, [{g["path"]: g["composite"] for g in x or ()} for x in lows])

    hosts = low.groupBy("host").agg(F.collect_list(F.struct("path", "composite")).alias("low"))
    named = source.mapInArrow(add_host, "page_id long, url string, html string, host string")
    return named.join(hosts, "host", "left").select("page_id", "url", "html", "low").mapInArrow(run_joined, out)
