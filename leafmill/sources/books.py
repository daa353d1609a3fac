"""Book files to tables: plain text and EPUB, one row of bytes at a time in Arrow batches."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill import reachable
from leafmill.operators.structure import txt_chapters

FORMATS = {".epub": "epub", ".mobi": "mobi", ".azw3": "mobi", ".pdf": "pdf", ".txt": "txt"}
CONTAINER = "META-INF/container.xml"
NAV_DEPTH = 3
#: Media types of spine entries that hold text.
DOCUMENTS = ("application/xhtml+xml", "text/html")


def format_of(path: Column) -> Column:
    """Reader of a path by its extension; an unknown one raises, naming the known."""
    known = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    extension = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    return F.coalesce(known[extension], F.raise_error(F.concat(F.lit("unsupported format: "), extension, F.lit(f"; supported: {', '.join(sorted(FORMATS))}"))).cast("string"))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def binary_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    reachable(spark)
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")


def decode_text(raw: bytes) -> str | None:
    """Strict UTF-8, else strict GBK, else nothing; line ends become newlines."""
    for charset in ("utf-8", "gbk"):
        try:
            return raw.decode(charset).replace("\r\n", "\n").replace("\r", "\n")
        except UnicodeDecodeError:
            pass
    return None


def read_txt(spark: SparkSession, path: str) -> DataFrame:
    return txt_texts(binary_files(spark, path, "*.[tT][xX][tT]"))


def txt_texts(files: DataFrame) -> DataFrame:
    """(book_id, path, text) of (path, content) rows: book_id is the file's stem; undecodable files have null text."""
    reachable(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decode_text(x or b"") for x in b.column(1).to_pylist()], pa.string())], ["path", "text"])

    rows = files.mapInArrow(run, "path string, text string")
    return rows.select(stem(F.col("path")).alias("book_id"), "path", "text")


def txt_book_chapters(spark: SparkSession, path: str) -> DataFrame:
    return txt_chapters(read_txt(spark, path).where(F.col("text").rlike(r"(?U)\S")).select("book_id", "text"))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _find(node: ET.Element, name: str) -> Iterator[ET.Element]:
    return (e for e in node.iter() if _local(e.tag) == name)


def _item(z: zipfile.ZipFile, name: str) -> bytes:
    try:
        return z.read(name)
    except KeyError:
        return b""


def _ncx(raw: bytes) -> list[tuple[str, str]]:
    """Top-level entries of an NCX that have a title and a place."""
    out = []
    for nav in _find(ET.fromstring(raw), "navMap"):
        for point in (p for p in nav if _local(p.tag) == "navPoint"):
            label = next((t.text or "" for n in point if _local(n.tag) == "navLabel" for t in _find(n, "text")), "")
            src = next((c.get("src", "") for c in point if _local(c.tag) == "content"), None)
            if label.strip() and src is not None:
                out.append((label.strip(), src))
    return out


def _nav(raw: bytes) -> list[tuple[str, str]]:
    """Entries of an EPUB 3 navigation document, in reading order, four levels deep."""
    root = ET.fromstring(raw)
    navs = [n for n in _find(root, "nav") if any(_local(c.tag) == "ol" for c in n)]
    typed = [n for n in navs if any(_local(k) == "type" and "toc" in v.split() for k, v in n.attrib.items())]
    out: list[tuple[str, str]] = []

    def walk(ol: ET.Element, depth: int) -> None:
        for li in (c for c in ol if _local(c.tag) == "li"):
            a = next((c for c in li if _local(c.tag) == "a"), None)
            if a is not None and (a.text or "").strip() and a.get("href"):
                out.append((a.text.strip(), a.get("href")))
            if depth < NAV_DEPTH:
                for sub in (c for c in li if _local(c.tag) == "ol"):
                    walk(sub, depth + 1)

    for nav in (typed or navs)[:1]:
        walk(next(c for c in nav if _local(c.tag) == "ol"), 0)
    return out


class _Body(HTMLParser):
    """Text nodes of the body (of all, if there is none), and the texts of the first title, h1, h2 and h3."""

    def __init__(self) -> None:
        super().__init__()
        self.all: list[str] = []
        self.body: list[str] = []
        self.heads: dict[str, str] = {}
        self.taken: set[str] = set()
        self.open: list[str] = []
        self.has_body = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.has_body = self.has_body or tag == "body"
        self.open.append(tag)
        if tag in ("title", "h1", "h2", "h3") and tag not in self.heads:
            self.heads[tag] = ""
            self.taken.add(tag)

    def handle_endtag(self, tag: str) -> None:
        while tag in self.open and self.open.pop() != tag:
            pass
        self.taken.discard(tag)

    def handle_data(self, data: str) -> None:
        text = data.strip()
        if text:
            self.all.append(text)
            if "body" in self.open:
                self.body.append(text)
            for h in self.taken:
                self.heads[h] += text


def xhtml_parts(raw: bytes) -> tuple[str, str]:
    """(text, title) of a document; the title is the first non-empty of title, h1, h2, h3."""
    p = _Body()
    p.feed(raw.decode("utf-8", "replace"))
    p.close()
    text = " ".join(" ".join(p.body if p.has_body else p.all).split())
    return text, next((p.heads[h] for h in ("title", "h1", "h2", "h3") if p.heads.get(h)), "")[:100]


def cover_href(items: list[dict]) -> str | None:
    """The first image of the manifest that is named so, else the only image."""
    images = [i for i in items if i["media_type"].startswith("image/")]
    named = [i["href"] for i in images if "cover" in f"{i['item_id']} {i['href']}".lower()]
    return named[0] if named else images[0]["href"] if len(images) == 1 else None


def parse_epub(raw: bytes | io.IOBase, parts: frozenset[str] = frozenset(("meta", "items", "spine", "toc"))) -> dict:
    """meta, items, spine and toc rows of one EPUB, given as bytes or an open file; `cover`, its bytes, if asked for.

    Only the members that the asked parts need are read.
    """
    z = zipfile.ZipFile(io.BytesIO(raw) if isinstance(raw, bytes) else raw)
    opf = next(e.get("full-path", "") for e in _find(ET.fromstring(z.read(CONTAINER)), "rootfile"))
    base, root = posixpath.dirname(opf), ET.fromstring(z.read(opf))
    at = lambda href: posixpath.normpath(posixpath.join(base, unquote(href))) if href else ""
    meta = [{"key": _local(e.tag), "value": (e.text or "").strip()} for m in _find(root, "metadata") for e in m if (e.text or "").strip()]
    items = [{"ord": i, "item_id": e.get("id", ""), "href": e.get("href", ""), "media_type": e.get("media-type", ""), "properties": e.get("properties", "")} for i, e in enumerate(e for m in _find(root, "manifest") for e in m if _local(e.tag) == "item")]
    by_id = {i["item_id"]: i for i in items}
    spine_node = next(_find(root, "spine"), None)
    refs = [e.get("idref", "") for e in spine_node] if spine_node is not None else []
    spine = []
    for ref in (r for r in refs if "spine" in parts and r in by_id and by_id[r]["media_type"] in DOCUMENTS):
        text, title = xhtml_parts(_item(z, at(by_id[ref]["href"])))
        spine.append({"ord": len(spine), "href": by_id[ref]["href"], "title": title, "text": text})
    toc: list[tuple[str, str]] = []
    ncx = by_id.get(spine_node.get("toc", "")) if spine_node is not None else None
    # the first that can be read counts, even if it has no entries
    for item, read in [(ncx, _ncx), *((i, _nav) for i in items if "nav" in i["properties"])]:
        if item and "toc" in parts:
            try:
                toc = read(_item(z, at(item["href"])))
                break
            except ET.ParseError:
                continue
    out = {"meta": meta, "items": items, "spine": spine, "toc": [{"ord": i, "title": t, "href": h} for i, (t, h) in enumerate(toc)]}
    if "cover" in parts:
        href = cover_href(items)
        out["cover"] = _item(z, at(href)) or None if href else None
    return out


_EPUB = "struct<meta:array<struct<key:string,value:string>>,items:array<struct<ord:int,item_id:string,href:string,media_type:string,properties:string>>,spine:array<struct<ord:int,href:string,title:string,text:string>>,toc:array<struct<ord:int,title:string,href:string>>>"


def read_epub(spark: SparkSession, path: str) -> DataFrame:
    return epub_books(binary_files(spark, path, "*.[eE][pP][uU][bB]"))


def epub_books(files: DataFrame) -> DataFrame:
    """(book_id, path, epub struct, error) of (path, content) rows of EPUB files; a broken file has a null struct and its error."""
    reachable(files.sparkSession)
    strings = lambda *names: pa.list_(pa.struct([(n, pa.int32() if n == "ord" else pa.string()) for n in names]))
    kind = pa.struct([("meta", strings("key", "value")), ("items", strings("ord", "item_id", "href", "media_type", "properties")), ("spine", strings("ord", "href", "title", "text")), ("toc", strings("ord", "title", "href"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            books, errors = [], []
            for raw in b.column(1).to_pylist():
                try:
                    books.append(parse_epub(raw or b""))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  whatever is wrong with a book is its row's error
                    books.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(books, kind), pa.array(errors, pa.string())], ["path", "epub", "error"])

    rows = files.mapInArrow(run, f"path string, epub {_EPUB}, error string")
    return rows.select(stem(F.col("path")).alias("book_id"), "*")


def epub_table(books: DataFrame, name: str) -> DataFrame:
    """The items, spine or toc rows of read_epub()'s books."""
    return books.where("epub is not null").select("book_id", F.inline(F.col(f"epub.{name}")))


def metadata(books: DataFrame) -> DataFrame:
    """Title (else the file's stem) and author (author, then creator, else from the file name)."""
    from leafmill.functions.labels import author_from_name

    value = lambda key: F.element_at(F.transform(F.filter("epub.meta", lambda m: m["key"] == key), lambda m: m["value"]), 1)
    first = lambda key: F.when(F.exists("epub.meta", lambda m: m["key"] == key), value(key))
    return books.select("book_id", F.coalesce(first("title"), "book_id").alias("title"), F.coalesce(first("author"), first("creator"), author_from_name(F.col("book_id"))).alias("author"))


def covers(items: DataFrame) -> DataFrame:
    """Cover of each book: the first image of the manifest named so, else the only image."""
    images = items.where(F.col("media_type").startswith("image/"))
    named = F.lower(F.concat_ws(" ", "item_id", "href")).contains("cover")
    agg = images.groupBy("book_id").agg(F.min_by("href", F.when(named, F.col("ord"))).alias("named"), F.count("*").alias("n"), F.min("href").alias("only"))
    return agg.select("book_id", F.coalesce("named", F.when(F.col("n") == 1, F.col("only"))).alias("cover"))
