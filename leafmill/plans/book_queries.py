"""Queries of the readers (S1-S6, S9), saved books (K1, K3) and tempo chains (E20).

The files are rows of bytes made here; the SQL states what is to be read from them.
"""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import audio
from leafmill.plans.base import Query, table
from leafmill.plans.inline import Rows
from leafmill.sources import books, documents, reader
from leafmill.sources.shared import shared_path

_PACKAGE = """<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata>{meta}</metadata>
<manifest>{items}</manifest><spine{ncx}>{refs}</spine></package>"""
_NCX = """<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap>{points}</navMap></ncx>"""
_NAV = """<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="landmarks"><ol><li><a href="c1.xhtml">Landmark</a></li></ol></nav>
<nav epub:type="toc"><ol><li><a href="c1.xhtml">Opening</a><ol><li><a href="c1.xhtml#s2">Inner</a></li></ol></li><li><a href="c2.xhtml"> </a></li><li><a>No place</a></li><li><a href="c2.xhtml">Ending</a></li></ol></nav></body></html>"""


def _point(title: str, src: str | None) -> str:
    return f"<navPoint><navLabel><text>{title}</text></navLabel>{'' if src is None else f'<content src="{src}"/>'}</navPoint>"


def _epub(meta: str, items: list[tuple[str, str, str, str]], refs: list[str], members: dict[str, str], ncx: str = "") -> bytes:
    """An EPUB of (id, href, media type, properties) items in the folder OPS."""
    manifest = "".join(f'<item id="{i}" href="{h}" media-type="{m}" properties="{p}"/>' for i, h, m, p in items)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(books.CONTAINER, '<container><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>')
        z.writestr("OPS/book.opf", _PACKAGE.format(meta=meta, items=manifest, ncx=f' toc="{ncx}"' if ncx else "", refs="".join(f'<itemref idref="{r}"/>' for r in refs)))
        for name, text in members.items():
            z.writestr(f"OPS/{name}", text)
    return out.getvalue()


_X, _P = "application/xhtml+xml", "image/png"


def _epub_files() -> list[tuple[str, bytes]]:
    ncx = _epub(
        "<dc:title>A Title</dc:title><dc:creator>An Author</dc:creator>",
        [("n", "toc.ncx", "application/x-dtbncx+xml", ""), ("i2", "z-cover.png", _P, ""), ("i1", "a-cover.png", _P, ""), ("c1", "c1.xhtml", _X, ""), ("c2", "c2.xhtml", _X, ""), ("c3", "c3.xhtml", _X, "")],
        ["c1", "i1", "gone", "c2", "c3"],
        {
            "toc.ncx": _NCX.format(points=_point("One", "c1.xhtml") + _point("", "c2.xhtml") + _point("Placeless", None) + _point(" Two ", "c2.xhtml#top")),
            "c1.xhtml": "<html><head><title>Page one</title></head><body><h1>Head</h1><p>Some <b>bold</b>\n text.</p></body></html>",
            "c2.xhtml": "<html><body><h1>First</h1><h1>Second</h1><p>More.</p></body></html>",
            "c3.xhtml": "<p>No body here</p>",
        },
        "n",
    )
    nav = _epub(
        "<dc:language>en</dc:language>",
        [("nav", "nav.xhtml", _X, "nav"), ("pic", "only.png", _P, ""), ("c1", "c1.xhtml", _X, ""), ("c2", "c2.xhtml", _X, "")],
        ["c1", "c2"],
        {"nav.xhtml": _NAV, "c1.xhtml": "<body><h2>Two</h2>text</body>", "c2.xhtml": "<body></body>"},
    )
    empty = _epub("<dc:title>Bare</dc:title>", [("n", "toc.ncx", "x", ""), ("nav", "nav.xhtml", _X, "nav")], [], {"toc.ncx": _NCX.format(points=""), "nav.xhtml": _NAV}, "n")
    return [("/in/ncx.epub", ncx), ("/in/nav (Ann Lee).EPUB", nav), ("/in/empty.epub", empty), ("/in/broken.epub", b"not an archive"), ("/in/cut.epub", ncx[:200]), ("/in/none.epub", b"")]


_TXT_FILES = [
    ("/in/plain.txt", "one\r\ntwo\rthree\n".encode()),
    ("/in/wide.v2.TXT", "第一章 开始".encode("gbk")),
    ("/in/utf.txt", "第一章 é".encode()),
    ("/in/bad.txt", b"\xff\xff\xfe"),
    ("/in/empty.txt", b""),
]
_TXT_ROWS = Rows("book_id string, text string", ("plain", "one\ntwo\nthree\n"), ("wide.v2", "第一章 开始"), ("utf", "第一章 é"), ("bad", None), ("empty", ""))
_READ = Rows("book_id string, n_items int, n_spine int, n_toc int, failed boolean", ("ncx", 6, 3, 2, False), ("nav (Ann Lee)", 4, 2, 3, False), ("empty", 2, 0, 0, False), ("broken", None, None, None, True), ("cut", None, None, None, True), ("none", None, None, None, True))
_SPINE = Rows(
    "book_id string, ord int, href string, title string, text string",
    ("ncx", 0, "c1.xhtml", "Page one", "Head Some bold text."), ("ncx", 1, "c2.xhtml", "First", "First Second More."), ("ncx", 2, "c3.xhtml", "", "No body here"),
    ("nav (Ann Lee)", 0, "c1.xhtml", "Two", "Two text"), ("nav (Ann Lee)", 1, "c2.xhtml", "", ""),
)
_NCX_ROWS = Rows("book_id string, ord int, title string, href string", ("ncx", 0, "One", "c1.xhtml"), ("ncx", 1, "Two", "c2.xhtml#top"))
_NAV_ROWS = Rows("book_id string, ord int, title string, href string", ("nav (Ann Lee)", 0, "Opening", "c1.xhtml"), ("nav (Ann Lee)", 1, "Inner", "c1.xhtml#s2"), ("nav (Ann Lee)", 2, "Ending", "c2.xhtml"))
_META = Rows("book_id string, title string, author string", ("ncx", "A Title", "An Author"), ("nav (Ann Lee)", "nav (Ann Lee)", "Ann Lee"), ("empty", "Bare", "Unknown"))
_COVERS = Rows("book_id string, cover string", ("ncx", "z-cover.png"), ("nav (Ann Lee)", "only.png"))
_PATHS = Rows("path string", ("/a/b.epub",), ("C.EPUB",), ("x.y.mobi",), ("x.azw3",), ("dir.pdf/book.Txt",), ("p.pdf",))
_SAVED = Rows(
    "id string, title string, idx int, chapter string, char_count int, edited boolean, text string",
    ("a", 'Quote " and \\', 0, "One", 3, False, "abc"), ("a", 'Quote " and \\', 1, "Zwei é", 0, True, ""), ("b", "第一本", 0, "第一章", 2, None, "开始"), ("c", "", 0, "\n", 1, False, None),
)
_SPEEDS = Rows("speed double", (0.1,), (0.2,), (0.25,), (0.3,), (0.5,), (0.75,), (1.0,), (1.5,), (2.0,), (2.5,), (4.0,), (5.0,), (8.0,), (None,))
_MANIFESTS = Rows("book_id string, selected array<int>, completed array<int>", ("a", [2, 0], [0, 0, 2, 0]), ("b", [], []), ("c", [1], None))


def _files(spark: SparkSession, files: list[tuple[str, bytes]]) -> DataFrame:
    return spark.createDataFrame(files, "path string, content binary")


def _books(spark: SparkSession) -> DataFrame:
    return books.epub_books(_files(spark, _epub_files()))


def _read(spark: SparkSession, d: str) -> DataFrame:
    size = lambda name: F.when(F.col("epub").isNotNull(), F.size(f"epub.{name}"))
    return _books(spark).select("book_id", size("items").alias("n_items"), size("spine").alias("n_spine"), size("toc").alias("n_toc"), F.col("error").isNotNull().alias("failed"))


def _toc(spark: SparkSession, with_ncx: bool) -> DataFrame:
    some = _books(spark).where("epub is not null").where(F.exists("epub.items", lambda i: i["href"] == "toc.ncx") == with_ncx)
    return books.epub_table(some, "toc").select("book_id", "ord", "title", "href")


def _saved(spark: SparkSession, d: str) -> DataFrame:
    """Books saved as JSON and read again; what a chapter's text becomes is told from the JSON itself."""
    chapter = F.struct(F.col("idx").alias("index"), F.col("chapter").alias("title"), "char_count", F.lit(None).cast("double").alias("estimated_duration_seconds"), "edited", "text")
    whole = _SAVED.frame(spark).groupBy("id", "title").agg(F.array_sort(F.collect_list(chapter)).alias("chapters"))
    held = documents.slim(whole).select(F.to_json(F.struct("id", "title", "chapters")).alias("j"))
    back = held.select("j", F.from_json("j", documents.BOOK).alias("b"))
    rows = back.select("j", "b.id", F.col("b.title").alias("book_title"), F.inline("b.chapters"))
    return rows.select("id", F.col("book_title").alias("title"), F.col("index").alias("idx"), F.col("title").alias("chapter"), "char_count", "edited", F.col("j").contains('"text"').alias("has_text"))


def _manifests(spark: SparkSession, d: str) -> DataFrame:
    held = _MANIFESTS.frame(spark).select(F.to_json(F.struct("book_id", F.col("selected").alias("selected_chapters"), F.col("completed").alias("completed_chapters"))).alias("j"))
    back = documents.ordered(held.select(F.from_json("j", documents.MANIFEST).alias("m")).select("m.*"))
    return back.select("book_id", F.to_json("selected_chapters").alias("selected"), F.to_json("completed_chapters").alias("completed"))


def _book_source(spark: SparkSession, d: str) -> DataFrame:
    """The documents as plain text files of their languages, read back as books by the data source."""
    folder = shared_path(spark, "book-files")
    texts = table(spark, d, "documents").select(F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    texts.write.option("maxRecordsPerFile", 5000).partitionBy("lang").text(folder)
    reader.register(spark)
    files = spark.read.format("book").schema("path string, format string, text string, error string").load(folder)
    lang = F.regexp_extract("path", "/lang=([^/]*)/", 1)
    return files.groupBy(lang.alias("lang"), "format").agg(F.sum(F.length("text")).alias("chars"), F.sum(F.regexp_count("text", F.lit(r"\n"))).alias("lines"), F.count("error").alias("errors"))


_LF = "replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
_SPARE = "greatest(ceil(log2({x}) - 1e-12)::INTEGER - 1, 0)"
_UP, _DOWN = _SPARE.format(x="speed"), _SPARE.format(x="(1 / speed)")

QUERIES = {
    "s1_format": Query(
        lambda spark, d: _PATHS.frame(spark).select("path", books.format_of(F.col("path")).alias("format")),
        f"SELECT path, CASE lower(regexp_extract(path, '(\\.[^./]*)$', 1)) WHEN '.epub' THEN 'epub' WHEN '.mobi' THEN 'mobi' WHEN '.azw3' THEN 'mobi' WHEN '.pdf' THEN 'pdf' WHEN '.txt' THEN 'txt' END AS format FROM {_PATHS.sql}",
    ),
    "s1_book_source": Query(
        _book_source,
        f"SELECT coalesce(lang, 'none') AS lang, 'txt' AS format, sum(length({_LF}) + 1)::BIGINT AS chars, sum(length({_LF}) - length(replace({_LF}, chr(10), '')) + 1)::BIGINT AS lines, 0::BIGINT AS errors FROM documents GROUP BY 1",
    ),
    "s2_txt_read": Query(lambda spark, d: books.txt_texts(_files(spark, _TXT_FILES)).select("book_id", "text"), f"SELECT * FROM {_TXT_ROWS.sql}"),
    "s3_epub_read": Query(_read, f"SELECT * FROM {_READ.sql}"),
    "s3_epub_spine": Query(lambda spark, d: books.epub_table(_books(spark), "spine").select("book_id", "ord", "href", "title", "text"), f"SELECT * FROM {_SPINE.sql}"),
    "s4_ncx_toc": Query(lambda spark, d: _toc(spark, True), f"SELECT * FROM {_NCX_ROWS.sql}"),
    "s5_nav_toc": Query(lambda spark, d: _toc(spark, False), f"SELECT * FROM {_NAV_ROWS.sql}"),
    "s6_metadata": Query(lambda spark, d: books.metadata(_books(spark).where("epub is not null")), f"SELECT * FROM {_META.sql}"),
    "s9_covers": Query(lambda spark, d: books.covers(books.epub_table(_books(spark), "items")), f"SELECT * FROM {_COVERS.sql}"),
    "k1_save_book": Query(_saved, f"SELECT id, title, idx, chapter, char_count, edited, FALSE AS has_text FROM {_SAVED.sql}"),
    "k3_manifest": Query(
        _manifests,
        "SELECT book_id, '[' || array_to_string(selected, ',') || ']' AS selected, '[' || array_to_string(list_filter(completed, lambda x, i: list_position(completed, x) = i), ',') || ']' AS completed FROM " + _MANIFESTS.sql,
    ),
    "e20_tempo_chain": Query(
        lambda spark, d: _SPEEDS.frame(spark).where("speed is not null").select("speed", audio.tempo_chain(F.col("speed")).alias("chain")),
        f"SELECT speed, repeat('atempo=2.0000,', {_UP}) || repeat('atempo=0.5000,', {_DOWN}) || printf('atempo=%.4f', speed / pow(2, {_UP}) * pow(2, {_DOWN})) AS chain FROM {_SPEEDS.sql} WHERE speed IS NOT NULL",
    ),
}
