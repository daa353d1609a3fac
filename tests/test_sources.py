"""Readers, documents and the inbox stream on files made here."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from leafmill.operators import structure as st
from leafmill.sources import books, documents
from leafmill.streaming import inbox

OPF = """<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>A Title</dc:title><dc:creator>An Author</dc:creator></metadata>
<manifest><item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="c1" href="c1.xhtml" media-type="application/xhtml+xml"/><item id="c2" href="c2.xhtml" media-type="application/xhtml+xml"/>
<item id="x" href="gone.xhtml" media-type="application/xhtml+xml"/><item id="img" href="my-cover.png" media-type="image/png"/><item id="i2" href="b.png" media-type="image/png"/>{ncx}</manifest>
<spine{toc}><itemref idref="c1"/><itemref idref="nope"/><itemref idref="c2"/><itemref idref="x"/></spine></package>"""
NAV = """<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><ol><li><a href="c1.xhtml">First<b>!</b></a><ol><li><a href="c2.xhtml#s">Nested</a></li></ol></li></ol></nav></body></html>"""
NCX = """<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text>One</text></navLabel><content src="c1.xhtml"/><navPoint><navLabel><text>Deep</text></navLabel><content src="c2.xhtml"/></navPoint></navPoint></navMap></ncx>"""
PAGE = "<html><head><title>{t}</title></head><body><h1>Head</h1><p>Some <b>bold</b> text of {t}.</p></body></html>"


def epub(path, ncx=False):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>')
        z.writestr("OPS/book.opf", OPF.format(ncx='<item id="ncx" href="toc.ncx" media-type="x"/>' if ncx else "", toc=' toc="ncx"' if ncx else ""))
        z.writestr("OPS/nav.xhtml", NAV)
        z.writestr("OPS/toc.ncx", NCX)
        z.writestr("OPS/c1.xhtml", PAGE.format(t="one"))
        z.writestr("OPS/c2.xhtml", PAGE.format(t=""))


def test_epub(spark, tmp_path):
    epub(tmp_path / "a.epub")
    epub(tmp_path / "b.epub", ncx=True)
    (tmp_path / "bad.epub").write_bytes(b"no zip")
    found = books.read_epub(spark, str(tmp_path)).cache()
    assert [r["book_id"] for r in found.where("error is not null").collect()] == ["bad"]
    toc = {(r["book_id"], r["ord"]): (r["title"], r["href"]) for r in books.epub_table(found, "toc").collect()}
    assert toc == {("a", 0): ("First", "c1.xhtml"), ("a", 1): ("Nested", "c2.xhtml#s"), ("b", 0): ("One", "c1.xhtml")}
    spine = books.epub_table(found, "spine").where("book_id = 'a'").orderBy("ord").collect()
    assert [(r["href"], r["title"], r["text"]) for r in spine] == [("c1.xhtml", "one", "Head Some bold text of one."), ("c2.xhtml", "Head", "Head Some bold text of ."), ("gone.xhtml", "", "")]
    assert books.metadata(found.where("book_id = 'a'")).collect()[0][1:] == ("A Title", "An Author")
    assert books.covers(books.epub_table(found, "items")).where("book_id = 'a'").head()["cover"] == "my-cover.png"
    chapters = st.epub_chapters(books.epub_table(found, "spine"), books.epub_table(found, "toc"))
    assert [r["title"] for r in chapters.where("book_id = 'a'").orderBy("idx").collect()] == ["First", "Nested"]


def test_epub_readings(spark, tmp_path):
    """First cover of the manifest, first heading, entries with title and place, empty NCX, pictures in the spine, damage."""
    page = "<html><body><h1>Fi<i>rst</i></h1><h1>Second</h1><p>Some text.</p></body></html>"
    opf = """<package xmlns="http://www.idpf.org/2007/opf"><metadata/><manifest><item id="z" href="z-cover.png" media-type="image/png"/><item id="a" href="a-cover.png" media-type="image/png"/>
<item id="c" href="c.xhtml" media-type="application/xhtml+xml"/><item id="n" href="n.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="x" href="t.ncx" media-type="x"/></manifest><spine{}><itemref idref="z"/><itemref idref="c"/></spine></package>"""
    nav = '<html xmlns="http://www.w3.org/1999/xhtml"><body><nav><ol><li><a href="">No place</a></li><li><a href="c.xhtml"> </a></li><li><a href="c.xhtml">Named</a></li></ol></nav></body></html>'
    for name, toc in (("nav", ""), ("ncx", ' toc="x"')):
        with zipfile.ZipFile(tmp_path / f"{name}.epub", "w") as z:
            for path, text in (("META-INF/container.xml", '<container><rootfile full-path="b.opf"/></container>'), ("b.opf", opf.format(toc)), ("c.xhtml", page), ("n.xhtml", nav), ("t.ncx", "<ncx><navMap/></ncx>")):
                z.writestr(path, text)
    raw = bytearray((tmp_path / "nav.epub").read_bytes())
    at = raw.find(b"Some text.")
    raw[at : at + 4] = b"SOME"  # the member's checksum fails
    (tmp_path / "damaged.epub").write_bytes(bytes(raw))
    found = books.read_epub(spark, str(tmp_path)).cache()
    assert [r["book_id"] for r in found.where("error is not null").collect()] == ["damaged"]
    assert {(r["book_id"], r["cover"]) for r in books.covers(books.epub_table(found, "items")).collect()} == {("nav", "z-cover.png"), ("ncx", "z-cover.png")}
    assert {(r["href"], r["title"], r["text"]) for r in books.epub_table(found, "spine").collect()} == {("c.xhtml", "First", "Fi rst Second Some text.")}
    assert [(r["book_id"], r["title"]) for r in books.epub_table(found, "toc").collect()] == [("nav", "Named")]


def test_txt(spark, tmp_path):
    (tmp_path / "u.txt").write_bytes("Chapter 1\r\nHello there.\r\nChapter 2\r\nBye.".encode())
    (tmp_path / "g.txt").write_bytes("第一章 开始\n正文在此。".encode("gbk"))
    (tmp_path / "broken.txt").write_bytes(b"\xff\xff\xff")
    (tmp_path / "blank.txt").write_bytes(b" \n ")
    text = {r["book_id"]: r["text"] for r in books.read_txt(spark, str(tmp_path)).collect()}
    assert text["g"].startswith("第一章") and "\r" not in text["u"] and text["broken"] is None
    got = {(r["book_id"], r["idx"]): (r["title"], r["text"]) for r in books.txt_book_chapters(spark, str(tmp_path)).collect()}
    assert got == {("u", 0): ("Chapter 1", "Hello there."), ("u", 1): ("Chapter 2", "Bye."), ("g", 0): ("第一章", "开始 正文在此。")}


def test_format_dispatch(spark):
    df = spark.createDataFrame([("/a/b.EPUB",), ("c.azw3",)], "p string")
    assert [r[0] for r in df.select(books.format_of(F.col("p"))).collect()] == ["epub", "mobi"]
    with pytest.raises(Exception, match="supported: .azw3, .epub, .mobi, .pdf, .txt"):
        spark.createDataFrame([("x.doc",)], "p string").select(books.format_of(F.col("p"))).collect()


def test_documents(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "meta.json").write_text(json.dumps({"id": "b1", "title": "T", "chapters": [{"index": 0, "title": "c", "char_count": 3}]}, indent=1))
    (tmp_path / "x" / "bad.json").write_text("{not json")
    found = documents.read_books(spark, str(tmp_path))
    assert [(r["id"], r["chapters"][0]["title"]) for r in found.collect()] == [("b1", "c")]
    documents.write_books(found, str(tmp_path / "out"))
    assert "text" not in spark.read.json(str(tmp_path / "out")).select(F.explode("chapters").alias("c")).select("c.*").columns
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "m.json").write_text(json.dumps({"book_id": "b1", "completed_chapters": [2, 1, 2], "state": "running"}))
    assert documents.read_manifests(spark, str(tmp_path / "m")).head()["completed_chapters"] == [2, 1]


def test_inbox_processes_each_file_once(spark, tmp_path):
    box, out, at = (str(tmp_path / n) for n in ("in", "out", "at"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Part 1\nSome text.")
    inbox.ingest(spark, box, out, at).awaitTermination()
    (tmp_path / "in" / "b.txt").write_text("Part 2\nOther text.")
    inbox.ingest(spark, box, out, at).awaitTermination()
    assert sorted((r["book_id"], r["title"]) for r in spark.read.parquet(out).collect()) == [("a", "Part 1"), ("b", "Part 2")]
