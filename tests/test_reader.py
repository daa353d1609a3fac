"""The data source of book files: rows, columns, filters, errors, further formats."""

import zipfile

import pytest
from pyspark.sql import functions as F
from tests.test_sources import epub

from leafmill.plans import book_queries
from leafmill.sources import books, reader


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("books")
    (top / "sub").mkdir()
    epub(top / "a.epub")
    epub(top / "sub" / "b.EPUB", ncx=True)
    with zipfile.ZipFile(top / "a.epub", "a") as z:
        z.writestr("OPS/my-cover.png", b"picture bytes")
    raw = (top / "a.epub").read_bytes()
    (top / "spoilt.epub").write_bytes(raw.replace(b"picture bytes", b"PICTURE bytes"))  # its checksum is wrong
    (top / "bad.epub").write_bytes(b"no zip")
    (top / "t.txt").write_bytes("Zeile\r\nzwei".encode())
    (top / "g.TXT").write_bytes("中文".encode("gbk"))
    (top / "raw.txt").write_bytes(b"\xff\xff\xff")
    (top / "x.pdf").write_bytes(b"%PDF")
    (top / "y.doc").write_bytes(b"")
    (top / "_hidden").write_bytes(b"")
    reader.register(spark)
    return str(top)


def test_rows_equal_the_functions(spark, folder):
    got = spark.read.format("book").load(folder)
    assert got.count() == 9
    named = {r["book_id"]: r for r in got.collect()}
    assert named["t"]["text"] == "Zeile\nzwei" and named["g"]["text"] == "中文" and named["a"]["format"] == "epub" and named["y"]["format"] == "doc"
    errors = {k: r["error"].split(":")[0] for k, r in named.items() if r["error"]}
    assert errors.pop("bad") and errors == {"raw": "neither UTF-8 nor GBK", "x": "ValueError", "y": "ValueError", "spoilt": "BadZipFile"}
    assert bytes(named["a"]["cover"]) == b"picture bytes"
    held = books.read_epub(spark, folder).where("error is null")
    for part in ("items", "spine", "toc"):
        mine = got.where(F.col("book_id") == "a").select(F.inline(part)).collect()
        assert mine and sorted(map(str, mine)) == sorted(map(str, held.where("book_id = 'a'").select(F.inline(f"epub.{part}")).collect()))


def test_only_what_the_columns_need_is_read(spark, folder):
    # the spoilt picture is an error only where covers are asked for
    some = spark.read.format("book").schema("book_id string, toc array<struct<ord:int,title:string,href:string>>, error string").load(folder + "/spoilt.epub").head()
    assert some["error"] is None and [t["title"] for t in some["toc"]] == ["First", "Nested"]
    whole = spark.read.format("book").schema("cover binary, error string").load(folder + "/spoilt.epub").head()
    assert whole["cover"] is None and "BadZipFile" in whole["error"]
    names = spark.read.format("book").schema("path string, format string, size long").load(folder)
    assert {r["format"] for r in names.collect()} == {"epub", "txt", "pdf", "doc"}
    seen = books.parse_epub(open(folder + "/a.epub", "rb"), frozenset(("meta",)))
    assert seen["meta"] and not seen["spine"] and not seen["toc"] and "cover" not in seen


def test_filters_leave_files_out(spark, folder):
    got = spark.read.format("book").load(folder).where("format = 'txt' and book_id in ('t', 'g', 'a')")
    assert sorted(r["book_id"] for r in got.collect()) == ["g", "t"]
    scan = reader.BookReader({"path": folder}, spark.read.format("book").load(folder).schema, reader.READERS)
    from pyspark.sql.datasource import EqualTo, GreaterThan

    assert len(list(scan.pushFilters([EqualTo(("format",), "txt"), GreaterThan(("size",), 3)]))) == 1
    assert sorted(p.rsplit("/", 1)[1] for part in scan.partitions() for p, _ in part.files) == ["g.TXT", "raw.txt", "t.txt"]
    assert spark.read.format("book").option("pathGlobFilter", "*.epub").load(folder).count() == 3
    assert spark.read.format("book").load(folder).where("book_id = 'none'").count() == 0


def test_files_are_dealt_by_size(spark, folder, monkeypatch):
    monkeypatch.setattr(reader, "PARTITION_BYTES", 600)
    parts = reader.BookReader({"path": folder}, None, reader.READERS).partitions()
    assert len(parts) > 3 and sum(len(p.files) for p in parts) == 9
    assert all(sum(s for _, s in p.files) <= 600 or len(p.files) == 1 for p in parts)


def test_a_further_format(spark, folder):
    reader.register(spark, {".doc": lambda file, columns: {"text": f"{len(file.read())} bytes"}})
    got = {r["book_id"]: r for r in spark.read.format("book").schema("book_id string, text string, error string").load(folder).collect()}
    assert got["y"]["text"] == "0 bytes" and got["y"]["error"] is None and got["t"]["text"] == "Zeile\nzwei"
    reader.register(spark)


def test_the_queries_rows_through_the_source(spark, tmp_path):
    for name, content in book_queries._epub_files():
        (tmp_path / name.rsplit("/", 1)[-1]).write_bytes(content)
    reader.register(spark)
    found = spark.read.format("book").load(str(tmp_path))
    spine = found.where("error is null").select("book_id", F.inline("spine")).select("book_id", "ord", "href", "title", "text")
    assert sorted(map(tuple, spine.collect())) == sorted(map(tuple, book_queries.QUERIES["s3_epub_spine"].run(spark, "").collect()))


def test_a_text_is_held_about_once():
    import io
    import tracemalloc

    raw = ("wide \U0001f600 text, " * 200_000).encode()
    file = io.BytesIO(raw)
    tracemalloc.start()
    got = reader._text(file, frozenset())
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got["error"] is None and bytes(got["text"]) == raw and most < 1.5 * len(raw)
    for content, text in ((b"a\r\nb\rc", "a\nb\nc"), ("中\r文".encode("gbk"), "中\n文"), (b"", ""), (b"\xed\xa0\x80", None), (b"\xff\xff\xff", None)):
        found = reader._text(io.BytesIO(content), frozenset())["text"]
        assert (found.decode() if isinstance(found, bytes) else found) == text == books.decode_text(content)
