"""Book files as a data source: spark.read.format("book").load(folder).

One row per file, read by the reader of its extension.  Files are dealt to partitions by
size.  The columns to read are those of the schema that the caller gives; by it, a reader
opens a file, and in an archive the members, only as far as they need: without `cover`, no
image is read, and without anything but names, no file is opened.  Filters on path, book_id
and format leave files out before any is opened; register() turns their push-down on.
Whatever is wrong with a file is its row's `error`; an extension that no reader has is one.

Further formats are added with `register(spark, {".ext": read})`: read(open file, columns) returns
values by column name.  Paths are those that Arrow's file systems open; for a store that only
Spark reads, the functions of `books` take rows of bytes.
"""

from __future__ import annotations

import fnmatch
import posixpath
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from leafmill import reachable
from leafmill.sources.books import FORMATS, decode_text, parse_epub

SCHEMA = """book_id string, path string, format string, size long, error string, text string, cover binary, meta array<struct<key:string,value:string>>,
items array<struct<ord:int,item_id:string,href:string,media_type:string,properties:string>>, spine array<struct<ord:int,href:string,title:string,text:string>>, toc array<struct<ord:int,title:string,href:string>>"""
#: Bytes of files that a partition reads, unless one file is larger, and its files at most.
PARTITION_BYTES, PARTITION_FILES = 64 << 20, 1000
#: Columns that are known without opening a file.
OUTSIDE = ("book_id", "path", "format", "size")

Read = Callable[[object, frozenset], dict]


def _is_utf8(raw: bytes) -> bool:
    """Whether the bytes are strict UTF-8, told without a copy."""
    try:
        pa.StringArray.from_buffers(1, pa.array([0, len(raw)], pa.int32()).buffers()[1], pa.py_buffer(raw)).validate(full=True)
    except pa.ArrowInvalid:
        return False
    return True


def _text(file: object, columns: frozenset) -> dict:
    """The text as UTF-8 bytes where it is that: a string of wide characters would take up to four times as much."""
    raw = file.read()
    if b"\r" in raw:
        raw = raw.replace(b"\r\n", b"\n").replace(b"\r", b"\n")
    text = raw if _is_utf8(raw) else decode_text(raw)
    return {"text": text, "error": None if text is not None else "neither UTF-8 nor GBK"}


def _unreadable(file: object, columns: frozenset) -> dict:
    raise ValueError("this format isn't read here")


READERS: dict[str, Read] = {".epub": parse_epub, ".txt": _text, ".pdf": _unreadable, ".mobi": _unreadable, ".azw3": _unreadable}


def _system(path: str) -> tuple[fs.FileSystem, str]:
    local = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(local) if "://" in local or local.startswith("/") else (fs.LocalFileSystem(), posixpath.abspath(local))


def _names(path: str) -> dict[str, str]:
    stem, ext = posixpath.splitext(posixpath.basename(path))
    return {"book_id": stem, "path": path, "format": FORMATS.get(ext.lower(), ext.lower().lstrip("."))}


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class BookReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType, readers: dict[str, Read]):
        self.path, self.glob = options["path"], options.get("pathglobfilter", "*")
        self.schema, self.readers = schema, readers
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality on what a file's name says; Spark tests the others."""
        for f in filters:
            known = isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in ("book_id", "path", "format")
            if not known:
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.wanted[f.attribute[0]] = self.wanted.get(f.attribute[0], values) & values

    def partitions(self) -> Sequence[InputPartition]:
        system, base = _system(self.path)
        found = [system.get_file_info(base)] if system.get_file_info(base).type == fs.FileType.File else system.get_file_info(fs.FileSelector(base, recursive=True))
        files = sorted((i.path, i.size) for i in found if i.type == fs.FileType.File and fnmatch.fnmatch(i.base_name, self.glob) and not i.base_name.startswith(("_", ".")))
        files = [f for f in files if all(_names(f[0])[c] in v for c, v in self.wanted.items())]
        out: list[Files] = []
        held = 0
        for path, size in files:
            if not out or held + size > PARTITION_BYTES or len(out[-1].files) >= PARTITION_FILES:
                out.append(Files([]))
                held = 0
            out[-1].files.append((path, size))
            held += size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_schema(self.schema)
        columns = frozenset(kind.names)
        system, _ = _system(self.path)
        for path, size in partition.files:
            row = {**_names(path), "size": size}
            read = self.readers.get(posixpath.splitext(path)[1].lower())
            try:
                if read is None:
                    raise ValueError(f"unsupported format; supported: {', '.join(sorted(e.lstrip('.') for e in self.readers))}")
                if columns - set(OUTSIDE):
                    with system.open_input_file(path) as file:
                        row |= read(file, columns)
            except Exception as e:  # noqa: BLE001  whatever is wrong with a file is its row's error
                row["error"] = f"{type(e).__name__}: {e}"
            batch = pa.RecordBatch.from_arrays([pa.array([row.get(f.name)], f.type) for f in kind], schema=kind)
            del row  # the file's bytes go before its batch does
            yield batch
            del batch
            pa.default_memory_pool().release_unused()


class BookSource(DataSource):
    readers: dict[str, Read] = READERS

    @classmethod
    def name(cls) -> str:
        return "book"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> BookReader:
        return BookReader({k.lower(): v for k, v in self.options.items()}, schema, self.readers)


def register(spark: SparkSession, more: dict[str, Read] | None = None) -> None:
    """Make the format "book" known to the session, with readers of further extensions (lower case, with the dot)."""
    reachable(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(type("BookSource", (BookSource,), {"readers": {**READERS, **(more or {})}}))
