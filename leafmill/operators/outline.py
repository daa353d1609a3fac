"""PDF outline objects to table-of-contents rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from leafmill import reachable


def _walk(titles: dict[int, str | None], first: dict[int, int | None], after: dict[int, int | None], start: int | None) -> Iterator[tuple[int, int]]:
    """(object, level) in pre-order: children before what comes next; each object once."""
    held, seen = [(start, 1)], set()
    while held:
        at, level = held.pop()
        if at is None or at in seen or at not in titles:
            continue
        seen.add(at)
        held.append((after[at], level))
        if titles[at]:
            yield at, level
            held.append((first[at], level + 1))


def outline_rows(objects: DataFrame, starts: DataFrame) -> DataFrame:
    """The entries of each book's outline: book_id, ord, level, title, page.

    objects: book_id string, obj, title, first (its first child), next (its next sibling),
    page (what its destination resolves to, from 1; null if it doesn't).  starts: book_id,
    obj, where the walk of a book begins, the outline's own first entry.  An object without a
    title is passed over with its children; one without a page has no row, but its children
    may.  References to objects that aren't there end a branch.  An object that is met again,
    in a cycle or by a second reference, was taken where it was met first.

    A book's objects meet in one task, a few columns of what one file holds; books spread.
    """
    reachable(objects.sparkSession)

    def walk(given: pa.Table, begin: pa.Table) -> pa.Table:
        obj, title, first, after, page = (given.column(c).to_pylist() for c in ("obj", "title", "first", "next", "page"))
        pages, titles = dict(zip(obj, page)), dict(zip(obj, title))
        found = _walk(titles, dict(zip(obj, first)), dict(zip(obj, after)), begin.column("obj")[0].as_py() if begin.num_rows else None)
        rows = [(k, level, titles[k], pages[k]) for k, level in found if pages[k] is not None]
        book = (given if given.num_rows else begin).column("book_id")[0].as_py()
        ord_, level, title, page = range(len(rows)), *([r[i] for r in rows] for i in (1, 2, 3))
        return pa.table([pa.array([book] * len(rows), pa.string()), pa.array(list(ord_), pa.int32()), pa.array(level, pa.int32()), pa.array(title, pa.string()), pa.array(page, pa.int32())], ["book_id", "ord", "level", "title", "page"])

    columns = objects.selectExpr("cast(book_id as string) as book_id", "cast(obj as int) as obj", "title", "cast(first as int) as first", "cast(next as int) as next", "cast(page as int) as page").where("obj is not null")
    begin = starts.selectExpr("cast(book_id as string) as book_id", "cast(obj as int) as obj")
    return columns.groupBy("book_id").cogroup(begin.groupBy("book_id")).applyInArrow(walk, "book_id string, ord int, level int, title string, page int")
