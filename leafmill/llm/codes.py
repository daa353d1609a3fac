"""Vector codes: product quantisation with a kd-tree per codebook, in integers throughout.

A component x counts as floor(256 * x).  A vector is cut into PARTS equal consecutive
parts; each part position has a codebook that starts as that part of the ENTRIES
smallest ids.  A round broadcasts a kd-tree per codebook, assigns every part to its
nearest entry and replaces each entry by the componentwise floor of the mean of its
parts.  The search is branch and bound over bounding boxes: a node is left out only if
its bound is above the best distance, so entries at equal distance are all met and the
lowest index wins.  Tasks return integer sums and counts per codebook entry and
component, which Spark adds up; the driver receives the codebooks and nothing else, a
size that ENTRIES and the vectors' length fix.

Defined results: a vector that is null or holds a null or non-finite component has no
row.  Neither has one whose length isn't a positive multiple of PARTS, or differs from
the length of the vector with the smallest id: codebooks are for one length.  Null ids
come last in the order of ids; among equal ids the smaller integer vector comes first.
Repeated rows count each; with fewer than ENTRIES rows the codebooks are as short; an
entry that no part chose stays; an empty table stays empty.  A component of 65,536 or
more, either way, is an error: distances would leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import narrow, small_batches, written
from leafmill.llm.textkit import give_back

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries of a kd-tree's leaf, rows searched at once, and the largest scaled component.
LEAF_ENTRIES, BLOCK_ROWS, LARGEST = 8, 2000, 1 << 24


class Node(NamedTuple):
    """Entries below a node as indexes (of a leaf only), its bounding box, and its children."""

    low: np.ndarray
    high: np.ndarray
    entries: np.ndarray | None
    children: tuple


def kd_tree(book: np.ndarray, at: np.ndarray | None = None) -> Node:
    """The tree over the rows of a codebook: halved at the median of the widest side."""
    at = np.arange(len(book)) if at is None else at
    low, high = book[at].min(axis=0), book[at].max(axis=0)
    if len(at) <= LEAF_ENTRIES or (low == high).all():
        return Node(low, high, np.sort(at), ())
    order = at[np.argsort(book[at, int(np.argmax(high - low))], kind="stable")]
    half = len(order) // 2
    return Node(low, high, None, (kd_tree(book, order[:half]), kd_tree(book, order[half:])))


def _bound(node: Node, x: np.ndarray) -> np.ndarray:
    """Squared distance of each row of x from the node's box."""
    out = np.maximum(np.maximum(node.low - x, x - node.high), 0)
    return np.einsum("ij,ij->i", out, out)


def nearest(tree: Node, book: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry to each row; ties to the lower index."""
    best = np.full(len(x), np.iinfo(np.int64).max)
    index = np.full(len(x), len(book))

    def visit(node: Node, rows: np.ndarray) -> None:
        if node.entries is not None:
            gap = x[rows][:, None, :] - book[node.entries][None, :, :]
            far = np.einsum("ijk,ijk->ij", gap, gap)
            k = far.argmin(axis=1)  # the first of equals: entries are in ascending order
            d, e = far[np.arange(len(rows)), k], node.entries[k]
            closer = (d < best[rows]) | ((d == best[rows]) & (e < index[rows]))
            best[rows[closer]], index[rows[closer]] = d[closer], e[closer]
            return
        a, b = node.children
        to_a, to_b = _bound(a, x[rows]), _bound(b, x[rows])
        first = to_a <= to_b
        # the nearer child first; then the other one, for those rows that its bound doesn't rule out
        for child, near, bound in ((a, first, to_a), (b, ~first, to_b), (b, first, to_b), (a, ~first, to_a)):
            go = rows[near & (bound <= best[rows])]
            if len(go):
                visit(child, go)

    if len(x):
        visit(tree, np.arange(len(x)))
    return index, best


class Codebooks(NamedTuple):
    """Entries as [part, entry, component] and a tree for each part."""

    entries: np.ndarray
    trees: list[Node]

    @classmethod
    def of(cls, entries: np.ndarray) -> Codebooks:
        return cls(entries, [kd_tree(book) for book in entries])

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code, squared distance) of each row of x, [row, part, component], for each part."""
        found = [nearest(self.trees[j], self.entries[j], np.ascontiguousarray(x[:, j])) for j in range(len(self.trees))]
        return np.stack([c for c, _ in found], axis=1), np.stack([d for _, d in found], axis=1)

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def scaled(c: Column, scale: int = SCALE) -> Column:
    """The integer vector of a row; null if the vector is null or holds a null or non-finite component."""
    wide = c.cast("array<double>")
    good = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(wide, lambda x: F.when(F.abs(x * scale) < LARGEST, F.floor(x * scale)).otherwise(F.raise_error(F.lit("a component is too large for integer codes")).cast("long")))
    return F.when(good, whole)


def _matrix(column: pa.Array, length: int, parts: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, parts, length // parts)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK_ROWS):
            yield batch.slice(lo, BLOCK_ROWS)


def fit(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks over (id, x), x of one length that `parts` divides; none for an empty table."""
    spark = kept.sparkSession
    small_batches(spark)
    first = [r["x"] for r in kept.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").collect()]
    if not first:
        return None
    length = len(first[0])
    books = Codebooks.of(np.ascontiguousarray(np.array(first, np.int64).reshape(-1, parts, length // parts).transpose(1, 0, 2)))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now = shared.value
            total, count = np.zeros_like(now.entries), np.zeros(now.entries.shape[:2], np.int64)
            for block in _blocks(batches):
                x = _matrix(block.column(0), length, parts)
                codes, _ = now.assign(x)
                for j in range(parts):
                    np.add.at(total[j], codes[:, j], x[:, j])
                    count[j] += np.bincount(codes[:, j], minlength=count.shape[1])
            part, entry = np.nonzero(count)
            width = total.shape[2]
            give_back()
            columns = [np.repeat(part, width), np.repeat(entry, width), np.tile(np.arange(width), len(part)), total[part, entry].ravel(), np.repeat(count[part, entry], width)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "entry", "place", "s", "n"])

        added = kept.select("x").mapInArrow(sums, "part long, entry long, place long, s long, n long").groupBy("part", "entry", "place").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        # parts x entries x components rows: a size that doesn't grow with the table
        means = added.select("part", "entry", "place", "s", "n").toArrow()
        p, e, at, s, n = (means.column(k).to_numpy() for k in range(5))
        moved = books.entries.copy()
        moved[p, e, at] = s // n
        books = Codebooks.of(moved)
        shared.unpersist()
    return books


def kept_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS) -> DataFrame:
    """(id, label, x) of the vectors that have codes, written to the shared folder."""
    small_batches(vectors.sparkSession)
    all_rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), scaled(F.col(vector_col)).alias("x"))
    rows = written(all_rows.where((F.size("x") > 0) & (F.size("x") % parts == 0)), "code-vectors")
    length = rows.orderBy(F.col("id").asc_nulls_last(), "x").select(F.size("x")).head()
    return rows.where(F.size("x") == length[0]) if length else rows


def encode(kept: DataFrame, books: Codebooks) -> DataFrame:
    """(id, label, codes, error): the codes of each row's parts and the sum of their squared distances."""
    small_batches(kept.sparkSession)
    shared = kept.sparkSession.sparkContext.broadcast(books)
    parts, _, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            codes, far = shared.value.assign(_matrix(block.column(2), parts * width, parts))
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array(list(codes.astype(np.int32)), pa.list_(pa.int32())), pa.array(far.sum(axis=1))], ["id", "label", "codes", "error"])
        give_back()

    types = dict(kept.dtypes)
    return kept.select("id", "label", "x").mapInArrow(run, f"id {types['id']}, label {types['label']}, codes array<int>, error long")


def decode(codes: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """The rows with `approx`, the vector that their codes stand for, in the middle of each integer's interval."""
    table = F.lit([[entry for entry in book] for book in ((books.entries + 0.5) / scale).tolist()])
    return codes.withColumn("approx", F.flatten(F.transform("codes", lambda c, j: F.get(F.get(table, j), c))))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector that has a code.

    label_error sums the errors of equal labels, nulls together.
    """
    kept = kept_rows(vectors, id_col, vector_col, label_col, parts)
    books = fit(kept, parts, entries, rounds)
    if books is None:
        empty = kept.select(F.col("id").alias("vec_id"), F.lit("").alias("code"), *(F.lit(0).cast("long").alias(n) for n in ("error", "label_error")), F.lit("").alias("codebooks_sha256"))
        return empty.where(F.lit(False))
    rows = written(encode(kept, books), "codes")
    # errors are added up before the join, so a label that many rows share sends one row per task
    labels = written(rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "code-labels")
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    both = rows.join(narrow(labels), F.col("label").eqNullSafe(F.col("of")))
    return both.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))
