"""Connected components of large edge tables by alternating star contractions.

Each round first contracts within partitions (a forest of stars per partition), then
applies the large-star and small-star steps, and is written to the shared folder, so
lineage stays short and a lost executor costs at most one round.  Only counts and
checksums reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import forget, small_batches, written
from leafmill.llm.textkit import give_back

#: Edges that a partition contracts at once.
CHUNK_EDGES = 500_000
#: Edges (16 bytes each) that one task may finish; more go through distributed rounds until they are so few.
LAST_EDGES = 1_000_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the same components as a-b: from each node to the smallest node of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        lo, hi = np.minimum(rx, ry), np.maximum(rx, ry)
        if (lo == hi).all():
            break
        np.minimum.at(root, hi, lo)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    k = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[k], nodes[root[k]]


def _contract(batches: Iterator[pa.RecordBatch], chunk: int = CHUNK_EDGES) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        e = np.concatenate(held, axis=1)
        a, b = stars(e[0], e[1])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
        size += batch.num_rows
        if size >= chunk:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()
    give_back()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node on an edge a-b (longs): the smallest node reachable from it."""
    small_batches(edges.sparkSession)
    contract = lambda df: df.mapInArrow(_contract, "a long, b long")
    now = written(contract(edges.select("a", "b").where("a != b")), "edges")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("b", "a"))).head()
        if mark == before or not mark[0]:
            break
        if mark[0] <= LAST_EDGES:
            now = now.coalesce(1).mapInArrow(lambda b: _contract(b, LAST_EDGES + 1), "a long, b long")
            break
        before = mark
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        nxt = written(contract(small.union(least.select("a", F.col("m").alias("b"))).distinct()), "edges")
        forget(now)
        now = nxt
    now = written(now, "stars")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(roots)
