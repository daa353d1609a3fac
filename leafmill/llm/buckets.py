"""Exchange of numpy columns between tasks in blocks.

A task sorts its rows by bucket (a range of the hashed key) and sends each bucket's
columns as binary blocks; the receiving task sees a bucket's blocks together.  The
number of buckets grows with the rows, so one fits in memory; senders combine equal
keys first, so that a key whose rows are equal adds at most a row per sending block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leafmill.llm.textkit import give_back

#: Rows of one bucket, about.
BUCKET_ROWS = 250_000
#: Bytes of one block's column at most.
BLOCK_BYTES = 4 << 20


def count_for(rows: float) -> int:
    return max(16, int(-(-rows // BUCKET_ROWS)))


def schema(width: int) -> str:
    return "bucket int, kind int, " + ", ".join(f"c{i} binary" for i in range(width))


def blocks(key: np.ndarray, n: int, kind: int, columns: list[np.ndarray], width: int = 0) -> Iterator[pa.RecordBatch]:
    """Record batches of the rows by bucket of the key; all columns are of 8-byte numbers, null ones fill up to `width`."""
    if not len(key):
        return
    bucket = (key % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    columns = [c[order] for c in columns]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    rows = []
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)]):
        for at in range(lo, hi, BLOCK_BYTES // 8):
            end = min(at + BLOCK_BYTES // 8, hi)
            rows.append((int(bucket[lo]), kind, *(c[at:end].tobytes() for c in columns)))
    width = max(width, len(columns))
    names = ["bucket", "kind", *(f"c{i}" for i in range(width))]
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * len(columns)]
    blank = [pa.binary()] * (width - len(columns))
    for lo in range(0, len(rows), 256):
        part = list(zip(*rows[lo : lo + 256]))
        arrays = [pa.array(x, t) for x, t in zip(part, kinds)]
        yield pa.RecordBatch.from_arrays([*arrays, *(pa.nulls(len(arrays[0]), t) for t in blank)], names)


def exchange(sent: DataFrame, n: int) -> DataFrame:
    return sent.repartitionById(n, "bucket").sortWithinPartitions("bucket")


def received(batches: Iterator[pa.RecordBatch], kinds: list[list[np.dtype]]) -> Iterator[dict[int, list[np.ndarray]]]:
    """Per bucket: kind -> columns, of exchange()'s rows."""
    now, held = None, {}

    def whole() -> dict[int, list[np.ndarray]]:
        return {k: [np.frombuffer(b"".join(x), t) for x, t in zip(zip(*rows), kinds[k])] for k, rows in held.items()}

    for batch in batches:
        bucket, kind = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        cols = [batch.column(2 + i) for i in range(batch.num_columns - 2)]
        for i, (b, k) in enumerate(zip(bucket, kind)):
            if b != now and held:
                yield whole()
                held = {}
            now = b
            held.setdefault(k, []).append(tuple(c[i].as_buffer() for c in cols[: len(kinds[k])]))
    if held:
        yield whole()
    give_back()
